"""Queries over the graph: writes, belief, neighbourhoods, reducers, patterns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import belief
from ..operators import graph, pattern, scan
from .inputs import b64, edges, event_edges, event_log, nodes, register, sql, table

_CANON = "case when confidence <= .125 then 'ruled_out' when confidence <= .375 then 'unlikely' when confidence <= .625 then 'possible' when confidence <= .875 then 'probable' when confidence is not null then 'certain' end"
_ID = b64("'1|' || src || '|' || type || '|' || dst")


@register(
    "edge_upsert_fold",
    sql(f"""with x as (select src, dst, type, arg_max(coalesce(weight, 1.0::double), seq) as weight, arg_max(confidence, seq) filter (confidence is not null) as confidence,
            arg_max(props, seq) filter (props is not null) as props from event_log group by all)
        select {_ID} as id, src, dst, type, true as directed, weight, confidence, {_CANON} as modality, null::varchar as ambiguity, coalesce(props, '{{}}') as props from x"""),
)
def edge_upsert_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.upsert_edges(event_log(spark, sf_dir))


@register(
    "node_upsert_fold",
    """select 'user:' || user_id as id, list_sort(list_distinct([arg_max(event_type, event_id), 'user'])) as labels, coalesce(arg_max(props, event_id) filter (event_id % 2 = 0), '{}') as props,
       min(event_id) as created_at, max(event_id) as updated_at from events group by user_id""",
)
def node_upsert_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    log = e.select(
        F.concat(F.lit("user:"), F.col("user_id").cast("string")).alias("id"), F.col("event_id").alias("seq"), F.col("event_id").alias("at"),
        F.array(F.concat(F.lit(" "), "event_type"), F.lit("user"), F.lit(" "), F.lit("user")).alias("labels"), F.when(F.col("event_id") % 2 == 0, F.col("props")).alias("props"),
    )
    return graph.upsert_nodes(log)


@register(
    "reference_sentences",
    """with r as (select 'conv:' || conv_id as node, case when turn % 2 = 0 then 'turn_' || turn else 'ref_' || substr(sha256(trim(text)), 1, 20) end as ref, substr(trim(text), 1, 4096) as text, role as source, turn as ordinal
              from conversations where trim(text) <> ''),
        one as (select node, ref, min(ordinal) as ordinal from r group by all)
        select node, ref, ordinal, text, source from (select r.*, row_number() over (partition by node order by ordinal, ref) as n from one join r using (node, ref, ordinal)) as x where n <= 64""",
)
def reference_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    refs = c.select(
        F.concat(F.lit("conv:"), F.col("conv_id").cast("string")).alias("node"), F.when(F.col("turn") % 2 == 0, F.concat(F.lit("turn_"), F.col("turn").cast("string"))).alias("ref"),
        "text", F.col("role").alias("source"), F.col("turn").alias("ordinal"),
    )
    return graph.reference_sentences(refs)


@register("edge_batch_status", sql("select count(*) as requested, count(*) as applied, count(distinct src || dst) as created, count(*) - count(distinct src || dst) as updated, 0::bigint as failed from event_log"))
def edge_batch_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = event_log(spark, sf_dir).withColumnRenamed("seq", "idx")
    return graph.batch_status(log.select("idx", "src", "dst", "type", "directed"), edges(spark, sf_dir))


@register("edge_autocreate_stubs", sql("select distinct id from (select src as id from event_log union all select dst from event_log) as x where id not in (select id from nodes)"))
def edge_autocreate_stubs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.stubs(nodes(spark, sf_dir), event_log(spark, sf_dir))


@register("node_cascade_delete", sql("select id, src, dst, type, weight from edges where split_part(src, ':', 1) <> 'customer' and split_part(dst, ':', 1) <> 'customer'"))
def node_cascade_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = nodes(spark, sf_dir)
    return graph.delete_nodes(n, edges(spark, sf_dir), n.where("id like 'customer:%'"), cascade=True)[1].select("id", "src", "dst", "type", "weight")


@register("edge_delete", sql("select id, src, dst, type, weight from edges where type <> 'in_nation'"))
def edge_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = edges(spark, sf_dir)
    return graph.delete_edges(e, e.where("type = 'in_nation'")).select("id", "src", "dst", "type", "weight")


@register("modality_from_confidence", sql(f"select event_id, (event_id % 101) / 100.0::double as confidence, {_CANON.replace('confidence', '((event_id % 101) / 100.0::double)')} as modality from events"))
def modality_from_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", ((F.col("event_id") % 101) / 100.0).alias("confidence"))
    return e.withColumn("modality", belief.modality_of(F.col("confidence")))


@register("modality_predicate_rank", sql("select id, src, dst, coalesce(modality, 'certain') as modality from edges where coalesce(modality, 'certain') in ('probable', 'certain')"))
def modality_predicate_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    word = belief.effective_modality(F.col("modality"), F.col("confidence"))
    return edges(spark, sf_dir).where(belief.rank(word) >= belief.rank(F.lit("likely"))).select("id", "src", "dst", word.alias("modality"))


def _options(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("group"), F.col("l_partkey").alias("dst")).agg(F.sum("l_quantity").alias("q"))
    least = F.min("dst").over(Window.partitionBy("group"))
    share = F.when(F.col("group") % 5 == 0, None).when(F.col("group") % 2 == 0, F.col("q")).when(F.col("dst") == least, None).otherwise(F.col("q") / 1024)
    return lines.select("group", "dst", share.alias("share"))


_OPTIONS = """options as (select "group", dst, case when "group" % 5 = 0 then null when "group" % 2 = 0 then q when dst = min(dst) over (partition by "group") then null else q / 1024 end as share
        from (select l_orderkey as "group", l_partkey as dst, sum(l_quantity) as q from lineitem group by all) as x),
    counted as (select *, count(*) over w as n, count(share) over w as d, coalesce(sum(share) over w, 0) as total, coalesce(max(share) over w, 0) as top from options window w as (partition by "group")),
    filled as (select *, coalesce(share, case when d = 0 then 1.0::double / n when total <= 1 and top <= 1 then case when 1 - total > 0 then (1 - total) / (n - d) else 1.0::double / n end
        else case when total > 0 then total / d else 1.0::double / n end end) as s from counted),
    done as (select "group", dst, share, floor(s / sum(s) over (partition by "group") * 1e6::double + 0.5) / 1e6::double as confidence from filled)"""


@register("ambiguity_distribute", f"with {_OPTIONS} select \"group\", dst, share, confidence, {_CANON} as modality from done")
def ambiguity_distribute(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.distribute(_options(spark, sf_dir), group=["group"])


def _ambiguous(spark: SparkSession, sf_dir: str) -> DataFrame:
    shared = graph.distribute(_options(spark, sf_dir), group=["group"])
    s = lambda c: F.col(c).cast("string")
    return shared.select(
        F.concat_ws("|", s("group"), s("dst")).alias("id"), s("group").alias("src"), s("dst").alias("dst"), F.lit("holds").alias("type"), F.lit(True).alias("directed"), F.lit(1.0).alias("weight"),
        "confidence", "modality", F.lit("which").alias("ambiguity"), F.lit("{}").alias("props"),
    )


@register(
    "ambiguity_top",
    f"""with {_OPTIONS}, t as (select "group"::varchar as src, dst::varchar as dst, confidence, {_CANON} as modality from done)
        select src, 'which' as ambiguity, count(*) as options, round(sum(confidence), 5) as confidence_sum, arg_min(dst, (-confidence, dst)) as top, arg_min(modality, (-confidence, dst)) as top_modality from t group by src""",
)
def ambiguity_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.ambiguity(_ambiguous(spark, sf_dir)).withColumn("confidence_sum", F.round("confidence_sum", 5))


@register(
    "ambiguity_resolve",
    f"""with {_OPTIONS}, t as (select "group"::varchar as src, dst::varchar as dst, confidence, {_CANON} as modality, "group" % 2 = 0 as told, min(dst::varchar) over (partition by "group") as w from done)
        select src || '|' || dst as id, src, dst, case when not told then confidence when dst = w then 1.0 else 0.0 end as confidence,
               case when not told then modality when dst = w then 'certain' else 'ruled_out' end as modality, case when not told then 'which' end as ambiguity from t""",
)
def ambiguity_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _ambiguous(spark, sf_dir)
    winners = e.where("src % 2 = 0").groupBy("src", "ambiguity").agg(F.min("dst").alias("winner"))
    return graph.resolve_ambiguity(e, winners).select("id", "src", "dst", "confidence", "modality", "ambiguity")


# Neighbourhoods and reducers.

_ORDER = f"{b64('type')}, {b64('peer')}"


@register("neighbors_out", sql(f"select id, src, dst, type, weight from adj where dir = 'out' and node = 'supplier:3' order by {_ORDER} limit 128"))
def neighbors_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.neighbors(edges(spark, sf_dir), "supplier:3").select("id", "src", "dst", "type", "weight")


@register("neighbors_in_typed", sql(f"select id, src, dst, type, weight from adj where dir = 'in' and node = 'nation:3' and type = 'in_nation' order by {_ORDER} limit 128"))
def neighbors_in_typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.neighbors(edges(spark, sf_dir), "nation:3", direction="in", type="in_nation").select("id", "src", "dst", "type", "weight")


@register("neighbors_both", sql("select id, src, dst, type, weight from edges where src = 'nation:3' or dst = 'nation:3' order by src, type, dst limit 128"))
def neighbors_both(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.neighbors(edges(spark, sf_dir), "nation:3", direction="both").select("id", "src", "dst", "type", "weight")


@register("degree_both_weighted", sql("select node, count(*) as degree, round(sum(weight), 9) as weight from adj group by all"))
def degree_both_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.degree(edges(spark, sf_dir), direction="both", weighted=True).withColumn("weight", F.round("weight", 9))


@register("neighbor_types_hist", sql("select node, type, count(*) as n, round(sum(weight), 9) as weight from adj where dir = 'out' group by all"))
def neighbor_types_hist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.neighbor_types(edges(spark, sf_dir)).withColumn("weight", F.round("weight", 9))


@register(
    "neighbor_types_page",
    sql(f"""select node, type, count(*) as n, round(sum(weight), 9) as weight from (select *, row_number() over (partition by node, dir order by {_ORDER}) as r from adj) as x where r <= 16 group by all"""),
)
def neighbor_types_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.neighbor_types(edges(spark, sf_dir), direction="both", limit=16).withColumn("weight", F.round("weight", 9))


@register("reduce_degree", sql("select dir, node, type, count(*) as degree from adj group by all"))
def reduce_degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.reduce_degree(graph.adjacency(edges(spark, sf_dir), "both"))


def _meshed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The graph and, for triangles, customers linked to the nation of their orders' suppliers' number."""
    o = table(spark, sf_dir, "orders").select(
        F.concat(F.lit("order:"), F.col("o_orderkey").cast("string")).alias("src"), F.concat(F.lit("nation:"), (F.col("o_custkey") % 25).cast("string")).alias("dst"), F.lit("seen_in").alias("type")
    )
    return edges(spark, sf_dir).select("src", "dst", "type").unionByName(o)


_MESH = "mesh as (select src, dst, type from edges union all select 'order:' || o_orderkey, 'nation:' || (o_custkey % 25), 'seen_in' from orders)"


@register(
    "reduce_triangle",
    sql(f"""with {_MESH}, near as (select distinct src as node, dst as peer from mesh), link as (select distinct least(src, dst) as a, greatest(src, dst) as b from mesh where src <> dst),
        closed as (select x.node, count(*) as closed from near as x join near as y on x.node = y.node and x.peer < y.peer join link on a = x.peer and b = y.peer group by all),
        n as (select node, count(*) as neighbors from near group by all)
        select node, neighbors, coalesce(closed, 0) as closed, case when neighbors > 1 then coalesce(closed, 0) / (neighbors * (neighbors - 1) / 2.0::double) else 0.0::double end as coefficient from n left join closed using (node)"""),
)
def reduce_triangle(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _meshed(spark, sf_dir)
    return graph.reduce_triangles(graph.adjacency(e, "out"), e)


@register(
    "reduce_pagerank_seed",
    sql("""with o as (select src as node, count(*) as outs from edges group by all), i as (select dst as node, count(*) as ins from edges group by all)
        select node, coalesce(ins, 0) as ins, coalesce(outs, 0) as outs, (coalesce(ins, 0) + 1) / (coalesce(outs, 0) + 1)::double as score from o full join i using (node)"""),
)
def reduce_pagerank_seed(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = edges(spark, sf_dir)
    return graph.reduce_pagerank_seed(graph.adjacency(e, "out"), e)


@register(
    "reduce_pagerank_top",
    sql("""with o as (select src as node, count(*) as outs from edges group by all), i as (select dst as node, count(*) as ins from edges group by all)
        select node, coalesce(ins, 0) as ins, coalesce(outs, 0) as outs, (coalesce(ins, 0) + 1) / (coalesce(outs, 0) + 1)::double as score from o full join i using (node) order by score desc, node limit 256"""),
)
def reduce_pagerank_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = edges(spark, sf_dir)
    return graph.reduce_pagerank_seed(graph.adjacency(e, "out"), e, limit=scan.PAGE)


# Patterns.

_COLS = "id, src, dst, type, weight"
_SORT = f"order by {b64('type')}, {b64('peer')} limit 2048"


def _query(name: str, text: str, oracle: str, events: bool = False) -> None:
    @register(name, sql(oracle))
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return pattern.query((event_edges if events else edges)(spark, sf_dir), nodes(spark, sf_dir), text)


_query("gq_single_out", "MATCH (id='supplier:5')-[:supplies]->(*) LIMIT 2048", f"select {_COLS}, 1 as hop from adj where dir = 'out' and node = 'supplier:5' and type = 'supplies' {_SORT}")
_query("gq_single_in", "MATCH (id='nation:7')<-[:in_nation]-(*) LIMIT 2048", f"select {_COLS}, 1 as hop from adj where dir = 'in' and node = 'nation:7' and type = 'in_nation' {_SORT}")
_query(
    "gq_where_weight", "MATCH (id='supplier:5')-[]->(*) WHERE edge.weight >= 0.1 AND edge.confidence >= probable LIMIT 2048",
    f"select {_COLS}, 1 as hop from adj where dir = 'out' and node = 'supplier:5' and weight >= .1 and coalesce(confidence, 1) >= .75 {_SORT}",
)
_query(
    "gq_where_label", "MATCH (id='nation:7')<-[]-(*) WHERE from.label = 'BUILDING' AND from.id != 'customer:1' LIMIT 2048",
    f"select {_COLS}, 1 as hop from adj where dir = 'in' and node = 'nation:7' and src in (select id from nodes where list_contains(labels, 'BUILDING')) and src <> 'customer:1' {_SORT}",
)
_query(
    "gq_far_label", "MATCH (id='nation:7')<-[]-(id=*, label='supplier') LIMIT 2048",
    f"select {_COLS}, 1 as hop from adj where dir = 'in' and node = 'nation:7' and peer in (select id from nodes where list_contains(labels, 'supplier')) {_SORT}",
)
_EV = f"select {b64("'1|' || src || '|' || type || '|' || dst")} as id, src, dst, type, 1.0::double as weight, 1 as hop, dst as peer from event_edges where src = 'user:8'"
_query("gq_where_props_typed", "MATCH (id='user:8')-[]->(*) WHERE edge.props.k = 69 LIMIT 2048", f"select {_COLS}, hop from ({_EV} and (props->>'k') = '69') as x {_SORT}", True)
_query("gq_where_props_string", "MATCH (id='user:8')-[]->(*) WHERE edge.props.k = '69' LIMIT 2048", f"select {_COLS}, hop from ({_EV} and false) as x {_SORT}", True)
_query("gq_where_props_range", "MATCH (id='user:8')-[]->(*) WHERE edge.props.k > 50 LIMIT 2048", f"select {_COLS}, hop from ({_EV} and (props->>'k')::double > 50) as x {_SORT}", True)
_query("gq_props_missing_ne", "MATCH (id='user:8')-[]->(*) WHERE edge.props.absent != 5 LIMIT 2048", f"select {_COLS}, hop from ({_EV}) as x {_SORT}", True)
_query("gq_return_nodes", "MATCH (id='nation:7')<-[]-(*) RETURN nodes LIMIT 2048", f"select distinct unnest([src, dst]) as node from (select * from adj where dir = 'in' and node = 'nation:7' {_SORT}) as x")
_query("gq_return_paths", "MATCH (id='order:9')-[:placed_by]->(*) RETURN paths", f"select {_COLS}, 1 as hop from adj where dir = 'out' and node = 'order:9' and type = 'placed_by' {_SORT}")
_query("gq_return_count", "MATCH (id='nation:7')<-[]-(*) RETURN count LIMIT 2048", "select least(2048, count(*)) as n from adj where dir = 'in' and node = 'nation:7'")

#: Rows per node that a traversal reads, ranked, and its branch rank, in SQL.
_READ = f"readable as (select *, row_number() over (partition by node order by {_ORDER}) as r from adj where dir = 'in' and weight > 0)"


def _hops(cost: str = "", branch: int | None = None, anchors: str = "'nation:7'") -> str:
    """Paths of up to two edges against their direction, as unrolled joins."""
    top = f"qualify row_number() over (partition by anchor, path order by weight desc, 1 / weight, peer) <= {branch}" if branch else ""
    return f"""with {_READ}, usable as (select * from readable where r <= 256),
        h1 as (select node as anchor, [node] as path, 1 / weight as cost, * from usable where node in ({anchors})),
        f1 as (select anchor, peer as at, list_append(path, peer) as path, cost from h1 where not list_contains(path, peer) {cost} {top}),
        h2 as (select f.anchor, f.path, f.cost + 1 / u.weight as cost, u.* from f1 as f join usable as u on u.node = f.at)"""


_query(
    "gq_hops_1_2", "MATCH (id='region:2')<-[]-(*) HOPS 1..2 BRANCH_LIMIT 256 LIMIT 2048",
    _hops(branch=256, anchors="'region:2'") + f""", found as (select distinct {_COLS}, peer, 1 as hop from h1 union select distinct {_COLS}, peer, 2 from h2)
        select {_COLS}, hop from found order by hop, {_ORDER} limit 2048""",
)
_query(
    "gq_hops_cost", "MATCH (id='nation:7')<-[]-(*) HOPS 1..2 BRANCH_LIMIT 256 COST_LIMIT 4 LIMIT 2048",
    _hops("and cost <= 4", 256) + f""", found as (select distinct {_COLS}, peer, 1 as hop from h1 where cost <= 4 union select distinct {_COLS}, peer, 2 from h2 where cost <= 4)
        select {_COLS}, hop from found order by hop, {_ORDER} limit 2048""",
)
_query(
    "gq_hops_branch", "MATCH (id='region:2')<-[]-(*) HOPS 2..2 BRANCH_LIMIT 3 LIMIT 2048",
    _hops(branch=3, anchors="'region:2'") + f" select distinct {_COLS}, 2 as hop from h2 order by {_ORDER.replace('peer', 'src')} limit 2048",
)


@register(
    "gq_hops_bulk",
    sql(_hops(branch=8, anchors="select 'nation:' || n_nationkey from nation") + """
        select anchor, id, src, dst, type, weight, round(min(cost), 6) as cost, hop from (select anchor, id, src, dst, type, weight, cost, 1 as hop from h1 union all select anchor, id, src, dst, type, weight, cost, 2 from h2) as x group by all"""),
)
def gq_hops_bulk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The traversal from all nations at once."""
    plan = pattern.parse("MATCH (id='nation:0')<-[]-(*) HOPS 1..2 BRANCH_LIMIT 8")
    anchors = table(spark, sf_dir, "nation").select(F.concat(F.lit("nation:"), F.col("n_nationkey").cast("string")).alias("anchor"))
    return pattern.traverse(edges(spark, sf_dir), nodes(spark, sf_dir), plan, anchors).withColumn("cost", F.round("cost", 6))
