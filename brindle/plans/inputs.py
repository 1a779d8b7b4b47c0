"""The library's data models derived from the relational tables: as DataFrames, and as SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import belief
from ..functions.literals import edge_id
from ..operators import linkpred
from .lineage import cut

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _id(kind: str, key: str) -> Column:
    return F.concat(F.lit(f"{kind}:"), F.col(key).cast("string"))


# Names and values.


def values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """key, payload, bytes: the documents' texts under doc_id + 1."""
    return table(spark, sf_dir, "documents").select((F.col("doc_id") + 1).alias("key"), F.col("text").alias("payload"), F.octet_length("text").cast("long").alias("bytes"))


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """name, key, hidden: language, source and number of each document; what is labelled toxic is hidden."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    toxic = labels.where("toxic = 1").select("doc_id").distinct().withColumn("hidden", F.lit(True))
    name = F.concat_ws(":", F.lit("ctx"), "lang", "source", F.lpad(F.col("doc_id").cast("string"), 9, "0"))
    return docs.select("doc_id", name.alias("name")).join(toxic, "doc_id", "left").select("name", (F.col("doc_id") + 1).alias("key"), F.coalesce("hidden", F.lit(False)).alias("hidden"))


# The graph.


def _edges(df: DataFrame, src: Column, dst: Column, kind: str, weight: Column | None = None, confidence: Column | None = None) -> DataFrame:
    return df.select(
        src.alias("src"), dst.alias("dst"), F.lit(kind).alias("type"), F.lit(True).alias("directed"), (F.lit(1.0) if weight is None else weight).alias("weight"),
        (F.lit(None) if confidence is None else confidence).cast("double").alias("confidence"), F.lit("{}").alias("props"),
    )


def _with_belief(rows: DataFrame) -> DataFrame:
    return rows.select(
        edge_id(F.col("src"), F.col("type"), F.col("dst"), F.col("directed")).alias("id"), "src", "dst", "type", "directed", "weight", "confidence",
        belief.modality_of(F.col("confidence")).alias("modality"), F.lit(None).cast("string").alias("ambiguity"), "props",
    )


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Who is where, who ordered and who supplies what, with weights from prices and quantities."""
    t = lambda n: table(spark, sf_dir, n)
    flag = F.col("flag")
    supplies = t("lineitem").groupBy("l_suppkey", "l_partkey").agg(F.sum("l_quantity").alias("q"), F.min("l_returnflag").alias("flag"))
    status = F.col("o_orderstatus")
    parts = [
        _edges(t("nation"), _id("nation", "n_nationkey"), _id("region", "n_regionkey"), "in_region"),
        _edges(t("customer"), _id("customer", "c_custkey"), _id("nation", "c_nationkey"), "in_nation"),
        _edges(t("supplier"), _id("supplier", "s_suppkey"), _id("nation", "s_nationkey"), "in_nation"),
        _edges(t("orders"), _id("order", "o_orderkey"), _id("customer", "o_custkey"), "placed_by", F.least(F.lit(1.0), F.col("o_totalprice") / 500000), F.when(status == "F", 0.75).when(status == "O", 0.25)),
        _edges(supplies, _id("supplier", "l_suppkey"), _id("part", "l_partkey"), "supplies", F.least(F.lit(1.0), F.col("q") / 500), F.when(flag == "A", 0.75).when(flag == "R", 0.25)),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return _with_belief(out)


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id and labels of what the tables name."""
    t = lambda n: table(spark, sf_dir, n)
    a = lambda df, i, *labels: df.select(i.alias("id"), F.array(*labels).alias("labels"))
    out = a(t("region"), _id("region", "r_regionkey"), F.lit("region"), F.col("r_name"))
    for df in (
        a(t("nation"), _id("nation", "n_nationkey"), F.lit("nation"), F.col("n_name")),
        a(t("customer"), _id("customer", "c_custkey"), F.lit("customer"), F.col("c_mktsegment")),
        a(t("supplier"), _id("supplier", "s_suppkey"), F.lit("supplier"), F.col("s_name")),
        a(t("orders"), _id("order", "o_orderkey"), F.lit("order"), F.col("o_orderpriority")),
        a(t("part"), _id("part", "p_partkey"), F.lit("part"), F.col("p_name")),
    ):
        out = out.unionByName(df)
    return out


def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes of edges from users to event types, in order of event_id."""
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("event_id").alias("seq"), _id("user", "user_id").alias("src"), _id("type", "event_type").alias("dst"), F.lit("did").alias("type"), F.lit(True).alias("directed"),
        F.when(F.col("event_id") % 7 != 0, F.least(F.lit(1.0), F.abs(F.col("value")) / 500)).alias("weight"),
        F.when(F.col("event_id") % 5 == 0, (F.col("event_id") % 9) / 8.0).alias("confidence"), F.lit(None).cast("string").alias("modality"), F.lit(None).cast("string").alias("ambiguity"),
        F.when(F.col("event_id") % 3 != 0, F.col("props")).alias("props"),
    )


def event_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An edge per event, its props as they are."""
    e = table(spark, sf_dir, "events")
    rows = e.select(
        _id("user", "user_id").alias("src"), _id("event", "event_id").alias("dst"), F.col("event_type").alias("type"), F.lit(True).alias("directed"),
        F.lit(1.0).alias("weight"), F.lit(None).cast("double").alias("confidence"), "props",
    )
    return _with_belief(rows)


# Prediction.


def pred(spark: SparkSession, sf_dir: str) -> DataFrame:
    """key: an event type; value: what a user did next; score: its share, as a logit; weights of depth 0 and 1 from counts."""
    from pyspark.sql import Window

    e = table(spark, sf_dir, "events")
    after = e.select(F.col("event_type").alias("key"), F.lead("event_type").over(Window.partitionBy("user_id").orderBy("event_id")).alias("value")).where("value is not null")
    n = after.groupBy("key", "value").agg(F.count("*").alias("n"))
    whole = n.groupBy("key").agg(F.sum("n").alias("total"))
    share = F.col("n") / F.col("total")
    w = lambda d, *v: F.struct(F.lit(d).alias("depth"), F.array(*v).alias("vector"), (F.col("n") % 5 / 10.0).alias("bias"))
    weights = F.array(w(0, share, F.lit(0.5)), w(1, F.col("n") % 7 / 7.0))
    return n.join(whole, "key").select("key", "value", share.alias("score"), weights.alias("weights"))


def lp_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """relation, src, dst, p: what parts orders hold, of what type parts are, who ordered."""
    t = lambda n: table(spark, sf_dir, n)
    line = t("lineitem").groupBy("l_orderkey", "l_partkey").agg(F.max("l_quantity").alias("q"), F.min("l_returnflag").alias("f"))
    a = line.select(F.concat(F.lit("holds_"), F.lower("f")).alias("relation"), _id("order", "l_orderkey").alias("src"), _id("part", "l_partkey").alias("dst"), (F.col("q") / 50).alias("p"))
    b = t("part").select(F.lit("generalizations").alias("relation"), _id("part", "p_partkey").alias("src"), _id("brand", "p_brand").alias("dst"), (F.col("p_size") / 50.0).alias("p"))
    c = t("orders").select(F.lit("placed_by").alias("relation"), _id("order", "o_orderkey").alias("src"), _id("customer", "o_custkey").alias("dst"), F.lit(0.5).alias("p"))
    return a.unionByName(b).unionByName(c)


def lp_split(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return linkpred.split(cut(lp_edges(spark, sf_dir)), 0.2, 42)


# The same in SQL.

_MODALITY = "case when confidence is null then null when confidence <= .125 then 'ruled_out' when confidence <= .375 then 'unlikely' when confidence <= .625 then 'possible' when confidence <= .875 then 'probable' else 'certain' end"


def b64(x: str) -> str:
    return f"replace(translate(to_base64(encode({x})), '+/', '-_'), '=', '')"


_EDGE_ID = b64("'1|' || src || '|' || type || '|' || dst")

CTES: dict[str, str] = {
    "vals": "select doc_id + 1 as key, text as payload, strlen(text)::bigint as bytes from documents",
    "pairs": """select 'ctx:' || lang || ':' || source || ':' || lpad(doc_id::varchar, 9, '0') as name, doc_id + 1 as key,
        doc_id in (select doc_id from labels where toxic = 1) as hidden from documents""",
    "edges_": """
        select 'nation:' || n_nationkey as src, 'region:' || n_regionkey as dst, 'in_region' as type, 1.0::double as weight, null::double as confidence from nation
        union all select 'customer:' || c_custkey, 'nation:' || c_nationkey, 'in_nation', 1.0, null from customer
        union all select 'supplier:' || s_suppkey, 'nation:' || s_nationkey, 'in_nation', 1.0, null from supplier
        union all select 'order:' || o_orderkey, 'customer:' || o_custkey, 'placed_by', least(1.0::double, o_totalprice / 500000), case o_orderstatus when 'F' then .75 when 'O' then .25 end from orders
        union all select 'supplier:' || l_suppkey, 'part:' || l_partkey, 'supplies', least(1.0::double, sum(l_quantity) / 500), case min(l_returnflag) when 'A' then .75 when 'R' then .25 end
            from lineitem group by l_suppkey, l_partkey""",
    "edges": f"select {_EDGE_ID} as id, *, {_MODALITY} as modality from edges_",
    "nodes": """
        select 'region:' || r_regionkey as id, ['region', r_name] as labels from region
        union all select 'nation:' || n_nationkey, ['nation', n_name] from nation
        union all select 'customer:' || c_custkey, ['customer', c_mktsegment] from customer
        union all select 'supplier:' || s_suppkey, ['supplier', s_name] from supplier
        union all select 'order:' || o_orderkey, ['order', o_orderpriority] from orders
        union all select 'part:' || p_partkey, ['part', p_name] from part""",
    "adj": "select src as node, dst as peer, 'out' as dir, * from edges union all select dst, src, 'in', * from edges",
    "event_log": """select event_id as seq, 'user:' || user_id as src, 'type:' || event_type as dst, 'did' as type,
        case when event_id % 7 <> 0 then least(1.0::double, abs(value) / 500) end as weight, case when event_id % 5 = 0 then (event_id % 9) / 8.0::double end as confidence,
        case when event_id % 3 <> 0 then props end as props from events""",
    "event_edges": "select 'user:' || user_id as src, 'event:' || event_id as dst, event_type as type, props from events",
    "after": "select event_type as key, lead(event_type) over (partition by user_id order by event_id) as value from events",
    "pred": """select key, value, n, n / (sum(n) over (partition by key))::double as score, (n % 5) / 10.0::double as bias, (n % 7) / 7.0::double as w1
        from (select key, value, count(*) as n from after where value is not null group by all) as x""",
    "lp_edges": """
        select 'holds_' || lower(f) as relation, 'order:' || l_orderkey as src, 'part:' || l_partkey as dst, q / 50 as p
            from (select l_orderkey, l_partkey, max(l_quantity) as q, min(l_returnflag) as f from lineitem group by all) as x
        union all select 'generalizations', 'part:' || p_partkey, 'brand:' || p_brand, p_size / 50.0::double from part
        union all select 'placed_by', 'order:' || o_orderkey, 'customer:' || o_custkey, 0.5::double from orders""",
    "lp_ranked": """select *, relation <> 'generalizations' as free,
        row_number() over (partition by relation <> 'generalizations' order by md5('42' || chr(31) || relation || chr(31) || src || chr(31) || dst), relation, src, dst) as r,
        count(*) over (partition by relation <> 'generalizations') as n from lp_edges""",
    "train": "select relation, src, dst, p from lp_ranked where not (free and r <= greatest(1, floor(n * 0.2::double + 0.5)))",
    "held": "select relation, src, dst, p from lp_ranked where free and r <= greatest(1, floor(n * 0.2::double + 0.5))",
    "rel_prior": "select relation, avg(p) as prior from train group by all",
    "src_prior": "select src, relation, avg(p) as source_prior from train group by all",
    "tgt_prior": "select relation, dst, count(*) / (sum(count(*)) over (partition by relation))::double as target_prior from train group by relation, dst",
    "has": "select distinct src, relation from train",
    "cond": """select l.relation as "left", r.relation as "right", count(*) as pair, any_value(p.presence) as presence, count(*) / any_value(p.presence)::double as conditional
        from has as l join has as r on l.src = r.src and l.relation <> r.relation join (select relation, count(*) as presence from has group by all) as p on p.relation = l.relation group by all""",
    "cats": "select src as entity, dst as category, max(p) as cp from train where relation = 'generalizations' group by all having max(p) > 0",
    "rel_cat": """select relation, category, w / sum(w) over (partition by relation) as share
        from (select relation, category, sum(p * cp) as w from train join cats on dst = entity where relation <> 'generalizations' group by all) as x""",
    "pool": "select relation, dst, row_number() over (partition by relation order by dst) - 1 as n, count(*) over (partition by relation) as size from (select distinct relation, dst from train) as x",
    "tries": """select h.relation, h.src, h.dst as true_dst, k, ('0x' || substr(md5('42' || chr(31) || h.relation || chr(31) || h.src || chr(31) || h.dst || chr(31) || k), 1, 12))::bigint % s.size as n
        from held as h join (select distinct relation, size from pool) as s using (relation), range(1, 17) as ks(k)""",
    "negs": """select relation, src, dst from (
            select t.relation, t.src, t.true_dst, p.dst, row_number() over (partition by t.relation, t.src, t.true_dst order by t.k) as r
            from tries as t join pool as p on p.relation = t.relation and p.n = t.n
            where p.dst <> t.true_dst and not exists (select 1 from train as x where x.relation = t.relation and x.src = t.src and x.dst = p.dst)) as y where r = 1""",
    "cand": "select relation, src, dst, 1 as label from held union all select relation, src, dst, 0 from negs",
    "prob_": """select c.*, coalesce(prior, 0) as prior, source_prior, target_prior,
            case when source_prior is not null then 0.6::double * source_prior + 0.4::double * coalesce(prior, 0) else coalesce(prior, 0) end as own
        from cand as c left join rel_prior using (relation) left join src_prior using (src, relation) left join tgt_prior using (relation, dst)""",
    "prob": "select relation, src, dst, label, target_prior, greatest(0, least(1, case when target_prior is not null then 0.75::double * own + 0.25::double * target_prior else own end)) as prob from prob_",
    "ctx": """select c.relation, c.src, sum(k * conditional) / sum(k) as context
        from (select distinct relation, src from cand) as c join (select src, relation as l, count(*) as k from train group by all) as s on s.src = c.src and s.l <> c.relation
        join cond on cond."left" = s.l and cond."right" = c.relation group by all""",
    "tcat": "select c.relation, c.dst, max(share) as category from (select distinct relation, dst from cand) as c join cats on c.dst = entity join rel_cat as r on r.relation = c.relation and r.category = cats.category group by all",
    "impl": """select p.*, greatest(0, least(1, 0.45::double * coalesce(context, 0) + 0.25::double * coalesce(category, 0) + 0.2::double * coalesce(target_prior, 0) + 0.1::double * prob)) as implicit
        from prob as p left join ctx using (relation, src) left join tcat using (relation, dst)""",
}


def sql(body: str) -> str:
    """The body with the tables it names, and those they name, put before it."""
    import re

    wanted: set[str] = set()

    def need(text: str) -> None:
        for name in CTES:
            if name not in wanted and re.search(rf"\b(?:from|join)\s+{name}\b", text):
                wanted.add(name)
                need(CTES[name])

    need(body)
    if not wanted:
        return body
    own = ", ".join(f"{n} as ({q})" for n, q in CTES.items() if n in wanted)
    body = body.strip()
    if body.startswith("with recursive "):
        return f"with recursive {own}, {body[15:]}"
    return f"with {own}, {body[5:]}" if body.startswith("with ") else f"with {own} {body}"


def rounded(c: Column | str) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


