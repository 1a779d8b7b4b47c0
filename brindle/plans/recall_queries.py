"""Queries over the lexical index, recall, similarity and the association cache."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import memo, recall, terms
from .inputs import b64, edges, nodes, register, sql, table
from .lineage import cut


def _tokens(x: str) -> str:
    split = f"list_filter(regexp_split_to_array(lower({x}), '[^\\p{{L}}\\p{{Nd}}]+'), lambda t: t <> '')"
    return f"list_filter({split}, lambda t, i: list_position({split}, t) = i)"


_DISTINCT = lambda x: f"list_filter({x}, lambda t, i: list_position({x}, t) = i)"
_ALL = f"list_concat({_tokens('id')}, list_concat({_tokens('labels[1]')}, {_tokens('labels[2]')}))"
_INDEX = f"indexed as (select id as node, ({_DISTINCT('a')})[1:12] as tokens from (select id, {_ALL} as a from nodes) as x), posted as (select distinct unnest(tokens) as token, node from indexed), vocab as (select token, count(*) as df from posted group by all)"


@register("term_tokens", sql(f"with {_INDEX} select node, tokens from indexed"))
def term_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return terms.node_tokens(nodes(spark, sf_dir))


@register("term_df_idf", sql(f"with {_INDEX} select token, df, round(ln((n + 1) / (df + 1)::double) + 1, 6) as idf from vocab, (select count(*) as n from nodes) as x"))
def term_df_idf(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = nodes(spark, sf_dir)
    df = terms.frequencies(terms.postings(terms.node_tokens(n)))
    return df.crossJoin(F.broadcast(n.agg(F.count("*").alias("n")))).select("token", "df", F.round(terms.idf(F.col("n"), F.col("df")), 6).alias("idf"))


_GRAMS = "list_distinct(list_transform(range(1, len(token) + 1), lambda i: substr('^' || token || '$', i, 3)))"


@register("term_trigrams", sql(f"with {_INDEX} select gram, count(*) as tokens from (select unnest({_GRAMS}) as gram from vocab) as x group by all"))
def term_trigrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = terms.frequencies(terms.postings(terms.node_tokens(nodes(spark, sf_dir))))
    return vocabulary.select(F.explode(terms.trigrams(F.col("token"))).alias("gram")).groupBy("gram").agg(F.count("*").alias("tokens"))


_WORDS = "words as (select distinct word as token from (select unnest(string_split(p_name, ' ')) as word from part union all select unnest(['widgit', 'smal', 'builidng', 'urgnet', 'automobil']) as word) as x)"


@register(
    "term_fuzzy_top8",
    sql(f"""with {_INDEX}, {_WORDS}, a as (select token, {_GRAMS} as g, case when len(token) <= 8 then 1 else 2 end as reach from words where len(token) > 2), b as (select token as match, df, {_GRAMS} as g from vocab as v),
        m as (select a.token, match, df, reach, levenshtein(a.token, match) as d, len(list_intersect(a.g, b.g)) as s, len(a.g) + len(b.g) as t from a join b on a.token <> match and abs(len(a.token) - len(match)) <= reach),
        r as (select token, match, df, 0.75::double * (1 - d / greatest(len(token), len(match))::double) + 0.25::double * (s / (t - s)::double) as similarity from m where s > 0 and d <= reach)
        select token, match, df, round(similarity, 6) as similarity from r qualify row_number() over (partition by token order by similarity desc, df, match) <= 8"""),
)
def term_fuzzy_top8(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = terms.frequencies(terms.postings(terms.node_tokens(nodes(spark, sf_dir))))
    asked = table(spark, sf_dir, "part").select(F.explode(F.split("p_name", " ")).alias("token"))
    typos = spark.createDataFrame([(w,) for w in ("widgit", "smal", "builidng", "urgnet", "automobil")], "token string")
    return terms.fuzzy(asked.unionByName(typos), vocabulary).withColumn("similarity", F.round("similarity", 6))


@register(
    "term_index_stats",
    sql(f"with {_INDEX} select (select count(*) from posted) as entries, (select count(*) from nodes) as nodes, (select count(*) from vocab) as tokens, (select count(distinct g) from (select unnest({_GRAMS}) as g from vocab) as x) as trigrams"),
)
def term_index_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = nodes(spark, sf_dir)
    return terms.stats(n, cut(terms.node_tokens(n)))


@register(
    "term_weighted_score",
    sql("""with t as (select p_partkey as id, list_distinct(string_split(p_name, ' ')) as tokens from part), v as (select token, count(*) as df from (select unnest(tokens) as token from t) as x group by all),
        w as (select token, ln(((select count(*) from part) + 1) / (df + 1)::double) + 1 as weight from v where token in ('red', 'widget', 'small')),
        s as (select id, any_value(len(tokens)) as size, sum(weight) as shared, count(*) as n from (select id, tokens, unnest(tokens) as token from t) as x join w using (token) group by all)
        select 'q' as query, id as candidate, round(least(1, shared / (total + mean * greatest(size - n, 0))), 6) as score from s, (select sum(weight) as total, avg(weight) as mean from w) as z"""),
)
def term_weighted_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    own = part.select(F.col("p_partkey").alias("candidate"), F.array_distinct(F.split("p_name", " ")).alias("tokens"))
    df = own.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("df")).where(F.col("token").isin("red", "widget", "small"))
    asked = df.crossJoin(F.broadcast(part.agg(F.count("*").alias("n")))).select(F.lit("q").alias("query"), "token", terms.idf(F.col("n"), F.col("df")).alias("weight"))
    return terms.weighted_score(asked, own).withColumn("score", F.round("score", 6))


# Recall.  Every customer is a query of two seeds; all are asked at once.


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer's query asks for the customer and for the nation five after its own."""
    c = table(spark, sf_dir, "customer")
    name = lambda kind, col: F.concat(F.lit(f"{kind}:"), col.cast("string"))
    own = c.select(name("customer", F.col("c_custkey")).alias("query"), F.array(name("customer", F.col("c_custkey")), name("nation", (F.col("c_nationkey") + 5) % 25)).alias("s"))
    return own.select("query", F.explode("s").alias("seed"))


_ASKED = "asked as (select 'customer:' || c_custkey as query, unnest(['customer:' || c_custkey, 'nation:' || ((c_nationkey + 5) % 25)]) as seed from customer)"
_LINKS = f"""ranked as (select *, row_number() over (partition by node, dir order by {b64('type')}, {b64('peer')}) as r from adj),
    links as (select distinct node, peer, id, type, greatest(0, least(1, weight)) * greatest(0, least(1, coalesce(confidence, 1))) as affinity from ranked where r <= 64 and node <> peer)"""


def _spread(factor: str, hops: int, precision: float) -> str:
    """Best activation of (query, node, seed) after one or two hops, in SQL."""
    floor = precision / 2 if hops == 1 else max(precision / 2, 0.01)
    out = f"""{_ASKED}, {_LINKS}, t0 as (select query, seed as node, seed, 1.0::double as a, 0 as d from asked)"""
    for h in range(1, hops + 1):
        before = f"t{h - 1}"
        new = f"select t.query, l.peer as node, t.seed, max(t.a * l.affinity * {factor}) as a, {h} as d from n{h - 1} as t join links as l on l.node = t.node group by t.query, l.peer, t.seed having max(t.a * l.affinity * {factor}) >= {floor}" if h > 1 else \
            f"select t.query, l.peer as node, t.seed, max(t.a * l.affinity * {factor}) as a, {h} as d from t0 as t join links as l on l.node = t.node group by t.query, l.peer, t.seed having max(t.a * l.affinity * {factor}) >= {floor}"
        out += f""", n{h} as (select n.* from ({new}) as n left join {before} as b using (query, node, seed) where b.a is null or n.a > b.a),
            t{h} as (select * from {before} where (query, node, seed) not in (select query, node, seed from n{h}) union all select * from n{h})"""
    return out


def _ranked(hops: int, precision: float, factor: str = "0.55::double", least: int = 1) -> str:
    return f"""with {_spread(factor, hops, precision)},
        g as (select query, node, 1 - product(1 - a) as raw, min(d) as distance, count(*) as source_count from t{hops} group by all),
        s as (select * from g where (query, node) not in (select query, seed from asked) and source_count >= {least} and raw >= {precision})
        select query, node, round(raw, 6) as score, round(raw * (distance / (distance + 1)::double) * source_count / 2.0::double, 6) as novelty, distance, source_count from s"""


def _recall(spark: SparkSession, sf_dir: str, **options) -> DataFrame:
    found = recall.recall_exact(_asked(spark, sf_dir), edges(spark, sf_dir), recall.Options(synonyms=False, synonym_types=(), limit=None, **options), paths=False)
    return found.select("query", "node", F.round("score", 6).alias("score"), F.round("novelty", 6).alias("novelty"), "distance", "source_count")


@register("recall_1hop", sql(_ranked(1, 0.1)))
def recall_1hop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _recall(spark, sf_dir, hops=1, precision=0.1)


@register("recall_2hop", sql(_ranked(2, 0.1)))
def recall_2hop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _recall(spark, sf_dir, hops=2, precision=0.1)


@register("recall_bridges", sql(_ranked(2, 0.05, least=2)))
def recall_bridges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _recall(spark, sf_dir, hops=2, precision=0.05, min_sources=2)


_FACTORS = {"in_region": 1.25, "in_nation": 0.75, "placed_by": 1.1}
_FACTOR = "least(1, 0.55::double * case l.type " + " ".join(f"when '{k}' then {v}::double" for k, v in _FACTORS.items()) + " else 1 end)"


@register("recall_relation_decay", sql(_ranked(2, 0.1, _FACTOR)))
def recall_relation_decay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _recall(spark, sf_dir, hops=2, precision=0.1, relation_factors=_FACTORS)


@register("recall_relation_factors", "select event_type as relation, round(.5 + 1 / (1 + exp(avg(value) / 100 - count(*) / 10000.0::double)), 6) as factor from events group by all")
def recall_relation_factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("key")).agg((F.count("*") / 10000.0).alias("carry"), (F.avg("value") / 100).alias("stop"))
    decay = e.select("key", F.explode(F.create_map(F.lit("carry"), "carry", F.lit("stop"), "stop")).alias("value", "score"))
    return recall.relation_factors(decay).withColumn("factor", F.round("factor", 6))


@register(
    "recall_seed_resolve",
    sql(f"""with {_INDEX}, q as (select distinct p_name as seed from part), w as (select distinct seed, unnest(string_split(seed, ' ')) as word from q),
        v as (select seed, word, df, ln(((select count(*) from nodes) + 1) / (df + 1)::double) + 1 as weight from w join vocab on token = word),
        listed as (select token, node from posted qualify row_number() over (partition by token order by node) <= 512),
        h as (select seed, node, sum(weight) as evidence, list(word) as matched from v join listed on token = word group by all),
        t as (select seed, sum(weight) as total, avg(weight) as mean from v group by all),
        s as (select seed, node, least(1, evidence / (total + mean * len(list_filter({_tokens('node')}, lambda x: not list_contains(matched, x))))) as share from h join t using (seed))
        select seed, node, floor(share * 0.99::double * 1e6 + .5) / 1e6 as score, 'lexical' as match from s where share >= .25
        qualify row_number() over (partition by seed order by floor(share * 0.99::double * 1e6 + .5) / 1e6 desc, node) <= 8"""),
)
def recall_seed_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = table(spark, sf_dir, "part").select(F.lit("q").alias("query"), F.col("p_name").alias("seed"))
    return recall.resolve(asked, nodes(spark, sf_dir), edges(spark, sf_dir)).select("seed", "node", "score", "match")


@register("recall_evidence")
def recall_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Associations of every nation's names with labels, path and sources."""
    n = nodes(spark, sf_dir)
    asked = table(spark, sf_dir, "nation").select(F.col("n_name").alias("query"), F.col("n_name").alias("seed"))
    found = recall.recall(asked, n, edges(spark, sf_dir), recall.Options(hops=2, precision=0.1))
    sentences = n.where("id like 'customer:%'").select(F.col("id").alias("node"), F.element_at("labels", 2).alias("text"), F.lit(0).alias("ordinal"), F.lit("segment").alias("ref"))
    return recall.evidence(found, n, sentences).select("query", "node", "rank", "score", "labels", F.size("via").alias("steps"), F.size("references").alias("n_references"))


@register("recall_batched", sql(f"""with r as ({_ranked(1, 0.1)}) select node, floor((1 - product(1 - score)) * 1e6 + .5) / 1e6 as score, sum(source_count)::bigint as source_count from r group by node"""))
def recall_batched(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recall.merged_batches(recall_1hop(spark, sf_dir))


# Similarity.

_NEAR = "near as (select distinct node, peer from adj where node <> peer and type = 'supplies'), sizes as (select node, count(*) as n from near group by all)"


@register(
    "similar_context",
    sql(f"""with {_NEAR}, s as (select a.node as id, b.node as candidate, count(*) as shared_count from near as a join near as b on a.peer = b.peer and a.node <> b.node group by all)
        select id, candidate, round(shared_count / (x.n + y.n - shared_count)::double, 6) as score, shared_count from s join sizes as x on x.node = id join sizes as y on y.node = candidate
        where shared_count / (x.n + y.n - shared_count)::double >= .05 and id like 'supplier:%'"""),
)
def similar_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = edges(spark, sf_dir).where("type = 'supplies'")
    asked = nodes(spark, sf_dir).where("id like 'supplier:%'")
    found = recall.similar(asked, nodes(spark, sf_dir), e, by="context", limit=None, listed=False)
    return found.select("id", "candidate", F.round("score", 6).alias("score"), "shared_count")


@register("similar_all")
def similar_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 32 most similar nodes of every nation, by neighbours and by name."""
    n = nodes(spark, sf_dir)
    return recall.similar(n.where("id like 'nation:%'"), n, edges(spark, sf_dir))


# The association cache.


def _links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What co-occurs in orders, as remembered links: per supplier and part."""
    line = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").cast("string").alias("src"), F.col("l_partkey").cast("string").alias("dst"))
    return line.agg(F.max(F.col("l_quantity") / 50).alias("score"), F.min("l_linenumber").cast("long").alias("distance"), F.count("*").alias("sources"), F.count("*").alias("observations"), F.sum(F.col("l_linenumber") % 2).alias("hits")).withColumns(
        {"created": F.lit(0.0), "refreshed": (F.col("score") * 36000), "used": F.col("hits") * 100.0}
    )


_LINKED = """mem as (select *, score * 36000 as refreshed, hits * 100.0::double as used from (select l_suppkey::varchar as src, l_partkey::varchar as dst, max(l_quantity / 50) as score, min(l_linenumber)::bigint as distance,
    count(*) as observations, sum(l_linenumber % 2)::bigint as hits from lineitem group by all) as x),
    worth as (select *, pow(2.0::double, -greatest(40000 - greatest(refreshed, used), 0) / 21600) * (2 * ln(1 + hits) + ln(1 + observations)) * (.25 + .75 * score) as utility from mem)"""


@register("cache_utility_rank", f"with {_LINKED} select src, dst, round(utility, 6) as utility, round(hits / (hits + observations)::double, 6) as usage from worth")
def cache_utility_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _links(spark, sf_dir).select("src", "dst", F.round(memo.utility(40000.0), 6).alias("utility"), F.round(memo.usage(F.col("hits"), F.col("observations")), 6).alias("usage"))


@register("cache_admission_prob", f"with {_LINKED} select src, dst, round(greatest(0, least(1, .25 * (.15 + .85 * score) * case when distance < 2 then .3 else 1 end * 1.5)), 9) as p from mem")
def cache_admission_prob(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _links(spark, sf_dir).select("src", "dst", F.round(memo.admission(F.col("score"), F.col("distance"), 1.5), 9).alias("p"))


@register(
    "cache_aging",
    f"""with {_LINKED} select src, dst, hits // 2 as hits, case when hits // 2 = 0 and observations // 2 = 0 then 1 else observations // 2 end as observations
        from worth where utility >= .05 * greatest(1, (select count(*) from mem) / 1000.0::double)""",
)
def cache_aging(spark: SparkSession, sf_dir: str) -> DataFrame:
    return memo.prune(_links(spark, sf_dir), 40000.0, capacity=1000, age=True).select("src", "dst", "hits", "observations")


@register(
    "cache_observe",
    f"""with {_LINKED}, seen as (select l_suppkey::varchar as src, l_partkey::varchar as dst, max(l_discount * 8) as score, min(l_linenumber) as distance, count(*) as n from lineitem where l_suppkey <> l_partkey group by all)
        select m.src, m.dst, greatest(m.score, least(1.0::double, coalesce(s.score, 0))) as score, least(m.distance, coalesce(s.distance, m.distance))::bigint as distance, observations + coalesce(n, 0) as observations from mem as m left join seen as s on s.src = m.src and s.dst = m.dst""",
)
def cache_observe(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").cast("string").alias("src"), F.col("l_partkey").cast("string").alias("dst"), (F.col("l_discount") * 8).alias("score"), F.col("l_linenumber").cast("long").alias("distance"), F.lit(1).cast("long").alias("sources"))
    return memo.observe_links(_links(spark, sf_dir), seen, 40000.0).select("src", "dst", "score", "distance", "observations")


@register(
    "cache_shortcuts",
    f"with {_LINKED} select src, dst, score from mem where score >= .5 qualify row_number() over (partition by src order by score desc, dst) <= 16",
)
def cache_shortcuts(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = _links(spark, sf_dir)
    return memo.shortcuts(links, links.select(F.col("src").alias("node")), floor=0.5)
