"""Queries over transfers, schemas, vocabularies and what the association cache knows of itself."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import memo, records, scan, store, vocabulary
from ..sources import edgelist, snapshots
from .inputs import pairs, pred, register, sql, table, values
from .lineage import shared
from .recall_queries import _LINKED, _links
from .store_queries import _PARTS, PARTS, _parts


def _folder(spark: SparkSession) -> str:
    return f"{shared(spark)}/transfer-{uuid.uuid4().hex}"


# Sources, sinks, transfers.

_ACTIONS = ("+", "-", "promote", "")


@register(
    "source_edge_list",
    """with raw as (select lower(event_type) || '_rel' as relation, 'user_' || user_id as src, 'item_' || event_id % 50 as dst, greatest(0, least(1, value / 100)) as p from events where event_id % 4 <> 1)
        select relation, src || '~' as src, dst || '~' as dst, max(p) as p from raw where p >= .05 group by all""",
)
def source_edge_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events written as an edge list, one action in four negative, and read as one."""
    e, where = table(spark, sf_dir, "events"), _folder(spark)
    action = F.element_at(F.array(*[F.lit(a) for a in _ACTIONS]), (F.col("event_id") % 4 + 1).cast("int"))
    raw = e.select(
        F.concat(F.upper("event_type"), F.lit(" rel ")).alias("Relation"), action.alias("Action"), F.concat(F.lit("User "), "user_id").alias("Entity"), F.concat(F.lit("#Item "), (F.col("event_id") % 50).cast("string")).alias("Value"),
        (F.col("value") / 100).cast("string").alias("Probability"), F.lit("log").alias("Source"), F.lit("1").alias("Iteration of Promotion"),
    )
    raw.write.csv(where, sep="\t", header=True, quote="", emptyValue="")
    return edgelist.read(spark, where, least=0.05)


@register("sink_report", "select event_type, count(*) as n, 'first' as run from events group by event_type union all select event_type, count(*), 'second' from events group by event_type")
def sink_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs' reports, as the metrics file has them."""
    report, where = table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n")), _folder(spark)
    for run in ("first", "second"):
        edgelist.write_report(report, where, run)
    return spark.read.csv(f"{where}/metrics", header=True, schema="event_type string, n long, run string")


@register("fork_transfer", sql("select name, payload, hidden from pairs join vals using (key) where name like 'ctx:en:%'"))
def fork_transfer(spark: SparkSession, sf_dir: str) -> DataFrame:
    where = _folder(spark)
    snapshots.export_fork(pairs(spark, sf_dir), values(spark, sf_dir), pred(spark, sf_dir), "ctx:en:", where)
    return snapshots.import_fork(spark, where)[0]


@register("pred_saved", sql("select key, value, round(score, 6) as score, case when w1 + bias >= 0.0001 then 2 else 1 end::int as kept from pred"))
def pred_saved(spark: SparkSession, sf_dir: str) -> DataFrame:
    where = _folder(spark)
    snapshots.save_predictions(pred(spark, sf_dir), where)
    return spark.read.parquet(where).select("key", "value", F.round("score", 6).alias("score"), F.size("weights").alias("kept"))


# Names with payloads, full scans, ids, vocabularies.


@register(
    "pair_put_payloads",
    sql("""with w as (select 'ctx:en:src1:' || lpad(o_custkey::varchar, 9, '0') as name, o_orderkey as seq, (select max(key) from vals) + row_number() over (order by o_orderkey) as key from orders),
        last as (select name, max(key) as key from w group by name)
        select coalesce(l.name, p.name) as name, coalesce(l.key, p.key) as key, case when l.name is not null then false else p.hidden end as hidden from pairs as p full join last as l using (name)"""),
)
def pair_put_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order writes its priority under a name of its customer's number, some of which are documents' names."""
    name = F.concat(F.lit("ctx:en:src1:"), F.lpad(F.col("o_custkey").cast("string"), 9, "0"))
    writes = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("seq"), name.alias("name"), F.col("o_orderpriority").alias("payload"), F.lit(False).alias("hidden"))
    return store.upsert_payloads(pairs(spark, sf_dir), values(spark, sf_dir), writes)[0]


@register("pair_scan_json", "select 'event:' || event_id as name, event_id + 1 as key, props ->> '$.k' as k from events")
def pair_scan_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    named = e.select(F.concat(F.lit("event:"), "event_id").alias("name"), (F.col("event_id") + 1).alias("key"), F.lit(False).alias("hidden"))
    found = scan.scan_json(named, e.select((F.col("event_id") + 1).alias("key"), F.col("props").alias("payload")), "event:")
    return found.select("name", "key", F.col("fields")["k"].alias("k"))


@register("kv_free_ids", "select 1000 as ids, 1000 as different, 0 as taken")
def kv_free_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A thousand free ids, counted, as they are random."""
    taken = table(spark, sf_dir, "documents").select(F.md5(F.col("doc_id").cast("string").cast("binary")).alias("id"))
    free = store.free_ids(taken, 1000).join(taken.withColumn("taken", F.lit(1)), "id", "left")
    return free.agg(F.count("*").alias("ids"), F.countDistinct("id").alias("different"), F.count("taken").alias("taken"))


_VOCABULARY = """known as (select p_brand as name, row_number() over (order by p_brand) - 1 as token from (select distinct p_brand from part) as b),
    fresh as (select p_type as name, (select max(token) from known) + row_number() over (order by p_type) as token from (select distinct p_type from part where p_type not in (select name from known)) as t),
    vocab as (select * from known union all select * from fresh)"""


def _vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts' brands have tokens; then their types get some."""
    p = table(spark, sf_dir, "part")
    known = vocabulary.allocate(spark.createDataFrame([], vocabulary.VOCABULARY), p.select(F.col("p_brand").alias("name")))
    return vocabulary.allocate(known, p.select(F.col("p_type").alias("name")))


@register("vocab_allocate", f"with {_VOCABULARY} select name, token from vocab")
def vocab_allocate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _vocabulary(spark, sf_dir)


@register("vocab_encode", f"with {_VOCABULARY} select p_partkey, b.token as brand, t.token as type, p_type as back from part join vocab as b on b.name = p_brand join vocab as t on t.name = p_type")
def vocab_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = _vocabulary(spark, sf_dir)
    coded = vocabulary.encode(vocabulary.encode(table(spark, sf_dir, "part"), own, "p_brand", "brand"), own, "p_type", "type").select("p_partkey", "brand", "type")
    return vocabulary.decode(coded, own, "type", "back").select("p_partkey", "brand", "type", "back")


# Record schemas.


@register(
    "rec_define",
    """select * from (values ('name', 'string', 64, 0, false), ('size', 'uint', 2, 64, true), ('price', 'float', 4, 66, false), ('brand', 'string', 16, 70, false), ('cheap', 'bool', 1, 86, false))
        as t(name, kind, width, "offset", indexed)""",
)
def rec_define(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fields of a defined schema, one of them indexed."""
    schema = records.index(PARTS, "size")
    return spark.createDataFrame([(f.name, f.kind, f.width, f.offset, f.indexed) for f in schema.fields], "name string, kind string, width int, offset int, indexed boolean")


@register("rec_index_range", f"select key, size, name from {_PARTS} where size between 10 and 19")
def rec_index_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = records.clustered(records.index(PARTS, "size"), _parts(spark, sf_dir), "size")
    return rows.where("size between 10 and 19").select("key", "size", "name")


# The cache's identities, classes, answers and budget.

_TOLD = "|p=0.0500|h=2|d=both|m=1|k=0.5500|cd=1.00|rd=-|b=32|t=placed_by"


@register(
    "cache_signature",
    f"""select 'customer:' || o_custkey as query, substr(sha256(string_agg('order:' || o_orderkey || chr(0), '' order by 'order:' || o_orderkey) || '{_TOLD}'), 1, 32) as signature from orders group by o_custkey""",
)
def cache_signature(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every customer the signature of comparing their orders."""
    asked = table(spark, sf_dir, "orders").select(F.concat(F.lit("customer:"), "o_custkey").alias("query"), F.concat(F.lit("order:"), "o_orderkey").alias("origin"))
    return memo.signatures(asked, precision=0.05, hops=2, direction="both", min_sources=1, decay=0.55, branch=32, types=["placed_by"])


@register(
    "cache_query_class",
    """with q as (select event_id, event_id % 9 as hops, user_id % 5 as least, event_id % 3 as d, event_id % 12 as seeds, event_id % 2 = 0 as typed from events),
        s as (select *, ((hops & 7) << 4) | ((least(least, 3) & 3) << 2) | case d when 0 then 1 when 1 then 2 else 0 end as shape, case when seeds <= 1 then 0 when seeds <= 3 then 1 when seeds <= 8 then 2 else 3 end as bucket from q)
        select event_id, (xor(xor(shape, bucket << 1), typed::int << 5) % 64)::int as class from s""",
)
def cache_query_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    way = F.element_at(F.array(F.lit("out"), F.lit("in"), F.lit("both")), (i % 3 + 1).cast("int"))
    own = memo.query_class_column(hops=i % 9, min_sources=F.col("user_id") % 5, direction=way, seeds=i % 12, typed=i % 2 == 0)
    return table(spark, sf_dir, "events").select("event_id", own.cast("int").alias("class"))


@register(
    "cache_class_bias",
    """with c as (select user_id as class, count(*) as lookups, count(*) filter (event_type = 'click') as hits, count(*) filter (event_type = 'error') as writes, 1.0::double + (user_id % 3 - 1) * .25::double as bias from events group by user_id
            union all select -1 - length(event_type), count(*), count(*) filter (value > 50), 0, 1.0 from events group by event_type),
        b as (select *, hits / lookups::double / .2::double as rate, lookups >= 32 as enough from c),
        f as (select *, case when enough then .7::double * bias + .3::double * least(greatest(rate, .1::double), 2.0::double) else bias end as e from b)
        select class, lookups, round(floor(least(greatest(case when e < 1 then 1 - (1 - e) / (1 - .1::double) * (1 - .75::double) else 1 + (e - 1) * .25::double end, .75::double), 1.25::double) / .05::double + .5) * .05::double, 6) as factor,
               round(case when enough then least(greatest(.7::double * bias + .3::double * rate, .1::double), 2.0::double) else bias end, 6) as new_bias, case when enough then lookups // 2 else lookups end as new_lookups, case when enough then hits // 2 else hits end as new_hits from f""",
)
def cache_class_bias(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of recall that events stand for: a user each, and a type each."""
    e = table(spark, sf_dir, "events")
    of = lambda hit, write: [F.count("*").alias("lookups"), F.count(F.when(hit, 1)).alias("hits"), F.count(F.when(write, 1)).alias("writes")]
    users = e.groupBy(F.col("user_id").alias("class")).agg(*of(F.col("event_type") == "click", F.col("event_type") == "error")).withColumn("bias", 1.0 + (F.col("class") % 3 - 1) * 0.25)
    types = e.groupBy("event_type").agg(*of(F.col("value") > 50, F.lit(False))).select((-1 - F.length("event_type")).cast("long").alias("class"), "lookups", "hits", "writes", F.lit(1.0).alias("bias"))
    out = memo.class_factors(users.unionByName(types))
    return out.select("class", "lookups", F.round("factor", 6).alias("factor"), F.round("new_bias", 6).alias("new_bias"), "new_lookups", "new_hits")


def _answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers of customers: all of one epoch of the graph, those of a segment again of the next."""
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    members = o.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.array_sort(F.collect_list(F.struct(F.col("o_orderkey").cast("string").alias("node"), F.least(F.lit(1.0), F.col("o_totalprice") / 500000).alias("score")))).alias("members"))
    fresh = members.join(c, "c_custkey").select(F.col("c_custkey").cast("string").alias("signature"), "members", "c_mktsegment")
    none = spark.createDataFrame([], snapshots.SCHEMAS["answers"])
    first = memo.observe_answers(none, fresh.select("signature", "members"), 100.0, 1)
    return memo.observe_answers(first, fresh.where("c_mktsegment = 'BUILDING'").select("signature", "members"), 200.0, 2)


_ANSWERED = "told as (select c_custkey, c_mktsegment = 'BUILDING' as again, count(o_orderkey) as n from customer left join orders on o_custkey = c_custkey group by all)"


@register(
    "cache_serve",
    f"with {_ANSWERED} select c_custkey::varchar as signature, n > 0 and again as hit, n > 0 and not again as stale, case when n > 0 and again then least(n, 64)::int end as members from told",
)
def cache_serve(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("signature"))
    served = memo.serve(_answers(spark, sf_dir), asked, 2)
    return served.select("signature", "hit", "stale", F.when(F.col("hit"), F.size("members")).alias("members"))


@register(
    "cache_stats",
    f"with {_LINKED}, {_ANSWERED} select (select count(*) from worth) as links, (select sum(hits) from worth)::bigint as link_hits, (select round(avg(utility), 6) from worth) as mean_utility, (select count(*) from told where n > 0) as answers, 0::bigint as answer_hits",
)
def cache_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return memo.stats(_links(spark, sf_dir), _answers(spark, sf_dir), 40000.0).withColumn("mean_utility", F.round("mean_utility", 6))


@register("cache_budget", f"with {_LINKED} select src, dst, round(utility, 6) as utility from worth order by utility desc, src, dst limit 1000")
def cache_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The thousand most useful links: what a budget of that size keeps."""
    kept = memo.within_budget(_links(spark, sf_dir), 40000.0, 1000)
    return kept.select("src", "dst", F.round(memo.utility(40000.0), 6).alias("utility"))
