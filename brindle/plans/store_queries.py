"""Queries over values, names, reducers and records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.literals import b64url, decode_literal, normalise_token
from ..operators import records, scan, store
from .inputs import pairs, register, sql, table, values


def _keys(spark: SparkSession, sf_dir: str, every: int) -> DataFrame:
    return values(spark, sf_dir).where(F.col("key") % every == 0).select("key")


@register("kv_insert", sql("select t.top + row_number() over (order by o_orderkey) as key, o_orderpriority as payload from orders, (select max(key) as top from vals) as t"))
def kv_insert(spark: SparkSession, sf_dir: str) -> DataFrame:
    new = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("seq"), F.col("o_orderpriority").alias("payload"))
    return store.insert(values(spark, sf_dir).select("key", "payload"), new)[0]


@register("kv_insert_declared_size", sql("select o_orderkey as seq, o_orderpriority as payload, o_orderkey % 3 + 5 as size, 'invalid_value_size' as error from orders where o_orderkey % 3 + 5 <> strlen(o_orderpriority)"))
def kv_insert_declared_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    new = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("seq"), F.col("o_orderpriority").alias("payload"), (F.col("o_orderkey") % 3 + 5).alias("size"))
    return store.insert(values(spark, sf_dir).select("key", "payload"), new, declared="size")[1]


@register("kv_point_join", sql("select k.key, payload, v.key is not null as found from (select distinct o_custkey as key from orders) as k left join vals as v using (key)"))
def kv_point_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.read(values(spark, sf_dir).select("key", "payload"), table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("key")))


@register(
    "kv_edit_fold",
    sql("""with last as (select user_id as key, arg_max(event_type, event_id) as new from events group by all)
        select v.key, coalesce(new, payload) as payload from vals as v left join last using (key)"""),
)
def kv_edit_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    edits = table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("seq"), F.col("event_type").alias("payload"))
    return store.edit(values(spark, sf_dir).select("key", "payload"), edits)


@register("kv_delete_anti", sql("select key, payload from vals where key % 3 <> 0"))
def kv_delete_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.delete(values(spark, sf_dir).select("key", "payload"), _keys(spark, sf_dir, 3))


@register("pair_upsert", sql("select 'type:' || event_type as name, max(event_id) as key, arg_max(event_id % 2 = 1, event_id) as hidden from events group by event_type"))
def pair_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return store.upsert_pairs(e.select(F.concat(F.lit("type:"), "event_type").alias("name"), F.col("event_id").alias("key"), (F.col("event_id") % 2 == 1).alias("hidden"), F.col("event_id").alias("seq")))


@register("pair_get", sql("select * from pairs where name = 'ctx:en:src1:000000001' or name = (select min(name) from pairs)"))
def pair_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = pairs(spark, sf_dir)
    least = p.agg(F.min("name").alias("name"))
    return store.get(p, "ctx:en:src1:000000001").unionByName(p.join(F.broadcast(least), "name")).distinct()


@register("pair_unbind", sql("select * from pairs where key % 4 <> 0"))
def pair_unbind(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = pairs(spark, sf_dir)
    return store.unbind(p, p.where("key % 4 = 0"))


@register("pair_purge_remaining", sql("select * from pairs where name not like 'ctx:de:%'"))
def pair_purge_remaining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.purge(pairs(spark, sf_dir), values(spark, sf_dir), "ctx:de:")[0]


@register("pair_purge_payloads", sql("select key, bytes from vals where key not in (select key from pairs where name like 'ctx:de:%')"))
def pair_purge_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.purge(pairs(spark, sf_dir), values(spark, sf_dir).select("key", "bytes"), "ctx:de:", payloads=True)[1]


def _batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    name = F.when(F.col("o_orderkey") % 1000 != 999, F.concat(F.lit("o:"), F.col("o_orderkey").cast("string"))).otherwise("")
    return o.select(F.col("o_orderkey").alias("idx"), name.alias("name"), F.col("o_orderpriority").alias("payload"))


_BATCH = "select o_orderkey as idx, case when o_orderkey % 1000 <> 999 then 'o:' || o_orderkey else '' end as name, o_orderpriority as payload from orders"


@register("batch_continue", f"select *, name <> '' as valid, name <> '' as applied from ({_BATCH}) as b")
def batch_continue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.put_batch(_batch(spark, sf_dir), continue_on_error=True)


@register("batch_stop_at_first_failure", f"select *, name <> '' as valid, idx < (select min(idx) from ({_BATCH}) as c where name = '') as applied from ({_BATCH}) as b")
def batch_stop_at_first_failure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.put_batch(_batch(spark, sf_dir))


@register("pair_hydrate", sql("select name, p.key, hidden, bytes, payload, false as dangling from pairs as p join vals as v using (key)"))
def pair_hydrate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.hydrate(pairs(spark, sf_dir), values(spark, sf_dir))


@register("json_patch", "select user_id as key, arg_max(event_type, event_id) as kind, arg_max(value, event_id)::varchar as value from events group by user_id")
def json_patch(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    base = e.select(F.col("user_id").alias("key")).distinct().withColumn("payload", F.lit('{"kind":"none"}'))
    one = lambda field, c: e.select(F.col("user_id").alias("key"), F.col("event_id").alias("seq"), F.lit(field).alias("field"), c.cast("string").alias("value"))
    done = store.mutate_json(base, one("kind", F.col("event_type")).unionByName(one("value", F.col("value"))))
    return done.select("key", F.get_json_object("payload", "$.kind").alias("kind"), F.get_json_object("payload", "$.value").alias("value"))


@register("value_literals", "select doc_id, case when doc_id % 2 = 0 then hex(encode(lang)) else hex(encode(lang || ':x')) end as hex from documents")
def value_literals(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    raw = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("x"), F.lower(F.hex(F.col("lang").cast("binary"))))).otherwise(F.concat("lang", F.lit(":x")))
    return d.select("doc_id", F.hex(decode_literal(raw)).alias("hex"))


@register("token_normalise", "select p_partkey, trim(regexp_replace(regexp_replace(lower(p_name || ' #' || p_brand || '!'), '[^a-z0-9_.:/+-]', '_', 'g'), '_+', '_', 'g'), '_') as token from part")
def token_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return p.select("p_partkey", normalise_token(F.concat("p_name", F.lit(" #"), "p_brand", F.lit("!"))).alias("token"))


@register("base64url", "select doc_id, replace(translate(to_base64(encode(text)), '+/', '-_'), '=', '') as token from documents where text is not null")
def base64url(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").where("text is not null").select("doc_id", b64url(F.col("text")).alias("token"))


# Scans, summaries, reducers.


@register("pair_scan_page1", sql("select * from pairs where name like 'ctx:en:%' and not hidden order by name limit 256"))
def pair_scan_page1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan.scan(pairs(spark, sf_dir), "ctx:en:")


@register("pair_scan_cursor", sql("select * from pairs where name > 'ctx:en:src12' and not hidden order by name limit 100"))
def pair_scan_cursor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan.scan(pairs(spark, sf_dir), "*", limit=100, cursor="ctx:en:src12")


@register("pair_scan_hidden", sql("select * from pairs where name like 'ctx:fr:%'"))
def pair_scan_hidden(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan.scan(pairs(spark, sf_dir), "ctx:fr:", limit=-1, include_hidden=True)


@register(
    "pair_summary_totals",
    sql("""select count(*) as names, sum(bytes)::bigint as total_bytes, min(bytes) as min_bytes, max(bytes) as max_bytes, min(name) as first_name, max(name) as last_name,
        (max(strlen(name)) - 7)::int as max_depth, 0 as self_terminal, 0::bigint as dangling from pairs join vals using (key) where name like 'ctx:en:%' and not hidden"""),
)
def pair_summary_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan.summary(pairs(spark, sf_dir), values(spark, sf_dir).select("key", "bytes"), "ctx:en:")


def _branches(depth: int) -> str:
    return sql(f"""select lower(hex(encode(substr(name, 5, {depth})))) as branch, count(*) as names from pairs where name like 'ctx:%' and not hidden group by all order by names desc, branch limit 32""")


@register("pair_summary_branches_d1", _branches(1))
def pair_summary_branches_d1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan.branches(pairs(spark, sf_dir), "ctx:")


@register("pair_summary_branches_d2", _branches(2))
def pair_summary_branches_d2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan.branches(pairs(spark, sf_dir), "ctx:", depth=2)


@register("pair_summary_branches_full", sql("select lower(hex(encode(substr(name, 5)))) as branch, count(*) as names from pairs where name like 'ctx:%' and not hidden group by all"))
def pair_summary_branches_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan.branches(pairs(spark, sf_dir), "ctx:", depth=-1, limit=0)


@register("namespace_summary", sql("select split_part(name, ':', 1) as namespace, count(*) as names, sum(bytes)::bigint as total_bytes from pairs join vals using (key) where not hidden group by all"))
def namespace_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan.namespace_summary(pairs(spark, sf_dir), values(spark, sf_dir).select("key", "bytes"))


@register("pair_reduce_payload", sql("select name, key, to_base64(encode(payload)) as payload from (select * from pairs where name like 'ctx:es:%' and not hidden order by name limit 256) as p join vals using (key)"))
def pair_reduce_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan.reduce("counts", pairs(spark, sf_dir), values(spark, sf_dir).select("key", "payload"), "ctx:es:")


@register("reduce_decode_counts", "select l_orderkey as key, l_partkey as token, sum(l_quantity)::bigint as count from lineitem group by all")
def reduce_decode_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packs each order's parts and quantities, and unpacks them again."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_partkey").agg(F.sum("l_quantity").cast("long").alias("n"))
    packed = lines.groupBy(F.col("l_orderkey").alias("key")).agg(F.array_sort(F.collect_list(F.struct(F.col("l_partkey").alias("token"), F.col("n").alias("count")))).alias("t"))
    return packed.select("key", F.explode(scan.decode_counts(scan.encode_counts(F.col("t")))).alias("r")).select("key", "r.*")


@register("reduce_decode_probs", "select l_orderkey as key, l_linenumber as n, l_partkey as token, l_quantity::bigint as qlogprob, case when l_quantity > 25 then l_suppkey end as backoff from lineitem")
def reduce_decode_probs(spark: SparkSession, sf_dir: str) -> DataFrame:
    hexed = lambda c, n: F.lpad(F.hex(c.cast("long")), 2 * n, "0")
    backoff = F.when(F.col("l_quantity") > 25, hexed(F.col("l_suppkey"), 2)).otherwise("FFFF")
    lines = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("key"), F.col("l_linenumber").alias("n"),
        F.unhex(F.concat(F.lit("01010001"), hexed(F.col("l_partkey"), 4), hexed(F.col("l_quantity"), 1), backoff)).alias("p"),
    )
    return lines.select("key", "n", F.explode(scan.decode_probabilities(F.col("p"))).alias("r")).select("key", "n", "r.*")


@register("reduce_decode_continuations", "select p_partkey as key, p_partkey as token, p_size::bigint as contexts from part")
def reduce_decode_continuations(spark: SparkSession, sf_dir: str) -> DataFrame:
    hexed = lambda c: F.lpad(F.hex(c.cast("long")), 8, "0")
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("key"), F.unhex(F.concat(F.lit("01"), hexed(F.col("p_partkey")), hexed(F.col("p_size")))).alias("p"))
    return p.select("key", scan.decode_continuation(F.col("p")).alias("r")).select("key", "r.*")


@register("bucket_values", "select o_orderkey, floor(round_even(o_totalprice * 1000000, 0)::bigint / 250000)::bigint as bucket from orders")
def bucket_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", scan.bucket(F.col("o_totalprice"), 250_000).alias("bucket"))


@register(
    "bucket_band_join",
    """select c_custkey as left_id, c_acctbal as left_value, s_suppkey as right_id, s_acctbal as right_value from customer join supplier
       on abs(round_even(c_acctbal * 1000000, 0) - round_even(s_acctbal * 1000000, 0)) <= 500000""",
)
def bucket_band_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("value"))
    b = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("value"))
    return scan.band_join(a, b, 0.5)


# Records.

PARTS = records.define("parts", "name:string:64,size:uint:2,price:float:4,brand:string:16,cheap:bool")


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return p.select(
        F.concat(F.lit("part/"), F.lpad(F.col("p_partkey").cast("string"), 9, "0")).alias("key"), F.col("p_name").alias("name"), F.col("p_size").alias("size"),
        F.col("p_retailprice").cast("float").alias("price"), F.col("p_brand").alias("brand"), (F.col("p_retailprice") < 1000).alias("cheap"),
    )


_PARTS = """(select 'part/' || lpad(p_partkey::varchar, 9, '0') as key, p_name as name, p_size as size, p_retailprice::float as price, p_brand as brand, p_retailprice < 1000 as cheap from part) as r"""
_SHOWN = f"select key, name, size, price::double as price, brand, cheap from {_PARTS}"


@register("rec_get_project", f"select key, size, price::double as price from {_PARTS} where key = 'part/000000042'")
def rec_get_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.get(PARTS, _parts(spark, sf_dir), "part/000000042", ["size", "price"])


@register("rec_scan_prefix", f"{_SHOWN} where key like 'part/0000001%' order by key limit 4096")
def rec_scan_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.scan(PARTS, _parts(spark, sf_dir), prefix="part/0000001", limit=4096)


def _select(op: str, sign: str) -> None:
    @register(f"rec_select_{op}", f"{_SHOWN} where size {sign} 25 order by key limit 10000")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return records.select(PARTS, _parts(spark, sf_dir), "size", op, 25, limit=10_000)


for _op, _sign in zip(records.OPS, ("=", "<>", "<", "<=", ">", ">=")):
    _select(_op, _sign)


@register("rec_select_indexed", f"{_SHOWN} where size >= 40 order by size, key limit 200")
def rec_select_indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.select(records.index(PARTS, "size"), _parts(spark, sf_dir), "size", "gte", 40, limit=200)


@register("rec_select_budget", f"select * from ({_SHOWN} order by key limit 300) as s where size > 25")
def rec_select_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.select(PARTS, _parts(spark, sf_dir), "size", "gt", 25, limit=10_000, budget=300)


@register("rec_select_bulk", f"{_SHOWN} where brand <> 'Brand#1'")
def rec_select_bulk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.select_all(PARTS, _parts(spark, sf_dir), "brand", "ne", "Brand#1")


@register("rec_alter_null", f"select key, name, size, price::double as price, cheap, null::double as novelty from {_PARTS}")
def rec_alter_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema, rows = records.alter(PARTS, _parts(spark, sf_dir), add="novelty:float", drop="brand")
    return records.project(schema, rows)


@register(
    "rec_partial_zero_fill",
    f"""with w as (select 'part/' || lpad(l_suppkey::varchar, 9, '0') as key, max(l_quantity)::int as size from lineitem group by all)
        select r.key, name, coalesce(w.size, r.size) as size, price::double as price, brand, cheap, case when w.key is not null then 0.0::double end as novelty from {_PARTS} left join w using (key)""",
)
def rec_partial_zero_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line writes to the part of its supplier's number; parts of greater numbers stay unwritten."""
    schema, rows = records.alter(PARTS, _parts(spark, sf_dir), add="novelty:float")
    key = F.concat(F.lit("part/"), F.lpad(F.col("l_suppkey").cast("string"), 9, "0"))
    writes = table(spark, sf_dir, "lineitem").select(key.alias("key"), F.col("l_quantity").alias("seq"), F.col("l_quantity").cast("int").alias("size"))
    return records.project(schema, records.write(schema, rows, writes))


@register("rec_out_of_range", "select o_orderkey as key, floor(o_totalprice)::bigint as size, 'value_out_of_range:size' as error from orders where floor(o_totalprice)::bigint > 65535")
def rec_out_of_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), F.floor("o_totalprice").cast("long").alias("size"))
    return records.invalid(PARTS, w)


@register("rec_compact", "select 'parts' as \"table\", 79 as width, 0 as dead, 2 as generation")
def rec_compact(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema, _ = records.alter(PARTS, _parts(spark, sf_dir), add="novelty:float", drop="brand")
    schema = records.compact(schema)
    schema = records.compact(schema) if schema.generation < 2 else schema
    return spark.createDataFrame([(schema.table, schema.width, schema.dead, schema.generation)], "table string, width int, dead int, generation int")


@register("rec_delete", f"{_SHOWN} where size <> 7")
def rec_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _parts(spark, sf_dir)
    return records.project(PARTS, records.delete(rows, rows.where("size = 7")))


@register("rec_count", "select count(*) as rows from part")
def rec_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parts(spark, sf_dir).agg(F.count("*").alias("rows"))


