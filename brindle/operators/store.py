"""The value layer (key to payload) and the name layer (name to key), as folds of operation logs.

``values``: key long, payload.  ``pairs``: name, key long, hidden boolean.  Writes are rows of a log with an ordering
column ``seq``; a snapshot is the last write of each key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.literals import under
from ..plans.lineage import in_ranges


def insert(values: DataFrame, payloads: DataFrame, *, declared: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Appends payloads under new keys (after the greatest there is, in order of ``seq``); returns the new rows and the refused ones.

    Refused: empty or null payloads, and those whose length differs from the column ``declared``.
    """
    ok = F.coalesce(F.octet_length("payload") > 0, F.lit(False))
    if declared is not None:
        ok = ok & F.coalesce(F.col(declared) == F.octet_length("payload"), F.lit(False))
    good = payloads.where(ok)
    top = values.agg(F.coalesce(F.max("key"), F.lit(0)).alias("top"))
    numbered = with_position(good, "seq", "n")
    new = numbered.crossJoin(F.broadcast(top)).select((F.col("top") + F.col("n")).alias("key"), "payload")  # one row
    return new, payloads.where(~ok).select("*", F.lit("invalid_value_size").alias("error"))


def with_position(df: DataFrame, order: str, name: str) -> DataFrame:
    """1, 2, 3 ... in order of a column, without one task ordering all rows: ranges of the column are counted, then numbered."""
    ranged = in_ranges(df, order)
    counts = ranged.groupBy("__part").count()
    before = counts.select("__part", (F.sum("count").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))).alias("__before"))
    inside = F.row_number().over(Window.partitionBy("__part").orderBy(order))
    return ranged.withColumn("__n", inside).join(F.broadcast(before), "__part").withColumn(name, F.col("__n") + F.coalesce("__before", F.lit(0))).drop("__part", "__n", "__before")


def upsert_payloads(pairs: DataFrame, values: DataFrame, writes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Names bound to new payloads (seq, name, payload, hidden): the pairs after the writes, and the new values with their seq.  Every payload gets a key of its own, in order of seq."""
    top = values.agg(F.coalesce(F.max("key"), F.lit(0)).alias("top"))
    new = with_position(writes, "seq", "n").crossJoin(F.broadcast(top)).select("seq", (F.col("top") + F.col("n")).alias("key"), "name", "payload", "hidden", "n")  # one row
    log = pairs.select("name", "key", "hidden", F.lit(0).cast("long").alias("seq")).unionByName(new.select("name", "key", "hidden", F.col("n").cast("long").alias("seq")))
    return upsert_pairs(log), new.select("seq", "key", "payload")


def edit(values: DataFrame, edits: DataFrame) -> DataFrame:
    """Values with each key's last edit (key, seq, payload); edits of keys that aren't there do nothing."""
    last = edits.groupBy("key").agg(F.max_by("payload", "seq").alias("new"))
    return values.join(last, "key", "left").select("key", F.coalesce("new", "payload").alias("payload"))


def delete(values: DataFrame, keys: DataFrame) -> DataFrame:
    """Values without the keys; names that point at them stay."""
    return values.join(keys.select("key").distinct(), "key", "left_anti")


def read(values: DataFrame, keys: DataFrame) -> DataFrame:
    """key, payload and found of each key asked for."""
    return keys.select("key").distinct().join(values.withColumn("found", F.lit(True)), "key", "left").withColumn("found", F.coalesce("found", F.lit(False)))


def upsert_pairs(log: DataFrame) -> DataFrame:
    """The pairs that a log of (name, key, hidden, seq) leaves: the last row of each name."""
    last = log.groupBy("name").agg(F.max_by(F.struct("key", "hidden"), "seq").alias("last"))
    return last.select("name", "last.key", "last.hidden")


def get(pairs: DataFrame, name: str) -> DataFrame:
    """The pair of exactly that name; a mere prefix of names has none."""
    return pairs.where(F.col("name") == name)


def unbind(pairs: DataFrame, names: DataFrame) -> DataFrame:
    return pairs.join(names.select("name").distinct(), "name", "left_anti")


def purge(pairs: DataFrame, values: DataFrame, prefix: str, *, payloads: bool = False) -> tuple[DataFrame, DataFrame]:
    """Pairs without the names under prefix, hidden ones too; with payloads the values they name go as well."""
    gone = under(F.col("name"), prefix)
    left = pairs.where(~gone)
    if not payloads:
        return left, values
    return left, values.join(pairs.where(gone).select("key").distinct(), "key", "left_anti")


def put_batch(items: DataFrame, *, continue_on_error: bool = False) -> DataFrame:
    """Status of items (idx, name, payload): applied unless invalid, and by default unless an earlier one was.

    A name and a payload must not be empty or null.
    """
    bad = ~(F.coalesce(F.octet_length("name") > 0, F.lit(False)) & F.coalesce(F.octet_length("payload") > 0, F.lit(False)))
    items = items.withColumn("valid", ~bad)
    if continue_on_error:
        return items.withColumn("applied", F.col("valid"))
    first = items.where(~F.col("valid")).agg(F.min("idx").alias("stop"))
    return items.crossJoin(F.broadcast(first)).withColumn("applied", F.col("stop").isNull() | (F.col("idx") < F.col("stop"))).drop("stop")


def hydrate(pairs: DataFrame, values: DataFrame) -> DataFrame:
    """Pairs with their payloads; null (and dangling true) for a name whose value was deleted."""
    return pairs.join(values, "key", "left").withColumn("dangling", F.col("payload").isNull())


def mutate_json(values: DataFrame, patches: DataFrame) -> DataFrame:
    """Payloads that are JSON objects of strings, with the patches (key, seq, field, value) applied in order; a null value removes its field."""
    last = patches.groupBy("key", "field").agg(F.max_by("value", "seq").alias("value"))
    patch = last.groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("field", "value"))).alias("patch"))
    old = F.coalesce(F.from_json(F.col("payload").cast("string"), "map<string,string>"), F.create_map().cast("map<string,string>"))
    kept = F.map_filter(old, lambda k, _: ~F.map_contains_key("patch", k))
    new = F.map_concat(kept, F.map_filter("patch", lambda _, v: v.isNotNull()))
    return values.join(patch, "key", "left").select("key", F.when(F.col("patch").isNull(), F.col("payload").cast("string")).otherwise(F.to_json(new)).alias("payload"))


def free_ids(taken: DataFrame, wanted: int) -> DataFrame:
    """``wanted`` random ids that the column id of taken doesn't have."""
    return taken.sparkSession.range(wanted).select(F.expr("uuid()").alias("id")).join(taken.select("id"), "id", "left_anti")
