"""Ordered pages, namespace summaries and reducers over the name layer."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.literals import under

PAGE, PAGE_MOST = 256, 4096
BRANCHES, BRANCHES_MOST = 32, 1024


def page_size(limit: int) -> int | None:
    """0 is the default, more than the most is the most, a negative limit is none."""
    return None if limit < 0 else min(limit or PAGE, PAGE_MOST)


def scan(pairs: DataFrame, prefix: str = "*", *, limit: int = 0, cursor: str | None = None, include_hidden: bool = False) -> DataFrame:
    """The page of names under prefix after the cursor, in order of their bytes.  The filter is a range and the order a top-k."""
    rows = pairs.where(under(F.col("name"), prefix))
    if not include_hidden:
        rows = rows.where(~F.col("hidden"))
    if cursor is not None:
        rows = rows.where(F.col("name") > F.lit(cursor))
    size = page_size(limit)
    rows = rows.orderBy("name")
    return rows if size is None else rows.limit(size)


@dataclass(frozen=True)
class Page:
    rows: list
    next_cursor: str | None


def fetch_page(pairs: DataFrame, prefix: str = "*", **options) -> Page:
    """A page's rows on the driver, at most 4096, and the cursor of the next; the cursor is None exactly when no more exist."""
    size = page_size(options.pop("limit", 0))
    if size is None:
        raise ValueError("an unlimited scan is a DataFrame: use scan")
    rows = scan(pairs, prefix, limit=-1, **options).limit(size + 1).collect()
    more = len(rows) > size
    return Page(rows[:size], rows[size - 1]["name"] if more else None)


def scan_json(pairs: DataFrame, values: DataFrame, prefix: str = "*", *, include_hidden: bool = False) -> DataFrame:
    """All names under a prefix, not a page, with their payloads read as JSON objects of strings; null where a payload is none."""
    return scan(pairs, prefix, limit=-1, include_hidden=include_hidden).join(values, "key").select("name", "key", F.from_json(F.col("payload").cast("string"), "map<string,string>").alias("fields"))


def summary(pairs: DataFrame, sizes: DataFrame, prefix: str, *, include_hidden: bool = False) -> DataFrame:
    """One row of totals of a namespace: count, payload bytes, least and greatest name, depth in bytes below the prefix.

    ``sizes`` (key, bytes) is all that is read of values.  A name whose value is gone counts in ``dangling``, where
    the reference fails the page.
    """
    rows = pairs.where(under(F.col("name"), prefix))
    if not include_hidden:
        rows = rows.where(~F.col("hidden"))
    skip = 0 if prefix == "*" else len(prefix.encode())
    return rows.join(sizes, "key", "left").agg(
        F.count("*").alias("names"),
        F.coalesce(F.sum("bytes"), F.lit(0)).alias("total_bytes"),
        F.min("bytes").alias("min_bytes"),
        F.max("bytes").alias("max_bytes"),
        F.min("name").alias("first_name"),
        F.max("name").alias("last_name"),
        F.max(F.octet_length("name") - skip).alias("max_depth"),
        F.coalesce(F.max((F.col("name") == F.lit(prefix)).cast("int")), F.lit(0)).alias("self_terminal"),
        F.count(F.when(F.col("bytes").isNull(), 1)).alias("dangling"),
    )


def branches(pairs: DataFrame, prefix: str, *, depth: int = 1, limit: int = BRANCHES, include_hidden: bool = False) -> DataFrame:
    """The next ``depth`` bytes below a prefix (in hex; all of them if depth is negative) with their numbers of names, most first, then by bytes.

    Depth 0 has no branches; limit 0 caps nothing, others at most 1024.
    """
    rows = pairs.where(under(F.col("name"), prefix))
    if not include_hidden:
        rows = rows.where(~F.col("hidden"))
    skip = 0 if prefix == "*" else len(prefix.encode())
    raw = F.col("name").cast("binary")
    below = F.substring(raw, skip + 1, depth if depth > 0 else 1 << 30)
    out = rows.where(F.octet_length("name") > skip).groupBy(F.lower(F.hex(below)).alias("branch")).agg(F.count("*").alias("names")).orderBy(F.desc("names"), "branch")
    if depth == 0:
        return out.where(F.lit(False))
    return out if limit == 0 else out.limit(min(limit, BRANCHES_MOST))


def namespace_summary(pairs: DataFrame, sizes: DataFrame, separator: str = ":") -> DataFrame:
    """Totals of every namespace (what precedes the first separator) in one pass."""
    space = F.substring_index("name", separator, 1)
    return pairs.where(~F.col("hidden")).join(sizes, "key", "left").groupBy(space.alias("namespace")).agg(
        F.count("*").alias("names"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("total_bytes")
    )


Reducer = Callable[[DataFrame, DataFrame], DataFrame]
REDUCERS: dict[str, Reducer] = {}


def register_reducer(name: str, reducer: Reducer) -> None:
    """A reducer gets the page of pairs and the values; names don't distinguish case."""
    REDUCERS[name.lower()] = reducer


def payloads(page: DataFrame, values: DataFrame) -> DataFrame:
    """The page with its payloads in base64."""
    encoded = F.regexp_replace(F.base64(F.col("payload").cast("binary")), "[\r\n]", "")
    return page.join(values, "key").select("name", "key", encoded.alias("payload"))


for _name in ("counts", "count", "probabilities", "probs", "backoffs", "continuations", "continuation"):
    register_reducer(_name, payloads)


def reduce(mode: str, pairs: DataFrame, values: DataFrame, prefix: str = "*", **options) -> DataFrame:
    if mode.lower() not in REDUCERS:
        raise ValueError(f"unknown reducer {mode}")
    return REDUCERS[mode.lower()](scan(pairs, prefix, **options), values)


# Packed statistics: big-endian records behind a header.


def _number(payload: Column, at: Column, size: int) -> Column:
    return F.conv(F.hex(payload.substr(at, F.lit(size))), 16, 10).cast("long")


def _records(payload: Column, header: int, width: int) -> Column:
    n = _number(payload, F.lit(3), 2)
    return F.when(n > 0, F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: (i * width + header + 1).cast("int")))


def _field(payload: Column, at: Column, offset: int, size: int) -> Column:
    return F.conv(F.hex(payload.substr(at + offset, F.lit(size))), 16, 10).cast("long")


def decode_counts(payload: Column) -> Column:
    """Array of (token, count) of u8 version, u8 order, u16 n, (u32 token, u32 count)*."""
    return F.transform(_records(payload, 4, 8), lambda at: F.struct(_field(payload, at, 0, 4).alias("token"), _field(payload, at, 4, 4).alias("count")))


def decode_probabilities(payload: Column) -> Column:
    """Array of (token, qlogprob, backoff) of u8 version, u8 order, u16 n, (u32 token, u8 qlogprob, u16 backoff, 0xFFFF for none)*."""

    def one(at: Column) -> Column:
        backoff = _field(payload, at, 5, 2)
        return F.struct(_field(payload, at, 0, 4).alias("token"), _field(payload, at, 4, 1).alias("qlogprob"), F.when(backoff != 0xFFFF, backoff).alias("backoff"))

    return F.transform(_records(payload, 4, 7), one)


def decode_continuation(payload: Column) -> Column:
    """(token, contexts) of u8 version, u32 token, u32 contexts."""
    return F.struct(_field(payload, F.lit(2), 0, 4).alias("token"), _field(payload, F.lit(6), 0, 4).alias("contexts"))


def encode_counts(tokens: Column, order: int = 1) -> Column:
    """The packed form of an array of (token, count)."""
    pad = lambda c, n: F.lpad(F.hex(c.cast("long")), 2 * n, "0")
    body = F.array_join(F.transform(tokens, lambda t: F.concat(pad(t["token"], 4), pad(t["count"], 4))), "")
    return F.unhex(F.concat(F.lit("01"), F.lit(f"{order:02x}"), pad(F.size(tokens), 2), body))


# Buckets of rounded values: the band join.

QUANTUM = 1_000_000


def bucket(value: Column, width: int) -> Column:
    """Number of the bucket of ``width`` millionths; halves of a millionth round to even."""
    return F.floor(F.bround(value * QUANTUM).cast("long") / width).cast("long")


def band_join(left: DataFrame, right: DataFrame, tolerance: float, *, width: int | None = None) -> DataFrame:
    """Pairs of rows (value) within the tolerance: left rows visit the buckets around them, an equi-join finds partners, a filter keeps those in reach."""
    reach = round(tolerance * QUANTUM)
    width = width or max(1, 2 * reach)
    at = F.bround(F.col("value") * QUANTUM).cast("long")
    visits = F.explode(F.sequence(F.floor((at - reach) / width), F.floor((at + reach) / width)))
    a = left.select(*[F.col(c).alias(f"left_{c}") for c in left.columns], visits.alias("bucket"))
    b = right.select(*[F.col(c).alias(f"right_{c}") for c in right.columns], bucket(F.col("value"), width).alias("bucket"))
    near = F.abs(F.bround(F.col("left_value") * QUANTUM) - F.bround(F.col("right_value") * QUANTUM)) <= reach
    return a.join(b, "bucket").where(near).drop("bucket")
