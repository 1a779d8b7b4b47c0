"""Mixing sources to target weights with a low-discrepancy schedule.

Slot t of the schedule gets the point frac((t + 1) * golden ratio); the source in whose interval of the cumulative
weights it lies fills it.  Such points fill every interval evenly, so that every stretch of
the schedule, not only the whole, has the target weights.  Each source's documents, shuffled by hash, are one string of
tokens cut into blocks of equal length; the r-th slot of a source takes its block r modulo the
source's blocks.  Documents cross the network once: cumulative counts come from bucket totals of a small
table, and the slots of a bucket's blocks are joined to the bucket.  A document is cut into all its pieces in one pass over it.

Tokens are the elements of an array column, the ids packed in a binary column, or the words of a text that has not been encoded.
"""

from __future__ import annotations

import math
from collections.abc import Mapping
from dataclasses import dataclass
from decimal import Decimal, getcontext

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textbuf
from .common import own_names, small_batches, small_side, written

getcontext().prec = 60
_GOLDEN = (Decimal(5).sqrt() - 1) / 2
GOLDEN = float(_GOLDEN)
#: What 2**20 steps add, so that points stay exact for schedules of any length.
LEAP = float((_GOLDEN * (1 << 20)) % 1)

#: White space that ends a word.
BLANK = np.zeros(256, bool)
BLANK[[9, 10, 11, 12, 13, 32]] = True
CHUNK = 1 << 16


@dataclass(frozen=True)
class Plan:
    """Of each source: its key, tokens, blocks and the end of its interval; and the slots of the schedule."""

    sources: tuple[tuple[str, int, int, float], ...]
    slots: int
    block: int


def point(slot: Column) -> Column:
    t = slot + 1
    return (F.pmod(t, F.lit(1 << 20)) * F.lit(GOLDEN) + F.floor(t / F.lit(1 << 20)) * F.lit(LEAP)) % F.lit(1.0)


def source_key(source: Column) -> Column:
    """A key that null has, too."""
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit("null"))


def word_starts(data: np.ndarray, row_byte: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes at which the words of rows of a text begin, and how many are before each row."""
    solid = ~BLANK[data]
    opens = solid.copy()
    opens[1:] &= ~solid[:-1]
    inner = row_byte[(row_byte > 0) & (row_byte < len(data))]
    opens[inner] |= solid[inner]
    start = np.flatnonzero(opens)
    return start, np.searchsorted(start, row_byte)


@F.arrow_udf(T.LongType())
def count_words(text: pa.Array) -> pa.Array:
    data, offsets = textbuf.buffers(text)
    return pa.array(np.diff(word_starts(data, offsets)[1]))


def count_tokens(docs: DataFrame, content: str, ids: str | None = None) -> Column:
    if ids:
        return F.coalesce(F.octet_length(f"`{content}`") / np.dtype(ids).itemsize, F.lit(0)).cast("long")
    if isinstance(docs.schema[content].dataType, T.ArrayType):
        return F.when(F.col(f"`{content}`").isNull(), 0).otherwise(F.size(f"`{content}`")).cast("long")
    return count_words(F.col(f"`{content}`"))


def piece_bounds(count: np.ndarray, lead: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of rows of so many tokens, ``lead`` of whose first block are before them: pieces of each, and row and first token of all pieces."""
    pieces = (lead + count - 1) // block + 1
    row = np.repeat(np.arange(len(count)), pieces)
    nth = np.arange(len(row)) - (np.cumsum(pieces) - pieces)[row]
    return pieces, row, np.maximum(0, nth * block - lead[row])


def cut_udf(kind: T.DataType, block: int, ids: str | None = None):
    """A document's pieces, one of each block that it reaches into, without copying what is cut; packed ids become arrays."""

    @F.arrow_udf(T.ArrayType(T.ArrayType(T.IntegerType()) if ids else kind))
    def cut(content: pa.Array, lead: pa.Array) -> pa.Array:
        lead = lead.to_numpy(zero_copy_only=False)
        if ids:
            data, offsets = textbuf.buffers(content)
            values, offsets = pa.array(data.view(ids).astype(np.int32)), offsets // np.dtype(ids).itemsize
            pieces, row, first = piece_bounds(np.diff(offsets), lead, block)
            inner = pa.ListArray.from_arrays(pa.array(np.append(offsets[:-1][row] + first, offsets[-1]).astype(np.int32)), values)
        elif isinstance(kind, T.ArrayType):
            offsets = content.offsets.to_numpy().astype(np.int64)
            pieces, row, first = piece_bounds(np.diff(offsets), lead, block)
            inner = pa.ListArray.from_arrays(pa.array(np.append(offsets[:-1][row] + first, offsets[-1]).astype(np.int32)), content.values)
        else:
            data, offsets = textbuf.buffers(content)
            start, before = word_starts(data, offsets)
            pieces, row, first = piece_bounds(np.diff(before), lead, block)
            at = np.where(first == 0, offsets[:-1][row], start[np.minimum(before[:-1][row] + first, len(start) - 1)])
            inner = pa.LargeStringArray.from_buffers(len(at), pa.py_buffer(np.append(at, len(data))), pa.py_buffer(np.ascontiguousarray(data))).cast(pa.string())
        return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(pieces)).astype(np.int32)), inner)

    return cut


def shuffled(seed: int) -> Column:
    return F.md5(F.concat_ws("/", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))).cast("binary"))


def schedule_plan(totals: list[tuple[str, int]], block: int, weights: Mapping[str | None, float] | None, temperature: float, slots: int | None) -> Plan:
    """Interval ends by source key, and as many slots as give each block one at least (unless told how many).

    Points of n slots are at most ``log2(n) + 3`` off in any interval, so (blocks + log2(n) + 3) / weight are enough for a source.
    A source without a weight, or with a weight of 0, isn't scheduled.
    """
    totals = sorted((k, n) for k, n in totals if n)
    if weights is None:
        given = {k: float(n) ** temperature for k, n in totals}
    else:
        given = {("null" if s is None else f"={s}"): float(w) for s, w in weights.items()}
        if any(not math.isfinite(w) or w < 0 for w in given.values()):
            raise ValueError("weights must be finite and not negative")
    totals = [(k, n) for k, n in totals if given.get(k, 0) > 0]
    if not totals:
        return Plan((), 0, block)
    sizes, whole, at, rows, need = {}, math.fsum(given[k] for k, _ in totals), 0.0, [], 0.0
    for k, n in totals:
        sizes[k] = -(-n // block)
        at += given[k]
        rows.append((k, n, sizes[k], at / whole))
        need = max(need, sizes[k] * whole / given[k])
    rows[-1] = (*rows[-1][:3], 1.0)
    if slots is None:
        slack = math.log2(need + 2) + 4
        slots = max(math.ceil((sizes[k] + slack) * whole / given[k]) for k, _ in totals)
    return Plan(tuple(rows), slots, block)


def schedule(spark: SparkSession, plan: Plan) -> DataFrame:
    """slot, key, rank among the slots of its source (from 0), block and epoch."""
    ends = F.array(*[F.lit(end) for *_, end in plan.sources])
    names = F.array(*[F.lit(k) for k, *_ in plan.sources])
    blocks = F.array(*[F.lit(b).cast("long") for _, _, b, _ in plan.sources])
    index = F.least(F.size(F.filter(ends, lambda e: e <= F.col("point"))), F.lit(len(plan.sources) - 1)) + 1
    slots = (
        spark.range(plan.slots).select(F.col("id").alias("slot"), point(F.col("id")).alias("point"))
        .select("slot", index.alias("i"), F.floor(F.col("slot") / CHUNK).alias("chunk"))
    )
    counts = slots.groupBy("i", "chunk").count()
    before = counts.select("i", "chunk", (F.sum("count").over(Window.partitionBy("i").orderBy("chunk")) - F.col("count")).alias("before"))
    inside = F.row_number().over(Window.partitionBy("i", "chunk").orderBy("slot")) - 1
    ranked = slots.join(before, ["i", "chunk"]).select("slot", "i", (F.col("before") + inside).alias("rank"))
    of = F.element_at(blocks, F.col("i"))
    return ranked.select("slot", F.element_at(names, F.col("i")).alias("key"), "rank", F.pmod("rank", of).alias("block"), F.floor(F.col("rank") / of).alias("epoch"))


@own_names
def mix(
    docs: DataFrame, *, content: str = "text", weights: Mapping[str | None, float] | None = None, temperature: float = 0.8, block: int = 2048, slots: int | None = None, seed: int = 0,
    bucket_blocks: int = 256, ids: str | None = None,
) -> DataFrame:
    """The columns of docs, with ``content`` cut to the piece in a slot, and slot, epoch, block, at (the piece's first token in the block), first_token and n_tokens.

    The tokens of an array column (of token ids) are its elements, those of a text are its words.  A binary column holds token ids as numbers
    of the numpy type ``ids`` (big-endian and unsigned, for its order to be theirs); their pieces are arrays.
    ``weights`` maps sources to target weights; without it a source of n tokens weighs n**temperature.  A block has
    ``block`` tokens, a source's last what is left.  Without ``slots`` the schedule is long enough that every block has a slot; sources
    that weigh more than their share repeat in epochs.  Words are what ASCII white space separates; each takes the white space behind
    it (a text's first also what is before it), so the pieces of a text join to it.  Contents without tokens (null, empty, blank) fill no slot.  A null
    source is a source of its own (None in ``weights``).  Documents are in the order of the MD5 of seed and doc_id (null as
    "null"), then of the content; repeated rows each count.  Columns of docs named as an added one are replaced by it; extra columns pass through.
    """
    spark = docs.sparkSession
    small_batches(spark)
    added = ("slot", "epoch", "block", "at", "first_token", "n_tokens")
    columns = [c for c in docs.columns if c not in added]
    count = count_tokens(docs, content, ids).alias("__n")
    light = written(docs.select(source_key(F.col("source")).alias("__key"), shuffled(seed).alias("__u"), count).where("__n > 0"), "token-counts")
    totals = [(r[0], r[1]) for r in light.groupBy("__key").agg(F.sum("__n")).collect()]  # a row a source
    plan = schedule_plan(totals, block, weights, temperature, slots)
    if not plan.slots:
        own = docs.select(*[F.col(f"`{c}`") for c in columns]).where(F.lit(False))
        return own.withColumns({c: F.lit(None).cast("long") for c in added})
    sizes = spark.createDataFrame([(k, max(1, -(-b // bucket_blocks))) for k, _, b, _ in plan.sources], "__key string, __buckets long")
    bucket = F.floor(F.conv(F.substring("__u", 1, 8), 16, 10).cast("long") * F.col("__buckets") / F.lit(float(1 << 32)))
    sizes = small_side(sizes, 1 << 16)
    filled = light.join(sizes, "__key").groupBy("__key", bucket.alias("__bucket")).agg(F.sum("__n").alias("__tokens"))
    offsets = written(
        filled.withColumn("__from", F.sum("__tokens").over(Window.partitionBy("__key").orderBy("__bucket")) - F.col("__tokens")), "bucket-offsets"
    )
    parts = offsets.select("__key", "__bucket", "__from", F.explode(F.sequence(F.floor(F.col("__from") / block), F.floor((F.col("__from") + F.col("__tokens") - 1) / block))).alias("__block"))
    times = schedule(spark, plan).select(F.col("key").alias("__key"), F.col("block").alias("__block"), "slot", "epoch")
    placed = (
        parts.join(times, ["__key", "__block"], "left")
        .groupBy("__key", "__bucket", "__from", "__block").agg(F.collect_list(F.when(F.col("slot").isNotNull(), F.struct("slot", "epoch"))).alias("times"))
        .groupBy("__key", "__bucket", "__from").agg(F.array_sort(F.collect_list(F.struct("__block", "times"))).alias("__blocks"))
    )
    own = docs.select(*[F.col(f"`{c}`") for c in columns], source_key(F.col("source")).alias("__key"), shuffled(seed).alias("__u"), count)
    own = own.where("__n > 0").join(sizes, "__key").withColumn("__bucket", bucket)
    order = Window.partitionBy("__key", "__bucket").orderBy("__u", f"`{content}`")
    own = own.withColumn("__start", F.sum("__n").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("__n"))
    start = F.col("__start")
    found = own.join(placed, ["__key", "__bucket"]).withColumn("__start", start + F.col("__from"))
    lead, name = F.pmod(start, F.lit(block)), F.col(f"`{content}`")
    skipped = F.floor(start / block) - F.col("__blocks")[0]["__block"]
    reach = F.floor((lead + F.col("__n") - 1) / block) + 1
    # only its own blocks go with a document to Python and back; used twice, they are not put together with the cut in one projection
    found = found.withColumn("__own", F.slice("__blocks", (skipped + 1).cast("int"), reach.cast("int"))).drop("__blocks")
    rest = [c for c in found.columns if c not in ("__own", content)]
    cut = found.select(
        *[F.col(f"`{c}`") for c in rest], F.col("__own")[0]["__block"].alias("__b0"), F.col("__own.times").alias("__times"), cut_udf(docs.schema[content].dataType, block, ids)(name, lead).alias("__pieces")
    )
    # every row has a piece; outer, lest Spark infers a filter on the pieces, which would cut each document twice
    pieces = cut.select(*[F.col(f"`{c}`") for c in rest], "__b0", "__times", F.posexplode_outer("__pieces").alias("__nth", content)).withColumn("__b", F.col("__b0") + F.col("__nth"))
    first = F.greatest(F.lit(0).cast("long"), F.col("__b") * block - start)
    last = F.least(F.col("__n"), (F.col("__b") + 1) * block - start)
    pieces = pieces.withColumns({"__first": first, "__len": last - first})
    out = pieces.withColumn("__t", F.explode(F.col("__times")[F.col("__nth")]))
    return out.select(
        *[F.col(f"`{c}`") for c in columns],
        F.col("__t.slot").alias("slot"), F.col("__t.epoch").alias("epoch"), F.col("__b").alias("block"),
        (start + F.col("__first") - F.col("__b") * block).alias("at"), F.col("__first").alias("first_token"), F.col("__len").alias("n_tokens"),
    )


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The pieces of ``mix`` with the columns of docs only, in the schedule's order: files in order of slot, n_chars that of the piece."""
    out = mix(docs, **options)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return out.repartitionByRange(parts, "slot").sortWithinPartitions("slot", "at").select(*[F.col(f"`{c}`") for c in docs.columns])


def oracle(block: int = 2048, temperature: float = 0.8, seed: int = 0) -> str:
    """``mix`` of the texts of documents with its defaults, as DuckDB SQL."""
    blank = " \\t\\n\\x0B\\f\\r"
    return f"""
        with words as (
            select *, '=' || source as k, md5('{seed}/' || doc_id) as u,
                   len(regexp_extract_all(text, '[^{blank}]+'))::bigint as n
            from documents),
        placed as (
            select *, (sum(n) over (partition by k order by u, text rows unbounded preceding) - n)::bigint as start from words where n > 0),
        totals as (select k, sum(n)::double as words, ceil(sum(n) / {block}.0)::bigint as blocks, pow(sum(n)::double, {temperature}) as w from placed group by k),
        ends as (select *, sum(w) over (order by k) as e, sum(w) over () as whole from totals),
        size as (
            select max(ceil((blocks + s) * whole / w))::bigint as slots
            from ends, (select log2(max(blocks * whole / w) + 2) + 4 as s from ends) as x),
        points as (
            select t as slot, (((t + 1) % 1048576) * {GOLDEN!r}::double + floor((t + 1) / 1048576) * {LEAP!r}::double) % 1.0::double as p
            from (select unnest(range(slots)) as t from size) as x),
        intervals as (select k, blocks, e / whole as hi, coalesce(lag(e / whole) over (order by k), 0) as lo,
                             row_number() over (order by k desc) = 1 as final from ends),
        slots as (
            select slot, k, blocks, row_number() over (partition by k order by slot) - 1 as r
            from points join intervals on p >= lo and (p < hi or final)),
        pieces as (
            select *, unnest(range(start // {block}, (start + n - 1) // {block} + 1)) as block from placed),
        cuts as (
            select *, greatest(0, block * {block} - start) as first_word,
                   least(n, (block + 1) * {block} - start) - greatest(0, block * {block} - start) as n_words from pieces)
        select c.doc_id, c.lang, c.source, c.n_chars, s.slot, (s.r // s.blocks)::bigint as epoch, c.block::bigint as block,
               (c.start + c.first_word - c.block * {block})::bigint as at, c.first_word::bigint as first_token, c.n_words::bigint as n_tokens,
               case when c.n_words = c.n then c.text else
                    (case when c.first_word = 0 then regexp_extract(c.text, '^[{blank}]*') else '' end) ||
                    array_to_string(regexp_extract_all(c.text, '[^{blank}]+[{blank}]*')[c.first_word + 1 : c.first_word + c.n_words], '') end as text
        from cuts as c join slots as s on s.k = c.k and s.r % s.blocks = c.block"""
