"""Exact dedup: tree-merge of sorted digest runs.

Each input partition turns its texts into one run sorted by digest, in which a digest
is there once, with its smallest identifier.  Partitions then exchange runs in rounds of
a butterfly (a binomial tree that every partition is a root of): in round r the runs of a
group of ``FAN`` neighbours that hold the same digest range are merged into one, and the
merged run is cut by the next digits of the digest.  After log(P) rounds each digest range
is one run, every partition has had an equal share of the work, and a digest with
any number of copies has shrunk to one entry at every level.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textbuf
from .common import own_names, small_side, written

FAN = 8
#: SHA-256 as four words in the machine's order (numpy brings records that it joins into that order), the text's length in bytes (which verifies it), identifier or that there is none, copies.
ENTRY = np.dtype([("digest", "<u8", 4), ("size", "<i8"), ("none", "<i8"), ("id", "<i8"), ("n", "<i8")])
RUN = "lane long, run long, entries binary"


def digests(docs: DataFrame) -> DataFrame:
    """digest, size and id of every row with a text."""
    return docs.where("text is not null").select(F.unhex(F.sha2("text", 256)).alias("digest"), F.octet_length("text").cast("long").alias("size"), F.col("doc_id").alias("id"))


def merge(runs: list[np.ndarray]) -> np.ndarray:
    """One sorted run of several: of the entries with equal digest and size, the smallest identifier (none counts as the largest) and all copies."""
    every = np.concatenate(runs) if runs else np.zeros(0, ENTRY)
    if not len(every):
        return every
    differ = lambda e: (e["digest"][1:] != e["digest"][:-1]).any(axis=1) | (e["size"][1:] != e["size"][:-1])
    merged = every[np.argsort(every["digest"][:, 0], kind="stable")]  # a natural merge sort: it finds the sorted runs and merges them
    other = differ(merged)
    if (other & (merged["digest"][1:, 0] == merged["digest"][:-1, 0])).any():  # digests that begin alike
        keys = every["digest"]
        merged = every[np.lexsort((every["size"], keys[:, 3], keys[:, 2], keys[:, 1], keys[:, 0]))]
        other = differ(merged)
    start = np.flatnonzero(np.concatenate([[True], other]))
    out = merged[start].copy()
    out["none"] = np.minimum.reduceat(merged["none"], start)
    out["id"] = np.minimum.reduceat(np.where(merged["none"] > 0, np.iinfo(np.int64).max, merged["id"]), start)
    out["n"] = np.add.reduceat(merged["n"], start)
    return out


def digit(run: np.ndarray, level: int) -> np.ndarray:
    """The level-th octal digit of each digest."""
    first = run["digest"][:, 0]
    return (first >> np.uint64(61 - 3 * level)).astype(np.int64) & (FAN - 1)


def cut(run: np.ndarray, lane: int, at: int, level: int) -> Iterator[tuple[int, int, bytes]]:
    where = np.searchsorted(digit(run, level), np.arange(FAN + 1)) if len(run) else np.zeros(FAN + 1, int)
    for d in range(FAN):
        if where[d] < where[d + 1]:
            yield lane * FAN + d, at, run[where[d] : where[d + 1]].tobytes()


def packed(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.binary())], names=["lane", "run", "entries"]
    )


def first_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    runs: list[np.ndarray] = []
    for b in batches:
        run = np.zeros(b.num_rows, ENTRY)
        if b.num_rows:
            run["digest"] = np.frombuffer(b"".join(b.column(0).to_pylist()), ">u8").reshape(-1, 4)
            run["size"], run["n"] = b.column(1).to_numpy(), 1
            run["none"], run["id"] = b.column(2).is_null().to_numpy(zero_copy_only=False), b.column(2).fill_null(0).to_numpy()
            runs.append(merge([run[np.argsort(run["digest"][:, 0])]]))
        if len(runs) > FAN:
            runs = [merge(runs)]
    if runs:
        yield packed(list(cut(merge(runs), 0, TaskContext.get().partitionId(), 0)))
    textbuf.release()


def _merge_round(level: int, last: bool):
    def round_(table: pa.Table) -> pa.Table:
        lane, run = table["lane"][0].as_py(), table["run"][0].as_py() // FAN
        one = merge([np.frombuffer(x, ENTRY) for x in table["entries"].to_pylist()])
        return pa.Table.from_batches([packed([(lane, run, one.tobytes())] if last else list(cut(one, lane, run, level)))])

    return round_


def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for x in b.column("entries").to_pylist():
            run = np.frombuffer(x, ENTRY)
            fixed = pa.FixedSizeBinaryArray.from_buffers(pa.binary(32), len(run), [None, pa.py_buffer(run["digest"].astype(">u8").tobytes())])
            yield pa.RecordBatch.from_arrays([fixed.cast(pa.binary()), pa.array(run["size"]), pa.array(run["id"], mask=run["none"] > 0), pa.array(run["n"])], names=["digest", "size", "kept", "n"])


def survivors(found: DataFrame) -> DataFrame:
    """digest, size, kept (the smallest id) and n (copies) of each distinct text of ``digests``."""
    runs = written(found.mapInArrow(first_runs, RUN), "digest-runs")
    most = runs.agg(F.max("run")).first()[0]
    count, level = (most or 0) + 1, 0
    while True:
        level += 1
        count = -(-count // FAN)
        runs = runs.groupBy("lane", F.floor(F.col("run") / FAN).alias("to")).applyInArrow(_merge_round(level, count == 1), RUN)
        if count == 1:
            break
    return runs.mapInArrow(unpacked, "digest binary, size long, kept long, n long")


def duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, kept_id and copies for every document whose text another document with a smaller identifier has.

    Texts are equal if all their bytes are; empty texts equal each other; null texts equal nothing and aren't listed.
    A doc_id whose text is there only in repeated rows of its own is listed with itself, once; copies counts
    the rows of that doc_id and text.  A null doc_id counts as larger than any.  Other columns aren't looked at.
    """
    found = written(digests(docs), "digests")
    own = found.groupBy("digest", "size", "id").agg(F.count("*").alias("copies"))
    repeated = survivors(found).where("n > 1").drop("n")
    return own.join(repeated, ["digest", "size"]).where("not (id <=> kept) or copies > 1").select(F.col("id").alias("doc_id"), F.col("kept").alias("kept_id"), "copies")


@own_names
def dedup(docs: DataFrame) -> DataFrame:
    """The rows of docs but for copies: of each distinct text one row, of the smallest doc_id (null: the largest), stays.

    Of several rows with that text and doc_id the one stays whose columns, written as JSON, come first.  Rows with a null
    text all stay.  All columns stay as they are.
    """
    found = written(digests(docs), "digests")
    counted = found.groupBy("digest", "size", "id").agg(F.count("*").alias("rows")).join(survivors(found).where("n > 1").drop("n"), ["digest", "size"])
    copies = counted.where("not (id <=> kept) or rows > 1").select(F.col("digest").alias("__d"), F.col("size").alias("__s"), F.col("id").alias("__k"), F.expr("id <=> kept").alias("__again"))
    copies = small_side(written(copies, "copies"), 1 << 18)
    named = docs.withColumns({"__digest": F.unhex(F.sha2("text", 256)), "__size": F.octet_length("text").cast("long")})
    match = (F.col("__digest") == F.col("__d")) & (F.col("__size") == F.col("__s")) & F.col("doc_id").eqNullSafe(F.col("__k"))
    columns = [F.col(f"`{c}`") for c in docs.columns]
    kept, again = named.join(copies, match, "left_anti").select(*columns), copies.where("__again")
    if again.isEmpty():
        return kept
    one = Window.partitionBy("__digest", "__size").orderBy(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}))
    first = named.join(again, match, "left_semi").withColumn("__r", F.row_number().over(one)).where("__r = 1").select(*columns)
    return kept.unionByName(first)
