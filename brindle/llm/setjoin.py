"""N-gram Jaccard join: size-banded tiles, hashed bitmap signatures, exact verification.

Every text is the set of its word n-grams (words in lower case, cut at ASCII punctuation and
white space), as 64-bit hashes; documents with one set are one row from there on.  Grams are ordered by the number of
sets that have them, rarest first, and a set's prefix is its first size - ceil(threshold * size) + 1 grams: two sets of the
threshold or above have a gram of both prefixes in common, so nothing is lost.  Grams that no other set has fill a prefix without being
looked for; a text most of whose grams are its own has no partner and goes no further.

How many sets have a gram is found in two exchanges of packed runs: sorted runs of grams go by ranges of gram, and what several sets
have comes back by ranges of set.  Grams that are in many sets of one batch already are never exchanged: they are last in the order, by
the totals of a bounded table.  A gram is looked for by its label: a few sets' grams by the fingerprint of these sets, other grams by the
sets' least hash and the magnitude of their number; so the grams that a group of copies shares are a few labels, and a pair meets in
a few tiles.

A band is a range of set sizes whose ends differ by the threshold's ratio, so that partners lie in one band or in neighbours.  A tile is a
band with a label: sets meet in the tiles of their own band and of the one above.  In a tile each set has a parity bitmap with two to four
bits a gram (of sets of two bands the larger's is folded to the smaller's width); the bits in which two bitmaps differ are
a lower bound of the symmetric difference, hence an upper bound of the overlap, which rules out nearly all pairs.  The
rest is verified by intersecting the sorted arrays of grams.  There is no limit on partners or candidates: tiles of many sets are cut into
blocks, and every pair of blocks is a task's share of its own.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textbuf
from .common import discard, own_names, partitions, small_side, written

#: Grams (rows times the size of their band, 256 at least) in a block of a tile.
BLOCK = 1 << 19
#: Sets of a block whose pairs are verified together.
SHARE = 256
#: A gram is hot if, among the sets of a batch of ``BATCH`` grams, one in HOT_SHARE has it, and HOT_LEAST at least; of hot grams the HOT_MOST in most sets are kept apart.
HOT_SHARE, HOT_LEAST, HOT_MOST = 512, 16, 1 << 17
BATCH = 1 << 19
#: Grams in a range of grams, on average at most.
LANE = 1 << 20
#: Sets up to which a gram's label is the fingerprint of all of them.
FEW = 4
U64 = textbuf.U64


def band_of(size: np.ndarray, threshold: float) -> np.ndarray:
    return np.floor(np.log(np.maximum(size, 1)) / -math.log(threshold) + 1e-9).astype(np.int64)


def band_bits(band: int, threshold: float) -> int:
    """Bits of the bitmaps compared in a band's tiles: a power of two, at least twice the band's largest set."""
    return max(64, 1 << math.ceil(math.log2(2 * threshold ** -(band + 1))))


def gram_sets(texts: pa.Array, n: int) -> Iterator[tuple[int, np.ndarray]]:
    """Row and sorted distinct grams of every text that has a word."""
    for s in range(0, len(texts), 256):
        for w in textbuf.chunks(pc.utf8_lower(texts.slice(s, 256)), textbuf.PUNCT):
            grams, row = textbuf.shingles(w, n)
            at = np.searchsorted(row, np.arange(w.rows + 1))
            for r in range(w.rows):
                if at[r] < at[r + 1]:
                    own = np.sort(grams[at[r] : at[r + 1]])
                    new = np.ones(len(own), bool)
                    np.not_equal(own[1:], own[:-1], out=new[1:])
                    yield s + w.first + r, own[new]


def fingerprint(grams: np.ndarray) -> tuple[int, int]:
    """Two words that stand for the set."""
    a, b = textbuf.mix(grams), textbuf.mix(grams ^ U64(0x5851F42D4C957F2D))
    return int(a.sum().astype(np.int64)), int((b.sum() + U64(len(grams))).astype(np.int64))


def parity(grams: np.ndarray, bits: int) -> bytes:
    """A bitmap in which each gram flips a bit; its halves, flipped by one another, are the bitmap of half the width."""
    counts = np.bincount((grams >> U64(20)).astype(np.int64) & (bits - 1), minlength=bits)
    return np.packbits(counts & 1).tobytes()


def folded(bitmap: np.ndarray, words: int) -> np.ndarray:
    while bitmap.shape[1] > words:
        half = bitmap.shape[1] // 2
        bitmap = bitmap[:, :half] ^ bitmap[:, half:]
    return bitmap


def prefix_of(size: np.ndarray, threshold: float) -> np.ndarray:
    return size - np.ceil(threshold * size - 1e-9).astype(np.int64) + 1


# Which sets there are, and which grams are in very many of them.

SIGNATURE = "struct<f0: bigint, f1: bigint, size: int, hot: array<struct<gram: bigint, n: bigint, least: bigint>>>"
_HOT = pa.list_(pa.struct([("gram", pa.int64()), ("n", pa.int64()), ("least", pa.int64())]))


def short(grams: np.ndarray) -> np.ndarray:
    """48 bits of each gram, in the order of the whole ones: what is counted.  Two grams that share them count as one, which costs time only."""
    return grams >> U64(16)


def hot_grams(sets: dict[tuple[int, int], np.ndarray]) -> list[dict]:
    """Of the distinct sets of a batch the grams that are in many, with their number and the sets' least hash."""
    sizes = np.array([len(g) for g in sets.values()])
    owner = np.repeat(textbuf.mix(np.array([f for f, _ in sets], np.int64).view(np.uint64)).view(np.int64), sizes)
    grams = short(np.concatenate(list(sets.values())))
    order = np.argsort(grams)
    grams, owner = grams[order], owner[order]
    start = np.flatnonzero(np.concatenate([[True], grams[1:] != grams[:-1]]))
    n = np.diff(np.concatenate([start, [len(grams)]]))
    least = np.minimum.reduceat(owner, start)
    many = n >= max(HOT_LEAST, len(sets) // HOT_SHARE)
    return [{"gram": g, "n": c, "least": m} for g, c, m in zip(grams[start][many].view(np.int64).tolist(), n[many].tolist(), least[many].tolist())]


def signature_udf(n: int):
    @F.arrow_udf(SIGNATURE)
    def signature(text: pa.Array) -> pa.Array:
        f0, f1, size = np.zeros(len(text), np.int64), np.zeros(len(text), np.int64), np.zeros(len(text), np.int32)
        hot: list[list | None] = [None] * len(text)
        held: dict[tuple[int, int], np.ndarray] = {}
        total = last = 0
        for r, grams in gram_sets(text, n):
            f = fingerprint(grams)
            f0[r], f1[r], size[r] = *f, len(grams)
            last = r
            if f not in held:
                held[f] = grams
                total += len(grams)
            if total >= BATCH:
                hot[r], held, total = hot_grams(held), {}, 0
        if held:
            hot[last] = (hot[last] or []) + hot_grams(held)
        held.clear()
        out = pa.StructArray.from_arrays([pa.array(f0), pa.array(f1), pa.array(size), pa.array(hot, _HOT)], names=["f0", "f1", "size", "hot"], mask=pa.array(size == 0))
        textbuf.release()
        return out

    return signature


def signatures(docs: DataFrame, n: int) -> DataFrame:
    """id, row (a hash of the text), f0 and f1 (the set), size and hot of each row with a word."""
    sig = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").alias("id"), F.xxhash64("text").alias("row"), signature_udf(n)("text").alias("s"))
    return written(sig.where("s is not null").select("id", "row", "s.*"), "signatures")


def hot_table(sig: DataFrame) -> dict[str, np.ndarray]:
    """gram (sorted), rank and label of the hot grams, HOT_MOST at most; it is broadcast."""
    every = sig.where("hot is not null").select(F.explode("hot").alias("h")).groupBy("h.gram").agg(F.sum("h.n").alias("n"), F.min("h.least").alias("least"))
    rows = every.orderBy(F.desc("n"), "gram").limit(HOT_MOST).toPandas()
    gram, n = rows["gram"].to_numpy(np.int64).view(np.uint64), rows["n"].to_numpy(np.int64)
    label = many_label(rows["least"].to_numpy(np.int64).view(np.uint64), n)
    rank = np.empty(len(gram), np.int64)
    rank[np.lexsort((gram, label, n))] = np.arange(len(gram))
    order = np.argsort(gram)
    return {"gram": gram[order], "rank": rank[order], "label": label[order]}


def many_label(least: np.ndarray, n: np.ndarray) -> np.ndarray:
    return textbuf.mix(least ^ (np.frexp(n.astype(float))[1].astype(np.uint64) * U64(0xA24BAED4963EE407)))


# Packed runs.


def pack(*arrays: np.ndarray) -> bytes:
    return np.array([len(arrays), *[x.nbytes for x in arrays]], "<i8").tobytes() + b"".join(x.tobytes() for x in arrays)


def unpack(raw: bytes, *kinds: str) -> list[np.ndarray]:
    sizes = np.frombuffer(raw, "<i8", len(kinds) + 1)[1:]
    out, at = [], 8 * (len(kinds) + 1)
    for kind, size in zip(kinds, sizes.tolist()):
        out.append(np.frombuffer(raw, kind, size // np.dtype(kind).itemsize, at))
        at += size
    return out


def lane_of(values: np.ndarray, bits: int, lanes: int) -> np.ndarray:
    """The range, of as many as lanes, that a value of so many bits lies in."""
    return ((values >> U64(bits - 32)) * U64(lanes)) >> U64(32)


def grams_packed(grams: np.ndarray, at: np.ndarray, sets: np.ndarray) -> bytes:
    """Sorted grams as differences, with the place of their set in sets."""
    own, at = np.unique(at, return_inverse=True)
    gaps = np.diff(grams)
    narrow = not len(gaps) or gaps.max() < 1 << 32
    return pack(grams[:1], gaps.astype("<u4") if narrow else gaps, at.astype("<u2" if len(own) <= 1 << 16 else "<u4"), sets[own], np.array([narrow, len(own) <= 1 << 16], "u1"))


def grams_unpacked(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Grams and the set of each."""
    narrow, few = raw[-2], raw[-1]
    first, gaps, at, sets, _ = unpack(raw, "<u8", "<u4" if narrow else "<u8", "<u2" if few else "<u4", "<u8", "u1")
    grams = np.empty(len(gaps) + 1, np.uint64)
    grams[0] = first[0]
    np.cumsum(gaps, out=grams[1:], dtype=np.uint64)
    grams[1:] += first[0]
    return grams, sets[at]


_HEAD = ("<u8", "<u8", "<i8", "<i8", "<i8", "<u8", "u1")
RUN = "lane long, run binary"
ANSWER = "lane long, head boolean, run binary"


def _rows(lane: list[int], run: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(lane, pa.int64()), pa.array(run, pa.binary())], names=["lane", "run"])


def requests_udf(n: int, threshold: float, lanes: int, set_lanes: int, shared):
    """Of texts with distinct sets: runs of their grams by range of gram, but for hot ones; and heads (size, hot grams, bitmap) by range of set, from ``lanes`` on."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot = shared.value
        held: list[np.ndarray] = []

        def flush() -> Iterator[pa.RecordBatch]:
            size = np.array([len(g) for g in held])
            flat, start = np.concatenate(held), np.cumsum(size) - size
            f0 = np.add.reduceat(textbuf.mix(flat), start)
            f1 = np.add.reduceat(textbuf.mix(flat ^ U64(0x5851F42D4C957F2D)), start) + size.astype(np.uint64)
            bits = [parity(g, band_bits(int(b), threshold)) for g, b in zip(held, band_of(size, threshold))]
            held.clear()
            row, grams = np.repeat(np.arange(len(size)), size), short(flat)
            del flat
            is_hot = np.zeros(len(grams), bool)
            known = np.zeros(0, np.int64)
            if len(hot["gram"]):
                at = np.minimum(np.searchsorted(hot["gram"], grams), len(hot["gram"]) - 1)
                is_hot = hot["gram"][at] == grams
                known = at[is_hot]
            hot_row = row[is_hot]
            order = np.lexsort((hot["rank"][known], hot_row))
            label = hot["label"][known][order]
            n_hot = np.bincount(hot_row, minlength=len(size))
            place = np.arange(len(label)) - (np.cumsum(n_hot) - n_hot)[hot_row]
            label, kept = label[ok := place < prefix_of(size, threshold)[hot_row]], np.minimum(n_hot, prefix_of(size, threshold))
            by_set = np.argsort(f0)
            lane = lane_of(f0[by_set], 64, set_lanes)
            edge = np.flatnonzero(np.concatenate([[True], lane[1:] != lane[:-1], [True]]))
            label_at = np.cumsum(kept) - kept
            out: tuple[list[int], list[bytes]] = ([], [])
            for s, e in zip(edge[:-1], edge[1:]):
                own = by_set[s:e]
                labels = [label[label_at[i] : label_at[i] + kept[i]] for i in own.tolist()]
                out[0].append(lanes + int(lane[s]))
                out[1].append(pack(f0[own], f1[own], size[own], n_hot[own], kept[own], np.concatenate(labels), np.frombuffer(b"".join(bits[i] for i in own.tolist()), np.uint8)))
            yield _rows(*out)
            del bits, ok
            row, grams = row[~is_hot], grams[~is_hot]
            order = np.argsort(grams)
            row, grams = row[order], grams[order]
            lane = lane_of(grams, 48, lanes)
            edge = np.flatnonzero(np.concatenate([[True], lane[1:] != lane[:-1], [True]])) if len(lane) else np.zeros(1, int)
            for s in range(0, len(edge) - 1, 256):
                part = list(zip(edge[s : s + 256].tolist(), edge[s + 1 : s + 257].tolist()))
                yield _rows([int(lane[a]) for a, _ in part], [grams_packed(grams[a:b], row[a:b], f0) for a, b in part])

        total = 0
        for b in batches:
            for _, grams in gram_sets(b.column(0), n):
                held.append(grams)
                total += len(grams)
                if total >= BATCH:
                    yield from flush()
                    total = 0
        if held:
            yield from flush()
        textbuf.release()

    return work


def answers_udf(lanes: int, set_lanes: int):
    """Of a range of grams: for each set its labels of grams that other sets have too, with the sets' number and how many of its grams they are of."""

    def work(table: pa.Table) -> pa.Table:
        lane = table["lane"][0].as_py()
        if lane >= lanes:
            return pa.table({"lane": pa.array([lane - lanes] * table.num_rows, pa.int64()), "head": [True] * table.num_rows, "run": table["run"]})
        parts = [grams_unpacked(x) for x in table["run"].to_pylist()]
        grams, owner = np.concatenate([g for g, _ in parts]), np.concatenate([s for _, s in parts])
        del parts
        order = np.argsort(grams, kind="stable")  # merges the sorted runs
        grams, owner = grams[order], owner[order]
        n = np.diff(np.flatnonzero(np.concatenate([[True], grams[1:] != grams[:-1], [True]])))
        owner, n = owner[np.repeat(n > 1, n)], n[n > 1]
        if not len(n):
            return pa.table({"lane": pa.array([], pa.int64()), "head": pa.array([], pa.bool_()), "run": pa.array([], pa.binary())})
        start, mixed = np.cumsum(n) - n, textbuf.mix(owner)
        label = np.where(n < FEW, textbuf.mix(np.add.reduceat(mixed, start) + n.astype(np.uint64)), many_label(np.minimum.reduceat(mixed, start), n))
        label, n = np.repeat(label, n), np.repeat(n, n)
        order = np.lexsort((label, owner))
        owner, label, n = owner[order], label[order], n[order]
        first = np.flatnonzero(np.concatenate([[True], (owner[1:] != owner[:-1]) | (label[1:] != label[:-1])]))
        times = np.diff(np.concatenate([first, [len(owner)]]))
        owner, label, n = owner[first], label[first], n[first]
        to = lane_of(owner, 64, set_lanes)
        edge = np.flatnonzero(np.concatenate([[True], to[1:] != to[:-1], [True]]))
        runs = []
        for s, e in zip(edge[:-1], edge[1:]):
            new = np.flatnonzero(np.concatenate([[True], owner[s + 1 : e] != owner[s : e - 1]]))
            runs.append(pack(owner[s:e][new], np.diff(np.concatenate([new, [e - s]])).astype("<u4"), label[s:e], n[s:e].astype("<u4"), times[s:e].astype("<u4")))
        textbuf.release()
        return pa.table({"lane": pa.array(to[edge[:-1]].astype(np.int64)), "head": [False] * len(runs), "run": pa.array(runs, pa.binary())})

    return work


KEYED = "f0 long, f1 long, size int, band int, keys array<bigint>, bits binary"


def prefixes_udf(threshold: float):
    """Of a range of sets those with a label to look for, with all that their prefixes hold."""

    def work(table: pa.Table) -> pa.Table:
        head = [unpack(x, *_HEAD) for x in table.filter(table["head"])["run"].to_pylist()]
        f0, f1, size, n_hot, kept, hot, bits = (np.concatenate([h[k] for h in head]) for k in range(7))
        told = [unpack(x, "<u8", "<u4", "<u8", "<u4", "<u4") for x in table.filter(pc.invert(table["head"]))["run"].to_pylist()]
        band = band_of(size, threshold)
        width = np.array([band_bits(int(b), threshold) // 8 for b in range(int(band.max()) + 1)])[band]
        bits_at, hot_at = np.cumsum(width) - width, np.cumsum(kept) - kept
        rank = np.argsort(f0, kind="stable")
        sets = np.unique(f0)
        if told:
            owner = np.repeat(np.concatenate([t[0] for t in told]), np.concatenate([t[1] for t in told]))
            label, n, times = (np.concatenate([t[k] for t in told]) for k in (2, 3, 4))
        else:
            owner, label, n, times = np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        own = np.searchsorted(sets, owner)
        order = np.lexsort((label, n, own))
        own, label, times = own[order], label[order], times[order].astype(np.int64)
        upto = np.cumsum(times)
        bound = np.searchsorted(own, np.arange(len(sets) + 1))
        before = np.concatenate([[0], upto])[bound]
        shared = np.diff(before)  # grams of each set that others have
        out: dict[str, list] = {c.split()[0]: [] for c in KEYED.split(", ")}
        for i in rank.tolist():
            s = int(np.searchsorted(sets, f0[i]))
            wanted = int(prefix_of(size[i : i + 1], threshold)[0]) - max(0, int(size[i] - shared[s] - n_hot[i]))
            if wanted <= 0:
                continue
            a, b = bound[s], bound[s + 1]
            few = int(np.searchsorted(upto[a:b] - times[a:b] - before[s], wanted))
            keys = label[a : a + few]
            if wanted > shared[s]:
                keys = np.concatenate([keys, hot[hot_at[i] : hot_at[i] + min(int(kept[i]), wanted - int(shared[s]))]])
            if len(keys):
                for c, v in zip(out, (f0[i], f1[i], size[i], band[i], np.unique(keys.view(np.int64)).tolist(), bits[bits_at[i] : bits_at[i] + width[i]].tobytes())):
                    out[c].append(v)
        textbuf.release()
        return pa.table({
            "f0": pa.array(np.array(out["f0"], np.uint64).view(np.int64)), "f1": pa.array(np.array(out["f1"], np.uint64).view(np.int64)), "size": pa.array(out["size"], pa.int32()),
            "band": pa.array(out["band"], pa.int32()), "keys": pa.array(out["keys"], pa.list_(pa.int64())), "bits": pa.array(out["bits"], pa.binary()),
        })

    return work


def keyed_sets(docs: DataFrame, sig: DataFrame, sets: DataFrame, n: int, threshold: float) -> DataFrame:
    """The sets that may have a partner, with the labels of their prefixes."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(hot_table(sig))
    rows = sig.groupBy("id", "row").agg(F.count("*").alias("n"), F.first("f0").alias("f0"), F.first("f1").alias("f1"))
    kept = rows.join(sets.select("f0", "f1", F.col("id").alias("u"), F.col("row").alias("r")), ["f0", "f1"]).withColumn("first", (F.col("id") == F.col("u")) & (F.col("row") == F.col("r")))
    again = small_side(written(kept.where("not first or n > 1").select("id", "row", "first"), "copied-rows"), 1 << 18)
    own = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").alias("id"), F.xxhash64("text").alias("row"), "text")
    single, repeated = own.join(again, ["id", "row"], "left_anti"), again.where("first")
    if not repeated.isEmpty():
        single = single.unionByName(own.join(repeated, ["id", "row"], "left_semi").dropDuplicates(["id", "row"]))
    total, count = sets.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    lanes, set_lanes = (max(partitions(spark), -(-x // y)) for x, y in ((total, LANE), (count, 1 << 17)))
    asked = single.select("text").mapInArrow(requests_udf(n, threshold, lanes, set_lanes, shared), RUN)
    answers = asked.groupBy("lane").applyInArrow(answers_udf(lanes, set_lanes), ANSWER)
    return written(answers.groupBy("lane").applyInArrow(prefixes_udf(threshold), KEYED), "keyed-sets")


# Tiles.

PAIR = "a0 long, a1 long, b0 long, b1 long, bucket long"


def candidates(bits: list[np.ndarray], size: np.ndarray, ok, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (x of the first bitmaps, y of the second) that sizes and bitmaps don't rule out, among those that ok(x, y) allows."""
    (left, right), (size_l, size_r) = bits, size
    step = max(1, (1 << 19) // max(1, right.shape[1] * len(right)))
    limit = threshold / (1 + threshold)
    xs, ys = [], []
    for s in range(0, len(left), step):
        a = size_l[s : s + step, None]
        fit = ok(np.arange(s, min(len(left), s + step))[:, None], np.arange(len(right))[None, :])
        fit &= np.minimum(a, size_r) >= threshold * np.maximum(a, size_r) - 1e-9
        differ = np.bitwise_count(left[s : s + step, None, :] ^ right[None, :, :]).sum(axis=2, dtype=np.int64)
        both = a + size_r
        x, y = np.nonzero(fit & ((both - differ) / 2 >= limit * both - 1e-9))
        xs.append(x + s)
        ys.append(y)
    return np.concatenate(xs), np.concatenate(ys)


def unmet(x: np.ndarray, y: np.ndarray, offsets: np.ndarray, keys: np.ndarray, key: int) -> np.ndarray:
    """Of which pairs (x, y) of lists of ascending keys is ``key`` the least in common?"""
    less = np.concatenate([[0], np.cumsum(keys < key)])
    below = less[offsets[1:]] - less[offsets[:-1]]
    size = below[x] + below[y]
    out, s = np.ones(len(x), bool), 0
    upto = np.cumsum(size)
    while s < len(x):
        e = max(s + 1, int(np.searchsorted(upto, (upto[s - 1] if s else 0) + (1 << 21), side="right")))
        side = np.concatenate([x[s:e], y[s:e]])
        pair = np.tile(np.arange(e - s), 2)
        many = below[side]
        at = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(offsets[side], many)
        pair, found = np.repeat(pair, many), keys[at]
        order = np.lexsort((found, pair))
        pair, found = pair[order], found[order]
        out[s + pair[1:][(pair[1:] == pair[:-1]) & (found[1:] == found[:-1])]] = False
        s = e
    return out


def compare(rows: pa.Table, threshold: float, i: int, j: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the pairs in a tile that the bitmaps don't rule out and that no tile of a smaller common key has."""
    size = rows["size"].to_numpy().astype(np.int64)
    home = rows["home"].to_numpy(zero_copy_only=False).astype(bool)
    block = rows["block"].to_numpy()
    at_home, away = np.flatnonzero(home), np.flatnonzero(~home)
    if not len(at_home):
        return at_home, at_home
    bitmaps = rows["bits"].combine_chunks()

    def bits(of: np.ndarray) -> np.ndarray:
        raw = textbuf.buffers(bitmaps.take(pa.array(of)))[0]
        return raw.reshape(len(of), -1).view(np.uint64)

    own = bits(at_home)
    across = (lambda x, y, p, q: block[p[x]] != block[q[y]]) if i != j else (lambda x, y, p, q: np.ones((x.size, y.size), bool))
    x, y = candidates([own, own], [size[at_home], size[at_home]], lambda x, y: (x < y) & across(x, y, at_home, at_home), threshold)
    x, y = at_home[x], at_home[y]
    if len(away):
        other = bits(away)
        u, v = candidates([folded(own, other.shape[1]), other], [size[at_home], size[away]], lambda x, y: across(x, y, at_home, away), threshold)
        x, y = np.concatenate([x, at_home[u]]), np.concatenate([y, away[v]])
    if len(x):
        keys = rows["keys"].combine_chunks()
        fresh = unmet(x, y, keys.offsets.to_numpy().astype(np.int64), keys.values.to_numpy(), rows["key"][0].as_py())
        x, y = x[fresh], y[fresh]
    return x, y


def tile_udf(threshold: float, buckets: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def tiles(table: pa.Table, upto: int, ident: np.ndarray) -> Iterator[pa.RecordBatch]:
            edge = np.flatnonzero((ident[1:upto] != ident[: upto - 1]).any(axis=1)) + 1
            edge = np.concatenate([[0], edge, [upto]])
            for s, e in zip(edge[:-1], edge[1:]):
                if e - s < 2:
                    continue
                rows = table.slice(s, e - s)
                x, y = compare(rows, threshold, int(ident[s, 2]), int(ident[s, 3]))
                if not len(x):
                    continue
                f0, f1 = rows["f0"].to_numpy(), rows["f1"].to_numpy()
                part = x // SHARE  # a crowded tile's pairs are several buckets
                swap = (f0[x] > f0[y]) | ((f0[x] == f0[y]) & (f1[x] > f1[y]))
                x, y = np.where(swap, y, x), np.where(swap, x, y)
                tile = (ident[s] * np.array([1, 7, 131, 524287])).sum()
                at = (textbuf.mix((tile + 8191 * part).astype(np.int64).view(np.uint64)) % np.uint64(buckets)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(f0[x]), pa.array(f1[x]), pa.array(f0[y]), pa.array(f1[y]), pa.array(at)], names=["a0", "a1", "b0", "b1", "bucket"])

        def ids(table: pa.Table) -> np.ndarray:
            return np.column_stack([table[c].to_numpy().astype(np.int64) for c in ("key", "tile", "i", "j")])

        for b in batches:
            if not b.num_rows:
                continue
            held.append(b)
            table = pa.Table.from_batches(held)
            ident = ids(table)
            same = (ident == ident[-1]).all(axis=1)
            upto = len(same) - int(np.argmin(same[::-1])) if not same.all() else 0  # the last tile may go on
            if upto:
                yield from tiles(table, upto, ident)
                held = table.slice(upto).to_batches()
        if held:
            table = pa.Table.from_batches(held)
            yield from tiles(table, table.num_rows, ids(table))
        held.clear()
        textbuf.release()

    return work


def verify_udf(n: int, threshold: float, forest: bool):
    """Exact Jaccard of a bucket's pairs, and whether a pair is in a spanning forest of those at the threshold or above; with forest only these."""

    def work(pairs: pa.Table, texts: pa.Table) -> pa.Table:
        a0, a1, b0, b1 = (pairs[c].to_numpy() for c in ("a0", "a1", "b0", "b1"))
        both = np.rec.fromarrays([np.concatenate([a0, b0]), np.concatenate([a1, b1])], names="f0,f1")
        order = np.lexsort((both.f1, both.f0))
        new = np.ones(len(order), bool)
        new[1:] = (both.f0[order][1:] != both.f0[order][:-1]) | (both.f1[order][1:] != both.f1[order][:-1])
        number = np.empty(len(order), np.int64)
        number[order] = np.cumsum(new) - 1
        x, y = number[: len(a0)], number[len(a0) :]
        of = {f: k for k, f in enumerate(zip(both.f0[order][new].tolist(), both.f1[order][new].tolist()))}
        sets: list[np.ndarray | None] = [None] * len(of)
        if texts.num_rows:
            for _, grams in gram_sets(texts["text"].combine_chunks(), n):
                k = of.get(fingerprint(grams))
                if k is not None:
                    sets[k] = grams
        parent = list(range(len(of)))

        def root(k: int) -> int:
            while parent[k] != k:
                parent[k] = k = parent[parent[k]]
            return k

        jaccard, tree = np.zeros(len(x)), np.zeros(len(x), bool)
        for k in range(len(x)):
            p, q = sets[x[k]], sets[y[k]]
            if p is None or q is None or (forest and root(x[k]) == root(y[k])):
                continue
            if len(p) > len(q):
                p, q = q, p
            at = np.searchsorted(q, p)
            common = int((q[np.minimum(at, len(q) - 1)] == p).sum())
            union = len(p) + len(q) - common
            if common >= threshold * union - 1e-9:
                jaccard[k] = common / union
                u, v = root(x[k]), root(y[k])
                parent[u], tree[k] = v, u != v
        good = np.flatnonzero(jaccard)
        del sets
        textbuf.release()
        return pa.table({"a0": a0[good], "a1": a1[good], "b0": b0[good], "b1": b1[good], "jaccard": jaccard[good], "tree": tree[good]})

    return work


VERIFIED = "a0 long, a1 long, b0 long, b1 long, jaccard double, tree boolean"


def distinct_sets(sig: DataFrame) -> DataFrame:
    """f0, f1, size, and id and row of the least document, of each set."""
    sets = sig.groupBy("f0", "f1").agg(F.first("size").alias("size"), F.min(F.struct("id", "row")).alias("r"))
    return written(sets.select("f0", "f1", "size", "r.*"), "gram-sets")


def similar_sets(docs: DataFrame, sig: DataFrame, sets: DataFrame, n: int, threshold: float, forest: bool) -> DataFrame:
    """Pairs of distinct sets (by fingerprint) with a Jaccard of the threshold at least, with that; each once, none left out."""
    keyed = keyed_sets(docs, sig, sets, n, threshold)
    places = keyed.select("f0", "f1", "band", F.explode("keys").alias("key"), F.explode(F.array(F.lit(0), F.lit(1))).alias("up"))
    places = places.select("f0", "f1", "key", (F.col("band") + F.col("up")).alias("tile"), (F.col("up") == 0).alias("home"))
    tiles = places.groupBy("key", "tile").agg(F.count("*").alias("n"), F.count(F.when(F.col("home"), 1)).alias("at_home")).where("n > 1 and at_home > 0")
    blocks = F.ceil(F.col("n") * F.greatest(F.pow(F.lit(1 / threshold), F.col("tile") + 1), F.lit(256.0)) / BLOCK)
    places = places.join(tiles.select("key", "tile", blocks.alias("blocks")), ["key", "tile"])
    places = places.withColumn("block", F.pmod(F.xxhash64("f0", "f1"), F.col("blocks"))).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    spread = places.join(keyed.select("f0", "f1", "size", "keys", "bits"), ["f0", "f1"]).select(
        "key", "tile", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "home", "size", "f0", "f1", "keys", "bits"
    )
    buckets = max(1, sets.count() // 200)
    tiled = spread.repartition("key", "tile", "i", "j").sortWithinPartitions("key", "tile", "i", "j")
    pairs = written(tiled.mapInArrow(tile_udf(threshold, buckets), PAIR), "candidate-pairs")
    ends = F.array(*[F.struct(F.col(c + "0").alias("f0"), F.col(c + "1").alias("f1")) for c in "ab"])
    needed = pairs.select(F.explode(ends).alias("f"), "bucket").select("f.*", "bucket").distinct()
    wanted = written(needed.join(sets.select("f0", "f1", "id", "row"), ["f0", "f1"]).select("id", "row", "bucket"), "wanted")
    own = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").alias("id"), F.xxhash64("text").alias("row"), "text")
    texts = own.join(small_side(wanted, 1 << 18), ["id", "row"]).select("text", "bucket")
    return pairs.groupBy("bucket").cogroup(texts.groupBy("bucket")).applyInArrow(verify_udf(n, threshold, forest), VERIFIED)


def ends_named(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    a, b = (sets.select(F.col("f0").alias(c + "0"), F.col("f1").alias(c + "1"), F.col("id").alias("id_" + c)) for c in "ab")
    return pairs.join(a, ["a0", "a1"]).join(b, ["b0", "b1"])


def similar_pairs(docs: DataFrame, *, n: int = 3, threshold: float = 0.5) -> DataFrame:
    """id_a < id_b and jaccard for all pairs of different n-gram sets with a Jaccard of the threshold at least; each set by its least doc_id.

    Which documents have which set, ``jaccard_join`` tells (set_id).  Rows are read and left out as there; where one doc_id has several
    texts, a pair of one doc_id is left out.
    """
    sig = signatures(docs, n)
    sets = distinct_sets(sig)
    named = ends_named(similar_sets(docs, sig, sets, n, threshold, False), sets).where("id_a <> id_b")
    return named.groupBy(F.least("id_a", "id_b").alias("id_a"), F.greatest("id_a", "id_b").alias("id_b")).agg(F.max("jaccard").alias("jaccard"))


def jaccard_join(docs: DataFrame, *, n: int = 3, threshold: float = 0.5) -> DataFrame:
    """Of every document that is linked to another: doc_id, class_id, set_id, n_same and n_links.

    Documents are linked if their n-gram sets have a Jaccard of the threshold at least; all links are found and counted.  class_id is the
    least doc_id of the documents that links connect, set_id the least doc_id with the very same set, n_same the number of other
    documents with that set, n_links of all that the document is linked to.  Documents without a link aren't listed.  Texts
    without a word (null, empty, punctuation only) and rows without doc_id have no links; a text of fewer than
    n words has one gram, of all its words.  Repeated rows count once; a doc_id with several texts is a document for each of
    their sets, with a row of its own.  Other columns aren't looked at.
    """
    sig = signatures(docs, n)
    sets = distinct_sets(sig)
    found = written(similar_sets(docs, sig, sets, n, threshold, False), "similar-sets")
    members = sig.select("f0", "f1", "id").distinct()
    sizes = members.groupBy("f0", "f1").agg(F.count("*").alias("members"))
    sets = written(sets.join(sizes, ["f0", "f1"]).select("f0", "f1", "id", "row", "members"), "set-sizes")
    both = found.select("a0", "a1", "b0", "b1").unionByName(found.select(F.col("b0").alias("a0"), F.col("b1").alias("a1"), F.col("a0").alias("b0"), F.col("a1").alias("b1")))
    links = both.join(sets.select(F.col("f0").alias("b0"), F.col("f1").alias("b1"), "members"), ["b0", "b1"]).groupBy(F.col("a0").alias("f0"), F.col("a1").alias("f1")).agg(F.sum("members").alias("others"))
    near = ends_named(found.where("tree"), sets).select(F.col("id_a").alias("u"), F.col("id_b").alias("v"))
    classes = components(near).withColumnsRenamed({"node": "id", "root": "class_id"})
    told = sets.join(links, ["f0", "f1"], "left").where("members > 1 or others is not null").join(classes, "id", "left")
    told = told.select("f0", "f1", F.coalesce("class_id", "id").alias("class_id"), F.col("id").alias("set_id"), (F.col("members") - 1).alias("n_same"), (F.col("members") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"))
    return members.join(told, ["f0", "f1"]).select(F.col("id").alias("doc_id"), "class_id", "set_id", "n_same", "n_links")


def components(edges: DataFrame) -> DataFrame:
    """node and root (its component's least node) of each node of edges (u, v), by alternating large-star and small-star.

    Least neighbours are aggregates and joined, so a node with any number of neighbours is no row or task of its own.
    """
    edges = written(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    state = None
    while True:
        around = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = around.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        large = around.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = written(large, "edges")
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.*")
        before, edges = edges, written(small.where("u <> v").distinct(), "edges")
        discard(before, large)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        state = now


@own_names
def dedup(docs: DataFrame, *, n: int = 3, threshold: float = 0.5) -> DataFrame:
    """The rows of docs with one document, of the smallest doc_id, of each group that similar pairs connect.

    Rows without doc_id or without a word all stay, as do all rows of a doc_id that stays; columns stay as they are.
    """
    sig = signatures(docs, n)
    sets = distinct_sets(sig)
    near = ends_named(similar_sets(docs, sig, sets, n, threshold, True), sets).select(F.col("id_a").alias("u"), F.col("id_b").alias("v"))
    same = sig.join(sets.select("f0", "f1", F.col("id").alias("v")), ["f0", "f1"]).where("id <> v").select(F.col("id").alias("u"), "v")
    gone = written(components(near.unionByName(same)).select(F.col("node").alias("__gone")), "near-copies")
    return docs.join(small_side(gone, 1 << 20), F.col("doc_id") == F.col("__gone"), "left_anti")


def oracle(n: int = 3, threshold: float = 0.5) -> str:
    """``jaccard_join`` of documents with its defaults, as DuckDB SQL: all pairs that share a gram."""
    return f"""
        with recursive words as (
            select doc_id, list_filter(regexp_split_to_array(lower(text), '[\\x00-\\x2f\\x3a-\\x40\\x5b-\\x60\\x7b-\\x7f]+'), lambda w : w <> '') as w
            from documents where doc_id is not null and text is not null),
        sets as (
            select distinct doc_id, list_sort(list_distinct(list_transform(range(1, greatest(len(w) - {n - 1}, 1) + 1), lambda i : array_to_string(w[i : i + {n - 1}], ' ')))) as s
            from words where len(w) > 0),
        groups as (select s, min(doc_id) as set_id, count(*) as members, len(s) as size from sets group by s),
        grams as (select set_id, size, unnest(s) as g from groups),
        pairs as (
            select a.set_id as x, b.set_id as y from grams as a join grams as b on a.g = b.g and a.set_id <> b.set_id
            group by a.set_id, b.set_id, a.size, b.size having count(*) >= {threshold} * (a.size + b.size - count(*)) - 1e-9),
        reach as (select set_id as x, set_id as y from groups union select r.x, p.y from reach as r join pairs as p on p.x = r.y),
        classes as (select x, min(y) as class_id from reach group by x),
        links as (select p.x, sum(g.members) as others from pairs as p join groups as g on g.set_id = p.y group by p.x)
        select s.doc_id, c.class_id, g.set_id, g.members - 1 as n_same, (g.members - 1 + coalesce(l.others, 0))::bigint as n_links
        from sets as s join groups as g on g.s = s.s join classes as c on c.x = g.set_id left join links as l on l.x = g.set_id
        where g.members > 1 or l.others is not null"""
