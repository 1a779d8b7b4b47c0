"""Substring dedup: anchors at the positions of a difference cover.

Modulo ``PERIOD`` every difference of two numbers is a difference of two members of ``COVER``.  So
of any two positions i and j that start a match, both i + d and j + d lie in the cover for some d under
the period: hashing only the windows at cover positions, 4 of 13, gives any match of ``WINDOW`` + 12 = 50
words an anchor that both sides hash.  Equal windows are linked to the first of them (so a passage that
many documents share costs a link each, not a pair each), anchors are gathered by pair of documents, and
the words of both are compared along each diagonal to extend every anchor to its maximal match.

The first of a window may share less of a passage than two later ones do.  Each anchor has a hash of the words around it; where two or
more differ in it from the first, all stretches of 50 words through these anchors are hashed too and linked to the first of theirs.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textbuf
from .common import small_side, written

PERIOD, COVER, WINDOW = 13, (0, 1, 3, 9), 38
#: A place is a document's key times 2**28 plus the number of a word.
PLACE_BITS = 28
KEY_MASK = (1 << 35) - 1


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text and a 35-bit key of both; what has one key by chance is told apart when texts are compared."""
    return docs.where("doc_id is not null and text is not null").select(
        "doc_id", "text", F.xxhash64("doc_id", "text").bitwiseAND(F.lit(KEY_MASK)).alias("key")
    )


def anchors_udf(window: int, period: int, cover: tuple[int, ...]):
    at_cover = np.zeros(period, bool)
    at_cover[list(cover)] = True

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = b.column(0).to_numpy()
            for w in textbuf.chunks(b.column(1)):
                counts = np.diff(w.bound)
                if len(counts) and counts.max() >= 1 << PLACE_BITS:
                    raise ValueError("a text of over 2**28 words")
                row = np.repeat(np.arange(w.rows), counts)
                pos = np.arange(len(row)) - w.bound[:-1][row]
                pick = np.flatnonzero(at_cover[pos % period] & (pos + window <= counts[row]))
                if not len(pick):
                    continue
                pre = textbuf.prefix(w.hash, textbuf.WORD_BASE)
                hashed = textbuf.slices(pre, pick, pick + window, textbuf.WORD_BASE)
                before, after = np.minimum(pos[pick], period - 1), np.minimum(counts[row[pick]] - pos[pick], window + period - 1)
                around = textbuf.slices(pre, pick - before, pick + after, textbuf.WORD_BASE) + before.astype(np.uint64)
                place = (keys[w.first + row[pick]] << PLACE_BITS) | pos[pick]
                yield pa.RecordBatch.from_arrays([pa.array(hashed.view(np.int64)), pa.array(place), pa.array(around.view(np.int64))], names=["h", "place", "around"])

    return work


def link_rows(place: np.ndarray, first: np.ndarray, crowded: bool) -> pa.RecordBatch:
    low = (1 << PLACE_BITS) - 1
    cols = [place >> PLACE_BITS, first >> PLACE_BITS, place & low, first & low, np.full(len(place), crowded)]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["key", "first", "pos", "first_pos", "crowded"])


LINK = "key long, first long, pos long, first_pos long, crowded boolean"


def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From anchors sorted by hash and place, each but the first of its hash, with the first.

    Where two or more of a hash differ from the first in the words around them, these and the first are there again as crowded.
    """
    held = [np.zeros(0, np.int64)] * 3  # of the last hash the first anchor and the first two that differ from it
    for b in batches:
        if not b.num_rows:
            continue
        old = len(held[0])
        h, place, around = (np.concatenate([x, b.column(k).to_numpy()]) for k, x in enumerate(held))
        new = np.ones(len(h), bool)
        new[1:] = h[1:] != h[:-1]
        opens = np.maximum.accumulate(np.where(new, np.arange(len(h)), 0))
        first = place[opens]
        fresh = np.arange(len(h)) >= old
        again = fresh & (place != first)
        if again.any():
            yield link_rows(place[again], first[again], False)
        other = around != around[opens]
        group = np.cumsum(new) - 1
        crowd = (np.bincount(group, other) >= 2)[group] & (new | other)
        if old == 3:
            crowd &= fresh
        if crowd.any():
            yield link_rows(place[crowd], first[crowd], True)
        last = opens[-1]
        keep = np.concatenate([[last], last + np.flatnonzero(other[last:])[:2]])
        held = [h[keep], place[keep], around[keep]]


def stretches_udf(window: int, period: int):
    """Of texts (key, text, at: crowded anchors with the first of each) all stretches of window + period - 1 words through the anchors.

    ``star`` is where the stretch lies on the diagonal of the anchor's first.
    """
    length = window + period - 1

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = b.column(0).to_numpy()
            at = b.column(2)
            sizes = np.diff(at.offsets.to_numpy())
            owner, anchor = np.repeat(np.arange(len(sizes)), sizes), at.flatten()
            pos, star = anchor.field("pos").to_numpy(), anchor.field("star").to_numpy()
            for w in textbuf.chunks(b.column(1)):
                counts = np.diff(w.bound)
                lo, hi = np.searchsorted(owner, [w.first, w.first + w.rows])
                for s in range(lo, hi, 1 << 15):
                    cut = slice(s, min(s + (1 << 15), hi))
                    back = np.arange(period)
                    row = np.repeat(owner[cut] - w.first, period)
                    start = (pos[cut, None] - back).ravel()
                    to = (star[cut, None] - back).ravel()
                    fits = (start >= 0) & (start + length <= counts[row])
                    row, start, to = row[fits], start[fits], to[fits]
                    if not len(row):
                        continue
                    place, k = np.unique((keys[w.first + row] << PLACE_BITS) | start, return_index=True)
                    begin = w.bound[:-1][row[k]] + start[k]
                    hashed = textbuf.slices(textbuf.prefix(w.hash, textbuf.WORD_BASE), begin, begin + length, textbuf.WORD_BASE)
                    yield pa.RecordBatch.from_arrays([pa.array(hashed.view(np.int64)), pa.array(place), pa.array(to[k])], names=["h", "place", "star"])

    return work


def crowded_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From stretches sorted by hash and place, each but the first of its hash, with the first, unless the anchor's link is the same."""
    held = None
    for b in batches:
        if not b.num_rows:
            continue
        h, place, star = (b.column(k).to_numpy() for k in range(3))
        if held is not None:
            h, place, star = np.concatenate([[held[0]], h]), np.concatenate([[held[1]], place]), np.concatenate([[held[1]], star])
        new = np.ones(len(h), bool)
        new[1:] = h[1:] != h[:-1]
        first = place[np.maximum.accumulate(np.where(new, np.arange(len(h)), 0))]
        held = (h[-1], first[-1])
        again = (place != first) & (star != first)
        if again.any():
            yield link_rows(place[again], first[again], False)


def matches(a: np.ndarray, b: np.ndarray, pos: np.ndarray, other: np.ndarray, window: int) -> list[tuple[int, int, int]]:
    """Maximal equal runs (start in a, length, start in b) through the anchors (pos, other) of two arrays of word hashes."""
    out = []
    diagonal = pos - other
    order = np.lexsort((pos, diagonal))
    pos, diagonal = pos[order], diagonal[order]
    edge = np.concatenate([[0], np.flatnonzero(np.diff(diagonal)) + 1, [len(pos)]])
    for s, e in zip(edge[:-1], edge[1:]):
        d = int(diagonal[s])
        lo, hi = max(0, d), min(len(a), len(b) + d)
        if hi - lo < window:
            continue
        breaks = np.flatnonzero(a[lo:hi] != b[lo - d : hi - d])
        k = np.searchsorted(breaks, pos[s:e] - lo)
        starts = np.where(k > 0, breaks[np.maximum(k - 1, 0)] + 1 if len(breaks) else 0, 0) + lo
        ends = np.where(k < len(breaks), breaks[np.minimum(k, len(breaks) - 1)] if len(breaks) else 0, hi - lo) + lo
        whole = (ends - starts >= window) & (starts <= pos[s:e])
        for x, y in sorted(set(zip(starts[whole].tolist(), ends[whole].tolist()))):
            out.append((x, y - x, x - d))
    return out


SPAN = "doc_id long, start_word long, n_words long, other_id long, other_start long"


def extend_udf(window: int):
    def work(pairs: pa.Table, texts: pa.Table) -> pa.Table:
        held = defaultdict(list)
        if texts.num_rows:
            keys, ids = texts["key"].to_pylist(), texts["doc_id"].to_pylist()
            for w in textbuf.chunks(texts["text"].combine_chunks()):
                for r in range(w.rows):
                    held[keys[w.first + r]].append((ids[w.first + r], w.hash[w.bound[r] : w.bound[r + 1]]))
        out: list[tuple[int, int, int, int, int]] = []
        for key, first, at in zip(pairs["key"].to_pylist(), pairs["first"].to_pylist(), pairs["at"].to_pylist()):
            place = np.array(at, np.int64)
            pos, other = place >> PLACE_BITS, place & ((1 << PLACE_BITS) - 1)
            for doc, a in held[key]:
                fits = pos + window <= len(a)
                for other_doc, b in held[first]:
                    ok = fits & (other + window <= len(b))
                    if key == first:
                        ok &= pos != other
                    for start, n, start_b in merged(matches(a, b, pos[ok], other[ok], window)) if ok.any() else ():
                        out.append((doc, start, n, other_doc, start_b))
        cols = list(zip(*out)) if out else [()] * 5
        return pa.table({c.split()[0]: pa.array(v, pa.int64()) for c, v in zip(SPAN.split(", "), cols)})

    return work


def merged(found: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """The union of overlapping matches of one pair; the other side's start is that of the longest."""
    out: list[list[int]] = []
    for start, n, other in sorted(found):
        if out and start < out[-1][0] + out[-1][1]:
            last = out[-1]
            last[1] = max(last[1], start + n - last[0])
            if n > last[3]:
                last[2], last[3] = other, n
        else:
            out.append([start, n, other, n])
    return [(s, n, o) for s, n, o, _ in out]


def repeats(docs: DataFrame, *, window: int = WINDOW, period: int = PERIOD, cover: tuple[int, ...] = COVER) -> DataFrame:
    """Passages of documents that are there before, in another document or earlier in the same.

    Words are what ASCII white space separates, compared exactly.  Every passage of window + period - 1 (50) words or more that
    two places share is found: of any 50 words that are at several places, each place but the first (in the order of keys, which are
    hashes) lies within one listed row.  For each place but the first of each window that the cover picks, and of any 50 words that no
    such row holds, the maximal match with that first place is listed, as doc_id, start_word (from 0), n_words (window at least), other_id
    and other_start; matches of one pair that overlap are one row, with the other_start of the longest.
    Texts of fewer than ``window`` words, null texts and rows without doc_id have no passages.  A row repeated with doc_id and
    text counts once; rows that share only a doc_id are documents of their own.  Other columns aren't looked at.
    """
    spark = docs.sparkSession
    own = keyed(docs)
    anchors = own.select("key", "text").mapInArrow(anchors_udf(window, period, cover), "h long, place long, around long")
    starred = written(anchors.repartition("h").sortWithinPartitions("h", "place").mapInArrow(links, LINK), "anchor-links")
    star = F.shiftleft("first", PLACE_BITS).bitwiseOR(F.col("first_pos"))
    crowded = starred.where("crowded").groupBy("key").agg(F.collect_list(F.struct("pos", star.alias("star"))).alias("at"))
    stretches = own.join(crowded, "key").select("key", "text", "at").mapInArrow(stretches_udf(window, period), "h long, place long, star long")
    more = stretches.repartition("h").sortWithinPartitions("h", "place").mapInArrow(crowded_links, LINK)
    linked = starred.where("not crowded").unionByName(more)
    place = F.shiftleft("pos", PLACE_BITS).bitwiseOR(F.col("first_pos"))
    pairs = written(linked.groupBy("key", "first").agg(F.collect_set(place).alias("at")), "anchor-pairs")
    shares = pairs.groupBy("first").agg(F.ceil(F.count("*") / 500).alias("shares"))
    per_bucket = 100
    buckets = max(1, pairs.count() // per_bucket)
    placed = pairs.join(small_side(written(shares, "anchor-shares"), 1 << 18), "first").select(
        "key", "first", "at", F.pmod(F.xxhash64("first", F.pmod(F.xxhash64("key"), "shares")), F.lit(buckets)).alias("bucket")
    )
    wanted = (
        placed.select(F.explode(F.array("key", "first")).alias("key"), "bucket").groupBy("key").agg(F.collect_set("bucket").alias("buckets"))
    )
    texts = own.join(small_side(written(wanted, "anchor-documents"), 1 << 18), "key").select("key", "doc_id", "text", F.explode("buckets").alias("bucket"))
    return placed.groupBy("bucket").cogroup(texts.groupBy("bucket")).applyInArrow(extend_udf(window), SPAN).distinct()
