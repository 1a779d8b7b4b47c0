"""Byte-level BPE with a two-tier lookup.

Pre-tokens that are in the vocabulary as they stand are resolved by a minimal perfect hash (hash and displace):
one hash, one displacement, one comparison.  The rest is merged lowest rank first and leftmost of equal ranks: long ones with
a heap of candidate pairs over a linked list of bytes, short ones of a batch together, a merge of each in a round.  Texts are cut into pre-tokens by the classes of their characters, a
batch at a time, and each pre-token is hashed as a slice of the batch; what a worker has resolved it remembers by that hash, in a
table of bounded size.  Two pre-tokens of one hash can't go unseen: the tokens' bytes are compared with the text's, and where they
differ the texts are encoded one by one.  Vocabularies are files of base64 tokens and ranks, at a path that is a parameter; they
are read on the driver and broadcast.
"""

from __future__ import annotations

import base64
import heapq
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textbuf
from .common import small_batches

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_PRETOKEN = regex.compile(PATTERN)
#: Pre-tokens that a worker remembers: slots by hash, two for each, and token ids of all slots before they are emptied.
SLOT_BITS, POOL = 19, 1 << 21
#: Bytes of a pre-token up to which it is merged together with the others of a batch.
SHORT = 64
_NO_PAIR = np.iinfo(np.int32).max
_M64 = (1 << 64) - 1
_STEP = 0x9E3779B97F4A7C15


def load(path: str = VOCABULARY) -> dict[bytes, int]:
    ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in Path(path).read_bytes().splitlines() if line)}
    if any(bytes([b]) not in ranks for b in range(256)):
        raise ValueError(f"{path} lacks single bytes")
    if sorted(ranks.values()) != list(range(len(ranks))):
        raise ValueError(f"{path}: ranks must be 0, 1, 2 ...")
    return ranks


def pretokens(text: str) -> list[str]:
    return _PRETOKEN.findall(text)


class PerfectHash:
    """A minimal perfect hash of the tokens: as many slots as tokens, each slot one token's."""

    def __init__(self, ranks: dict[bytes, int], per_bucket: int = 4) -> None:
        n = len(ranks)
        self.size, self.buckets = n, max(1, n // per_bucket)
        self.displacement = [0] * self.buckets
        self.tokens: list[bytes] = [b""] * n
        self.ids = [-1] * n
        groups: list[list[tuple[int, bytes]]] = [[] for _ in range(self.buckets)]
        for token in ranks:
            h = xxhash.xxh3_64_intdigest(token)
            groups[h % self.buckets].append((h, token))
        taken = bytearray(n)
        free = n - 1
        for g in sorted(range(self.buckets), key=lambda g: -len(groups[g])):
            members = groups[g]
            if not members:
                break
            if len(members) == 1:  # the slot itself, as a negative displacement
                while taken[free]:
                    free -= 1
                self.displacement[g], slots = -free - 1, [free]
            else:
                d = 0
                while True:
                    slots = [self._slot(h, d) for h, _ in members]
                    if len(set(slots)) == len(slots) and not any(taken[s] for s in slots):
                        break
                    d += 1
                self.displacement[g] = d
            for s, (_, token) in zip(slots, members):
                taken[s], self.tokens[s], self.ids[s] = 1, token, ranks[token]

    def _slot(self, h: int, d: int) -> int:
        x = (h + d * _STEP) & _M64
        x = ((x ^ (x >> 32)) * 0xD6E8FEB86659FD93) & _M64
        return (x ^ (x >> 32)) % self.size

    def get(self, token: bytes) -> int:
        """The token's id, or -1."""
        h = xxhash.xxh3_64_intdigest(token)
        d = self.displacement[h % self.buckets]
        s = -d - 1 if d < 0 else self._slot(h, d)
        return self.ids[s] if self.tokens[s] == token else -1


def pair_table(ranks: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
    """Of all two tokens that are a token together: first * len(ranks) + second, sorted, and the token that they are."""
    get, n = ranks.get, len(ranks)
    pairs = sorted((a * n + b, r) for token, r in ranks.items() for i in range(1, len(token)) if (a := get(token[:i])) is not None and (b := get(token[i:])) is not None)
    return np.array([k for k, _ in pairs], np.int64), np.array([r for _, r in pairs], np.int32)


def spread(begin: np.ndarray, n: np.ndarray) -> np.ndarray:
    """begin[i], begin[i] + 1 ... of n[i] numbers each, one after the other."""
    return np.repeat(begin - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))


def merge(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Token ids of a pre-token by merging its bytes."""
    n = len(word)
    get = ranks.get
    end = list(range(1, n + 1))  # of the part that starts here; 0 once it is part of another
    before = list(range(-1, n))
    heap = [(r, i) for i in range(n - 1) if (r := get(word[i : i + 2])) is not None]
    heapq.heapify(heap)
    pop, push = heapq.heappop, heapq.heappush
    while heap:
        r, i = pop(heap)
        j = end[i]
        if not j or j >= n:
            continue
        k = end[j]
        if get(word[i:k]) != r:
            continue
        end[i], end[j] = k, 0
        if k < n:
            before[k] = i
            if (r := get(word[i : end[k]])) is not None:
                push(heap, (r, i))
        p = before[i]
        if p >= 0 and (r := get(word[p:k])) is not None:
            push(heap, (r, p))
    out, i = [], 0
    while i < n:
        out.append(ranks[word[i : end[i]]])
        i = end[i]
    return out


# Pre-tokens of a batch.

_LETTER, _NUMBER, _BLANK, _REST = 1, 2, 3, 4
_classes: list[np.ndarray] = []


def character_classes() -> np.ndarray:
    """The class of every code point: letter, number, white space or any other."""
    if not _classes:
        every, out = "".join(map(chr, range(0x110000))), np.full(0x110000, _REST, np.uint8)
        for kind, pattern in ((_LETTER, r"\p{L}+"), (_NUMBER, r"\p{N}+"), (_BLANK, r"\s+")):
            for m in regex.finditer(pattern, every):
                out[m.start() : m.end()] = kind
        _classes.append(out)
    return _classes[0]


def byte_classes(data: np.ndarray) -> np.ndarray:
    """The class of the character that each byte of UTF-8 is of."""
    table = character_classes()
    out = table[:256][data]
    lead = np.flatnonzero(data >= 0xC0)
    if len(lead):
        more = np.concatenate([data, np.zeros(3, np.uint8)])
        b0, b1, b2, b3 = (more[lead + k].astype(np.int32) & (255 if k == 0 else 63) for k in range(4))
        three, four = b0 >= 0xE0, b0 >= 0xF0
        code = np.where(four, (b0 & 7) << 18 | b1 << 12 | b2 << 6 | b3, np.where(three, (b0 & 15) << 12 | b1 << 6 | b2, (b0 & 31) << 6 | b1))
        kind = table[code]
        out[lead] = kind
        for k, of in ((1, slice(None)), (2, three), (3, four)):
            out[lead[of] + k] = kind[of]
    return out


def boundaries(data: np.ndarray, row_byte: np.ndarray) -> np.ndarray:
    """Where the pre-tokens of rows of UTF-8 begin, as PATTERN cuts them."""
    n = len(data)
    kind = byte_classes(data)
    row_starts = np.zeros(n + 1, bool)
    row_starts[row_byte] = True
    edge = row_starts[:n].copy()
    edge[1:] |= kind[1:] != kind[:-1]
    runs = np.flatnonzero(edge)
    ends = np.append(runs[1:], n)
    # white space: its last character is a pre-token of its own, or belongs to what follows it if it is a space
    between = (kind[runs] == _BLANK) & ~row_starts[ends]
    after = ends[between]
    last = after - 1
    for _ in range(3):
        last = last - ((data[last] & 0xC0) == 0x80)
    edge[last] = True
    edge[after[data[last] == 0x20]] = False
    # contractions: 's, 't, 'm, 'd, 're, 've, 'll at the begin of a pre-token
    quote = np.flatnonzero(edge & (data == 0x27))
    if len(quote):
        stop = row_byte[np.searchsorted(row_byte, quote, side="right")]
        more = np.concatenate([data, np.zeros(2, np.uint8)]).astype(np.int32)
        one, two = more[quote + 1], more[quote + 1] << 8 | more[quote + 2]
        size = np.where(np.isin(one, [ord(c) for c in "stmd"]), 2, np.where(np.isin(two, [ord(a) << 8 | ord(b) for a, b in ("re", "ve", "ll")]), 3, 0))
        fits = (size > 0) & (quote + size <= stop)
        quote, size, stop = quote[fits], size[fits], stop[fits]
        edge[quote + 1] = False
        edge[(quote + size)[quote + size < stop]] = True
    return np.flatnonzero(edge)


class Codec:
    """Token ids of texts by a vocabulary, and texts of token ids."""

    def __init__(self, ranks: dict[bytes, int], table: PerfectHash | None = None, pairs: tuple[np.ndarray, np.ndarray] | None = None) -> None:
        self.ranks, self.table = ranks, table or PerfectHash(ranks)
        self.pairs, self.paired = pairs or pair_table(ranks)
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        self.bytes_of = [b""] * len(ranks)
        for token, r in ranks.items():
            self.bytes_of[r] = token
        self.sizes = np.array([len(b) for b in self.bytes_of])
        self.begins = np.cumsum(self.sizes) - self.sizes
        self.flat = np.frombuffer(b"".join(self.bytes_of), np.uint8)
        self.displacement, self.slots = np.array(self.table.displacement), np.array(self.table.ids)
        self.byte_pairs = self._pair(np.repeat(self.byte_ids, 256), np.tile(self.byte_ids, 256))
        self._forget()

    def _forget(self) -> None:
        self.hashes = np.zeros(1 << SLOT_BITS, np.uint64)
        self.at, self.n = np.zeros(1 << SLOT_BITS, np.int32), np.zeros(1 << SLOT_BITS, np.int32)
        self.pool, self.filled = np.zeros(POOL, np.int32), 0

    def resolve(self, pretoken: bytes) -> list[int]:
        whole = self.table.get(pretoken)
        return [whole] if whole >= 0 else merge(pretoken, self.ranks)

    def _pair(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The tokens that two tokens each are together; _NO_PAIR if they are none."""
        if not len(self.pairs):
            return np.full(len(left), _NO_PAIR, np.int32)
        key = left.astype(np.int64) * len(self.ranks) + right
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        return np.where(self.pairs[at] == key, self.paired[at], _NO_PAIR)

    def merge_many(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Token ids as ``merge`` finds them of many pre-tokens, and how many each has: each round merges the lowest pair, the leftmost of equal ones, of every pre-token that has one."""
        n = end - start
        begin, counts = np.cumsum(n) - n, np.zeros(len(n), np.int64)
        raw = data[spread(start, n)]
        token = self.byte_ids[raw]
        done = np.empty(len(token), np.int32)  # each pre-token's from its begin on
        rank = np.full(len(token), _NO_PAIR, np.int32)
        inner = np.ones(len(token), bool)
        inner[begin + n - 1] = False
        inner = np.flatnonzero(inner)
        rank[inner] = self.byte_pairs[raw[inner].astype(np.int64) << 8 | raw[inner + 1]]
        word = np.arange(len(n))
        while len(word):
            at = np.cumsum(n) - n
            least = np.minimum.reduceat(rank, at)
            on = least != _NO_PAIR
            if not on.all():
                keep, over = np.repeat(on, n), word[~on]
                counts[over] = n[~on]
                done[spread(begin[over], n[~on])] = token[~keep]
                token, rank, word, n, least = token[keep], rank[keep], word[on], n[on], least[on]
                if not len(word):
                    break
                at = np.cumsum(n) - n
            lowest = np.flatnonzero(rank == np.repeat(least, n))
            at = lowest[np.searchsorted(lowest, at)]
            token[at] = least
            keep = np.ones(len(token), bool)
            keep[at + 1] = False
            token, rank, n = token[keep], rank[keep], n - 1
            at = at - np.arange(len(at))  # each earlier pre-token is one token shorter
            first = np.cumsum(n) - n
            rank[at] = _NO_PAIR
            near = np.concatenate([at[at > first] - 1, at[at < first + n - 1]])
            rank[near] = self._pair(token[near], token[near + 1])
        return done[spread(begin, counts)], counts

    def whole_many(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """What the perfect hash has of many pre-tokens: a token's id, or -1."""
        raw, hashed = data.tobytes(), xxhash.xxh3_64_intdigest
        h = np.array([hashed(raw[a:b]) for a, b in zip(start.tolist(), end.tolist())], np.uint64)
        d = self.displacement[(h % np.uint64(self.table.buckets)).astype(np.int64)]
        x = h + np.maximum(d, 0).astype(np.uint64) * np.uint64(_STEP)
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        found = self.slots[np.where(d < 0, -d - 1, ((x ^ (x >> np.uint64(32))) % np.uint64(self.table.size)).astype(np.int64))]
        size = end - start
        fits = np.flatnonzero(self.sizes[found] == size)
        out = np.full(len(h), -1, np.int32)
        if len(fits):
            n = size[fits]
            same = np.logical_and.reduceat(self.flat[spread(self.begins[found[fits]], n)] == data[spread(start[fits], n)], np.cumsum(n) - n)
            out[fits[same]] = found[fits[same]]
        return out

    def resolve_many(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What ``resolve`` finds of many pre-tokens: token ids, and how many each has."""
        whole = self.whole_many(data, start, end)
        sizes = np.ones(len(start), np.int32)
        short = np.flatnonzero((whole < 0) & (end - start <= SHORT))
        merged, sizes[short] = self.merge_many(data, start[short], end[short])
        long = {i: merge(data[start[i] : end[i]].tobytes(), self.ranks) for i in np.flatnonzero((whole < 0) & (end - start > SHORT)).tolist()}
        for i, found in long.items():
            sizes[i] = len(found)
        ids, at = np.empty(int(sizes.sum()), np.int32), np.cumsum(sizes) - sizes
        ids[at[whole >= 0]] = whole[whole >= 0]
        ids[spread(at[short], sizes[short])] = merged
        for i, found in long.items():
            ids[at[i] : at[i] + len(found)] = found
        return ids, sizes

    def _lookup(self, hashes: np.ndarray, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Token ids of all pre-tokens, and how many each has."""
        slot = (hashes >> np.uint64(64 - SLOT_BITS)).astype(np.int64)
        known = self.hashes[slot] == hashes
        second = np.flatnonzero(~known)
        slot[second] ^= 1
        known[second] = self.hashes[slot[second]] == hashes[second]
        at, n = self.at[slot], self.n[slot]
        miss = np.flatnonzero(~known)
        pool = self.pool
        if len(miss):
            own, first, which = np.unique(hashes[miss], return_index=True, return_inverse=True)
            ids, sizes = self.resolve_many(data, start[miss[first]], end[miss[first]])
            if self.filled + len(ids) > POOL:
                at, n = np.where(known, at, 0), np.where(known, n, 0)
                pool = np.concatenate([self.pool[: self.filled], ids])  # of this batch only
                begin = self.filled + np.cumsum(sizes) - sizes
                self._forget()
            else:
                begin = (self.filled + np.cumsum(sizes) - sizes).astype(np.int32)
                self.pool[self.filled : self.filled + len(ids)] = ids
                self.filled += len(ids)
                to = slot[miss[first]]
                to ^= (self.hashes[to] != 0) & ((self.hashes[to ^ 1] == 0) | (own & np.uint64(1) == 0))  # an empty one, or either
                self.hashes[to], self.at[to], self.n[to] = own, begin, sizes
            at, n = at.astype(np.int64), n.astype(np.int64)
            at[miss], n[miss] = begin[which], sizes[which]
        return pool[spread(at, n)], n

    def encode_rows(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Token ids of all texts, how many each has, and whether decoding them gives the text back."""
        counts, exact = np.zeros(len(texts), np.int64), np.ones(len(texts), bool)
        data, offsets = textbuf.buffers(texts)
        values, total, i = np.empty(len(data), np.int32), 0, 0  # a token has a byte at least; what isn't touched takes no memory
        while i < len(texts):
            j = min(max(int(np.searchsorted(offsets, offsets[i] + textbuf.CHUNK, side="right")) - 1, i + 1), len(texts))
            part, row_byte = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
            if len(part):
                start = boundaries(part, row_byte)
                end = np.append(start[1:], len(part))
                hashes = textbuf.slices(textbuf.prefix(textbuf.CODE[part], textbuf.BASE), start, end, textbuf.BASE)
                ids, n = self._lookup(hashes, part, start, end)
                upto = np.concatenate([[0], np.cumsum(n)])[np.searchsorted(start, row_byte)]
                if self._same(ids, upto, part, row_byte):
                    counts[i:j] = np.diff(upto)
                else:
                    ids = []
                    for r in range(i, j):
                        raw = data[offsets[r] : offsets[r + 1]].tobytes()
                        own = self.encode(raw.decode())
                        counts[r], exact[r] = len(own), self.decode_bytes(own) == raw
                        ids += own
                values[total : total + len(ids)] = ids
                total += len(ids)
            i = j
        return values[:total], counts, exact

    def _same(self, ids: np.ndarray, upto: np.ndarray, data: np.ndarray, row_byte: np.ndarray) -> bool:
        """Are the tokens' bytes those of each row?"""
        sizes = self.sizes[ids]
        ends = np.concatenate([[0], np.cumsum(sizes)])
        if (ends[upto] != row_byte).any():
            return False
        return bool((self.flat[np.repeat(self.begins[ids] - ends[:-1], sizes) + np.arange(len(data))] == data).all())

    def encode(self, text: str) -> list[int]:
        """Token ids of one text, pre-token by pre-token."""
        return [i for p in pretokens(text) for i in self.resolve(p.encode())]

    def decode_bytes(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))

    def decode(self, ids: list[int]) -> str:
        """The text; bytes that are no UTF-8 (ids cut from a text may start or end within a character) become U+FFFD."""
        return self.decode_bytes(ids).decode("utf-8", "replace")


_codecs: dict[object, Codec] = {}


def _codec(shared) -> Codec:
    """The worker's codec of a broadcast vocabulary."""
    key = shared.value["digest"]
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = Codec(shared.value["ranks"], shared.value["table"], shared.value["pairs"])
    return _codecs[key]


def share(spark: SparkSession, path: str = VOCABULARY):
    """The vocabulary and its perfect hash as a broadcast variable; its size is the vocabulary's, whatever the data's."""
    small_batches(spark)
    ranks = load(path)
    digest = xxhash.xxh3_128_hexdigest(Path(path).read_bytes())
    return spark.sparkContext.broadcast({"digest": digest, "ranks": ranks, "table": PerfectHash(ranks), "pairs": pair_table(ranks)})


ENCODED = "struct<tokens: array<int>, exact: boolean>"


def sortable_ids(vocabulary: str = VOCABULARY) -> str:
    """The numpy type of a vocabulary's token ids in as few bytes as hold them all; bytes of such ids are in the order of the ids."""
    return ">u2" if len(load(vocabulary)) <= 1 << 16 else ">u4"


def packed_udf(shared, ids: str):
    """Tokens of a text as bytes, each a number of the numpy type ``ids``; null of null."""
    width = np.dtype(ids).itemsize

    @F.arrow_udf("binary")
    def encode(text: pa.Array) -> pa.Array:
        values, counts, _ = _codec(shared).encode_rows(text)
        offsets = np.zeros(len(text) + 1, np.int32)
        np.cumsum(width * counts, out=offsets[1:])
        out = pa.Array.from_buffers(pa.binary(), len(text), [text.is_valid().buffers()[1], pa.py_buffer(offsets), pa.py_buffer(values.astype(ids, copy=False))])
        textbuf.release()
        return out

    return encode


def encode_udf(shared):
    """Tokens of a text, and whether decoding them gives the text back; null of null."""

    @F.arrow_udf(ENCODED)
    def encode(text: pa.Array) -> pa.Array:
        values, counts, exact = _codec(shared).encode_rows(text)
        offsets = np.zeros(len(text) + 1, np.int32)
        np.cumsum(counts, out=offsets[1:])
        tokens = pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))
        textbuf.release()
        return pa.StructArray.from_arrays([tokens, pa.array(exact)], names=["tokens", "exact"], mask=text.is_null())

    return encode


def decode_udf(shared):
    """The text of token ids; null of null."""

    @F.arrow_udf("string")
    def decode(tokens: pa.Array) -> pa.Array:
        codec = _codec(shared)
        return pa.array([None if x is None else codec.decode(x) for x in tokens.to_pylist()], pa.string())

    return decode


def encode(docs: DataFrame, *, vocabulary: str = VOCABULARY, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the columns to keep, tokens, n_tokens and exact (decoding gives the text back) of every row of docs.

    Null text: tokens, n_tokens and exact are null; the empty text has no tokens.  Null and repeated doc_ids are rows as
    any.  Strings of special tokens are ordinary text.  Other columns are left out.
    """
    also = [F.col(f"`{c}`") for c in keep]
    found = docs.select("doc_id", *also, encode_udf(share(docs.sparkSession, vocabulary))("text").alias("e"))
    return found.select("doc_id", *also, "e.tokens", F.when(F.col("e").isNotNull(), F.size("e.tokens")).alias("n_tokens"), "e.exact")


def encode_packed(docs: DataFrame, *, vocabulary: str = VOCABULARY, keep: tuple[str, ...] = (), ids: str = "<i4") -> DataFrame:
    """doc_id, the columns to keep and tokens of every row of docs, as ``encode`` has them, in bytes: for files four each, little-endian, or of another numpy type."""
    return docs.select("doc_id", *[F.col(f"`{c}`") for c in keep], packed_udf(share(docs.sparkSession, vocabulary), ids)("text").alias("tokens"))


def decode(encoded: DataFrame, *, vocabulary: str = VOCABULARY) -> DataFrame:
    """The rows of ``encode`` with their text."""
    return encoded.withColumn("text", decode_udf(share(encoded.sparkSession, vocabulary))("tokens"))
