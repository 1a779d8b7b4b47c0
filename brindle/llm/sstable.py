"""Sorted-string-table shards: documents by identifier, found by binary search.

A shard holds a range of identifiers.  Its blocks hold entries in order of key, each key as the length
it shares with the one before and the rest; every ``RESTART`` entries a key is whole.  After the blocks come a sparse
index (first key, offset and length of each block), a Bloom filter of the keys and a footer of fixed
size that says where they are:

    block*  index  bloom  footer
    block   zstd of: entry*  u32 offset of each restart  u32 their number;  then xxh32 of it, u32
    entry   varint shared, varint rest, varint value length + 1 (0: null), rest of key, value
    index   u32 blocks, then of each: 8-byte key, u64 offset, u32 length, u32 entries
    bloom   u8 hashes, u64 bits, bits
    footer  u64 index offset, u64 bloom offset, u64 entries, u64 least key, u64 greatest key, magic

Keys are 8 bytes, big-endian, with the sign bit flipped, so that bytes sort as integers do.  A value is token ids, four bytes each,
little-endian, or a text's UTF-8 bytes.
"""

from __future__ import annotations

import os
import struct
import uuid
from bisect import bisect_right
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MAGIC = b"BRSST001"
FOOTER = struct.Struct(">QQQQQ8s")
INDEX = struct.Struct(">8sQII")
RESTART = 16
BLOCK_BYTES = 64 << 10
BLOOM_BITS = 10  # a key
BLOOM_HASHES = 7
#: Bytes of values in a shard, on average.
SHARD_BYTES = 32 << 20


def key_bytes(key: int) -> bytes:
    return ((key + (1 << 63)) & ((1 << 64) - 1)).to_bytes(8, "big")


def key_of(raw: bytes) -> int:
    return int.from_bytes(raw, "big") - (1 << 63)


def varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def read_varint(raw: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = raw[at]
        at += 1
        n |= (b & 127) << shift
        if b < 128:
            return n, at
        shift += 7


class Builder:
    """Sections of one shard, from entries in order of key."""

    def __init__(self, block_bytes: int = BLOCK_BYTES) -> None:
        self.block_bytes, self.offset, self.entries = block_bytes, 0, 0
        self.index: list[tuple[bytes, int, int, int]] = []
        self.hashes: list[int] = []
        self.first = self.last = b""
        self.codec = zstandard.ZstdCompressor(level=1)
        self._start()

    def _start(self) -> None:
        self.block, self.restarts, self.n, self.first_key = bytearray(), [], 0, b""

    def add(self, key: bytes, value: bytes | None) -> tuple | None:
        """The block that this entry closes, if one."""
        done = self._close() if len(self.block) >= self.block_bytes else None
        if self.n % RESTART == 0:
            self.restarts.append(len(self.block))
            shared = 0
        else:
            shared = next((i for i in range(8) if key[i] != self.last[i]), 8)
        self.first_key = self.first_key or key
        self.block += varint(shared) + varint(8 - shared) + varint(0 if value is None else len(value) + 1) + key[shared:]
        if value is not None:
            self.block += value
        self.n += 1
        self.entries += 1
        self.first = self.first or key
        if key != self.last or self.entries == 1:
            self.hashes.append(xxhash.xxh3_64_intdigest(key))
        self.last = key
        return done

    def _section(self, kind: str, raw: bytes, first: bytes, n: int) -> tuple:
        row = (kind, self.offset, key_of(first), key_of(self.last), n, raw)
        self.offset += len(raw)
        return row

    def _close(self) -> tuple | None:
        if not self.n:
            return None
        self.block += struct.pack(f">{len(self.restarts) + 1}I", *self.restarts, len(self.restarts))
        raw = self.codec.compress(bytes(self.block))
        raw += struct.pack(">I", xxhash.xxh32_intdigest(raw))
        self.index.append((self.first_key, self.offset, len(raw), self.n))
        row = self._section("block", raw, self.first_key, self.n)
        self._start()
        return row

    def finish(self) -> Iterator[tuple]:
        if (row := self._close()) is not None:
            yield row
        index_at = self.offset
        yield self._section("index", struct.pack(">I", len(self.index)) + b"".join(INDEX.pack(*x) for x in self.index), self.first, len(self.index))
        bloom_at = self.offset
        yield self._section("bloom", bloom(self.hashes), self.first, len(self.hashes))
        low, high = int.from_bytes(self.first, "big"), int.from_bytes(self.last, "big")
        yield self._section("footer", FOOTER.pack(index_at, bloom_at, self.entries, low, high, MAGIC), self.first, self.entries)


def bloom_places(h: np.ndarray, bits: int) -> np.ndarray:
    low, high = h & np.uint64(0xFFFFFFFF), (h >> np.uint64(32)) | np.uint64(1)
    return (low[:, None] + high[:, None] * np.arange(BLOOM_HASHES, dtype=np.uint64)) % np.uint64(bits)


def bloom(hashes: list[int]) -> bytes:
    bits = max(64, -(-len(hashes) * BLOOM_BITS // 8) * 8)
    flags = np.zeros(bits, np.uint8)
    flags[bloom_places(np.array(hashes, np.uint64), bits).ravel().astype(np.int64)] = 1
    return struct.pack(">BQ", BLOOM_HASHES, bits) + np.packbits(flags).tobytes()


class Shard:
    """Reads a shard from its bytes, or from a file a block at a time."""

    def __init__(self, raw: bytes | None = None, path: str | None = None) -> None:
        self._raw, self._file = raw, open(path, "rb") if path else None  # noqa: SIM115
        size = len(raw) if raw is not None else os.path.getsize(path)
        index_at, bloom_at, self.entries, self.low, self.high, magic = FOOTER.unpack(self._read(size - FOOTER.size, FOOTER.size))
        if magic != MAGIC:
            raise ValueError("no sorted-string table")
        index = self._read(index_at, bloom_at - index_at)
        self.blocks = [INDEX.unpack_from(index, 4 + INDEX.size * i) for i in range(struct.unpack_from(">I", index)[0])]
        self.firsts = [b[0] for b in self.blocks]
        head = self._read(bloom_at, size - FOOTER.size - bloom_at)
        self.bits = struct.unpack_from(">BQ", head)[1]
        self.flags = head[9:]

    def _read(self, at: int, n: int) -> bytes:
        if self._file is None:
            return self._raw[at : at + n]
        self._file.seek(at)
        return self._file.read(n)

    def may_have(self, key: int) -> bool:
        places = bloom_places(np.array([xxhash.xxh3_64_intdigest(key_bytes(key))], np.uint64), self.bits)[0]
        return all(self.flags[int(p) >> 3] >> (7 - (int(p) & 7)) & 1 for p in places)

    def _block(self, i: int) -> tuple[bytes, list[int]]:
        _, at, n, _ = self.blocks[i]
        raw = self._read(at, n)
        if struct.unpack(">I", raw[-4:])[0] != xxhash.xxh32_intdigest(raw[:-4]):
            raise ValueError(f"block {i} is damaged")
        block = zstandard.ZstdDecompressor().decompress(raw[:-4])
        count = struct.unpack(">I", block[-4:])[0]
        return block, list(struct.unpack(f">{count}I", block[-4 - 4 * count : -4]))

    @staticmethod
    def _entries(block: bytes, at: int, stop: int) -> Iterator[tuple[bytes, bytes | None]]:
        key = b""
        while at < stop:
            shared, at = read_varint(block, at)
            rest, at = read_varint(block, at)
            size, at = read_varint(block, at)
            key = key[:shared] + block[at : at + rest]
            at += rest
            if size:
                yield key, block[at : at + size - 1]
                at += size - 1
            else:
                yield key, None

    def get(self, key: int) -> list[bytes | None]:
        """The values of all entries of a key: none, one, or several of a repeated identifier."""
        if not self.may_have(key):
            return []
        raw, out = key_bytes(key), []
        i = max(0, bisect_right(self.firsts, raw) - 1)
        while i > 0 and self.firsts[i] == raw:  # a repeated key may begin in the block before
            i -= 1
        while i < len(self.blocks) and self.firsts[i] <= raw:
            block, restarts = self._block(i)
            stop = len(block) - 4 * (len(restarts) + 1)
            whole = lambda r: next(self._entries(block, restarts[r], stop))[0]  # noqa: B023, E731
            low, high = 0, len(restarts)  # the last restart before the key
            while high - low > 1:
                mid = (low + high) // 2
                low, high = (mid, high) if whole(mid) < raw else (low, mid)
            for k, v in self._entries(block, restarts[low], stop):
                if k > raw:
                    return out
                if k == raw:
                    out.append(v)
            i += 1
        return out

    def __iter__(self) -> Iterator[tuple[int, bytes | None]]:
        for i in range(len(self.blocks)):
            block, restarts = self._block(i)
            for k, v in self._entries(block, 0, len(block) - 4 * (len(restarts) + 1)):
                yield key_of(k), v


SECTION = "shard int, seq int, kind string, offset long, first_id long, last_id long, entries long, content binary"
_FIELDS = [("shard", pa.int32()), ("seq", pa.int32()), ("kind", pa.string()), ("offset", pa.int64()), ("first_id", pa.int64()), ("last_id", pa.int64()), ("entries", pa.int64()), ("content", pa.binary())]


def sections_udf(block_bytes: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, builder, seq, rows, size = TaskContext.get().partitionId(), Builder(block_bytes), 0, [], 0

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows), _FIELDS)], names=[n for n, _ in _FIELDS])

        for b in batches:
            for at in range(0, b.num_rows, 256):
                for key, value in zip(b.column(0).slice(at, 256).to_pylist(), b.column(1).slice(at, 256).to_pylist()):
                    if (done := builder.add(key_bytes(key), value)) is not None:
                        rows.append((shard, seq, *done))
                        seq += 1
                        size += len(done[-1])
                        if size > 4 << 20:
                            yield flush()
                            rows, size = [], 0
        if builder.entries:
            for done in builder.finish():
                rows.append((shard, seq, *done))
                seq += 1
            yield flush()

    return work


def packed(df: DataFrame, value: str) -> DataFrame:
    """id and value: bytes of a string or binary column as they are, of an array of token ids four bytes each."""
    kind = df.schema[value].dataType
    if isinstance(kind, T.ArrayType):

        @F.arrow_udf("binary")
        def pack(tokens: pa.Array) -> pa.Array:
            if tokens.values.null_count:
                raise ValueError("a token id is null")
            ids = tokens.values.to_numpy().astype("<u4")
            offsets = tokens.offsets.to_numpy().astype(np.int64) * 4
            valid = pa.array(np.packbits(tokens.is_valid().to_numpy(zero_copy_only=False), bitorder="little")).buffers()[1]
            return pa.Array.from_buffers(pa.large_binary(), len(tokens), [valid, pa.py_buffer(offsets), pa.py_buffer(ids)]).cast(pa.binary())

        return df.withColumn(value, pack(F.col(value)))
    return df.withColumn(value, F.col(value).cast("binary"))


def sections(df: DataFrame, *, key: str = "doc_id", value: str = "text", shard_bytes: int = SHARD_BYTES, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The sections of all shards, which joined in order of ``offset`` are the shard's file.

    Shards are consecutive ranges of the identifier, about ``shard_bytes`` of values each (numbers with gaps where a range is empty).  Identifiers are
    integers or what casts to them; others are an error, as are null token ids.  Rows
    with a null identifier have no key and are left out; a null value is an entry that is null, an empty one is empty.
    All rows of a repeated identifier are entries, in order of value.  Other columns aren't looked at.
    """
    named = df.select(F.col(key).cast("long").alias("id"), F.col(value).alias("v")).where("id is not null")
    size = 4 * F.size("v") if isinstance(df.schema[value].dataType, T.ArrayType) else F.octet_length("v")
    total = named.agg(F.sum(F.when(F.col("v").isNotNull(), size).cast("long"))).first()[0] or 0
    own, parts = packed(named, "v"), max(1, -(-total // shard_bytes))
    return own.repartitionByRange(parts, "id").sortWithinPartitions("id", "v").mapInArrow(sections_udf(block_bytes), SECTION)


def write(df: DataFrame, folder: str, **options) -> DataFrame:
    """Writes each shard to a file of ``folder``, which all executors share; returns shard, file, entries, first_id and last_id.

    A file gets its name when it is whole, so a task that is run again does no harm.  The shards are written when the
    result is used.
    """

    def save(shard: pa.Table) -> pa.Table:
        shard = shard.sort_by("offset")
        name = f"shard-{shard['shard'][0].as_py():06d}.sst"
        target, own = Path(folder, name), Path(folder, f".{name}.{uuid.uuid4().hex}")
        target.parent.mkdir(parents=True, exist_ok=True)
        own.write_bytes(b"".join(shard["content"].to_pylist()))
        own.replace(target)
        last = shard.num_rows - 1
        return pa.table({"shard": pa.array([shard["shard"][0].as_py()], pa.int32()), "file": [name], "entries": [shard["entries"][last].as_py()], "first_id": [shard["first_id"][last].as_py()], "last_id": [shard["last_id"][last].as_py()]})

    return sections(df, **options).groupBy("shard").applyInArrow(save, "shard int, file string, entries long, first_id long, last_id long")
