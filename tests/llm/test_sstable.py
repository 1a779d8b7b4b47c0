from pathlib import Path

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from brindle.llm import bpe, queries, sstable


def build(rows, block_bytes=64):
    b, parts = sstable.Builder(block_bytes), []
    for key, value in rows:
        if (done := b.add(sstable.key_bytes(key), value)) is not None:
            parts.append(done)
    parts += list(b.finish())
    return b"".join(p[-1] for p in parts)


@settings(deadline=None, max_examples=60)
@given(st.lists(st.tuples(st.integers(-(2**63), 2**63 - 1), st.none() | st.binary(max_size=90)), min_size=1, max_size=80))
def test_every_entry_is_found_and_nothing_else(rows):
    rows.sort(key=lambda r: (r[0], r[1] is not None, r[1]))
    shard = sstable.Shard(build(rows))
    assert list(shard) == rows
    for key in {k for k, _ in rows}:
        assert shard.get(key) == [v for k, v in rows if k == key]
    there = {k for k, _ in rows}
    for key in range(-20, 20):
        if key not in there:
            assert shard.get(key) == []


def test_damage_is_noticed():
    raw = bytearray(build([(i, b"v" * 30) for i in range(50)]))
    raw[5] ^= 1
    with pytest.raises(ValueError, match="damaged"):
        list(sstable.Shard(bytes(raw)))


def test_bloom_filter_turns_most_away():
    shard = sstable.Shard(build([(i * 2, b"x") for i in range(5000)], 4096))
    assert sum(shard.may_have(i * 2 + 1) for i in range(5000)) < 200


def test_files_hold_all_documents(spark, small, tmp_path):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    done = sstable.write(docs, str(tmp_path), shard_bytes=200_000, block_bytes=2000).collect()
    assert len(done) > 2 and sum(r.entries for r in done) == docs.count()
    shards = [(r.first_id, r.last_id, sstable.Shard(path=str(Path(tmp_path, r.file)))) for r in done]
    for r in docs.collect():
        inside = [s for low, high, s in shards if low <= r.doc_id <= high]
        assert len(inside) == 1 and inside[0].get(r.doc_id) == [r.text.encode()]
        assert all(r.doc_id not in dict(s) for _, _, s in shards if s is not inside[0])


def test_token_ids_and_odd_rows(spark):
    rows = [(1, [5, 70000]), (2, []), (3, None), (None, [1]), (1, [5, 70000]), (-4, [9])]
    df = spark.createDataFrame(rows, "doc_id long, tokens array<int>").withColumnsRenamed({})
    for name in ("id", "v", "shard", "content"):
        df = df.withColumn(name, df.doc_id)
    raw = {}
    for r in sstable.sections(df, value="tokens").orderBy("shard", "offset").collect():
        raw[r.shard] = raw.get(r.shard, b"") + bytes(r.content)
    got = [x for k in sorted(raw) for x in sstable.Shard(raw[k])]
    two = (5).to_bytes(4, "little") + (70000).to_bytes(4, "little")
    assert got == [(-4, (9).to_bytes(4, "little")), (1, two), (1, two), (2, b""), (3, None)]
    assert sstable.sections(df.limit(0), value="tokens").count() == 0


def test_the_query_stores_token_ids(spark, small):
    shards = {}
    for r in queries.op3_sorted_string_tables(spark, small).orderBy("shard", "offset").collect():
        shards[r.shard] = shards.get(r.shard, b"") + bytes(r.content)
    got = [(k, None if v is None else np.frombuffer(v, "<u4").tolist()) for raw in shards.values() for k, v in sstable.Shard(raw)]
    want = [(r.doc_id, r.tokens) for r in bpe.encode(spark.read.parquet(f"{small}/documents.parquet")).collect() if r.doc_id is not None]
    assert sorted(got, key=repr) == sorted(want, key=repr)
