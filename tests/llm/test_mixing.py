import hashlib
import time
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from brindle.llm import bpe, common, mixing, queries
from tests.compare import same


def test_agrees_with_sql(spark, small, duck):
    same(mixing.mix(spark.read.parquet(f"{small}/documents.parquet")), duck, mixing.oracle())


def cut_by_hand(rows, block):
    """Of documents (doc_id, source, tokens): source, block, at, doc_id, first token and piece of all pieces, each source's documents in the order of their MD5."""
    out, upto = set(), Counter()
    for k, source, tokens in sorted(rows, key=lambda r: (hashlib.md5(f"0/{r[0]}".encode()).hexdigest(), r[2])):
        for i, t in enumerate(tokens):
            b, at = divmod(upto[source], block)
            upto[source] += 1
            if i == 0 or at == 0:
                out.add((source, b, at, k, i))
    return out, upto


def test_registered_query_against_brute_force(spark, small):
    """Every token of the first epochs is where counting by hand puts it; slots follow the points of the golden ratio."""
    docs = spark.read.parquet(f"{small}/documents.parquet").collect()
    codec = bpe.Codec(bpe.load())
    rows = [(r.doc_id, r.source, codec.encode(r.text)) for r in docs]
    want, totals = cut_by_hand(rows, 2048)
    got = queries.op4_source_mixing(spark, small).collect()
    assert {(r.source, r.block, r.at, r.doc_id, r.first_token) for r in got if r.epoch == 0} == want
    tokens = {k: t for k, _, t in rows}
    assert all(r.tokens == tokens[r.doc_id][r.first_token : r.first_token + r.n_tokens] for r in got)
    assert {s: sum(r.n_tokens for r in got if r.source == s and r.epoch == 0) for s in totals} == dict(totals)
    plan = mixing.schedule_plan([("=" + s, n) for s, n in totals.items()], 2048, None, 0.8, None)
    ranks = Counter()
    slots = {}
    for t in range(plan.slots):
        point = ((t + 1) * mixing._GOLDEN) % 1
        key, blocks = next((k, b) for k, _, b, end in plan.sources if point < end or k == plan.sources[-1][0])
        slots[t] = (key[1:], ranks[key] % blocks, ranks[key] // blocks)
        ranks[key] += 1
    assert {r.slot: (r.source, r.block, r.epoch) for r in got} == slots


def test_long_texts_are_cut_in_linear_time():
    took = []
    for n in (200_000, 1_600_000):
        text, lead = pa.array(["word " * n]), pa.array([5])
        began = time.process_time()
        pieces = mixing.cut_udf(mixing.T.StringType(), 256).func(text, lead)
        took.append(time.process_time() - began)
        assert len(pieces) == 1 and len(pieces[0]) == (n + 5 - 1) // 256 + 1 and len(pieces[0][0].as_py()) == 5 * 251
    assert took[1] < 40 * max(took[0], 0.01)


def test_schedule_is_even_everywhere(spark):
    plan = mixing.Plan((("=a", 100, 10, 0.5), ("=b", 100, 10, 0.8), ("=c", 100, 10, 1.0)), 30_000, 10)
    rows = mixing.schedule(spark, plan).orderBy("slot").collect()
    assert [r.slot for r in rows] == list(range(30_000))
    seen, own = Counter(), defaultdict(int)
    for r in rows:
        assert (r["rank"], r.block, r.epoch) == (own[r.key], own[r.key] % 10, own[r.key] // 10)
        own[r.key] += 1
        seen[r.key] += 1
        for key, w in (("=a", 0.5), ("=b", 0.3), ("=c", 0.2)):
            assert abs(seen[key] - w * (r.slot + 1)) < 20


def test_pieces_of_the_first_epoch_join_to_the_texts(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    whole = defaultdict(list)
    for r in mixing.mix(docs, block=100).where("epoch = 0").collect():
        whole[r.doc_id].append((r.block, r.at, r.text, r.n_tokens))
    for r in docs.collect():
        if r.text.strip():
            assert "".join(t for _, _, t, _ in sorted(whole[r.doc_id])) == r.text
        assert sum(n for *_, n in whole[r.doc_id]) == len(r.text.split())


def test_blocks_are_full_and_weights_are_met(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    words = Counter()
    for r in docs.collect():
        words[r.source] += len(r.text.split())
    a, b = sorted(words, key=words.get)[-2:]
    rows = mixing.mix(docs, weights={a: 3.0, b: 1.0}, block=50, slots=4000).collect()
    size, source = Counter(), {}
    for r in rows:
        size[r.slot] += r.n_tokens
        source[r.slot] = r.source
    assert set(source.values()) == {a, b} and len(source) == 4000
    assert abs(Counter(source.values())[a] - 3000) < 20
    assert sum(n == 50 for n in size.values()) > 0.9 * len(size) and max(size.values()) == 50


@pytest.mark.parametrize("weights", [{"a": -1.0}, {"a": float("nan")}])
def test_weights_must_be_numbers(spark, weights):
    docs = spark.createDataFrame([(1, "x", "a")], "doc_id long, text string, source string")
    with pytest.raises(ValueError):
        mixing.mix(docs, weights=weights)


def test_odd_rows(spark):
    rows = [(1, None, "a"), (2, "", "a"), (3, "  \n ", None), (4, " one two ", None), (4, " one two ", None), (None, "x y z", "b"), (5, "w " * 50_000, "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for name in ("slot", "__key", "__n", "key", "times", "odd.name"):
        docs = docs.withColumn(name, docs.doc_id)
    out = mixing.mix(docs, block=1000).where("epoch = 0").collect()
    got = Counter((r.doc_id, r.n_tokens) for r in out)
    assert got[(4, 2)] == 2 and got[(None, 3)] == 1 and got[(5, 1000)] == 50
    assert out[0]["odd.name"] == out[0].doc_id and out[0]["__key"] == out[0].doc_id
    assert mixing.mixed_documents(docs, block=1000).columns == docs.columns
    assert mixing.mix(docs.limit(0)).count() == 0
    assert mixing.mix(docs.where("doc_id < 3")).count() == 0


def test_batches_are_bounded_by_bytes(spark):
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    was = spark.conf.get(name)
    try:
        spark.conf.set(name, "64m")
        docs = spark.createDataFrame([(1, list(range(5000)), "a")], "doc_id long, tokens array<int>, source string")
        rows = mixing.mix(docs, content="tokens").where("epoch = 0").collect()
        assert int(spark.conf.get(name).removesuffix("b")) == common.BATCH_BYTES
        assert [t for r in sorted(rows, key=lambda r: r.block) for t in r.tokens] == list(range(5000))
    finally:
        spark.conf.set(name, was)


@pytest.mark.parametrize("kind", [">u2", ">u4"])
def test_packed_ids_mix_as_arrays_do(spark, kind):
    """Null and empty contents, null and repeated ids, ties by content, ids beyond 15 bits; arrays come out."""
    rows = [(1, [7] * 25, "a"), (2, [], "a"), (3, None, None), (4, [50_000, 1], None), (4, [255, 256], None), (4, [256], None), (4, [255], None), (None, list(range(40_000, 40_033)), "a"), (4, [255], None)]
    arrays = spark.createDataFrame(rows, "doc_id long, tokens array<int>, source string")
    pack = [(k, None if t is None else np.array(t, kind).tobytes(), s) for k, t, s in rows]
    packed = spark.createDataFrame(pack, "doc_id long, tokens binary, source string")
    want, got = mixing.mix(arrays, content="tokens", block=10), mixing.mix(packed, content="tokens", block=10, ids=kind)
    assert got.dtypes == want.dtypes
    assert Counter(map(str, got.collect())) == Counter(map(str, want.collect())) and got.count() > 10


def test_documents_are_cut_once(spark):
    docs = spark.createDataFrame([(1, "x y z", "a")], "doc_id long, text string, source string")
    plan = mixing.mix(docs, block=2)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython [cut(") == 1


def test_registered_query_keeps_packed_ids(spark, small, monkeypatch):
    """Between encoding and cutting a token id takes two bytes; the result has arrays."""
    kept = []
    monkeypatch.setattr(queries, "written", lambda df, what: kept.append(common.written(df, what)) or kept[-1])
    assert dict(queries.op4_source_mixing(spark, small).dtypes)["tokens"] == "array<int>"
    codec = bpe.Codec(bpe.load())
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{small}/documents.parquet").limit(20).collect()}
    for r in kept[0].where(kept[0].doc_id.isin(list(texts))).collect():
        assert np.frombuffer(r.tokens, ">u2").tolist() == codec.encode(texts[r.doc_id])
