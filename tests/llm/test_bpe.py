import numpy as np
import pyarrow as pa
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from brindle.llm import bpe, common

PATHS = ["/opt/tokenizers/byte_bpe_50k.tiktoken", "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"]


@pytest.fixture(scope="module", params=PATHS)
def pair(request):
    ranks = bpe.load(request.param)
    return bpe.Codec(ranks), tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_perfect_hash_is_minimal_and_exact():
    ranks = bpe.load(PATHS[0])
    table = bpe.PerfectHash(ranks)
    assert sorted(table.ids) == list(range(len(ranks)))
    assert all(table.get(t) == r for t, r in ranks.items())
    assert all(table.get(t + b"\x00zz") == ranks.get(t + b"\x00zz", -1) for t in list(ranks)[:2000])


def rows_of(codec, texts):
    """The batch path's ids of each text, and how many texts came through it."""
    values, counts, exact = codec.encode_rows(pa.array(texts, pa.string()))
    assert exact.all()
    ends = np.cumsum(counts)
    return [values[e - n : e].tolist() for e, n in zip(ends, counts)]


#: Characters at which pre-tokens are cut, among any others.
MIXED = st.text(st.one_of(st.sampled_from("''  \n\t\xa0\u3000\x1c\x85stmdrevlSé1²日!"), st.characters(codec="utf-8")), max_size=40)


@settings(deadline=None, max_examples=400)
@given(st.lists(MIXED, max_size=8))
def test_any_texts_as_the_public_library_does(texts):
    codec, other = test_any_texts_as_the_public_library_does.pair
    want = [other.encode_ordinary(t) for t in texts]
    assert rows_of(codec, texts) == want and [codec.encode(t) for t in texts] == want
    assert [codec.decode(ids) for ids in want] == texts


@settings(deadline=None, max_examples=400)
@given(st.lists(MIXED, max_size=8))
def test_boundaries_as_the_pattern_has_them(texts):
    raw = [t.encode() for t in texts]
    row_byte = np.cumsum([0] + [len(r) for r in raw])
    data = np.frombuffer(b"".join(raw), np.uint8)
    want = [at + sum(len(p.encode()) for p in cut[:k]) for at, t in zip(row_byte, texts) for cut in [bpe.pretokens(t)] for k in range(len(cut))]
    assert not len(data) or bpe.boundaries(data, row_byte).tolist() == want


_ranks = bpe.load(PATHS[0])
test_any_texts_as_the_public_library_does.pair = (bpe.Codec(_ranks), tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=_ranks, special_tokens={}))


@pytest.mark.parametrize("text", ["", " ", "   \n\n x", "a" * 5000, "don't  we'll", "x\x1c\x1d\x1e\x1fy\x85z", "1²½Ⅻ٣", "naïve ÀÖØ÷× ʼn ɏ ɐ", "日本語テキスト", "👩‍👩‍👧", "<|endoftext|>", "    a", "ǅ ǈ ª º µ"])
def test_hard_texts(pair, text):
    codec, other = pair
    assert codec.encode(text) == other.encode_ordinary(text) and rows_of(codec, [text, "x", text]) == [other.encode_ordinary(t) for t in (text, "x", text)]


def test_documents(spark, small, pair):
    _, other = pair
    path = next(p for p in PATHS if bpe.load(p) == pair[0].ranks)
    docs = spark.read.parquet(f"{small}/documents.parquet")
    text = {r.doc_id: r.text for r in docs.collect()}
    for r in bpe.decode(bpe.encode(docs, vocabulary=path), vocabulary=path).collect():
        assert r.tokens == other.encode_ordinary(text[r.doc_id]) and r.n_tokens == len(r.tokens) and r.exact and r.text == text[r.doc_id]


def test_memory_of_a_worker_is_bounded(monkeypatch):
    monkeypatch.setattr(bpe, "SLOT_BITS", 4)
    monkeypatch.setattr(bpe, "POOL", 100)
    codec = bpe.Codec(_ranks, bpe.PerfectHash(_ranks))
    texts = [" ".join(f"q{i}z" for i in range(k, k + 30)) for k in range(0, 300, 20)] * 2
    for _ in range(2):
        assert [codec.decode(ids) for ids in rows_of(codec, texts)] == texts
        for t in texts:
            assert rows_of(codec, [t]) == [codec.encode(t)]
    assert len(codec.hashes) == 16 and len(codec.pool) == 100 and codec.filled <= 100


def test_pre_tokens_of_one_hash_do_no_harm(monkeypatch):
    codec = bpe.Codec(_ranks, bpe.PerfectHash(_ranks))
    monkeypatch.setattr(bpe.textbuf, "slices", lambda pre, start, end, base: np.full(len(start), 77, np.uint64))
    texts = ["two words", "", None, "naïve"]
    assert rows_of(codec, texts) == [codec.encode(t or "") for t in texts]


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (None, "a"), (3, "a b"), (3, "a b"), (4, "long text " * 100_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for name in ("e", "tokens", "exact", "n_tokens"):
        docs = docs.withColumn(name, docs.doc_id)
    got = bpe.encode(docs).collect()
    assert [(r.doc_id, r.n_tokens, r.exact) for r in got[:5]] == [(1, None, None), (2, 0, True), (None, 1, True), (3, 2, True), (3, 2, True)]
    assert np.unique(got[5].tokens).size < 6 and got[5].exact
    back = bpe.decode(spark.createDataFrame(got, "doc_id long, tokens array<int>, n_tokens int, exact boolean")).collect()
    assert [r.text for r in back[:4]] == [None, "", "a", "a b"]
    assert bpe.encode(docs.limit(0)).count() == 0


def test_vocabularies_must_be_whole(tmp_path):
    (tmp_path / "v").write_text("YQ== 0\n")
    with pytest.raises(ValueError):
        bpe.load(str(tmp_path / "v"))


@settings(deadline=None, max_examples=200)
@given(st.lists(st.binary(min_size=1, max_size=40) | st.text("abehlnorst ", min_size=1, max_size=90).map(str.encode), min_size=1, max_size=12))
def test_pre_tokens_resolved_together_are_as_one_by_one(words):
    codec, _ = test_any_texts_as_the_public_library_does.pair
    data, end = np.frombuffer(b"".join(words), np.uint8), np.cumsum([len(w) for w in words])
    start = end - [len(w) for w in words]
    for many, one in ((codec.merge_many, lambda w: bpe.merge(w, _ranks)), (codec.resolve_many, codec.resolve)):
        ids, n = many(data, start, end)
        assert [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] == [one(w) for w in words]
    assert codec.whole_many(data, start, end).tolist() == [_ranks.get(w, -1) for w in words]


def test_what_a_worker_remembers_is_small():
    codec, _ = test_any_texts_as_the_public_library_does.pair
    assert sum(x.nbytes for x in (codec.hashes, codec.at, codec.n, codec.pool)) <= 16 << 20


@pytest.mark.parametrize("before, after", [("64m", common.BATCH_BYTES), ("1000000", 1_000_000)])
def test_batches_are_small(spark, before, after):
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    was = spark.conf.get(name)
    try:
        spark.conf.set(name, before)
        common.small_batches(spark)
        assert int(spark.conf.get(name).removesuffix("b")) == after
        sizes = bpe.F.arrow_udf("long")(_batch_bytes)
        texts = spark.range(0, 3000, 1, 1).select(bpe.F.repeat(bpe.F.lit("x"), 10_000).alias("text"))
        assert max(r.n for r in texts.select(sizes("text").alias("n")).collect()) <= after + 10_000  # a row more
    finally:
        spark.conf.set(name, was)


def _batch_bytes(text: pa.Array) -> pa.Array:
    return pa.array([sum(map(len, text.to_pylist()))] * len(text))
