from collections import Counter

import tiktoken

import __spark_entry__
import corpus_pipeline
from brindle.llm import bpe, mixing, quality
from tests.llm.test_setjoin import brute, groups


def test_stages():
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality rules", "exact dedup", "n-gram Jaccard join", "mixing sources to target weights", "byte-level BPE"]


def test_each_stage_against_brute_force(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").cache()
    labels = spark.read.parquet(f"{small}/labels.parquet")
    stages = [f for _, f in corpus_pipeline.STAGES]
    after = stages[0](spark, docs, small).cache()
    rules = quality.fit(docs, labels)
    judged = {r.doc_id: r.keep for r in quality.judge(docs, rules).collect()}
    assert sorted(r.doc_id for r in after.collect()) == sorted(k for k, keep in judged.items() if keep)
    bad = {r.doc_id for r in labels.where("quality = 1").collect()}
    assert all(judged[k] for k in bad)
    assert after.columns == docs.columns

    distinct = stages[1](spark, after, small).cache()
    first = {}
    for r in sorted(after.collect()):
        first.setdefault(r.text, r.doc_id)
    assert sorted(r.doc_id for r in distinct.collect()) == sorted(first.values()) and distinct.columns == docs.columns

    single = stages[2](spark, distinct, small).cache()
    rows = distinct.collect()
    of = groups(brute([(r.doc_id, r.text) for r in rows]), [r.doc_id for r in rows])
    assert sorted(r.doc_id for r in single.collect()) == sorted(set(of.values())) and single.columns == docs.columns

    mixed = stages[3](spark, single, small).cache()
    told = Counter((r.doc_id, r.text) for r in mixing.mix(single).collect())
    assert Counter((r.doc_id, r.text) for r in mixed.collect()) == told and mixed.columns == docs.columns
    assert {k for k, _ in told} == {r.doc_id for r in single.collect() if r.text.strip()}

    other = tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=bpe.load(), special_tokens={})
    encoded = stages[4](spark, mixed, small).collect()
    assert Counter((r.doc_id, tuple(r.tokens)) for r in encoded) == Counter({(k, tuple(other.encode_ordinary(t))): 0 for k, t in told}) + Counter(
        x for (k, t), n in told.items() for x in [(k, tuple(other.encode_ordinary(t)))] * n
    )
    assert corpus_pipeline.run(spark, small).count() == sum(told.values())


def test_empty_documents(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").limit(0)
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, small)
        assert docs.count() == 0, k


def test_registered():
    names = set(__spark_entry__.queries())
    assert {"pipeline"} <= names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))
