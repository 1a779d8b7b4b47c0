from collections import Counter, defaultdict

import numpy as np
import pytest

from brindle.llm import exactdedup, queries
from tests.compare import same


def test_agrees_with_sql(spark, small, duck):
    same(exactdedup.duplicates(spark.read.parquet(f"{small}/documents.parquet")), duck, queries.ORACLES["op9_exact_dedup"])


@pytest.mark.parametrize("parts", [1, 8, 9, 30, 70])
def test_any_number_of_rounds(spark, parts):
    """One, two and three rounds of merging."""
    rows = [(i, f"text {i % 211}") for i in range(1000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
    assert sorted((r.doc_id, r.kept_id) for r in exactdedup.duplicates(docs).collect()) == [(i, i % 211) for i in range(211, 1000)]
    assert sorted(r.doc_id for r in exactdedup.dedup(docs).collect()) == list(range(211))
    assert sorted(r.kept for r in exactdedup.survivors(exactdedup.digests(docs)).collect()) == list(range(211))


def test_odd_rows(spark):
    rows = [(1, None), (2, None), (3, ""), (4, ""), (None, "a"), (5, "a"), (5, "a"), (6, "A"), (7, "b"), (7, "b"), (None, "c"), (None, "c"), (8, "x" * 3_000_000), (9, "x" * 3_000_000), (10, "a ")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for name in ("digest", "size", "id", "kept", "n", "lane", "__d", "__k", "odd.name"):
        docs = docs.withColumn(name, docs.doc_id)
    got = Counter((r.doc_id, r.kept_id, r.copies) for r in exactdedup.duplicates(docs).collect())
    assert got == Counter({(4, 3, 1): 1, (None, 5, 1): 1, (5, 5, 2): 1, (7, 7, 2): 1, (None, None, 2): 1, (9, 8, 1): 1})
    kept = exactdedup.dedup(docs)
    assert kept.columns == docs.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter([1, 2, 3, 5, 6, 7, None, 8, 10])
    assert exactdedup.dedup(docs.limit(0)).count() == 0 and exactdedup.duplicates(docs.limit(0)).count() == 0


def test_dedup_equals_brute_force(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    least = defaultdict(lambda: 1 << 62)
    for r in docs.collect():
        least[r.text] = min(least[r.text], r.doc_id)
    assert sorted(r.doc_id for r in exactdedup.dedup(docs).collect()) == sorted(least.values())


def test_the_largest_identifier_is_not_null(spark):
    most = 2**63 - 1
    docs = spark.createDataFrame([(most, "a"), (None, "a"), (most, "b"), (-most - 1, "b"), (most, "c"), (None, "d"), (None, "d")], "doc_id long, text string").repartition(3)
    got = Counter((r.doc_id, r.kept_id, r.copies) for r in exactdedup.duplicates(docs).collect())
    assert got == Counter([(None, most, 1), (most, -most - 1, 1), (None, None, 2)])
    assert Counter((r.doc_id, r.text) for r in exactdedup.dedup(docs).collect()) == Counter([(most, "a"), (-most - 1, "b"), (most, "c"), (None, "d")])


def test_of_repeated_rows_the_first_by_its_columns_stays(spark):
    docs = spark.createDataFrame([(1, "a", k) for k in (7, 3, 5, None)] + [(2, "a", 1)], "doc_id long, text string, extra int")
    for parts in (1, 5):
        assert [tuple(r) for r in exactdedup.dedup(docs.repartition(parts)).collect()] == [(1, "a", 3)]


def test_merge_of_digests_that_begin_alike():
    rng = np.random.default_rng(3)
    every = np.zeros(400, exactdedup.ENTRY)
    every["digest"][:, 0], every["digest"][:, 3] = rng.integers(0, 5, 400), rng.integers(0, 7, 400)
    every["size"], every["id"], every["none"], every["n"] = rng.integers(0, 2, 400), rng.integers(-9, 99, 400), rng.integers(0, 2, 400), 1
    runs = [exactdedup.merge([x]) for x in np.split(every, 8)]
    want = defaultdict(list)
    for e in every:
        want[(*e["digest"].tolist(), int(e["size"]))].append((int(e["none"]), int(e["id"])))
    got = {(*e["digest"].tolist(), int(e["size"])): (int(e["none"]), int(e["n"]), int(e["id"])) for e in exactdedup.merge(runs)}
    assert got.keys() == want.keys()
    for k, ids in want.items():
        assert got[k][:2] == (min(n for n, _ in ids), len(ids)) and (got[k][0] or got[k][2] == min(i for n, i in ids if not n))
