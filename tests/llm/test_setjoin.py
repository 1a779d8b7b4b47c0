import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from brindle.llm import setjoin
from tests.compare import same


def grams(text, n=3):
    words = [w for w in re.split(r"[\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", (text or "").lower()) if w]
    return {tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))} if words else set()


def brute(texts, threshold=0.5):
    sets = [(k, s) for k, t in texts if (s := grams(t))]
    out = {}
    for i, (a, x) in enumerate(sets):
        for b, y in sets[i + 1 :]:
            if a != b and (j := len(x & y) / len(x | y)) >= threshold:
                pair = (min(a, b), max(a, b))
                out[pair] = max(j, out.get(pair, 0))
    return out


def got(df):
    return {(r.id_a, r.id_b): r.jaccard for r in df.collect()}


def close(a, b):
    return a.keys() == b.keys() and all(abs(a[k] - b[k]) < 1e-12 for k in a)


def linked(texts, threshold=0.5):
    """doc_id, class_id, set_id, n_same and n_links by comparing all pairs; one text a document."""
    sets = {k: s for k, t in texts if (s := grams(t))}
    pairs = brute(texts, threshold)
    of, links = groups(pairs, sets), Counter(k for pair in pairs for k in pair)
    alike = defaultdict(list)
    for k, s in sets.items():
        alike[frozenset(s)].append(k)
    return {k: (of[k], min(alike[frozenset(s)]), len(alike[frozenset(s)]) - 1, links[k]) for k, s in sets.items() if links[k]}


def rows(df):
    found = df.collect()
    out = {r.doc_id: (r.class_id, r.set_id, r.n_same, r.n_links) for r in found}
    assert len(out) == len(found)
    return out


def representatives(texts, threshold=0.5):
    first = {}
    for k, t in sorted(texts):
        first.setdefault(frozenset(grams(t)), (k, t))
    return brute(list(first.values()), threshold)


def test_given_documents(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    texts = [(r.doc_id, r.text) for r in docs.collect()]
    truth = linked(texts)
    assert truth and rows(setjoin.jaccard_join(docs)) == truth
    assert close(got(setjoin.similar_pairs(docs)), representatives(texts))


def test_sql(spark, small, duck):
    same(setjoin.jaccard_join(spark.read.parquet(f"{small}/documents.parquet")), duck, setjoin.oracle())


def edited(spark, threshold=0.5):
    rng = np.random.default_rng(7)
    rows, k = [], 0
    for size in (4, 9, 30, 120, 700):
        base = [f"w{x}" for x in rng.integers(0, 10**6, size)]
        for share in (0, 0.02, 0.05, 0.1, 0.2, 0.4):
            for cut in (1.0, 0.8, 0.55):
                words = [f"e{rng.integers(10**6)}" if rng.random() < share else w for w in base[: max(3, int(size * cut))]]
                rows.append((k, " ".join(words)))
                k += 1
    return rows, spark.createDataFrame(rows, "doc_id long, text string")


def test_edited_copies_across_bands(spark):
    texts, docs = edited(spark)
    for threshold in (0.5, 0.8):
        assert close(got(setjoin.similar_pairs(docs, threshold=threshold)), representatives(texts, threshold))
        assert rows(setjoin.jaccard_join(docs, threshold=threshold)) == linked(texts, threshold)


def crowd(spark):
    """Edited copies of two texts, among texts that share passages with them and with one another."""
    rng = np.random.default_rng(11)
    say = lambda n: [f"w{x}" for x in rng.integers(0, 10**6, n)]
    bases, out = [say(80), say(80)], []
    for k in range(200):
        words = [f"e{rng.integers(10**6)}" if rng.random() < 0.01 * (k % 12) else w for w in bases[k % 2]]
        out.append((k, " ".join(words[: 80 - 3 * (k % 7)])))
    for k in range(200, 260):
        out.append((k, " ".join(bases[k % 2][: int(rng.integers(5, 60))] + say(int(rng.integers(5, 60))))))
    return out, spark.createDataFrame(out, "doc_id long, text string")


@pytest.mark.parametrize("hot, few", [(2, 32), (16, 2), (10**6, 4)])
def test_crowds_whatever_is_hot(spark, monkeypatch, hot, few):
    for name, value in (("HOT_LEAST", hot), ("FEW", few), ("BATCH", 4000), ("BLOCK", 256 * 40)):
        monkeypatch.setattr(setjoin, name, value)
    texts, docs = crowd(spark)
    assert rows(setjoin.jaccard_join(docs.repartition(3))) == linked(texts)


def test_table_of_hot_grams_is_bounded(spark, monkeypatch):
    monkeypatch.setattr(setjoin, "HOT_LEAST", 2)
    monkeypatch.setattr(setjoin, "HOT_MOST", 7)
    texts, docs = crowd(spark)
    assert len(setjoin.hot_table(setjoin.signatures(docs, 3))["gram"]) == 7
    assert close(got(setjoin.similar_pairs(docs)), representatives(texts))


def test_packed_runs():
    rng = np.random.default_rng(2)
    for n, high in ((1, 1 << 48), (2, 1 << 48), (5000, 1 << 48), (5000, 300)):
        grams_, at = np.sort(rng.integers(0, high, n).astype(np.uint64)), rng.integers(0, 900, n)
        sets = rng.integers(0, 1 << 62, 900).astype(np.uint64)
        back, owner = setjoin.grams_unpacked(setjoin.grams_packed(grams_, at, sets))
        assert (back == grams_).all() and (owner == sets[at]).all()


def test_pairs_are_met_in_the_tile_of_their_least_key():
    keys = [[1, 5, 9], [5, 9], [-3, 9], [9], [1, 9]]
    offsets = np.cumsum([0] + [len(k) for k in keys])
    x, y = np.triu_indices(len(keys), 1)
    for key in (1, 5, 9):
        mine = [(i, j) for i, j in zip(x, y) if key in keys[i] and key in keys[j]]
        a, b = (np.array([p[k] for p in mine]) for k in range(2))
        want = [min(set(keys[i]) & set(keys[j])) == key for i, j in mine]
        assert not mine or setjoin.unmet(a, b, offsets, np.concatenate(keys), key).tolist() == want


def groups(pairs, ids):
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {i: find(i) for i in ids}


def test_dedup_keeps_one_of_each_group(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    ids = [r.doc_id for r in docs.collect()]
    of = groups(brute([(r.doc_id, r.text) for r in docs.collect()]), ids)
    assert sorted(r.doc_id for r in setjoin.dedup(docs).collect()) == sorted(set(of.values()))


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (7, 7)], "u long, v long")
    found = {r.node: r.root for r in setjoin.components(edges).collect()}
    assert found == {**{i: 0 for i in range(1, 61)}, 101: 100}


def test_odd_rows(spark):
    t = "one two three four five six seven"
    given = [(1, None), (2, ""), (3, "!!! ..."), (None, t), (4, t), (4, t), (5, t.upper() + "!"), (6, t + " eight"), (7, "x"), (8, "x"), (9, "w " * 60_000), (10, "w " * 60_000)]
    docs = spark.createDataFrame(given, "doc_id long, text string")
    for name in ("id", "s", "f0", "size", "band", "bucket", "key"):
        docs = docs.withColumn(name, docs.doc_id)
    assert rows(setjoin.jaccard_join(docs)) == {4: (4, 4, 1, 2), 5: (4, 4, 1, 2), 6: (4, 6, 0, 2), 7: (7, 7, 1, 1), 8: (7, 7, 1, 1), 9: (9, 9, 1, 1), 10: (9, 9, 1, 1)}
    found = got(setjoin.similar_pairs(docs))
    assert found.keys() == {(4, 6)} and abs(found[(4, 6)] - 5 / 6) < 1e-12
    kept = setjoin.dedup(docs)
    assert kept.columns == docs.columns and sorted(str(r.doc_id) for r in kept.collect()) == sorted(["1", "2", "3", "None", "4", "4", "7", "9"])
    assert setjoin.jaccard_join(docs.limit(0)).count() == 0 and setjoin.dedup(docs.limit(0)).count() == 0
