from collections import defaultdict
from functools import lru_cache

import numpy as np
import pytest

from brindle.llm import substrings

N = substrings.WINDOW + substrings.PERIOD - 1


def check(rows, texts) -> set:
    """Every word of a row's span lies in a window that the other text has too; returns the covered words."""
    words = {k: t.split() for k, t in texts.items()}
    windows = lru_cache(None)(lambda k: {tuple(words[k][i : i + substrings.WINDOW]) for i in range(len(words[k]) - substrings.WINDOW + 1)})
    covered = set()
    for r in rows:
        a, end = words[r.doc_id], r.start_word + r.n_words
        assert r.n_words >= substrings.WINDOW and end <= len(a)
        if r.doc_id != r.other_id or r.start_word != r.other_start:
            covered |= {(r.doc_id, i) for i in range(r.start_word, r.start_word + r.n_words)}
        shared = [i for i in range(r.start_word, end - substrings.WINDOW + 1) if tuple(a[i : i + substrings.WINDOW]) in windows(r.other_id)]
        assert shared and shared[0] == r.start_word and shared[-1] == end - substrings.WINDOW
        assert all(y - x <= substrings.WINDOW for x, y in zip(shared, shared[1:]))
    return covered


def brute(texts) -> dict[tuple, list]:
    places = defaultdict(list)
    for k, t in texts.items():
        w = t.split()
        for i in range(len(w) - N + 1):
            places[tuple(w[i : i + N])].append((k, i))
    return {g: p for g, p in places.items() if len(p) > 1}


def test_the_cover_has_all_differences():
    assert {(a - b) % substrings.PERIOD for a in substrings.COVER for b in substrings.COVER} == set(range(substrings.PERIOD))


def test_all_long_repeats_are_found(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    covered = check(substrings.repeats(docs).collect(), texts)
    shared = brute(texts)
    assert shared
    for places in shared.values():
        outside = [p for p in places if not all((p[0], p[1] + i) in covered for i in range(N))]
        # the first place of a passage isn't listed; in a run of one word its repeats begin at the next positions of the cover
        assert len({k for k, _ in outside}) <= 1 and (not outside or max(i for _, i in outside) - min(i for _, i in outside) < substrings.PERIOD), outside


@pytest.mark.parametrize("offset", range(13))
def test_each_offset_of_a_passage(offset):
    rng = np.random.default_rng(offset)
    passage = rng.integers(0, 1 << 40, N)
    a = np.concatenate([rng.integers(0, 1 << 40, 7), passage, rng.integers(0, 1 << 40, 30)])
    b = np.concatenate([rng.integers(0, 1 << 40, 40 + offset), passage])
    cover = lambda x: {tuple(x[i : i + substrings.WINDOW]): i for i in range(len(x) - substrings.WINDOW + 1) if i % substrings.PERIOD in substrings.COVER}
    x, y = cover(a), cover(b)
    common = sorted(set(x) & set(y))
    assert common
    found = substrings.matches(a, b, np.array([x[c] for c in common]), np.array([y[c] for c in common]), substrings.WINDOW)
    assert found == [(7, N, 40 + offset)]


def test_odd_rows(spark):
    rng = np.random.default_rng(1)
    say = lambda n: " ".join(f"w{x}" for x in rng.integers(0, 10**9, n))
    p = say(60)
    rows = [(1, None), (2, ""), (None, p), (3, say(5) + " " + p), (4, p + "\n" + say(9)), (4, p + "\n" + say(9)), (5, p + " " + say(40) + " " + p), (6, "same " * 30_000), (7, say(49))]
    rows[5] = rows[4]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for name in ("key", "h", "place", "bucket", "first", "at"):
        docs = docs.withColumn(name, docs.doc_id)
    got = substrings.repeats(docs).collect()
    pairs = {frozenset((r.doc_id, r.other_id)) for r in got}
    assert {3, 4, 5} == {x for pair in pairs for x in pair} - {6}
    assert frozenset((6,)) in pairs and not any(r.doc_id in (1, 2, 7) for r in got)
    listed = {(r.doc_id, r.start_word) for r in got if r.doc_id != 6}
    assert len(listed) == 3 and all(r.n_words >= 60 for r in got if r.doc_id != 6)  # four places, the first of which isn't listed
    assert substrings.repeats(docs.limit(0)).count() == 0


def test_others_that_share_only_part_of_a_passage(spark):
    """Each 50 words of several places lie within one row, but at one place, whoever is first of the smaller windows in them."""
    rng = np.random.default_rng(3)
    say = lambda n: [f"w{x}" for x in rng.integers(0, 10**9, n)]
    texts = {}
    for case in range(120):
        p = say(int(rng.integers(50, 70)))
        for k in range(2 + case % 2):
            texts[len(texts)] = say(int(rng.integers(0, 30))) + p + say(int(rng.integers(0, 30)))
        for _ in range(case % 5):
            cut = int(rng.integers(0, 12))
            texts[len(texts)] = say(int(rng.integers(0, 30))) + p[cut : cut + int(rng.integers(38, len(p)))] + say(int(rng.integers(0, 30)))
    texts = {k: " ".join(t) for k, t in texts.items()}
    rows = substrings.repeats(spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)).collect()
    check(rows, texts)
    for places in brute(texts).values():
        outside = [(k, i) for k, i in places if not any(r.doc_id == k and r.start_word <= i and i + N <= r.start_word + r.n_words for r in rows)]
        assert len(outside) <= 1, outside


def test_links_do_not_depend_on_batches():
    rng = np.random.default_rng(4)
    h = np.sort(rng.integers(0, 30, 500))
    place, around = np.arange(500) << substrings.PLACE_BITS, rng.integers(0, 3, 500)
    got = []
    for step in (1, 2, 3, 7, 500):
        batches = [substrings.pa.RecordBatch.from_arrays([substrings.pa.array(x[s : s + step]) for x in (h, place, around)], names=["h", "place", "around"]) for s in range(0, 500, step)]
        got.append(sorted(tuple(r.values()) for b in substrings.links(iter(batches)) for r in b.to_pylist()))
    assert got[0] and all(g == got[0] for g in got) and len(set(got[0])) == len(got[0])
