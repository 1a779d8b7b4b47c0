import numpy as np
import pyarrow as pa
import pytest

from brindle.llm import quality

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def word_stats(text: str) -> dict[str, float]:
    words = text.split()
    solid = [c for c in text if not c.isspace()]
    return {
        "n_bytes": len(text.encode()),
        "n_words": len(words),
        "mean_word": len("".join(solid).encode()) / max(1, len(words)),
        "symbol_share": sum(not c.isalnum() for c in solid) / max(1, len(solid)),
        "distinct_share": len(set(words)) / max(1, len(words)),
        "echo_share": sum(a == b for a, b in zip(words, words[1:])) / max(1, len(words)),
        "words_per_line": len(words) / (text.count("\n") + 1),
    }


def test_statistics_agree_with_plain_python():
    texts = ["", "one", "A b b b! c, d\ne f", "x " * 5000, "||| --- |||", None, "tail \n\n"]
    got = quality.statistics(pa.array(texts))
    for row, text in zip(got, texts):
        for name, value in word_stats(text or "").items():
            assert row[quality.STATS.index(name)] == pytest.approx(value), (text, name)


def test_rules_are_found_and_hold_on_held_out_rows():
    rng = np.random.default_rng(3)
    x = rng.random((3000, len(quality.STATS)))
    y = ((x[:, 4] > 0.7) & (x[:, 1] > 0.4)) | (x[:, 8] > 0.9)
    rules = quality.learn(x[:2000], y[:2000])
    hit = np.zeros(1000, bool)
    for r in rules:
        hit |= r.holds(x[2000:])
    assert (hit == y[2000:]).mean() > 0.97


@pytest.mark.parametrize("y", [np.zeros(50, bool), np.ones(50, bool), np.zeros(0, bool)])
def test_nothing_is_learned_from_one_class(y):
    assert quality.learn(np.random.default_rng(0).random((len(y), len(quality.STATS))), y) == []


def test_held_out_accuracy_on_documents(spark):
    folder = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    rules = quality.fit(docs, labels.where("doc_id % 2 = 0"))
    judged = quality.judge(docs.join(labels.where("doc_id % 2 = 1"), "doc_id", "left_semi"), rules).join(labels, "doc_id").toPandas()
    bad = judged.quality == 0
    assert (~judged.keep[bad]).mean() > 0.9
    assert judged.keep[~bad].mean() > 0.99


def test_judge_equals_the_rules_row_by_row(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    rules = [quality.Rule((quality.Literal("symbol_share", True, 0.05), quality.Literal("n_words", True, 20))), quality.Rule((quality.Literal("echo_share", True, 0.2),))]
    for r in quality.judge(docs, rules).collect():
        x = np.array([[r[s] for s in quality.STATS]])
        first = next((k for k, rule in enumerate(rules, 1) if rule.holds(x)[0]), None)
        assert (r.rule, r.keep) == (first, first is None)


def test_odd_rows(spark):
    rows = [(1, None, None, None, None), (None, "fine words here", "en", None, 3), (2, "", "en", "a", 0), (2, "", "en", "a", 0), (3, "a !!! ??? ### $$$", "en", "a", 9), (4, "word " * 200_000, None, "b", 1)]
    docs = spark.createDataFrame(rows, DOCS)
    for name in ("s", "rule", "keep", "h", "quality", "__k"):
        docs = docs.withColumn(name, docs.doc_id * 0)
    rules = [quality.Rule((quality.Literal("symbol_share", True, 0.5),))]
    assert quality.judge(docs, rules).count() == 6
    kept = quality.keep(docs, rules)
    assert kept.columns == docs.columns and sorted(str(r.doc_id) for r in kept.collect()) == ["1", "2", "2", "4", "None"]
    labels = spark.createDataFrame([(1, 0), (None, 1), (2, None), (9, 0), (2, 1), (2, 0)], "doc_id long, quality int")
    assert quality.fit(docs, labels) == []
    assert quality.fit(docs.limit(0), labels.limit(0)) == []
    assert quality.judge(docs.limit(0), rules).count() == 0
