import numpy as np
import pytest

from brindle.plans import registry
from tests.compare import same

@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_its_sql(spark, small, duck, name):
    same(registry.QUERIES[name](spark, small), duck, registry.ORACLES[name])


def test_queries_without_sql_have_tests_of_their_own():
    assert set(registry.QUERIES) - set(registry.ORACLES) == {"fork_assign", "pred_deepen", "pred_train_sequence", "recall_evidence", "similar_all"}  # the last test here, and test_brute.py


def test_flagship(spark, small):
    assert registry.flagship(spark, small).count() > 0


def test_contexts_of_all_embeddings_are_deepened(spark, small):
    rows = {}
    for r in spark.read.parquet(f"{small}/embeddings.parquet").orderBy("vec_id").collect():
        rows.setdefault(r.label, []).append(r.embedding)
    got = registry.QUERIES["pred_deepen"](spark, small).collect()
    assert len(got) == len(rows)
    for r in got:
        m = np.array(rows[r.label], np.float64)
        mean, variance, square = m.mean(0), m.var(0), np.sqrt((m**2).mean(0))
        order = np.argsort(-np.abs(m).mean(1), kind="stable")
        k = min(3, max(1, len(m) // 2))
        contrast = np.tanh(m[order[:k]].mean(0) - m[order[-k:]].mean(0))
        interaction = np.tanh(mean * contrast)
        scale = np.tanh(np.abs(variance).mean() * np.log1p(len(m)))
        assert len(m) > 3 and m.shape[1] == 64 and r.rows == len(m) + 6
        np.testing.assert_allclose(r.context, np.vstack([m, scale * np.array([mean, variance, square, contrast, interaction, np.tanh(mean + variance + interaction)])]), atol=2e-6)
