"""Prediction tables: candidates of a key with scores and context weights, their softmax, merging, inheritance and training.

``pred``: key, value, score double, weights array<struct<depth int, vector array<double>, bias double>>.  Scores are logits.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.vectors import dot, norm1, sigmoid

WEIGHTS = "array<struct<depth:int,vector:array<double>,bias:double>>"
PURGE, HINT, BLEND, MOST_SCORE, NEW_SCORE = 1e-4, 32, 0.35, 24.0, 0.05


def clamp_score(c: Column) -> Column:
    return F.least(F.greatest(c, F.lit(-MOST_SCORE)), F.lit(MOST_SCORE))


def upsert(pred: DataFrame, log: DataFrame) -> DataFrame:
    """Entries after writes (key, value, score, weights, seq): the last counts, its score from 0 to 1; weights not given stay."""
    last = log.groupBy("key", "value").agg(
        F.max_by(F.least(F.greatest("score", F.lit(0.0)), F.lit(1.0)), "seq").alias("n_score"), F.max_by("weights", F.when(F.col("weights").isNotNull(), F.col("seq"))).alias("n_weights")
    )
    both = pred.join(last, ["key", "value"], "full_outer")
    return both.select("key", "value", F.coalesce("n_score", "score").alias("score"), F.coalesce("n_weights", "weights", F.array().cast(WEIGHTS)).alias("weights"))


def matrix(rows: Sequence[Sequence[float]]) -> Column:
    """A literal context matrix."""
    return F.array(*[F.array(*[F.lit(float(x)) for x in row]).cast("array<double>") for row in rows]).cast("array<array<double>>")


def context_term(weights: Column, context: Column) -> Column:
    """Sum over the depths that the context has: inner product plus bias."""
    n = F.size(context)
    return F.aggregate(
        F.filter(F.coalesce(weights, F.array().cast(WEIGHTS)), lambda w: w["depth"] < n), F.lit(0.0),
        lambda s, w: s + dot(w["vector"], F.element_at(context, w["depth"] + 1)) + w["bias"],
    )


def softmax(pred: DataFrame, *, context: Sequence[Sequence[float]] | None = None, context_column: str | None = None) -> DataFrame:
    """Probability of every value of every key.  The same shift of all logits changes nothing, so windows take no part.

    ``context`` is one matrix for all keys, deepened; ``context_column`` names a column with each row's own, as it is.
    """
    logit = F.col("score")
    if context is not None:
        logit = logit + context_term(F.col("weights"), matrix(deepen(context)))
    elif context_column is not None:
        logit = logit + context_term(F.col("weights"), F.col(context_column))
    w = Window.partitionBy("key")
    rows = pred.select("key", "value", logit.alias("logit"))
    rows = rows.withColumn("e", F.exp(F.col("logit") - F.max("logit").over(w)))
    return rows.select("key", "value", (F.col("e") / F.sum("e").over(w)).alias("probability"))


def ranked(probabilities: DataFrame) -> DataFrame:
    """With each key's values numbered from the likeliest; ties by value."""
    return probabilities.withColumn("rank", F.row_number().over(Window.partitionBy("key").orderBy(F.desc("probability"), "value")))


def merged(probabilities: DataFrame, mode: str = "avg", *, by: Sequence[str] = ()) -> DataFrame:
    """Softmaxed sets of several keys as one by value: the mean over the sets that have it, the sum or the greatest, from 0 to 1."""
    how = {"avg": F.avg, "sum": F.sum, "max": F.max}[mode]
    return probabilities.groupBy(*by, "value").agg(F.least(F.greatest(how("probability"), F.lit(0.0)), F.lit(1.0)).alias("probability"))


def window_mean(windows: DataFrame, by: Sequence[str]) -> DataFrame:
    """Element-wise mean of vectors (column vector) of a group, cut to the shortest: (…, position, mean)."""
    short = Window.partitionBy(*by)
    rows = windows.withColumn("__n", F.min(F.size("vector")).over(short)).select(*by, F.posexplode(F.slice("vector", 1, F.greatest(F.col("__n"), F.lit(0)))).alias("position", "x"))
    return rows.groupBy(*by, "position").agg(F.avg("x").alias("mean"))


# Deepening a context.


def _mean(rows: list[list[float]], n: int) -> list[float]:
    return [math.fsum(r[i] for r in rows if i < len(r)) / len(rows) for i in range(n)]


def deepen(context: Sequence[Sequence[float]]) -> list[list[float]]:
    """The matrix with six derived layers (mean, variance, root mean square, contrast, interaction, blend), scaled by how much its rows vary.

    Less than two rows that aren't empty, or rows without variance: unchanged.  Short rows count as zeros in mean and square, and only as
    far as they go in the variance; contrast is between the up to 3 rows of most and of least energy, the first of equals being the greater.
    """
    context = [[float(x) for x in row] for row in context]
    rows = [r for r in context if r]
    if len(rows) < 2:
        return context
    n = max(map(len, rows))
    mean = _mean(rows, n)
    variance = [sum((r[i] - mean[i]) ** 2 for r in rows if i < len(r)) / len(rows) for i in range(n)]
    square = [math.sqrt(sum(r[i] ** 2 for r in rows if i < len(r)) / len(rows)) for i in range(n)]
    k = min(3, max(1, len(rows) // 2))
    order = sorted(range(len(rows)), key=lambda i: (-sum(map(abs, rows[i])) / len(rows[i]), i))
    top, bottom = _mean([rows[i] for i in order[:k]], n), _mean([rows[i] for i in order[::-1][:k]], n)
    contrast = [math.tanh(a - b) for a, b in zip(top, bottom)]
    interaction = [math.tanh(a * b) for a, b in zip(mean, contrast)]
    blend = [math.tanh(a + b + c) for a, b, c in zip(mean, variance, interaction)]
    scale = min(math.tanh(sum(map(abs, variance)) / n * math.log1p(len(rows))), 1.0)
    if scale <= 0:
        return context
    return context + [[scale * x for x in layer] for layer in (mean, variance, square, contrast, interaction, blend)]


@F.pandas_udf(T.ArrayType(T.ArrayType(T.DoubleType())))
def deepened(context: pd.Series) -> pd.Series:
    """``deepen`` of every row's own matrix; null of null."""
    return context.map(lambda m: None if m is None else deepen([list(r) for r in m]))


# Training.


def weigh_context(context: Sequence[Sequence[float]], weights: Sequence[float] | None) -> list[list[float]]:
    """Rows times their weights, which are taken from 0 to 2."""
    if weights is None:
        return [list(map(float, r)) for r in context]
    return [[x * min(max(w, 0.0), 2.0) for x in r] for r, w in zip(context, [*weights, *[1.0] * len(context)])]


def hint(vector: Sequence[float]) -> list[float]:
    """The first 32 numbers with length 1."""
    v = [float(x) for x in vector[:HINT]]
    norm = math.sqrt(sum(x * x for x in v))
    return [x / norm for x in v] if norm else v


def blended(old: Sequence[float], new: Sequence[float], weight: float = BLEND) -> list[float]:
    n = max(len(old), len(new))
    a, b = [*old, *[0.0] * (n - len(old))], [*new, *[0.0] * (n - len(new))]
    return [(1 - weight) * x + weight * y for x, y in zip(a, b)]


def _step(state: dict, value: str, context: list[list[float]], rate: float, target: bool) -> None:
    score, weights = state.get(value) or (NEW_SCORE, {})
    s = score + sum(sum(x * y for x, y in zip(row, weights[d][0])) + weights[d][1] for d, row in enumerate(context) if d in weights)
    s = 1 / (1 + math.exp(-s)) if s >= 0 else math.exp(s) / (1 + math.exp(s))
    by = rate * ((1 - s) if target else -s)
    fresh = dict(weights)
    for d, row in enumerate(context):
        vector, bias = fresh.get(d, ([0.0] * len(row), 0.0))
        vector = [*vector, *[0.0] * (len(row) - len(vector))]
        fresh[d] = ([v + by * (row[i] if i < len(row) else 0.0) for i, v in enumerate(vector)], bias + by)
    state[value] = (min(max(score + by, -MOST_SCORE), MOST_SCORE), fresh)


PRED = f"key string, value string, score double, weights {WEIGHTS}"


def train(pred: DataFrame, steps: DataFrame) -> DataFrame:
    """Entries after training steps (key, seq, target, negatives array, rate, context array<array<double>>), each key's in order of seq.

    The target's score moves by rate * (1 - sigmoid), a negative's by -rate * sigmoid, weights and biases by the same times the deepened
    context; scores stay within 24.  A value that isn't there starts at .05.  Steps of a key without entries do nothing.
    """

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state = None, {}

        def entries() -> list[tuple]:
            return [(key, v, s, [{"depth": d, "vector": list(w), "bias": b} for d, (w, b) in sorted(weights.items())]) for v, (s, weights) in state.items()]

        for batch in batches:
            rows = []
            for r in batch.itertuples():
                if r.key != key:
                    rows += entries()
                    key, state = r.key, {}
                if not r.step:
                    state[r.value] = (float(r.score), {int(w["depth"]): (list(map(float, w["vector"])), float(w["bias"])) for w in (r.weights if r.weights is not None else [])})
                elif state:
                    context = deepen([list(x) for x in r.context]) if r.context is not None else []
                    rate = r.rate if r.rate and r.rate > 0 else 0.01
                    _step(state, r.target, context, rate, True)
                    for v in dict.fromkeys(x for x in (r.negatives if r.negatives is not None else []) if x and x != r.target):
                        _step(state, v, context, rate, False)
            if rows:
                yield pd.DataFrame(rows, columns=["key", "value", "score", "weights"])
        if state:
            yield pd.DataFrame(entries(), columns=["key", "value", "score", "weights"])

    # Entries come before their key's steps, which pass by in order: Python holds a batch and a key's entries.
    own = pred.select("key", F.lit(False).alias("step"), "value", "score", "weights")
    todo = steps.select("key", F.lit(True).alias("step"), "seq", "target", "negatives", F.col("rate").cast("double").alias("rate"), F.col("context").cast("array<array<double>>").alias("context"))
    rows = own.unionByName(todo, allowMissingColumns=True).repartition("key")
    return rows.sortWithinPartitions("key", "step", F.asc_nulls_last("seq")).mapInPandas(fold, PRED)


def window_hints(hints: DataFrame, steps: DataFrame) -> DataFrame:
    """Hints (key, position, vector) after the contexts of steps (key, seq, context): the first is set, later ones blend in by .35."""

    def fold(own: pd.DataFrame, todo: pd.DataFrame) -> pd.DataFrame:
        held = {int(r.position): list(r.vector) for r in own.itertuples()}
        key = (own if len(own) else todo)["key"].iloc[0]
        for r in todo.sort_values("seq", kind="stable").itertuples():
            for i, row in enumerate(r.context if r.context is not None else []):
                if len(row):
                    new = hint(list(row))
                    held[i] = blended(held[i], new) if held.get(i) else new
        return pd.DataFrame([(key, i, v) for i, v in sorted(held.items())], columns=["key", "position", "vector"])

    return hints.groupBy("key").cogroup(steps.groupBy("key")).applyInPandas(fold, "key string, position int, vector array<double>")


def train_one(pred: DataFrame, *, target: str, negatives: Sequence[str] = (), rate: float = 0.01) -> DataFrame:
    """One step without context for every key that has the values, as a projection."""
    s = sigmoid(F.col("score"))
    moved = F.when(F.col("value") == target, F.col("score") + rate * (1 - s)).when(F.col("value").isin(*negatives), F.col("score") - rate * s).otherwise(F.col("score"))
    return pred.withColumn("score", clamp_score(moved))


def adjust(pred: DataFrame, context: Sequence[Sequence[float]], *, mode: str = "bias", strength: float = 1.0) -> DataFrame:
    """Scores changed for good by a context: plus its term (bias), or times one plus its term (scale); not clamped."""
    term = context_term(F.col("weights"), matrix(deepen(context))) * (strength or 1.0)
    return pred.withColumn("score", F.col("score") * (1 + term) if mode in ("scale", "multiply") else F.col("score") + term)


# Inheritance.


def inherit(pred: DataFrame, wanted: DataFrame, mode: str = "avg") -> DataFrame:
    """Targets made of sources, for rows (key, target, source): key, value, score, weights and used.

    The score is the mean, sum or greatest of the sources that exist, within 24.  Weights of a depth are the mean over the sources that have it,
    each counting sigmoid of its score; a short vector counts as padded with zeros.  No source, no row.
    """
    rows = wanted.select("key", "target", "source").distinct().join(pred.withColumnRenamed("value", "source"), ["key", "source"])
    how = {"avg": F.avg, "sum": F.sum, "max": F.max}[mode]
    scores = rows.groupBy("key", "target").agg(clamp_score(how("score")).alias("score"), F.count("*").alias("used"))
    deep = rows.select("key", "target", sigmoid(F.col("score")).alias("w"), F.explode("weights").alias("c"))
    deep = deep.select("key", "target", "w", "c.depth", "c.vector", "c.bias")
    whole = deep.groupBy("key", "target", "depth").agg(F.sum("w").alias("total"), (F.sum(F.col("bias") * F.col("w")) / F.sum("w")).alias("bias"))
    cells = deep.select("key", "target", "depth", "w", F.posexplode("vector").alias("i", "x")).groupBy("key", "target", "depth", "i").agg(F.sum(F.col("x") * F.col("w")).alias("x"))
    vectors = cells.groupBy("key", "target", "depth").agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("v"))
    made = whole.join(vectors, ["key", "target", "depth"], "left").select(
        "key", "target", F.struct("depth", F.coalesce(F.transform("v", lambda c: c["x"] / F.col("total")), F.array().cast("array<double>")).alias("vector"), "bias").alias("w")
    )
    weights = made.groupBy("key", "target").agg(F.array_sort(F.collect_list("w")).alias("weights"))
    return scores.join(weights, ["key", "target"], "left").select("key", F.col("target").alias("value"), "score", F.coalesce("weights", F.array().cast(WEIGHTS)).alias("weights"), "used")


def with_inherited(pred: DataFrame, made: DataFrame) -> DataFrame:
    """Entries in which the inherited replace their namesakes."""
    return pred.join(made.select("key", "value"), ["key", "value"], "left_anti").unionByName(made.select("key", "value", "score", "weights"))


def pruned(pred: DataFrame, least: float = PURGE) -> DataFrame:
    """Without context weights of next to no size; what a saved table holds."""
    return pred.withColumn("weights", F.filter("weights", lambda w: norm1(w["vector"]) + F.abs(w["bias"]) >= least))
