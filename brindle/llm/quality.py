"""Quality rules: decision lists learned by sequential covering, applied as Spark conditional expressions.

``fit`` grows a conjunction of thresholds literal by literal on two thirds of the labelled
statistics (FOIL gain), prunes it backwards on the other third, keeps it if it is
precise there, removes what it covers and starts the next one; after an imprecise one the
next best first literal is tried.  The ordered list
becomes one ``CASE WHEN`` over the statistics, evaluated on the JVM for every document.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textbuf

STATS = (
    "n_bytes",
    "n_words",
    "mean_word",
    "upper_share",
    "symbol_share",
    "bar_share",
    "bang_share",
    "distinct_share",
    "echo_share",
    "words_per_line",
    "digit_share",
)
STATS_TYPE = T.StructType([T.StructField(n, T.DoubleType(), False) for n in STATS])

_BYTE = np.arange(256)
_LETTER = np.array([chr(b).isalpha() and b < 128 for b in _BYTE]) | (_BYTE >= 0xC0)
_UPPER = (_BYTE >= 65) & (_BYTE <= 90)
_DIGIT = (_BYTE >= 48) & (_BYTE <= 57)
_SYMBOL = textbuf.PUNCT & ~textbuf.SPACE & (_BYTE > 32)


def _per_row(flags: np.ndarray, row_byte: np.ndarray) -> np.ndarray:
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return np.diff(total[row_byte])


def statistics(column: pa.Array) -> np.ndarray:
    """The statistics of each text, one row each; null counts as the empty text, whose statistics are all 0."""
    out = np.zeros((len(column), len(STATS)))
    for w in textbuf.chunks(column):
        b, at = w.data, w.row_byte
        words = np.diff(w.bound).astype(float)
        size = np.diff(at).astype(float)
        solid = np.maximum(_per_row(~textbuf.SPACE[b], at), 1)
        latin = np.zeros(len(b), bool)  # U+00C0..U+00DE in UTF-8
        latin[1:] = (b[:-1] == 0xC3) & (b[1:] >= 0x80) & (b[1:] <= 0x9E) & (b[1:] != 0x97)
        letters = np.maximum(_per_row(_LETTER[b], at), 1)
        row = np.repeat(np.arange(w.rows), np.diff(w.bound))
        keyed = w.hash + textbuf.mix(row.astype(np.uint64))
        _, first = np.unique(keyed, return_index=True)
        distinct = np.bincount(row[first], minlength=w.rows)
        same = np.zeros(len(w.hash), bool)
        same[1:] = (w.hash[1:] == w.hash[:-1]) & (row[1:] == row[:-1])
        some = np.maximum(words, 1)
        out[w.first : w.first + w.rows] = np.column_stack(
            [
                size,
                words,
                _per_row(~textbuf.SPACE[b], at) / some,
                _per_row(_UPPER[b] | latin, at) / letters,
                _per_row(_SYMBOL[b], at) / solid,
                _per_row(b == ord("|"), at) / solid,
                _per_row(b == ord("!"), at) / solid,
                distinct / some,
                np.bincount(row[same], minlength=w.rows) / some,
                words / (_per_row(b == 10, at) + 1),
                _per_row(_DIGIT[b], at) / solid,
            ]
        )
    return out


@F.arrow_udf(STATS_TYPE)
def text_statistics(text: pa.Array) -> pa.Array:
    found = statistics(text)
    textbuf.release()
    return pa.StructArray.from_arrays([pa.array(found[:, i]) for i in range(len(STATS))], names=list(STATS))


@dataclass(frozen=True)
class Literal:
    stat: str
    at_least: bool
    value: float

    def holds(self, x: np.ndarray) -> np.ndarray:
        col = x[:, STATS.index(self.stat)]
        return col >= self.value if self.at_least else col <= self.value

    def column(self, stats: Column) -> Column:
        c = stats[self.stat]
        return c >= F.lit(self.value) if self.at_least else c <= F.lit(self.value)

    def __str__(self) -> str:
        return f"{self.stat} {'>=' if self.at_least else '<='} {self.value:.6g}"


@dataclass(frozen=True)
class Rule:
    literals: tuple[Literal, ...]
    covered: int = field(default=0, compare=False)
    wrong: int = field(default=0, compare=False)

    def holds(self, x: np.ndarray) -> np.ndarray:
        out = np.ones(len(x), bool)
        for lit in self.literals:
            out &= lit.holds(x)
        return out

    def __str__(self) -> str:
        return " and ".join(map(str, self.literals))


def _candidates(x: np.ndarray, positive: np.ndarray, cuts: int) -> list[tuple[int, np.ndarray]]:
    out = []
    for j in range(x.shape[1]):
        levels = np.unique(x[:, j])
        if len(levels) > 16 * cuts:
            levels = np.unique(np.quantile(x[:, j], np.linspace(0, 1, cuts)))
        if positive.any():
            levels = np.union1d(levels, np.quantile(x[positive, j], np.linspace(0, 1, 17)))
        out.append((j, (levels[1:] + levels[:-1]) / 2))
    return out


def _grow(x: np.ndarray, y: np.ndarray, most: int, cuts: int, barred: set[tuple[str, bool]]) -> list[Literal]:
    literals: list[Literal] = []
    inside = np.ones(len(x), bool)
    while len(literals) < most:
        xs, ys = x[inside], y[inside]
        p0, n0 = ys.sum(), (~ys).sum()
        if p0 == 0 or n0 == 0:
            break
        best, chosen = 0.0, None
        base = np.log2(p0 / (p0 + n0))
        for j, levels in _candidates(xs, ys, cuts):
            if not len(levels):
                continue
            pos, neg = np.sort(xs[ys, j]), np.sort(xs[~ys, j])
            for up in (True, False):
                if not literals and (STATS[j], up) in barred:
                    continue
                p = p0 - np.searchsorted(pos, levels) if up else np.searchsorted(pos, levels, side="right")
                n = n0 - np.searchsorted(neg, levels) if up else np.searchsorted(neg, levels, side="right")
                with np.errstate(divide="ignore", invalid="ignore"):
                    gain = np.where(p > 0, p * (np.log2(p / np.maximum(p + n, 1)) - base), 0)
                k = int(np.argmax(gain))
                if gain[k] > best + 1e-9:
                    best, chosen = float(gain[k]), Literal(STATS[j], up, float(levels[k]))
        if chosen is None:
            break
        literals.append(chosen)
        inside &= chosen.holds(x)
    return literals


def _prune(literals: list[Literal], x: np.ndarray, y: np.ndarray, hold: np.ndarray, min_precision: float, min_cover: int) -> Rule | None:
    """The beginning of the conjunction that is worth most on what is held out, of those precise enough there and on all rows."""
    best, found = -2.0, None
    for k in range(1, len(literals) + 1):
        hit = Rule(tuple(literals[:k])).holds(x)
        wrong, p, n = int((hit & ~y).sum()), int((hit & y & hold).sum()), int((hit & ~y & hold).sum())
        if p < min_cover or p < min_precision * (p + n) or wrong > (1 - min_precision) * hit.sum():
            continue
        if (p - n) / (p + n) > best:
            best, found = (p - n) / (p + n), Rule(tuple(literals[:k]), int(hit.sum()), wrong)
    return found


def learn(
    x: np.ndarray, reject: np.ndarray, *, most_rules: int = 24, most_literals: int = 4, min_precision: float = 0.97, min_cover: int = 4, cuts: int = 129
) -> list[Rule]:
    """The decision list; the rows' order decides what is grown and what is pruned (every third row), so it must be fixed."""
    x, y = np.asarray(x, float), np.asarray(reject, bool)
    rules: list[Rule] = []
    hold = np.arange(len(x)) % 3 == 2
    barred: set[tuple[str, bool]] = set()  # first literals that led to no precise rule since the last one
    while len(rules) < most_rules and (y & ~hold).sum() >= min_cover:
        grown = _grow(x[~hold], y[~hold], most_literals, cuts, barred)
        if not grown:
            break
        rule = _prune(grown, x, y, hold, min_precision, max(1, min_cover // 2))
        if rule is None:
            barred.add((grown[0].stat, grown[0].at_least))
            continue
        rules.append(rule)
        barred.clear()
        hit = rule.holds(x)
        x, y, hold = x[~hit], y[~hit], hold[~hit]
    return rules


def fit(docs: DataFrame, labels: DataFrame, *, sample: int = 20_000, **options) -> list[Rule]:
    """Rules that tell quality 0 from quality 1, learned from at most ``sample`` labelled documents.

    The sample is the labels of least hash of doc_id, whatever the size of the tables; that bound keeps
    what is sent to the driver (11 numbers a row) fixed.  Labels or documents with a null doc_id, null
    quality or null text aren't learned from; where a doc_id has several labels the lowest counts, where it has several rows the
    text that is least by statistics.  No usable label, or one class only: no rules.
    """
    chosen = (
        labels.where("doc_id is not null and quality is not null")
        .groupBy("doc_id")
        .agg(F.min("quality").alias("quality"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(sample)
    )
    rows = (
        docs.where("doc_id is not null and text is not null")
        .select("doc_id", "text")
        .join(F.broadcast(chosen), "doc_id")  # at most ``sample`` rows of two numbers
        .select("doc_id", "quality", text_statistics("text").alias("s"))
        .groupBy("doc_id", "quality").agg(F.min("s").alias("s"))  # a row an id, however often it is there
        .select(F.xxhash64("doc_id").alias("h"), "doc_id", "quality", "s.*")
        .toPandas()
        .sort_values(["h", "doc_id", *STATS], kind="stable")
    )
    return learn(rows[list(STATS)].to_numpy(), (rows["quality"] == 0).to_numpy(), **options)


def verdict(rules: list[Rule], stats: Column) -> Column:
    """Number of the first rule that holds, from 1 in order; null where none does."""
    out = F.lit(None).cast("int")
    for k in range(len(rules), 0, -1):
        cond = F.lit(True)
        for lit in rules[k - 1].literals:
            cond = cond & lit.column(stats)
        out = F.when(cond, F.lit(k)).otherwise(out)
    return out


def judge(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """doc_id, the statistics, ``rule`` (the first that rejects, or null) and ``keep`` of every row of docs.

    Null text is judged as the empty text; a null or repeated doc_id is judged as any row; other columns are left out.
    """
    return (
        docs.select("doc_id", text_statistics("text").alias("s"))
        .select("doc_id", "s.*", verdict(rules, F.col("s")).alias("rule"))
        .withColumn("keep", F.col("rule").isNull())
    )


def keep(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """The rows of docs that no rule rejects, with all their columns as they were."""
    if not rules:
        return docs
    return docs.where(verdict(rules, text_statistics("text")).isNull())
