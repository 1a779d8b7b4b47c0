"""The association cache: links and answers worth remembering, as tables that are merged, ranked, aged and pruned set-wise.

``links``: src, dst, score, distance, sources, observations, hits, created, refreshed, used (seconds).
``answers``: signature, epoch, members array<struct<node, score>>, score, observations, hits, created, refreshed, used.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.literals import clamp01

SAMPLE, CAPACITY, HALF_LIFE, LEAST_UTILITY, MEMBERS = 0.25, 65_536, 6 * 3600.0, 0.05, 64
TARGET_RATE, LEAST_BIAS, MOST_BIAS, LEAST_DECAY, MOST_DECAY, QUANTUM, SAMPLES = 0.20, 0.1, 2.0, 0.75, 1.25, 0.05, 32


def signature(
    origins: Iterable[str], *, precision: float, hops: int, direction: str, min_sources: int, decay: float, branch: int, cache_factor: float = 1.0, profile: str = "-", types: Iterable[str] = ()
) -> str:
    """32 hex digits for a comparison: the same for the same set of origins and the same parameters that decide the answer."""
    told = _told(precision, hops, direction, min_sources, decay, branch, cache_factor, profile, types)
    return hashlib.sha256(("".join(o + "\0" for o in sorted(origins)) + told).encode()).hexdigest()[:32]


def _told(precision: float, hops: int, direction: str, min_sources: int, decay: float, branch: int, cache_factor: float, profile: str, types: Iterable[str]) -> str:
    names = sorted(types)
    return f"|p={precision:.4f}|h={hops}|d={direction}|m={min_sources}|k={decay:.4f}|cd={cache_factor:.2f}|rd={profile}|b={branch}" + ("|t=" + ",".join(names) if names else "")


def signatures(
    asked: DataFrame, *, precision: float, hops: int, direction: str, min_sources: int, decay: float, branch: int, cache_factor: float = 1.0, profile: str = "-", types: Iterable[str] = ()
) -> DataFrame:
    """query and signature of many comparisons (query, origin) at once; a query has at most as many origins as a recall has seeds."""
    told = _told(precision, hops, direction, min_sources, decay, branch, cache_factor, profile, types)
    origins = F.array_join(F.transform(F.array_sort(F.collect_set("origin")), lambda o: F.concat(o, F.lit("\0"))), "")
    return asked.groupBy("query").agg(F.substring(F.sha2(F.concat(origins, F.lit(told)), 256), 1, 32).alias("signature"))


def query_class(*, hops: int, min_sources: int, direction: str, seeds: int, typed: bool) -> int:
    """One of 64 shapes of recall."""
    some = 0 if seeds <= 1 else 1 if seeds <= 3 else 2 if seeds <= 8 else 3
    shape = (hops & 7) << 4 | (min(min_sources, 3) & 3) << 2 | {"out": 1, "in": 2}.get(direction, 0)
    return (shape ^ some << 1 ^ int(typed) << 5) % 64


def query_class_column(*, hops: Column, min_sources: Column, direction: Column, seeds: Column, typed: Column) -> Column:
    """query_class of columns."""
    some = F.when(seeds <= 1, 0).when(seeds <= 3, 1).when(seeds <= 8, 2).otherwise(3)
    way = F.when(direction == "out", 1).when(direction == "in", 2).otherwise(0)
    shape = F.shiftleft(hops.cast("int").bitwiseAND(7), 4).bitwiseOR(F.shiftleft(F.least(min_sources.cast("int"), F.lit(3)).bitwiseAND(3), 2)).bitwiseOR(way)
    return F.pmod(shape.bitwiseXOR(F.shiftleft(some, 1)).bitwiseXOR(F.shiftleft(typed.cast("int"), 5)), F.lit(64))


def class_factors(classes: DataFrame) -> DataFrame:
    """Classes (lookups, hits, writes, bias) with their decay factor, and the state that retuning leaves: ClassStats of a whole table."""
    rate, enough = F.col("hits") / F.col("lookups") / TARGET_RATE, F.col("lookups") >= SAMPLES
    within = lambda c, low, high: F.least(F.greatest(c, F.lit(low)), F.lit(high))
    bias = F.when(enough, 0.7 * F.col("bias") + 0.3 * within(rate, LEAST_BIAS, MOST_BIAS)).otherwise(F.col("bias"))
    factor = F.when(bias < 1, 1 - (1 - bias) / (1 - LEAST_BIAS) * (1 - LEAST_DECAY)).otherwise(1 + (bias - 1) / (MOST_BIAS - 1) * (MOST_DECAY - 1))
    half = lambda c: F.when(enough, F.floor(F.col(c) / 2)).otherwise(F.col(c)).cast("long")
    return classes.withColumns({
        "factor": F.floor(within(factor, LEAST_DECAY, MOST_DECAY) / QUANTUM + 0.5) * QUANTUM,
        "new_bias": F.when(enough, within(0.7 * F.col("bias") + 0.3 * rate, LEAST_BIAS, MOST_BIAS)).otherwise(F.col("bias")),
        "new_lookups": half("lookups"), "new_hits": half("hits"), "new_writes": half("writes"),
    })


@dataclass
class ClassStats:
    """What a shape of recall has learned: its bias follows the rate of hits, and old counts fade by halves."""

    lookups: int = 0
    hits: int = 0
    writes: int = 0
    bias: float = 1.0

    def _wanted(self) -> float:
        return min(max(self.hits / self.lookups / TARGET_RATE, LEAST_BIAS), MOST_BIAS)

    def retune(self) -> None:
        if self.lookups >= SAMPLES:
            self.bias = min(max(0.7 * self.bias + 0.3 * (self.hits / self.lookups / TARGET_RATE), LEAST_BIAS), MOST_BIAS)
            self.lookups, self.hits, self.writes = self.lookups // 2, self.hits // 2, self.writes // 2

    def decay_factor(self) -> float:
        """.75 to 1.25 in steps of .05; 1 while the bias is neutral."""
        bias = self.bias if self.lookups < SAMPLES else 0.7 * self.bias + 0.3 * self._wanted()
        if bias < 1:
            factor = 1 - (1 - bias) / (1 - LEAST_BIAS) * (1 - LEAST_DECAY)
        else:
            factor = 1 + (bias - 1) / (MOST_BIAS - 1) * (MOST_DECAY - 1)
        return int(min(max(factor, LEAST_DECAY), MOST_DECAY) / QUANTUM + 0.5) * QUANTUM


def utility(now: Column | float, half_life: float = HALF_LIFE) -> Column:
    """Worth of an entry: recurrence, faded by half every half-life since its last use, times a quarter plus three quarters of its score."""
    now = now if isinstance(now, Column) else F.lit(float(now))
    age = F.greatest(now - F.greatest("refreshed", F.coalesce("used", F.lit(0))), F.lit(0.0))
    return F.pow(F.lit(2.0), -age / half_life) * (2 * F.log1p(F.col("hits").cast("double")) + F.log1p(F.col("observations").cast("double"))) * (0.25 + 0.75 * F.col("score"))


def usage(hits: Column, observations: Column) -> Column:
    return F.when(hits + observations > 0, hits / (hits + observations)).otherwise(0.0)


def admission(score: Column, distance: Column, bias: Column | float = 1.0, sample: float = SAMPLE) -> Column:
    bias = bias if isinstance(bias, Column) else F.lit(float(bias))
    return clamp01(sample * (0.15 + 0.85 * clamp01(score)) * F.when(distance < 2, 0.3).otherwise(1.0) * bias)


def observe_links(links: DataFrame, seen: DataFrame, now: float, *, sample: float = SAMPLE, bias: float = 1.0, seed: int = 0) -> DataFrame:
    """Links after co-activations (src, dst, score, distance, sources), several of a pair at once.

    A known link is always reinforced: an observation each, the greatest score and sources, the least positive distance.  A new one is
    admitted by chance: the dice of a pair are a hash of it and ``seed``, so a run that is repeated decides alike.
    """
    dice = F.pmod(F.xxhash64("src", "dst", F.lit(seed)), F.lit(1 << 52)) / float(1 << 52)
    near = F.min(F.when(F.col("distance") > 0, F.col("distance")))
    fresh = seen.where("src <> '' and dst <> '' and src <> dst").groupBy("src", "dst").agg(
        F.max(clamp01(F.col("score"))).alias("n_score"), near.alias("n_distance"), F.max("sources").alias("n_sources"), F.count("*").alias("n")
    )
    both = links.withColumn("there", F.lit(True)).join(fresh, ["src", "dst"], "full_outer")
    there, told = F.coalesce("there", F.lit(False)), F.col("n").isNotNull()
    both = both.where(there | (dice < admission(F.col("n_score"), F.coalesce("n_distance", F.lit(0)), bias, sample)))
    return both.select(
        "src", "dst", F.greatest("score", "n_score").alias("score"), F.coalesce(F.least(F.when(F.col("distance") > 0, F.col("distance")), F.col("n_distance")), F.col("distance"), F.lit(0)).alias("distance"),
        F.greatest("sources", "n_sources").alias("sources"), (F.coalesce("observations", F.lit(0)) + F.coalesce("n", F.lit(0))).cast("long").alias("observations"),
        F.coalesce("hits", F.lit(0)).cast("long").alias("hits"), F.coalesce("created", F.lit(float(now))).alias("created"),
        F.when(told, F.lit(float(now))).otherwise(F.col("refreshed")).alias("refreshed"), F.coalesce("used", F.lit(0.0)).alias("used"),
    )


def observe_answers(answers: DataFrame, fresh: DataFrame, now: float, epoch: int) -> DataFrame:
    """Answers after fresh ones (signature, members): always remembered, at most 64 members, valid for this epoch of the graph."""
    cut = fresh.select("signature", F.slice("members", 1, MEMBERS).alias("n_members"))
    best = F.coalesce(F.array_max(F.transform("n_members", lambda m: m["score"])), F.lit(0.0))
    both = answers.join(cut.withColumn("n_score", best), "signature", "full_outer")
    told = F.col("n_members").isNotNull()
    pick = lambda new, old: F.when(told, new).otherwise(F.col(old)).alias(old)
    return both.select(
        "signature", pick(F.lit(epoch).cast("long"), "epoch"), pick(F.col("n_members"), "members"), pick(F.col("n_score"), "score"),
        (F.coalesce("observations", F.lit(0)) + told.cast("long")).cast("long").alias("observations"), F.coalesce("hits", F.lit(0)).cast("long").alias("hits"),
        F.coalesce("created", F.lit(float(now))).alias("created"), pick(F.lit(float(now)), "refreshed"), F.coalesce("used", F.lit(0.0)).alias("used"),
    )


def serve(answers: DataFrame, asked: DataFrame, epoch: int) -> DataFrame:
    """Of signatures asked for (signature): members where the answer is of this epoch, and stale where it is of another."""
    rows = asked.select("signature").distinct().join(answers.select("signature", "epoch", "members"), "signature", "left")
    fresh = F.coalesce(F.col("epoch") == epoch, F.lit(False))
    return rows.select("signature", fresh.alias("hit"), (F.col("epoch").isNotNull() & ~fresh).alias("stale"), F.when(fresh, F.col("members")).alias("members"))


def shortcuts(links: DataFrame, nodes: DataFrame, *, floor: float = 0.0, limit: int = 16) -> DataFrame:
    """Remembered links of nodes (node), the best ``limit`` of each of at least ``floor``: src, dst, score."""
    from pyspark.sql import Window

    own = links.join(nodes.select(F.col("node").alias("src")).distinct(), "src").where(F.col("score") >= floor)
    rank = F.row_number().over(Window.partitionBy("src").orderBy(F.desc("score"), "dst"))
    return own.withColumn("__r", rank).where(F.col("__r") <= limit).select("src", "dst", "score")


def prune(entries: DataFrame, now: float, *, capacity: int = CAPACITY, least: float = LEAST_UTILITY, half_life: float = HALF_LIFE, age: bool = False) -> DataFrame:
    """Entries worth at least ``least``, times how far their number exceeds the capacity; ``age`` halves the counts of those that stay (an entry without any has one observation)."""
    live = entries.agg(F.count("*").alias("__live"))
    kept = entries.crossJoin(F.broadcast(live)).where(utility(now, half_life) >= least * F.greatest(F.lit(1.0), F.col("__live") / F.lit(float(capacity)))).drop("__live")
    if not age:
        return kept
    hits, seen = F.floor(F.col("hits") / 2), F.floor(F.col("observations") / 2)
    return kept.withColumns({"hits": hits, "observations": F.when((hits == 0) & (seen == 0), F.lit(1)).otherwise(seen).cast("long")})


def within_budget(entries: DataFrame, now: float, capacity: int) -> DataFrame:
    """The ``capacity`` most useful entries of all databases (columns src and dst break ties)."""
    return entries.withColumn("__u", utility(now)).orderBy(F.desc("__u"), "src", "dst").limit(capacity).drop("__u")


def stats(links: DataFrame, answers: DataFrame, now: float) -> DataFrame:
    one = links.agg(F.count("*").alias("links"), F.coalesce(F.sum("hits"), F.lit(0)).alias("link_hits"), F.avg(utility(now)).alias("mean_utility"))
    return one.crossJoin(answers.agg(F.count("*").alias("answers"), F.coalesce(F.sum("hits"), F.lit(0)).alias("answer_hits")))
