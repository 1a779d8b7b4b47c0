"""Statistical link prediction over ``edges`` (relation, src, dst, p): priors, co-occurrence, candidates, scores, ranking metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.literals import clamp01
from ..plans.lineage import cut, in_ranges, numbered, passing, sieve, small

TYPING = "generalizations"


def _dice(seed: int, *columns: str) -> Column:
    return F.md5(F.concat_ws("\x1f", F.lit(str(seed)), *columns))


def split(edges: DataFrame, ratio: float = 0.2, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Training and held-out edges.  Of all but typing edges a share, one at least, is held out: those of least MD5, so that a run repeats.

    The threshold is found without ordering all rows: hashes are uniform, so the counts of their first four digits say in which of the 65536 ranges the
    last one lies, and only that range is ranked.
    """
    rows = edges.withColumn("__h", _dice(seed, "relation", "src", "dst")).withColumn("__b", F.substring("__h", 1, 4))
    if ratio <= 0:
        return edges, edges.where(F.lit(False))
    free = F.col("relation") != TYPING
    counts = rows.where(free).groupBy("__b").count()
    upto = F.sum("count").over(Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, 0))  # 65536 rows at most
    total = counts.agg(F.sum("count").alias("n"))
    wanted = F.least(F.greatest(F.floor(F.col("n") * ratio + 0.5), F.lit(1)), F.col("n"))
    edge = F.struct("__h", "relation", "src", "dst")
    marks = counts.withColumn("upto", upto).crossJoin(F.broadcast(total)).select("__b", (wanted - (F.col("upto") - F.col("count"))).alias("room"))
    last = marks.where("room > 0").orderBy(F.desc("__b")).limit(1).first()  # the range of the last one held out
    if last is None:
        return edges, edges.where(F.lit(False))
    own = rows.where(free & (F.col("__b") == last["__b"])).withColumn("__i", F.row_number().over(Window.orderBy("__h", "relation", "src", "dst")))  # one of 65536 ranges
    end = own.where(F.col("__i") <= last["room"]).orderBy(F.desc("__i")).limit(1).select(edge.alias("e")).first()["e"]
    end = F.struct(*(F.lit(x).alias(c) for c, x in end.asDict().items()))
    same = own.where(edge == end).agg(F.max("__i")).first()[0]
    if same <= last["room"]:
        held = F.coalesce(free & (edge <= end), F.lit(False))
        return rows.where(~held).select(*edges.columns), rows.where(held).select(*edges.columns)
    in_range = F.row_number().over(Window.partitionBy("__b", free).orderBy("__h", "relation", "src", "dst"))
    marked = rows.join(F.broadcast(marks), "__b", "left").withColumn("__held", free & F.coalesce(in_range <= F.col("room"), F.lit(False)))  # copies of the last edge, of which some stay
    return marked.where(~F.col("__held")).select(*edges.columns), marked.where("__held").select(*edges.columns)


def relation_prior(train: DataFrame) -> DataFrame:
    return train.groupBy("relation").agg(F.avg("p").alias("prior"))


def source_prior(train: DataFrame) -> DataFrame:
    return train.groupBy("src", "relation").agg(F.avg("p").alias("source_prior"))


def target_prior(train: DataFrame) -> DataFrame:
    """Share of a relation's edges that a target has."""
    whole = train.groupBy("relation").agg(F.count("*").alias("n"))
    return train.groupBy("relation", "dst").agg(F.count("*").alias("k")).join(whole, "relation").select("relation", "dst", (F.col("k") / F.col("n")).alias("target_prior"))


def conditional(train: DataFrame, has: DataFrame | None = None) -> DataFrame:
    """P(right | left) over sources: how many that have relation left have right as well.

    A source's distinct relations make the pairs, so work grows with relations a source, not with its edges.
    """
    has = train.select("src", "relation").distinct() if has is None else has
    sets = has.groupBy("src").agg(F.collect_set("relation").alias("rs"))
    pairs = sets.select(F.explode("rs").alias("left"), "rs").select("left", F.explode("rs").alias("right")).where("left <> right").groupBy("left", "right").agg(F.count("*").alias("pair"))
    presence = has.groupBy(F.col("relation").alias("left")).agg(F.count("*").alias("presence"))
    return pairs.join(presence, "left").select("left", "right", "pair", "presence", (F.col("pair") / F.col("presence")).alias("conditional"))


def categories(train: DataFrame) -> DataFrame:
    """(entity, category, p): the greatest p of each typing edge."""
    return train.where(F.col("relation") == TYPING).groupBy(F.col("src").alias("entity"), F.col("dst").alias("category")).agg(F.max("p").alias("cp")).where("cp > 0")


def relation_category(train: DataFrame) -> DataFrame:
    """Share of each category among a relation's targets, by p times the category's p."""
    cats = categories(train)
    raw = train.where(F.col("relation") != TYPING).join(cats, F.col("dst") == F.col("entity")).groupBy("relation", "category").agg(F.sum(F.col("p") * F.col("cp")).alias("w"))
    whole = raw.groupBy("relation").agg(F.sum("w").alias("total")).where("total > 0")
    return raw.join(whole, "relation").select("relation", "category", (F.col("w") / F.col("total")).alias("share"))


def candidates(held: DataFrame, train: DataFrame, negatives: int = 1, seed: int = 42, attempts: int = 16) -> DataFrame:
    """Held-out edges (label 1) with their negatives (label 0, p 0): targets of the same relation that no training edge has.

    Attempt k of an edge takes the target whose number in the relation's pool is a hash of edge and k; the first ``negatives`` that are
    neither the true target nor known count.
    """
    pool = cut(numbered(train.select("relation", "dst").distinct(), "relation", "dst", "n"))
    sizes = pool.groupBy("relation").agg(F.count("*").alias("size"))
    edge = ["relation", "src", "actual"]
    todo = cut(held.join(small(sizes), "relation").select("relation", "src", F.col("dst").alias("actual"), "size").distinct())
    number = F.pmod(F.conv(F.substring(_dice(seed, *edge, "k"), 1, 12), 16, 10).cast("long"), F.col("size"))
    found, done, step = None, 0, negatives
    while done < attempts * negatives:  # most edges need the first attempts only
        upto = min(attempts * negatives, done + step)
        tries = todo.withColumn("k", F.explode(F.sequence(F.lit(done + 1), F.lit(upto)))).withColumn("n", number)
        tried = cut(tries.join(pool, ["relation", "n"]).where("dst <> actual").select(*edge, "dst", "k"))
        known = passing(train.select("relation", "src", "dst"), "relation, src, dst", sieve(tried, "relation, src, dst"))  # most edges were never tried
        fresh = tried.join(known, ["relation", "src", "dst"], "left_anti").select(*edge, "dst", "k")
        found = cut((fresh if found is None else found.unionByName(fresh)).groupBy(*edge, "dst").agg(F.min("k").alias("k")))
        enough = found.groupBy(*edge).agg(F.count("*").alias("n")).where(F.col("n") >= negatives)
        todo, done, step = cut(todo.join(enough, edge, "left_anti")), upto, 4 * step
        if todo.isEmpty():
            break
    picked = held.select("relation", "src", "dst").where(F.lit(False)) if found is None else found.withColumn("__r", F.row_number().over(Window.partitionBy(*edge).orderBy("k"))).where(F.col("__r") <= negatives)
    return held.select("relation", "src", "dst", F.lit(1).alias("label")).unionByName(picked.select("relation", "src", "dst", F.lit(0).alias("label")))


def probability_scores(rows: DataFrame, train: DataFrame, sources: DataFrame | None = None) -> DataFrame:
    """Rows (relation, src, dst, …) with prob: the relation's prior, .6/.4 with the source's, .75/.25 with the target's, where there are such."""
    sources = source_prior(train) if sources is None else sources
    out = rows.join(small(relation_prior(train)), "relation", "left").join(sources, ["src", "relation"], "left").join(target_prior(train), ["relation", "dst"], "left")
    prior = F.coalesce("prior", F.lit(0.0))
    own = F.when(F.col("source_prior").isNotNull(), 0.6 * F.col("source_prior") + 0.4 * prior).otherwise(prior)
    own = F.when(F.col("target_prior").isNotNull(), 0.75 * own + 0.25 * F.col("target_prior")).otherwise(own)
    return out.withColumn("prob", clamp01(own)).drop("prior", "source_prior")


def implicit_scores(rows: DataFrame, train: DataFrame) -> DataFrame:
    """Rows with prob and implicit: .45 context + .25 category + .20 target + .10 prob.

    Context is the mean of P(relation | r) over the source's other relations r, weighted by their share of its edges and only over those for
    which it is known; category the greatest share that a category of the target has in the relation.
    """
    sources = cut(train.groupBy("src", "relation").agg(F.avg("p").alias("source_prior"), F.count("*").alias("k")))
    scored = probability_scores(rows, train, sources.drop("k"))
    shares = sources.select("src", F.col("relation").alias("left"), "k")
    keys = rows.select("relation", "src").distinct()
    ctx = (
        keys.join(shares, "src").where("left <> relation").join(small(conditional(train, sources.select("src", "relation")).select("left", F.col("right").alias("relation"), "conditional")), ["left", "relation"])
        .groupBy("relation", "src").agg((F.sum(F.col("k") * F.col("conditional")) / F.sum("k")).alias("context"))
    )
    cat = (
        rows.select("relation", "dst").distinct().join(categories(train), F.col("dst") == F.col("entity")).join(small(relation_category(train)), ["relation", "category"])
        .groupBy("relation", "dst").agg(F.max("share").alias("category"))
    )
    out = scored.join(ctx, ["relation", "src"], "left").join(cat, ["relation", "dst"], "left")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return out.withColumn("implicit", clamp01(0.45 * zero("context") + 0.25 * zero("category") + 0.20 * zero("target_prior") + 0.10 * F.col("prob")))


def rerank(rows: DataFrame, k: int = 1000, alpha: float = 0.4, *, base: str = "implicit", other: str = "prob", ties: tuple[str, ...] = ()) -> DataFrame:
    """Rows with reranked: base, but for the k best by base alpha * base + (1 - alpha) * other.  Ties: positives first, then ``ties``."""
    alpha = min(max(alpha, 0.0), 1.0)
    best = rows.orderBy(F.desc(base), F.desc("label"), *ties).limit(k).withColumn("reranked", clamp01(alpha * F.col(base) + (1 - alpha) * F.col(other)))
    keys = [c for c in ("relation", "src", "dst", "label", *ties) if c in rows.columns]
    return rows.join(small(best.select(*dict.fromkeys(keys), "reranked")), list(dict.fromkeys(keys)), "left").withColumn("reranked", F.coalesce("reranked", base))


# Metrics.  Rows are counted by score first; what is ordered are the distinct scores, in ranges.


def _by_score(rows: DataFrame, score: str) -> DataFrame:
    return rows.groupBy(F.col(score).alias("s")).agg(F.count(F.when(F.col("label") == 1, 1)).alias("pos"), F.count(F.when(F.col("label") != 1, 1)).alias("neg"))


def _running(levels: DataFrame, descending: bool) -> DataFrame:
    """With the positives and negatives before each level: sums within ranges of the score, and over the ranges."""
    ranged = in_ranges(levels.withColumn("__k", -F.col("s") if descending else F.col("s")), "__k")
    inside = Window.partitionBy("__part").orderBy("__k").rowsBetween(Window.unboundedPreceding, -1)
    over = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    whole = ranged.groupBy("__part").agg(F.sum("pos").alias("p"), F.sum("neg").alias("n")).select("__part", F.coalesce(F.sum("p").over(over), F.lit(0)).alias("p0"), F.coalesce(F.sum("n").over(over), F.lit(0)).alias("n0"))
    out = ranged.withColumns({"p1": F.coalesce(F.sum("pos").over(inside), F.lit(0)), "n1": F.coalesce(F.sum("neg").over(inside), F.lit(0))}).join(F.broadcast(whole), "__part")
    return out.select("s", "pos", "neg", (F.col("p0") + F.col("p1")).alias("pos_before"), (F.col("n0") + F.col("n1")).alias("neg_before"))


def auc(rows: DataFrame, score: str) -> DataFrame:
    """Area under the ROC curve by rank sums; among equal scores positives have the lower ranks.  0 if a class is missing."""
    levels = _running(_by_score(rows, score), descending=False)
    sums = levels.agg(F.sum(F.col("pos").cast("double") * F.col("neg_before")).alias("wins"), F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    return sums.select(F.when((F.col("p") > 0) & (F.col("n") > 0), F.col("wins") / (F.col("p").cast("double") * F.col("n"))).otherwise(0.0).alias("auc"))


def average_precision(rows: DataFrame, score: str) -> DataFrame:
    """Mean precision at the positives, which come first among equal scores; 0 without positives."""
    levels = _running(_by_score(rows, score), descending=True).where("pos > 0")
    terms = F.aggregate(
        F.sequence(F.lit(1).cast("long"), F.col("pos")), F.lit(0.0), lambda acc, i: acc + (F.col("pos_before") + i).cast("double") / (F.col("pos_before") + F.col("neg_before") + i)
    )
    return levels.agg(F.coalesce(F.sum(terms) / F.sum("pos"), F.lit(0.0)).alias("ap"))


def precision_at(rows: DataFrame, score: str, k: int) -> DataFrame:
    """Share of positives among the k best (positives first among equals), or among all if they are fewer."""
    top = rows.orderBy(F.desc(score), F.desc("label")).limit(max(k, 0)).agg(F.avg((F.col("label") == 1).cast("double")).alias("p"))
    return top.select(F.coalesce("p", F.lit(0.0)).alias("precision_at_k"))


def percentile(values: DataFrame, column: str, p: float) -> DataFrame:
    """Nearest rank: the value of number ceil(p * n), the least or greatest for p outside 0..1; 0 without values."""
    levels = values.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("s")).agg(F.count("*").alias("pos")).withColumn("neg", F.lit(0).cast("long"))
    n = values.where(F.col(column).isNotNull()).agg(F.count("*").alias("n"))
    rank = F.least(F.greatest(F.ceil(F.lit(min(max(p, 0.0), 1.0)) * F.col("n")), F.lit(1)), F.col("n"))
    found = _running(levels, descending=False).crossJoin(F.broadcast(n)).where((F.col("pos_before") < rank) & (rank <= F.col("pos_before") + F.col("pos")))
    return found.agg(F.coalesce(F.max("s").cast("double"), F.lit(0.0)).alias("percentile"))
