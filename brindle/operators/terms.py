"""The lexical index over nodes: tokens, postings, document frequencies, trigrams and tolerant matching, all as derived tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.literals import clamp01

NODE_TOKENS, REFERENCE_TOKENS = 12, 20
FUZZY_MOST = 8


def tokens(text: Column) -> Column:
    """Distinct words of letters and digits in lower case, in order of their first place; of null none."""
    return F.array_distinct(F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{Nd}]+"), lambda t: t != ""))


def node_tokens(nodes: DataFrame, sentences: DataFrame | None = None) -> DataFrame:
    """(node, tokens): the first 12 of the id and the labels, then those of reference sentences (node, text, ordinal, ref) up to 32 in all."""
    head = F.slice(F.array_distinct(F.concat(tokens(F.col("id")), F.flatten(F.transform(F.coalesce("labels", F.array().cast("array<string>")), tokens)))), 1, NODE_TOKENS)
    own = nodes.select(F.col("id").alias("node"), head.alias("tokens"))
    if sentences is None:
        return own
    said = sentences.groupBy("node").agg(F.array_sort(F.collect_list(F.struct("ordinal", "ref", "text"))).alias("said"))
    more = F.flatten(F.transform("said", lambda s: tokens(s["text"])))
    both = F.when(F.col("said").isNull(), F.col("tokens")).otherwise(F.slice(F.array_distinct(F.concat("tokens", more)), 1, NODE_TOKENS + REFERENCE_TOKENS))
    return own.join(said, "node", "left").select("node", both.alias("tokens"))


def postings(tokened: DataFrame) -> DataFrame:
    """(token, node), each pair once."""
    return tokened.select(F.explode("tokens").alias("token"), "node").distinct()


def postings_of(tokened: DataFrame, wanted: DataFrame) -> DataFrame:
    """Postings of the tokens wanted (token) only."""
    return tokened.select(F.explode("tokens").alias("token"), "node").join(wanted, "token", "left_semi").distinct()


def frequencies(posted: DataFrame) -> DataFrame:
    """(token, df)."""
    return posted.groupBy("token").agg(F.count("*").alias("df"))


def idf(documents: Column, df: Column) -> Column:
    """ln((N + 1) / (min(df, N) + 1)) + 1; 1 where nothing is indexed."""
    n = documents.cast("double")
    return F.when(n > 0, F.log((n + 1) / (F.least(df.cast("double"), n) + 1)) + 1).otherwise(1.0)


def trigrams(token: Column) -> Column:
    """Distinct three-character windows of the token between ^ and $."""
    padded = F.concat(F.lit("^"), token, F.lit("$"))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(padded) - 2), lambda i: F.substring(padded, i, F.lit(3))))


def max_edits(length: Column) -> Column:
    return F.when(length <= 2, 0).when(length <= 8, 1).otherwise(2)


def fuzzy(queries: DataFrame, vocabulary: DataFrame, most: int = FUZZY_MOST) -> DataFrame:
    """For tokens asked for (token) the ``most`` best of the vocabulary (token, df) within their edit distance: token, match, similarity, df.

    Partners meet by a common trigram, if lengths allow the distance; similarity is three parts of edit and one of trigram similarity.
    Ties: the rarer, then the lesser token.  A token isn't its own match; every gram's postings count, whatever their number.
    """
    def grams(df: DataFrame, name: str) -> DataFrame:
        cut = df.select(F.col("token").alias(name), trigrams(F.col("token")).alias("__g"))
        return cut.select(name, F.size("__g").alias(f"{name}_grams"), F.explode("__g").alias("gram"))

    asked = grams(queries.select("token").distinct().where(F.length("token") > 2), "token").withColumn("reach", max_edits(F.length("token")))
    known = grams(vocabulary, "match")
    near = F.abs(F.length("token") - F.length("match")) <= F.col("reach")
    met = asked.join(known, (asked["gram"] == known["gram"]) & near & (F.col("token") != F.col("match")))
    met = met.groupBy("token", "match", "reach").agg(F.count("*").alias("shared"), F.first("token_grams").alias("a"), F.first("match_grams").alias("b"))
    distance = F.levenshtein("token", "match")
    longest = F.greatest(F.length("token"), F.length("match"))
    alike = 0.75 * (1 - F.col("distance") / longest) + 0.25 * (F.col("shared") / (F.col("a") + F.col("b") - F.col("shared")))
    found = met.withColumn("distance", distance).where(F.col("distance") <= F.col("reach")).select("token", "match", alike.alias("similarity"))
    found = found.join(vocabulary.select(F.col("token").alias("match"), "df"), "match")
    best = F.row_number().over(Window.partitionBy("token").orderBy(F.desc("similarity"), "df", "match"))
    return found.withColumn("__r", best).where(F.col("__r") <= most).select("token", "match", "similarity", "df")


def weighted_score(asked: DataFrame, candidates: DataFrame) -> DataFrame:
    """Score of candidates (candidate, tokens) for weighted tokens (query, token, weight): shared weight over all weight plus the mean for each extra token."""
    whole = asked.groupBy("query").agg(F.sum("weight").alias("total"), F.avg("weight").alias("mean"))
    shared = (
        asked.join(candidates.select("candidate", F.size("tokens").alias("size"), F.explode("tokens").alias("token")), "token")
        .groupBy("query", "candidate", "size").agg(F.sum("weight").alias("shared"), F.count("*").alias("n"))
    )
    extra = F.greatest(F.col("size") - F.col("n"), F.lit(0))
    score = clamp01(F.col("shared") / (F.col("total") + F.col("mean") * extra))
    return shared.join(whole, "query").select("query", "candidate", score.alias("score"))


def stats(nodes: DataFrame, tokened: DataFrame) -> DataFrame:
    """One row: entries, nodes, tokens and trigrams of the index."""
    posted = postings(tokened)
    vocabulary = frequencies(posted)
    grams = vocabulary.select(F.explode(trigrams(F.col("token"))).alias("gram"))
    one = lambda df, c, n: df.agg(c.alias(n))
    return (
        one(posted, F.count("*"), "entries").crossJoin(one(nodes, F.count("*"), "nodes"))
        .crossJoin(one(vocabulary, F.count("*"), "tokens")).crossJoin(one(grams, F.countDistinct("gram"), "trigrams"))
    )
