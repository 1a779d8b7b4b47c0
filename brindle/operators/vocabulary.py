"""Vocabularies: names and the tokens (numbers) they keep for good."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import with_position

VOCABULARY = "name string, token long"


def allocate(vocabulary: DataFrame, names: DataFrame) -> DataFrame:
    """The vocabulary (name, token) with a token for each name that has none: the numbers after the greatest, in order of name.  A token is never given away again."""
    fresh = names.where("name is not null").select("name").distinct().join(vocabulary, "name", "left_anti")
    top = vocabulary.agg(F.coalesce(F.max("token"), F.lit(-1)).alias("top"))
    new = with_position(fresh, "name", "n").crossJoin(F.broadcast(top)).select("name", (F.col("top") + F.col("n")).alias("token"))  # one row
    return vocabulary.select("name", "token").unionByName(new)


def encode(rows: DataFrame, vocabulary: DataFrame, column: str, to: str = "token") -> DataFrame:
    """Rows with the token of a column's name, null where it has none."""
    own = vocabulary.select(F.col("name").alias(column), F.col("token").alias(to))
    return rows.join(own, column, "left")


def decode(rows: DataFrame, vocabulary: DataFrame, column: str, to: str = "name") -> DataFrame:
    """Rows with the name of a column's token, null where there is none."""
    own = vocabulary.select(F.col("token").alias(column), F.col("name").alias(to))
    return rows.join(own, column, "left")
