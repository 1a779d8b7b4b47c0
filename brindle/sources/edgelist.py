"""Edge lists from tab-separated files, and reports back to files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.literals import clamp01, normalise_token

COLUMNS = ("Relation", "Action", "Entity", "Value", "Probability", "Source", "Iteration of Promotion")
POSITIVE = ("", "+", "add", "promote", "positive", "true", "1")


def read(spark: SparkSession, path: str, *, least: float = 0.0) -> DataFrame:
    """(relation, src, dst, p) of a file with the seven named columns: rows of positive action, p from 0 to 1 and at least ``least``, of repeated edges the greatest p.

    Names are normalised tokens; nodes end in ``~``.  Rows without a relation, a node or a number as probability are left out.
    """
    raw = spark.read.csv(path, sep="\t", header=True, quote="", mode="PERMISSIVE")
    names = {c.strip().lower(): c for c in raw.columns}
    missing = [c for c in COLUMNS if c.lower() not in names]
    if missing:
        raise ValueError(f"missing_columns:{','.join(missing)}")
    col = lambda c: F.col(f"`{names[c.lower()]}`")
    rows = raw.where(F.lower(F.trim(F.coalesce(col("Action"), F.lit("")))).isin(*POSITIVE)).select(
        normalise_token(col("Relation")).alias("relation"), normalise_token(col("Entity")).alias("src"), normalise_token(col("Value")).alias("dst"), F.trim(col("Probability")).try_cast("double").alias("p")
    )
    rows = rows.where("relation <> '' and src <> '' and dst <> '' and p is not null").withColumn("p", clamp01(F.col("p"))).where(F.col("p") >= least)
    return rows.groupBy("relation", F.concat("src", F.lit("~")).alias("src"), F.concat("dst", F.lit("~")).alias("dst")).agg(F.max("p").alias("p"))


def write_report(report: DataFrame, folder: str, run: str) -> None:
    """A run's report as JSON under its name, and as a line appended to the metrics CSV."""
    report.write.mode("overwrite").json(f"{folder}/{run}")
    report.withColumn("run", F.lit(run)).write.mode("append").option("header", True).csv(f"{folder}/metrics")
