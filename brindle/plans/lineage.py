"""Cutting lineage in loops: tables written to the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where that is unset, a folder of the session's own if all runs on this machine."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="brindle-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """The rows of df, written once in the shared folder."""
    spark = df.sparkSession
    path = f"{shared(spark)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small(df: DataFrame, most: int = 1 << 17) -> DataFrame:
    """The rows of df, written, and marked for broadcast if there are at most ``most``; else Spark joins by shuffle."""
    df = cut(df)
    return F.broadcast(df) if df.count() <= most else df


def sieve(ids: DataFrame, column: str, words: int = 1 << 20) -> DataFrame:
    """A table of bits, of bounded size, that says of a hash whether an id (a column, or several with commas) may have it: for ``passing``."""
    h = F.pmod(F.expr(f"xxhash64({column})"), F.lit(words * 64))
    bits = ids.select(F.shiftright(h, 6).alias("__word"), F.expr(f"shiftleft(1L, cast(pmod(xxhash64({column}), 64) as int))").alias("__bit")).groupBy("__word").agg(F.bit_or("__bit").alias("__bits"))
    return F.broadcast(cut(bits))


def flagged(rows: DataFrame, column: str, bits: DataFrame, name: str, words: int = 1 << 20) -> DataFrame:
    """Rows with ``name``: false where the column is none of a sieve's ids, true where it may be; no shuffle."""
    h = F.shiftright(F.pmod(F.expr(f"xxhash64({column})"), F.lit(words * 64)), 6)
    joined = rows.withColumn("__h", h).join(bits.withColumnRenamed("__word", "__h"), "__h", "left")
    return joined.withColumn(name, F.coalesce(F.expr(f"shiftright(__bits, cast(pmod(xxhash64({column}), 64) as int)) & 1 = 1"), F.lit(False))).drop("__h", "__bits")


def passing(rows: DataFrame, column: str, bits: DataFrame) -> DataFrame:
    """Rows whose column is among a sieve's ids, and some others of the same hashes; no shuffle."""
    return flagged(rows, column, bits, "__in").where("__in").drop("__in")


def numbered(df: DataFrame, group: str, order: str, name: str) -> DataFrame:
    """The rows with their number (from 0) in the order of their group: ranges of both are numbered by themselves, only their totals meet."""
    own = in_ranges(df, F.struct(group, order))
    counts = own.groupBy(group, "__part").agg(F.count("*").alias("__n"))
    before = counts.select(group, "__part", (F.sum("__n").over(Window.partitionBy(group).orderBy("__part")) - F.col("__n")).alias("__before"))
    inside = F.row_number().over(Window.partitionBy(group, "__part").orderBy(order)) - 1
    return own.withColumn("__i", inside).join(before, [group, "__part"]).withColumn(name, F.col("__i") + F.col("__before")).drop("__part", "__i", "__before")


def in_ranges(df: DataFrame, order: str | Column) -> DataFrame:
    """The rows with ``__part``, the number of the range of ``order`` that they lie in; written, as the ranges come from a sample that another run would draw anew."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return cut(df.repartitionByRange(parts, order).withColumn("__part", F.spark_partition_id()))
