"""What the operators share: reading tables, sizing shuffles, cutting lineage."""

from __future__ import annotations

import functools
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of a batch that goes to Python, but for its last row.
BATCH_BYTES = 8 << 20


def small_batches(spark: SparkSession) -> None:
    """Bounds the session's Arrow batches by BATCH_BYTES: each task holds a batch and its result several times, in the JVM and in Python, outside of the heap."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if not 0 < spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(name)) <= BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir; where that is unset, one of this session's own if all runs on this machine (tests)."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        where = tempfile.mkdtemp(prefix="brindle-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where


def written(df: DataFrame, what: str) -> DataFrame:
    """The rows of df as a table written once in the shared folder: lineage is cut and survives lost executors."""
    path = f"{shared_folder(df.sparkSession)}/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables of ``written`` that nothing reads any more."""
    for df in tables:
        jvm = df.sparkSession._jvm
        path = jvm.org.apache.hadoop.fs.Path(df.written_to)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def struct_of(df: DataFrame, names: list[str]) -> Column:
    return F.struct(*[F.col(f"`{n}`") for n in names])


def small_side(df: DataFrame, most_rows: int) -> DataFrame:
    """A written table of few columns, marked for broadcast if its counted rows are at most ``most_rows``; else Spark joins by shuffle."""
    return F.broadcast(df) if df.count() <= most_rows else df


def own_names(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """For functions of documents that return their columns: columns that begin with two underscores, as the function's own do, have other names meanwhile."""

    @functools.wraps(f)
    def run(docs: DataFrame, *args, **options) -> DataFrame:
        away = {c: f"extra_{k}_{uuid.uuid4().hex}" for k, c in enumerate(docs.columns) if c.startswith("__")}
        if not away:
            return f(docs, *args, **options)
        return f(docs.withColumnsRenamed(away), *args, **options).withColumnsRenamed({v: k for k, v in away.items()})

    return run
