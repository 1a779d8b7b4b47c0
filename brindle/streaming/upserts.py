"""Streams of writes: edges folded into a table batch by batch, and counts of events by window."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.graph import upsert_edges
from ..sources.snapshots import Folder


def edge_writes(events: DataFrame) -> DataFrame:
    """Writes of edges (user, did, type) from events; ``events`` may be a stream."""
    return events.select(
        F.col("event_id").alias("seq"), F.concat(F.lit("user:"), F.col("user_id").cast("string")).alias("src"), F.concat(F.lit("type:"), "event_type").alias("dst"), F.lit("did").alias("type"),
        F.lit(True).alias("directed"), F.least(F.lit(1.0), F.abs("value") / 500).alias("weight"), F.lit(None).cast("double").alias("confidence"),
        F.lit(None).cast("string").alias("modality"), F.lit(None).cast("string").alias("ambiguity"), "props",
    )


def fold(table: DataFrame, writes: DataFrame) -> DataFrame:
    """The table's edges after later writes."""
    first = writes.agg(F.min("seq").alias("s"))
    old = table.drop("id").crossJoin(F.broadcast(first)).withColumn("seq", F.coalesce("s", F.lit(0)) - 1).drop("s")  # one row
    return upsert_edges(old.unionByName(writes))


#: Parts that the followed table is kept in; a batch reads and writes those its edges belong to.
BUCKETS = 64


def bucketed(edges: DataFrame) -> DataFrame:
    return edges.withColumn("__bucket", F.pmod(F.xxhash64("src", "dst", "type", "directed"), F.lit(BUCKETS)).cast("int"))


def follow_edges(writes: DataFrame, folder: Folder, checkpoint: str) -> StreamingQuery:
    """Folds each batch into the folder's ``edges``, once: a batch number that was written is skipped when it comes again.

    The table is kept in buckets by edge, and only those that a batch writes to are read and written anew.
    """

    def one(batch: DataFrame, number: int) -> None:
        done = folder.load("edges.batch")
        if done is not None and int(done) >= number:
            return
        numbers = sorted(r[0] for r in bucketed(batch).select("__bucket").distinct().collect())  # BUCKETS at most
        old = folder.buckets("edges", numbers)
        if old is None:  # the first batch: all of the table is put in buckets
            old, numbers = folder.table("edges"), list(range(BUCKETS))
        if numbers:
            folder.replace_buckets("edges", bucketed(fold(old, batch)), "__bucket", numbers)
        folder.save("edges.batch", str(number))

    return writes.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(one).start()


def read_events(spark: SparkSession, path: str, files: int = 1) -> DataFrame:
    """A folder of event files as a stream; ts as a timestamp, which watermarks need."""
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))


def windowed_counts(events: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events and their values by type and window, those later than the watermark being dropped."""
    return (
        events.withWatermark("ts", late).groupBy(F.window("ts", window).alias("w"), "event_type")
        .agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")
    )
