"""Tables of a database as Parquet snapshots, and the transfer of a namespace from one to another."""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.literals import under
from ..operators.predict import WEIGHTS, pruned

SCHEMAS = {
    "values": "key long, payload string",
    "pairs": "name string, key long, hidden boolean",
    "nodes": "id string, labels array<string>, props string, created_at timestamp, updated_at timestamp",
    "edges": "id string, src string, dst string, type string, directed boolean, weight double, confidence double, modality string, ambiguity string, props string",
    "sentences": "node string, ref string, ordinal int, text string, source string",
    "pred": f"table string, key string, value string, score double, weights {WEIGHTS}",
    "links": "src string, dst string, score double, distance long, sources long, observations long, hits long, created double, refreshed double, used double",
    "answers": "signature string, epoch long, members array<struct<node:string,score:double>>, score double, observations long, hits long, created double, refreshed double, used double",
}


#: Seconds for which a snapshot stays after another has taken its place.
RETENTION = 3600.0


class Folder:
    """A folder of tables on any file system that Spark reads.  A write makes a new snapshot; the pointer moves when the snapshot is whole."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        self._fs = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def load(self, name: str) -> str | None:
        at = self._at(name)
        if not self._fs.exists(at):
            return None
        stream = self._fs.open(at)
        try:
            return self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def save(self, name: str, text: str) -> None:
        stream = self._fs.create(self._at(name), True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()

    def listed(self) -> list[str]:
        if not self._fs.exists(self._at("")):
            return []
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._at("")) if s.isDirectory())

    def drop(self, name: str = "") -> None:
        self._fs.delete(self._at(name), True)

    def table(self, name: str, schema: str | T.StructType | None = None) -> DataFrame:
        schema = schema or SCHEMAS[name]
        current = self.load(f"{name}.current")
        if current is None:
            return self.spark.createDataFrame([], schema)
        if current.startswith("{"):  # buckets
            paths = [f"{self.path}/{name}/{p}" for p in json.loads(current).values()]
            return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}/{current}")

    def buckets(self, name: str, numbers: list[int]) -> DataFrame | None:
        """The rows of some buckets of a table; None if the table isn't kept in buckets."""
        current = self.load(f"{name}.current")
        if current is None or not current.startswith("{"):
            return None
        held = json.loads(current)
        paths = [f"{self.path}/{name}/{held[str(n)]}" for n in numbers if str(n) in held]
        return self.spark.read.schema(SCHEMAS[name]).parquet(*paths) if paths else self.spark.createDataFrame([], SCHEMAS[name])

    def replace_buckets(self, name: str, rows: DataFrame, column: str, numbers: list[int]) -> None:
        """Writes some buckets of a table anew, whose number is in a column; the others stay where they are."""
        old, new = self.load(f"{name}.current") or "{}", uuid.uuid4().hex
        rows.repartition(column).write.partitionBy(column).parquet(f"{self.path}/{name}/{new}")
        held = json.loads(old) if old.startswith("{") else {}
        there = {s.getPath().getName() for s in self._fs.listStatus(self._at(f"{name}/{new}"))}
        late = [p for n, p in held.items() if int(n) in numbers] if old.startswith("{") else [old]
        held = {n: p for n, p in held.items() if int(n) not in numbers} | {str(n): f"{new}/{column}={n}" for n in numbers if f"{column}={n}" in there}
        self._succeed(name, json.dumps(held), late)

    def replace(self, name: str, rows: DataFrame) -> None:
        """Writes a snapshot and makes it the current one.  Earlier ones stay for ``RETENTION`` seconds, so that what reads them can end."""
        old, new = self.load(f"{name}.current") or "{}", uuid.uuid4().hex
        rows.write.parquet(f"{self.path}/{name}/{new}")
        self._succeed(name, new, [*json.loads(old).values()] if old.startswith("{") else [old])

    def _succeed(self, name: str, current: str, late: list[str]) -> None:
        """Moves the pointer; what it no longer names is dropped when its time is over."""
        self.save(f"{name}.current", current)
        now, left = time.time(), []
        for at, version in json.loads(self.load(f"{name}.earlier") or "[]") + [[now, p] for p in late]:
            if now - at < RETENTION:
                left.append([at, version])
            else:
                self.drop(f"{name}/{version}")
        self.save(f"{name}.earlier", json.dumps(left))


def export_fork(pairs: DataFrame, values: DataFrame, pred: DataFrame, prefix: str, path: str) -> None:
    """All names under a prefix with their payloads, and the prediction entries of keys under it, as two tables."""
    own = pairs.where(under(F.col("name"), prefix))
    own.join(values, "key", "left").select("name", "payload", "hidden").write.mode("overwrite").parquet(f"{path}/pairs")
    pruned(pred.where(under(F.col("key"), prefix))).write.mode("overwrite").parquet(f"{path}/pred")


def import_fork(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(name, payload, hidden) and prediction entries of an exported fork."""
    return spark.read.parquet(f"{path}/pairs"), spark.read.parquet(f"{path}/pred")


def save_predictions(pred: DataFrame, path: str) -> None:
    """Entries without weights of next to no size."""
    pruned(pred).write.mode("overwrite").parquet(path)


def settings_text(settings: dict[str, object]) -> str:
    return json.dumps(settings, sort_keys=True)
