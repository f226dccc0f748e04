"""Structured Streaming: windows over events, incremental ingestion, state with a time to live."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from docmill.operators.state import manifest_diff


def event_stream(spark: SparkSession, path: str, schema, files_per_batch: int = 1) -> DataFrame:
    """Files of a folder as a stream; times without zone are read as UTC, since watermarks need a zone."""
    s = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)
    return s.withColumn("ts", F.col("ts").cast("timestamp"))


def tumbling(events: DataFrame, width: str, late: str | None = None) -> DataFrame:
    """(window_start, event_type, n, total, largest); rows later than ``late`` are dropped in a stream."""
    e = events.withWatermark("ts", late) if late else events
    g = e.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"), F.max("value").alias("largest"))
    return g.select(F.col("w.start").alias("window_start"), "event_type", "n", "total", "largest")


def sliding(events: DataFrame, width: str, step: str, late: str | None = None) -> DataFrame:
    e = events.withWatermark("ts", late) if late else events
    g = e.groupBy(F.window("ts", width, step).alias("w"), "event_type").agg(F.count("*").alias("n"))
    return g.select(F.col("w.start").alias("window_start"), "event_type", "n")


def sessions(events: DataFrame, gap: str, late: str | None = None) -> DataFrame:
    """(user_id, session_start, session_end, n): rows of a user no further apart than ``gap``."""
    e = events.withWatermark("ts", late) if late else events
    g = e.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"))
    return g.select("user_id", F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")


def without_repeats(events: DataFrame, late: str) -> DataFrame:
    """Each event id once, as far back as ``late``."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def enrich(events: DataFrame, static: DataFrame, on: str) -> DataFrame:
    """Stream joined with a table that is read anew for each batch."""
    return events.join(static, on, "left")


_MANIFEST = "path string, size long, mtime double, content_hash string, deleted boolean, batch long"


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def manifest(spark: SparkSession, path: str, before: int | None = None) -> DataFrame:
    """(path, size, mtime, content_hash, batch): the last state of each file that isn't deleted, of batches ``before`` a number."""
    if not _exists(spark, path):
        return spark.createDataFrame([], _MANIFEST).drop("deleted")
    m = spark.read.schema(_MANIFEST).parquet(path)
    if before is not None:
        m = m.where(F.col("batch") < before)  # a partition filter
    last = m.groupBy("path").agg(F.max(F.struct("batch", "size", "mtime", "content_hash", "deleted")).alias("m"))
    return last.where("not m.deleted").select("path", "m.size", "m.mtime", "m.content_hash", "m.batch")


def ingest_into(files: DataFrame, manifest_path: str, target: str, checkpoint: str, process):
    """Stream of (path, size, mtime, content_hash, …): each batch's new and modified files are processed.

    A row whose column ``deleted`` (if there is one) is true says that its file
    is gone. Rows and manifest of a batch lie in a folder of its number, the
    manifest is written last, and what has changed is told by the batches before
    it only; so a batch that is delivered again writes the same once more.
    Of a path that a batch has twice the last state counts. :func:`live_rows`
    reads the output without former versions and deleted files.
    """

    def batch(df: DataFrame, number: int) -> None:
        spark = df.sparkSession
        gone = F.coalesce("deleted", F.lit(False)) if "deleted" in df.columns else F.lit(False)
        state_of = df.groupBy("path").agg(F.max(F.struct("mtime", "size", "content_hash", gone.alias("deleted"))).alias("s")).select("path", "s.*")
        known = manifest(spark, manifest_path, number)
        here = state_of.where("not deleted").select("path", "size", "mtime", "content_hash")
        changed = manifest_diff(known.drop("batch"), here).where("change <> 'deleted'").select("path")
        fresh = df.where(~gone).join(here, ["path", "size", "mtime", "content_hash"], "left_semi").join(changed, "path", "left_semi")
        process(fresh).write.mode("overwrite").parquet(f"{target}/batch={number}")
        lost = state_of.where("deleted").join(known.select("path"), "path", "left_semi")
        rows = here.join(changed, "path", "left_semi").withColumn("deleted", F.lit(False)).unionByName(lost.select("path", "size", "mtime", "content_hash", "deleted"))
        rows.write.mode("overwrite").parquet(f"{manifest_path}/batch={number}")

    return files.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True)


def live_rows(spark: SparkSession, target: str, manifest_path: str) -> DataFrame:
    """Rows of :func:`ingest_into` (which must hold ``path``) of the last version of each file that isn't deleted."""
    return spark.read.parquet(target).join(manifest(spark, manifest_path).select("path", "batch"), ["path", "batch"], "left_semi")


def drop_stale(spark: SparkSession, target: str, manifest_path: str) -> list[str]:
    """Delete output folders of batches that no live file is in; returns what was deleted."""
    live = {r[0] for r in manifest(spark, manifest_path).select("batch").distinct().collect()}  # one row a batch
    root = spark._jvm.org.apache.hadoop.fs.Path(target)
    fs, gone = root.getFileSystem(spark._jsc.hadoopConfiguration()), []
    for f in fs.listStatus(root):
        name = f.getPath().getName()
        if name.startswith("batch=") and int(name[6:]) not in live:
            fs.delete(f.getPath(), True)
            gone.append(name)
    return sorted(gone)


class LatestWithin(StatefulProcessor):
    """Per key the last value, forgotten after a time to live; says of each row whether it was a hit."""

    def __init__(self, ttl_ms: int):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "value double", ttlDurationMs=self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        known = self.last.get()
        out = []
        for part in rows:
            for v in part["value"]:
                out.append({"key": key[0], "value": float(v), "hit": known is not None})
                known = (float(v),)
        if known is not None:
            self.last.update(known)
        yield pd.DataFrame(out, columns=["key", "value", "hit"])

    def close(self) -> None:
        pass


def ttl_cache(stream: DataFrame, ttl_ms: int) -> DataFrame:
    """(key, value, hit) of a stream (key, value); needs the RocksDB state store."""
    return stream.groupBy("key").transformWithStateInPandas(statefulProcessor=LatestWithin(ttl_ms), outputStructType="key string, value double, hit boolean", outputMode="Append", timeMode="ProcessingTime")
