"""Intermediate tables in the folder that all executors share.

Iterative operators cut their lineage here: a written Parquet table survives
the loss of an executor and, unlike a checkpointed RDD, keeps column pruning
and size statistics for the next plan.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}
_WRITTEN: list[tuple[SparkSession, str]] = []


def folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; a local session without one (tests) gets one folder of its own."""
    sc = spark.sparkContext
    own = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if own:
        return own
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if sc.applicationId not in _OWN:
        _OWN[sc.applicationId] = tempfile.mkdtemp(prefix="docmill-scratch-")
    return _OWN[sc.applicationId]


def stage(df: DataFrame, name: str, sort_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and return it as read from there.

    This runs a job. The table stays until :func:`clear`, at the latest until the process ends.
    """
    spark = df.sparkSession
    path = f"{folder(spark)}/docmill/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    _WRITTEN.append((spark, path))
    (df.sortWithinPartitions(*sort_by) if sort_by else df).write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def clear(spark: SparkSession | None = None) -> None:
    """Delete the intermediate tables that this process has written."""
    keep = []
    for s, path in _WRITTEN:
        if spark is not None and s is not spark:
            keep.append((s, path))
            continue
        try:
            p = s._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(s._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # the session has ended; the folder goes with the application
            pass
    _WRITTEN[:] = keep


atexit.register(clear)
