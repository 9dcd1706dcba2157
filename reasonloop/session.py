"""Spark session and shared-folder helpers.

The library never writes to a machine-local temporary folder on a cluster: every
intermediate that must survive executor loss goes under the folder named by
``spark.checkpoint.dir``. Only a local-mode session with no such setting (tests,
the bench) gets a private folder of its own.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession

_DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_spark(master: str | None = None, app: str = "reasonloop",
              shuffle_partitions: int | None = None,
              extra: dict[str, str] | None = None) -> SparkSession:
    """Build (or reuse) a session with AQE on, UTC time and no UI server."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for k, v in _DEFAULT_CONF.items():
        builder = builder.config(k, v)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in (extra or {}).items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def _is_local(spark: SparkSession) -> bool:
    return spark.sparkContext.master.startswith("local")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder, setting a private one only in local mode."""
    sc = spark.sparkContext
    d = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if d:
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(d)
        return sc.getCheckpointDir() or d
    if not _is_local(spark):
        raise RuntimeError(
            "spark.checkpoint.dir is not set; a cluster run needs a shared folder for "
            "lineage cuts and intermediate tables")
    d = tempfile.mkdtemp(prefix="reasonloop-ckpt-")
    spark.conf.set("spark.checkpoint.dir", d)
    sc.setCheckpointDir(d)
    return sc.getCheckpointDir() or d


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique folder path under the shared checkpoint folder."""
    base = ensure_checkpoint_dir(spark)
    return os.path.join(base, "reasonloop", f"{name}-{uuid.uuid4().hex[:12]}")


def materialize(df, name: str):
    """Write ``df`` once under the shared checkpoint folder and return it read back.

    Cuts the lineage (a lost executor re-reads the table instead of recomputing its plan)
    and lets a table that several branches of one query read be computed once."""
    path = scratch_path(df.sparkSession, name)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def write_observed(df: DataFrame, path: str, metrics: dict[str, Column], write=None) -> dict:
    """Write ``df`` to ``path`` (Parquet, or ``write(df, path)``) and return ``metrics`` (name -> aggregate), which are
    gathered by the very job that writes: no second pass reads the table for them."""
    seen = Observation(f"observed-{uuid.uuid4().hex}")
    watched = df.observe(seen, *[m.alias(name) for name, m in metrics.items()])
    if write is None:
        watched.write.mode("overwrite").parquet(path)
    else:
        write(watched, path)
    return dict(seen.get)


def materialize_observed(df: DataFrame, name: str, metrics: dict[str, Column]) -> tuple[DataFrame, dict]:
    """:func:`materialize` and the metrics of the written rows, in one pass."""
    path = scratch_path(df.sparkSession, name)
    seen = write_observed(df, path, metrics)
    return df.sparkSession.read.parquet(path), seen
