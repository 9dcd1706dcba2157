"""Training-metrics files as a long table.

A metrics file is one JSON object per training run with per-step and per-epoch arrays
(loss, perplexity, the running best validation loss) and a timestamp. Many runs' files are
read as one DataFrame (the run is the file name unless given) and turned into
``run, series, phase, granularity, idx, value`` rows with ``posexplode`` — each array
element becomes a row, so rollups over many runs are ordinary aggregations.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The series names of a metrics file.
SERIES = [
    "train_step_loss", "train_loss", "train_step_perplexity", "train_prep",
    "val_step_loss", "val_loss", "val_step_perplexity", "val_prep",
]
SCHEMA = ", ".join(f"{s} array<double>" for s in SERIES) + ", ts string"


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    """Metrics files under ``path`` (one JSON object per file, possibly pretty-printed)."""
    df = (spark.read.schema(SCHEMA).option("multiLine", "true").option("mode", "FAILFAST")
          .json(path))
    name = F.regexp_extract(F.input_file_name(), r"([^/]+?)(\.json)?$", 1)
    return df.withColumn("run", name)


def metrics_long(metrics: DataFrame, run_col: str = "run") -> DataFrame:
    """One row per array element: ``run, series, phase, granularity, idx, value``."""
    parts = []
    for s in SERIES:
        parts.append(F.struct(F.lit(s).alias("series"), F.col(s).alias("values")))
    exploded = metrics.select(run_col, F.explode(F.array(*parts)).alias("m"))
    long = exploded.select(run_col, F.col("m.series").alias("series"),
                           F.posexplode_outer("m.values").alias("idx", "value"))
    return (long.filter(F.col("idx").isNotNull())
            .withColumn("phase", F.substring_index("series", "_", 1))
            .withColumn("granularity", F.when(F.col("series").contains("_step_"), F.lit("step"))
                        .otherwise(F.lit("epoch")))
            .select(run_col, "series", "phase", "granularity", "idx", "value"))
