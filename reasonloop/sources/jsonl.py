"""JSON-lines sources and sinks.

* S1 ``read_jsonl``: explicit schema, FAILFAST (a malformed line fails the job instead of
  turning into a NULL row); blank lines are skipped by the reader.
* S2 ``read_jsonl(missing_ok=True)``: an absent path gives an empty frame of the schema.
* S3 ``write_jsonl``: overwrite; NULL fields are written (``ignoreNullFields=false``);
  ``ensure_ascii=True`` writes non-ASCII characters as ``\\uXXXX`` escapes (surrogate
  pairs above the BMP), the ASCII-only variant of the sink.
* S4 ``append_batch``: one folder per micro-batch ``batch_id=<n>``, overwritten on replay so
  a retried batch never duplicates rows.
"""

from __future__ import annotations

import json
import os
import re

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

_NON_ASCII = re.compile(r"[^\x00-\x7f]")


def _escape_char(m: re.Match) -> str:
    return json.dumps(m.group(0))[1:-1]


def _ascii_lines(lines: pd.Series) -> pd.Series:
    # per-row helper on Arrow batches: JSON text in, the same JSON with \\u escapes out
    return lines.map(lambda t: None if t is None else _NON_ASCII.sub(_escape_char, t))


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    jpath = jvm.org.apache.hadoop.fs.Path(path)
    fs = jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.exists(jpath)


def read_jsonl(spark: SparkSession, path: str, schema: StructType | str,
               missing_ok: bool = False) -> DataFrame:
    if missing_ok and not _exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def write_jsonl(df: DataFrame, path: str, mode: str = "overwrite", ensure_ascii: bool = False) -> None:
    if not ensure_ascii:
        df.write.mode(mode).option("ignoreNullFields", "false").json(path)
        return
    line = F.to_json(F.struct(*[F.col(c) for c in df.columns]), {"ignoreNullFields": "false"})
    ascii_json = F.pandas_udf(_ascii_lines, "string")
    df.select(ascii_json(line).alias("value")).write.mode(mode).text(path)


def append_batch(df: DataFrame, root: str, batch_id: int) -> str:
    """Write one micro-batch into ``root/batch_id=<n>`` (idempotent on replay)."""
    out = os.path.join(root, f"batch_id={batch_id}")
    write_jsonl(df, out, mode="overwrite")
    return out
