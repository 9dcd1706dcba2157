"""Incremental self-training pass over a stream of problem files (ST1).

Structured Streaming file source (``maxFilesPerTrigger`` problems files per micro-batch)
with ``foreachBatch``: each micro-batch runs forward selection (R3), the anti-join of
misses (R4) and rationalisation (R5) against stored generations, and appends both kept
sets as JSON lines (S4), each in a folder of the batch's own attempt. One commit record per batch
(``sources.manifest``) names both and holds the counts; readers follow the records, so a batch is read
wholly or not at all, whatever an attempt that failed between two outputs left behind, and a
replayed batch that was committed adds nothing. A batch reads only the generations between its lowest and highest
id; laid out by id (:func:`lay_out_by_id`), like the source files, they are pruned by the
files' statistics, so a batch's reading follows the batch, not the table. The outputs are
counted by the jobs that write them; running totals (A8) are a query over the batches' counts. ``trigger(availableNow)`` drains what
is there and stops; the streaming checkpoint makes a restarted run resume after the last
committed batch.
"""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators import selection as S
from ..operators.generate import TableGenerator
from ..plans.iteration import forward_pass, rationalize_pass
from ..session import materialize, materialize_observed, scratch_path, write_observed
from ..sources.jsonl import write_jsonl
from ..sources.manifest import Manifest
from ..sources.schemas import KEPT_ROW


def lay_out_by_id(generations: DataFrame, id_col: str = "id") -> DataFrame:
    """``generations`` written in files that each hold a range of ids, sorted by id."""
    path = scratch_path(generations.sparkSession, "generations-by-id")
    generations.repartitionByRange(id_col).sortWithinPartitions(id_col).write.parquet(path)
    return generations.sparkSession.read.parquet(path)


def process_batch(problems: DataFrame, forward: TableGenerator, rationalizer: TableGenerator,
                  profile: str = "hash_then_any") -> tuple[DataFrame, DataFrame]:
    """Forward-kept and rationalised-kept rows for one batch of problems (``id, question, answer``, a
    stored table)."""
    low, high = problems.agg(F.min("id"), F.max("id")).first()
    kept = materialize(forward_pass(problems, forward.between(low, high), profile=profile), "batch-kept")
    missed = S.missed_problems(problems.select("id", "question", "answer"), kept)
    return kept, rationalize_pass(missed, rationalizer.between(low, high), profile=profile)


def incremental_pass(spark: SparkSession, source_dir: str, source_schema: StructType | str,
                     to_problems: Callable[[DataFrame], DataFrame], forward: TableGenerator,
                     rationalizer: TableGenerator, out_root: str, max_files_per_trigger: int = 1,
                     profile: str = "hash_then_any", file_glob: str | None = None) -> Manifest:
    """Run the stream to completion; returns the commit records to read it by.

    ``to_problems`` maps a micro-batch of source rows to problems (``id, question,
    answer``) — e.g. a join with a static gold table. ``file_glob`` restricts the files of
    ``source_dir`` that the stream picks up."""
    manifest = Manifest(spark, out_root)
    ckpt = os.path.join(out_root, "_checkpoint")

    def each_batch(batch_df: DataFrame, batch_id: int) -> None:
        name = f"batch-{batch_id}"
        if manifest.committed(name):
            return
        problems, seen = materialize_observed(to_problems(batch_df), "batch-problems", {"n": F.count(F.lit(1))})
        record = {"batch_id": int(batch_id), "n": seen["n"], "paths": {}}
        kept, rat = process_batch(problems, forward, rationalizer, profile)
        for out, count, rows in (("forward", "fwd_kept", kept), ("rationalized", "rat_kept", rat)):
            path = manifest.attempt(out)
            record[count] = write_observed(rows, path, {"n": F.count(F.lit(1))}, write_jsonl)["n"]
            record["paths"][out] = path
        manifest.commit(name, record)

    reader = spark.readStream.schema(source_schema).option("maxFilesPerTrigger", max_files_per_trigger)
    if file_glob:
        reader = reader.option("pathGlobFilter", file_glob)
    src = reader.parquet(source_dir)
    q = (src.writeStream.foreachBatch(each_batch)
         .option("checkpointLocation", ckpt)
         .trigger(availableNow=True)
         .start())
    q.awaitTermination()
    return manifest


def stats(manifest: Manifest) -> DataFrame:
    """``batch_id, n, fwd_kept, rat_kept`` of the committed batches."""
    rows = [(r["batch_id"], r["n"], r["fwd_kept"], r["rat_kept"]) for r in manifest.records().values()]
    return manifest.spark.createDataFrame(rows, "batch_id bigint, n bigint, fwd_kept bigint, rat_kept bigint")


def progress(manifest: Manifest, every: int = 10) -> DataFrame:
    """A8 over the committed batches: running forward / rationalised kept totals reported
    after every ``every``-th micro-batch."""
    from ..operators.report import progress_counters
    return progress_counters(stats(manifest), every=every)


def read_outputs(manifest: Manifest) -> DataFrame:
    """Forward and rationalised rows of all committed batches (``src`` 0 / 1)."""
    spark, records = manifest.spark, manifest.records().values()

    def rows(out: str, src: int) -> DataFrame:
        paths = [r["paths"][out] for r in records]
        df = spark.read.schema(KEPT_ROW).option("mode", "FAILFAST").json(paths) if paths else spark.createDataFrame([], KEPT_ROW)
        return df.withColumn("src", F.lit(src))

    return rows("forward", 0).unionByName(rows("rationalized", 1))
