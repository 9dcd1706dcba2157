"""ST1: several micro-batches give the same kept rows as the batch iteration; a replay
of the same stream adds nothing."""

import os
import tempfile

import pytest
from pyspark.sql import functions as F

from reasonloop.operators.generate import TableGenerator
from reasonloop.plans import catalog
from reasonloop.plans import fixture as FX
from reasonloop.sources.manifest import Manifest
from reasonloop.streaming import incremental as ST
from tests.conftest import SF_SMALL


def test_micro_batches_equal_batch(spark):
    src = tempfile.mkdtemp(prefix="rl-stream-src-")
    FX.table(spark, SF_SMALL, "orders").repartition(4).write.mode("overwrite").parquet(os.path.join(src, "orders"))
    golds = FX.order_golds(spark, SF_SMALL)
    lines = FX.numbered_lines(spark, SF_SMALL)
    out = tempfile.mkdtemp(prefix="rl-stream-out-")
    args = (spark, os.path.join(src, "orders"), FX.table(spark, SF_SMALL, "orders").schema,
            lambda b: FX.problems_from_orders(b, golds),
            TableGenerator(FX.candidates(spark, SF_SMALL, lines=lines)),
            TableGenerator(FX.candidates(spark, SF_SMALL, shift=catalog.RATIONALIZE_SHIFT, lines=lines)),
            out)
    paths = ST.incremental_pass(*args, max_files_per_trigger=1)
    stats = ST.stats(paths)
    assert stats.count() == 4
    streamed = ST.read_outputs(paths).select("id", "rationale", "src")
    batch = catalog.one_iteration(spark, SF_SMALL)
    b = sorted((r.id, r.src) for r in batch.collect())
    s = sorted((r.id, r.src) for r in streamed.collect())
    assert s == b
    # restart with the same checkpoint: nothing new, nothing duplicated
    ST.incremental_pass(*args, max_files_per_trigger=1)
    assert ST.read_outputs(paths).count() == len(b)
    totals = stats.agg(F.sum("fwd_kept"), F.sum("rat_kept")).collect()[0]
    assert totals[0] + totals[1] == len(b)
    last = ST.progress(paths, every=2).orderBy("batch_id").collect()
    assert [r.batch_id for r in last] == [1, 3]
    assert last[-1].cum_fwd_kept + last[-1].cum_rat_kept == len(b)


def test_a_batch_is_read_wholly_or_not(spark, monkeypatch):
    src, out = tempfile.mkdtemp(prefix="rl-stream-src-"), tempfile.mkdtemp(prefix="rl-stream-out-")
    FX.table(spark, SF_SMALL, "orders").limit(60).repartition(3).write.mode("overwrite").parquet(os.path.join(src, "orders"))
    golds, lines = FX.order_golds(spark, SF_SMALL), FX.numbered_lines(spark, SF_SMALL)
    args = (spark, os.path.join(src, "orders"), FX.table(spark, SF_SMALL, "orders").schema,
            lambda b: FX.problems_from_orders(b, golds), TableGenerator(FX.candidates(spark, SF_SMALL, lines=lines)),
            TableGenerator(FX.candidates(spark, SF_SMALL, shift=catalog.RATIONALIZE_SHIFT, lines=lines)), out)
    written, plain = [], ST.write_jsonl

    def lost_between_two_outputs(df, path):
        if len(written) == 3:                                # the second batch, its first output written
            raise OSError("sink lost")
        written.append(path)
        plain(df, path)

    monkeypatch.setattr(ST, "write_jsonl", lost_between_two_outputs)
    with pytest.raises(Exception, match="sink lost"):
        ST.incremental_pass(*args)
    manifest = Manifest(spark, out)
    assert [r["batch_id"] for r in manifest.records().values()] == [0]
    first = sorted(map(tuple, ST.read_outputs(manifest).collect()), key=str)
    assert len(first) == sum(r.fwd_kept + r.rat_kept for r in ST.stats(manifest).collect())
    monkeypatch.setattr(ST, "write_jsonl", plain)
    done = ST.incremental_pass(*args)
    assert sorted(r["batch_id"] for r in done.records().values()) == [0, 1, 2]
    rows = [(r.id, r.src) for r in ST.read_outputs(done).collect()]
    assert len(rows) == len(set(rows)) == ST.stats(done).agg(F.sum(F.col("fwd_kept") + F.col("rat_kept"))).first()[0]
    assert {(r[0], r[-1]) for r in first} <= set(rows)
