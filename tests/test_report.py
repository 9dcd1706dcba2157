"""Accuracy denominators, counters, loss rollup, mismatch listings."""

import math

from pyspark.sql import functions as F

from reasonloop.operators import report as R


def test_accuracy_denominators(spark):
    df = spark.createDataFrame([(1,), (0,), (None,), (1,)], "em int")
    a1 = R.em_accuracy(df).collect()[0]
    assert (a1.n, a1.correct, a1.accuracy) == (4, 2, 0.5)
    a2 = R.em_accuracy_gold_only(df).collect()[0]
    assert (a2.total, a2.n_gold, a2.correct) == (4, 3, 2) and abs(a2.accuracy - 2 / 3) < 1e-12
    empty = spark.createDataFrame([(None,)], "em int")
    assert R.em_accuracy_gold_only(empty).collect()[0].accuracy == 0.0


def test_compare_experiments_and_parse_ok(spark):
    a = spark.createDataFrame([(1, "x #### 1"), (0, "y")], "em int, generated string")
    b = spark.createDataFrame([(None, "#### 2")], "em int, generated string")
    out = {r.label: r for r in R.compare_experiments({"a": a, "b": b}).collect()}
    assert (out["a"].total, out["a"].n_gold, out["a"].correct, out["a"].parse_ok) == (2, 2, 1, 1)
    assert (out["b"].n_gold, out["b"].accuracy, out["b"].parse_ok) == (0, 0.0, 1)


def test_running_totals_across_blocks(spark):
    rows = [(i, i % 3) for i in range(0, 250)]
    df = spark.createDataFrame(rows, "batch_id bigint, v bigint")
    out = {r.batch_id: r.cum_v for r in R.running_totals(df, "batch_id", ["v"], block_size=16).collect()}
    acc = 0
    for i, v in rows:
        acc += v
        assert out[i] == acc


def test_progress_counters_every_p(spark):
    df = spark.createDataFrame([(i, 1, 2) for i in range(25)], "batch_id bigint, fwd_kept bigint, rat_kept bigint")
    out = sorted((r.batch_id, r.cum_fwd_kept, r.cum_rat_kept) for r in R.progress_counters(df, every=10).collect())
    assert out == [(9, 10, 20), (19, 20, 40)]


def test_loss_rollup(spark):
    log = spark.createDataFrame([
        (1, "train", 0, 0.5), (1, "train", 0, None), (1, "train", 1, 0.2), (1, "train", 1, 0.2),
        (1, "train", 2, 0.9)], "run int, phase string, epoch int, loss double")
    out = {r.epoch: r for r in R.loss_rollup(log).collect()}
    assert abs(out[0].epoch_loss - 0.25) < 1e-12          # skipped batch: 0 in sum, 1 in count
    assert abs(out[1].perplexity - math.exp(0.2)) < 1e-12
    assert abs(out[2].best_loss - 0.2) < 1e-12             # running best
    assert abs(out[2].avg_perplexity - (math.exp(0.25) + math.exp(0.2) + math.exp(0.9)) / 3) < 1e-12


def test_top_mismatches_global_and_grouped(spark):
    df = spark.createDataFrame([(i, i % 2, "v" + str(i % 3)) for i in range(30)], "ordinal int, em int, variant string")
    top = [r.ordinal for r in R.top_mismatches(df, 4).collect()]
    assert top == [0, 2, 4, 6]
    grouped = R.top_mismatches(df, 2, group_by=["variant"]).collect()
    got = sorted((r.variant, r.ordinal) for r in grouped)
    assert got == [("v0", 0), ("v0", 6), ("v1", 4), ("v1", 10), ("v2", 2), ("v2", 8)]


def test_zero_shot_record(spark):
    df = spark.createDataFrame([("Q", "  step one\n\n step two \nThe answer is 18.\n", "#### 18"),
                                ("Q", "x", "")], "question string, generated string, gold string")
    rows = R.zero_shot_record(df).collect()
    assert rows[0].rationale == "step one\nstep two" and rows[0].answer == "18" and rows[0].em == 1
    assert rows[1].em is None and rows[1].gold_extracted == ""


def test_stage_report(spark):
    df = spark.createDataFrame([(1,), (0,)], "em int")
    rep = R.stage_report("r", [("s", "n", df, F.count(F.lit(1))), ("s", "em", df, F.avg("em"))]).collect()
    assert sorted((r.metric, r.value) for r in rep) == [("em", 0.5), ("n", 2.0)]


def test_parse_ok_count(spark):
    df = spark.createDataFrame([("a #### 1", "x"), ("none", "x"), (None, "y")], "generated string, g string")
    out = {r.g: r.parse_ok for r in R.parse_ok_count(df, group_by=["g"]).collect()}
    assert out == {"x": 1, "y": 0}
