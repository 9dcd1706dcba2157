"""The loop with Python generators (mapInPandas path), cumulative training sets,
early stop when nothing is missed, and the train/test overlap guard."""

import re
import tempfile

import pytest

from reasonloop.plans import selftrain as ST


def _model_generator(level):
    # the stand-in model answers problem n correctly when n < level
    def fn(prompts, k):
        out = []
        for p in prompts:
            n = int(re.search(r"problem (\d+)", p).group(1))
            out.append([f"work\n#### {n if n < level else n + 1}"] * k)
        return out
    return fn


def test_loop_report_and_early_stop(spark):
    rows = [(i, f"problem {i}", f"#### {i}") for i in range(40)]
    probs = spark.createDataFrame(rows, "id bigint, question string, answer string")
    train, test = probs.filter("id < 30"), probs.filter("id >= 30")
    hooks = ST.LoopHooks(
        generator_for=lambda m, purpose: _model_generator(10 * (m + 1) + (10 if purpose == "retry" else 0)),
        train=lambda start, path, it: start + 1)
    rep = ST.run_self_training(spark, train, test, hooks, 0, tempfile.mkdtemp(prefix="rl-loop-"),
                               iterations=5, run="t")
    got = {(r.iter, r.metric): r.value for r in rep.collect()}
    assert got[(1, "em")] == 0.0
    assert (got[(2, "misses")], got[(2, "kept_correct")], got[(2, "train_size")]) == (20, 10, 10)
    assert (got[(3, "misses")], got[(3, "kept_correct")], got[(3, "train_size")]) == (10, 10, 20)
    assert got[(4, "misses")] == 0 and got[(4, "stopped_early")] == 1
    assert not any(it > 4 for it, _ in got)


def test_overlap_refused(spark):
    probs = spark.createDataFrame([(1, "problem 1", "#### 1")], "id bigint, question string, answer string")
    hooks = ST.LoopHooks(generator_for=lambda m, p: _model_generator(0), train=lambda s, p, i: s)
    with pytest.raises(ValueError):
        ST.run_self_training(spark, probs, probs, hooks, 0, tempfile.mkdtemp(prefix="rl-loop-"))


def test_keep_all_without_early_stop(spark):
    rows = [(i, f"problem {i}", f"#### {i}") for i in range(20)]
    probs = spark.createDataFrame(rows, "id bigint, question string, answer string")
    train, test = probs.filter("id < 15"), probs.filter("id >= 15")
    hooks = ST.LoopHooks(generator_for=lambda m, purpose: _model_generator(100), train=lambda s, p, i: s)
    rep = ST.run_self_training(spark, train, test, hooks, 0, tempfile.mkdtemp(prefix="rl-loop-"),
                               iterations=2, keep_all=True, stop_early=False, restart="from_base")
    got = {(r.iter, r.metric): r.value for r in rep.collect()}
    # every problem is answered correctly: no misses, yet both rounds run
    assert got[(2, "misses")] == 0 and got[(3, "misses")] == 0 and (3, "em") in got
    assert got[(3, "em")] == 1.0


def test_baseline_stage(spark):
    rows = [(i, f"problem {i}", f"#### {i}") for i in range(40)]
    probs = spark.createDataFrame(rows, "id bigint, question string, answer string")
    train, test = probs.filter("id < 30"), probs.filter("id >= 30")
    seen = []

    def fit(start, path, it):
        seen.append((start, it, spark.read.parquet(path).count()))
        return start + 1

    hooks = ST.LoopHooks(generator_for=lambda m, purpose: _model_generator(10 * (m + 1) + (10 if purpose == "retry" else 0)),
                         train=fit)
    baseline = train.selectExpr("question", "'worked' AS rationale", "answer")
    rep = ST.run_self_training(spark, train, test, hooks, 0, tempfile.mkdtemp(prefix="rl-loop-"),
                               iterations=1, run="t", baseline_set=baseline)
    got = {(r.iter, r.stage, r.metric): r.value for r in rep.collect()}
    # the first round starts from the fine-tuned model (answers 0..19): ten misses, not twenty
    assert got[(1, "zero_shot", "em")] == 0.0 and got[(1, "baseline", "em")] == 0.0
    assert got[(2, "loop", "misses")] == 10 and got[(2, "loop", "train_size")] == 10
    assert seen == [(0, 1, 30), (1, 2, 10)]


def test_iteration_trains_and_evaluates(spark):
    from reasonloop.plans.iteration import run_iteration
    rows = [(i, f"problem {i}", f"#### {i}") for i in range(20)]
    probs = spark.createDataFrame(rows, "id bigint, question string, answer string")
    gen = _model_generator(5)
    res = run_iteration(probs.filter("id < 10"), gen, _model_generator(100), k=2,
                        train=lambda path: spark.read.parquet(path).count(),
                        test_problems=probs.filter("id >= 10"), generator_for=lambda model: _model_generator(model + 5))
    assert res.model == 10 and res.train.count() == 10
    acc = res.accuracy.first()
    assert (acc.n, acc.correct) == (10, 5) and res.predictions.count() == 10
    with pytest.raises(ValueError):
        run_iteration(probs, gen, gen, test_problems=probs)


def test_a_stopped_loop_goes_on_where_it_was(spark):
    rows = [(i, f"problem {i}", f"#### {i}") for i in range(40)]
    probs = spark.createDataFrame(rows, "id bigint, question string, answer string")
    train, test = probs.filter("id < 30"), probs.filter("id >= 30")
    trained = []

    def hooks(lost_at=None):
        def train_model(start, path, it):
            if it == lost_at:
                raise ConnectionError("trainer lost")
            trained.append(it)
            return f"m{int(start[1:]) + 1}"

        return ST.LoopHooks(generator_for=lambda m, purpose: _model_generator(10 * int(m[1:]) + (10 if purpose == "retry" else 0)),
                            train=train_model, save=lambda m: {"name": m}, load=lambda s: s["name"])

    def run(root, **how):
        rep = ST.run_self_training(spark, train, test, hooks(**how), "m0", root, iterations=2, run="t")
        return sorted(map(tuple, rep.collect()))

    whole = run(tempfile.mkdtemp(prefix="rl-loop-"))
    root = tempfile.mkdtemp(prefix="rl-loop-")
    trained.clear()
    for lost_at in (2, 3):
        with pytest.raises(ConnectionError):
            run(root, lost_at=lost_at)
    assert run(root) == whole and trained == [2, 3]
    assert run(root) == whole and trained == [2, 3]            # nothing is left to run, no row is added
