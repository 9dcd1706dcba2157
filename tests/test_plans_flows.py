"""Generic evaluation flows and one iteration with Python generators."""

import re

from reasonloop.plans import evaluate as EV
from reasonloop.plans.iteration import run_iteration


def _answering(correct_below):
    def fn(prompts, k):
        out = []
        for p in prompts:
            n = int(re.search(r"problem (\d+)", p).group(1))
            out.append([f"step one\nstep two\nThe answer is {n if n < correct_below else -1}\n#### {n if n < correct_below else -1}"] * k)
        return out
    return fn


def _problems(spark, n=12):
    return spark.createDataFrame([(i, i, f"problem {i}", f"work\n#### {i}") for i in range(n)],
                                 "id bigint, ordinal bigint, question string, answer string")


def test_zero_shot_and_batched_and_sampled(spark):
    probs = _problems(spark)
    recs, acc = EV.zero_shot_eval(probs, _answering(6))
    a = acc.collect()[0]
    assert (a.total, a.n_gold, a.correct) == (12, 12, 6)
    r0 = [r for r in recs.collect() if r.id == 0][0]
    assert r0.rationale == "step one\nstep two\nThe answer is 0" and r0.answer == "0" and r0.em == 1
    preds, acc = EV.batched_eval(probs, _answering(3), num_shards=2, shard_idx=0)
    rows = sorted((r.id, r.em) for r in preds.collect())
    assert [r[0] for r in rows] == [f"hf_test_{i}" for i in (0, 1, 2, 3, 4, 5)]
    assert acc.collect()[0].correct == 3
    preds, acc = EV.sampled_eval(probs, _answering(4))
    assert acc.collect()[0].correct == 4
    assert {r.id: r.pred_final for r in preds.collect()}[2] == "2"


def test_run_iteration_with_python_generators(spark):
    probs = _problems(spark).select("id", "question", "answer")
    res = run_iteration(probs, _answering(5), _answering(9), k=2)
    assert res.forward.count() == 5 and res.rationalized.count() == 4
    train = res.train.collect()
    assert len(train) == 9 and all(r.text.startswith("###Input:\nproblem") for r in train)


def test_batched_eval_limit_cuts_inside_the_shard(spark):
    probs = _problems(spark)
    preds, acc = EV.batched_eval(probs, _answering(100), num_shards=2, shard_idx=1, limit=2)
    assert sorted(r.id for r in preds.collect()) == ["hf_test_6", "hf_test_7"]
    assert acc.collect()[0].correct == 2
