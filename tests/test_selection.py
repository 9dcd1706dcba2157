"""Candidate selection, merges and retries on small hand-made tables."""

from pyspark.sql import functions as F

from reasonloop.operators import selection as S

PROBS = [(1, "q1", "#### 5"), (2, "q2", "#### 7"), (3, "q3", "#### 9")]
CANDS = [
    (1, 1, "I think #### 4"), (1, 2, "long way #### 5"), (1, 3, "#### 5"),
    (2, 1, "nothing"), (2, 2, "still nothing"),
    (3, 2, "## 9 #### 9"), (3, 1, "#### 9 "),
]


def _frames(spark):
    p = spark.createDataFrame(PROBS, "id bigint, question string, answer string")
    c = spark.createDataFrame(CANDS, "id bigint, cand_idx int, text string")
    return p, c


def test_keep_first_and_missed(spark):
    p, c = _frames(spark)
    kept = {r.id: (r.cand_idx, r.rationale, r.final) for r in S.keep_first_correct(c, p).collect()}
    assert kept == {1: (2, "long way #### 5", "#### 5"), 3: (1, "#### 9 ", "#### 9")}
    missed = [r.id for r in S.missed_problems(p, S.keep_first_correct(c, p)).collect()]
    assert missed == [2]


def test_first_correct_ignores_row_order(spark):
    p, c = _frames(spark)
    a = sorted(map(tuple, S.keep_first_correct(c, p).collect()))
    b = sorted(map(tuple, S.keep_first_correct(c.repartition(7).orderBy(F.rand(3)), p.repartition(3)).collect()))
    assert a == b


def test_shortest_correct_ties_go_to_earliest(spark):
    misses = spark.createDataFrame([(1, "q1", "#### 5"), (2, "q2", "#### 7")],
                                   "id bigint, question string, gold_answer string")
    outs = spark.createDataFrame([(1, 1, "xx #### 5"), (1, 2, "#### 5"), (1, 3, "#### 5"), (1, 4, "#### 6"),
                                  (2, 1, "#### 8")], "id bigint, cand_idx int, text string")
    rows = S.retry_shortest_correct(misses, outs).collect()
    assert [(r.id, r.cand_idx, r.output, r.em_after) for r in rows] == [(1, 2, "#### 5", True)]


def test_retry_keep_and_flag(spark):
    misses = spark.createDataFrame([(1, "q1", "#### 5"), (2, "q2", "#### 7")],
                                   "id bigint, question string, gold_answer string")
    outs = spark.createDataFrame([(1, "so #### 5"), (2, "#### 8")], "id bigint, text string")
    kept = S.retry_keep_correct(misses, outs).collect()
    assert [(r.id, r.em_after) for r in kept] == [(1, True)]
    flags = sorted((r.id, r.em_after) for r in S.retry_flag_all(misses, outs).collect())
    assert flags == [(1, True), (2, False)]


def test_merge_last_wins_across_and_within_sources(spark):
    a = spark.createDataFrame([(1, "a1", 0), (2, "a2", 1), (1, "a1-late", 2)], "id bigint, r string, ord int")
    b = spark.createDataFrame([(2, "b2", 0), (3, "b3", 1)], "id bigint, r string, ord int")
    m = S.merge_last_wins([a, b], order_col="ord").orderBy("pos").collect()
    assert [(x.id, x.r, x.src) for x in m] == [(1, "a1-late", 0), (2, "b2", 1), (3, "b3", 1)]


def test_collect_misses_backfill(spark):
    preds = spark.createDataFrame([
        ("hf_test_0", None, "#### 1", False),      # question missing -> both from dataset
        ("hf_test_1", "q1", "#### 2", True),        # correct -> not a miss
        ("hf_test_2", "q2", None, None),            # NULL em counts as a miss; gold missing
        ("other_3", None, "#### 4", False),         # no index -> dropped (question stays NULL)
        ("hf_test_9", "q9", "", False),             # empty gold, no backfill needed -> dropped
    ], "id string, question string, gold_answer string, em boolean")
    ds = spark.createDataFrame([(0, "Q0", "A0"), (1, "Q1", "A1"), (2, "Q2", "A2")],
                               "ordinal bigint, question string, answer string")
    got = sorted(tuple(r) for r in S.collect_misses(preds, ds).collect())
    assert got == [("hf_test_0", "Q0", "A0"), ("hf_test_2", "Q2", "A2")]


def test_collect_misses_strict(spark):
    import pytest
    preds = spark.createDataFrame([("hf_test_x", None, "#### 1", False)],
                                  "id string, question string, gold_answer string, em boolean")
    with pytest.raises(ValueError):
        S.collect_misses(preds, None, strict=True)


def test_training_rows_and_union(spark):
    r = spark.createDataFrame([("q1", "steps #### 1,000"), ("q2", "no final")], "question string, output string")
    correct = S.training_rows(r).collect()
    assert [(x.question, x.answer) for x in correct] == [("q1", "#### 1000")]
    keep = sorted((x.question, x.answer) for x in S.training_rows(r, correct_only=False).collect())
    assert keep == [("q1", "#### 1000"), ("q2", "")]
    u = S.cumulative_training_set(S.training_rows(r), S.training_rows(r))
    assert u.count() == 2  # bag union, no dedupe


def test_regroup_and_flatten(spark):
    _, c = _frames(spark)
    g = {r.id: (r.n_candidates, r.first_text, r.last_text) for r in S.regroup_candidates(c).collect()}
    assert g[1] == (3, "I think #### 4", "#### 5") and g[3] == (2, "#### 9 ", "## 9 #### 9")
    arr = spark.createDataFrame([(1, ["a", "b"])], "id int, texts array<string>")
    assert [tuple(r) for r in S.flatten_candidates(arr).collect()] == [(1, 1, "a"), (1, 2, "b")]


def test_first_and_shortest_with_a_hot_problem(spark):
    # problem 0 holds a third of all candidates; picks must be exact regardless
    rows = []
    for i in range(3000):
        pid = 0 if i % 3 == 0 else i % 97 + 1
        rows.append((pid, i, f"#### {i % 5}" + " pad" * (i % 7)))
    c = spark.createDataFrame(rows, "id bigint, cand_idx int, text string").repartition(8)
    p = spark.createDataFrame([(k, f"q{k}", "#### 3") for k in range(98)], "id bigint, question string, answer string")
    kept = {r.id: r.cand_idx for r in S.keep_first_correct(c, p).collect()}
    exp = {}
    for pid, i, t in sorted(rows, key=lambda r: r[1]):
        if t.startswith("#### 3") and pid not in exp:
            exp[pid] = i
    assert kept == exp
    misses = p.select("id", "question", F.col("answer").alias("gold_answer"))
    short = {r.id: r.cand_idx for r in S.retry_shortest_correct(misses, c).collect()}
    best = {}
    for pid, i, t in rows:
        if t.startswith("#### 3"):
            key = (len(t), i)
            if pid not in best or key < best[pid][0]:
                best[pid] = (key, i)
    assert short == {k: v[1] for k, v in best.items()}


def test_strict_backfill_refuses_an_index_outside_the_dataset(spark):
    import pytest
    preds = spark.createDataFrame([("hf_test_99", 0, None, None)], "id string, em int, question string, gold_answer string")
    data = spark.createDataFrame([(0, "q", "a")], "ordinal long, question string, answer string")
    with pytest.raises(ValueError):
        S.collect_misses(preds, data, strict=True)
