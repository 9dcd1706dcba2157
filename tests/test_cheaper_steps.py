"""Steps that were made cheaper: the same values, by fewer joins, jobs and scans."""

import re

from pyspark.sql import functions as F

from reasonloop.functions import answers as A
from reasonloop.functions.records import rationale_from_generation
from reasonloop.operators.generate import TableGenerator
from reasonloop.operators.genstore import PromptStore, prompt_key
from reasonloop.operators.merge import MergedTable
from reasonloop.operators.selection import merge_last_wins
from reasonloop.operators.skew import BLOCK_CONF, block_join
from reasonloop.session import scratch_path

NUMBERS = ["5", "0", "007", "-0", "+5", "5.", "5.0", "1,234", ",  5", "5 .", "- 5", "x5", "$5", "'", "٣", "1e3", "1_000", ".5", "", " ", None,
           "999999999999999", "9999999999999999", "1234567890123456789", "no number here", "\x005", "5\x00", "1d", "inf", "½"]


def test_staged_normalisers_equal_the_plain_ones(spark):
    df = spark.createDataFrame([(t,) for t in NUMBERS], "text string")
    for profile in ("integral", "rounded"):
        staged = A.with_normalized(df, profile, "text", "got").withColumn("want", A.normalize(profile, F.col("text")))
        for r in staged.collect():
            assert r.got == r.want, (profile, r.text, r.got, r.want)


def test_a_short_integer_is_not_cast(spark):
    plan = A.with_normalized(spark.createDataFrame([("5",)], "text string"), "integral", "text", "n")._jdf.queryExecution().optimizedPlan().toString()
    assert "CASE WHEN __ns_null" in plan and "WHEN __ns_i" in plan


def test_keys_of_marked_and_unmarked_golds(spark):
    texts = ["#### 1,234 ", "a #### -5.50 b", " $7 ", "x\t", None, "", "####", "#### -", "12 and 13", " 1,2 "]
    df = spark.createDataFrame([(g, t) for g in texts for t in texts], "gold string, text string")
    for profile in ("hash_loose", "hash_then_any"):
        d = A.with_em(df, profile, "gold", "text", "got").withColumn("want", A.score(profile, F.col("gold"), F.col("text")))
        assert all(r.got == r.want for r in d.collect()), profile


def test_cues_are_looked_for_only_where_their_word_stands(spark):
    d = A.with_cascades(spark.createDataFrame([("a",)], "text string"), "text", {"cascade_first": "x"})
    plan = d._jdf.queryExecution().optimizedPlan().toString()
    assert "Contains(__xs_low" in plan and "lambdafunction" not in plan


def test_rationale_of_texts_with_and_without_breaks(spark):
    texts = ["a", "a\nb", "\na\n", "a b\x85c", "a\x1cb", " \n ", "", None, "a\r\nb"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(rationale_from_generation(F.col("t"))).collect()
    want = [None if t is None else "\n".join(x[:-1]) if len(x := [p.strip() for p in t.splitlines() if p.strip()]) > 1 else t.strip() for t in texts]
    assert [r[0] for r in got] == want


def _jobs(spark, run):
    sc = spark.sparkContext
    sc.setJobGroup("counted", "counted")
    try:
        run()
        return len(sc.statusTracker().getJobIdsForGroup("counted"))
    finally:
        sc._jsc.clearJobGroup()


def test_a_known_highest_position_needs_no_look_at_the_rows(spark):
    fact = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (2, 1, "c")], "id int, cand_idx int, text string")
    dim = spark.createDataFrame([(1,), (3,)], "id int")
    assert _jobs(spark, lambda: block_join(fact, dim, "id", highest=2)) == 0
    assert _jobs(spark, lambda: TableGenerator(fact)(dim, k=1)) == 0
    spark.conf.set(BLOCK_CONF, "1")
    try:
        assert sorted(map(tuple, block_join(fact, dim, "id", highest=2).collect())) == [(1, 1, "a"), (1, 2, "b")]
    finally:
        spark.conf.unset(BLOCK_CONF)


def test_every_asked_prompt_is_answered_or_silent(spark):
    asked = spark.createDataFrame([(1, "p"), (2, "q"), (3, None), (4, "p")], "id int, prompt string")
    gens = spark.createDataFrame([("p", 1, "x"), ("p", 2, "y"), (None, 1, "z"), ("r", 1, "w")], "prompt string, cand_idx int, text string")
    gens = gens.select(prompt_key("prompt").alias("prompt_key"), "cand_idx", "text")
    want = {(1, 1, "x"), (1, 2, "y"), (4, 1, "x"), (4, 2, "y"), (2, None, None), (3, None, None)}
    plans = []
    for highest in (2, None):
        store = PromptStore(gens, highest=highest)
        out = store.answered(store.keyed(asked).select("prompt_key", "id"))
        rows = [tuple(r) for r in out.select("id", "cand_idx", "text").collect()]
        assert len(rows) == len(want) and set(rows) == want
        plans.append(out._jdf.queryExecution().optimizedPlan().toString())
    assert len(re.findall("Join ", plans[0])) == 1


def test_merge_joins_the_old_parts_once(spark):
    a = spark.createDataFrame([(1, "a1", 0), (2, "a2", 1), (None, "an", 2)], "id int, v string, ord int")
    b = spark.createDataFrame([(2, "b2", 0), (3, None, 1), (None, "bn", 2)], "id int, v string, ord int")
    table = MergedTable(spark, scratch_path(spark, "merged"), order_col="ord", parts=2)
    table.add(a)
    table.add(b)
    key = lambda d: sorted(((r.id, r.v, r.ord, r.src, tuple(r.pos)) for r in d.collect()), key=str)
    assert key(table.read()) == key(merge_last_wins([a, b], "ord"))
    one = table._merged(table.read(), table.read())._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall("Join ", one)) == 1
