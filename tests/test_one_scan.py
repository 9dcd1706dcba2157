"""The one-scan cascade against one pass per cue, and plans that compute the scoring once."""

import random
import re

import pytest
from pyspark.sql import functions as F

from reasonloop.functions import answers as A
from reasonloop.operators import report as R
from tests.conftest import SF_SMALL

PIECES = ["final answer", "final  answer", "answer", "Answer is", "####", "###", "#", "=>", "=", ">", "result", "Result:", " is", ":", " ", "\n",
          " ", "5", "-12", "+3.", "7.50", "1,234", "08x", "x", "$", "٣", ".", "finalanswer", "the ", "-", ""]


def plain(text, patterns, first):
    if text is None:
        return ""
    t = text.strip()
    low = t.lower()
    for p in patterns:
        found = re.findall(p, low)
        if found:
            return found[0 if first else -1].replace(",", "")
    found = re.findall(A.LOOSE_NUMBER, t.replace(",", ""))
    if found:
        return found[-1]
    return t.splitlines()[-1].strip() if t else ""


@pytest.mark.parametrize("seed", [1, 2])
def test_cascades_equal_one_pass_per_cue(spark, seed):
    rnd = random.Random(seed)
    texts = ["".join(rnd.choice(PIECES) for _ in range(rnd.randrange(1, 14))) for _ in range(1500)] + [None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    t = F.col("text")
    one = A.with_cascades(df, "text", {"cascade_last": "last", "cascade_first": "first", "cascade_first_shell": "shell"})
    one = one.withColumn("last2", A.extract_cascade_last(t)).withColumn("shell2", A.extract_cascade_first(t, with_result=False))
    for r in one.collect():
        want = (plain(r.text, A.CASCADE_LAST, False), plain(r.text, A.CASCADE_FIRST, True), plain(r.text, A.CASCADE_FIRST_SHELL, True))
        assert (r["last"], r["first"], r["shell"]) == want, r.text
        assert (r["last2"], r["shell2"]) == (want[0], want[2]), r.text


def _regexes(df):
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return len(re.findall(r"regexp_\w+\(|RLIKE", plan))


def test_a_text_is_scanned_once_for_all_cues(spark):
    df = spark.createDataFrame([("a",)], "text string")
    both = A.with_cascades(df, "text", {"cascade_last": "last", "cascade_first": "first"})
    plan = both._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("result(?: is|:)?") == 1                       # the cues, once for both cascades


def test_mismatch_listings_score_once(spark):
    import __spark_entry__ as E
    q = E.queries()
    assert _regexes(q["ablation_mismatches"](spark, SF_SMALL)) <= _regexes(q["prompt_ablation"](spark, SF_SMALL))
    assert _regexes(q["mismatch_export"](spark, SF_SMALL)) <= _regexes(q["zero_shot_records"](spark, SF_SMALL))
    df = spark.createDataFrame([(1, 0, "a"), (2, 1, "a"), (3, None, "a"), (4, 0, "b"), (5, 0, "a")], "ordinal int, em int, g string")
    assert {r.ordinal for r in R.mismatch_export(df).collect()} == {1, 4, 5} and R.mismatch_export(df).columns == df.columns
    assert {r.ordinal for r in R.top_mismatches(df, 1, group_by=["g"]).collect()} == {1, 4}


def test_integers_have_every_digit_of_their_double(spark):
    rnd = random.Random(4)
    texts = ["1e20", str(2 ** 63), str(2 ** 70), "1e300", "1e38", "9.999999999999999e37", "-1e23", str(2 ** 62), str(2 ** 63 - 1), "1e18",
             "-9223372036854775808", "1.7976931348623157e308", "123", "-0.0", "1e400", "12345678901234567890123"]
    texts += [repr(rnd.uniform(1, 10) * 10.0 ** rnd.randrange(16, 308)) for _ in range(200)]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    for r in A.with_normalized(A.with_normalized(df, "integral", "text", "n3"), "rounded", "text", "n4").collect():
        want = str(int(float(r.text))) if float(r.text) not in (float("inf"),) else r.text
        assert r["n3"] == want and r["n4"] == want, r.text
