"""Literal edge cases for every extractor, normaliser and exact-match profile.

Expected values are the behaviour of the workload's plain-Python functions on each input,
written out as literals (Unicode classes, trailing dots, commas, NULL and empty inputs).
"""

import pytest
from pyspark.sql import functions as F

from reasonloop.functions import answers as A

EXTRACT_CASES = [
    ('#### 18', '18', '18', '18', '18', '18', '18', '#### 18', '#### 18', '#### 18'),
    ('#### 18.', '18.', '18', '18', '18', '18', '18', '#### 18.', '#### 18', '#### 18'),
    ('#### 70,000', '70000', '70', '000', '70', '70', '70', '#### 70000', '#### 70,000', '#### 70,000'),
    ('#### -3.50', '-3.50', '-3.50', '-3.50', '-3.50', '-3.50', '-3.50', '#### -3.50', '#### -3.50', '#### -3.50'),
    ('Final answer: $18', None, None, '18', '18', '18', None, 'Final answer: $18', 'final answer: $18', 'final answer: $18'),
    ('answer is 5', None, None, '5', '5', '5', None, 'answer is 5', 'answer is 5', 'answer is 5'),
    ('x => 7', None, None, '7', '7', '7', None, 'x => 7', 'x => 7', 'x => 7'),
    ('a = 4 = 5', None, None, '5', '5', '4', None, 'a = 4 = 5', 'a = 4 = 5', 'a = 4 = 5'),
    ('the result: 9', None, None, '9', '9', '9', None, 'the result: 9', 'the result: 9', 'the result: 9'),
    ('460.', None, None, '460', '460.', '460.', None, '460.', '460', '460'),
    ('no number', None, None, None, 'no number', 'no number', None, 'no number', 'no number', 'no number'),
    ('', None, None, None, '', '', None, '', '', ''),
    (None, None, None, None, '', '', None, None, '', ''),
    ('#### 1 #### 2 ####3', '3', '3', '3', '3', '1', '3', '#### 1 #### 2 ####3', '#### 1 #### 2 ####3', '#### 1 #### 2 ####3'),
    ('<<16-3-4=9>>9 apples\n#### 18', '18', '18', '18', '18', '9', '18', '<<16-3-4=9>>9 apples\n#### 18', '<<16-3-4=9>>9 apples\n#### 18', '<<16-3-4=9>>9 apples\n#### 18'),
    ('#### 18', '18', '18', '18', '18', '18', '18', '#### 18', '#### 18', '#### 18'),
    ('1d', None, None, '1', '1', '1', None, '1d', '1d', '1d'),
    ('1_000', None, None, '000', '000', '000', None, '1_000', '1000', '1000'),
    ('inf', None, None, None, 'inf', 'inf', None, 'inf', 'inf', 'inf'),
    ('nan', None, None, None, 'nan', 'nan', None, 'nan', 'nan', 'nan'),
    ('2.5', None, None, '2.5', '2.5', '2.5', None, '2.5', '2.5', '2'),
    ('0.5', None, None, '0.5', '0.5', '0.5', None, '0.5', '0.5', '0'),
    ('-0.5', None, None, '-0.5', '-0.5', '-0.5', None, '-0.5', '-0.5', '0'),
    ('1e3', None, None, '3', '3', '3', None, '1e3', '1000', '1000'),
    ('   ', None, None, None, '', '', None, '', '', ''),
    ('a\n\nb line\r\n  last one  \r\n\n', None, None, None, 'last one', 'last one', None, 'a\n\nb line\r\n  last one', 'a\n\nb line\r\n  last one', 'a\n\nb line\r\n  last one'),
    ('x\x0bend', None, None, None, 'end', 'end', None, 'x\x0bend', 'x\x0bend', 'x\x0bend'),
    ('١٢', None, None, '١٢', '١٢', '١٢', None, '١٢', '12', '12'),
    ('5 .', None, None, '5', '5', '5', None, '5 .', '5', '5'),
    ('$1,234.00', None, None, '234.00', '1234.00', '1234.00', None, '1234.00', '$1,234.00', '$1,234.00'),
    ('the answer is 1,000', None, None, '000', '1', '1', None, 'the answer is 1000', 'the answer is 1,000', 'the answer is 1,000'),
    ('#### +5', None, None, '5', '+5', '+5', '+5', '#### +5', '#### +5', '#### +5'),
    ('x=3é', None, None, '3', '3', '3', None, 'x=3é', 'x=3é', 'x=3é'),
]
EM_CASES = [
    ('#### 18', '#### 18', True, True, 1, 1),
    ('#### 18', 'so #### 18.', False, True, 1, 1),
    ('#### 18', 'Final answer: 18', False, True, 1, 1),
    ('#### 18', '#### 70,000', False, False, 0, 0),
    ('#### 18', 'answer: 5', False, False, 0, 0),
    ('#### 18', 'no number', False, False, 0, 0),
    ('#### 18', '', False, False, 0, 0),
    ('#### 18', None, False, False, 0, 0),
    ('#### 18', '12 = 18 then #### 18', True, True, 1, 1),
    ('#### 18', '1.0', False, False, 0, 0),
    ('The answer is 5', '#### 18', False, False, 0, 0),
    ('The answer is 5', 'so #### 18.', False, False, 0, 0),
    ('The answer is 5', 'Final answer: 18', False, False, 0, 0),
    ('The answer is 5', '#### 70,000', False, False, 0, 0),
    ('The answer is 5', 'answer: 5', False, False, 1, 1),
    ('The answer is 5', 'no number', False, False, 0, 0),
    ('The answer is 5', '', False, False, 0, 0),
    ('The answer is 5', None, False, False, 0, 0),
    ('The answer is 5', '12 = 18 then #### 18', False, False, 0, 0),
    ('The answer is 5', '1.0', False, False, 0, 0),
    ('', '#### 18', False, False, None, 0),
    ('', 'so #### 18.', False, False, None, 0),
    ('', 'Final answer: 18', True, False, None, 0),
    ('', '#### 70,000', False, False, None, 0),
    ('', 'answer: 5', True, False, None, 0),
    ('', 'no number', True, False, None, 0),
    ('', '', True, False, None, 0),
    ('', None, True, False, None, 0),
    ('', '12 = 18 then #### 18', False, False, None, 0),
    ('', '1.0', True, False, None, 0),
    (None, '#### 18', False, False, None, 0),
    (None, 'so #### 18.', False, False, None, 0),
    (None, 'Final answer: 18', False, False, None, 0),
    (None, '#### 70,000', False, False, None, 0),
    (None, 'answer: 5', False, False, None, 0),
    (None, 'no number', False, False, None, 0),
    (None, '', False, False, None, 0),
    (None, None, False, False, None, 0),
    (None, '12 = 18 then #### 18', False, False, None, 0),
    (None, '1.0', False, False, None, 0),
    ('18', '#### 18', True, True, 1, 1),
    ('18', 'so #### 18.', False, True, 1, 1),
    ('18', 'Final answer: 18', False, True, 1, 1),
    ('18', '#### 70,000', False, False, 0, 0),
    ('18', 'answer: 5', False, False, 0, 0),
    ('18', 'no number', False, False, 0, 0),
    ('18', '', False, False, 0, 0),
    ('18', None, False, False, 0, 0),
    ('18', '12 = 18 then #### 18', True, True, 1, 1),
    ('18', '1.0', False, False, 0, 0),
    ('<<16-3-4=9>>9 apples\n#### 18', '#### 18', True, True, 1, 0),
    ('<<16-3-4=9>>9 apples\n#### 18', 'so #### 18.', False, True, 1, 0),
    ('<<16-3-4=9>>9 apples\n#### 18', 'Final answer: 18', False, True, 1, 0),
    ('<<16-3-4=9>>9 apples\n#### 18', '#### 70,000', False, False, 0, 0),
    ('<<16-3-4=9>>9 apples\n#### 18', 'answer: 5', False, False, 0, 0),
    ('<<16-3-4=9>>9 apples\n#### 18', 'no number', False, False, 0, 0),
    ('<<16-3-4=9>>9 apples\n#### 18', '', False, False, 0, 0),
    ('<<16-3-4=9>>9 apples\n#### 18', None, False, False, 0, 0),
    ('<<16-3-4=9>>9 apples\n#### 18', '12 = 18 then #### 18', True, True, 1, 0),
    ('<<16-3-4=9>>9 apples\n#### 18', '1.0', False, False, 0, 0),
    ('#### 70,000', '#### 18', False, False, 0, 0),
    ('#### 70,000', 'so #### 18.', False, False, 0, 0),
    ('#### 70,000', 'Final answer: 18', False, False, 0, 0),
    ('#### 70,000', '#### 70,000', True, True, 1, 1),
    ('#### 70,000', 'answer: 5', False, False, 0, 0),
    ('#### 70,000', 'no number', False, False, 0, 0),
    ('#### 70,000', '', False, False, 0, 0),
    ('#### 70,000', None, False, False, 0, 0),
    ('#### 70,000', '12 = 18 then #### 18', False, False, 0, 0),
    ('#### 70,000', '1.0', False, False, 0, 0),
    ('x = 1.0', '#### 18', False, False, 0, 0),
    ('x = 1.0', 'so #### 18.', False, False, 0, 0),
    ('x = 1.0', 'Final answer: 18', False, False, 0, 0),
    ('x = 1.0', '#### 70,000', False, False, 0, 0),
    ('x = 1.0', 'answer: 5', False, False, 0, 0),
    ('x = 1.0', 'no number', False, False, 0, 0),
    ('x = 1.0', '', False, False, 0, 0),
    ('x = 1.0', None, False, False, 0, 0),
    ('x = 1.0', '12 = 18 then #### 18', False, False, 0, 0),
    ('x = 1.0', '1.0', False, False, 1, 1),
]


def test_extractors_and_normalisers(spark):
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(EXTRACT_CASES)], "i int, t string")
    t = F.col("t")
    got = df.select("i", A.extract_hash_loose(t).alias("x1"), A.extract_hash_strict(t).alias("x2"),
                    A.extract_last_number(t).alias("x2f"), A.extract_cascade_last(t).alias("x3"),
                    A.extract_cascade_first(t).alias("x4"), A.extract_solution_number(t).alias("x5"),
                    A.normalize_money(t).alias("n2"), A.normalize_integral(t).alias("n3"),
                    A.normalize_rounded(t).alias("n4")).orderBy("i").collect()
    for row, case in zip(got, EXTRACT_CASES):
        assert tuple(row)[1:] == case[1:], (case[0], tuple(row)[1:], case[1:])


def test_staged_forms_equal_column_forms(spark):
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(EXTRACT_CASES)], "i int, t string")
    d = A.with_extracted(df, "cascade_last", "t", "x3")
    d = A.with_extracted(d, "cascade_first", "t", "x4")
    d = A.with_normalized(d, "integral", "t", "n3")
    d = A.with_normalized(d, "rounded", "t", "n4")
    got = {r.i: (r.x3, r.x4, r.n3, r.n4) for r in d.collect()}
    for i, c in enumerate(EXTRACT_CASES):
        assert got[i] == (c[4], c[5], c[8], c[9]), c[0]


def test_em_profiles(spark):
    df = spark.createDataFrame([(i, c[0], c[1]) for i, c in enumerate(EM_CASES)], "i int, g string, p string")
    g, p = F.col("g"), F.col("p")
    d = df.select("i", "g", "p", A.em_hash_loose(g, p).alias("m1"), A.em_hash_then_any(g, p).alias("m2"),
                  A.em_cascade_last(g, p).alias("m3"), A.em_cascade_first(g, p).alias("m4"))
    d = A.with_em(d, "cascade_last", "g", "p", "m3s")
    d = A.with_em(d, "cascade_first", "g", "p", "m4s")
    for r in d.orderBy("i").collect():
        exp = EM_CASES[r.i]
        assert (r.m1, r.m2, r.m3, r.m4) == exp[2:], (exp[:2], (r.m1, r.m2, r.m3, r.m4), exp[2:])
        assert (r.m3s, r.m4s) == exp[4:], exp[:2]


def test_unknown_profile_raises():
    with pytest.raises(ValueError):
        A.score("nope", F.lit("a"), F.lit("b"))


def test_unicode_whitespace_and_digits(spark):
    df = spark.createDataFrame([("####\u00a018",), ("answer: \u0661\u0662",), ("\u2003 7 \u3000",)], "t string")
    got = [tuple(r) for r in df.select(A.extract_hash_strict("t"), A.normalize_integral(A.extract_cascade_last("t")),
                                       A.normalize_trim("t")).collect()]
    assert got[0][0] == "18"            # no-break space counts as whitespace after ####
    assert got[1][1] == "12"            # Arabic-Indic digits read as a number, as Python float does
    assert got[2][2] == "7"             # em space and ideographic space are stripped


def test_long_runs_take_linear_time(spark):
    import time
    from pyspark.sql import functions as F
    from reasonloop.functions import text as X
    n = 1_000_000
    df = spark.createDataFrame([("a" + " " * n + "b",), ("x" * n,)], "t string")
    began = time.time()
    got = [(r.a, r.b) for r in df.select(F.length(X.trim_u(F.col("t"))).alias("a"),
                                         F.length(X.last_line(F.col("t"))).alias("b")).collect()]
    assert got == [(n + 2, n + 2), (n, n)] and time.time() - began < 10


def test_large_integers_keep_their_exact_digits(spark):
    texts = ["9007199254740993", "-9223372036854775808", "1234567890123456789", "-4611686018427387905", "1e18",
             "-0.0", "12.0"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    df = A.with_normalized(A.with_normalized(df, "integral", "t", "n3"), "rounded", "t", "n4")
    for r in df.collect():
        exact = str(int(float(r.t)))
        assert (r.n3, r.n4) == (exact, exact), (r, exact)


def test_gold_keys_of_several_profiles_scan_the_cues_once(spark):
    df = spark.createDataFrame([("#### 1,200",), ("answer is 7.5\x85last x",), ("no\rnumber\x1clast one ",), ("",), (None,), ("٣.",)], "gold string")
    profiles = ["hash_loose", "hash_then_any", "cascade_last", "cascade_first"]
    both = A.with_gold_keys(df, {p: p for p in profiles}, "gold")
    assert both._jdf.queryExecution().optimizedPlan().toString().count("result(?: is|:)?") == 1
    for p in profiles:
        want = A.with_gold_key(df, p, "gold", "k").collect()
        assert [r[p] for r in both.collect()] == [r["k"] for r in want]
