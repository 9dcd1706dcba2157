"""Filter audit against a plain run of every order over the rows."""

import random
import re
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from reasonloop.llm import filter_audit

COLUMNS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")


def brute(rows, labels):
    """rows of (id, text, source); labels id -> (good, toxic)."""
    low = {}
    for i, t, _ in rows:
        if i is not None:
            low[t or ""] = min(low.get(t or "", i), i)
    judged = []
    for i, t, s in rows:
        t = t or ""
        w = re.findall("[^\x20\x09-\x0d]+", t)
        f = {"A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t),
             "D": bool(re.search("[#$%&*|]", t)), "E": i is not None and i > low[t]}
        judged.append((s or "", {k for k, v in f.items() if v}, *labels.get(i, (0, 0))))
    out = {}
    for part in {j[0] for j in judged}:
        mine = [j for j in judged if j[0] == part]
        shapley = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = mine
            for step, x in enumerate(order, 1):
                gone = [j for j in left if x in j[1]]
                left = [j for j in left if x not in j[1]]
                shapley[x] += len(gone)
                out[part, "".join(order), step] = [
                    len(left), len(gone), sum(x in j[1] for j in mine) - len(gone), sum(j[1] == {x} for j in mine),
                    sum(j[2] for j in gone), sum(j[3] for j in gone)]
        for (p, order, step), v in out.items():
            if p == part:
                v.append(shapley[order[step - 1]])
    return out


def result(df):
    return {(r.part, r.filter_order, r.step): [*(r[c] for c in COLUMNS), r.shapley] for r in df.collect()}


def sample():
    rnd = random.Random(3)
    texts = [None, "", "A" * 300, "one two"]
    for _ in range(40):
        n = rnd.choice((20, 60, 90))
        vocab = rnd.choice((12, 400))
        t = " ".join(f"w{rnd.randrange(vocab)}" for _ in range(n))
        if rnd.random() < 0.3:
            t = t.upper()
        if rnd.random() < 0.3:
            t += " #"
        texts.append(t)
    ids = [None, None, 7, 7, *range(10, 200)]
    rows = [(i, rnd.choice(texts), rnd.choice(("a", "b", None, ""))) for i in ids]
    rows += [rows[3], rows[10], rows[10]]
    labels = {i: (rnd.randrange(2), rnd.randrange(2)) for i in ids if i is not None and rnd.random() < 0.6}
    return rows, labels


@pytest.mark.parametrize("buckets", [filter_audit.MOST_BUCKETS, 1])
def test_audit_equals_every_order_run_over_the_rows(spark, buckets):
    rows, labels = sample()
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("mask", F.lit("clash"))
    said = [(i, g, t) for i, (g, t) in labels.items()] + [(None, 1, 1), (10, None, None)]
    got = result(filter_audit.audit(docs, spark.createDataFrame(said, "doc_id long, quality int, toxic int"), most_buckets=buckets))
    assert got == brute(rows, labels)


def test_sketch_clears_unique_texts_and_no_repeat(spark):
    rows = spark.range(3000).select(F.lit("a").alias("part"), "id", F.lit(0).alias("mask"),
                                    F.unhex(F.sha2((F.col("id") % 2900).cast("string").cast("binary"), 256)).alias("digest"))
    buckets = filter_audit.sketch_buckets(3000)
    seen = filter_audit.possible_repeats(rows, filter_audit.repeat_sketch(rows, buckets), buckets)
    maybe = {r.id for r in seen.where("maybe").collect()}
    assert maybe >= set(range(100)) | set(range(2900, 3000))
    assert len(maybe) < 300


def test_text_ids_and_empty_tables(spark):
    labels = spark.createDataFrame([("x", 1, 0)], "doc_id string, quality int, toxic int")
    docs = spark.createDataFrame([("x", "t", "s"), ("y", "t", "s")], "doc_id string, text string, source string")
    got = result(filter_audit.audit(docs, labels))
    assert got["s", "EABCD", 1] == [1, 1, 0, 0, 0, 0, 60]
    assert filter_audit.audit(docs.limit(0), labels).count() == 0
    assert filter_audit.audit(docs, labels.limit(0)).count() == 600
