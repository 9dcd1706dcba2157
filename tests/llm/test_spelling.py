"""Spelling variants against brute force over all pairs of words."""

import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from reasonloop.llm import spelling

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def counts(docs):
    c = Counter()
    for i, t in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 199 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            c[run] += 1
    return {w: n for w, n in c.items() if len(w) >= 6 and n >= 5}


def around(w, alphabet):
    for k in range(len(w) + 1):
        yield w[:k] + w[k + 1:]
        for a in alphabet:
            yield w[:k] + a + w[k:]
            yield w[:k] + a + w[k + 1:]


def brute(docs):
    n = counts(docs)
    alphabet = sorted({c for w in n for c in w})
    near = {w: {v for v in around(w, alphabet) if v in n and v != w} for w in n}
    form = {}
    for w in n:
        top = min(near[w], key=lambda v: (-n[v], v), default=None)
        form[w] = top if top and n[top] >= 5 * n[w] else None
    out = {}
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out[w] = (form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None)
    return out


def result(df):
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()}


def edited(w, rnd, alphabet):
    k = rnd.randrange(len(w))
    return rnd.choice((w[:k] + w[k + 1:], w[:k] + rnd.choice(alphabet) + w[k:], w[:k] + rnd.choice(alphabet) + w[k + 1:]))


@pytest.mark.parametrize("tile", [1024, 4])
def test_variants_equal_brute_force(spark, tile):
    rnd = random.Random(5)
    alphabet = "abcdefgABéÉÿ×"
    words = ["".join(rnd.choice(alphabet) for _ in range(rnd.randrange(6, 10))) for _ in range(40)]
    weight = [300] * 40
    for w in (40, 6, 1):                                     # chains of variants, each rarer
        words += [edited(x, rnd, alphabet) for x in words[-40:]]
        weight += [w] * 40
    docs = [(i if i % 9 else None, " ".join(rnd.choices(words, weight, k=400)) + "; x3" * (i % 2)) for i in range(150)]
    docs += [(500, None), (501, ""), (502, "short 12 --"), docs[1], docs[1]]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("word", F.lit("clash"))
    want = brute(docs)
    assert sum(v[0] is not None for v in want.values()) > 20 and any(v[0] != v[1] and v[0] for v in want.values())
    assert result(spelling.spelling_variants(df, tile=tile)) == want


def test_variants_of_the_documents(spark, docs):
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert result(spelling.spelling_variants(docs)) == brute(rows)


def test_tables_without_words(spark):
    df = spark.createDataFrame([("a", None), (None, "one two")], "doc_id string, text string")
    assert spelling.spelling_variants(df).count() == 0
    assert spelling.spelling_variants(df.limit(0)).count() == 0
