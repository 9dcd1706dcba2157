"""The corpus pipeline: every stage against a plain version of its decision, odd rows, empty tables."""

import random
import re
from collections import Counter

import pytest

import corpus_pipeline
from reasonloop.llm import decontam

WORD = "[^\x20\x09-\x0d]+"


def _plain_quality(text):
    """The base verdict and the rules that the planted rows can break."""
    w = re.findall(WORD, text or "")
    tri = Counter(tuple(w[i:i + 3]) for i in range(len(w) - 2))
    again = {j for i in range(len(w) - 2) if tri[tuple(w[i:i + 3])] > 1 for j in (i, i + 1, i + 2)}
    return len(w) >= 50 and 100 * len(again) <= 50 * len(w)


def _shingles(text):
    w = re.findall(WORD, text.lower())
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)}


def _contains(text, item):
    """Within the allowed edits, by the plain table of free-ended word edit distance."""
    t, w = (re.findall(r"[^\W_]+", x.lower()) for x in (text, item or ""))
    if not w:
        return False
    row = [0] * (len(t) + 1)
    for a in range(len(w)):
        new = [a + 1]
        for b in range(len(t)):
            new.append(min(row[b] + (t[b] != w[a]), row[b + 1] + 1, new[b] + 1))
        row = new
    return min(row) <= decontam.allowed_edits(len(w))


@pytest.fixture(scope="module")
def planted(tmp_path_factory, spark):
    rnd = random.Random(21)

    def prose(n=70):
        return [f"{rnd.choice('abcdefghij')}word{rnd.randrange(3000)}" for _ in range(n)]

    items = [" ".join(prose(24)) for _ in range(4)] + ["", "...", None]
    rows = []
    for i in range(40):
        w = prose()
        kind = i % 5
        rows.append((i, " ".join(w), "en", f"s{i % 3}", kind))
        if kind == 1:                                        # near and exact copies under larger ids
            rows += [(100 + i, " ".join(w + ["end"]), "en", "s1", kind), (200 + i, " ".join(w), "de", "s2", kind)]
        if kind == 2:
            hurt = items[i % 4].split()
            hurt[rnd.randrange(len(hurt))] = "edited"
            rows[-1] = (i, " ".join(w[:30] + hurt + w[30:]), "en", "s0", kind)
        if kind == 3:
            rows[-1] = (i, " ".join(w) + " password: hunter22x", "en", "s0", kind)
        if kind == 4:
            rows[-1] = (i, " ".join(w[:10]) if i % 2 else "again and again " * 40, "en", "s0", kind)
    rows += [(None, None, None, None, None), (None, "", "en", None, 0), (39, "short", "en", "s0", 0), (39, "short", "en", "s0", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, row int")
    folder = str(tmp_path_factory.mktemp("sf"))
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, rows, items


def test_every_stage_decides_like_its_plain_version(spark, planted):
    folder, rows, items = planted
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    steps = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
        steps[name] = [tuple(r)[:5] for r in docs.collect()]
        if name != "mix":
            assert docs.columns == ["doc_id", "text", "lang", "source", "row"]
    want = [r for r in rows if _plain_quality(r[1])]
    assert sorted(steps["quality"]) == sorted(want) and len(want) < len(rows) - 4
    sets = {r: _shingles(r[1]) for r in want}
    want = [r for r in want if not any(s[0] < r[0] and len(sets[r] & sets[s]) >= 0.8 * len(sets[r] | sets[s]) for s in sets)]
    assert sorted(steps["near_duplicates"]) == sorted(want)
    want = [r for r in want if not any(_contains(r[1], i) for i in items)]
    assert sorted(steps["decontamination"]) == sorted(want) and len(want) == len(steps["near_duplicates"]) - 8
    want = [(i, re.sub("password: hunter22x", "[SECRET]", t), *rest) for i, t, *rest in want]
    assert sorted(steps["secrets"]) == sorted(want) and sum("[SECRET]" in r[1] for r in want) == 8
    texts = {r[0]: len(re.findall(WORD, r[1])) for r in want}
    taken = Counter()
    for r in docs.collect():
        taken[r.doc_id] += r.taken_words
        assert r.taken_words == len(re.findall(WORD, r.text)) <= texts[r.doc_id]
    assert set(taken) <= set(texts) and all(n <= 2 * texts[i] for i, n in taken.items())
    assert abs(sum(taken.values()) - 1.5 * sum(texts.values())) <= 3


def test_the_pipeline_runs_over_odd_and_empty_tables(spark, planted, tmp_path):
    folder, _, _ = planted
    assert corpus_pipeline.run(spark, folder).count() > 0
    for name in ("documents", "benchmark"):
        spark.read.parquet(f"{folder}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.count() == 0 and out.columns == ["doc_id", "text", "lang", "source", "row", "epoch", "taken_words"]
