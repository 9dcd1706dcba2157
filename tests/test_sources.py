"""JSONL round trips, FAILFAST, missing paths, split rules."""

import os
import tempfile

import pytest
from pyspark.sql import functions as F

from reasonloop.sources import jsonl as J
from reasonloop.sources import splits as SP

SCHEMA = "id string, question string, em int"


def test_jsonl_round_trip_keeps_nulls(spark):
    d = tempfile.mkdtemp(prefix="rl-json-")
    df = spark.createDataFrame([("a", "q", None), ("b", None, 1)], SCHEMA)
    J.write_jsonl(df, os.path.join(d, "out"))
    text = "".join(open(os.path.join(d, "out", f)).read() for f in os.listdir(os.path.join(d, "out"))
                   if f.endswith(".json"))
    assert '"em":null' in text
    back = sorted(tuple(r) for r in J.read_jsonl(spark, os.path.join(d, "out"), SCHEMA).collect())
    assert back == [("a", "q", None), ("b", None, 1)]


def test_failfast_and_blank_lines(spark):
    d = tempfile.mkdtemp(prefix="rl-json-")
    good = os.path.join(d, "good.jsonl")
    with open(good, "w") as f:
        f.write('{"id": "a", "question": "q", "em": 1}\n\n{"id": "b", "question": "r", "em": 0}\n')
    assert J.read_jsonl(spark, good, SCHEMA).count() == 2
    bad = os.path.join(d, "bad.jsonl")
    with open(bad, "w") as f:
        f.write('{"id": "a"}\n{not json\n')
    with pytest.raises(Exception):
        J.read_jsonl(spark, bad, SCHEMA).collect()
    assert J.read_jsonl(spark, os.path.join(d, "absent"), SCHEMA, missing_ok=True).count() == 0


def test_append_batch_is_idempotent(spark):
    d = tempfile.mkdtemp(prefix="rl-json-")
    df = spark.createDataFrame([("a", "q", 1)], SCHEMA)
    J.append_batch(df, d, 0)
    J.append_batch(df, d, 0)
    J.append_batch(df, d, 1)
    assert J.read_jsonl(spark, d, SCHEMA).count() == 2


def test_split_rules(spark):
    assert [SP.holdout_size(n) for n in (0, 1, 2, 9, 10, 25, 100)] == [0, 0, 1, 1, 1, 2, 10]
    df = spark.range(0, 10).withColumnRenamed("id", "ordinal")
    tr, va = SP.tail_holdout(df)
    assert sorted(r.ordinal for r in va.collect()) == [9] and tr.count() == 9
    # ceil(10/4)=3 rows per shard; shard 3 holds one row; limit cuts inside the shard
    assert [r.ordinal for r in SP.shard(df, 4, 3).collect()] == [9]
    assert sorted(r.ordinal for r in SP.shard(df, 4, 1, limit=2).collect()) == [3, 4]
    assert SP.shard(spark.range(0, 2).withColumnRenamed("id", "ordinal"), 4, 3).count() == 0
    assert SP.head(df, 3).count() == 3 and SP.head(df, 0).count() == 10
    ids = [r.id for r in SP.ordinal_ids(df, "hf_test_", limit=2).orderBy("ordinal").collect()]
    assert ids == ["hf_test_0", "hf_test_1"]
    b = {r.ordinal: r.batch_id for r in SP.batch_ids(df, 4).collect()}
    assert b[3] == 0 and b[4] == 1 and b[9] == 2


def test_hash_split_stable_under_repartition(spark):
    df = spark.range(0, 2000).select(F.col("id").cast("string").alias("id"))
    _, t1 = SP.hash_split(df, 0.1, seed=7)
    _, t2 = SP.hash_split(df.repartition(11), 0.1, seed=7)
    a, b = sorted(r.id for r in t1.collect()), sorted(r.id for r in t2.collect())
    assert a == b and 120 < len(a) < 280


def test_metrics_files_to_long_table(spark):
    import json

    from reasonloop.sources import metrics as M
    d = tempfile.mkdtemp(prefix="rl-metrics-")
    for run, losses in (("runA", [0.9, 0.7, 0.4]), ("runB", [1.2])):
        obj = {s: [] for s in M.SERIES}
        obj.update(train_step_loss=losses, train_loss=[sum(losses) / len(losses)], val_loss=[0.5], ts="t")
        with open(os.path.join(d, f"{run}.json"), "w") as f:
            json.dump(obj, f, indent=2)
    long = M.metrics_long(M.read_metrics(spark, d))
    rows = sorted((r.run, r.series, r.granularity, r.idx, r.value) for r in long.collect())
    assert ("runA", "train_step_loss", "step", 2, 0.4) in rows
    assert ("runB", "val_loss", "epoch", 0, 0.5) in rows
    assert len([r for r in rows if r[1] == "train_step_loss"]) == 4


def test_numeric_id_read_as_text(spark):
    from reasonloop.sources import schemas
    d = tempfile.mkdtemp(prefix="rl-json-")
    p = os.path.join(d, "p.jsonl")
    with open(p, "w") as f:
        f.write('{"id": 7, "question": "q", "answer": "steps\\n#### 18"}\n')
    r = J.read_jsonl(spark, p, schemas.PROBLEM_RAW).collect()[0]
    assert r.id == "7" and r.answer.endswith("#### 18")


def test_ascii_escaped_sink(spark):
    import json
    d = tempfile.mkdtemp(prefix="rl-json-")
    df = spark.createDataFrame([("é", "naïve 😀 text", None)], SCHEMA)
    J.write_jsonl(df, os.path.join(d, "a"), ensure_ascii=True)
    raw = "".join(open(os.path.join(d, "a", f), encoding="utf-8").read()
                  for f in os.listdir(os.path.join(d, "a")) if f.startswith("part-"))
    assert raw.isascii() and "\\u00e9" in raw and "\\ud83d\\ude00" in raw and '"em":null' in raw
    assert json.loads(raw.strip()) == {"id": "é", "question": "naïve 😀 text", "em": None}
    back = J.read_jsonl(spark, os.path.join(d, "a"), SCHEMA).collect()[0]
    assert (back.id, back.question, back.em) == ("é", "naïve 😀 text", None)
