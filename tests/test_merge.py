"""The incremental keyed merge against the full one after every source."""

import random

import pytest
from pyspark.sql import functions as F

from reasonloop.operators.merge import MergedTable
from reasonloop.operators.selection import merge_last_wins
from reasonloop.session import scratch_path


def _rows(df):
    return sorted((r.id or "", r.v, r.src, r.pos[0], r.pos[1]) for r in df.collect())


def test_equals_the_full_merge_after_each_source(spark):
    rnd = random.Random(3)
    table = MergedTable(spark, scratch_path(spark, "merged"), order_col="ord", parts=8)
    assert table.read() is None
    sources, before = [], {}
    for k, (n, ids) in enumerate([(60, 40), (30, 80), (3, 5), (0, 1), (25, 90)]):
        rows = [(rnd.choice([f"i{rnd.randrange(ids)}", None]), o, f"s{k}o{o}") for o in range(n)]
        sources.append(spark.createDataFrame(rows, "id string, ord long, v string"))
        record = table.add(sources[-1])
        assert _rows(table.read()) == _rows(merge_last_wins(sources, "ord"))
        parts = set(record["parts"])
        held = {str(r.p) for r in sources[-1].select(F.pmod(F.xxhash64("id"), F.lit(8)).alias("p")).distinct().collect()}
        # parts that hold none of the source's ids keep their files, the others get new ones
        assert {p for p in parts if before.get(p) != record["parts"][p]} == held
        before = record["parts"]


def test_a_source_that_was_not_committed_is_not_read(spark, monkeypatch):
    table = MergedTable(spark, scratch_path(spark, "merged"), order_col="ord", parts=4)
    one = spark.createDataFrame([("a", 0, "x"), ("b", 1, "y")], "id string, ord long, v string")
    table.add(one)
    want = _rows(table.read())
    monkeypatch.setattr(table.manifest, "commit", lambda name, record: False)
    with pytest.raises(RuntimeError):
        table.add(one.withColumn("v", F.lit("lost")))
    assert _rows(table.read()) == want
