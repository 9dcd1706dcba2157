"""Generations by prompt, resumable runs and commit records."""

import pytest
from pyspark.errors import PythonException
from pyspark.sql import functions as F

from reasonloop.functions import prompts as PR
from reasonloop.operators.generate import candidates_for, generate
from reasonloop.operators.genstore import GenerationRun, PromptStore, prompt_key
from reasonloop.plans.fixture import StepGenerator
from reasonloop.session import scratch_path
from reasonloop.sources.manifest import Manifest


def _asked(spark, template=PR.VARIANT_1):
    qs = spark.createDataFrame([(1, "a$?"), (2, "b"), (3, "a$?")], "id int, question string")
    return qs.select("id", PR.render(template, q="question").alias("prompt"))


def test_lookup_follows_the_prompt_and_the_settings(spark):
    asked = _asked(spark)
    stored = (asked.filter("id < 3").select(prompt_key("prompt", {"t": 0}).alias("prompt_key"), F.col("id").alias("cand_idx"))
              .withColumn("text", F.concat(F.lit("t"), F.col("cand_idx").cast("string"))))
    store = PromptStore(stored, {"t": 0})
    got = {(r.id, r.cand_idx, r.text) for r in store.lookup(asked).collect()}
    assert got == {(1, 1, "t1"), (3, 1, "t1"), (2, 2, "t2")}         # the same prompt shares its texts
    assert {r.id for r in store.lookup(asked, k=1).collect()} == {1, 3}
    assert store.missing(asked).count() == 0
    assert PromptStore(stored, {"t": 1}).lookup(asked).count() == 0
    changed = _asked(spark, PR.VARIANT_1.replace("Let's", "Lets"))
    assert store.lookup(changed).count() == 0 and store.missing(changed).count() == 2
    assert {r.id for r in generate(asked, store, k=None).collect()} == {1, 2, 3}
    assert candidates_for(asked, store).columns == ["id", "cand_idx", "text"]


def test_a_stopped_run_goes_on_without_repeats(spark):
    asked = spark.range(200).select("id", F.concat(F.lit("p"), (F.col("id") % 150).cast("string")).alias("prompt"))
    run = GenerationRun(spark, scratch_path(spark, "run"), k=2, units=5)
    with pytest.raises(PythonException):
        run.fill(asked, StepGenerator(run.settings, 5, stop_at=3))
    first = run.generations()
    done = {r.prompt_key for r in first.collect()}
    assert 0 < len(done) < 150 and first.select("run").distinct().collect()[0].run == 1
    store = GenerationRun(spark, run.manifest.root, k=2, units=5).fill(asked, StepGenerator(run.settings))
    made = run.generations().collect()
    assert len(made) == 300 and len({(r.prompt_key, r.cand_idx) for r in made}) == 300
    assert {r.prompt_key for r in made if r.run == 1} == done
    assert sum(r["prompts"] for r in run.records().values()) == 150
    assert store.lookup(asked).count() == 400
    before = run.records()
    run.fill(asked, StepGenerator(run.settings, 1, stop_at=0))        # nothing is left, so nothing is asked
    assert run.records() == before


def test_outputs_without_a_record_are_not_read(spark):
    run = GenerationRun(spark, scratch_path(spark, "run"))
    stray = spark.createDataFrame([("k", 1, "half", 1)], "prompt_key string, cand_idx int, text string, run int")
    stray.write.parquet(run.manifest.attempt("units"))
    assert run.generations().count() == 0
    m = Manifest(spark, run.manifest.root)
    assert m.commit("one", {"a": 1}) and not m.commit("one", {"a": 2})
    assert m.records() == {"one": {"a": 1}} and m.committed("one") and not m.committed("two")
