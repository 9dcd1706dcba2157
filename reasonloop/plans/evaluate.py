"""Evaluation flows: prompts -> generation (R1) -> extraction and scoring -> records.

* :func:`zero_shot_eval` — wide zero-shot records (P3, P8, X3, M3; L3) and the gold-only
  accuracy (A2).
* :func:`batched_eval` — ``hf_test_<n>`` ids, ``em`` boolean by ``hash_loose`` (M1), the
  optional contiguous shard and limit (S9), accuracy over all rows (A1).
* :func:`sampled_eval` — ``output, pred_final`` (X2) and ``em`` by ``hash_then_any`` (M2).

Each takes a problem table and a generator (a Python callable run by ``mapInPandas``,
or a :class:`~reasonloop.operators.generate.TableGenerator` of stored generations).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import answers as A
from ..functions import prompts as PR
from ..functions import records as RC
from ..operators import report as R
from ..operators.generate import generate
from ..operators.selection import TEST_ID_PREFIX
from ..sources import splits as SP


def _generate_one(prompts: DataFrame, generator, batch_size: int, **loading) -> DataFrame:
    outs = generate(prompts.select("id", "prompt"), generator, k=1, batch_size=batch_size, **loading)
    return prompts.join(outs.filter(F.col("cand_idx") == 1).select("id", F.col("text").alias("generated")),
                        "id", "left")


def zero_shot_eval(problems: DataFrame, generator, template: str = PR.ZERO_SHOT,
                   batch_size: int = 16, **loading) -> tuple[DataFrame, DataFrame]:
    """(``loading``: ``loader`` and ``loader_key`` of :func:`generate`, here and below.)

    Zero-shot records ``id, question, generated, rationale, answer, gold, gold_extracted,
    em`` and the accuracy row (A2). Question and gold are resolved through their alias
    chains, so raw and class-format problem tables both work."""
    q = RC.resolve_field(problems, RC.QUESTION_ALIASES, skip_empty=False)
    gold = RC.resolve_field(problems, RC.GOLD_ALIASES)
    base = problems.select("id", q.alias("question"), gold.alias("gold"))
    prompts = base.withColumn("prompt", PR.render(template, q=F.col("question")))
    recs = R.zero_shot_record(_generate_one(prompts, generator, batch_size, **loading), gold_col="gold")
    recs = recs.select("id", "question", "generated", "rationale", "answer", "gold", "gold_extracted", "em")
    return recs, R.em_accuracy_gold_only(recs)


def batched_eval(problems: DataFrame, generator, template: str = PR.FORWARD, batch_size: int = 16,
                 num_shards: int = 1, shard_idx: int = 0, limit: int | None = None,
                 ordinal_col: str = "ordinal", **loading) -> tuple[DataFrame, DataFrame]:
    """Batched evaluation over a problem table that carries its position (``ordinal``):
    rows ``id (hf_test_<ordinal>), em, gold_answer, output`` and the accuracy row (A1)."""
    part = SP.shard(problems, num_shards, shard_idx, ordinal_col, limit=limit) if num_shards > 1 or limit \
        else problems
    gold = RC.resolve_field(part, RC.GOLD_ALIASES)
    base = part.select(F.concat(F.lit(TEST_ID_PREFIX), F.col(ordinal_col).cast("string")).alias("id"),
                       F.col("question"), gold.alias("gold_answer"))
    prompts = base.withColumn("prompt", PR.render(template, question=F.col("question")))
    preds = _generate_one(prompts, generator, batch_size, **loading)
    preds = preds.select("id", A.em_hash_loose(F.col("gold_answer"), F.col("generated")).alias("em"),
                         "gold_answer", F.col("generated").alias("output"))
    return preds, R.em_accuracy(preds)


def sampled_eval(problems: DataFrame, generator, template: str = PR.FORWARD,
                 batch_size: int = 16, **loading) -> tuple[DataFrame, DataFrame]:
    """Rows ``id, question, output, pred_final, gold_answer, em`` and the accuracy row."""
    gold = RC.resolve_field(problems, RC.GOLD_ALIASES)
    base = problems.select("id", "question", gold.alias("gold_answer"))
    prompts = base.withColumn("prompt", PR.render(template, question=F.col("question")))
    preds = _generate_one(prompts, generator, batch_size, **loading)
    preds = preds.select("id", "question", F.col("generated").alias("output"),
                         A.extract_hash_strict(F.col("generated")).alias("pred_final"), "gold_answer",
                         A.em_hash_then_any(F.col("gold_answer"), F.col("generated")).alias("em"))
    return preds, R.em_accuracy(preds)
