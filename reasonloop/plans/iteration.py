"""One self-training iteration (R14) for any problem table and generators.

forward prompts -> K generations -> first correct kept (R3) -> misses (R4) -> hinted
rationalisation prompts (P4, P1) -> K generations -> first correct kept (R5) -> keyed
merge, rationalised rows win (R6) -> class-format text (P5) -> format gate (P10).

The kept rows are read by both the anti-join and the merge, and the merge reads its sources
twice, so both are written once to the shared folder instead of being recomputed per branch.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import prompts as PR
from ..functions import records as RC
from ..operators import selection as S
from ..operators.generate import candidates_for
from ..session import materialize, scratch_path
from .evaluate import sampled_eval


@dataclass
class IterationResult:
    forward: DataFrame        # id, question, rationale, final, cand_idx
    rationalized: DataFrame   # id, question, rationale, final, cand_idx
    train: DataFrame          # id, text, src
    model: Any = None                       # what the train hook returned
    predictions: DataFrame | None = None    # id, question, output, pred_final, gold_answer, em
    accuracy: DataFrame | None = None       # one row (A1)


def forward_pass(problems: DataFrame, generator, k: int | None = None, profile: str = "hash_then_any",
                 template: str = PR.FORWARD, batch_size: int = 16,
                 loader=None, loader_key: str | None = None) -> DataFrame:
    """R1 + R3: forward prompts, K generations, first correct kept."""
    prompts = problems.select("id", "question", "answer",
                              PR.render(template, question=F.col("question")).alias("prompt"))
    return S.keep_first_correct(candidates_for(prompts, generator, k, batch_size=batch_size, loader=loader,
                                               loader_key=loader_key), prompts, profile)


def rationalize_pass(missed: DataFrame, generator, k: int | None = None, profile: str = "hash_then_any",
                     template: str = PR.RATIONALIZE, full_answer_hint: bool = False,
                     batch_size: int = 16, loader=None, loader_key: str | None = None) -> DataFrame:
    """Hinted prompts (numeric gold, or the whole answer), K generations, first correct."""
    prompts = missed.select(
        "id", "question", "answer",
        PR.render(template, question=F.col("question"),
                  gold_final=RC.hint_final(F.col("answer"), full_answer_hint)).alias("prompt"))
    return S.keep_first_correct(candidates_for(prompts, generator, k, batch_size=batch_size, loader=loader,
                                               loader_key=loader_key), prompts, profile)


def run_iteration(problems: DataFrame, forward_generator, rationalize_generator, k: int | None = None,
                  profile: str = "hash_then_any", quarantine: bool = True, loader=None,
                  loader_key: str | None = None, train: Callable[[str], Any] | None = None,
                  test_problems: DataFrame | None = None,
                  generator_for: Callable[[Any], Any] | None = None) -> IterationResult:
    """R14 over ``problems`` (``id, question, answer``). ``loader`` builds one generator per
    worker for both passes (the generator arguments are then unused).

    ``train(path)`` fine-tunes on the written training set (Parquet ``id, text, src``) and returns
    the model; with ``test_problems`` and ``generator_for(model)`` that model is evaluated on them."""
    if (test_problems is None) != (generator_for is None) or (test_problems is not None and train is None):
        raise ValueError("evaluation needs train, test_problems and generator_for")
    how = {"loader": loader, "loader_key": loader_key}
    kept = materialize(forward_pass(problems, forward_generator, k, profile, **how), "kept")
    missed = S.missed_problems(problems.select("id", "question", "answer"), kept)
    rat = materialize(rationalize_pass(missed, rationalize_generator, k, profile, **how), "rationalized")
    cols = ["id", "question", "rationale", "final"]
    merged = S.merge_last_wins([kept.select(*cols), rat.select(*cols)], order_col="id")
    texts = merged.select("id", RC.class_text(F.col("question"), F.col("rationale"),
                                              F.col("final")).alias("text"), "src")
    result = IterationResult(kept, rat, RC.check_training_format(texts, quarantine=quarantine))
    if train is not None:
        spark = problems.sparkSession
        path = scratch_path(spark, "training-set")
        result.train.write.parquet(path)
        result.train = spark.read.parquet(path)
        result.model = train(path)
    if test_problems is not None:
        result.predictions, result.accuracy = sampled_eval(test_problems, generator_for(result.model))
    return result
