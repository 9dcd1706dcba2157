"""Iterative self-training loop (R13) and its stage report.

The loop itself is driver-side control flow; every step inside an iteration is a Spark
job over tables, and every table an iteration produces is written as Parquet in a folder of
its own attempt under ``out_root/<table>/iter=<k>`` and read back, which cuts the lineage (a lost
executor never replays earlier iterations). A table's report metrics are observed by the job that
writes it; nothing is read again to be counted.

An iteration ends with one commit record (``sources.manifest``): its table paths, report rows and
the model's state. The report is read from the records. A loop that was stopped is started
again with the same arguments and goes on at the first iteration without a record, from the last
record's model and tables; what an iteration that was not committed has written is never read.

The model is opaque to the library. Hooks stand in for it:

* ``generator_for(model, purpose)`` returns a generator for :func:`generate`
  (``purpose`` is ``"eval"`` or ``"retry"``);
* ``train(start_model, train_path, iteration)`` fine-tunes and returns the new model;
  ``restart="incremental"`` starts from the previous model, ``"from_base"`` from the base;
* ``save(model)`` returns what a record keeps of a model (JSON: a path, a name, a number; default: the
  model itself) and ``load(saved)`` gives the model back.

Misses are collected from predictions on the *training* problems and accuracy is reported
on the *test* problems; an overlap between the two is refused unless ``allow_overlap``.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import answers as A
from ..functions import prompts as PR
from ..operators import selection as S
from ..operators.generate import generate
from ..session import write_observed
from ..sources.manifest import Manifest


@dataclass
class LoopHooks:
    generator_for: Callable[[Any, str], Any]
    train: Callable[[Any, str, int], Any]
    save: Callable[[Any], Any] = lambda model: model
    load: Callable[[Any], Any] = lambda saved: saved


@dataclass
class _Iteration:
    """What one iteration has written and measured so far."""
    manifest: Manifest
    it: int
    paths: dict[str, str] = field(default_factory=dict)
    report: list[tuple[str, str, float]] = field(default_factory=list)

    def write(self, df: DataFrame, table: str, metrics: dict[tuple[str, str], Column]) -> DataFrame:
        """``metrics``: (stage, metric) -> aggregate over the written rows."""
        path = self.paths[table] = self.manifest.attempt(f"{table}/iter={self.it}")
        seen = write_observed(df, path, {"rows": F.count(F.lit(1))} | {f"{s}.{m}": agg.cast("double") for (s, m), agg in metrics.items()})
        self.rows = seen["rows"]
        self.report += [(s, m, seen[f"{s}.{m}"]) for s, m in metrics]
        return df.sparkSession.read.parquet(path)

    def commit(self, model, stopped: bool = False) -> None:
        self.manifest.commit(f"iter-{self.it}", {"iter": self.it, "model": model, "stopped": stopped, "paths": self.paths,
                                                 "report": self.report})


def read_report(manifest: Manifest, run: str = "run") -> DataFrame:
    """``run, iter, stage, metric, value`` of the committed iterations."""
    rows = [(run, r["iter"], s, m, v) for r in manifest.records().values() for s, m, v in r["report"]]
    return manifest.spark.createDataFrame(rows, "run string, iter int, stage string, metric string, value double")


def _predict(problems: DataFrame, model, hooks: LoopHooks, template: str, profile: str) -> DataFrame:
    prompts = problems.select("id", "question", "answer",
                              PR.render(template, question=F.col("question")).alias("prompt"))
    outs = generate(prompts, hooks.generator_for(model, "eval"), k=1)
    j = prompts.join(outs.select("id", F.col("text").alias("output")), "id", "left")
    j = A.with_em(j, profile, "answer", "output", "em")
    return j.select("id", "question", F.col("answer").alias("gold_answer"), "output", "em")


def run_self_training(spark: SparkSession, train_problems: DataFrame, test_problems: DataFrame,
                      hooks: LoopHooks, base_model, out_root: str, iterations: int = 5, k: int = 1,
                      restart: str = "incremental", run: str = "run",
                      eval_template: str = PR.FORWARD, retry_template: str = PR.HINT,
                      profile: str = "hash_loose", allow_overlap: bool = False,
                      keep_all: bool = False, stop_early: bool = True,
                      baseline_set: DataFrame | None = None) -> DataFrame:
    """Run up to ``iterations`` rounds (numbered 2..iterations+1 as in the workload) and
    return the stage report ``run, iter, stage, metric, value``.

    Default: correct retries only (R8 / R9 when ``k > 1``), correct-only cumulative set
    (R11), stop when nothing is missed. ``keep_all=True`` keeps every greedy retry with its
    ``em_after`` flag (R10) and builds the keep-all set (R12); ``stop_early=False`` runs every
    round even without misses (the second controller's behaviour, which also uses
    ``retry_template=FORWARD`` and ``restart="from_base"``).

    ``baseline_set`` (``question, rationale, answer``, e.g. :func:`~reasonloop.functions.records.sft_set`)
    adds the baseline stage: the base model is fine-tuned on it and evaluated, and the first
    round starts from that model and its misses. The set itself is no part of the cumulative
    training sets. Iterations that ``out_root`` holds records of are not run again."""
    if restart not in ("incremental", "from_base"):
        raise ValueError("restart must be 'incremental' or 'from_base'")
    if not allow_overlap and train_problems.join(test_problems.select("id"), "id", "left_semi").take(1):
        raise ValueError("train and test problems share ids; pass allow_overlap=True to permit it")
    manifest = Manifest(spark, out_root)
    records = {r["iter"]: r for r in manifest.records().values()}
    em = F.avg(F.coalesce(F.col("em").cast("int"), F.lit(0)))
    count = F.count(F.lit(1))

    def predict(problems: DataFrame, model) -> DataFrame:
        return _predict(problems, model, hooks, eval_template, profile)

    if 1 not in records:
        now, model = _Iteration(manifest, 1), base_model
        now.write(predict(test_problems, model), "test_preds", {("zero_shot", "em"): em})
        if baseline_set is not None:
            now.write(baseline_set.select("question", "rationale", "answer"), "baseline", {})
            model = hooks.train(base_model, now.paths["baseline"], 1)
            now.write(predict(test_problems, model), "baseline_preds", {("baseline", "em"): em})
        now.write(predict(train_problems, model), "train_preds", {})
        now.commit(hooks.save(model))
        records = {1: manifest.records()["iter-1"]}
    last = records[max(records)]
    model = hooks.load(last["model"])
    train_preds = spark.read.parquet(last["paths"]["train_preds"]) if "train_preds" in last["paths"] else None
    prev_train = spark.read.parquet(last["paths"]["train"]) if "train" in last["paths"] else None
    for it in range(last["iter"] + 1, iterations + 2):
        if last["stopped"]:
            break
        now = _Iteration(manifest, it)
        misses = now.write(S.collect_misses(train_preds), "misses", {("loop", "misses"): count})
        if stop_early and not now.rows:
            now.report.append(("loop", "stopped_early", 1.0))
            now.commit(hooks.save(model), stopped=True)
            break
        now.report.append(("loop", "generated", float(now.rows)))
        prompts = misses.select("id", "question", "gold_answer",
                                PR.render(retry_template, question=F.col("question")).alias("prompt"))
        outs = generate(prompts, hooks.generator_for(model, "retry"), k=k)
        greedy = outs.filter(F.col("cand_idx") == 1)
        if keep_all:
            kept = S.retry_flag_all(misses, greedy, profile)
        elif k <= 1:
            kept = S.retry_keep_correct(misses, greedy, profile)
        else:
            kept = S.retry_shortest_correct(misses, outs, profile)
        kept = now.write(kept.select("id", "question", "gold_answer", "output", "em_after"), "kept",
                         {("loop", "kept_correct"): F.count_if(F.col("em_after"))})
        rows = S.training_rows(kept, correct_only=not keep_all)
        prev_train = now.write(S.cumulative_training_set(rows, prev_train), "train", {("loop", "train_size"): count})
        start = model if restart == "incremental" else base_model
        model = hooks.train(start, now.paths["train"], it)
        now.write(predict(test_problems, model), "test_preds", {("loop", "em"): em})
        train_preds = now.write(predict(train_problems, model), "train_preds", {})
        now.commit(hooks.save(model))
    return read_report(manifest, run)
