"""Accuracy, counters, rollups and mismatch listings.

Everything is an aggregate or a bounded window: global counts use map-side partial
aggregation, running totals are two-level prefix sums (block totals, then a window
inside each block), per-group top-N uses ``row_number() <= n`` which Spark turns into a
partial group limit before the shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import answers as A
from ..functions.records import rationale_from_generation
from ..functions.text import trim_u
from .skew import block_join


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


# ---- A1 / A2 / A4 -----------------------------------------------------------

def em_accuracy(df: DataFrame, em_col: str = "em", group_by: Sequence[str] = ()) -> DataFrame:
    """A1: NULL em counts as wrong; ``accuracy = correct / max(1, n)``."""
    em = F.coalesce(_c(em_col).cast("int"), F.lit(0))
    return df.groupBy(*group_by).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(em).cast("bigint").alias("correct"),
        (F.sum(em) / F.greatest(F.count(F.lit(1)), F.lit(1))).alias("accuracy"))


def em_accuracy_gold_only(df: DataFrame, em_col: str = "em",
                          group_by: Sequence[str] = ()) -> DataFrame:
    """A2: rows with NULL em are excluded; accuracy 0.0 when none is left."""
    em = _c(em_col).cast("int")
    return df.groupBy(*group_by).agg(
        F.count(F.lit(1)).alias("total"),
        F.count(em).alias("n_gold"),
        F.coalesce(F.sum(em), F.lit(0)).cast("bigint").alias("correct"),
        F.coalesce(F.avg(em), F.lit(0.0)).alias("accuracy"))


def parse_ok_count(df: DataFrame, text_col: str = "generated",
                   group_by: Sequence[str] = ()) -> DataFrame:
    """A4: rows whose generation contains ``####``."""
    return df.groupBy(*group_by).agg(
        F.count_if(F.coalesce(F.contains(_c(text_col), F.lit("####")), F.lit(False)))
         .alias("parse_ok"))


def compare_experiments(runs: dict[str, DataFrame], em_col: str = "em",
                        text_col: str = "generated") -> DataFrame:
    """A5: ``label -> predictions`` to one row per label: total, n_gold, correct, accuracy
    (gold-only denominator), parseable count."""
    u = None
    for label, df in runs.items():
        t = df.select(F.lit(label).alias("label"), _c(em_col).cast("int").alias("em"),
                      _c(text_col).alias("generated"))
        u = t if u is None else u.unionByName(t)
    return compare_labels(u)


def compare_labels(df: DataFrame, label_col: str = "label", em_col: str = "em",
                   text_col: str = "generated") -> DataFrame:
    """A5 over one table of predictions with a ``label`` column: one pass for any number of labels."""
    em = _c(em_col).cast("int")
    return df.groupBy(label_col).agg(
        F.count(F.lit(1)).alias("total"),
        F.count(em).alias("n_gold"),
        F.coalesce(F.sum(em), F.lit(0)).cast("bigint").alias("correct"),
        F.coalesce(F.avg(em), F.lit(0.0)).alias("accuracy"),
        F.count_if(F.coalesce(F.contains(_c(text_col), F.lit("####")), F.lit(False)))
         .alias("parse_ok"))


# ---- A7 -----------------------------------------------------------------------

def stage_report(run: str, metrics: Sequence[tuple[str, str, DataFrame, Column]]) -> DataFrame:
    """``(stage, metric, frame, aggregate)`` entries to rows ``run, stage, metric,
    value``. Each aggregate runs as its own partial aggregation; the union is tiny."""
    u = None
    for stage, metric, df, agg in metrics:
        t = df.agg(agg.cast("double").alias("value")).select(
            F.lit(run).alias("run"), F.lit(stage).alias("stage"), F.lit(metric).alias("metric"),
            "value")
        u = t if u is None else u.unionByName(t)
    return u


# ---- running totals (A8) ------------------------------------------------------

def _offsets(totals: DataFrame, block_col: str, value_cols: Sequence[str], block_size: int,
             n_blocks: int) -> DataFrame:
    """Per block the sums of ``value_cols`` over all earlier blocks (``__o_*``)."""
    if n_blocks <= block_size:
        before = Window.orderBy(block_col).rowsBetween(Window.unboundedPreceding, -1)
        return totals.select(block_col, *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"__o_{c}")
                                          for c in value_cols])
    upto = running_totals(totals, block_col, value_cols, block_size)
    return upto.select(block_col, *[(F.col(f"cum_{c}") - F.col(c)).alias(f"__o_{c}") for c in value_cols])


def running_totals(df: DataFrame, order_col: str, value_cols: Sequence[str],
                   block_size: int = 4096) -> DataFrame:
    """Prefix sums of ``value_cols`` along an integer ``order_col`` (one row per value) without
    a global window: every block of ``block_size`` values runs its own window, and the block
    totals are summed the same way, level over level, until one block holds them all. No window at any level holds more than
    ``block_size`` rows. ``df`` is read once per level and should be a stored table."""
    blk = f"__blk_{order_col}"
    d = df.withColumn(blk, F.floor(F.col(order_col) / F.lit(block_size)))
    totals = d.groupBy(blk).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in value_cols])
    ends = df.agg(F.min(order_col), F.max(order_col)).first()
    n_blocks = 0 if ends[0] is None else ends[1] // block_size - ends[0] // block_size + 1
    offsets = _offsets(totals, blk, value_cols, block_size, n_blocks)
    inside = Window.partitionBy(blk).orderBy(order_col).rowsBetween(Window.unboundedPreceding, 0)
    out = d.join(offsets, blk)
    for c in value_cols:
        out = out.withColumn(f"cum_{c}", F.col(f"__o_{c}") + F.coalesce(F.sum(c).over(inside), F.lit(0)))
    return out.drop(blk, *[f"__o_{c}" for c in value_cols])


def progress_counters(batch_stats: DataFrame, every: int = 10, batch_col: str = "batch_id",
                      kept_cols: Sequence[str] = ("fwd_kept", "rat_kept")) -> DataFrame:
    """Running kept counts reported after every ``every``-th micro-batch."""
    rt = running_totals(batch_stats, batch_col, list(kept_cols))
    return rt.filter(((F.col(batch_col) + 1) % every) == 0)


# ---- A9 -----------------------------------------------------------------------

def loss_rollup(log: DataFrame, run_col: str = "run", phase_col: str = "phase",
                epoch_col: str = "epoch", loss_col: str = "loss") -> DataFrame:
    """Per run, phase and epoch: ``epoch_loss = sum(loss or 0) / batches``,
    ``perplexity = exp(epoch_loss)`` (NaN where that overflows), ``best_loss`` = running minimum over epochs, and the
    run averages of epoch losses, of perplexities (not exp of the average) and of the
    running best (what the workload reports as the average validation loss)."""
    per_epoch = log.groupBy(run_col, phase_col, epoch_col).agg(
        F.count(F.lit(1)).alias("batches"),
        (F.sum(F.coalesce(_c(loss_col), F.lit(0.0))) / F.count(F.lit(1))).alias("epoch_loss"))
    w_run = Window.partitionBy(run_col, phase_col)
    w_best = w_run.orderBy(epoch_col).rowsBetween(Window.unboundedPreceding, 0)
    return (per_epoch
            .withColumn("perplexity", F.when(F.exp("epoch_loss") == F.lit(float("inf")), F.lit(float("nan")))
                        .otherwise(F.exp("epoch_loss")))
            .withColumn("best_loss", F.min("epoch_loss").over(w_best))
            .withColumn("avg_loss", F.avg("epoch_loss").over(w_run))
            .withColumn("avg_perplexity", F.avg("perplexity").over(w_run))
            .withColumn("avg_best_loss", F.avg("best_loss").over(w_run)))


def step_rollup(log: DataFrame, run_col: str = "run", phase_col: str = "phase",
                step_col: str = "step", loss_col: str = "loss") -> DataFrame:
    """A9, step series: per run and phase the steps that have a loss, the averages of their losses and
    of their perplexities (``exp(loss)``, NaN where that overflows), the lowest and the last loss."""
    loss = _c(loss_col)
    ppl = F.when(F.exp(loss) == F.lit(float("inf")), F.lit(float("nan"))).otherwise(F.exp(loss))
    return log.filter(loss.isNotNull()).groupBy(run_col, phase_col).agg(
        F.count(F.lit(1)).alias("steps"), F.avg(loss).alias("avg_step_loss"),
        F.avg(ppl).alias("avg_step_perplexity"), F.min(loss).alias("best_step_loss"),
        F.max_by(loss, _c(step_col)).alias("last_step_loss"))


# ---- L1 / L2 / L3 -------------------------------------------------------------

def _scored_once(df: DataFrame) -> DataFrame:
    """``df`` with its columns computed before any filter that follows. A filter on a scored column would
    be pushed below the scoring and repeat the whole extraction in its condition; a row's partition number,
    which no filter may pass, keeps it above."""
    return df.withColumn("__once", F.spark_partition_id()).filter(F.col("__once") >= 0)


def _mismatches(df: DataFrame, em_col: str) -> DataFrame:
    return _scored_once(df).filter(F.coalesce(_c(em_col).cast("int"), F.lit(-1)) == 0).drop("__once")


def top_mismatches(df: DataFrame, n: int, em_col: str = "em", order_col: str | list[str] = "ordinal",
                   group_by: Sequence[str] = ()) -> DataFrame:
    """L1: the first ``n`` rows with em = 0 in source order (per group when given)."""
    miss = _mismatches(df, em_col)
    if not group_by:
        return miss.orderBy(order_col).limit(n)
    w = Window.partitionBy(*group_by).orderBy(order_col)
    return miss.withColumn("__rn", F.row_number().over(w)).filter(F.col("__rn") <= n).drop("__rn")


def mismatch_export(scored: DataFrame, em_col: str = "em") -> DataFrame:
    """L2: every mismatch (em = 0) with its raw and extracted values."""
    return _mismatches(scored, em_col)


def zero_shot_record(df: DataFrame, generated_col: str = "generated", gold_col: str = "gold",
                     golds: DataFrame | None = None, id_col: str = "id",
                     idx_col: str = "cand_idx", highest: int | None = None) -> DataFrame:
    """L3: one wide prediction row — stripped generation, rationale (all non-blank lines but
    the last), extracted answer (X3), gold, extracted gold and M3 em (NULL when the gold
    extracts to "").

    With ``golds`` (``id, gold`` and any other per-problem columns) the gold side is
    extracted once per problem and joined to the generations, spread by their ``idx_col`` (``highest``: as in ``skew.block_join``);
    otherwise ``df`` carries the gold itself."""
    if golds is None:
        df = df.withColumn("gold", F.coalesce(_c(gold_col), F.lit("")))
    # the generations' own extraction comes before the join, on their evenly split partitions
    staged = df.withColumn("generated", trim_u(_c(generated_col)))
    staged = A.with_extracted(staged, "cascade_last", "generated", "answer")
    staged = A.with_normalized(staged, "integral", "answer", "__pn")
    staged = staged.withColumn("rationale", rationale_from_generation(F.col("generated")))
    gold = staged if golds is None else golds.withColumn("gold", F.coalesce(_c(gold_col), F.lit("")))
    gold = A.with_extracted(gold, "cascade_last", "gold", "gold_extracted")
    gold = A.with_normalized(gold, "integral", "gold_extracted", "__gn")
    staged = gold if golds is None else block_join(staged, gold, id_col, idx_col, highest=highest)
    return (staged
            .withColumn("em", F.when(F.col("gold_extracted") == "", F.lit(None).cast("int"))
                        .otherwise((F.col("__gn") == F.col("__pn")).cast("int")))
            .drop("__pn", "__gn"))
