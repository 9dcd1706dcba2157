"""Registered queries: each takes ``(spark, sf_dir)`` and returns a DataFrame over the
driver's tables (through the derived fixture in :mod:`reasonloop.plans.fixture`)."""

from __future__ import annotations

from pyspark.errors import PythonException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import answers as A
from ..functions import prompts as PR
from ..functions import records as RC
from ..operators import batches as B
from ..operators import report as R
from ..operators import selection as S
from ..operators.generate import TableGenerator, candidates_for
from ..operators.genstore import GenerationRun, PromptStore
from ..operators.merge import MergedTable
from ..operators.ordinal import with_file_ordinal, with_ordinal
from ..operators.skew import block_join
from ..session import materialize, materialize_observed, scratch_path
from ..sources import jsonl as J
from ..sources import splits as SP
from ..streaming import incremental as ST
from . import fixture as FX

RATIONALIZE_SHIFT = 2   # rationalised candidates: same lines, shapes shifted by two
RETRY_SHIFT = 1         # greedy retry output: the last candidate, shapes shifted by one
PREV_RETRY_SHIFT = 0    # the previous iteration's greedy retry output: last candidate as is


def keep_first_correct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R3 with the ``hash_then_any`` profile: first correct candidate per problem."""
    fx = FX.Tables(spark, sf_dir)
    return S.keep_first_correct(fx.candidates(), fx.problems_once)


def greedy_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A1 over a greedy evaluation: each problem's first candidate scored with
    ``hash_loose``; problems with no candidate count as wrong."""
    fx = FX.Tables(spark, sf_dir, shared_lines=False)
    probs = fx.problems_once
    first = fx.candidates().filter(F.col("cand_idx") == 1)
    preds = probs.join(first.select("id", "text"), "id", "left").withColumn(
        "em", A.em_hash_loose(F.col("answer"), F.col("text")))
    return R.em_accuracy(preds).withColumn("accuracy", F.round("accuracy", 8))


def _forward_and_missed(fx: FX.Tables, materialize_kept: bool = False):
    probs = fx.problems
    kept = S.keep_first_correct(fx.candidates(), probs)
    if materialize_kept:
        kept = materialize(kept, "kept")
    return probs, kept, S.missed_problems(probs, kept)


def missed_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Problems with no kept forward candidate."""
    fx = FX.Tables(spark, sf_dir)
    _, _, missed = _forward_and_missed(fx)
    return missed.select("id", "question", "answer")


def _rationalize(fx: FX.Tables, missed):
    """Hint prompt with the numeric gold (P4/P1), the generations stored for that very
    prompt (R1), first correct kept (R3)."""
    prompts = missed.select(
        "id", "question", "answer",
        PR.render(PR.RATIONALIZE, question=F.col("question"),
                  gold_final=RC.hint_final(F.col("answer"))).alias("prompt"))
    store = PromptStore(fx.recorded_hinted(RATIONALIZE_SHIFT), FX.RECORDED_SETTINGS, fx.largest_order)
    return S.keep_first_correct(candidates_for(prompts, store), prompts)


def rationalize_missed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rationalised kept rows for the forward misses."""
    fx = FX.Tables(spark, sf_dir)
    _, _, missed = _forward_and_missed(fx)
    return _rationalize(fx, missed)


def one_iteration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R14 + R6 + P5 + P10: forward, rationalise the misses, merge (rationalised rows win),
    class-format text, format gate — the generic iteration with stored generations."""
    from .iteration import run_iteration
    fx = FX.Tables(spark, sf_dir)
    res = run_iteration(fx.problems, TableGenerator(fx.candidates()),
                        TableGenerator(fx.candidates(RATIONALIZE_SHIFT)))
    return res.train


def merge_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R6 on overlapping sources: first-correct picks over the forward candidates and over
    the shifted candidates for *all* problems; the later source wins per id, the position
    of the first sighting is kept."""
    fx = FX.Tables(spark, sf_dir)
    probs = fx.problems
    a = S.keep_first_correct(fx.candidates(), probs)
    b = S.keep_first_correct(fx.candidates(RATIONALIZE_SHIFT), probs)
    m = S.merge_last_wins([materialize(d.select("id", "rationale", "cand_idx"), "merge-source") for d in (a, b)],
                          order_col="id")
    return m.select("id", "rationale", "cand_idx", "src",
                    F.col("pos.__src").alias("first_src"), F.col("pos.__ord").alias("first_pos"))


def incremental_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R6, incremental form: three overlapping sources are merged one after the other into a table cut by id, the
    last of them holding urgent orders only."""
    fx = FX.Tables(spark, sf_dir)
    probs = fx.problems
    urgent = FX.table(spark, sf_dir, "orders").filter("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("id"))
    merged = MergedTable(spark, scratch_path(spark, "merged"), order_col="id", parts=16)
    for shift in (0, RATIONALIZE_SHIFT, RETRY_SHIFT):
        kept = S.keep_first_correct(fx.candidates(shift), probs).select("id", "rationale", "cand_idx")
        merged.add(kept.join(urgent, "id", "left_semi") if shift == RETRY_SHIFT else kept)
    return merged.read().select("id", "rationale", "cand_idx", "src", F.col("pos.__src").alias("first_src"),
                                F.col("pos.__ord").alias("first_pos"))


def _misses_for_retry(fx: FX.Tables, shared: bool = False):
    """``shared``: several branches read the misses, so they are written."""
    _, _, missed = _forward_and_missed(fx)
    missed = missed.select("id", "question", F.col("answer").alias("gold_answer"))
    return materialize(missed, "misses") if shared else missed


def _greedy_retry_outputs(fx: FX.Tables, shift: int):
    """One stored greedy output per problem: its last candidate (R2 pick) of a shifted set."""
    return S.last_candidates(fx.candidates(shift)).select("id", "text")


def retry_keep_correct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One hinted greedy output per miss, kept when the ``hash_loose`` match holds."""
    fx = FX.Tables(spark, sf_dir)
    misses = _misses_for_retry(fx)
    return S.retry_keep_correct(misses, _greedy_retry_outputs(fx, RETRY_SHIFT))


def retry_shortest_correct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best of K retries per miss — the shortest matching text, ties to the earliest."""
    fx = FX.Tables(spark, sf_dir)
    misses = _misses_for_retry(fx)
    outs = fx.candidates(RATIONALIZE_SHIFT)
    return S.retry_shortest_correct(misses, outs)


def shortest_vs_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R3 vs R9 on all problems (``hash_then_any``): the problems whose first correct and
    shortest correct candidates differ."""
    fx = FX.Tables(spark, sf_dir)
    keys = S.gold_keys(fx.problems, "hash_then_any")
    cands = fx.candidates()
    first = S.best_index(cands, keys, "hash_then_any")
    short = S.best_index(cands, keys, "hash_then_any", shortest=True)
    return (first.select("id", F.col("cand_idx").alias("first_idx"))
            .join(short.select("id", F.col("cand_idx").alias("shortest_idx")), "id")
            .filter(F.col("first_idx") != F.col("shortest_idx")))


def retry_flag_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plain-prompt greedy retry, every output kept with ``em_after``."""
    fx = FX.Tables(spark, sf_dir)
    misses = _misses_for_retry(fx)
    return S.retry_flag_all(misses, _greedy_retry_outputs(fx, RETRY_SHIFT))


def _retry_rows(fx: FX.Tables, shift, misses, keep_all):
    outs = _greedy_retry_outputs(fx, shift)
    return S.retry_flag_all(misses, outs) if keep_all else S.retry_keep_correct(misses, outs)


def train_set_correct_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    """This iteration's kept retries with an extractable final, bag-unioned with the
    previous iteration's set (no dedupe)."""
    fx = FX.Tables(spark, sf_dir)
    misses = _misses_for_retry(fx, shared=True)
    prev = S.training_rows(_retry_rows(fx, PREV_RETRY_SHIFT, misses, False))
    cur = S.training_rows(_retry_rows(fx, RETRY_SHIFT, misses, False))
    return S.cumulative_training_set(cur, prev)


def train_set_keep_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every retry row (answer "" when no final), bag-unioned with the previous set."""
    fx = FX.Tables(spark, sf_dir)
    misses = _misses_for_retry(fx, shared=True)
    prev = S.training_rows(_retry_rows(fx, PREV_RETRY_SHIFT, misses, True),
                           correct_only=False)
    cur = S.training_rows(_retry_rows(fx, RETRY_SHIFT, misses, True),
                          correct_only=False)
    return S.cumulative_training_set(cur, prev)


def _greedy_predictions(fx: FX.Tables):
    """Batched-eval style predictions: ``hf_test_<orderkey>`` ids, first candidate as the
    output, ``hash_loose`` em. Orders in status P lose their question and urgent orders
    their gold, so the backfill path has work to do."""
    probs = fx.problems
    orders = FX.table(fx.spark, fx.sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"), "o_orderstatus", "o_orderpriority")
    first = fx.candidates().filter(F.col("cand_idx") == 1).select("id", "text")
    j = probs.join(orders, "id").join(first, "id", "left")
    return j.select(
        F.concat(F.lit(S.TEST_ID_PREFIX), F.col("id").cast("string")).alias("id"),
        F.when(F.col("o_orderstatus") != "P", F.col("question")).alias("question"),
        F.when(F.col("o_orderpriority") != "1-URGENT", F.col("answer")).alias("gold_answer"),
        F.col("text").alias("output"),
        A.em_hash_loose(F.col("answer"), F.col("text")).alias("em"))


def collect_misses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Misses of the greedy evaluation, question and gold backfilled from the dataset
    by the index parsed from the id."""
    fx = FX.Tables(spark, sf_dir, shared_lines=False)
    preds = _greedy_predictions(fx)
    dataset = fx.problems.select(F.col("id").alias("ordinal"), "question", "answer")
    return S.collect_misses(preds, dataset)


def extract_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X1, X2, X2f, X3, X4 (both cue lists), X5 over every candidate text."""
    fx = FX.Tables(spark, sf_dir, shared_lines=False)
    c = fx.candidates()
    t = F.col("text")
    return c.select("id", "cand_idx",
                    A.extract_hash_loose(t).alias("x_hash_loose"),
                    A.extract_hash_strict(t).alias("x_hash_strict"),
                    A.extract_last_number(t).alias("x_last_number"),
                    A.extract_cascade_last(t).alias("x_cascade_last"),
                    A.extract_cascade_first(t).alias("x_cascade_first"),
                    A.extract_cascade_first(t, with_result=False).alias("x_cascade_first_shell"),
                    A.extract_solution_number(t).alias("x_solution_number"))


def em_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M1-M4 and the N1-N4 normalisations over every (candidate, gold) pair. Gold keys are
    computed once per problem; the extracted prediction values double as the M3/M4 keys."""
    fx = FX.Tables(spark, sf_dir)
    probs = fx.problems_once.select("id", "answer")
    keys = A.with_gold_keys(probs, {"hash_loose": "gk_loose", "hash_then_any": "gk_any", "cascade_last": "gk_last",
                                    "cascade_first": "gk_first"}, "answer").drop("answer")
    d = A.with_cascades(fx.candidates(), "text", {"cascade_last": "x3", "cascade_first": "x4"})
    d = A.with_normalized(d, "integral", "x3", "n_integral")
    d = A.with_normalized(d, "rounded", "x4", "n_rounded")
    d = A.with_pred_key(d, "hash_loose", "text", "pk_loose")
    d = A.with_pred_key(d, "hash_then_any", "text", "pk_any")
    d = d.select("id", "cand_idx", A.normalize_trim(F.col("text")).alias("n_trim"),
                 A.normalize_money(A.extract_last_number(F.col("text"))).alias("n_money"),
                 "n_integral", "n_rounded", "pk_loose", "pk_any")
    return block_join(d, keys, "id").select(
        "id", "cand_idx", "n_trim", "n_money", "n_integral", "n_rounded",
        A.em_from_keys("hash_loose", "gk_loose", "pk_loose").cast("int").alias("em_hash_loose"),
        A.em_from_keys("hash_then_any", "gk_any", "pk_any").cast("int").alias("em_hash_then_any"),
        A.em_from_keys("cascade_last", "gk_last", "n_integral").alias("em_cascade_last"),
        A.em_from_keys("cascade_first", "gk_first", "n_rounded").alias("em_cascade_first"))


def answer_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X1-X5, N1-N4 and M1-M4 over texts with every cue, sign, separator and empty form, against golds
    that may be null, empty or unmarked (no join: the gold is in the row)."""
    t = F.col("text")
    d = A.with_cascades(FX.answer_texts(spark, sf_dir), "text", {"cascade_last": "x_last", "cascade_first": "x_first"})
    d = A.with_normalized(d, "integral", "x_last", "n_integral")
    d = A.with_normalized(d, "rounded", "x_first", "n_rounded")
    for profile in ("hash_loose", "hash_then_any"):
        d = A.with_pred_key(d, profile, "text", f"pk_{profile}")
    d = A.with_gold_keys(d, {p: f"gk_{p}" for p in ("hash_loose", "hash_then_any", "cascade_last", "cascade_first")}, "gold")
    return d.select(
        "id", "line", "part", "supp", A.extract_hash_loose(t).alias("x_hash_loose"),
        A.extract_hash_strict(t).alias("x_hash_strict"), A.extract_last_number(t).alias("x_last_number"),
        A.extract_solution_number(t).alias("x_solution_number"), "x_last", "x_first",
        A.normalize_trim(t).alias("n_trim"), A.normalize_money(t).alias("n_money"), "n_integral", "n_rounded",
        A.em_from_keys("hash_loose", "gk_hash_loose", "pk_hash_loose").cast("int").alias("em_hash_loose"),
        A.em_from_keys("hash_then_any", "gk_hash_then_any", "pk_hash_then_any").cast("int").alias("em_hash_then_any"),
        A.em_from_keys("cascade_last", "gk_cascade_last", "n_integral").alias("em_cascade_last"),
        A.em_from_keys("cascade_first", "gk_cascade_first", "n_rounded").alias("em_cascade_first"))


def gold_sft_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The training set of the baseline stage, from worked solutions (each problem's first
    candidate; problems without one have an empty solution)."""
    fx = FX.Tables(spark, sf_dir, shared_lines=False)
    first = fx.candidates().filter(F.col("cand_idx") == 1).select("id", F.col("text").alias("solution"))
    return RC.sft_set(fx.problems_once.join(first, "id", "left"))


def step_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A9, step series: per run and phase over the steps that have a loss."""
    out = R.step_rollup(FX.loss_log(spark, sf_dir))
    for c in ("avg_step_loss", "avg_step_perplexity", "best_step_loss", "last_step_loss"):
        out = out.withColumn(c, F.round(c, 8))
    return out


def zero_shot_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L3 + A3: wide zero-shot prediction rows (P8 rationale, X3 answer, M3 em) re-scored
    from stored generations (every candidate against its problem's gold)."""
    fx = FX.Tables(spark, sf_dir, shared_lines=False)
    probs = fx.problems_once.select("id", "question", F.col("answer").alias("gold"))
    gens = fx.candidates().select("id", "cand_idx", F.col("text").alias("generated"))
    recs = R.zero_shot_record(gens, golds=probs, highest=fx.largest_order)
    return recs.select("id", "cand_idx", "question", "generated", "rationale", "answer", "gold",
                       "gold_extracted", "em")


def rescore_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A2 + A3: gold-only accuracy of the re-scored zero-shot rows, per candidate index."""
    recs = zero_shot_records(spark, sf_dir)
    out = R.em_accuracy_gold_only(recs, group_by=["cand_idx"])
    return out.withColumn("accuracy", F.round("accuracy", 8))


def rescore_stored_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A3 + P3: re-score stored zero-shot predictions. The gold is resolved through the
    ``gold, answer, final_answer, answer_text`` chain and the prediction through
    ``answer, generated, final_answer`` (``a or b`` semantics: empty falls through), both
    re-extracted (X3) when non-empty; em is NULL without a gold, else the N3 comparison."""
    stored = materialize(zero_shot_records(spark, sf_dir).select("id", "cand_idx", "question", "generated", "answer", "gold"),
                         "stored-predictions")
    g_raw = RC.resolve_field(stored, RC.GOLD_ALIASES_EVAL)
    p_raw = RC.resolve_field(stored, RC.PRED_ALIASES)
    d = stored.select("id", "cand_idx", g_raw.alias("gold_raw"), p_raw.alias("pred_raw"))
    d = A.with_extracted(d, "cascade_last", "gold_raw", "__gx")
    d = A.with_extracted(d, "cascade_last", "pred_raw", "__px")
    d = (d.withColumn("gold_extracted", F.when(F.col("gold_raw") != "", F.col("__gx")).otherwise(F.col("gold_raw")))
          .withColumn("pred_extracted", F.when(F.col("pred_raw") != "", F.col("__px")).otherwise(F.col("pred_raw"))))
    d = A.with_normalized(d, "integral", "gold_extracted", "__gn")
    d = A.with_normalized(d, "integral", "pred_extracted", "__pn")
    d = d.withColumn("em", F.when(F.col("gold_raw") == "", F.lit(None).cast("int"))
                     .otherwise((F.col("__gn") == F.col("__pn")).cast("int")))
    return d.select("id", "cand_idx", "gold_raw", "gold_extracted", "pred_raw", "pred_extracted", "em")


def _variant_predictions(fx: FX.Tables):
    """Problems x the three prompt variants (rendered, A6), each answered by the generations stored
    for that very prompt (a variant without one counts as a miss); M4 em with the first-match
    cascade as in the ablation script."""
    keys = A.with_gold_key(fx.problems.select("id", "question", "answer"), "cascade_first_shell", "answer", "gk")
    store = PromptStore(fx.recorded_variants(), FX.RECORDED_SETTINGS, fx.largest_order)
    asked = store.keyed(PR.explode_variants(keys)).select("prompt_key", "id", "variant", "answer", "gk")
    j = A.with_pred_key(store.answered(asked), "cascade_first_shell", "text", "pk")
    return j.select("id", "variant", "cand_idx", F.col("text").alias("generated"), "answer",
                    A.em_from_keys("cascade_first_shell", "gk", "pk").alias("em"))


def prompt_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EM and mismatch counts per prompt variant over the same problems."""
    fx = FX.Tables(spark, sf_dir, shared_lines=False)
    p = _variant_predictions(fx)
    return p.groupBy("variant").agg(
        F.count(F.lit(1)).alias("total"),
        F.sum("em").cast("bigint").alias("correct"),
        F.sum(1 - F.col("em")).cast("bigint").alias("mismatches"),
        F.round(F.sum("em") / F.count(F.lit(1)), 8).alias("em_rate"))


def ablation_mismatches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L1 per variant: the first six mismatches of each variant in problem order."""
    fx = FX.Tables(spark, sf_dir, shared_lines=False)
    p = _variant_predictions(fx)
    return (R.top_mismatches(p, 6, order_col=["id", "cand_idx"], group_by=["variant"])
            .select("variant", "id", "cand_idx", "generated", "em"))


def experiment_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A5 + A4: label -> EM %, evaluated/total, parseable count, for every stored prediction set
    (the candidates of one index, re-scored with M3) in one pass."""
    recs = zero_shot_records(spark, sf_dir)
    out = R.compare_labels(recs.withColumn("label", F.concat(F.lit("cand"), F.col("cand_idx").cast("string"))))
    return out.withColumn("accuracy", F.round("accuracy", 8))


def top_mismatches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L1: the first 20 greedy-evaluation mismatches in problem order."""
    fx = FX.Tables(spark, sf_dir, shared_lines=False)
    probs = fx.problems_once
    first = fx.candidates().filter(F.col("cand_idx") == 1).select("id", "text")
    p = probs.join(first, "id", "left").withColumn(
        "em", A.em_hash_loose(F.col("answer"), F.col("text")).cast("int"))
    return R.top_mismatches(p.withColumn("ordinal", F.col("id")), 20).select("id", "text", "answer", "em")


def mismatch_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L2: every M3 mismatch with raw and extracted gold and prediction."""
    recs = zero_shot_records(spark, sf_dir)
    return R.mismatch_export(recs).select(
        "id", "cand_idx", F.col("gold").alias("gold_raw"), "gold_extracted",
        F.col("generated").alias("pred_raw"), F.col("answer").alias("pred_extracted"), "em")


def stage_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per stage metric of an iteration: greedy EM, misses, generated, kept,
    train size."""
    fx = FX.Tables(spark, sf_dir)
    count = F.count(F.lit(1))
    first = fx.candidates().filter(F.col("cand_idx") == 1)
    preds = fx.problems.join(first.select("id", "text"), "id", "left").select(
        "id", A.em_hash_loose(F.col("answer"), F.col("text")).cast("int").alias("em"))
    # every metric is observed by the job that writes its table
    _, em = materialize_observed(preds, "zero-shot", {"em": F.avg(F.coalesce("em", F.lit(0)))})
    misses, missed = materialize_observed(_misses_for_retry(fx), "misses", {"n": count})
    kept, right = materialize_observed(_retry_rows(fx, RETRY_SHIFT, misses, False), "retried", {"n": count})
    _, train = materialize_observed(S.training_rows(kept), "train-set", {"n": count})
    rows = [("zero_shot", "em", round(em["em"] or 0.0, 8)), ("iter2", "misses", missed["n"]), ("iter2", "generated", missed["n"]),
            ("iter2", "kept_correct", right["n"]), ("iter2", "train_size", train["n"])]
    return spark.createDataFrame([("fixture", s, m, float(v)) for s, m, v in rows],
                                 "run string, stage string, metric string, value double")


def progress_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running forward-kept / rationalised-kept totals every 10 micro-batches of 16
    problems (problem order = id)."""
    fx = FX.Tables(spark, sf_dir)
    probs = with_ordinal(fx.problem_ids, ["id"])
    _, kept, missed = _forward_and_missed(fx, materialize_kept=True)
    rat = _rationalize(fx, missed)
    flags = (probs.select("id", "ordinal")
             .join(kept.select("id", F.lit(1).alias("f")), "id", "left")
             .join(rat.select("id", F.lit(1).alias("r")), "id", "left"))
    stats = SP.batch_ids(flags, 16).groupBy("batch_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.coalesce(F.sum("f"), F.lit(0)).cast("bigint").alias("fwd_kept"),
        F.coalesce(F.sum("r"), F.lit(0)).cast("bigint").alias("rat_kept"))
    out = R.progress_counters(materialize(stats, "batch-stats"), every=10)
    return out.select("batch_id", "fwd_kept", "rat_kept", "cum_fwd_kept", "cum_rat_kept")


def loss_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per run/phase/epoch loss, perplexity, best-so-far loss, run averages."""
    out = R.loss_rollup(FX.loss_log(spark, sf_dir))
    for c in ("epoch_loss", "perplexity", "best_loss", "avg_loss", "avg_perplexity", "avg_best_loss"):
        out = out.withColumn(c, F.round(c, 8))
    return out


def _csv(c):
    return F.array_join(F.col(c), ",").alias(c)


def sft_batches(spark: SparkSession, sf_dir: str, max_seq_len: int | None = 32) -> DataFrame:
    """T1 + T2: concatenate/mask token arrays, batches of 8 consecutive examples (line-item
    order), cut to ``min(longest, 32)`` and right-pad."""
    ex = with_ordinal(FX.token_examples(spark, sf_dir),
                      ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate"])
    b = B.padded_examples(SP.batch_ids(ex, 8), max_seq_len=max_seq_len, pad_id=0)
    return b.select("ordinal", "batch_id", "max_len", _csv("input_ids"),
                    _csv("attention_mask"), _csv("labels"))


def sft_batches_uncapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pad to the longest example of the batch, no cut."""
    return sft_batches(spark, sf_dir, max_seq_len=None)


def split_assignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S5, S6, S7, S9, S10 on the problem table in file order (which is id order): ordinal ids, head-100 flag,
    tail hold-out flag, shard of 4, the first 50 of shard 1 and batch of 16."""
    orders = FX.table(spark, sf_dir, "orders").select("o_orderkey")
    probs = with_file_ordinal(orders).withColumnRenamed("o_orderkey", "id")
    probs, seen = materialize_observed(probs, "ordinals", {"n": F.count(F.lit(1))})
    n = seen["n"]
    train, val = SP.tail_holdout(probs, n=n)
    sides = train.withColumn("is_val", F.lit(False)).unionByName(val.withColumn("is_val", F.lit(True)))
    shards = None
    for i in range(4):
        part = SP.shard(sides, 4, i, n=n).withColumn("shard", F.lit(i))
        shards = part if shards is None else shards.unionByName(part)
    first = SP.head(probs, 100).select("id", F.lit(True).alias("in_head"))
    in_shard = SP.shard(probs, 4, 1, n=n, limit=50).select("id", F.lit(True).alias("in_limited_shard"))
    out = SP.batch_ids(SP.ordinal_ids(shards, S.TEST_ID_PREFIX, id_col="test_id"), 16)
    out = out.join(first, "id", "left").join(in_shard, "id", "left")
    return out.select("id", "ordinal", "test_id", F.coalesce("in_head", F.lit(False)).alias("in_head"), "is_val", "shard",
                      F.coalesce("in_limited_shard", F.lit(False)).alias("in_limited_shard"), "batch_id")


def hash_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seeded 10 % test split by key hash; every problem with its side."""
    fx = FX.Tables(spark, sf_dir)
    probs = fx.problem_ids
    train, test = SP.hash_split(probs, 0.1, seed=42)
    return train.withColumn("split", F.lit("train")).unionByName(test.withColumn("split", F.lit("test")))


def conversation_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P5, P7, P8, P10 over (user turn, next assistant turn) pairs: rationale split,
    class-format text, SFT target (reference and legacy profiles), format gate."""
    pairs = FX.conversation_pairs(spark, sf_dir)
    g = F.col("generated")
    staged = pairs.select("conv_id", "turn", "question", "generated",
                          RC.rationale_from_generation(g).alias("rationale"),
                          F.coalesce(A.extract_last_number(g), F.lit("")).alias("final"))
    out = staged.select(
        "conv_id", "turn", "rationale",
        RC.class_text(F.col("question"), F.col("rationale"), F.col("final")).alias("text"),
        RC.sft_target(F.col("rationale"), F.col("final"), "reference").alias("target"),
        RC.sft_target(F.col("rationale"), F.col("final"), "legacy").alias("target_legacy"))
    return out.withColumn("format_ok", RC.format_ok(F.col("text")))


def sft_triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SFT triples from worked solutions (candidate texts) and answer fields."""
    fx = FX.Tables(spark, sf_dir)
    c = block_join(fx.candidates(), fx.problems_once.select("id", "question", "answer"), "id")
    rationale, answer = RC.sft_triple(F.col("text"), F.col("answer"))
    legacy_r, legacy_a = RC.sft_triple_legacy(F.col("text"), F.lit(None).cast("string"), F.col("answer"))
    return c.select("id", "cand_idx", "question", rationale.alias("rationale"), answer.alias("answer"),
                    legacy_r.alias("legacy_rationale"), legacy_a.alias("legacy_answer"))


def render_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forward, rationalise (numeric gold hint), hint, zero-shot and SFT
    prompts per problem."""
    fx = FX.Tables(spark, sf_dir)
    p = fx.problems_once
    q, a = F.col("question"), F.col("answer")
    return p.select("id",
                    PR.render(PR.FORWARD, question=q).alias("forward"),
                    PR.render(PR.RATIONALIZE, question=q, gold_final=RC.hint_final(a)).alias("rationalize"),
                    PR.render(PR.RATIONALIZE, question=q, gold_final=RC.hint_final(a, True)).alias("rationalize_full"),
                    PR.render(PR.HINT, question=q).alias("hint"),
                    PR.render(PR.ZERO_SHOT, q=q).alias("zero_shot"),
                    *[PR.render(PR.TEMPLATES[v], q=q).alias(v) for v in PR.VARIANTS],
                    PR.render(PR.SFT_PROMPT, q=q).alias("sft"))


def prompt_echo_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decoded outputs that echo the forward prompt, with the echo removed."""
    fx = FX.Tables(spark, sf_dir)
    c = block_join(fx.candidates(), fx.problems_once.select("id", "question"), "id")
    prompt = PR.render(PR.FORWARD, question=F.col("question"))
    echoed = F.when(F.col("cand_idx") % 2 == 0, F.concat(prompt, F.col("text"))).otherwise(F.col("text"))
    return c.select("id", "cand_idx", RC.strip_prompt_echo(echoed, prompt).alias("output"))


def regroup_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R2: candidates regrouped per problem (count, first and last by index)."""
    fx = FX.Tables(spark, sf_dir)
    return S.regroup_candidates(fx.candidates())


def _run_stream(spark: SparkSession, sf_dir: str, micro_batches: int = 4) -> dict[str, str]:
    """ST1: the forward + rationalise pass as a file stream over the orders with
    ``foreachBatch`` into ``batch_id=`` folders; the committed output, class-formatted,
    equals the batch iteration's. The orders are first laid out as range-partitioned files
    in the shared folder and the stream takes about ``1 / micro_batches`` of them per
    trigger, so each micro-batch grows with the data."""
    fx = FX.Tables(spark, sf_dir, shared_lines=False)
    orders = FX.table(spark, sf_dir, "orders")
    src = scratch_path(spark, "orders-stream-source")
    n_files = int(spark.conf.get("spark.sql.shuffle.partitions"))
    orders.repartitionByRange(n_files, "o_orderkey").write.parquet(src)
    written = len([f for f in spark.read.parquet(src).inputFiles()])
    golds = ST.lay_out_by_id(FX.order_golds(spark, sf_dir), "l_orderkey")
    # the generations are texts of the numbered lines, which are laid out once for both
    lines = ST.lay_out_by_id(fx.lines)
    forward, rationalized = (FX.texts_of(lines, shift) for shift in (0, RATIONALIZE_SHIFT))

    def to_problems(batch: DataFrame) -> DataFrame:
        low, high = batch.agg(F.min("o_orderkey"), F.max("o_orderkey")).first()
        return FX.problems_from_orders(batch, golds.filter(F.col("l_orderkey").between(low, high)))

    paths = ST.incremental_pass(
        spark, src, orders.schema, to_problems, TableGenerator(forward), TableGenerator(rationalized),
        scratch_path(spark, "incremental"),
        max_files_per_trigger=max(1, -(-written // micro_batches)))
    return paths


def incremental_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST1 + S4: the committed output of all micro-batches, class-formatted, equals the batch
    iteration's."""
    out = ST.read_outputs(_run_stream(spark, sf_dir))
    return out.select("id", RC.class_text(F.col("question"), F.col("rationale"),
                                          F.col("final")).alias("text"), "src")


def stream_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A8 over the stream's committed batches: the running total after the last one equals the
    batch iteration's kept counts."""
    totals = ST.progress(_run_stream(spark, sf_dir), every=1)
    return totals.agg(F.max("cum_fwd_kept").alias("fwd_kept"), F.max("cum_rat_kept").alias("rat_kept"))


def self_training_loop(spark: SparkSession, sf_dir: str, iterations: int = 2) -> DataFrame:
    """The iterative loop over a seeded 90/10 split of the problems. The stand-in
    model is an integer; its generations are the stored candidates shifted by the model
    number (the first one for evaluation, the last one as the greedy retry) and training
    moves it to the next number. Checks data flow, not model quality."""
    fx = FX.Tables(spark, sf_dir)
    return _loop(fx, scratch_path(spark, "selftrain"), iterations)


def _loop(fx: FX.Tables, out_root: str, iterations: int, lost_at: int | None = None, **how):
    """The loop with the stand-in model; ``lost_at``: training fails in this iteration."""
    from . import selftrain as ST13
    spark = fx.spark
    probs = fx.problems.select("id", "question", "answer")
    train, test = SP.hash_split(probs, 0.1, seed=42)

    def generator_for(model: int, purpose: str):
        c = fx.candidates(model)
        if purpose == "eval":
            return TableGenerator(c.filter(F.col("cand_idx") == 1))
        return TableGenerator(S.last_candidates(c).select("id", F.lit(1).alias("cand_idx"), "text"))

    def train_model(start: int, path: str, it: int) -> int:
        if it == lost_at:
            raise ConnectionError("trainer lost")
        return start + 1

    hooks = ST13.LoopHooks(generator_for=generator_for, train=train_model)
    rep = ST13.run_self_training(spark, train, test, hooks, 0, out_root, iterations=iterations, run="fixture", **how)
    return rep.withColumn("value", F.round("value", 8))


def restarted_loop(spark: SparkSession, sf_dir: str, iterations: int = 2) -> DataFrame:
    """R13 + A7: the loop with its baseline stage (P6 set of worked solutions), stopped by a lost trainer in
    its last iteration and started again in the same folder: the committed iterations are kept, the
    lost one runs anew and every report row stands once."""
    fx = FX.Tables(spark, sf_dir)
    first = fx.candidates().filter(F.col("cand_idx") == 1).select("id", F.col("text").alias("solution"))
    worked = RC.sft_set(fx.problems.join(first, "id", "left"))
    root = scratch_path(spark, "restarted")
    try:
        _loop(fx, root, iterations, lost_at=iterations + 1, baseline_set=worked)
    except ConnectionError:
        pass
    return _loop(fx, root, iterations, baseline_set=worked)


KEPT_SCHEMA = "id bigint, question string, rationale string, final string, cand_idx int"


def jsonl_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kept rows written as JSON lines (NULLs kept) to the shared scratch folder and
    read back with an explicit schema in FAILFAST mode; an absent path reads as empty."""
    kept = keep_first_correct(spark, sf_dir)
    path = scratch_path(spark, "kept-jsonl")
    J.write_jsonl(kept, path)
    back = J.read_jsonl(spark, path, KEPT_SCHEMA)
    absent = J.read_jsonl(spark, path + "-absent", KEPT_SCHEMA, missing_ok=True)
    return back.unionByName(absent)


def resumed_generation(spark: SparkSession, sf_dir: str, units: int = 4) -> DataFrame:
    """R1 + S9: every user turn's forward prompt answered by a callable. The first run loses its generator
    in the unit after half of them; the second generates what is not committed, each distinct prompt
    once in all. ``run`` is the run that generated a text, ``generated`` the prompts that both runs
    generated together, ``distinct_prompts`` those there are."""
    turns = FX.user_turns(spark, sf_dir)
    asked = materialize(turns.select("id", PR.render(PR.FORWARD, question="question").alias("prompt")), "prompts")
    run = GenerationRun(spark, scratch_path(spark, "generation-run"), k=2, settings={"do_sample": True}, units=units)
    try:
        run.fill(asked, FX.StepGenerator(run.settings, units, stop_at=units // 2))
    except PythonException as e:
        if "stopped halfway" not in str(e):
            raise
    store = run.fill(asked, FX.StepGenerator(run.settings))
    made = run.generations()
    generated = sum(r["prompts"] for r in run.records().values())
    distinct = asked.agg(F.count_distinct("prompt")).first()[0]
    both = block_join(made, store.keyed(asked).select("prompt_key", "id"), "prompt_key")
    return both.select("id", "cand_idx", "text", "run", F.lit(generated).cast("bigint").alias("generated"),
                       F.lit(distinct).cast("bigint").alias("distinct_prompts"))


def resolved_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P3 + P5: every alias chain over records whose first names may be null, empty or absent, in the ``or`` form (an
    empty value falls through) and the ``get`` form (only null does), and the class text of the record."""
    rows = FX.alias_rows(spark, sf_dir)
    chains = {"gold_train": RC.GOLD_ALIASES, "gold_eval": RC.GOLD_ALIASES_EVAL, "gold_rescore": RC.GOLD_ALIASES_RESCORE,
              "pred": RC.PRED_ALIASES, "asked": RC.QUESTION_ALIASES, "rationale": RC.RATIONALE_ALIASES, "final": RC.FINAL_ALIASES}
    text = RC.class_text(*[RC.resolve_field(rows, chains[c]) for c in ("asked", "rationale", "final")])
    return rows.select("id", "line", "part", "supp", *[RC.resolve_field(rows, c).alias(n) for n, c in chains.items()],
                       *[RC.resolve_field(rows, chains[n], skip_empty=False, default=None).alias(f"{n}_get") for n in ("gold_eval", "asked")],
                       text.alias("text"))


def positional_candidates(spark: SparkSession, sf_dir: str, k: int = 4) -> DataFrame:
    """R2, positional and array forms: the orders' texts in file order are a flat list of K per prompt; regrouped by
    position, gathered into one array a prompt (K texts) and laid out again."""
    orders = FX.table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    flat = with_file_ordinal(orders, "pos").select("pos", F.concat_ws(" ", "o_orderkey", "o_orderpriority").alias("text"))
    grouped = (S.regroup_flat(flat, k).groupBy("prompt_idx")
               .agg(F.transform(F.array_sort(F.collect_list(F.struct("cand_idx", "text"))), lambda x: x["text"]).alias("texts")))
    return S.flatten_candidates(grouped, "prompt_idx")


def evaluated_iteration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R14 with its train and evaluate steps: one iteration over the training problems, the stand-in trainer reads
    the written set, and its model (the shifted candidates, if the set has rows) answers the test problems."""
    from .iteration import run_iteration
    fx = FX.Tables(spark, sf_dir)
    train, test = SP.hash_split(fx.problems.select("id", "question", "answer"), 0.1, seed=42)
    res = run_iteration(train, TableGenerator(fx.candidates()), TableGenerator(fx.candidates(RATIONALIZE_SHIFT)),
                        train=lambda path: 0 if spark.read.parquet(path).isEmpty() else 1, test_problems=test,
                        generator_for=lambda model: TableGenerator(fx.candidates(model).filter(F.col("cand_idx") == 1)))
    return res.accuracy.withColumn("accuracy", F.round("accuracy", 8))


QUERIES = {
    "keep_first_correct": keep_first_correct,
    "greedy_accuracy": greedy_accuracy,
    "missed_problems": missed_problems,
    "rationalize_missed": rationalize_missed,
    "one_iteration": one_iteration,
    "merge_last_wins": merge_last_wins,
    "retry_keep_correct": retry_keep_correct,
    "retry_shortest_correct": retry_shortest_correct,
    "shortest_vs_first": shortest_vs_first,
    "retry_flag_all": retry_flag_all,
    "train_set_correct_only": train_set_correct_only,
    "train_set_keep_all": train_set_keep_all,
    "collect_misses": collect_misses,
    "extract_profiles": extract_profiles,
    "em_profiles": em_profiles,
    "answer_shapes": answer_shapes,
    "gold_sft_set": gold_sft_set,
    "step_rollup": step_rollup,
    "zero_shot_records": zero_shot_records,
    "rescore_accuracy": rescore_accuracy,
    "rescore_stored_predictions": rescore_stored_predictions,
    "prompt_ablation": prompt_ablation,
    "ablation_mismatches": ablation_mismatches,
    "experiment_comparison": experiment_comparison,
    "top_mismatches": top_mismatches,
    "mismatch_export": mismatch_export,
    "stage_report": stage_report,
    "progress_counters": progress_counters,
    "loss_rollup": loss_rollup,
    "sft_batches": sft_batches,
    "sft_batches_uncapped": sft_batches_uncapped,
    "split_assignments": split_assignments,
    "hash_split": hash_split,
    "conversation_records": conversation_records,
    "sft_triples": sft_triples,
    "render_prompts": render_prompts,
    "prompt_echo_strip": prompt_echo_strip,
    "regroup_candidates": regroup_candidates,
    "incremental_stream": incremental_stream,
    "stream_totals": stream_totals,
    "jsonl_round_trip": jsonl_round_trip,
    "self_training_loop": self_training_loop,
    "resumed_generation": resumed_generation,
    "restarted_loop": restarted_loop,
    "resolved_fields": resolved_fields,
    "positional_candidates": positional_candidates,
    "evaluated_iteration": evaluated_iteration,
    "incremental_merge": incremental_merge,
}


COVERAGE = {
    "keep_first_correct": "R3, M2, X2, X2f, N2",
    "greedy_accuracy": "A1, M1, X1, N1",
    "missed_problems": "R4",
    "rationalize_missed": "R5, P4, P1, R1",
    "one_iteration": "R14, R6, P5, P10",
    "merge_last_wins": "R6",
    "retry_keep_correct": "R8, M1",
    "retry_shortest_correct": "R9",
    "shortest_vs_first": "R3, R9",
    "retry_flag_all": "R10",
    "train_set_correct_only": "R11",
    "train_set_keep_all": "R12",
    "collect_misses": "R7",
    "extract_profiles": "X1, X2, X2f, X3, X4, X5",
    "em_profiles": "N1, N2, N3, N4, M1, M2, M3, M4",
    "answer_shapes": "X1, X2, X2f, X3, X4, X5, N1, N2, N3, N4, M1, M2, M3, M4",
    "gold_sft_set": "P6, X5",
    "step_rollup": "A9",
    "zero_shot_records": "L3, A3, P8, X3, M3",
    "rescore_accuracy": "A2, A3",
    "rescore_stored_predictions": "A3, P3",
    "prompt_ablation": "A6, P2, M4",
    "ablation_mismatches": "L1, A6",
    "experiment_comparison": "A5, A4",
    "top_mismatches": "L1",
    "mismatch_export": "L2",
    "stage_report": "A7",
    "progress_counters": "A8, S10",
    "loss_rollup": "A9",
    "sft_batches": "T1, T2, S10",
    "sft_batches_uncapped": "T2b",
    "split_assignments": "S5, S6, S7, S9, S10",
    "hash_split": "S8",
    "conversation_records": "P5, P7, P8, P10",
    "sft_triples": "P6, P6b, X5",
    "render_prompts": "P1, P2, P4",
    "prompt_echo_strip": "P9",
    "regroup_candidates": "R2",
    "incremental_stream": "ST1, S4",
    "stream_totals": "ST1, A8",
    "jsonl_round_trip": "S1, S2, S3",
    "self_training_loop": "R13, R7, R8, R11, A7",
    "resumed_generation": "R1, S9, P1",
    "restarted_loop": "R13, A7, P6, R11",
    "resolved_fields": "P3, P5",
    "positional_candidates": "R2, S5",
    "evaluated_iteration": "R14, A1, M2",
    "incremental_merge": "R6",
}
