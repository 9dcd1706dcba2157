"""Candidate selection, keyed merges and set operations.

All picks are hash aggregates over the candidate index alone (``cand_idx`` numbers the
candidates of a problem, no two alike): Spark pre-aggregates them map-side, so a problem with
a huge number of candidates never lands whole in one task, and no text is sorted or
carried through an aggregation. The winner's text is fetched by ``(id, cand_idx)``. Candidate
tables are therefore read twice and should be stored tables.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import answers as A
from .skew import block_join


# Fixed value: the id prefix of test problems numbered by their position in the split.
TEST_ID_PREFIX = "hf_test_"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


# ---- R2 -------------------------------------------------------------------

def _with_text(picks: DataFrame, cands: DataFrame, idx: str, out: str, id_col: str = "id",
               idx_col: str = "cand_idx", text_col: str = "text") -> DataFrame:
    """``picks`` with the text of the candidate its column ``idx`` names, as ``out``. Pairs of id and
    index are distinct, so a problem with many candidates is spread by the pair."""
    texts = cands.select(F.col(id_col).alias("__tid"), F.col(idx_col).alias("__tidx"), F.col(text_col).alias(out))
    return picks.join(texts, (F.col(id_col) == F.col("__tid")) & (F.col(idx) == F.col("__tidx"))).drop("__tid", "__tidx")


def regroup_candidates(cands: DataFrame, id_col: str = "id", idx_col: str = "cand_idx",
                       text_col: str = "text") -> DataFrame:
    """R2 summary form: per problem the candidate count and the first / last candidate
    (by index). The long table stays the canonical layout: no per-problem array is built."""
    ends = cands.groupBy(id_col).agg(F.count(F.lit(1)).alias("n_candidates"), F.min(idx_col).alias("first_idx"),
                                     F.max(idx_col).alias("last_idx"))
    first = _with_text(ends, cands, "first_idx", "first_text", id_col, idx_col, text_col)
    return _with_text(first, cands, "last_idx", "last_text", id_col, idx_col, text_col)


def last_candidates(cands: DataFrame, id_col: str = "id", idx_col: str = "cand_idx",
                    text_col: str = "text") -> DataFrame:
    """``(id, last_idx, text)``: each problem's last candidate."""
    ends = cands.groupBy(id_col).agg(F.max(idx_col).alias("last_idx"))
    return _with_text(ends, cands, "last_idx", "text", id_col, idx_col, text_col)


def regroup_flat(texts: DataFrame, k: int, pos_col: str = "pos", text_col: str = "text") -> DataFrame:
    """R2 positional form: a flat list of K texts per prompt (0-based ``pos``) to
    ``(prompt_idx, cand_idx, text)``; text ``j * k + i`` is candidate ``i + 1`` of prompt ``j``."""
    p = F.col(pos_col)
    return texts.select(F.floor(p / F.lit(k)).cast("bigint").alias("prompt_idx"),
                        (F.pmod(p, F.lit(k)) + 1).cast("int").alias("cand_idx"), F.col(text_col).alias("text"))


def flatten_candidates(grouped: DataFrame, id_col: str = "id", texts_col: str = "texts") -> DataFrame:
    """R2 inverse: an array of K texts per problem to the long ``(id, cand_idx, text)``."""
    return grouped.select(id_col, F.posexplode(texts_col).alias("cand_idx", "text")) \
        .withColumn("cand_idx", F.col("cand_idx") + 1)


# ---- scoring join -----------------------------------------------------------

def gold_keys(problems: DataFrame, profile: str, id_col: str = "id", gold_col: str = "answer",
              key_col: str = "__gk", carry: Sequence[str] = ()) -> DataFrame:
    """``(id, key, *carry)``: the normalised gold of every problem, computed once per
    problem; ``carry`` columns ride along (one row per problem) to the join."""
    cols = [id_col, gold_col] + [c for c in carry if c not in (id_col, gold_col)]
    keyed = A.with_gold_key(problems.select(*cols), profile, gold_col, key_col)
    return keyed.select(id_col, key_col, *[c for c in carry if c != id_col])


def _scored(cands: DataFrame, keys: DataFrame, profile: str, id_col: str, text_col: str,
            em_col: str) -> DataFrame:
    # The prediction key (the regex work) is computed before the join, on the candidates'
    # own evenly split partitions, so a problem with a huge number of candidates does not
    # concentrate the scoring in the task that receives its key.
    p = A.with_pred_key(cands, profile, text_col, "__pk")
    j = p.join(keys, id_col)
    return j.withColumn(em_col, A.em_from_keys(profile, "__gk", "__pk")).drop("__gk", "__pk")


def score_candidates(cands: DataFrame, problems: DataFrame, profile: str = "hash_then_any",
                     id_col: str = "id", gold_col: str = "answer", text_col: str = "text",
                     em_col: str = "em", idx_col: str = "cand_idx") -> DataFrame:
    """Each candidate with the EM of its text against its problem's gold. The gold side is
    normalised once per problem and only ``(id, key)`` is joined to the candidates, each
    problem's spread by blocks of ``idx_col``."""
    p = A.with_pred_key(cands, profile, text_col, "__pk")
    j = block_join(p, gold_keys(problems, profile, id_col, gold_col), id_col, idx_col)
    return j.withColumn(em_col, A.em_from_keys(profile, "__gk", "__pk")).drop("__gk", "__pk")


# ---- R3 / R5 ----------------------------------------------------------------

_INDEX_BITS = 32


def best_index(cands: DataFrame, keys: DataFrame, profile: str, shortest: bool = False,
               id_col: str = "id", idx_col: str = "cand_idx", text_col: str = "text") -> DataFrame:
    """``(id, cand_idx)`` and the other columns of ``keys``: the matching candidate with the
    lowest index, or the shortest one (ties to the lowest index).

    Under every profile a candidate matches exactly when its prediction key equals the
    problem's (non-NULL) gold key. So the prediction key is computed map-side, candidates
    are reduced per ``(id, key)`` to one number (length and index share a long), and one
    equi-join on ``(id, key) = (id, gold key)`` keeps the matching group. Partial aggregation
    collapses equal predictions before the shuffle and distinct ones spread by the pair; a
    problem with a third of all candidates never lands in one task.

    Both keys get a leading mark, a missing prediction is the empty text and a missing gold ``!``, so
    they never meet and no null filter (which would run the extraction a second time) is pushed
    below the projection."""
    idx = F.col(idx_col).cast("bigint")
    rank = F.shiftleft(F.coalesce(F.length(text_col), F.lit(0)).cast("bigint"), _INDEX_BITS) + idx if shortest else idx
    p = A.with_pred_key(cands.select(id_col, idx_col, text_col), profile, text_col, "__pk")
    best = (p.select(id_col, rank.alias("__rank"), F.coalesce(F.concat(F.lit("="), F.col("__pk")), F.lit("")).alias("__pk"))
            .groupBy(id_col, "__pk").agg(F.min("__rank").alias("__rank")))
    gold = keys.withColumn("__pk", F.coalesce(F.concat(F.lit("="), F.col("__gk")), F.lit("!"))).drop("__gk")
    extra = [c for c in gold.columns if c not in (id_col, "__pk")]
    found = F.col("__rank").bitwiseAND(F.lit((1 << _INDEX_BITS) - 1)) if shortest else F.col("__rank")
    return best.join(gold, [id_col, "__pk"]).select(id_col, found.cast("int").alias("cand_idx"), *extra)


def best_matching(cands: DataFrame, keys: DataFrame, profile: str, shortest: bool = False,
                  id_col: str = "id", idx_col: str = "cand_idx", text_col: str = "text") -> DataFrame:
    """:func:`best_index` with the winner's ``text``."""
    best = best_index(cands, keys, profile, shortest, id_col, idx_col, text_col)
    return _with_text(best, cands, "cand_idx", "text", id_col, idx_col, text_col)


def keep_first_correct(cands: DataFrame, problems: DataFrame, profile: str = "hash_then_any",
                       id_col: str = "id", idx_col: str = "cand_idx", text_col: str = "text",
                       question_col: str = "question", gold_col: str = "answer") -> DataFrame:
    """Per problem the lowest-index candidate whose text matches the gold.

    Output ``id, question, rationale, final, cand_idx`` (``final`` is the gold text).
    Question and gold text ride on the per-problem side of the ``(id, key)`` join."""
    probs = problems.select(id_col, F.col(question_col).alias("question"),
                            F.col(gold_col).alias("final"))
    keys = gold_keys(probs, profile, id_col, "final", carry=["question", "final"])
    best = best_matching(cands, keys, profile, False, id_col, idx_col, text_col)
    return best.select(id_col, "question", F.col("text").alias("rationale"), "final", "cand_idx")


def missed_problems(problems: DataFrame, kept: DataFrame, id_col: str = "id") -> DataFrame:
    """Problems with no kept row (anti-join on id)."""
    return problems.join(kept.select(id_col), id_col, "left_anti")


# ---- R6 -----------------------------------------------------------------------

def merge_last_wins(sources: Sequence[DataFrame], order_col: str, id_col: str = "id") -> DataFrame:
    """Keyed union where a later row replaces an earlier one (later source, or later
    position in the same source); each id keeps the position of its first sighting.

    ``order_col`` is the row's position inside a source; rows of one id and source have
    different ones. Output has the sources' columns plus ``src`` and ``pos`` (struct of source
    and position of the first sighting), so ``orderBy('pos')`` restores the merged order. The
    positions are reduced alone; the winning rows are fetched by id, source and position."""
    cols = sources[0].columns
    tagged = None
    for i, s in enumerate(sources):
        t = s.select(*cols).withColumn("__src", F.lit(i)).withColumn("__ord", F.col(order_col))
        tagged = t if tagged is None else tagged.unionByName(t)
    at = [F.when(F.col("__src") == i, F.col("__ord")) for i in range(len(sources))]
    ends = tagged.groupBy(F.col(id_col).alias("__id")).agg(
        *[F.min(c).alias(f"__lo{i}") for i, c in enumerate(at)],
        *[F.max(c).alias(f"__hi{i}") for i, c in enumerate(at)])
    seen = [(i, F.col(f"__lo{i}"), F.col(f"__hi{i}")) for i in range(len(sources))]
    first = F.coalesce(*[F.when(lo.isNotNull(), F.struct(F.lit(i).alias("__src"), lo.alias("__ord"))) for i, lo, _ in seen])
    last_src = F.coalesce(*[F.when(hi.isNotNull(), F.lit(i)) for i, _, hi in reversed(seen)])
    last_ord = F.coalesce(*[hi for _, _, hi in reversed(seen)])
    winners = ends.select("__id", first.alias("pos"), last_src.alias("__wsrc"), last_ord.alias("__word"))
    won = (F.col(id_col).eqNullSafe(F.col("__id")) & (F.col("__src") == F.col("__wsrc"))
           & (F.col("__ord") == F.col("__word")))
    return tagged.join(winners, won).select(
        id_col, *[c for c in cols if c != id_col], F.col("__src").alias("src"), "pos")


# ---- R7 -----------------------------------------------------------------------

def collect_misses(preds: DataFrame, dataset: DataFrame | None = None, id_col: str = "id",
                   em_col: str = "em", question_col: str = "question",
                   gold_col: str = "gold_answer", id_prefix: str = TEST_ID_PREFIX,
                   dataset_index: str = "ordinal", dataset_question: str = "question",
                   dataset_gold: str = "answer", strict: bool = False) -> DataFrame:
    """Prediction rows whose ``em`` is falsy (NULL counts as a miss). When question or
    gold is NULL and the id is ``<prefix><n>``, both are taken from the dataset row with
    index n. Rows whose question or gold is still NULL or empty are dropped.

    ``strict=True`` raises when such an id has no parsable index, or one outside the dataset."""
    em = F.col(em_col)
    miss = preds.filter(~F.coalesce(em.try_cast("boolean"), F.lit(False)))
    rid = F.col(id_col).cast("string")
    idx = F.when(rid.startswith(id_prefix),
                 F.substring_index(rid, "_", -1).try_cast("bigint"))
    needs = F.col(question_col).isNull() | F.col(gold_col).isNull()
    miss = miss.withColumn("__idx", F.when(needs, idx)).withColumn(
        "__needs", needs & rid.startswith(id_prefix))
    if strict:
        bad = miss.filter(F.col("__needs") & F.col("__idx").isNull()).limit(1).count()
        if bad:
            raise ValueError(f"a missed row has an id {id_prefix}<n> with no parsable index")
        if dataset is not None:
            known = dataset.select(F.col(dataset_index).cast("bigint").alias("__idx"))
            lost = miss.filter(F.col("__needs")).join(known, "__idx", "left_anti")
            if lost.limit(1).count():
                raise ValueError(f"a missed row's index in {id_prefix}<n> is outside the dataset")
    if dataset is None:
        out = miss.withColumn("__q", F.col(question_col)).withColumn("__g", F.col(gold_col))
    else:
        # Only rows with an index take part in the join: rows without one would all share
        # the NULL key and pile into a single task.
        ds = dataset.select(F.col(dataset_index).alias("__idx"),
                            F.col(dataset_question).alias("__dq"),
                            F.col(dataset_gold).alias("__dg"))
        keyed = miss.filter(F.col("__idx").isNotNull()).join(ds, "__idx", "left")
        hit = F.col("__needs") & F.col("__dq").isNotNull()
        keyed = (keyed.withColumn("__q", F.when(hit, F.col("__dq")).otherwise(F.col(question_col)))
                      .withColumn("__g", F.when(hit, F.col("__dg")).otherwise(F.col(gold_col)))
                      .drop("__dq", "__dg"))
        rest = (miss.filter(F.col("__idx").isNull())
                .withColumn("__q", F.col(question_col)).withColumn("__g", F.col(gold_col)))
        out = keyed.unionByName(rest)
    out = out.filter((F.coalesce(F.col("__q"), F.lit("")) != "") &
                     (F.coalesce(F.col("__g"), F.lit("")) != ""))
    return out.select(F.col(id_col).alias("id"), F.col("__q").alias("question"),
                      F.col("__g").alias("gold_answer"))


# ---- R8 / R9 / R10 ------------------------------------------------------------

def _retried(misses: DataFrame, outputs: DataFrame, profile: str, id_col: str, text_col: str) -> DataFrame:
    """Misses with their output and its ``__em``; question and gold ride on the key table."""
    keys = gold_keys(misses, profile, id_col, "gold_answer", carry=["question", "gold_answer"])
    return _scored(outputs.select(id_col, F.col(text_col).alias("output")), keys, profile, id_col, "output", "__em")


def retry_keep_correct(misses: DataFrame, outputs: DataFrame, profile: str = "hash_loose",
                       id_col: str = "id", text_col: str = "text") -> DataFrame:
    """One output per miss, kept only when it matches the gold; ``em_after`` true."""
    return (_retried(misses, outputs, profile, id_col, text_col).filter(A.is_match("__em"))
            .select(id_col, "question", "gold_answer", "output", F.lit(True).alias("em_after")))


def retry_shortest_correct(misses: DataFrame, outputs: DataFrame, profile: str = "hash_loose",
                           id_col: str = "id", idx_col: str = "cand_idx",
                           text_col: str = "text") -> DataFrame:
    """Among the K outputs that match, the shortest text; ties go to the earliest."""
    keys = gold_keys(misses, profile, id_col, "gold_answer", carry=["question", "gold_answer"])
    best = best_matching(outputs, keys, profile, True, id_col, idx_col, text_col)
    return best.select(id_col, "question", "gold_answer", F.col("text").alias("output"), "cand_idx",
                       F.lit(True).alias("em_after"))


def retry_flag_all(misses: DataFrame, outputs: DataFrame, profile: str = "hash_loose",
                   id_col: str = "id", text_col: str = "text") -> DataFrame:
    """Every output kept with ``em_after`` true/false."""
    return (_retried(misses, outputs, profile, id_col, text_col)
            .select(id_col, "question", "gold_answer", "output", A.is_match("__em").alias("em_after")))


# ---- R11 / R12 ----------------------------------------------------------------

def training_rows(retries: DataFrame, correct_only: bool = True) -> DataFrame:
    """Retry rows to SFT triples ``question, rationale, answer``: ``answer = '#### ' || X1``.
    ``correct_only`` (R11) drops rows with no extractable final; otherwise (R12) their
    answer is ""."""
    final = A.extract_hash_loose(F.col("output"))
    rows = retries.select("question", F.col("output").alias("rationale"),
                          F.when(final.isNotNull(), F.concat(F.lit("#### "), final))
                           .otherwise(F.lit("")).alias("answer"))
    return rows.filter(F.col("answer") != "") if correct_only else rows


def cumulative_training_set(current: DataFrame, previous: DataFrame | None) -> DataFrame:
    """Bag union (UNION ALL) of this iteration's rows and the previous set."""
    cols = ["question", "rationale", "answer"]
    cur = current.select(*cols)
    return cur if previous is None else cur.unionByName(previous.select(*cols))
