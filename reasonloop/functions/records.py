"""Record projections (P3-P10): field resolution, SFT texts, rationale splits, format gate."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import answers as A
from .text import ANY_BREAK, nonblank_lines, trim_u

# Ordered alias chains for fields whose names vary between files.
GOLD_ALIASES = ["answer", "gold_answer", "final_answer", "answer_text", "A"]
GOLD_ALIASES_EVAL = ["gold", "answer", "final_answer", "answer_text"]
GOLD_ALIASES_RESCORE = ["gold", "answer", "A", "gold_answer"]
PRED_ALIASES = ["answer", "generated", "final_answer"]
QUESTION_ALIASES = ["question", "Q", "q"]
RATIONALE_ALIASES = ["gold_rationale", "rationale", "solution", "explanation"]
FINAL_ALIASES = ["final", "gold_answer", "answer"]
# Class-format markers and the legacy SFT separator.
INPUT_MARK = "###Input:"
OUTPUT_MARK = "###Output:"
FINAL_MARK = "#### "
LEGACY_FINAL = "Final answer: "


def resolve_field(df: DataFrame, aliases: Sequence[str], skip_empty: bool = True,
                  default: str | None = "") -> Column:
    """The first alias column that exists and holds a value. ``skip_empty=True`` is the
    ``a or b or ...`` chain (an empty string also falls through); ``False`` is the
    ``.get`` chain (only NULL falls through)."""
    present = [a for a in aliases if a in df.columns]
    parts = [F.nullif(F.col(a).cast("string"), F.lit("")) if skip_empty else F.col(a).cast("string")
             for a in present]
    if default is not None:
        parts.append(F.lit(default))
    if not parts:
        return F.lit(None).cast("string")
    return F.coalesce(*parts) if len(parts) > 1 else parts[0]


def hint_final(answer: Column, full_answer: bool = False) -> Column:
    """Gold for the rationalisation hint: ``X2(answer) or answer`` (or the whole
    answer when ``full_answer``)."""
    return answer if full_answer else F.coalesce(A.extract_hash_strict(answer), answer)


def class_text(question: Column, rationale: Column, final: Column) -> Column:
    """P5: ``###Input:\\n{q}\\n\\n###Output:\\n{rationale}\\n#### {final}``."""
    return F.concat(F.lit(INPUT_MARK + "\n"), question, F.lit("\n\n" + OUTPUT_MARK + "\n"),
                    rationale, F.lit("\n" + FINAL_MARK), final)


def class_records(df: DataFrame, id_col: str = "id") -> DataFrame:
    """P5 over a table whose field names vary: question, rationale and final are resolved
    through their alias chains (empty values fall through), then ``id, text``."""
    q = resolve_field(df, QUESTION_ALIASES)
    r = resolve_field(df, RATIONALE_ALIASES)
    f = resolve_field(df, FINAL_ALIASES)
    return df.select(id_col, class_text(q, r, f).alias("text"))


def sft_triple(solution: Column, answer: Column) -> tuple[Column, Column]:
    """``(rationale, answer)`` — rationale is the stripped solution; answer is
    ``#### n`` from the solution's last ``#### n`` (X5), else the stripped answer field."""
    sol = trim_u(F.coalesce(solution, F.lit("")))
    num = A.extract_solution_number(sol)
    ans = F.when(num.isNotNull(), F.concat(F.lit(FINAL_MARK), num)).otherwise(
        trim_u(F.coalesce(answer, F.lit(""))))
    return sol, ans


def sft_set(df: DataFrame, solution_col: str = "solution", answer_col: str = "answer",
            id_col: str = "id", question_col: str = "question") -> DataFrame:
    """P6 over a problem table with worked solutions: ``id, question`` (stripped), ``rationale, answer``."""
    rationale, answer = sft_triple(F.col(solution_col), F.col(answer_col))
    return df.select(id_col, trim_u(F.coalesce(F.col(question_col), F.lit(""))).alias("question"),
                     rationale.alias("rationale"), answer.alias("answer"))


def sft_triple_legacy(solution: Column, explanation: Column, answer: Column) -> tuple[Column, Column]:
    """rationale = solution, else explanation, else answer; answer unchanged."""
    rationale = F.coalesce(F.nullif(solution, F.lit("")), F.nullif(explanation, F.lit("")),
                           F.coalesce(answer, F.lit("")))
    return rationale, F.coalesce(answer, F.lit(""))


def sft_target(rationale: Column, answer: Column, profile: str = "reference") -> Column:
    """Training target text.

    ``reference``: stripped rationale, a newline unless the *unstripped* rationale ended in
    one, then the stripped answer (so a rationale ending in a newline is glued to the
    answer). ``newline``: always one newline between them. ``legacy``: rationale +
    ``\\nFinal answer: `` + answer, or only ``Final answer: `` + answer when the rationale
    is blank."""
    r = F.coalesce(rationale, F.lit(""))
    a = trim_u(F.coalesce(answer, F.lit("")))
    if profile == "reference":
        sep = F.when(r.endswith(F.lit("\n")), F.lit("")).otherwise(F.lit("\n"))
        return F.concat(trim_u(r), sep, a)
    if profile == "newline":
        return F.concat(trim_u(r), F.lit("\n"), a)
    if profile == "legacy":
        return F.when(trim_u(r) != "", F.concat(trim_u(r), F.lit("\n" + LEGACY_FINAL), a)) \
            .otherwise(F.concat(F.lit(LEGACY_FINAL), a))
    raise ValueError(f"unknown target profile {profile!r}")


def rationale_from_generation(generated: Column) -> Column:
    """The non-blank stripped lines but the last, joined by newlines; the whole
    (stripped) text when it has at most one such line."""
    g = trim_u(generated)
    lines = nonblank_lines(g)
    return F.when(~F.rlike(g, F.lit(ANY_BREAK)), g).when(F.size(lines) > 1,
                  F.array_join(F.slice(lines, 1, F.size(lines) - 1), "\n")).otherwise(g)


def strip_prompt_echo(text: Column, prompt: Column) -> Column:
    """Drop a leading copy of the prompt, then strip."""
    cut = F.when(F.startswith(text, prompt), F.substring(text, F.length(prompt) + 1, 1 << 30)) \
        .otherwise(text)
    return trim_u(cut)


def format_ok(text: Column) -> Column:
    """P10 predicate: the line holds ``###Input:``, ``###Output:`` and ``#### ``."""
    t = F.coalesce(text, F.lit(""))
    return (F.contains(t, F.lit(INPUT_MARK)) & F.contains(t, F.lit(OUTPUT_MARK)) &
            F.contains(t, F.lit(FINAL_MARK)))


def check_training_format(df: DataFrame, text_col: str = "text", id_col: str = "id",
                          quarantine: bool = False) -> DataFrame:
    """P10 gate: raise (with up to five offending ids) when any row fails ``format_ok``;
    with ``quarantine=True`` return the passing rows instead of raising."""
    ok = format_ok(F.col(text_col))
    if quarantine:
        return df.filter(ok)
    bad = df.filter(~ok).select(id_col).limit(5).collect()
    if bad:
        raise ValueError(f"bad training line format, e.g. ids {[r[0] for r in bad]}")
    return df
