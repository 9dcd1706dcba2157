"""Final-answer extraction, normalisation and exact-match scoring as Column builders.

Every profile is a composition of native functions (``regexp_extract_all``,
``try_element_at``, ``coalesce``, ``try_cast``), so scoring stays inside whole-stage
codegen and never leaves the JVM. Five extractor profiles coexist because the
workloads they reproduce disagree with each other; pick one by name.

Extractors return a string Column (NULL = "no match" where the profile has that
notion); scorers return a boolean (``hash_loose``, ``hash_then_any``) or a nullable
int (``cascade_last``, ``cascade_first``) Column.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import U, after_last_break, ascii_digits, last_line, rstrip_dots, trim_u, without

# ---------------------------------------------------------------------------
# Patterns that must equal the workload's for identical results.
# ---------------------------------------------------------------------------
HASH_LOOSE = r"####\s*([-\d][\d,\.]*)"
HASH_STRICT = r"####\s*([\-]?\d+(?:\.\d+)?)"
ANY_NUMBER = r"[\-]?\d+(?:\.\d+)?"
SOLUTION_NUMBER = r"####\s*([+-]?\d+\.?\d*)\b"
LOOSE_NUMBER = r"[+-]?\d+\.?\d*"
CUE_FINAL_ANSWER = r"final answer(?: is|:)?\s*([+-]?\d+\.?\d*)\b"
CUE_ANSWER = r"answer(?: is|:)?\s*([+-]?\d+\.?\d*)\b"
CUE_HASH = r"####\s*([+-]?\d+\.?\d*)\b"
CUE_ARROW = r"=>\s*([+-]?\d+\.?\d*)\b"
CUE_EQUALS = r"=\s*([+-]?\d+\.?\d*)\b"
CUE_RESULT = r"result(?: is|:)?\s*([+-]?\d+\.?\d*)\b"
# Cascade orders: last-match cascade and first-match cascade.
CASCADE_LAST = [CUE_FINAL_ANSWER, CUE_ANSWER, CUE_HASH, CUE_ARROW, CUE_EQUALS, CUE_RESULT]
CASCADE_FIRST = [CUE_FINAL_ANSWER, CUE_ANSWER, CUE_EQUALS, CUE_ARROW, CUE_HASH, CUE_RESULT]
CASCADE_FIRST_SHELL = [CUE_FINAL_ANSWER, CUE_ANSWER, CUE_EQUALS, CUE_ARROW, CUE_HASH]
# ---------------------------------------------------------------------------

# Python float() syntax without inf/nan (those never yield an integer text here);
# underscores between digits are accepted as Python accepts them.
_DIGITS = r"[0-9](?:_?[0-9])*"
FLOAT_SYNTAX = (r"\A[+-]?(?:" + _DIGITS + r"(?:\.(?:" + _DIGITS + r")?)?|\." + _DIGITS + r")"
                r"(?:[eE][+-]?" + _DIGITS + r")?\z")


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def last_match(c, pattern: str, group: int = 1) -> Column:
    """Last regex match (group), NULL when there is none."""
    return F.try_element_at(F.regexp_extract_all(_col(c), F.lit(U + pattern), F.lit(group)), F.lit(-1))


def first_match(c, pattern: str, group: int = 1) -> Column:
    """First (leftmost) regex match (group), NULL when there is none."""
    return F.nullif(F.regexp_extract(_col(c), U + pattern, group), F.lit(""))


def _last_hash(c, pattern: str) -> Column:
    """:func:`last_match` of a pattern that begins with ``####``: texts without that mark are not scanned."""
    return F.when(F.contains(_col(c), F.lit("####")), last_match(c, pattern))


# ---- extractors -----------------------------------------------------------

def extract_hash_loose(c) -> Column:
    """Last ``#### n`` with digits, commas and dots; commas removed; NULL if none."""
    return without(_last_hash(c, HASH_LOOSE), ",")


def extract_hash_strict(c) -> Column:
    """Last ``#### n`` with an optional sign and decimal part; NULL if none."""
    return _last_hash(c, HASH_STRICT)


def extract_last_number(c) -> Column:
    """X2f: last number anywhere in the text; NULL if none."""
    return last_match(c, ANY_NUMBER, 0)


def extract_solution_number(c) -> Column:
    """Last ``#### n`` of a worked solution; NULL if none."""
    return _last_hash(c, SOLUTION_NUMBER)


# The cue groups ``[+-]?\d+\.?\d*`` can never hold a comma, so the workload's comma removal
# on a cue match is a no-op and is not repeated here.
def _fallbacks(stripped: Column) -> list[Column]:
    return [last_match(without(stripped, ","), LOOSE_NUMBER, 0), last_line(stripped)]


# ---- one-scan cascade ------------------------------------------------------
#
# All cues are one alternation, so one pass over a text finds the hits of every cue. Hits of different
# cues cannot overlap but in one case: a hit is a cue, blanks and a number, and of the cues only
# ``final answer`` holds another, ``answer``. Such a hit counts for ``final answer`` alone; the hit that
# ``answer`` loses by it would only matter if ``final answer``, the first cue of every cascade, had none.

def _one_of(patterns: list[str]) -> str:
    return "|".join(re.sub(r"\((?!\?)", "(?:", p) for p in patterns)


_CUE_BEGINS = {CUE_FINAL_ANSWER: "final", CUE_ANSWER: "answer", CUE_HASH: "####", CUE_ARROW: "=>", CUE_EQUALS: "=", CUE_RESULT: "result"}
_CUE_WORDS = _CUE_BEGINS | {CUE_FINAL_ANSWER: "final answer"}
# a character that begins no cue is passed over without trying every cue there
ANY_CUE = "(?=[" + "".join(sorted({b[0] for b in _CUE_BEGINS.values()})) + "])(?:" + _one_of(CASCADE_LAST) + ")"


def cue_hits(low: Column) -> Column:
    """Every hit of every cue (cue and number as they stand), in one pass over the lower-cased text."""
    return F.regexp_extract_all(low, F.lit(U + ANY_CUE), F.lit(0))


def pick_hit(hits: Column, patterns: list[str], first: bool) -> Column:
    """Number of the first or last hit of the first cue of ``patterns`` that hits; NULL if none does."""
    def ranked(h: Column, i: Column) -> Column:
        rank = F.lit(len(patterns))
        # a cue that begins like another one (``=>``, ``=``) is asked for first
        for p in sorted(patterns, key=lambda x: len(_CUE_BEGINS[x])):
            rank = F.when(h.startswith(_CUE_BEGINS[p]), F.lit(patterns.index(p))).otherwise(rank)
        return F.struct(rank.alias("rank"), (i if first else -i).alias("at"), h.alias("hit"))

    best = F.array_min(F.transform(hits, ranked))
    number = F.regexp_extract(best["hit"], U + LOOSE_NUMBER + r"\z", 0)
    return F.when(best["rank"] < len(patterns), number)


def extract_cascade_last(c) -> Column:
    """On the stripped, lower-cased text, the first cue pattern that hits gives its
    last match; then the last number (commas removed); then the last line; "" for NULL."""
    t = trim_u(_col(c))
    hit = pick_hit(cue_hits(F.lower(t)), CASCADE_LAST, first=False)
    return F.when(_col(c).isNull(), F.lit("")).otherwise(F.coalesce(hit, *_fallbacks(t)))


def extract_cascade_first(c, with_result: bool = True) -> Column:
    """Like X3 but each cue gives its first match and the cue order puts ``=`` before
    ``####``; ``with_result=False`` is the shell variant without the ``result`` cue."""
    t = trim_u(_col(c))
    hit = pick_hit(cue_hits(F.lower(t)), CASCADE_FIRST if with_result else CASCADE_FIRST_SHELL, first=True)
    return F.when(_col(c).isNull(), F.lit("")).otherwise(F.coalesce(hit, *_fallbacks(t)))


EXTRACTORS: dict[str, Callable[[Column], Column]] = {
    "hash_loose": extract_hash_loose,
    "hash_strict": extract_hash_strict,
    "last_number": extract_last_number,
    "cascade_last": extract_cascade_last,
    "cascade_first": extract_cascade_first,
    "cascade_first_shell": lambda c: extract_cascade_first(c, with_result=False),
    "solution_number": extract_solution_number,
}


# ---- normalisers ----------------------------------------------------------

def normalize_trim(c) -> Column:
    """Strip only."""
    return trim_u(_col(c))


def normalize_money(c) -> Column:
    """Strip, drop commas, drop one leading ``$`` (NULL stays NULL)."""
    return F.regexp_replace(without(trim_u(_col(c)), ","), r"\A\$", "")


def _as_double(text: Column) -> Column:
    """Python ``float(text)`` for finite decimal syntax, else NULL (``1d``, ``inf``... )."""
    return without(F.regexp_extract(trim_u(ascii_digits(text)), FLOAT_SYNTAX, 0), "_").try_cast("double")


_LIMB = 10 ** 9              # decimal limbs, least first
_STEP = 29                   # bits a limb is shifted by at once: its product and carry stay below 2^63


def _shifted(limbs: Column, factor: Column) -> Column:
    """Decimal limbs times a factor of at most 2^``_STEP``."""
    div = lambda x: F.call_function("div", x, F.lit(_LIMB))
    none = F.array().cast("array<bigint>")
    done = F.aggregate(
        limbs, F.struct(F.lit(0).cast("bigint").alias("carry"), none.alias("out")),
        lambda a, x: F.struct(div(x * factor + a["carry"]).alias("carry"),
                              F.concat(a["out"], F.array((x * factor + a["carry"]) % _LIMB)).alias("out")),
        lambda a: F.when(a["carry"] > 0, F.concat(a["out"], F.array(a["carry"]))).otherwise(a["out"]))
    return done


def exact_digits(d: Column) -> Column:
    """Every digit of an integral double of 2^62 or more: its mantissa as decimal limbs, shifted by its exponent."""
    e = F.floor(F.log2(d)) - 55
    m = (d / F.pow(F.lit(2.0), e)).cast("bigint")
    div = lambda x: F.call_function("div", x, F.lit(_LIMB))
    steps = F.concat(F.array_repeat(F.lit(1 << _STEP).cast("bigint"), (e / _STEP).cast("int")),
                     F.array(F.pow(F.lit(2.0), e % _STEP).cast("bigint")))
    limbs = F.aggregate(steps, F.array(m % _LIMB, div(m)), _shifted)
    text = F.array_join(F.transform(F.reverse(limbs), lambda x: F.lpad(x.cast("string"), 9, "0")), "")
    return F.ltrim(text, F.lit("0"))


def _integer_text(d: Column) -> Column:
    """Every digit of an integral double, as Python's ``int`` prints it."""
    size = F.abs(d)
    large = F.concat(F.when(d < 0, F.lit("-")).otherwise(F.lit("")), exact_digits(size))
    return F.when(size < F.lit(float(1 << 63)), d.try_cast("bigint").cast("string")).otherwise(
        F.when(size < F.lit(float("inf")), large))


def normalize_integral(c) -> Column:
    """Strip, drop trailing dots; a number that is integral (commas ignored) becomes
    its integer text, anything else the lower-cased text; NULL becomes ""."""
    s = rstrip_dots(trim_u(_col(c)))
    d = _as_double(without(s, ","))
    integral = F.when(d.isNotNull() & ((d % F.lit(1.0)) == F.lit(0.0)), _integer_text(d))
    return F.when(_col(c).isNull(), F.lit("")).otherwise(F.coalesce(integral, F.lower(s)))


def normalize_rounded(c) -> Column:
    """Strip, drop trailing dots; any number rounds half-to-even to an integer text
    (commas are not removed); anything else the lower-cased text; NULL becomes ""."""
    s = rstrip_dots(trim_u(_col(c)))
    d = _as_double(s)
    rounded = _integer_text(F.bround(d, 0))
    return F.when(_col(c).isNull(), F.lit("")).otherwise(F.coalesce(rounded, F.lower(s)))


NORMALIZERS: dict[str, Callable[[Column], Column]] = {
    "trim": normalize_trim,
    "money": normalize_money,
    "integral": normalize_integral,
    "rounded": normalize_rounded,
}


# ---- exact-match scorers --------------------------------------------------

def em_hash_loose(gold, text) -> Column:
    """M1: ``(X1(gold) or gold)`` vs ``(X1(text) or "")`` after stripping; NULL gold is a
    miss. A text without ``####`` equals an empty gold."""
    g = F.coalesce(extract_hash_loose(gold), _col(gold))
    p = F.coalesce(extract_hash_loose(text), F.lit(""))
    return F.when(g.isNull(), F.lit(False)).otherwise(trim_u(p) == trim_u(g))


def em_hash_then_any(gold, text) -> Column:
    """M2: gold ``X2(gold) or gold``; prediction ``X2(text) or X2f(text)``; both through N2;
    no prediction is a miss."""
    g = normalize_money(F.coalesce(extract_hash_strict(gold), _col(gold)))
    p = normalize_money(F.coalesce(extract_hash_strict(text), extract_last_number(text)))
    return F.coalesce(p == g, F.lit(False))


def em_cascade_last(gold, text) -> Column:
    """M3: X3 on both sides, N3, as 0/1; NULL when the extracted gold is ""."""
    g = extract_cascade_last(gold)
    p = extract_cascade_last(text)
    return F.when(g == F.lit(""), F.lit(None).cast("int")).otherwise(
        (normalize_integral(g) == normalize_integral(p)).cast("int"))


def em_cascade_first(gold, text, with_result: bool = True) -> Column:
    """M4: X4 on both sides, N4; 1 only when both are non-empty and equal, else 0."""
    g = normalize_rounded(extract_cascade_first(gold, with_result))
    p = normalize_rounded(extract_cascade_first(text, with_result))
    return ((g != F.lit("")) & (p != F.lit("")) & (g == p)).cast("int")


SCORERS: dict[str, Callable[[Column, Column], Column]] = {
    "hash_loose": em_hash_loose,
    "hash_then_any": em_hash_then_any,
    "cascade_last": em_cascade_last,
    "cascade_first": em_cascade_first,
    "cascade_first_shell": lambda g, t: em_cascade_first(g, t, with_result=False),
}


def score(profile: str, gold, text) -> Column:
    """Exact-match Column for a named profile."""
    try:
        return SCORERS[profile](gold, text)
    except KeyError:
        raise ValueError(f"unknown EM profile {profile!r}; known: {sorted(SCORERS)}") from None


def extract(profile: str, text) -> Column:
    try:
        return EXTRACTORS[profile](text)
    except KeyError:
        raise ValueError(f"unknown extractor {profile!r}; known: {sorted(EXTRACTORS)}") from None


def normalize(profile: str, text) -> Column:
    try:
        return NORMALIZERS[profile](text)
    except KeyError:
        raise ValueError(f"unknown normaliser {profile!r}; known: {sorted(NORMALIZERS)}") from None


# ---- staged DataFrame forms -------------------------------------------------
#
# Nesting the Column builders (N3 of X3, used three times inside M3) multiplies the
# expression tree and can overflow the 64 KB generated-method limit of whole-stage
# codegen. The staged forms below put every extracted value into its own column first;
# the next projection references it more than once, so the optimizer keeps the
# projections apart instead of inlining the tree, and the plan stays linear in size.

_CASCADES = {
    "cascade_last": (False, CASCADE_LAST),
    "cascade_first": (True, CASCADE_FIRST),
    "cascade_first_shell": (True, CASCADE_FIRST_SHELL),
}


def with_cascades(df: DataFrame, src, outputs: dict[str, str]) -> DataFrame:
    """Add several cascade extractions of the same text (``{profile: out_column}``) from the
    same hits of every cue; the fallback is computed once, for texts in which a cascade finds no cue."""
    c = _col(src)
    d = df.withColumn("__xs_t", trim_u(c)).withColumn("__xs_null", c.isNull())
    d = d.withColumn("__xs_low", F.lower(F.col("__xs_t")))
    low = F.col("__xs_low")
    hits = {p: f"__xs_hits{i}" for i, p in enumerate(CASCADE_LAST) if any(p in _CASCADES[x][1] for x in outputs)}
    # a text without a cue's word is not scanned for that cue
    d = d.select("*", *[F.when(F.contains(low, F.lit(_CUE_WORDS[p])), F.regexp_extract_all(low, F.lit(U + p), F.lit(1))).alias(h)
                        for p, h in hits.items()])
    picks = {out: f"__xs_{i}" for i, out in enumerate(outputs.values())}
    for profile, out in outputs.items():
        first, pats = _CASCADES[profile]
        d = d.withColumn(picks[out], F.coalesce(*[F.try_element_at(hits[p], F.lit(1 if first else -1)) for p in pats]))
    none = F.lit(False)
    for p in picks.values():
        none = none | F.col(p).isNull()
    d = d.withColumn("__xs_rest", F.when(none, F.coalesce(_fallbacks(F.col("__xs_t"))[0], after_last_break(F.col("__xs_t")))))
    for out, p in picks.items():
        d = d.withColumn(out, F.when(F.col("__xs_null"), F.lit("")).otherwise(F.coalesce(p, "__xs_rest")))
    return d.drop("__xs_t", "__xs_low", "__xs_null", "__xs_rest", *hits.values(), *picks.values())


def with_extracted(df: DataFrame, profile: str, src, out: str) -> DataFrame:
    """Add ``out`` = extractor ``profile`` applied to ``src`` (staged for the cascades)."""
    if profile in _CASCADES:
        return with_cascades(df, src, {profile: out})
    return df.withColumn(out, extract(profile, src))


def with_normalized(df: DataFrame, profile: str, src, out: str) -> DataFrame:
    """Add ``out`` = normaliser ``profile`` applied to ``src`` (staged)."""
    if profile not in ("integral", "rounded"):
        return df.withColumn(out, normalize(profile, src))
    c = _col(src)
    d = df.withColumn("__ns_s", rstrip_dots(trim_u(c))).withColumn("__ns_null", c.isNull())
    s = F.col("__ns_s")
    d = d.withColumn("__ns_n", without(s, ",") if profile == "integral" else s)
    n = F.col("__ns_n")
    # a short integer as Python prints it stands for itself (try_cast is slow for texts that are no number)
    digits = (F.btrim(n, F.lit("0123456789")) == F.lit("")) & F.length(n).between(1, 15)
    d = d.withColumn("__ns_i", F.coalesce(digits & (~F.startswith(n, F.lit("0")) | (n == F.lit("0"))), F.lit(False)))
    # of digits, signs and dots alone the cast takes what Python takes; a text that begins like no number is
    # none; any other text goes the whole way
    begin = F.ascii(n)
    plain = F.btrim(n, F.lit("0123456789.+-")) == F.lit("")
    d = d.withColumn("__ns_d", F.when(F.col("__ns_i") | begin.between(33, 42) | begin.between(58, 127), F.lit(None).cast("double"))
                     .when(plain, n.try_cast("double")).otherwise(_as_double(n)))
    dd = F.col("__ns_d")
    if profile == "integral":
        val = F.when(dd.isNotNull() & ((dd % F.lit(1.0)) == F.lit(0.0)), _integer_text(dd))
    else:
        val = _integer_text(F.bround(dd, 0))
    d = d.withColumn(out, F.when(F.col("__ns_null"), F.lit("")).when(F.col("__ns_i"), n).otherwise(F.coalesce(val, F.lower(s))))
    return d.drop("__ns_s", "__ns_n", "__ns_d", "__ns_i", "__ns_null")


def is_match(c) -> Column:
    """True for a boolean true or an int 1 em value; NULL counts as a miss."""
    return F.coalesce(_col(c).cast("int") == F.lit(1), F.lit(False))


def with_em(df: DataFrame, profile: str, gold, text, out: str = "em") -> DataFrame:
    """Add the exact-match column ``out`` for ``profile`` (same values as :func:`score`),
    computing the normalised gold and prediction keys as intermediate columns."""
    d = with_gold_key(df, profile, gold, "__em_gk")
    d = with_pred_key(d, profile, text, "__em_pk")
    return d.withColumn(out, em_from_keys(profile, "__em_gk", "__em_pk")).drop("__em_gk", "__em_pk")


# ---- key form: gold side once per problem, prediction side per candidate ------
#
# Every profile compares a normalised gold key with a normalised prediction key. The gold
# key depends only on the problem, so it is computed on the problem table (one row per
# problem) before the candidate join instead of once per candidate. An extracted number holds no
# blank, comma or ``$``, so the strip and N2 would leave it as it is.

def with_gold_key(df: DataFrame, profile: str, gold, out: str) -> DataFrame:
    """Add the normalised gold key of ``profile`` (NULL when the profile scores no gold)."""
    g = _col(gold)
    if profile == "hash_loose":
        return df.withColumn(out, F.coalesce(extract_hash_loose(g), trim_u(g)))
    if profile == "hash_then_any":
        return df.withColumn(out, F.coalesce(extract_hash_strict(g), normalize_money(g)))
    if profile in _CASCADES:
        return with_gold_keys(df, {profile: out}, gold)
    raise ValueError(f"unknown EM profile {profile!r}; known: {sorted(SCORERS)}")


def with_gold_keys(df: DataFrame, outputs: dict[str, str], gold) -> DataFrame:
    """Add the gold keys of several profiles (``{profile: out_column}``); the cascades share one list of cue hits."""
    cascades = {p: f"__gk_{p}" for p in outputs if p in _CASCADES}
    d = with_cascades(df, gold, cascades) if cascades else df
    for profile, out in outputs.items():
        if profile not in cascades:
            d = with_gold_key(d, profile, gold, out)
            continue
        x = cascades[profile]
        d = with_normalized(d, "integral" if profile == "cascade_last" else "rounded", x, out)
        d = d.withColumn(out, F.when(F.col(x) != F.lit(""), F.col(out)) if profile == "cascade_last" else F.nullif(F.col(out), F.lit("")))
    return d.drop(*cascades.values())


def with_pred_key(df: DataFrame, profile: str, text, out: str) -> DataFrame:
    """Add the normalised prediction key of ``profile``."""
    t = _col(text)
    if profile == "hash_loose":
        return df.withColumn(out, F.coalesce(extract_hash_loose(t), F.lit("")))
    if profile == "hash_then_any":
        return df.withColumn(out, F.coalesce(extract_hash_strict(t), extract_last_number(t)))
    if profile == "cascade_last":
        d = with_extracted(df, "cascade_last", text, "__pk_x")
        return with_normalized(d, "integral", "__pk_x", out).drop("__pk_x")
    if profile in ("cascade_first", "cascade_first_shell"):
        d = with_extracted(df, profile, text, "__pk_x")
        return with_normalized(d, "rounded", "__pk_x", out).drop("__pk_x")
    raise ValueError(f"unknown EM profile {profile!r}; known: {sorted(SCORERS)}")


def em_from_keys(profile: str, gold_key, pred_key) -> Column:
    """The EM value of ``profile`` from its two keys (same values as :func:`score`)."""
    g, p = _col(gold_key), _col(pred_key)
    if profile in ("hash_loose", "hash_then_any"):
        return F.coalesce(p == g, F.lit(False))
    if profile == "cascade_last":
        return F.when(g.isNull(), F.lit(None).cast("int")).otherwise((g == p).cast("int"))
    if profile in ("cascade_first", "cascade_first_shell"):
        return F.coalesce((p != F.lit("")) & (g == p), F.lit(False)).cast("int")
    raise ValueError(f"unknown EM profile {profile!r}; known: {sorted(SCORERS)}")
