"""DuckDB SQL used as an independent oracle for the registered queries.

Written directly in SQL against the driver's tables (``orders``, ``lineitem``, ...), not
generated from the Spark plans. DuckDB's regex engine is RE2 (ASCII classes); the
fixture text is ASCII, so its results must equal the Spark Columns' exactly.
"""

from __future__ import annotations


def q(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


# ---- scalar expression builders (DuckDB dialect) ---------------------------

def trim_ws(e: str) -> str:
    return f"regexp_replace({e}, '^\\s+|\\s+$', '', 'g')"


def last_match(e: str, pattern: str, group: int = 1) -> str:
    return f"regexp_extract_all({e}, {q(pattern)}, {group})[-1]"


def first_match(e: str, pattern: str, group: int = 1) -> str:
    return f"nullif(regexp_extract({e}, {q(pattern)}, {group}), '')"


def x1(e: str) -> str:
    return f"replace({last_match(e, r'####\s*([-\d][\d,\.]*)')}, ',', '')"


def x2(e: str) -> str:
    return last_match(e, r"####\s*([\-]?\d+(?:\.\d+)?)")


def x2f(e: str) -> str:
    return last_match(e, r"[\-]?\d+(?:\.\d+)?", 0)


def x5(e: str) -> str:
    return last_match(e, r"####\s*([+-]?\d+\.?\d*)\b")


_CUES = {
    "final": r"final answer(?: is|:)?\s*([+-]?\d+\.?\d*)\b",
    "answer": r"answer(?: is|:)?\s*([+-]?\d+\.?\d*)\b",
    "hash": r"####\s*([+-]?\d+\.?\d*)\b",
    "arrow": r"=>\s*([+-]?\d+\.?\d*)\b",
    "eq": r"=\s*([+-]?\d+\.?\d*)\b",
    "result": r"result(?: is|:)?\s*([+-]?\d+\.?\d*)\b",
}


def _last_line(t: str) -> str:
    return trim_ws(f"regexp_extract({t}, '([^\\n\\r]*)$', 1)")


def x3(e: str) -> str:
    t = trim_ws(e)
    low = f"lower({t})"
    cues = [f"replace({last_match(low, _CUES[k])}, ',', '')"
            for k in ("final", "answer", "hash", "arrow", "eq", "result")]
    nums = last_match(f"replace({t}, ',', '')", r"[+-]?\d+\.?\d*", 0)
    return f"CASE WHEN {e} IS NULL THEN '' ELSE coalesce({', '.join(cues)}, {nums}, {_last_line(t)}) END"


def x4(e: str, with_result: bool = True) -> str:
    t = trim_ws(e)
    low = f"lower({t})"
    keys = ["final", "answer", "eq", "arrow", "hash"] + (["result"] if with_result else [])
    cues = [f"replace({first_match(low, _CUES[k])}, ',', '')" for k in keys]
    nums = last_match(f"replace({t}, ',', '')", r"[+-]?\d+\.?\d*", 0)
    return f"CASE WHEN {e} IS NULL THEN '' ELSE coalesce({', '.join(cues)}, {nums}, {_last_line(t)}) END"


def n2(e: str) -> str:
    return f"regexp_replace(replace({trim_ws(e)}, ',', ''), '^\\$', '')"


_FLOAT = r"^[+-]?([0-9](_?[0-9])*(\.([0-9](_?[0-9])*)?)?|\.[0-9](_?[0-9])*)([eE][+-]?[0-9](_?[0-9])*)?$"


def _num(e: str) -> str:
    t = trim_ws(e)
    return f"(CASE WHEN regexp_full_match({t}, {q(_FLOAT)}) THEN TRY_CAST(replace({t}, '_', '') AS DOUBLE) END)"


def n3(e: str) -> str:
    s = f"regexp_replace({trim_ws(e)}, '\\.+$', '')"
    d = _num(f"replace({s}, ',', '')")
    return (f"CASE WHEN {e} IS NULL THEN '' ELSE coalesce(CASE WHEN {d} % 1 = 0 THEN "
            f"CAST(TRY_CAST({d} AS DECIMAL(38,0)) AS VARCHAR) END, lower({s})) END")


def n4(e: str) -> str:
    s = f"regexp_replace({trim_ws(e)}, '\\.+$', '')"
    d = _num(s)
    return (f"CASE WHEN {e} IS NULL THEN '' ELSE coalesce("
            f"CAST(TRY_CAST(round_even({d}, 0) AS DECIMAL(38,0)) AS VARCHAR), lower({s})) END")


def m1(gold: str, text: str) -> str:
    g = f"coalesce({x1(gold)}, {gold})"
    p = f"coalesce({x1(text)}, '')"
    return f"(CASE WHEN {g} IS NULL THEN false ELSE {trim_ws(p)} = {trim_ws(g)} END)"


def m2(gold: str, text: str) -> str:
    g = n2(f"coalesce({x2(gold)}, {gold})")
    p = n2(f"coalesce({x2(text)}, {x2f(text)})")
    return f"coalesce({p} = {g}, false)"


# ---- fixture CTEs -------------------------------------------------------------

def numbered_lines_cte() -> str:
    return """nl AS (
  SELECT l_orderkey AS id, CAST(l_quantity AS BIGINT) AS q,
         CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey,
              l_suppkey, l_extendedprice, l_shipdate) AS INTEGER) AS cand_idx
  FROM lineitem)"""


def candidates_cte(name: str = "cand", shift: int = 0) -> str:
    return f"""{name} AS (
  SELECT id, cand_idx, CASE (cand_idx + {shift}) % 5
      WHEN 0 THEN 'step = ' || CAST(q AS VARCHAR) || ' so #### ' || CAST(q AS VARCHAR)
      WHEN 1 THEN '#### ' || CAST(q AS VARCHAR) || ' units'
      WHEN 2 THEN 'Final answer: $' || CAST(q AS VARCHAR)
      WHEN 3 THEN 'no number here'
      ELSE '12 = ' || CAST(q AS VARCHAR) || ' then #### 1,' || CAST(q AS VARCHAR) END AS text
  FROM nl)"""


def problems_cte() -> str:
    return """prob AS (
  SELECT o_orderkey AS id,
    'Order ' || CAST(o_orderkey AS VARCHAR) || ' of customer ' || CAST(o_custkey AS VARCHAR)
      || ' has priority ' || o_orderpriority
      || '. What is the largest quantity on one of its lines?' AS question,
    'Order has parts. #### ' || CAST(coalesce(g.gold, 0) AS VARCHAR) AS answer,
    CAST(coalesce(g.gold, 0) AS BIGINT) AS gold
  FROM orders LEFT JOIN (SELECT l_orderkey, CAST(max(l_quantity) AS BIGINT) AS gold
                         FROM lineitem GROUP BY l_orderkey) g ON o_orderkey = g.l_orderkey)"""


def fixture_ctes(rationalized: bool = False) -> str:
    parts = [numbered_lines_cte(), candidates_cte("cand", 0), problems_cte()]
    if rationalized:
        parts.append(candidates_cte("rcand", 2))
    return "WITH " + ",\n".join(parts)


def m3_stage(gold: str, text: str) -> tuple[str, str]:
    """(select-list adding gx/px, expression over gx/px) for the M3 profile."""
    return (f"{x3(gold)} AS gx, {x3(text)} AS px",
            f"CASE WHEN gx = '' THEN NULL ELSE CAST({n3('gx')} = {n3('px')} AS INTEGER) END")


def m4(gold: str, text: str, with_result: bool = True) -> str:
    g = n4(x4(gold, with_result))
    p = n4(x4(text, with_result))
    return f"CAST(({g}) <> '' AND ({p}) <> '' AND ({g}) = ({p}) AS INTEGER)"


LINE_SPLIT = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x{85}\x{2028}\x{2029}]"


def rationale_expr(g: str) -> str:
    """P8 over an already stripped text expression ``g``."""
    lines = (f"list_filter(list_transform(string_split_regex({g}, {q(LINE_SPLIT)}), "
             f"lambda x: {trim_ws('x')}), lambda x: x <> '')")
    return (f"CASE WHEN len({lines}) > 1 THEN array_to_string(({lines})[1:len({lines}) - 1], chr(10)) "
            f"ELSE {g} END")


def render_sql(template: str, **exprs: str) -> str:
    from string import Formatter
    parts = []
    for literal, field, _, _ in Formatter().parse(template):
        if literal:
            parts.append(q(literal))
        if field is not None:
            parts.append(f"CAST({exprs[field]} AS VARCHAR)")
    return " || ".join(parts) if parts else "''"


def kept_cte(name: str = "kept", cand: str = "cand") -> str:
    """First correct (M2) candidate per problem."""
    return f"""{name} AS (
  SELECT c.id, p.question, c.text AS rationale, p.answer AS final, c.cand_idx
  FROM {cand} c JOIN prob p ON c.id = p.id
  WHERE {m2('p.answer', 'c.text')}
  QUALIFY row_number() OVER (PARTITION BY c.id ORDER BY c.cand_idx) = 1)"""


def missed_cte(name: str = "missed", kept: str = "kept") -> str:
    return f"""{name} AS (
  SELECT p.* FROM prob p ANTI JOIN {kept} k ON p.id = k.id)"""
