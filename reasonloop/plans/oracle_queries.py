"""Oracle SQL per registered query (DuckDB dialect), written against the driver's tables."""

from __future__ import annotations

from ..functions import prompts as PR
from .fixture import RECORDED_HINTED, RECORDED_VARIANTS
from .oracle_sql import (candidates_cte, fixture_ctes, kept_cte, m1, m2, m3_stage, m4,
                         missed_cte, n2, n3, n4, q, rationale_expr, render_sql, trim_ws, x1,
                         x2, x2f, x3, x4, x5)

NL = "chr(10)"
FIX = fixture_ctes()
FIX_R = fixture_ctes(rationalized=True)

KEEP_FIRST_CORRECT = FIX + ",\n" + kept_cte() + """
SELECT id, question, rationale, final, cand_idx FROM kept
"""

GREEDY_ACCURACY = FIX + f""",
preds AS (
  SELECT p.id, {m1('p.answer', 'c.text')} AS em
  FROM prob p LEFT JOIN (SELECT id, text FROM cand WHERE cand_idx = 1) c ON p.id = c.id)
SELECT count(*) AS n, CAST(sum(CAST(em AS INTEGER)) AS BIGINT) AS correct,
       round(sum(CAST(em AS INTEGER)) / greatest(count(*), 1), 8) AS accuracy
FROM preds
"""

MISSED_PROBLEMS = FIX + ",\n" + kept_cte() + ",\n" + missed_cte() + """
SELECT id, question, answer FROM missed
"""

_RAT = FIX_R + ",\n" + kept_cte() + ",\n" + missed_cte() + f""",
rat AS (
  SELECT r.id, m.question, r.text AS rationale, m.answer AS final, r.cand_idx
  FROM rcand r JOIN missed m ON r.id = m.id
  WHERE {m2('m.answer', 'r.text')}
  QUALIFY row_number() OVER (PARTITION BY r.id ORDER BY r.cand_idx) = 1)"""

def _key(prompt: str, settings: str) -> str:
    """Key of a prompt expression under the settings, as SQL."""
    return f"md5({q(settings)} || chr(10) || {prompt})"


_RECORDED = '{"do_sample": false, "max_new_tokens": 160}'


def _recorded(parts: tuple[str, ...], *exprs: str) -> str:
    """SQL of a recorded prompt: its parts with the expressions between them."""
    out = [q(parts[0])]
    for e, part in zip(exprs, parts[1:]):
        out += [f"CAST({e} AS VARCHAR)", q(part)]
    return " || ".join(out)


# the store is keyed by the recorded prompts, looked up by the rendered ones
RATIONALIZE_MISSED = FIX_R + ",\n" + kept_cte() + ",\n" + missed_cte() + f""",
store AS (
  SELECT {_key(_recorded(RECORDED_HINTED, 'p.gold', 'p.question'), _RECORDED)} AS prompt_key, r.cand_idx, r.text
  FROM rcand r JOIN prob p ON p.id = r.id),
asked AS (
  SELECT *, {_key(render_sql(PR.RATIONALIZE, question='question', gold_final=f"coalesce({x2('answer')}, answer)"), _RECORDED)} AS prompt_key
  FROM missed)
SELECT a.id, a.question, s.text AS rationale, a.answer AS final, s.cand_idx
FROM asked a JOIN store s ON s.prompt_key = a.prompt_key
WHERE {m2('a.answer', 's.text')}
QUALIFY row_number() OVER (PARTITION BY a.id ORDER BY s.cand_idx) = 1
"""

_GENERATED = '{"do_sample": true, "k": 2}'
RESUMED_GENERATION = f"""
WITH turns AS (
  SELECT conv_id || ':' || turn AS id, text AS question FROM conversations WHERE role = 'user' AND text IS NOT NULL),
asked AS (SELECT id, {render_sql(PR.FORWARD, question='question')} AS prompt FROM turns),
keyed AS (SELECT *, {_key('prompt', _GENERATED)} AS k FROM asked),
made AS (SELECT id, prompt, unnest([1, 2]) AS cand_idx, CAST('0x' || substr(k, 1, 8) AS BIGINT) % 4 AS unit FROM keyed)
SELECT id, cand_idx, 'attempt ' || cand_idx || ': #### ' || (length(prompt) * cand_idx) AS text,
       CASE WHEN unit < 2 THEN 1 ELSE 2 END AS run,
       (SELECT count(DISTINCT prompt) FROM asked) AS generated, (SELECT count(DISTINCT prompt) FROM asked) AS distinct_prompts
FROM made
"""

ONE_ITERATION = _RAT + f"""
SELECT id, '###Input:' || {NL} || question || {NL} || {NL} || '###Output:' || {NL} || rationale
       || {NL} || '#### ' || final AS text, src
FROM (SELECT id, question, rationale, final, 0 AS src FROM kept
      UNION ALL SELECT id, question, rationale, final, 1 AS src FROM rat)
"""

STREAM_TOTALS = _RAT + """
SELECT (SELECT count(*) FROM kept) AS fwd_kept, (SELECT count(*) FROM rat) AS rat_kept
"""

MERGE_LAST_WINS = FIX_R + ",\n" + kept_cte("a", "cand") + ",\n" + kept_cte("b", "rcand") + """,
u AS (SELECT id, rationale, cand_idx, 0 AS src FROM a
      UNION ALL SELECT id, rationale, cand_idx, 1 AS src FROM b)
SELECT id, rationale, cand_idx, src, first_src, first_pos FROM (
  SELECT id, rationale, cand_idx, src, min(src) OVER (PARTITION BY id) AS first_src,
         id AS first_pos, row_number() OVER (PARTITION BY id ORDER BY src DESC) AS rn
  FROM u) WHERE rn = 1
"""


INCREMENTAL_MERGE = (FIX_R + ",\n" + candidates_cte("xcand", 1) + ",\n" + kept_cte("a", "cand") + ",\n" + kept_cte("b", "rcand")
                     + ",\n" + kept_cte("x", "xcand") + """,
u AS (SELECT id, rationale, cand_idx, 0 AS src FROM a
      UNION ALL SELECT id, rationale, cand_idx, 1 AS src FROM b
      UNION ALL SELECT id, rationale, cand_idx, 2 AS src FROM x
      WHERE id IN (SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT'))
SELECT id, rationale, cand_idx, src, min(src) OVER (PARTITION BY id) AS first_src, id AS first_pos
FROM u QUALIFY row_number() OVER (PARTITION BY id ORDER BY src DESC) = 1
""")


def _retry_base(shifts=(1,), last_only=True):
    ctes = [FIX]
    for s in shifts:
        ctes.append(candidates_cte(f"rall{s}", s))
        if last_only:
            ctes.append(f"""r{s} AS (
  SELECT id, arg_max(text, cand_idx) AS text, 1 AS cand_idx FROM rall{s} GROUP BY id)""")
        else:
            ctes.append(f"r{s} AS (SELECT * FROM rall{s})")
    ctes += [kept_cte(), missed_cte()]
    return ",\n".join(ctes)


RETRY_KEEP_CORRECT = _retry_base() + f"""
SELECT m.id, m.question, m.answer AS gold_answer, r.text AS output, true AS em_after
FROM missed m JOIN r1 r ON m.id = r.id
WHERE {m1('m.answer', 'r.text')}
"""

RETRY_FLAG_ALL = _retry_base() + f"""
SELECT m.id, m.question, m.answer AS gold_answer, r.text AS output,
       {m1('m.answer', 'r.text')} AS em_after
FROM missed m JOIN r1 r ON m.id = r.id
"""

RETRY_SHORTEST_CORRECT = _retry_base((2,), last_only=False) + f"""
SELECT m.id, m.question, m.answer AS gold_answer, r.text AS output, r.cand_idx, true AS em_after
FROM missed m JOIN r2 r ON m.id = r.id
WHERE {m1('m.answer', 'r.text')}
QUALIFY row_number() OVER (PARTITION BY m.id ORDER BY length(r.text), r.cand_idx) = 1
"""

SHORTEST_VS_FIRST = FIX + f""",
hits AS (SELECT c.id, c.cand_idx, c.text FROM cand c JOIN prob p ON c.id = p.id
         WHERE {m2('p.answer', 'c.text')}),
f AS (SELECT id, min(cand_idx) AS first_idx FROM hits GROUP BY id),
s AS (SELECT id, cand_idx AS shortest_idx FROM hits
      QUALIFY row_number() OVER (PARTITION BY id ORDER BY length(text), cand_idx) = 1)
SELECT f.id, f.first_idx, s.shortest_idx FROM f JOIN s ON f.id = s.id
WHERE f.first_idx <> s.shortest_idx
"""


def _train_rows(src: str, keep_all: bool) -> str:
    fin = x1(f"{src}.output")
    if keep_all:
        return (f"SELECT question, output AS rationale, CASE WHEN {fin} IS NOT NULL THEN '#### ' || {fin} "
                f"ELSE '' END AS answer FROM {src}")
    return (f"SELECT question, output AS rationale, '#### ' || {fin} AS answer FROM {src} "
            f"WHERE {fin} IS NOT NULL")


def _retry_rows_cte(name: str, cand: str, keep_all: bool) -> str:
    if keep_all:
        return f"""{name} AS (
  SELECT m.id, m.question, m.answer AS gold_answer, r.text AS output
  FROM missed m JOIN {cand} r ON m.id = r.id)"""
    return f"""{name} AS (
  SELECT m.id, m.question, m.answer AS gold_answer, r.text AS output
  FROM missed m JOIN {cand} r ON m.id = r.id
  WHERE {m1('m.answer', 'r.text')})"""


def _train_set(keep_all: bool) -> str:
    return (_retry_base((0, 1)) + ",\n" + _retry_rows_cte("prev_rows", "r0", keep_all) + ",\n"
            + _retry_rows_cte("cur_rows", "r1", keep_all) + "\n"
            + _train_rows("cur_rows", keep_all) + "\nUNION ALL\n" + _train_rows("prev_rows", keep_all))


TRAIN_SET_CORRECT_ONLY = _train_set(False)
TRAIN_SET_KEEP_ALL = _train_set(True)

COLLECT_MISSES = FIX + f""",
preds AS (
  SELECT 'hf_test_' || CAST(p.id AS VARCHAR) AS id,
         CASE WHEN o.o_orderstatus <> 'P' THEN p.question END AS question,
         CASE WHEN o.o_orderpriority <> '1-URGENT' THEN p.answer END AS gold_answer,
         {m1('p.answer', 'c.text')} AS em
  FROM prob p JOIN orders o ON p.id = o.o_orderkey
  LEFT JOIN (SELECT id, text FROM cand WHERE cand_idx = 1) c ON p.id = c.id),
miss AS (
  SELECT *, (question IS NULL OR gold_answer IS NULL) AS needs,
         CASE WHEN (question IS NULL OR gold_answer IS NULL) AND starts_with(id, 'hf_test_')
              THEN TRY_CAST(regexp_extract(id, '([^_]*)$', 1) AS BIGINT) END AS idx
  FROM preds WHERE NOT coalesce(em, false)),
filled AS (
  SELECT m.id,
         CASE WHEN m.needs AND starts_with(m.id, 'hf_test_') AND d.question IS NOT NULL
              THEN d.question ELSE m.question END AS question,
         CASE WHEN m.needs AND starts_with(m.id, 'hf_test_') AND d.question IS NOT NULL
              THEN d.answer ELSE m.gold_answer END AS gold_answer
  FROM miss m LEFT JOIN prob d ON m.idx = d.id)
SELECT id, question, gold_answer FROM filled
WHERE coalesce(question, '') <> '' AND coalesce(gold_answer, '') <> ''
"""

EXTRACT_PROFILES = FIX + f"""
SELECT id, cand_idx, {x1('text')} AS x_hash_loose, {x2('text')} AS x_hash_strict,
       {x2f('text')} AS x_last_number, {x3('text')} AS x_cascade_last,
       {x4('text')} AS x_cascade_first, {x4('text', False)} AS x_cascade_first_shell,
       {x5('text')} AS x_solution_number
FROM cand
"""

_M3_SEL, _M3_EXPR = m3_stage("p.answer", "c.text")
EM_PROFILES = FIX + f""",
st AS (
  SELECT c.id, c.cand_idx, c.text, p.answer, {x3('c.text')} AS x3v, {x4('c.text')} AS x4v, {_M3_SEL}
  FROM cand c JOIN prob p ON c.id = p.id)
SELECT id, cand_idx, {trim_ws('text')} AS n_trim, {n2(x2f('text'))} AS n_money,
       {n3('x3v')} AS n_integral, {n4('x4v')} AS n_rounded,
       CAST({m1('answer', 'text')} AS INTEGER) AS em_hash_loose,
       CAST({m2('answer', 'text')} AS INTEGER) AS em_hash_then_any,
       {_M3_EXPR} AS em_cascade_last,
       {m4('answer', 'text')} AS em_cascade_first
FROM st
"""

_SHAPES_SEL, _SHAPES_EXPR = m3_stage("gold", "text")
ANSWER_SHAPES = f"""
WITH n AS (SELECT *, CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) AS q FROM lineitem),
t AS (
  SELECT l_orderkey AS id, l_linenumber AS line, l_partkey AS part, l_suppkey AS supp,
    CASE (l_orderkey + l_linenumber) % 11
      WHEN 0 THEN 'So the final answer is -' || q
      WHEN 1 THEN 'The ANSWER: +' || q || '.50'
      WHEN 2 THEN 'a => ' || q || '.'
      WHEN 3 THEN 'the result is ' || q || '.0 apples'
      WHEN 4 THEN 'Result: $' || q || ',500.00'
      WHEN 5 THEN '#### -1,' || q
      WHEN 6 THEN '  ' || q || '  '
      WHEN 7 THEN 'nothing here' || {NL} || 'last line words'
      WHEN 8 THEN ''
      WHEN 9 THEN NULL
      ELSE 'final answer: 7 but x = ' || q || '.75' END AS text,
    CASE l_partkey % 6
      WHEN 0 THEN '#### ' || q
      WHEN 1 THEN NULL
      WHEN 2 THEN ''
      WHEN 3 THEN 'cost #### $' || q
      WHEN 4 THEN '-' || q || '.0'
      ELSE 'The answer is ' || q || '.5 or #### 1,' || q END AS gold
  FROM n),
st AS (SELECT *, {x3('text')} AS x_last, {x4('text')} AS x_first, {_SHAPES_SEL} FROM t)
SELECT id, line, part, supp, {x1('text')} AS x_hash_loose, {x2('text')} AS x_hash_strict,
       {x2f('text')} AS x_last_number, {x5('text')} AS x_solution_number, x_last, x_first,
       {trim_ws('text')} AS n_trim, {n2('text')} AS n_money, {n3('x_last')} AS n_integral,
       {n4('x_first')} AS n_rounded,
       CAST({m1('gold', 'text')} AS INTEGER) AS em_hash_loose,
       CAST({m2('gold', 'text')} AS INTEGER) AS em_hash_then_any,
       {_SHAPES_EXPR} AS em_cascade_last, {m4('gold', 'text')} AS em_cascade_first
FROM st
"""

GOLD_SFT_SET = FIX + f""",
s AS (SELECT p.id, p.question, p.answer, {trim_ws("coalesce(c.text, '')")} AS rationale
      FROM prob p LEFT JOIN (SELECT id, text FROM cand WHERE cand_idx = 1) c ON p.id = c.id)
SELECT id, {trim_ws('question')} AS question, rationale,
       coalesce('#### ' || {x5('rationale')}, {trim_ws('answer')}) AS answer
FROM s
"""

STEP_ROLLUP = """
WITH log AS (
  SELECT user_id AS run, CASE WHEN event_type IN ('view', 'purchase') THEN 'val' ELSE 'train' END AS phase,
         event_id AS step, value / 100.0 AS loss
  FROM events WHERE event_type <> 'error' AND value IS NOT NULL)
SELECT run, phase, count(*) AS steps, round(avg(loss), 8) AS avg_step_loss,
       round(avg(exp(loss)), 8) AS avg_step_perplexity, round(min(loss), 8) AS best_step_loss,
       round(arg_max(loss, step), 8) AS last_step_loss
FROM log GROUP BY run, phase
"""

_ZS_BASE = FIX + f""",
zs0 AS (
  SELECT c.id, c.cand_idx, p.question, {trim_ws('c.text')} AS generated,
         coalesce(p.answer, '') AS gold
  FROM cand c JOIN prob p ON c.id = p.id),
zs1 AS (SELECT *, {x3('generated')} AS answer, {x3('gold')} AS gold_extracted FROM zs0),
zs AS (
  SELECT id, cand_idx, question, generated, {rationale_expr('generated')} AS rationale, answer, gold,
         gold_extracted,
         CASE WHEN gold_extracted = '' THEN NULL
              ELSE CAST({n3('gold_extracted')} = {n3('answer')} AS INTEGER) END AS em
  FROM zs1)"""

ZERO_SHOT_RECORDS = _ZS_BASE + """
SELECT id, cand_idx, question, generated, rationale, answer, gold, gold_extracted, em FROM zs
"""

RESCORE_ACCURACY = _ZS_BASE + """
SELECT cand_idx, count(*) AS total, count(em) AS n_gold,
       CAST(coalesce(sum(em), 0) AS BIGINT) AS correct,
       round(coalesce(avg(em), 0.0), 8) AS accuracy
FROM zs GROUP BY cand_idx
"""

EXPERIMENT_COMPARISON = _ZS_BASE + """
SELECT 'cand' || CAST(cand_idx AS VARCHAR) AS label, count(*) AS total, count(em) AS n_gold,
       CAST(coalesce(sum(em), 0) AS BIGINT) AS correct,
       round(coalesce(avg(em), 0.0), 8) AS accuracy,
       count(*) FILTER (WHERE coalesce(contains(generated, '####'), false)) AS parse_ok
FROM zs GROUP BY cand_idx
"""

MISMATCH_EXPORT = _ZS_BASE + """
SELECT id, cand_idx, gold AS gold_raw, gold_extracted, generated AS pred_raw, answer AS pred_extracted, em
FROM zs WHERE em = 0
"""

RESCORE_STORED_PREDICTIONS = _ZS_BASE + f""",
r0 AS (
  SELECT id, cand_idx,
         coalesce(nullif(gold, ''), nullif(answer, ''), '') AS gold_raw,
         coalesce(nullif(answer, ''), nullif(generated, ''), '') AS pred_raw
  FROM zs),
r1 AS (
  SELECT *, CASE WHEN gold_raw <> '' THEN {x3('gold_raw')} ELSE gold_raw END AS gold_extracted,
            CASE WHEN pred_raw <> '' THEN {x3('pred_raw')} ELSE pred_raw END AS pred_extracted
  FROM r0)
SELECT id, cand_idx, gold_raw, gold_extracted, pred_raw, pred_extracted,
       CASE WHEN gold_raw = '' THEN NULL
            ELSE CAST({n3('gold_extracted')} = {n3('pred_extracted')} AS INTEGER) END AS em
FROM r1
"""

_VARIANTS = FIX + f""",
store AS (
  SELECT CASE (c.cand_idx - 1) % 3 + 1
           {" ".join(f"WHEN {i + 1} THEN " + _key(_recorded(RECORDED_VARIANTS[v], 'p.question'), _RECORDED)
                     for i, v in enumerate(PR.VARIANTS))} END AS prompt_key, c.cand_idx, c.text
  FROM cand c JOIN prob p ON p.id = c.id),
pv AS (
  {" UNION ALL ".join(f"SELECT id, answer, '{v}' AS variant, "
                      + _key(render_sql(PR.TEMPLATES[v], q='question'), _RECORDED) + " AS prompt_key FROM prob" for v in PR.VARIANTS)}),
vp AS (
  SELECT pv.id, pv.variant, c.cand_idx, c.text AS generated, pv.answer,
         {m4('pv.answer', 'c.text', False)} AS em
  FROM pv LEFT JOIN store c ON pv.prompt_key = c.prompt_key)"""

PROMPT_ABLATION = _VARIANTS + """
SELECT variant, count(*) AS total, CAST(sum(em) AS BIGINT) AS correct,
       CAST(sum(1 - em) AS BIGINT) AS mismatches, round(sum(em) / count(*), 8) AS em_rate
FROM vp GROUP BY variant
"""

ABLATION_MISMATCHES = _VARIANTS + """
SELECT variant, id, cand_idx, generated, em FROM vp WHERE em = 0
QUALIFY row_number() OVER (PARTITION BY variant ORDER BY id, cand_idx NULLS FIRST) <= 6
"""

TOP_MISMATCHES = FIX + f""",
preds AS (
  SELECT p.id, c.text, p.answer, CAST({m1('p.answer', 'c.text')} AS INTEGER) AS em
  FROM prob p LEFT JOIN (SELECT id, text FROM cand WHERE cand_idx = 1) c ON p.id = c.id)
SELECT id, text, answer, em FROM preds WHERE em = 0 ORDER BY id LIMIT 20
"""

STAGE_REPORT = _retry_base() + ",\n" + _retry_rows_cte("kept_retry", "r1", False) + f""",
preds AS (
  SELECT CAST({m1('p.answer', 'c.text')} AS INTEGER) AS em
  FROM prob p LEFT JOIN (SELECT id, text FROM cand WHERE cand_idx = 1) c ON p.id = c.id),
train AS ({_train_rows('kept_retry', False)})
SELECT 'fixture' AS run, 'zero_shot' AS stage, 'em' AS metric,
       CAST(round(sum(coalesce(em, 0)) / greatest(count(*), 1), 8) AS DOUBLE) AS value FROM preds
UNION ALL SELECT 'fixture', 'iter2', 'misses', CAST(count(*) AS DOUBLE) FROM missed
UNION ALL SELECT 'fixture', 'iter2', 'generated', CAST(count(*) AS DOUBLE) FROM missed
UNION ALL SELECT 'fixture', 'iter2', 'kept_correct', CAST(count(*) AS DOUBLE) FROM kept_retry
UNION ALL SELECT 'fixture', 'iter2', 'train_size', CAST(count(*) AS DOUBLE) FROM train
"""

PROGRESS_COUNTERS = _RAT + """,
flags AS (
  SELECT p.id, row_number() OVER (ORDER BY p.id) - 1 AS ordinal,
         CASE WHEN k.id IS NOT NULL THEN 1 ELSE 0 END AS f,
         CASE WHEN r.id IS NOT NULL THEN 1 ELSE 0 END AS r
  FROM prob p LEFT JOIN kept k ON p.id = k.id LEFT JOIN rat r ON p.id = r.id),
stats AS (
  SELECT CAST(floor(ordinal / 16) AS BIGINT) AS batch_id, CAST(sum(f) AS BIGINT) AS fwd_kept,
         CAST(sum(r) AS BIGINT) AS rat_kept
  FROM flags GROUP BY 1),
cum AS (
  SELECT batch_id, fwd_kept, rat_kept,
         CAST(sum(fwd_kept) OVER (ORDER BY batch_id) AS BIGINT) AS cum_fwd_kept,
         CAST(sum(rat_kept) OVER (ORDER BY batch_id) AS BIGINT) AS cum_rat_kept
  FROM stats)
SELECT * FROM cum WHERE (batch_id + 1) % 10 = 0
"""

LOSS_ROLLUP = """
WITH log AS (
  SELECT user_id AS run,
         CASE WHEN event_type IN ('view', 'purchase') THEN 'val' ELSE 'train' END AS phase,
         CAST(date_diff('day', DATE '1970-01-01', CAST(ts AS DATE)) AS INTEGER) AS epoch,
         CASE WHEN event_type = 'error' THEN NULL ELSE value / 100.0 END AS loss
  FROM events),
pe AS (
  SELECT run, phase, epoch, count(*) AS batches, sum(coalesce(loss, 0.0)) / count(*) AS epoch_loss
  FROM log GROUP BY run, phase, epoch),
best AS (
  SELECT *, min(epoch_loss) OVER (PARTITION BY run, phase ORDER BY epoch
            ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS best_loss
  FROM pe)
SELECT run, phase, epoch, batches, round(epoch_loss, 8) AS epoch_loss,
       round(exp(epoch_loss), 8) AS perplexity,
       round(best_loss, 8) AS best_loss,
       round(avg(epoch_loss) OVER (PARTITION BY run, phase), 8) AS avg_loss,
       round(avg(exp(epoch_loss)) OVER (PARTITION BY run, phase), 8) AS avg_perplexity,
       round(avg(best_loss) OVER (PARTITION BY run, phase), 8) AS avg_best_loss
FROM best
"""


def _sft_batches(cap: int | None) -> str:
    ml = "longest" if cap is None else f"least(longest, {cap})"
    return f"""
WITH ex AS (
  SELECT row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate) - 1
           AS ordinal,
         list_slice([CAST(l_partkey AS INTEGER), CAST(l_suppkey AS INTEGER), l_linenumber], 1,
                    CAST(l_partkey % 3 + 1 AS INTEGER)) AS prompt_ids,
         generate_series(1, CAST(l_quantity AS INTEGER)) AS target_ids
  FROM lineitem),
m AS (
  SELECT ordinal, CAST(floor(ordinal / 8) AS BIGINT) AS batch_id,
         list_concat(prompt_ids, target_ids) AS input_ids,
         list_resize([1], len(prompt_ids) + len(target_ids), 1) AS attention_mask,
         list_concat(list_resize([-100], len(prompt_ids), -100), target_ids) AS labels
  FROM ex),
b AS (SELECT *, max(len(input_ids)) OVER (PARTITION BY batch_id) AS longest FROM m),
c AS (SELECT *, CAST({ml} AS INTEGER) AS max_len FROM b)
SELECT ordinal, batch_id, max_len,
       array_to_string(list_resize(input_ids, max_len, 0), ',') AS input_ids,
       array_to_string(list_resize(attention_mask, max_len, 0), ',') AS attention_mask,
       array_to_string(list_resize(labels, max_len, -100), ',') AS labels
FROM c
"""


SFT_BATCHES = _sft_batches(32)
SFT_BATCHES_UNCAPPED = _sft_batches(None)

SPLIT_ASSIGNMENTS = """
WITH p AS (SELECT o_orderkey AS id, row_number() OVER (ORDER BY o_orderkey) - 1 AS ordinal,
                  count(*) OVER () AS n FROM orders)
SELECT id, ordinal, 'hf_test_' || CAST(ordinal AS VARCHAR) AS test_id,
       ordinal < 100 AS in_head,
       ordinal >= n - (CASE WHEN n > 1 THEN greatest(1, CAST(floor(0.1 * n) AS BIGINT)) ELSE 0 END)
         AS is_val,
       CAST(floor(ordinal / ceil(n / 4)) AS INTEGER) AS shard,
       ordinal >= ceil(n / 4) AND ordinal < ceil(n / 4) + 50 AND ordinal < 2 * ceil(n / 4) AS in_limited_shard,
       CAST(floor(ordinal / 16) AS BIGINT) AS batch_id
FROM p
"""

HASH_SPLIT = """
SELECT o_orderkey AS id,
       CASE WHEN CAST(('0x' || substr(md5(CAST(o_orderkey AS VARCHAR) || '#42'), 1, 8)) AS BIGINT) % 1000000
                 < 100000 THEN 'test' ELSE 'train' END AS split
FROM orders
"""

CONVERSATION_RECORDS = f"""
WITH pairs AS (
  SELECT u.conv_id, u.turn, u.text AS question, a.text AS generated
  FROM conversations u JOIN conversations a
    ON u.conv_id = a.conv_id AND a.turn = u.turn + 1
  WHERE u.role = 'user' AND a.role = 'assistant'),
st AS (
  SELECT conv_id, turn, question, {rationale_expr(trim_ws('generated'))} AS rationale,
         coalesce({x2f('generated')}, '') AS final
  FROM pairs),
out AS (
  SELECT conv_id, turn, rationale,
         '###Input:' || {NL} || question || {NL} || {NL} || '###Output:' || {NL} || rationale
           || {NL} || '#### ' || final AS text,
         {trim_ws('rationale')} || CASE WHEN ends_with(rationale, {NL}) THEN '' ELSE {NL} END
           || {trim_ws('final')} AS target,
         CASE WHEN {trim_ws('rationale')} <> ''
              THEN {trim_ws('rationale')} || {NL} || 'Final answer: ' || {trim_ws('final')}
              ELSE 'Final answer: ' || {trim_ws('final')} END AS target_legacy
  FROM st)
SELECT *, contains(text, '###Input:') AND contains(text, '###Output:') AND contains(text, '#### ')
          AS format_ok
FROM out
"""

SFT_TRIPLES = FIX + f""",
st AS (SELECT c.id, c.cand_idx, p.question, c.text, p.answer,
              {trim_ws("coalesce(c.text, '')")} AS sol
       FROM cand c JOIN prob p ON c.id = p.id)
SELECT id, cand_idx, question, sol AS rationale,
       CASE WHEN {x5('sol')} IS NOT NULL THEN '#### ' || {x5('sol')}
            ELSE {trim_ws("coalesce(answer, '')")} END AS answer,
       coalesce(nullif(text, ''), coalesce(answer, '')) AS legacy_rationale,
       coalesce(answer, '') AS legacy_answer
FROM st
"""

RENDER_PROMPTS = FIX + f"""
SELECT id,
  {render_sql(PR.FORWARD, question='question')} AS forward,
  {render_sql(PR.RATIONALIZE, question='question', gold_final=f"coalesce({x2('answer')}, answer)")} AS rationalize,
  {render_sql(PR.RATIONALIZE, question='question', gold_final='answer')} AS rationalize_full,
  {render_sql(PR.HINT, question='question')} AS hint,
  {render_sql(PR.ZERO_SHOT, q='question')} AS zero_shot,
  {render_sql(PR.VARIANT_1, q='question')} AS variant_1,
  {render_sql(PR.VARIANT_2, q='question')} AS variant_2,
  {render_sql(PR.VARIANT_3, q='question')} AS variant_3,
  {render_sql(PR.SFT_PROMPT, q='question')} AS sft
FROM prob
"""

_PROMPT = render_sql(PR.FORWARD, question="p.question")
PROMPT_ECHO_STRIP = FIX + f""",
e AS (SELECT c.id, c.cand_idx, {_PROMPT} AS prompt,
             CASE WHEN c.cand_idx % 2 = 0 THEN {_PROMPT} || c.text ELSE c.text END AS echoed
      FROM cand c JOIN prob p ON c.id = p.id)
SELECT id, cand_idx,
       {trim_ws("CASE WHEN starts_with(echoed, prompt) THEN substr(echoed, length(prompt) + 1) ELSE echoed END")}
         AS output
FROM e
"""

REGROUP_CANDIDATES = FIX + """
SELECT id, count(*) AS n_candidates, min(cand_idx) AS first_idx, max(cand_idx) AS last_idx,
       arg_min(text, cand_idx) AS first_text, arg_max(text, cand_idx) AS last_text
FROM cand GROUP BY id
"""

def _self_training_loop() -> str:
    """The two-iteration loop of the ``self_training_loop`` query, unrolled: model m's
    evaluation output is candidate 1 of the shift-m set, its retry output the last one."""
    ctes = [FIX, candidates_cte("c1", 1), candidates_cte("c2", 2), """split AS (
  SELECT id, question, answer,
         CAST(('0x' || substr(md5(CAST(id AS VARCHAR) || '#42'), 1, 8)) AS BIGINT) % 1000000 < 100000
           AS is_test
  FROM prob)"""]
    for m, c in enumerate(("cand", "c1", "c2")):
        ctes.append(f"""pred{m} AS (
  SELECT s.id, s.is_test, s.question, s.answer, {m1('s.answer', 'f.text')} AS em
  FROM split s LEFT JOIN (SELECT id, text FROM {c} WHERE cand_idx = 1) f ON s.id = f.id)""")
    for m, c in enumerate(("cand", "c1")):
        ctes.append(f"""miss{m} AS (
  SELECT id, question, answer FROM pred{m}
  WHERE NOT is_test AND NOT coalesce(em, false)
    AND coalesce(question, '') <> '' AND coalesce(answer, '') <> '')""")
        ctes.append(f"""kept{m} AS (
  SELECT mm.id, l.text AS output
  FROM miss{m} mm JOIN (SELECT id, arg_max(text, cand_idx) AS text FROM {c} GROUP BY id) l
    ON mm.id = l.id
  WHERE {m1('mm.answer', 'l.text')})""")
        ctes.append(f"""train{m} AS (SELECT count(*) AS n FROM kept{m} WHERE {x1('output')} IS NOT NULL)""")
    body = """
SELECT 'fixture' AS run, 1 AS iter, 'zero_shot' AS stage, 'em' AS metric,
       round(CAST(avg(CAST(em AS INTEGER)) AS DOUBLE), 8) AS value FROM pred0 WHERE is_test
UNION ALL SELECT 'fixture', 2, 'loop', 'misses', CAST(count(*) AS DOUBLE) FROM miss0
UNION ALL SELECT 'fixture', 2, 'loop', 'generated', CAST(count(*) AS DOUBLE) FROM miss0
UNION ALL SELECT 'fixture', 2, 'loop', 'kept_correct', CAST(count(*) AS DOUBLE) FROM kept0
UNION ALL SELECT 'fixture', 2, 'loop', 'train_size', CAST(n AS DOUBLE) FROM train0
UNION ALL SELECT 'fixture', 2, 'loop', 'em', round(CAST(avg(CAST(em AS INTEGER)) AS DOUBLE), 8) FROM pred1 WHERE is_test
UNION ALL SELECT 'fixture', 3, 'loop', 'misses', CAST(count(*) AS DOUBLE) FROM miss1
UNION ALL SELECT 'fixture', 3, 'loop', 'generated', CAST(count(*) AS DOUBLE) FROM miss1
UNION ALL SELECT 'fixture', 3, 'loop', 'kept_correct', CAST(count(*) AS DOUBLE) FROM kept1
UNION ALL SELECT 'fixture', 3, 'loop', 'train_size', CAST(t0.n + t1.n AS DOUBLE) FROM train0 t0, train1 t1
UNION ALL SELECT 'fixture', 3, 'loop', 'em', round(CAST(avg(CAST(em AS INTEGER)) AS DOUBLE), 8) FROM pred2 WHERE is_test
"""
    return ",\n".join(ctes) + body


SELF_TRAINING_LOOP = _self_training_loop()


def _restarted_loop() -> str:
    """The same loop after a baseline stage, unrolled: model 0 is evaluated, model 1 is the baseline, models 2
    and 3 follow the two iterations; model m is the shift-m candidate set."""
    ctes = [FIX] + [candidates_cte(f"c{m}", m) for m in range(4)] + ["""split AS (
  SELECT id, question, answer,
         CAST(('0x' || substr(md5(CAST(id AS VARCHAR) || '#42'), 1, 8)) AS BIGINT) % 1000000 < 100000 AS is_test
  FROM prob)"""]
    ctes += [f"""pred{m} AS (
  SELECT s.id, s.is_test, s.question, s.answer, {m1('s.answer', 'f.text')} AS em
  FROM split s LEFT JOIN (SELECT id, text FROM c{m} WHERE cand_idx = 1) f ON s.id = f.id)""" for m in range(4)]
    for m in (1, 2):
        ctes.append(f"""miss{m} AS (
  SELECT id, question, answer FROM pred{m} WHERE NOT is_test AND NOT coalesce(em, false)
    AND coalesce(question, '') <> '' AND coalesce(answer, '') <> '')""")
        ctes.append(f"""kept{m} AS (
  SELECT l.text AS output
  FROM miss{m} mm JOIN (SELECT id, arg_max(text, cand_idx) AS text FROM c{m} GROUP BY id) l ON mm.id = l.id
  WHERE {m1('mm.answer', 'l.text')})""")
        ctes.append(f"train{m} AS (SELECT count(*) AS n FROM kept{m} WHERE {x1('output')} IS NOT NULL)")

    def em(it, stage, m):
        return (f"SELECT 'fixture' AS run, {it} AS iter, '{stage}' AS stage, 'em' AS metric, "
                f"round(CAST(avg(CAST(em AS INTEGER)) AS DOUBLE), 8) AS value FROM pred{m} WHERE is_test")

    def number(it, metric, source, n="count(*)"):
        return f"SELECT 'fixture', {it}, 'loop', '{metric}', CAST({n} AS DOUBLE) FROM {source}"

    rows = [em(1, "zero_shot", 0), em(1, "baseline", 1)]
    for it, m, sets, size in ((2, 1, "train1", "train1.n"), (3, 2, "train1, train2", "train1.n + train2.n")):
        rows += [number(it, "misses", f"miss{m}"), number(it, "generated", f"miss{m}"), number(it, "kept_correct", f"kept{m}"),
                 number(it, "train_size", sets, size), em(it, "loop", m + 1)]
    return ",\n".join(ctes) + "\n" + "\nUNION ALL ".join(rows)


RESTARTED_LOOP = _restarted_loop()

def _first_of(names: list[str], empty: bool = True) -> str:
    """``a or b or ...`` of the names (with "" at the end), or the first that is not null."""
    if not empty:
        return f"coalesce({', '.join(names)})"
    return "coalesce(" + ", ".join(f"nullif({n}, '')" for n in names) + ", '')"


def _held(text: str, *when: int) -> str:
    return f"CASE WHEN pick IN ({', '.join(map(str, when))}) THEN {text} WHEN pick = {(when[0] + 1) % 5} THEN '' END"


RESOLVED_FIELDS = f"""
WITH li AS (SELECT *, (l_orderkey + l_partkey) % 5 AS pick, CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) AS n FROM lineitem),
r AS (
  SELECT l_orderkey AS id, l_linenumber AS line, l_partkey AS part, l_suppkey AS supp, {_held('n', 0)} AS gold,
    {_held("'#### ' || n", 1)} AS answer, {_held('n', 2, 3)} AS gold_answer, {_held('n', 3)} AS answer_text,
    CASE WHEN pick = 4 THEN n END AS a_name, {_held("'so ' || n", 1, 2)} AS generated, {_held("'how many'", 2)} AS question,
    {_held("'count'", 4)} AS q_name, {_held("'steps'", 0, 3)} AS solution FROM li),
f AS (
  SELECT id, line, part, supp, {_first_of(['answer', 'gold_answer', 'answer_text', 'a_name'])} AS gold_train,
    {_first_of(['gold', 'answer', 'answer_text'])} AS gold_eval, {_first_of(['gold', 'answer', 'a_name', 'gold_answer'])} AS gold_rescore,
    {_first_of(['answer', 'generated'])} AS pred, {_first_of(['question', 'q_name'])} AS asked, {_first_of(['solution'])} AS rationale,
    {_first_of(['gold_answer', 'answer'])} AS final, {_first_of(['gold', 'answer', 'answer_text'], False)} AS gold_eval_get,
    {_first_of(['question', 'q_name'], False)} AS asked_get FROM r)
SELECT *, '###Input:' || {NL} || asked || {NL} || {NL} || '###Output:' || {NL} || rationale || {NL} || '#### ' || final AS text FROM f
"""

POSITIONAL_CANDIDATES = """
WITH p AS (SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS pos, o_orderkey || ' ' || o_orderpriority AS text FROM orders)
SELECT CAST(floor(pos / 4) AS BIGINT) AS prompt_idx, CAST(pos % 4 + 1 AS INTEGER) AS cand_idx, text FROM p
"""

EVALUATED_ITERATION = FIX + f""",
{candidates_cte('c1', 1)},
test AS (
  SELECT id, answer FROM prob WHERE CAST(('0x' || substr(md5(CAST(id AS VARCHAR) || '#42'), 1, 8)) AS BIGINT) % 1000000 < 100000),
scored AS (
  SELECT CAST({m2('t.answer', 'c.text')} AS INTEGER) AS em
  FROM test t LEFT JOIN (SELECT id, text FROM c1 WHERE cand_idx = 1) c ON c.id = t.id)
SELECT count(*) AS n, CAST(coalesce(sum(em), 0) AS BIGINT) AS correct, round(coalesce(sum(em), 0) / greatest(count(*), 1), 8) AS accuracy
FROM scored
"""

ORACLE = {
    "keep_first_correct": KEEP_FIRST_CORRECT,
    "greedy_accuracy": GREEDY_ACCURACY,
    "missed_problems": MISSED_PROBLEMS,
    "rationalize_missed": RATIONALIZE_MISSED,
    "one_iteration": ONE_ITERATION,
    "merge_last_wins": MERGE_LAST_WINS,
    "retry_keep_correct": RETRY_KEEP_CORRECT,
    "retry_shortest_correct": RETRY_SHORTEST_CORRECT,
    "shortest_vs_first": SHORTEST_VS_FIRST,
    "retry_flag_all": RETRY_FLAG_ALL,
    "train_set_correct_only": TRAIN_SET_CORRECT_ONLY,
    "train_set_keep_all": TRAIN_SET_KEEP_ALL,
    "collect_misses": COLLECT_MISSES,
    "extract_profiles": EXTRACT_PROFILES,
    "em_profiles": EM_PROFILES,
    "answer_shapes": ANSWER_SHAPES,
    "gold_sft_set": GOLD_SFT_SET,
    "step_rollup": STEP_ROLLUP,
    "zero_shot_records": ZERO_SHOT_RECORDS,
    "rescore_accuracy": RESCORE_ACCURACY,
    "rescore_stored_predictions": RESCORE_STORED_PREDICTIONS,
    "resumed_generation": RESUMED_GENERATION,
    "restarted_loop": RESTARTED_LOOP,
    "resolved_fields": RESOLVED_FIELDS,
    "positional_candidates": POSITIONAL_CANDIDATES,
    "evaluated_iteration": EVALUATED_ITERATION,
    "incremental_merge": INCREMENTAL_MERGE,
    "prompt_ablation": PROMPT_ABLATION,
    "ablation_mismatches": ABLATION_MISMATCHES,
    "experiment_comparison": EXPERIMENT_COMPARISON,
    "top_mismatches": TOP_MISMATCHES,
    "mismatch_export": MISMATCH_EXPORT,
    "stage_report": STAGE_REPORT,
    "progress_counters": PROGRESS_COUNTERS,
    "loss_rollup": LOSS_ROLLUP,
    "sft_batches": SFT_BATCHES,
    "sft_batches_uncapped": SFT_BATCHES_UNCAPPED,
    "split_assignments": SPLIT_ASSIGNMENTS,
    "hash_split": HASH_SPLIT,
    "conversation_records": CONVERSATION_RECORDS,
    "sft_triples": SFT_TRIPLES,
    "render_prompts": RENDER_PROMPTS,
    "prompt_echo_strip": PROMPT_ECHO_STRIP,
    "regroup_candidates": REGROUP_CANDIDATES,
    "stream_totals": STREAM_TOTALS,
    "incremental_stream": ONE_ITERATION,
    "jsonl_round_trip": KEEP_FIRST_CORRECT,
    "self_training_loop": SELF_TRAINING_LOOP,
}
