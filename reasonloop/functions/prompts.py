"""Prompt templates (P2) and rendering.

A template is split once on the driver into literal pieces and ``{field}`` slots (Python
``str.format`` syntax, ``{{``/``}}`` escapes), then rendered per row with ``concat`` —
no regex replacement, so ``$`` or backslashes in the data are copied as they are.
"""

from __future__ import annotations

import os
from string import Formatter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Template texts that must equal the workload's prompts.
# ---------------------------------------------------------------------------
FORWARD = (
    "You are a helpful math tutor. Solve the problem step by step, showing clear reasoning.\n"
    "At the end, output only the final numeric answer on a new line as: #### <number>\n"
    "Question:\n"
    "{question}\n"
)
RATIONALIZE = (
    "# Rationalize with hint: show steps that arrive at the given correct final.\n"
    "You are a helpful math tutor. The correct final answer is {gold_final}.\n"
    "Explain step by step how to arrive at that answer for the problem below.\n"
    "Return the same final numeric answer after \"#### \".\n"
    "\n"
    "Q: {question}\n"
    "A:\n"
)
HINT = (
    "You are a careful math tutor. Re-solve the problem step by step and verify each operation.\n"
    "Hint: 1) Identify variables and known quantities 2) Set up the relevant equations 3) Compute carefully\n"
    "4) Check units and parity 5) Recalculate if a step seems inconsistent.\n"
    "At the end, output only the final numeric answer on a new line as: #### <number>\n"
    "Question:\n"
    "{question}\n"
)
ZERO_SHOT = (
    "Q: {q}\n"
    "Let's think step by step.\n"
    "Please give the final answer as '#### <number>' on the last line.\n"
    "A:"
)
# The three ablation variants reach the generator through shell command substitution,
# which drops the trailing newline of each file.
VARIANT_1 = (
    "Q: {q}\n"
    "Let's think step by step.\n"
    "A:"
)
VARIANT_2 = (
    "Q: {q}\n"
    "Let's think step by step.\n"
    "A:\n"
    "(Please finish with a final line starting with \"Final answer:\" followed by the numeric answer.)"
)
VARIANT_3 = (
    "Q: {q}\n"
    "Let's think step by step.\n"
    "A:\n"
    "(Show your steps and then on the last line write EXACTLY: Final answer: <number>)"
)
SFT_PROMPT = "Q: {q}\nA: "
# ---------------------------------------------------------------------------

TEMPLATES: dict[str, str] = {
    "forward": FORWARD,
    "rationalize": RATIONALIZE,
    "hint": HINT,
    "zero_shot": ZERO_SHOT,
    "variant_1": VARIANT_1,
    "variant_2": VARIANT_2,
    "variant_3": VARIANT_3,
    "sft": SFT_PROMPT,
}
VARIANTS = ["variant_1", "variant_2", "variant_3"]


def load_template(path: str | None, fallback: str) -> str:
    """The file's text when the path exists, else the built-in fallback (driver side)."""
    if path and os.path.exists(path):
        with open(path, encoding="utf-8") as f:
            return f.read()
    return fallback


def template_pieces(template: str) -> list[tuple[str, str | None]]:
    """``[(literal, field or None), ...]`` as ``str.format`` reads the template."""
    out = []
    for literal, field, spec, conv in Formatter().parse(template):
        if spec or conv:
            raise ValueError("format specs and conversions are not supported in templates")
        out.append((literal, field))
    return out


def template_fields(template: str) -> set[str]:
    return {f for _, f in template_pieces(template) if f is not None}


def render(template: str, **fields) -> Column:
    """Render a template per row; ``fields`` maps slot names to Columns or names."""
    parts: list[Column] = []
    for literal, field in template_pieces(template):
        if literal:
            parts.append(F.lit(literal))
        if field is not None:
            if field not in fields:
                raise KeyError(f"template slot {{{field}}} has no column")
            v = fields[field]
            parts.append((F.col(v) if isinstance(v, str) else v).cast("string"))
    return F.concat(*parts) if parts else F.lit("")


def explode_variants(df: DataFrame, question_col: str = "question", names: list[str] | None = None,
                     slot: str = "q") -> DataFrame:
    """A6 input: every row once per prompt variant, with ``variant`` and the rendered
    ``prompt``. The variants are an array exploded next to each row (a generator, not a
    join), so the problem table is read once and never shuffled for this."""
    names = names or VARIANTS
    q = F.col(question_col)
    opts = F.array(*[F.struct(F.lit(n).alias("variant"), render(TEMPLATES[n], **{slot: q}).alias("prompt"))
                     for n in names])
    return df.withColumn("__v", F.explode(opts)).select("*", "__v.variant", "__v.prompt").drop("__v")
