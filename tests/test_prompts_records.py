"""Prompt rendering (P1/P2) and record projections."""

import pytest
from pyspark.sql import functions as F

from reasonloop.functions import prompts as PR
from reasonloop.functions import records as RC


def test_render_keeps_special_characters(spark):
    df = spark.createDataFrame([("cost is $5 \\\\ {x}",)], "q string")
    out = df.select(PR.render("A {{lit}} {question}!", question="q").alias("p")).collect()[0].p
    assert out == "A {lit} cost is $5 \\\\ {x}!"
    assert PR.render(PR.FORWARD, question=F.lit("Q1")) is not None
    assert PR.template_fields(PR.RATIONALIZE) == {"question", "gold_final"}
    with pytest.raises(KeyError):
        PR.render(PR.RATIONALIZE, question=F.lit("x"))


def test_forward_template_matches_str_format(spark):
    df = spark.createDataFrame([("How many?",)], "q string")
    for name, tmpl in PR.TEMPLATES.items():
        slot = "q" if "{q}" in tmpl else "question"
        fields = {slot: "q"}
        if "{gold_final}" in tmpl:
            fields["gold_final"] = F.lit("18")
        got = df.select(PR.render(tmpl, **fields).alias("p")).collect()[0].p
        assert got == tmpl.format(**{slot: "How many?", "gold_final": "18"}), name


def test_resolve_field_chains(spark):
    df = spark.createDataFrame([("", "g1", None), (None, None, "a")], "answer string, gold_answer string, A string")
    or_chain = [r[0] for r in df.select(RC.resolve_field(df, RC.GOLD_ALIASES)).collect()]
    get_chain = [r[0] for r in df.select(RC.resolve_field(df, RC.GOLD_ALIASES, skip_empty=False)).collect()]
    assert or_chain == ["g1", "a"] and get_chain == ["", "a"]


def test_records(spark):
    df = spark.createDataFrame([("Q", "line a\nline b\n", "#### 4", "Sol text\n#### 12\n")],
                               "q string, r string, a string, sol string")
    r = df.select(
        RC.class_text(F.col("q"), F.col("r"), F.lit("4")).alias("text"),
        RC.sft_target(F.col("r"), F.col("a"), "reference").alias("ref"),
        RC.sft_target(F.col("r"), F.col("a"), "newline").alias("nl"),
        RC.sft_target(F.lit("  "), F.col("a"), "legacy").alias("legacy"),
        RC.rationale_from_generation(F.col("r")).alias("rat"),
        RC.hint_final(F.col("a")).alias("hint"),
        *[c.alias(n) for c, n in zip(RC.sft_triple(F.col("sol"), F.lit("x")), ("tr", "ta"))],
    ).collect()[0]
    assert r.text == "###Input:\nQ\n\n###Output:\nline a\nline b\n\n#### 4"
    assert r.ref == "line a\nline b#### 4"     # glued: rationale ended with a newline
    assert r.nl == "line a\nline b\n#### 4"
    assert r.legacy == "Final answer: #### 4"
    assert r.rat == "line a" and r.hint == "4"
    assert (r.tr, r.ta) == ("Sol text\n#### 12", "#### 12")


def test_format_gate(spark):
    df = spark.createDataFrame([(1, "###Input:\nq\n\n###Output:\nr\n#### 1"), (2, "plain")], "id int, text string")
    with pytest.raises(ValueError):
        RC.check_training_format(df)
    assert RC.check_training_format(df, quarantine=True).count() == 1


def test_prompt_echo(spark):
    df = spark.createDataFrame([("P: ", "P:  answer "), ("P: ", "other")], "p string, t string")
    assert [r[0] for r in df.select(RC.strip_prompt_echo(F.col("t"), F.col("p"))).collect()] == ["answer", "other"]


def test_rationale_split_uses_python_line_breaks(spark):
    # \x1c-\x1e, \x85,  / , \x0b, \x0c and \r\n all break lines, as str.splitlines does
    text = "a\x1cb\x1dc\x1ed\x85e f g\x0bh\x0ci\r\nj\rk\nlast"
    df = spark.createDataFrame([(text,)], "t string")
    got = df.select(RC.rationale_from_generation(F.col("t"))).collect()[0][0]
    lines = [x.strip() for x in text.splitlines() if x.strip()]
    assert got == "\n".join(lines[:-1])


def test_explode_variants(spark):
    df = spark.createDataFrame([(1, "How many?")], "id int, question string")
    rows = sorted((r.variant, r.prompt) for r in PR.explode_variants(df).collect())
    assert [v for v, _ in rows] == PR.VARIANTS
    assert rows[0][1] == PR.VARIANT_1.format(q="How many?")


def test_class_records_resolve_names(spark):
    df = spark.createDataFrame([("1", "Q1", "", "sol", "7"), ("2", "Q2", "rat", None, "8")],
                               "id string, question string, rationale string, solution string, gold_answer string")
    got = {r.id: r.text for r in RC.class_records(df).collect()}
    assert got["1"] == "###Input:\nQ1\n\n###Output:\nsol\n#### 7"
    assert got["2"] == "###Input:\nQ2\n\n###Output:\nrat\n#### 8"


def test_load_template_file_or_fallback(tmp_path):
    p = tmp_path / "t.txt"
    p.write_text("Q: {question}\n")
    assert PR.load_template(str(p), PR.FORWARD) == "Q: {question}\n"
    assert PR.load_template(str(tmp_path / "absent.txt"), PR.FORWARD) == PR.FORWARD
    assert PR.load_template(None, PR.HINT) == PR.HINT
