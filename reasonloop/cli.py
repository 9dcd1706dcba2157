"""Command line for the model-free data tasks, over JSON-lines files.

    python -m reasonloop rescore preds.jsonl [--profile cascade_last] [--top 20] [--save-mismatches DIR]
    python -m reasonloop compare Label:preds.jsonl [Label2:preds2.jsonl ...]
    python -m reasonloop build --forward fw.jsonl --rationalized rt.jsonl --out DIR
    python -m reasonloop check-format train.jsonl [--quarantine DIR]

Every command is a Spark job (files are read with explicit schemas in FAILFAST mode);
only the printed summaries and the first ``--top`` mismatches reach the driver.
"""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import answers as A
from .functions import records as RC
from .operators import report as R
from .operators import selection as S
from .operators.ordinal import with_ordinal
from .sources import jsonl as J
from .sources import schemas

PREDICTION_FIELDS = ("id string, question string, generated string, rationale string, answer string, "
                     "gold string, gold_answer string, final_answer string, answer_text string, A string, "
                     "em string, output string")


def _em_value(c):
    """``em`` stored as 0/1, true/false or null -> 1 / 0 / NULL."""
    t = F.lower(F.trim(c.cast("string")))
    return F.when(t.isin("1", "true"), F.lit(1)).when(t.isin("0", "false"), F.lit(0))


def _read_ordered(spark: SparkSession, path: str, schema, missing_ok: bool = False) -> DataFrame:
    """The rows with their ``ordinal`` in file order: by file path, offset of the split in the file and
    position in the split (the reader keeps a split's lines in order; splits are scheduled by size)."""
    df = J.read_jsonl(spark, path, schema, missing_ok=missing_ok)
    names = df.columns
    if not df.inputFiles():
        return df.withColumn("ordinal", F.lit(None).cast("bigint"))
    placed = df.select(*names, F.col("_metadata.file_path").alias("__file"),
                       F.col("_metadata.file_block_start").alias("__start"),
                       F.monotonically_increasing_id().alias("__at"))
    return with_ordinal(placed, ["__file", "__start", "__at"]).select(*names, "ordinal")


def rescore(spark: SparkSession, path: str, profile: str = "cascade_last") -> DataFrame:
    """Re-extract and re-score stored predictions: gold through the ``gold, answer,
    final_answer, answer_text`` chain (``gold, answer, A, gold_answer`` for
    ``cascade_first``), prediction through ``answer, generated, final_answer`` (``generated``
    for ``cascade_first``); em NULL without a gold under ``cascade_last``."""
    df = _read_ordered(spark, path, PREDICTION_FIELDS)
    if profile == "cascade_first":
        gold = RC.resolve_field(df, RC.GOLD_ALIASES_RESCORE)
        pred = RC.resolve_field(df, ["generated"])
    else:
        gold = RC.resolve_field(df, RC.GOLD_ALIASES_EVAL)
        pred = RC.resolve_field(df, RC.PRED_ALIASES)
    d = df.select("ordinal", "id", "question", gold.alias("gold_raw"), pred.alias("pred_raw"))
    ext = "cascade_first" if profile == "cascade_first" else "cascade_last"
    d = A.with_extracted(d, ext, "gold_raw", "gold_extracted")
    d = A.with_extracted(d, ext, "pred_raw", "pred_extracted")
    if profile == "cascade_first":
        d = A.with_em(d, "cascade_first", "gold_raw", "pred_raw", "em")
    else:
        norm = "integral"
        d = A.with_normalized(d, norm, "gold_extracted", "__gn")
        d = A.with_normalized(d, norm, "pred_extracted", "__pn")
        d = d.withColumn("em", F.when(F.col("gold_raw") == "", F.lit(None).cast("int"))
                         .otherwise((F.col("__gn") == F.col("__pn")).cast("int"))).drop("__gn", "__pn")
    return d


def compare(spark: SparkSession, specs: list[str]) -> DataFrame:
    runs, paths = {}, {}
    for spec in specs:
        if ":" not in spec:
            raise SystemExit(f"bad experiment spec {spec!r}; use Label:path.jsonl")
        label, path = spec.split(":", 1)
        paths[label.strip()] = path.strip()
        df = J.read_jsonl(spark, path.strip(), PREDICTION_FIELDS)
        runs[label.strip()] = df.select(_em_value(F.col("em")).alias("em"),
                                        RC.resolve_field(df, ["generated"]).alias("generated"))
    path_col = F.coalesce(*[F.when(F.col("label") == k, F.lit(v)) for k, v in paths.items()])
    return (R.compare_experiments(runs).withColumn("accuracy", F.round("accuracy", 6))
            .withColumn("path", path_col))


def build(spark: SparkSession, forward: str, rationalized: str) -> DataFrame:
    fw = _read_ordered(spark, forward, schemas.KEPT_RATIONALE)
    rt = _read_ordered(spark, rationalized, schemas.KEPT_RATIONALE, missing_ok=True)
    merged = S.merge_last_wins([fw, rt], order_col="ordinal")
    return merged.select("id", RC.class_text(F.col("question"), F.col("rationale"),
                                             F.col("final")).alias("text"), "pos")


def main(argv: list[str] | None = None) -> int:
    ap = argparse.ArgumentParser(prog="reasonloop")
    sub = ap.add_subparsers(dest="cmd", required=True)
    p = sub.add_parser("rescore")
    p.add_argument("path")
    p.add_argument("--profile", default="cascade_last", choices=["cascade_last", "cascade_first"])
    p.add_argument("--top", type=int, default=20)
    p.add_argument("--save-mismatches")
    p = sub.add_parser("compare")
    p.add_argument("specs", nargs="+")
    p = sub.add_parser("build")
    p.add_argument("--forward", required=True)
    p.add_argument("--rationalized", required=True)
    p.add_argument("--out", required=True)
    p = sub.add_parser("check-format")
    p.add_argument("path")
    p.add_argument("--quarantine")
    ap.add_argument("--master", default=None)
    args = ap.parse_args(argv)

    from .session import get_spark
    spark = get_spark(args.master)
    if args.cmd == "rescore":
        scored = rescore(spark, args.path, args.profile)
        agg = R.em_accuracy_gold_only(scored).collect()[0]
        print(json.dumps({"total": agg.total, "with_gold": agg.n_gold, "correct": agg.correct,
                          "em": agg.accuracy}))
        for r in R.top_mismatches(scored, args.top).collect():
            print(json.dumps({"id": r.id, "gold_extracted": r.gold_extracted,
                              "pred_extracted": r.pred_extracted}, ensure_ascii=False))
        if args.save_mismatches:
            J.write_jsonl(R.mismatch_export(scored).drop("ordinal"), args.save_mismatches)
    elif args.cmd == "compare":
        for r in compare(spark, args.specs).orderBy("label").collect():
            print(json.dumps(r.asDict()))
    elif args.cmd == "build":
        out = build(spark, args.forward, args.rationalized)
        J.write_jsonl(out.orderBy("pos").select("id", "text"), args.out)
        print(json.dumps({"written": spark.read.json(args.out).count(), "out": args.out}))
    elif args.cmd == "check-format":
        df = J.read_jsonl(spark, args.path, schemas.SFT_TEXT)
        if args.quarantine:
            bad = df.filter(~RC.format_ok(F.col("text")))
            J.write_jsonl(bad, args.quarantine)
            print(json.dumps({"bad": spark.read.json(args.quarantine).count()}))
        else:
            RC.check_training_format(df)
            print(json.dumps({"ok": df.count()}))
    return 0


if __name__ == "__main__":
    sys.exit(main())
