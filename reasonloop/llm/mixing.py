"""Mixing sources to target weights with DataFrame operations only.

* *Targets.* Sources in code point order (null last) weigh ``weights``, repeating. Together
  they are to give ``share`` times all tokens; a source gives at most ``cap`` times its own
  size and what it cannot give is dealt to the others by weight. With sources ordered by
  ``cap * size / weight`` that fixed point has a closed form (running sums), no loop.
* *Order.* A row's key is the md5 of its id (without one, of its text), size and ``seed``: random, and
  the same in every run. A source's key range is cut into equal parts of about ``RANGE_ROWS`` rows, so a source
  that holds a third of all rows is spread over many tasks.
* *Prefix sums.* Token sums per range, running sums over the ranges of a source, and running
  sums inside each range give every row the tokens before it in its source.
* *Cut.* Every row is taken ``target div size`` times, and in the last epoch from the first row
  on until exactly the source's budget is reached; the row there is cut inside.

Rows with the same id, source and text are one row with a count while keys and sums are made, so
repeated rows never meet in one window. At the end they are numbered over all tasks by the hash of
the whole row, and each keeps its own other columns. A null text has size 0; sources of size 0 get target 0; an empty table gives no rows.

The per-source table has one row per source and is broadcast only up to ``MOST_SOURCES`` rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ordinal import group_row_number
from ..session import materialize
from .common import WORD, packed

WEIGHTS = (5, 2, 1)
SHARE = 1.5
CAP = 2.0
RANGE_ROWS = 50_000
MOST_SOURCES = 100_000


def word_count(text: Column) -> Column:
    """Words of a text; null counts none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """Adds ``target`` to (source, source_size, rows), one row per source."""
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    w = sources.withColumn("weight", F.element_at(
        F.array(*[F.lit(x) for x in weights]), F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("double"))
    w = w.withColumn("most", F.lit(cap) * F.col("source_size")).withColumn("ratio", F.col("most") / F.col("weight"))
    by_ratio = Window.orderBy("ratio", F.col("source").isNull(), "source")
    given = F.coalesce(F.sum("most").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    open_weight = F.sum("weight").over(by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    total = F.sum("source_size").over(Window.partitionBy())
    # the level rises over the sources that reach their cap and falls after them
    w = w.withColumn("level", (F.lit(share) * total - given) / open_weight)
    level = F.max("level").over(Window.partitionBy())
    return w.withColumn("target", F.least("most", level * F.col("weight"))).drop("most", "ratio", "level", "weight")


def plan_mix(docs: DataFrame, id_col: str, source_col: str, text_col: str, seed: int = 0,
             weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP,
             range_rows: int = RANGE_ROWS) -> DataFrame:
    """One row per distinct (id, source, text hash): ``id, source, th, size, n`` (rows),
    ``source_size, target, epochs`` (whole takes) and ``left`` (tokens of the last epoch's budget
    before the first of the n rows; negative beyond the budget)."""
    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), word_count(text).alias("size"),
                       F.xxhash64(text).alias("th"))
    rows = materialize(rows.groupBy("id", "source", "size", "th").agg(F.count(F.lit(1)).alias("n")), "mix-sizes")
    sources = materialize(targets(rows.groupBy("source").agg(
        F.sum(F.col("size") * F.col("n")).alias("source_size"), F.count(F.lit(1)).alias("rows")),
        weights, share, cap), "mix-sources")
    if sources.count() <= MOST_SOURCES:
        sources = F.broadcast(sources)
    sources = sources.withColumnRenamed("source", "__source")
    # rows without an id are told apart by their text
    key = F.md5(F.concat_ws(":", F.coalesce(F.col("id").cast("string"), F.concat(F.lit("null"), F.col("th").cast("string"))),
                            F.lit(seed), F.col("size").cast("string")).cast("binary"))
    dealt = (rows.join(sources, F.col("source").eqNullSafe(F.col("__source"))).drop("__source")
             .withColumn("key", key)
             .withColumn("range", F.floor(F.conv(F.substring("key", 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))
                                          * F.ceil(F.col("rows") / F.lit(range_rows)))))
    dealt = dealt.repartition("source", "range")
    sums = dealt.groupBy("source", "range").agg(F.sum(F.col("size") * F.col("n")).alias("tokens"))
    before_range = sums.select(
        F.col("source").alias("__s"), F.col("range").alias("__r"),
        F.coalesce(F.sum("tokens").over(Window.partitionBy("source").orderBy("range")
                                        .rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    inside = (Window.partitionBy("source", "range").orderBy("key", "id", "size", "th")
              .rowsBetween(Window.unboundedPreceding, -1))
    dealt = dealt.withColumn("__in", F.coalesce(F.sum(F.col("size") * F.col("n")).over(inside), F.lit(0)))
    dealt = dealt.join(before_range, F.col("source").eqNullSafe(F.col("__s")) & (F.col("range") == F.col("__r")))
    goal = F.floor("target").cast("long")
    epochs = F.when(F.col("source_size") > 0, F.floor(goal / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    return (dealt.withColumn("epochs", epochs)
            .select("id", "source", "th", "size", "n", "source_size", "target", "epochs",
                    (goal - F.col("epochs") * F.col("source_size") - F.col("__before") - F.col("__in")).alias("left")))


def _part(nth: Column) -> Column:
    """Tokens that the nth of the equal rows gives in the last, partial epoch."""
    return F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), F.col("left") - nth * F.col("size")))


def mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", **how) -> DataFrame:
    """One row per input row: id, ``size``, ``source_size``, ``target`` and ``taken`` (tokens)."""
    plan = plan_mix(docs, id_col, source_col, text_col, **how)
    each = plan.withColumn("__nth", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    return each.select(F.col("id").alias(id_col), "size", "source_size", "target",
                       (F.col("epochs") * F.col("size") + _part(F.col("__nth"))).alias("taken"))


def mixed_rows(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", **how) -> DataFrame:
    """The mix itself: each row of ``docs`` once per epoch that takes it, with all its columns,
    ``epoch`` (from 0) and ``taken_words`` (in place of columns of ``docs`` so named); the text of a
    source's last row is cut at the budget."""
    plan = plan_mix(docs, id_col, source_col, text_col, **how)
    plan = materialize(plan.select(F.col("id").alias("__id"), F.col("source").alias("__source"), "th", "size", "n", "epochs", "left"),
                       "mix-plan")
    names = [c for c in docs.columns if c.lower() not in ("epoch", "taken_words")]
    row = F.col("row")
    text = row.getField(text_col).cast("string")

    def joined(plan: DataFrame) -> DataFrame:
        return packed(docs).join(plan, row.getField(id_col).eqNullSafe(F.col("__id"))
                                 & row.getField(source_col).eqNullSafe(F.col("__source")) & (F.xxhash64(text) == F.col("th")))

    one, repeated = plan.where("n = 1"), plan.where("n > 1")
    out = joined(one).withColumn("__nth", F.lit(0).cast("long"))
    if not repeated.isEmpty():
        numbered = group_row_number(joined(repeated), ["__id", "__source", "th"], [], "__nth", base=0, ranges=True)
        out = out.unionByName(numbered.withColumn("__nth", F.col("__nth").cast("long")))
    out = out.withColumn("__part", _part(F.col("__nth")))
    out = (out.withColumn("__times", F.col("epochs") + F.when(F.col("__part") > 0, 1).otherwise(0))
           .where("__times > 0").withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__times") - 1)))
           .withColumn("taken_words", F.when(F.col("epoch") < F.col("epochs"), F.col("size")).otherwise(F.col("__part"))))
    cut = F.when(F.col("taken_words") < F.col("size"), F.array_join(
        F.slice(F.split(F.ltrim(text), r"(?<=[\x20\x09-\x0D])(?=[^\x20\x09-\x0D])"), F.lit(1),
                F.col("taken_words").cast("int")), "")).otherwise(text)
    return out.select(*[(cut if c == text_col else row.getField(c)).alias(c) for c in names], "epoch", "taken_words")
