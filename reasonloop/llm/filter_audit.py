"""Filter interaction audit: what every filter removes in every order of the filters.

1. *Flags.* One pass over the texts writes a narrow row each: source, id, the mask of the text
   filters that it fails, and the SHA-256 of its whole text.
2. *Counting-Bloom prepass* for the duplicate filter. A text hashes to one bucket of ``CELLS``
   counters and to ``HASHES`` counters in it. Tasks count their own rows, the sums of these
   sketches are merged by (bucket, counter), and counters of two or more are kept as one bitmap per
   bucket. A text with a counter of its own cannot occur twice and is cleared. The sketch has about
   ``CELLS_PER_ROW`` counters a row and never more than ``MOST_BUCKETS`` buckets of 4 KB, which is
   the bound of its broadcast; beyond it more texts are sent on as possible repeats, with the
   same result.
3. *Exact ids.* Only possible repeats are shuffled, by the digest of the full text, for the
   smallest id of each text. Rows are matched by (digest, id), so the copies of one text are
   spread over tasks by their ids.
4. *Mask counts.* Rows become counts per (part, mask) with those labelled good and toxic. Counts
   are additive: ``left[S]``, the rows that fail no filter of the set S, is a sum over masks, and
   every figure of every order is a difference of such sums. No order is run over rows.

A null text is empty; a null source is the part ``''``. A null id equals no smaller id and has no
label, so such a row never fails the duplicate filter; rows of one text that tie on its smallest id
all pass it. An id labelled more than once is good (toxic) if any of its labels says so. An empty
table gives no rows.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .common import WORD

CELLS = 1 << 15
CELLS_PER_ROW = 16
HASHES = 4
MOST_BUCKETS = 1 << 16
DUPLICATE = "E"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

#: letter -> failure condition of (text, its words); the duplicate filter is found apart
FILTERS = {
    "A": lambda text, words: F.size(words) < 50,
    "B": lambda text, words: 100 * F.size(F.array_distinct(words)) < 65 * F.size(words),
    "C": lambda text, words: 100 * (F.length(text) - F.length(F.translate(text, _UPPER, ""))) > 5 * F.length(text),
    "D": lambda text, words: text.rlike("[#$%&*|]"),
}


def flags(docs: DataFrame, id_col: str, text_col: str, source_col: str, filters=FILTERS) -> DataFrame:
    """(part, id, mask, digest) of every row; bit i of ``mask`` is the i-th filter."""
    src = docs.select(F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("part"), F.col(id_col).alias("id"),
                      F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    src = src.withColumn("words", F.regexp_extract_all("text", F.lit(WORD), F.lit(0)))
    mask = F.lit(0)
    for i, fails in enumerate(filters.values()):
        mask = mask + F.when(fails(F.col("text"), F.col("words")), 1 << i).otherwise(0)
    return src.select("part", "id", mask.alias("mask"), F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("digest"))


def _placed(rows: DataFrame, buckets: int) -> DataFrame:
    """Adds ``bucket`` and ``cells`` (distinct counters of the row's text in it)."""
    h = F.xxhash64("digest")
    spread = F.xxhash64("digest", F.lit(1))
    cells = [F.shiftrightunsigned(spread, 15 * i).bitwiseAND(F.lit(CELLS - 1)).cast("int") for i in range(HASHES)]
    return rows.withColumn("bucket", F.pmod(h, F.lit(buckets)).cast("int")).withColumn("cells", F.array_distinct(F.array(*cells)))


def repeat_sketch(rows: DataFrame, buckets: int) -> DataFrame:
    """(bucket, bits): the counters that two or more rows share."""
    counted = (_placed(rows, buckets).select("bucket", F.explode("cells").alias("cell"))
               .groupBy("bucket", "cell").agg(F.count(F.lit(1)).alias("n")))
    return (counted.where("n > 1").groupBy("bucket")
            .agg(F.bitmap_construct_agg(F.col("cell").cast("long")).alias("bits")))


def sketch_buckets(rows: int, cells_per_row: int = CELLS_PER_ROW, most: int = MOST_BUCKETS) -> int:
    return max(1, min(most, -(-rows * cells_per_row // CELLS)))


def possible_repeats(rows: DataFrame, sketch: DataFrame, buckets: int) -> DataFrame:
    """Adds ``maybe``: false where the sketch proves that the row's text occurs once."""
    def shared(cell: Column) -> Column:
        byte = F.conv(F.hex(F.substring("bits", F.floor(cell / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
        return F.expr("1") == F.pmod(F.floor(byte / F.pow(F.lit(2), cell % 8)), F.lit(2))

    probed = _placed(rows, buckets).join(F.broadcast(sketch), "bucket", "left")
    return probed.withColumn("maybe", F.col("bits").isNotNull() & F.forall("cells", shared)).drop("bucket", "cells", "bits")


def with_duplicates(rows: DataFrame, bit: int, most_buckets: int = MOST_BUCKETS) -> DataFrame:
    """(part, id, mask, n): equal rows counted, ``bit`` set where a smaller id has the same text."""
    buckets = sketch_buckets(rows.count(), most=most_buckets)
    sketch = materialize(repeat_sketch(rows, buckets), "audit-sketch")
    probed = materialize(possible_repeats(rows, sketch, buckets).withColumn(
        "maybe", F.col("maybe") & F.col("id").isNotNull()), "audit-probed")
    keys = ["part", "id", "mask"]
    cleared = probed.where("not maybe").groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    again = probed.where("maybe")
    first = again.groupBy("digest").agg(F.min("id").alias("id")).withColumn("first", F.lit(True))
    tested = (again.groupBy("digest", *keys).agg(F.count(F.lit(1)).alias("n")).join(first, ["digest", "id"], "left")
              .select("part", "id", F.when(F.col("first"), F.col("mask")).otherwise(F.col("mask") + bit).alias("mask"), "n"))
    return cleared.unionByName(tested)


def mask_counts(rows: DataFrame, labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(part, mask, n, good, toxic) from (part, id, mask, n); rows without an id skip the join."""
    said = (labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id"))
            .agg(F.max(F.coalesce((F.col("quality") == 1).cast("int"), F.lit(0))).alias("good"),
                 F.max(F.coalesce((F.col("toxic") == 1).cast("int"), F.lit(0))).alias("toxic")))
    named = rows.where("id is not null").join(said, "id", "left")
    none = F.lit(None).cast("int")
    every = named.unionByName(rows.where("id is null").withColumn("good", none).withColumn("toxic", none))
    weight = lambda c: F.coalesce(F.sum(F.col(c) * F.col("n")), F.lit(0)).cast("long").alias(c)
    return every.groupBy("part", "mask").agg(F.sum("n").alias("n"), weight("good"), weight("toxic"))


def order_figures(counts: DataFrame, letters: str) -> DataFrame:
    """One row per (part, order of ``letters``, step) from the additive mask counts."""
    sets = 1 << len(letters)
    orders = ["".join(p) for p in permutations(letters)]
    per_part = counts.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("m"))

    def total(value, keep=lambda x: F.lit(True)) -> Column:
        return F.aggregate("m", F.lit(0).cast("long"), lambda a, x: a + F.when(keep(x), value(x)).otherwise(F.lit(0).cast("long")))

    def left(name: str) -> Column:
        return F.transform(F.sequence(F.lit(0), F.lit(sets - 1)),
                           lambda s: total(lambda x: x[name], lambda x: x["mask"].bitwiseAND(s) == 0)).alias(f"left_{name}")

    def per_filter(value, keep) -> Column:
        return F.transform(F.sequence(F.lit(0), F.lit(len(letters) - 1)),
                           lambda i: total(value, lambda x: keep(x["mask"], F.pow(F.lit(2), i).cast("int"))))

    # among the filters that a row fails, each comes first in the same number of orders
    share = lambda x: x["n"] * (F.lit(len(orders)) / F.bit_count(x["mask"])).cast("long")
    sums = per_part.select(
        "part", left("n"), left("good"), left("toxic"),
        per_filter(lambda x: x["n"], lambda mask, bit: mask == bit).alias("only"),
        per_filter(share, lambda mask, bit: mask.bitwiseAND(bit) != 0).alias("shapley"))
    place = lambda c: F.position(c, F.lit(letters)) - 1
    steps = (sums.withColumn("filter_order", F.explode(F.array(*[F.lit(o) for o in orders])))
             .withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(letters)))))
             .withColumn("i", place(F.substring("filter_order", F.col("step"), F.lit(1))))
             .withColumn("bit", F.pow(F.lit(2), F.col("i")).cast("int"))
             .withColumn("before", F.aggregate(
                 F.filter(F.split("filter_order", ""), lambda c: F.position(c, F.col("filter_order")) < F.col("step")),
                 F.lit(0), lambda a, c: a + F.when(c == "", 0).otherwise(F.pow(F.lit(2), place(c)).cast("int")))))

    def at(name: str, mask: Column) -> Column:
        return F.element_at(name, mask + 1)

    before, after, alone = F.col("before"), F.col("before") + F.col("bit"), F.col("bit")
    removed = at("left_n", before) - at("left_n", after)
    return steps.select(
        "part", "filter_order", "step", at("left_n", after).alias("kept"), removed.alias("removed"),
        (at("left_n", F.lit(0)) - at("left_n", alone) - removed).alias("redundant"),
        F.element_at("only", F.col("i") + 1).alias("unique_fails"),
        (at("left_good", before) - at("left_good", after)).alias("good_lost"),
        (at("left_toxic", before) - at("left_toxic", after)).alias("toxic_lost"),
        F.element_at("shapley", F.col("i") + 1).alias("shapley"))


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
          filters=FILTERS, duplicate: str = DUPLICATE, most_buckets: int = MOST_BUCKETS) -> DataFrame:
    """Per part, order of the filters and step: rows ``kept`` after it, ``removed`` by it, ``redundant``
    (fail it, removed before), ``unique_fails`` (fail it alone), ``good_lost`` and ``toxic_lost`` (removed by it
    and so labelled) and ``shapley`` (its removals summed over all orders)."""
    letters = "".join(filters) + duplicate
    rows = materialize(flags(docs, id_col, text_col, source_col, filters), "audit-flags")
    counts = mask_counts(with_duplicates(rows, 1 << len(filters), most_buckets), labels, id_col)
    return order_figures(counts, letters)
