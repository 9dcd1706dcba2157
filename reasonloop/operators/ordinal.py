"""Dense row ordinals without a single-task window.

``row_number() over (order by k)`` with no partition runs in one task. Here the frame is
range-sorted across all partitions, each row gets its index inside its partition from
``monotonically_increasing_id`` (partition index in the upper bits), and a prefix sum of
the per-partition counts is added back. The prefix table has one row per partition,
so its broadcast is bounded by the partition count, not by the data.

The tagged frame is checkpointed (reliably, into ``spark.checkpoint.dir``) before it is
used twice: the count branch and the main branch would otherwise be planned as two
separate exchanges, and adaptive execution may coalesce them differently, so partition
indexes would not agree between them. The checkpoint also cuts the lineage, so a lost
executor re-reads the checkpoint instead of re-running the sort.

Where the source's own order is wanted, ``with_file_ordinal`` and ``with_split_ordinal`` take it from
the files and neither sort nor exchange rows.

``group_row_number`` numbers rows inside groups, large ones the same way: a position inside (range, group)
plus the group's rows in earlier ranges, so a hot group is spread over range partitions instead
of one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir, materialize
from .skew import block_rows

_LOW_BITS = (1 << 33) - 1


def _sort_cols(cols: Sequence[str | Column]) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in cols]


def _row_hash(df: DataFrame, seed: int = 17) -> Column:
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    return F.xxhash64(*[F.col(f"`{c}`") for c, k in kinds.items() if "map<" not in k and "variant" not in k], F.lit(seed))


def with_ordinal(df: DataFrame, order_by: Sequence[str | Column], name: str = "ordinal",
                 num_partitions: int | None = None) -> DataFrame:
    """Add a dense 0-based ``name`` column following ``order_by`` (ties broken arbitrarily).

    A hash of the row is the last sort key, so even a key value shared by a third of the
    rows is cut across several range partitions instead of landing in one."""
    keys = _sort_cols(order_by) + [F.col("__tie")]
    # the row's hash comes first, so rows that differ go the same way in every run of a task;
    # the running id only spreads exactly equal rows
    d = df.withColumn("__tie", F.struct(_row_hash(df).alias("h"), F.monotonically_increasing_id().alias("i")))
    sorted_df = (d.repartitionByRange(num_partitions, *keys) if num_partitions
                 else d.repartitionByRange(*keys)).sortWithinPartitions(*keys)
    ensure_checkpoint_dir(df.sparkSession)
    tagged = (sorted_df.withColumn("__mid", F.monotonically_increasing_id())
              .checkpoint(eager=True)
              .withColumn("__pid", F.shiftright(F.col("__mid"), 33))
              .withColumn("__local", F.col("__mid").bitwiseAND(F.lit(_LOW_BITS))))
    counts = tagged.groupBy("__pid").agg((F.max("__local") + 1).alias("__n"))
    # One row per partition: the running total is a tiny single-partition window.
    offsets = counts.select(
        "__pid",
        F.coalesce(F.sum("__n").over(Window.orderBy("__pid").rowsBetween(
            Window.unboundedPreceding, -1)), F.lit(0)).alias("__off"))
    return (tagged.join(F.broadcast(offsets), "__pid")
            .withColumn(name, F.col("__off") + F.col("__local"))
            .drop("__mid", "__pid", "__local", "__off", "__tie"))


def with_file_ordinal(df: DataFrame, name: str = "ordinal") -> DataFrame:
    """Add a dense 0-based ``name`` column in source order: files by path, rows as they stand in a file.

    ``df`` is a scan of Parquet files (``spark.read.parquet``), which know each row's index in its file. Only
    one count per file is aggregated and summed over the files before it; rows are neither
    sorted nor exchanged. The table of offsets has one row per file, like the file listing that the
    driver holds for the scan, and is broadcast."""
    tagged = df.select("*", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias("__index"))
    files = tagged.groupBy("__file").agg(F.count(F.lit(1)).alias("__n"))
    return _after_earlier(tagged, files, ["__file"], F.col("__index"), name).select(*df.columns, name)


def with_split_ordinal(df: DataFrame, name: str = "ordinal") -> DataFrame:
    """:func:`with_file_ordinal` for sources whose rows have no index (JSON lines, text, CSV): a row's place is that
    of its file, its split of the file and its position among the split's rows. ``df`` is the scan itself, and
    every scan of it cuts the files alike."""
    m = F.col("_metadata")
    tagged = df.select("*", m["file_path"].alias("__file"), m["file_block_start"].alias("__split"),
                       F.monotonically_increasing_id().alias("__mid"))
    splits = tagged.groupBy("__file", "__split").agg(F.count(F.lit(1)).alias("__n"), F.min("__mid").alias("__first"))
    return _after_earlier(tagged, splits, ["__file", "__split"], F.col("__mid") - F.col("__first"), name).select(*df.columns, name)


def _after_earlier(tagged: DataFrame, counts: DataFrame, keys: list[str], place: Column, name: str) -> DataFrame:
    """``name`` = rows of the units (``keys``) before a row's own, and its ``place`` there."""
    up = Window.orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("__off", F.coalesce(F.sum("__n").over(up), F.lit(0)))
    return tagged.join(F.broadcast(offsets), keys).withColumn(name, F.col("__off") + place)


def largest_group(df: DataFrame, group_by: Sequence[str]) -> int:
    """Rows of the largest group (0 without rows), from the keys alone."""
    return df.groupBy(*group_by).agg(F.count(F.lit(1)).alias("__n")).agg(F.max("__n")).first()[0] or 0


def group_row_number(df: DataFrame, group_by: Sequence[str], order_by: Sequence[str | Column],
                     name: str = "rn", base: int = 1, ranges: bool = False, largest: int | None = None) -> DataFrame:
    """``row_number() over (partition by group_by order by order_by)`` (``base``-based)
    that never pushes a whole group through one task.

    If no group has more than a block of rows (``skew.BLOCK_ROWS``; the counts are aggregated from the keys
    alone, unless the caller knows the ``largest``)
    one window numbers them all, unless ``ranges`` asks for the other way (rows with long texts). Otherwise the frame is cut into ranges of (group, order, row hash) and written once. Rows are
    numbered by a window over (range, group), which holds at most one range, and a group
    that goes on from earlier ranges adds its rows there. Only the first group of a range
    can go on from an earlier one, so these additions are at most one row per range and
    their broadcast is bounded by the partition count, whatever the data's size."""
    keys = list(group_by)
    order = _sort_cols(order_by)
    most = block_rows(df.sparkSession)
    if not ranges and (largest_group(df, keys) if largest is None else largest) <= most:
        # rows that the hash does not part are equal, so either order gives the same rows
        window = Window.partitionBy(*keys).orderBy(*order, _row_hash(df))
        return df.withColumn(name, (F.row_number().over(window) + (base - 1)).cast("int"))
    cut = (df.withColumn("__tie", F.struct(_row_hash(df).alias("h"), F.monotonically_increasing_id().alias("i")))
           .repartitionByRange(*[F.col(k) for k in keys], *order, F.col("__tie"))
           .withColumn("__pid", F.spark_partition_id()))
    cut = materialize(cut, "ranges")
    counts = cut.groupBy("__pid", *keys).agg(F.count(F.lit(1)).alias("__n"))
    # one row per range that a group touches: the window holds at most one row per range
    before = counts.withColumn("__before", F.sum("__n").over(
        Window.partitionBy(*keys).orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)))
    carried = before.filter(F.col("__before") > 0).select(
        F.col("__pid").alias("__cpid"), *[F.col(k).alias(f"__c{i}") for i, k in enumerate(keys)], "__before")
    same = F.col("__pid") == F.col("__cpid")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"__c{i}"))
    window = Window.partitionBy("__pid", *keys).orderBy(*order, F.col("__tie"))
    numbered = cut.withColumn("__in", F.row_number().over(window))
    return (numbered.join(F.broadcast(carried), same, "left")
            .withColumn(name, (F.coalesce("__before", F.lit(0)) + F.col("__in") + (base - 1)).cast("int"))
            .select(*df.columns, name))
