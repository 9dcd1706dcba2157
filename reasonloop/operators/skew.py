"""Equi-join of rows that carry a position inside their key, spread by blocks of positions.

Many-to-one joins (every candidate with its problem's gold key) put all rows of one key
into one task. Here a row's sub-key is the block of its position inside the key
(``cand_idx div block``): a key with a third of all rows gets as many sub-keys as it has
blocks, any other key gets one. The other side's row is repeated once per block that
occurs, so every row meets it under its own sub-key. Nothing is
sampled or drawn at random, and a task run again sends every row the same way.

``fact`` is read twice (once for its lowest and highest block, from the position alone; if they differ again for its
distinct ``(key, block)`` pairs, which are reduced map-side), so it should be a stored table or cheap to scan. Where all
positions lie in one block no key has rows to spread, and the join is the plain one: neither the pairs nor
the repeated other side are shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: rows of one key that may meet in one task
BLOCK_ROWS = 100_000
BLOCK_CONF = "spark.reasonloop.blockRows"   # session setting that overrides the default


def block_rows(spark: SparkSession) -> int:
    return int(spark.conf.get(BLOCK_CONF, str(BLOCK_ROWS)))


def block_of(position: str | Column, block: int) -> Column:
    p = F.col(position) if isinstance(position, str) else position
    return F.coalesce(F.floor(p / F.lit(block)).cast("bigint"), F.lit(0).cast("bigint"))


def block_join(fact: DataFrame, dim: DataFrame, key: str, position: str | Column = "cand_idx",
               how: str = "inner", block: int | None = None, highest: int | None = None) -> DataFrame:
    """``fact.join(dim, key, how)`` with each key's rows spread by blocks of ``position``
    (``how`` is ``inner`` or ``left``; ``dim`` holds at most one row per key). A NULL position
    counts as block 0. ``highest``: no position is higher (positions begin at 0 or 1); if that is less than a block,
    ``fact`` is not read for it."""
    if block is None:
        block = block_rows(fact.sparkSession)
    if highest is not None and highest < block:
        return fact.join(dim, key, how)
    f = fact.withColumn("__block", block_of(position, block))
    low, high = f.agg(F.min("__block"), F.max("__block")).first()
    if low == high:
        return fact.join(dim, key, how)
    blocks = f.select(key, "__block").distinct()
    return f.join(blocks.join(dim, key), [key, "__block"], how).drop("__block")
