"""Ordinal-based ids and splits.

Row order is carried explicitly as an ``ordinal`` column (0-based); when the source has
none, :func:`reasonloop.operators.ordinal.with_ordinal` derives it from a sort key
without a single-task window. Every split is then a narrow filter or projection; the
only global facts needed are the row count (one aggregate action) for S7 and S9.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ordinal_ids(df: DataFrame, prefix: str, ordinal_col: str = "ordinal",
                limit: int | None = None, id_col: str = "id") -> DataFrame:
    """``id = prefix || ordinal`` (e.g. ``train_7``, ``hf_test_7``); optional limit."""
    out = df.withColumn(id_col, F.concat(F.lit(prefix), F.col(ordinal_col).cast("string")))
    return head(out, limit, ordinal_col) if limit else out


def head(df: DataFrame, n: int | None, ordinal_col: str = "ordinal") -> DataFrame:
    """The first n rows (``n`` 0 or None keeps all)."""
    return df if not n else df.filter(F.col(ordinal_col) < n)


def holdout_size(n: int) -> int:
    """S7 rule: ``max(1, int(0.1 * n))`` when n > 1, else 0."""
    return max(1, int(0.1 * n)) if n > 1 else 0


def tail_holdout(df: DataFrame, ordinal_col: str = "ordinal",
                 n: int | None = None) -> tuple[DataFrame, DataFrame]:
    """The last ``holdout_size(n)`` rows are validation, the rest training."""
    n = df.count() if n is None else n
    cut = n - holdout_size(n)
    o = F.col(ordinal_col)
    return df.filter(o < cut), df.filter(o >= cut)


def hash_bucket(key: Column, seed: int, buckets: int = 1_000_000) -> Column:
    """A seeded bucket in ``[0, buckets)``: the first 32 bits of ``md5(key || '#' || seed)``.
    A portable hash (any engine with md5 computes the same split) that depends on the key
    only, so the split is the same under any partitioning or re-run."""
    h = F.md5(F.concat(key.cast("string"), F.lit(f"#{seed}")))
    return F.pmod(F.conv(F.substring(h, 1, 8), 16, 10).cast("bigint"), F.lit(buckets))


def hash_split(df: DataFrame, test_fraction: float, seed: int = 42, key_col: str = "id") -> tuple[DataFrame, DataFrame]:
    """Seeded split by a hash of the key — stable under repartitioning and re-runs
    (same intent as a seeded shuffle split; not the same rows)."""
    is_test = hash_bucket(F.col(key_col), seed) < F.lit(int(round(test_fraction * 1_000_000)))
    return df.filter(~is_test), df.filter(is_test)


def shard_size(n: int, k: int) -> int:
    """S9 rule: ``ceil(n / k)`` rows per shard (trailing shards may be empty)."""
    return math.ceil(n / k)


def shard(df: DataFrame, num_shards: int, shard_idx: int, ordinal_col: str = "ordinal",
          n: int | None = None, limit: int | None = None) -> DataFrame:
    """The contiguous shard ``[i*per, min(n, (i+1)*per))``; ``limit`` cuts inside it."""
    n = df.count() if n is None else n
    per = shard_size(n, num_shards)
    s, e = shard_idx * per, min(n, shard_idx * per + per)
    if limit:
        e = min(e, s + limit)
    o = F.col(ordinal_col)
    return df.filter((o >= s) & (o < e))


def batch_ids(df: DataFrame, batch_size: int, ordinal_col: str = "ordinal",
              name: str = "batch_id") -> DataFrame:
    """Consecutive ``batch_size`` rows share a batch id."""
    return df.withColumn(name, F.floor(F.col(ordinal_col) / F.lit(batch_size)).cast("bigint"))
