"""Training-batch preparation over pre-tokenised integer arrays.

Arrays stay native: ``concat``, ``array_repeat``, ``slice`` and a window ``max`` over the
batch (a batch holds at most B rows by construction, so the window is bounded).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

IGNORE_INDEX = -100  # fixed value: label id that the loss ignores


def concat_and_mask(df: DataFrame, prompt_col: str = "prompt_ids",
                    target_col: str = "target_ids") -> DataFrame:
    """``input_ids = prompt + target``, mask all ones, labels ignore the prompt."""
    p, t = F.col(prompt_col), F.col(target_col)
    return (df.withColumn("input_ids", F.concat(p, t))
              .withColumn("attention_mask", F.array_repeat(F.lit(1), F.size(p) + F.size(t)))
              .withColumn("labels", F.concat(F.array_repeat(F.lit(IGNORE_INDEX), F.size(p)), t)))


def pad_batches(df: DataFrame, batch_col: str = "batch_id", *, max_seq_len: int | None,
                pad_id: int = 0) -> DataFrame:
    """Per batch ``max_len = min(longest input, max_seq_len)``; every row is cut to
    ``max_len`` and right-padded with ``pad_id`` / 0 / -100. The cut has no default: ``max_seq_len=None`` is T2b
    (pad to the longest, no cut)."""
    return _fit(df.withColumn("max_len", _batch_length(F.size("input_ids"), batch_col, max_seq_len)), pad_id)


def padded_examples(df: DataFrame, batch_col: str = "batch_id", prompt_col: str = "prompt_ids",
                    target_col: str = "target_ids", *, max_seq_len: int | None, pad_id: int = 0) -> DataFrame:
    """T1 + T2: as :func:`pad_batches` over :func:`concat_and_mask`, but the batch's length is
    taken from the sizes of the two source arrays, so only those are shuffled; input ids, mask
    and labels are built after it."""
    size = F.size(prompt_col) + F.size(target_col)
    return _fit(concat_and_mask(df.withColumn("max_len", _batch_length(size, batch_col, max_seq_len)),
                                prompt_col, target_col), pad_id)


def _batch_length(size: Column, batch_col: str, max_seq_len: int | None) -> Column:
    longest = F.max(size).over(Window.partitionBy(batch_col))
    return longest if max_seq_len is None else F.least(longest, F.lit(max_seq_len))


def _fit(d: DataFrame, pad_id: int) -> DataFrame:
    def fit(c: str, pad: int):
        cut = F.slice(F.col(c), 1, F.col("max_len"))
        return F.concat(cut, F.array_repeat(F.lit(pad), F.col("max_len") - F.size(cut)))

    return (d.withColumn("input_ids", fit("input_ids", pad_id))
             .withColumn("attention_mask", fit("attention_mask", 0))
             .withColumn("labels", fit("labels", IGNORE_INDEX)))
