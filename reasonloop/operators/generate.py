"""Batched generation (R1): prompts in, K candidate texts per prompt out.

No model ships with the library. A caller supplies either

* a Python callable ``fn(prompts: list[str], k: int) -> list[list[str]]`` — it runs inside
  ``mapInPandas`` on Arrow batches of ``batch_size`` prompts, and a ``loader`` (if given)
  is called once per Python worker to build it (e.g. load a model), or
* a :class:`TableGenerator` — generations already stored in a table
  ``(id, cand_idx, text)``, looked up by an equi-join. The queries and tests use this
  form; it is also how a replay of a previous run works; or
* a ``genstore.PromptStore`` — stored generations looked up by the rendered prompt itself.

Output: ``id, cand_idx int (1-based), text string`` plus an ``error`` column for the
callable form (a failing batch yields rows with NULL text and the error message instead
of failing the whole job when ``on_error='record'``).
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialize
from .skew import block_join


class TableGenerator:
    """Stored generations looked up by problem id, each problem's spread by blocks of ``cand_idx``."""

    def __init__(self, generations: DataFrame, id_col: str = "id", idx_col: str = "cand_idx",
                 text_col: str = "text"):
        self.generations = generations.select(
            F.col(id_col).alias("__gid"), F.col(idx_col).cast("int").alias("cand_idx"),
            F.col(text_col).alias("text"))

    def rows(self, id_col: str = "id", k: int | None = None) -> DataFrame:
        """The stored ``(id, cand_idx, text)`` themselves (the first ``k`` of a problem)."""
        g = self.generations if k is None else self.generations.filter(F.col("cand_idx") <= k)
        return g.withColumnRenamed("__gid", id_col)

    def between(self, low, high) -> TableGenerator:
        """The generations of ids from ``low`` to ``high``: the filter reaches the files' statistics, so a
        table laid out by id is read in part."""
        return TableGenerator(self.generations.filter(F.col("__gid").between(F.lit(low), F.lit(high))), "__gid")

    def __call__(self, prompts: DataFrame, id_col: str = "id", k: int | None = None) -> DataFrame:
        g = self.rows("__gid", k)
        return (block_join(g, prompts.select(F.col(id_col).alias("__gid")), "__gid", "cand_idx", highest=k)
                .withColumnRenamed("__gid", id_col)
                .withColumn("error", F.lit(None).cast("string")))


_worker_cache: dict[str, Callable] = {}


def _resolve(fn: Callable | None, loader: Callable[[], Callable] | None, key: str) -> Callable:
    """The generator of this call; a worker keeps the last one it built."""
    if loader is None:
        return fn
    if key not in _worker_cache:
        built = loader()
        _worker_cache.clear()
        _worker_cache[key] = built
    return _worker_cache[key]


def generate(prompts: DataFrame, generator, k: int = 1, id_col: str = "id",
             prompt_col: str = "prompt", batch_size: int = 16,
             loader: Callable[[], Callable] | None = None, on_error: str = "raise",
             loader_key: str | None = None) -> DataFrame:
    """K generations per prompt (``None``: all stored ones, or four of a callable). A worker builds the loader's generator once per
    ``loader_key``; without a key every call of this function counts as a new generator."""
    if isinstance(generator, TableGenerator):
        return generator(prompts, id_col=id_col, k=k)
    if hasattr(generator, "lookup"):
        return generator.lookup(prompts, id_col, prompt_col, k).withColumn("error", F.lit(None).cast("string"))
    id_type = prompts.schema[id_col].dataType
    out_schema = T.StructType([
        T.StructField(id_col, id_type), T.StructField("cand_idx", T.IntegerType()),
        T.StructField("text", T.StringType()), T.StructField("error", T.StringType())])
    k = 4 if k is None else k
    if k < 1:
        raise ValueError("a generator gives one text per prompt or more")
    fn0 = generator
    key = loader_key or uuid.uuid4().hex

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fn = _resolve(fn0, loader, key)
        for pdf in batches:
            for start in range(0, len(pdf), batch_size):
                chunk = pdf.iloc[start:start + batch_size]
                ids = chunk[id_col].tolist()
                try:
                    outs = fn(chunk[prompt_col].fillna("").tolist(), k)
                    if len(outs) != len(ids) or any(len(o) != k for o in outs):
                        raise ValueError("generator must return k texts per prompt")
                    rows = [(i, j + 1, t, None) for i, o in zip(ids, outs) for j, t in enumerate(o)]
                except Exception as e:  # noqa: BLE001 - recorded per row on request
                    if on_error != "record":
                        raise
                    rows = [(i, j + 1, None, repr(e)) for i in ids for j in range(k)]
                yield pd.DataFrame(rows, columns=[id_col, "cand_idx", "text", "error"])

    return prompts.select(id_col, prompt_col).mapInPandas(run, out_schema)


def candidates_for(prompts: DataFrame, generator, k: int | None = None, **how) -> DataFrame:
    """Candidates to pick from for ``prompts``, in a form that may be read twice. Stored generations
    are returned as they are: the pick joins its reduced rows with the prompts' gold keys, which
    leaves out other problems. A callable runs once and its texts are written."""
    if isinstance(generator, TableGenerator):
        return generator.rows(k=k)
    if hasattr(generator, "lookup"):                     # by rendered prompt: only the prompts' own texts are read on
        return materialize(generator.lookup(prompts, k=k), "generations")
    return materialize(generate(prompts, generator, k=k, **how), "generations")
