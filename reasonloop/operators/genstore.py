"""Generations stored by what was asked (R1): prompt in, texts out, whatever problem asks it.

A generation's key is the 128-bit hash of the decode settings and the whole rendered prompt. A
changed character in a template or a changed setting is another key, so a stored text is never
taken for a prompt that did not produce it; problems with the same prompt share their texts.

``GenerationRun`` fills such a store with a callable and can be stopped at any time. Distinct prompts
without a committed text are dealt to units by key; a unit is one Spark job that writes into a folder
of its own attempt and is committed by one record (``sources.manifest``). A run started again
generates only what no record names: the outputs of a unit that failed are never read, those of
finished ones never generated again. A failed task inside a unit is Spark's to repeat.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialize, write_observed
from ..sources.manifest import Manifest
from .generate import generate
from .skew import block_join, block_rows

UNIT_ROWS = 1_000_000
STORE_SCHEMA = "prompt_key string, cand_idx int, text string"


def prompt_key(prompt: str | Column, settings: dict | None = None) -> Column:
    """Key of a rendered prompt under ``settings`` (decode parameters, model name)."""
    p = F.col(prompt) if isinstance(prompt, str) else prompt
    return F.md5(F.concat(F.lit(json.dumps(settings or {}, sort_keys=True) + "\n"), p).cast("binary"))


class PromptStore:
    """Stored generations ``(prompt_key, cand_idx, text)``, looked up by the rendered prompt; ``highest``: no
    ``cand_idx`` is higher, if known (see ``skew.block_join``)."""

    def __init__(self, generations: DataFrame, settings: dict | None = None, highest: int | None = None):
        self.highest = highest
        self.generations = generations.select("prompt_key", F.col("cand_idx").cast("int").alias("cand_idx"), "text")
        self.settings = settings

    def keyed(self, prompts: DataFrame, prompt_col: str = "prompt") -> DataFrame:
        return prompts.withColumn("prompt_key", prompt_key(prompt_col, self.settings))

    def lookup(self, prompts: DataFrame, id_col: str = "id", prompt_col: str = "prompt", k: int | None = None) -> DataFrame:
        """``(id, cand_idx, text)`` of every prompt that has stored texts (the first ``k``); a key's texts are
        spread by blocks of ``cand_idx``."""
        g = self.generations if k is None else self.generations.filter(F.col("cand_idx") <= k)
        asked = self.keyed(prompts, prompt_col).select("prompt_key", id_col)
        return block_join(g, asked, "prompt_key", highest=self.highest if k is None else k).select(id_col, "cand_idx", "text")

    def answered(self, keyed: DataFrame) -> DataFrame:
        """The rows of ``keyed`` (with their ``prompt_key``), each with every text stored for its prompt: ``cand_idx`` and
        ``text``, NULL where there is none. If ``highest`` is known and less than a block, one outer join finds
        both; otherwise a key's texts are spread by blocks and the rows without one are added."""
        if self.highest is not None and self.highest < block_rows(keyed.sparkSession):
            return keyed.join(self.generations, "prompt_key", "left")
        keyed, g = materialize(keyed, "asked"), materialize(self.generations, "stored-generations")
        silent = (keyed.join(g.select("prompt_key").distinct(), "prompt_key", "left_anti")
                  .withColumn("cand_idx", F.lit(None).cast("int")).withColumn("text", F.lit(None).cast("string")))
        return block_join(g, keyed, "prompt_key").unionByName(silent)

    def missing(self, prompts: DataFrame, prompt_col: str = "prompt") -> DataFrame:
        """Distinct ``(prompt_key, prompt)`` without a stored text."""
        asked = self.keyed(prompts.select(F.col(prompt_col).alias("prompt"))).dropDuplicates(["prompt_key"])
        return asked.join(self.generations.select("prompt_key").distinct(), "prompt_key", "left_anti").select("prompt_key", "prompt")


class GenerationRun:
    """A store under ``root`` that a callable fills unit by unit; see the module's text."""

    def __init__(self, spark: SparkSession, root: str, k: int = 1, settings: dict | None = None,
                 unit_rows: int = UNIT_ROWS, units: int | None = None, batch_size: int = 16):
        self.spark, self.manifest = spark, Manifest(spark, root)
        self.k, self.settings, self.batch_size = k, {"k": k, **(settings or {})}, batch_size
        self.unit_rows, self.units = unit_rows, units

    def records(self) -> dict[str, dict]:
        return self.manifest.records()

    def generations(self) -> DataFrame:
        """``(prompt_key, cand_idx, text, run)`` of the committed units; ``run`` is the call that generated them."""
        parts = self.records().values()
        schema = STORE_SCHEMA + ", run int"
        if not parts:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[r["path"] for r in parts])

    def store(self) -> PromptStore:
        return PromptStore(self.generations(), self.settings)

    def fill(self, prompts: DataFrame, generator: Callable, prompt_col: str = "prompt", **how) -> PromptStore:
        """Generates ``k`` texts for every distinct prompt that has none and returns the store."""
        run = 1 + max((r["run"] for r in self.records().values()), default=0)
        todo = materialize(self.store().missing(prompts, prompt_col), "prompts-todo")
        units = self.units or -(-todo.count() // self.unit_rows)
        unit = F.conv(F.substring("prompt_key", 1, 8), 16, 10).cast("bigint") % F.lit(max(units, 1))
        todo = todo.withColumn("unit", unit)
        for u in range(units):
            part = todo.filter(F.col("unit") == u)
            if part.isEmpty():
                continue
            texts = generate(part, generator, k=self.k, id_col="prompt_key", batch_size=self.batch_size, **how)
            path = self.manifest.attempt("units")
            seen = write_observed(texts.select("prompt_key", "cand_idx", "text", F.lit(run).alias("run")), path,
                                  {"rows": F.count(F.lit(1))})
            self.manifest.commit(path.rsplit("-", 1)[1], {"path": path, "run": run, "prompts": seen["rows"] // self.k})
        return self.store()
