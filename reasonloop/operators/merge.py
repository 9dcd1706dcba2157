"""Keyed merge (R6) kept as a table: a new source rewrites only the parts that hold its ids.

The merged table is cut into parts by the hash of the id. ``add`` reduces the new source to its last row
per id, joins it with the touched parts alone and writes those anew into a folder of its own attempt; one
commit record then names the files of every part, touched or not (``sources.manifest``). Readers follow
the last record, so they see a source wholly or not, and untouched parts keep their files. A row's payload
is that of its id's last sighting, its position that of the first, as in ``selection.merge_last_wins``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialize
from ..sources.manifest import Manifest
from .selection import merge_last_wins

PARTS = 64


class MergedTable:
    """A merged table under ``root``; ``parts`` counts when the first source is added and is kept then."""

    def __init__(self, spark: SparkSession, root: str, order_col: str, id_col: str = "id", parts: int = PARTS):
        self.spark, self.manifest = spark, Manifest(spark, root)
        self.order_col, self.id_col, self.parts = order_col, id_col, parts

    def last(self) -> dict | None:
        """The last committed record: ``source`` (its number), ``n_parts`` and ``parts`` (part -> folder)."""
        return max(self.manifest.records().values(), key=lambda r: r["source"], default=None)

    def _merged(self, rows: DataFrame, old: DataFrame) -> DataFrame:
        """New rows at their id's old position, and the old rows of other ids, by one outer join."""
        was = old.select([F.col(c).alias(f"__was_{c}") for c in old.columns])
        both = rows.withColumn("__new", F.lit(True)).join(was, F.col(self.id_col).eqNullSafe(F.col(f"__was_{self.id_col}")), "full")
        return both.select(*[F.coalesce("__was_pos", "pos").alias(c) if c == "pos" else
                             F.when(F.col("__new"), F.col(c)).otherwise(F.col(f"__was_{c}")).alias(c) for c in rows.columns])

    def read(self) -> DataFrame | None:
        """The merged rows: the sources' columns, ``src`` and ``pos``; None before the first source."""
        last = self.last()
        return None if last is None else self.spark.read.parquet(*last["parts"].values()) if last["parts"] else None

    def add(self, source: DataFrame) -> dict:
        """Merge ``source`` (same columns each time) as the next one; returns the committed record."""
        last = self.last() or {"source": -1, "n_parts": self.parts, "parts": {}}
        number, n = last["source"] + 1, last["n_parts"]
        new = merge_last_wins([materialize(source, "merge-new")], self.order_col, self.id_col)      # read twice
        new = materialize(new.withColumn("src", F.lit(number))
                          .withColumn("pos", F.struct(F.lit(number).alias("__src"), F.col("pos.__ord").alias("__ord")))
                          .withColumn("part", F.pmod(F.xxhash64(self.id_col), F.lit(n)).cast("int")), "merge-source")
        touched = sorted(r["part"] for r in new.select("part").distinct().collect())      # at most n_parts numbers
        rows = new.drop("part")
        folders = [last["parts"][str(p)] for p in touched if str(p) in last["parts"]]
        merged = self._merged(rows, self.spark.read.schema(rows.schema).parquet(*folders)) if folders else rows
        path = self.manifest.attempt("parts")
        merged = merged.withColumn("part", F.pmod(F.xxhash64(self.id_col), F.lit(n)).cast("int"))
        merged.repartition("part").write.partitionBy("part").parquet(path)
        record = {"source": number, "n_parts": n, "parts": last["parts"] | {str(p): f"{path}/part={p}" for p in touched}}
        if not self.manifest.commit(f"source-{number}", record):
            raise RuntimeError("another run has merged a source meanwhile; add this one again")
        return record
