"""Commit records: what readers may read of a folder that jobs write into.

A job writes its outputs into folders of its own attempt and then commits one small record that names
them all. Readers follow the records, so the outputs of an attempt appear together or not at
all, whatever was left behind by an attempt that failed. A record is written aside and renamed;
a name can be committed once. Records are read by Spark, one row each.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession


class Manifest:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.path = f"{self.root}/_manifest"

    def _fs(self, path: str):
        jpath = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return jpath.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), jpath

    def _file(self, name: str) -> str:
        return f"{self.path}/{name}.json"

    def committed(self, name: str) -> bool:
        fs, path = self._fs(self._file(name))
        return fs.exists(path)

    def attempt(self, name: str) -> str:
        """A new folder for one attempt's output ``name``; nothing reads it before a record names it."""
        return f"{self.root}/{name}/attempt-{uuid.uuid4().hex}"

    def commit(self, name: str, record: dict) -> bool:
        """Commits ``record``; false if ``name`` was committed before (the earlier record stays)."""
        if self.committed(name):
            return False
        fs, aside = self._fs(f"{self.path}/.{uuid.uuid4().hex}")
        line = json.dumps({"name": name, "record": json.dumps(record)})
        out = fs.create(aside, True)
        out.write(bytearray(line.encode()))
        out.close()
        done = fs.rename(aside, self._fs(self._file(name))[1])
        if not done:
            fs.delete(aside, False)
        return bool(done)

    def records(self) -> dict[str, dict]:
        """Every committed record by name."""
        fs, path = self._fs(self.path)
        if not fs.exists(path):
            return {}
        rows = self.spark.read.schema("name string, record string").json(self.path).collect()
        return {r["name"]: json.loads(r["record"]) for r in rows}
