"""Append-only tables with numbered commits.

Data files go to ``<table>/data/<uuid>``; commit n is the file ``<table>/commits/<n>.json`` that names the folders in force and is made
only if it does not exist yet. Readers pin a number; of two writers that read n, one makes n + 1 and the other gets
``ConflictError`` and must look again. Nothing is ever deleted.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession


class ConflictError(Exception):
    """Another writer made this commit."""


class Table:
    def __init__(self, spark: SparkSession, path: str, schema) -> None:
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema
        self._jvm = spark.sparkContext._jvm
        root = self._jvm.org.apache.hadoop.fs.Path(self.path)
        self._fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _at(self, rest: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{rest}")

    def last(self) -> int:
        """Number of the last commit; 0 for an empty table."""
        folder = self._at("commits")
        if not self._fs.exists(folder):
            return 0
        return max((int(s.getPath().getName().split(".")[0]) for s in self._fs.listStatus(folder) if s.getPath().getName().endswith(".json")), default=0)

    def _commit(self, n: int) -> dict:
        if n == 0:
            return {"folders": []}
        stream = self._fs.open(self._at(f"commits/{n}.json"))
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def read(self, at: int | None = None) -> DataFrame:
        """The rows of commit ``at`` (default: the last)."""
        folders = self._commit(self.last() if at is None else at)["folders"]
        return self.spark.read.schema(self.schema).parquet(*[f"{self.path}/{f}" for f in folders]) if folders else self.spark.createDataFrame([], self.schema)

    def append(self, rows: DataFrame, expected: int | None = None) -> int:
        """Write rows and commit them after ``expected`` (default: the last commit); returns the new number."""
        base = self.last() if expected is None else expected
        folder = f"data/{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.path}/{folder}")
        self._publish(base + 1, {"folders": [*self._commit(base)["folders"], folder]})
        return base + 1

    def _publish(self, n: int, content: dict) -> None:
        try:
            stream = self._fs.create(self._at(f"commits/{n}.json"), False)
        except Exception as e:
            if "exist" in str(e).lower():
                raise ConflictError(f"commit {n} exists") from None
            raise
        try:
            stream.write(bytearray(json.dumps(content).encode()))
        finally:
            stream.close()
