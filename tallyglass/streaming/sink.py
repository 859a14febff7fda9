"""A table that takes each micro-batch exactly once.

The table is a folder with one folder ``batch=<name>`` per batch and one marker per committed batch below
``_commits``. A batch is written to its own folder, which a replay overwrites, and then its marker is
written; readers see the folders of marked batches only. So neither a crash nor a replay adds a row
twice, whatever its key holds. One writer at a time, which a streaming checkpoint sees to.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


class BatchTable:
    """A table of batches at ``path`` on any file system that Spark writes to."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType | str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self.schema = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)

    def _hadoop(self, path: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at, at.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def commits(self) -> list[str]:
        """Names of the committed batches, from the names of their markers."""
        at, files = self._hadoop(f"{self.path}/_commits")
        names = [s.getPath().getName() for s in files.listStatus(at)] if files.exists(at) else []
        return sorted(n.removesuffix(".json") for n in names if n.endswith(".json") and not n.startswith("."))

    def note(self, batch: str) -> dict:
        """What the marker of a committed batch says."""
        at, files = self._hadoop(f"{self.path}/_commits/{batch}.json")
        stream = files.open(at)
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def read(self, without: str | None = None) -> DataFrame:
        """Rows of the committed batches; with ``without``, of the others."""
        batches = [b for b in self.commits() if b != without]
        if not batches:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[f"{self.path}/batch={b}" for b in batches])

    def write(self, rows: DataFrame, batch: str) -> int:
        """Make ``rows`` the content of ``batch``, whether it was there or not; returns how many they are."""
        folder = f"{self.path}/batch={batch}"
        rows.select(*[F.col(f"`{f.name}`").cast(f.dataType) for f in self.schema]).write.mode("overwrite").parquet(folder)
        n = self.spark.read.schema(self.schema).parquet(folder).count()
        at, files = self._hadoop(f"{self.path}/_commits/{batch}.json")
        new, _ = self._hadoop(f"{self.path}/_commits/.{batch}.new")
        stream = files.create(new, True)
        try:
            stream.write(bytearray(json.dumps({"batch": batch, "n_rows": n}).encode()))
        finally:
            stream.close()
        files.delete(at, False)
        if not files.rename(new, at):  # the marker is there as a whole or not at all
            raise OSError(f"batch {batch} could not be committed at {self.path}")
        return n
