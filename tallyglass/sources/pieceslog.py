"""A stream reader with offsets of its own (G2, G3): per key the newest item that was taken.

A log of pieces is a folder with a folder ``key=<key>`` for each key and, below it, Parquet files that are
named by the first and last item they hold, ``<first>-<last>.parquet``. So what is new is known from the
names alone. An offset maps each key to its newest item; a batch holds the items of each key above the
start and up to the end. Keys that are told to be revisited start ``slack`` items lower once.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote, unquote

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema

from tallyglass.sources.rowgroups import open_path

NAME = "pieces_log"
FILE = re.compile(r"key=([^/]*)/(\d+)-(\d+)\.parquet$")
REVISIT = "revisit.json"


@dataclass
class Span(InputPartition):
    """The items above ``low`` and up to ``high`` of one file."""

    file: str
    low: int
    high: int


class PiecesReader(DataSourceStreamReader):
    def __init__(self, path: str, item: str, slack: int, schema: T.StructType) -> None:
        self.path, self.item, self.slack, self.schema = path, item, slack, schema

    def _files(self) -> list[tuple[str, int, int, str]]:
        system, at = open_path(self.path)
        found = []
        for f in system.get_file_info(fs.FileSelector(at, recursive=True, allow_not_found=True)):
            m = FILE.search(f.path)
            if m:
                found.append((unquote(m[1]), int(m[2]), int(m[3]), f.path))
        return sorted(found)

    def _asked(self) -> dict[str, int]:
        """How often each key was asked to be revisited, from ``revisit.json`` in the folder."""
        system, at = open_path(self.path)
        file = f"{at}/{REVISIT}"
        if system.get_file_info(file).type != fs.FileType.File:
            return {}
        with system.open_input_stream(file) as source:
            return json.loads(source.readall().decode())

    def initialOffset(self) -> dict:
        return {"newest": {}, "revisits": {}}

    def latestOffset(self) -> dict:
        newest: dict[str, int] = {}
        for key, _, last, _ in self._files():
            newest[key] = max(newest.get(key, -1), last)
        return {"newest": newest, "revisits": self._asked()}

    def partitions(self, start: dict, end: dict) -> list[Span]:
        out = []
        for key, first, last, file in self._files():
            low, high = start["newest"].get(key, -1), end["newest"].get(key, -1)
            if end["revisits"].get(key, 0) > start["revisits"].get(key, 0):
                low -= self.slack
            if last > low and first <= high:
                out.append(Span(file, low, high))
        return out

    def read(self, partition: Span) -> Iterator[pa.RecordBatch]:
        kinds = to_arrow_schema(self.schema)
        system, _ = open_path(self.path)
        with system.open_input_file(partition.file) as source:
            for batch in pq.ParquetFile(source).iter_batches(columns=kinds.names, use_threads=False):
                at = batch.column(self.item)
                kept = batch.filter(pc.and_(pc.greater(at, partition.low), pc.less_equal(at, partition.high)))
                yield pa.RecordBatch.from_arrays([kept.column(n).cast(kinds.field(n).type) for n in kinds.names], schema=kinds)

    def commit(self, end: dict) -> None:
        """Spark's checkpoint holds the offsets; nothing is deleted."""


class PiecesLog(DataSource):
    """``spark.readStream.format("pieces_log").schema(...).option("item", "no").load(path)``; ``slack`` is 0 unless given."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def streamReader(self, schema: T.StructType) -> PiecesReader:
        return PiecesReader(self.options["path"].rstrip("/"), self.options["item"], int(self.options.get("slack", 0)), schema)


def file_name(key: str, first: int, last: int) -> str:
    """Where a file of a key's items goes below the log's folder."""
    return f"key={quote(key, safe='')}/{first}-{last}.parquet"


def register(spark: SparkSession) -> None:
    spark.dataSource.register(PiecesLog)
