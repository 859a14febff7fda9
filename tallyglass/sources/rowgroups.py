"""A registered data source over Parquet files (S1, S13): one partition a row group, chosen by the filters that reach it.

The planner reads footers only. A row group whose statistics rule out a filter is not opened; a file
that cannot be read is a row of its own in the column ``_corrupt`` instead of the end of the job.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import (
    DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual,
)
from pyspark.sql.pandas.types import from_arrow_schema, to_arrow_schema

NAME = "row_groups"
CORRUPT = "_corrupt"


def open_path(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def files_of(path: str) -> list[str]:
    """The Parquet files at or below ``path``, in the order of their names."""
    system, at = open_path(path)
    info = system.get_file_info(at)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    if info.type == fs.FileType.File:
        return [at]
    found = system.get_file_info(fs.FileSelector(at, recursive=True))
    return sorted(f.path for f in found if f.type == fs.FileType.File and f.path.endswith(".parquet"))


@dataclass
class Group(InputPartition):
    """A row group of a file, or what is wrong with the file."""

    file: str
    group: int = -1
    error: str | None = None


def may_hold(f: Filter, low: dict, high: dict, nulls: dict, n: int) -> bool:
    """Whether a row group of ``n`` rows with these least and greatest values and NULL counts may have a row that the filter keeps."""
    name = ".".join(getattr(f, "attribute", ()))
    if not isinstance(f, (EqualTo, In, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual, IsNotNull)):
        return True
    if nulls.get(name) == n:  # NULL alone
        return False
    if isinstance(f, IsNotNull) or name not in low:
        return True
    a, b = low[name], high[name]
    try:
        if isinstance(f, EqualTo):
            return a <= f.value <= b
        if isinstance(f, In):
            return any(a <= v <= b for v in f.value if v is not None)
        if isinstance(f, GreaterThan):
            return b > f.value
        if isinstance(f, GreaterThanOrEqual):
            return b >= f.value
        if isinstance(f, LessThan):
            return a < f.value
        return a <= f.value
    except TypeError:  # statistics of another type say nothing
        return True


class RowGroupReader(DataSourceReader):
    def __init__(self, path: str, schema: T.StructType, mode: str) -> None:
        self.path, self.schema, self.mode, self.filters = path, schema, mode, []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """All filters choose row groups; Spark still applies them to the rows."""
        self.filters = list(filters)
        yield from filters

    def partitions(self) -> list[Group]:
        out: list[Group] = []
        system, _ = open_path(self.path)
        for file in files_of(self.path):
            try:
                with system.open_input_file(file) as source:
                    footer = pq.ParquetFile(source).metadata
                    out += [Group(file, g) for g in range(footer.num_row_groups) if self._wanted(footer.row_group(g))]
            except (pa.ArrowInvalid, OSError) as error:
                if self.mode == "FAILFAST":
                    raise
                out.append(Group(file, error=f"{file}: {str(error).splitlines()[0]}"))
        return out

    def _wanted(self, group) -> bool:
        low, high, nulls = {}, {}, {}
        for c in range(group.num_columns):
            column = group.column(c)
            s = column.statistics
            if s is not None and s.has_min_max:
                low[column.path_in_schema], high[column.path_in_schema] = s.min, s.max
            if s is not None and s.has_null_count:
                nulls[column.path_in_schema] = s.null_count
        return all(may_hold(f, low, high, nulls, group.num_rows) for f in self.filters)

    def read(self, partition: Group) -> Iterator[pa.RecordBatch]:
        names = [f.name for f in self.schema if f.name != CORRUPT]
        kinds = to_arrow_schema(self.schema)
        if partition.error is None:
            system, _ = open_path(self.path)
            with system.open_input_file(partition.file) as source:
                file = pq.ParquetFile(source)
                try:
                    for batch in file.iter_batches(row_groups=[partition.group], columns=names, use_threads=False):
                        columns = [batch.column(n).cast(kinds.field(n).type) for n in names]
                        yield pa.RecordBatch.from_arrays([*columns, pa.nulls(batch.num_rows, pa.string())], schema=kinds)
                    return
                except (pa.ArrowInvalid, OSError) as error:  # a damaged page: the rows before it have been handed on
                    if self.mode == "FAILFAST":
                        raise
                    partition = Group(partition.file, partition.group, f"{partition.file}, row group {partition.group}: {str(error).splitlines()[0]}")
        yield pa.RecordBatch.from_arrays([*[pa.nulls(1, kinds.field(n).type) for n in names], pa.array([partition.error])], schema=kinds)


class RowGroups(DataSource):
    """``spark.read.format("row_groups").load(path)``; option ``mode`` FAILFAST raises on a damaged file."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> T.StructType:
        """The columns of the first file that can be read, and ``_corrupt``."""
        path = self.options["path"]
        system, _ = open_path(path)
        for file in files_of(path):
            try:
                with system.open_input_file(file) as source:
                    found = from_arrow_schema(pq.ParquetFile(source).schema_arrow)
                    return T.StructType([*found.fields, T.StructField(CORRUPT, T.StringType())])
            except (pa.ArrowInvalid, OSError):
                continue
        raise ValueError(f"no readable Parquet file at {path}")

    def reader(self, schema: T.StructType) -> RowGroupReader:
        return RowGroupReader(self.options["path"], schema, self.options.get("mode", "PERMISSIVE").upper())


def session(spark: SparkSession) -> SparkSession:
    """A session of the same application that knows the source and pushes filters to it; the given one stays as it is."""
    own = spark.newSession()
    own.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    own.conf.set("spark.sql.session.timeZone", spark.conf.get("spark.sql.session.timeZone"))
    own.dataSource.register(RowGroups)
    return own
