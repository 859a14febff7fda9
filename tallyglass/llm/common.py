"""Shared plumbing of the corpus operators: shared-folder tables, batches, tables of a run."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space that separates words in every operator here: U+0020 and U+0009 to U+000D.
SPACE = " \t\n\x0b\x0c\r"
#: Rows that a batch function sees at once; the bytes of an Arrow batch are bounded by the session.
BATCH_ROWS = 512
#: Local folders of applications without ``spark.checkpoint.dir``, which only local masters get.
_local: dict[str, str] = {}


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see: ``spark.checkpoint.dir``.

    Where that is unset, a local master gets a new local folder; a cluster cannot share one, so there
    it is an error. The session's settings are left as they are.
    """
    known = spark.conf.get("spark.checkpoint.dir", None)
    if known:
        return known
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if context.applicationId not in _local:
        _local[context.applicationId] = "file://" + tempfile.mkdtemp(prefix="tallyglass-")
    return _local[context.applicationId]


def own_dir(spark: SparkSession) -> str:
    """Where the tables of this application go."""
    return f"{shared_dir(spark)}/tallyglass/{spark.sparkContext.applicationId}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read again.

    Cuts the lineage, survives lost executors, and keeps an expensive step from running twice.
    """
    spark = df.sparkSession
    path = f"{own_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def map_batches(
    df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str, rows: int = BATCH_ROWS
) -> DataFrame:
    """``mapInArrow`` whose function gets slices of at most ``rows`` rows, whatever the session's batches hold."""

    def sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return fn(batch.slice(lo, rows) for batch in batches for lo in range(0, max(batch.num_rows, 1), rows))

    return df.mapInArrow(sliced, schema)


def fold(doc_id: Column) -> Column:
    """0 to 4 from the CRC-32 of the id's text; 0 marks the held-out fold, NULL ids count as it."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5, F.lit(0))


def binary_rows(rows) -> pa.Array:
    """A 2-d array of bytes as a binary Arrow array, one value a row."""
    import numpy as np

    n, width = rows.shape
    offsets = np.arange(0, (n + 1) * width, width, dtype=np.int32) if width else np.zeros(n + 1, dtype=np.int32)
    data = np.ascontiguousarray(rows)
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(offsets), pa.py_buffer(data)])


def release(spark: SparkSession) -> None:
    """Delete what ``stored`` wrote for this application; frames that read it are of no use afterwards."""
    path = spark._jvm.org.apache.hadoop.fs.Path(own_dir(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
