"""Intermediate tables in the shared folder, and how a table is handed to Python workers."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textwarden.session import fresh_path

_WRITTEN: list[str] = []


def stored(df: DataFrame, name: str) -> DataFrame:
    """The same rows, written once as Parquet below the shared folder and read from there.

    It cuts the lineage, so that a lost executor costs a read instead of the work behind it.
    """
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    _WRITTEN.append(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def claimed(spark: SparkSession, name: str) -> str:
    """A path below the shared folder for files of another kind; deleted with the tables."""
    path = fresh_path(spark, name)
    _WRITTEN.append(path)
    return path


def _delete(spark: SparkSession, path: str) -> bool:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return bool(fs.delete(place, True))


def discard(*tables: DataFrame) -> None:
    """Delete intermediate tables that nothing reads any more: what came from them is stored itself."""
    for table in tables:
        if table.stored_at in _WRITTEN:
            _WRITTEN.remove(table.stored_at)
            _delete(table.sparkSession, table.stored_at)


def written() -> list[str]:
    """Where the intermediate tables of this driver are."""
    return list(_WRITTEN)


def release(spark: SparkSession, paths: list[str] | None = None) -> int:
    """Delete intermediate tables, all or the given ones; call it once the results are written."""
    done = 0
    for path in written() if paths is None else paths:
        if path in _WRITTEN:
            _WRITTEN.remove(path)
            done += _delete(spark, path)
    return done


ROWS = 2000  # rows that a Python worker takes at a time, so that it holds little besides its input


def sliced(batches: Iterator[pa.RecordBatch], rows: int = ROWS) -> Iterator[pa.RecordBatch]:
    """The same rows in smaller batches; a worker that has done its last one gives its memory back."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
    batch = None
    give_back()


def give_back() -> None:
    """Return memory that this process has freed to the system: workers wait for their next task for long."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it
    if trim:
        trim(0)


def by_batch(df: DataFrame, make: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema) -> DataFrame:
    """Apply a function to the rows of a table, some at a time; row work, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            out = make(batch)
            if out is not None and out.num_rows:
                yield out

    return df.mapInArrow(run, schema)


def crc_fold(doc_id: Column | str, folds: int = 5) -> Column:
    """crc32 of the id as text, modulo the folds; null ids fall into fold 0."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(c.cast("string").cast("binary")) % folds, F.lit(0).cast("bigint"))
