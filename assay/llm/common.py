"""What the operators share: registering queries, reading documents, storing intermediate tables."""

from __future__ import annotations

import ctypes
import functools
import gc
import itertools
import pickle
import uuid
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_type

from assay.session import shared_dir
from assay.sources.readers import read_table

DOCUMENTS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
LABELS = "doc_id bigint, quality int, toxic int"

ARROW_BYTES = 4_000_000

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    """Register a query, with the SQL that gives the same rows where there is one."""

    def keep(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql.strip()
        return fn

    return keep


def documents(spark: SparkSession, root: str) -> DataFrame:
    return read_table(spark, root, "documents", DOCUMENTS)


def labels(spark: SparkSession, root: str) -> DataFrame:
    return read_table(spark, root, "labels", LABELS)


def folder(spark: SparkSession, name: str) -> str:
    """A new folder on the storage that driver and executors share (spark.checkpoint.dir)."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: cuts the lineage and survives lost executors."""
    path = folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def whole(text: str | Column = "text") -> Column:
    """The text, null as the empty text."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def bounded_batches(spark: SparkSession) -> None:
    """Let Arrow batches end at ``ARROW_BYTES``, so that long texts do not add up in executor and Python worker.

    This is a setting of the session; it changes how rows travel to Python, not what comes back.
    """
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))


@functools.cache
def _libc():
    try:
        return ctypes.CDLL("libc.so.6")
    except OSError:
        return None


#: What a worker process drops when a map task ends.
FORGET: list[Callable[[], None]] = []


def release() -> None:
    """Give freed memory back to the system: a Python worker lives on after its task, beside those of later stages."""
    for forget in FORGET:
        forget()
    gc.collect()
    pa.default_memory_pool().release_unused()
    if (libc := _libc()) is not None:
        libc.malloc_trim(0)


def small_batches(batches: Iterator[pa.RecordBatch], column: str, size: int) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that the named text or binary column holds about ``size`` bytes; a longer text stands alone."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        ends = np.cumsum(np.asarray(pc.binary_length(batch.column(column)).fill_null(0), dtype=np.int64))
        start, base = 0, 0
        while start < n:
            end = max(start + 1, int(np.searchsorted(ends, base + size, side="right")))
            yield batch.slice(start, end - start)
            start, base = end, int(ends[end - 1])
    release()


def map_texts(df: DataFrame, keep: list[str], new: str, work: Callable[[list[bytes]], list], text_col: str = "text",
              size: int = 2_000_000) -> DataFrame:
    """Columns ``keep`` and the ``new`` ones (DDL) that ``work`` makes of every whole text, row by row, in order.

    ``work`` gets the texts of a small batch as UTF-8 (null as empty) and returns one array or list for each new
    column. Other columns, of whatever name, are passed by position, so names cannot clash on the way.
    """
    source = df.select(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)], whole(F.col(f"`{text_col}`").cast("string")).cast("binary").alias("t"))
    bounded_batches(df.sparkSession)
    added = T.StructType.fromDDL(new)
    schema = T.StructType([T.StructField(f"k{i}", f.dataType) for i, f in enumerate(source.schema.fields[:-1])] + list(added))
    kinds = [to_arrow_type(f.dataType) for f in added]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "t", size):
            made = work(batch.column("t").to_pylist())
            arrays = batch.columns[:-1] + [pa.array(x, type=k) for x, k in zip(made, kinds)]
            yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    return source.mapInArrow(run, schema).toDF(*keep, *added.names)


def numbering(first: int = 0) -> dict:
    """A dictionary that gives each new key the next number."""
    return defaultdict(itertools.count(first).__next__)


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed block."""
    return zstandard.ZstdCompressor(level=1).compress(pickle.dumps(arrays, protocol=5))


def unpack(block: bytes) -> tuple[np.ndarray, ...]:
    return pickle.loads(zstandard.ZstdDecompressor().decompress(block))


def held_out(modulus: int, id_col: str = "doc_id") -> Column:
    """Rows kept from learning: crc32 of the identifier as text leaves the remainder 1. A missing identifier counts as ''."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(modulus)) == 1


def batch_number(sequence: int) -> int:
    """A number for a batch of a map task; the same when the task runs again."""
    return (TaskContext.get().partitionId() << 32) | sequence
