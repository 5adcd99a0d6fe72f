"""Shared plumbing of the training-data operators: shared scratch tables, safe column handling, Arrow batches."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Stands for a null doc_id inside joins; it sorts before every other id and is no id of a document itself.
NULL_ID = -(2**63)
#: Bytes of an Arrow batch that goes to or comes from a Python worker: what bounds a worker's memory where rows are long.
BATCH_BYTES = 4 << 20
#: Bytes of a table up to which it is broadcast.
BROADCAST_BYTES = 32 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def scratch_root(spark: SparkSession) -> str:
    """The shared folder for intermediate tables: spark.checkpoint.dir, or a temp folder in single-JVM local mode only."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        where = tempfile.mkdtemp(prefix="tidemill-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def bound_batches(spark: SparkSession) -> None:
    """Bound Arrow batches of the session by BATCH_BYTES, unless it has a bound other than Spark's own of 64 MB."""
    if spark.conf.get(_BATCH) == "67108864b":
        spark.conf.set(_BATCH, f"{BATCH_BYTES}b")


_SCRATCH: list[str] = []


def scratch_path(spark: SparkSession, tag: str) -> str:
    """A new path in the shared folder, which `discard` or `clean` deletes."""
    bound_batches(spark)
    _SCRATCH.append(f"{scratch_root(spark)}/{tag}-{uuid.uuid4().hex}")
    return _SCRATCH[-1]


def stored(df: DataFrame, tag: str) -> DataFrame:
    """Write df once as a table in the shared folder and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, tag)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def delete(spark: SparkSession, where: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(where)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    if where in _SCRATCH:
        _SCRATCH.remove(where)


def discard(*tables: DataFrame) -> None:
    """Delete stored tables that nothing will read again: all that was made of them is stored itself."""
    for t in tables:
        delete(t.sparkSession, t.stored_at)


def clean(spark: SparkSession, *keep: DataFrame, since: int = 0) -> None:
    """Delete the scratch tables of this process but `keep`: for when results that read them are stored or used up.
    since: leave the first so many; len(scratch_tables()) tells how many there are."""
    kept = {t.stored_at for t in keep}
    for where in [p for p in _SCRATCH[since:] if p not in kept]:
        delete(spark, where)


def scratch_tables() -> list[str]:
    return list(_SCRATCH)


def doc_keys(docs: DataFrame) -> DataFrame:
    """(doc, th, doc_id, text): doc is a non-null id, th tells rows apart that repeat an id with another text.

    Other columns are left behind, so clashing names in the input do no harm."""
    return docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("doc"),
        F.xxhash64(F.col("text").cast("string")).alias("th"),
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("text").cast("string").alias("text"),
    )


def texts_of(batch: pa.RecordBatch, name: str = "text") -> list[bytes]:
    """The UTF-8 bytes of a string column; null becomes empty."""
    col = batch.column(batch.schema.get_field_index(name))
    return [x or b"" for x in col.cast(pa.binary()).to_pylist()]


def give_back() -> None:
    """Return freed memory of this worker to the system; workers live on between tasks and stages."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def pieces(batches: Iterable[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """The same rows in small batches, so that what a task derives from them stays small; frees memory at the end."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
    give_back()


def bytes_of(df: DataFrame) -> int:
    """The stored size of a table that `stored` made."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df.stored_at)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(path).getLength()


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def lower_bytes(b: bytes) -> bytes:
    """Lower-case A-Z only, on UTF-8 bytes."""
    return b.translate(_LOWER)


def word_bounds(data: np.ndarray, is_space: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end offsets of the maximal runs of bytes that are no separators."""
    word = ~is_space[data]
    edge = np.flatnonzero(np.diff(np.concatenate(([False], word, [False])).astype(np.int8)))
    return edge[::2], edge[1::2]


#: Separators of words `[^\x20\x09-\x0D]+`.
SPACES = np.zeros(256, dtype=bool)
SPACES[[0x20, 9, 10, 11, 12, 13]] = True
