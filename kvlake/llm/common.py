"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import contextlib
import ctypes

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F


_ARROW_DEFAULT, _ARROW_BYTES = "67108864b", "4m"


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder the cluster names in ``spark.checkpoint.dir``; only where that is unset
    (tests, a laptop) fall back to a folder beside the warehouse."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        sc.setCheckpointDir(named or spark.conf.get("spark.sql.warehouse.dir") + "/_checkpoints")


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder; survives lost executors."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder on whatever file system it is."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, base: str) -> str:
    """A column name that ``df`` does not have yet."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base += "_"
    return base


def id_crc(doc_id: Column | str) -> Column:
    """crc32 of the id as text: the fold key of labelled rows."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary") if isinstance(doc_id, str) else doc_id.cast("string").cast("binary"))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, fold: Column, max_rows: int, max_chars: int) -> pa.Table:
    """Texts and labels of at most ``max_rows`` labelled documents, picked by hash of the id.

    Both bounds are documented parameters of the classifiers that call this: documents over
    ``max_chars`` are left out of the training sample only, and are scored whole like any other.
    The picked ids are at most ``max_rows`` rows, which is why they may be broadcast. An id that is
    labelled both ways is left out; an id with several texts gives the smallest, so that at most
    ``max_rows`` texts reach the driver.
    """
    picked = (
        labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & fold)
        .groupBy("doc_id")
        .agg(F.min(label).cast("int").alias("y"), F.max(label).cast("int").alias("z"))
        .where("y = z")
        .select("doc_id", "y")
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(max_rows)
    )
    texts = docs.select("doc_id", "text").where(F.col("text").isNotNull() & (F.length("text") <= max_chars))
    got = texts.join(F.broadcast(picked), "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text")).select("doc_id", "text", "y").toArrow()
    return got.sort_by([("doc_id", "ascending"), ("text", "ascending")])


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column laid end to end, and n + 1 offsets; a null counts as empty."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def bounded_batches() -> None:
    """Bound Arrow batches by bytes: ten thousand rows of long texts would not fit. A session's own
    setting, if it is not the default, stays."""
    spark, name = SparkSession.getActiveSession(), "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark is not None and spark.conf.get(name, None) == _ARROW_DEFAULT:
        spark.conf.set(name, _ARROW_BYTES)


def give_back() -> None:
    """Hand memory that this worker process has freed back to the system, where the C library can."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def slices(column: pa.Array, max_bytes: int = 250_000):
    """Consecutive slices of a string column of about ``max_bytes`` each (one value at least)."""
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    at = 0
    while at < len(column):
        to = int(np.searchsorted(offsets, offsets[at] + max_bytes, side="right")) - 1
        to = min(max(to, at + 1), len(column))
        yield column.slice(at, to - at)
        at = to
