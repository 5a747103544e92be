"""The mutation log as a stream: tailing logs, applying them to a store, and latest values.

The newest version of a key is a maximum over sequence numbers, so neither late nor repeated rows
change a result: no watermark is needed, and replay is harmless. State grows with the number of
keys; ``latest_stream`` keeps one row a key in the state store.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from kvlake.plans.scratch import shared_folder
from kvlake.plans.store import Store
from kvlake.schema import MUTATION, PUT
from kvlake.sources.wal import ARROW, SCHEMA, in_batches, log_rows


def stream_log(spark: SparkSession, path: str, schema=MUTATION, files_per_trigger: int = 100, pattern: str | None = None) -> DataFrame:
    """Parquet files of mutations as they arrive under ``path``."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
    return (reader.option("pathGlobFilter", pattern) if pattern else reader).parquet(path)


def stream_wal(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    """Rows of raw .log files as the files arrive."""
    content = "path string, modificationTime timestamp, length long, content binary"
    files = spark.readStream.format("binaryFile").schema(content).option("pathGlobFilter", "*.log").option("maxFilesPerTrigger", files_per_trigger).load(path)

    def decode(batches):
        for batch in batches:
            for name, data in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                yield from in_batches(log_rows(name, data.as_py()), ARROW)

    return files.select("path", "content").mapInArrow(decode, SCHEMA)


def latest_stream(muts: DataFrame) -> DataFrame:
    """(key, seq, value) of the newest version of each key so far, deletions as null values."""
    newest = muts.groupBy("key").agg(F.max_by(F.struct("seq", "op", "value"), "seq").alias("m"))
    return newest.select("key", "m.seq", "m.op", F.when(F.col("m.op") == PUT, F.col("m.value")).alias("value"))


def apply_to_store(muts: DataFrame, store: Store, checkpoint: str):
    """Start a query that adds each micro-batch of numbered mutations to a store. A batch that is tried
    again is written again, which changes no read: rows are told apart by (key, seq)."""

    def add(batch: DataFrame, _: int) -> None:
        store.ingest(batch.dropDuplicates(["key", "seq"]))

    return muts.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def run_to_memory(df: DataFrame, name: str, mode: str = "complete") -> DataFrame:
    """Run a stream over all that is there, and its result table."""
    spark = df.sparkSession
    query = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", shared_folder(spark, name)).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.table(name)
