"""Writes as rows: atomic batches and the sequence numbers of their operations.

A batch is an ordered list of puts and deletes; the i-th operation of all batches in order gets the
next sequence number plus i, so a later operation on a key wins. A global row_number() would run in
one task. Instead rows are range-partitioned by their order, every task numbers its own rows, and
the tasks' offsets, one number a task, are added.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from kvlake.plans.scratch import pinned
from kvlake.schema import DELETE, MAX_SEQUENCE, PUT

OP = T.StructType([T.StructField("pos", T.LongType()), T.StructField("op", T.ByteType()), T.StructField("key", T.BinaryType()), T.StructField("value", T.BinaryType())])


class Batch:
    """Builder of one atomic batch, in call order."""

    def __init__(self, ops: list[tuple[int, bytes, bytes | None]] = ()):
        self.ops: list[tuple[int, bytes, bytes | None]] = list(ops)

    def put(self, key: bytes, value: bytes) -> Batch:
        self.ops.append((PUT, bytes(key), bytes(value)))
        return self

    def delete(self, key: bytes) -> Batch:
        self.ops.append((DELETE, bytes(key), None))
        return self

    def clear(self) -> None:
        self.ops.clear()

    def append(self, other: Batch) -> Batch:
        """The operations of another batch after this one's."""
        self.ops += other.ops
        return self

    def iterate(self, handler) -> None:
        """Call handler.put(key, value) or handler.delete(key) for each operation in order."""
        for op, key, value in self.ops:
            handler.put(key, value) if op == PUT else handler.delete(key)

    def __len__(self) -> int:
        return len(self.ops)

    def rows(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(i, *o[:2], o[2]) for i, o in enumerate(self.ops)], OP)


def number_rows(rows: DataFrame, order: Sequence[str], base: int) -> DataFrame:
    """``rows`` with seq = base + place in ``order`` (from 0)."""
    dealt = pinned(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_m", F.monotonically_increasing_id()))
    part, place = F.shiftright("_m", 33), F.col("_m").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = [tuple(r) for r in dealt.groupBy(part.alias("p")).count().orderBy("p").collect()]  # one row a task
    starts, at = [], base
    for p, n in sizes:
        starts.append((p, at))
        at += n
    if at - 1 > MAX_SEQUENCE:
        raise ValueError("sequence numbers are used up")
    offsets = rows.sparkSession.createDataFrame(starts, "_p long, _start long")
    return dealt.join(F.broadcast(offsets), part == F.col("_p")).withColumn("seq", F.col("_start") + place).drop("_m", "_p", "_start")


def batch_mutations(ops: DataFrame, base: int, order: Sequence[str] = ("batch_id", "pos")) -> DataFrame:
    """(key, seq, op, value) of operations in batch order; deletes carry no value."""
    value = F.when(F.col("op") == PUT, F.col("value"))
    return number_rows(ops, order, base).select("key", "seq", F.col("op").cast("tinyint").alias("op"), value.alias("value"))


def overwritten(ops: DataFrame, batch: str = "batch_id") -> DataFrame:
    """The operation that wins for each key of each batch: the last."""
    return ops.groupBy(batch, "key").agg(F.max_by(F.struct("pos", "op", "value"), "pos").alias("w")).select(batch, "key", "w.pos", "w.op", "w.value")
