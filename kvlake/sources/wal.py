"""The write-ahead log: records in 32 KiB blocks of checksummed fragments, and the batches in them.

A fragment is a masked CRC-32C (4 bytes), a length (2) and a type (1), then the data; less than a
header's room at a block's end is zeros. A batch is its first sequence number (8 bytes), a count (4)
and its operations. All integers are little-endian.

Reading tells damage apart: a record cut off at the end of the file is the trace of a crash and is
left out silently; a bad checksum or type costs the rest of its block and is reported.
"""

from __future__ import annotations

import struct

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from kvlake.functions.coding import crc32c, mask, prefixed, read_prefixed, unmask
from kvlake.schema import DELETE, PUT

BLOCK, HEADER = 32768, 7
ZERO, FULL, FIRST, MIDDLE, LAST = range(5)


def log_bytes(records, offset: int = 0) -> bytes:
    """A log of some records, to be appended at ``offset`` of a file."""
    out, room = bytearray(), BLOCK - offset % BLOCK
    for record in records:
        at, begun = 0, False
        while True:
            if room < HEADER:
                out += bytes(room)
                room = BLOCK
            part = record[at : at + room - HEADER]
            at += len(part)
            ended = at == len(record)
            kind = (FULL if ended else FIRST) if not begun else (LAST if ended else MIDDLE)
            out += struct.pack("<IHB", mask(crc32c(bytes([kind]) + part)), len(part), kind) + part
            room -= HEADER + len(part)
            begun = True
            if ended:
                break
    return bytes(out)


def log_records(data: bytes, verify: bool = True, start: int = 0, stop: int | None = None):
    """(offset, record, problem) in file order; record is None where a problem is told. ``start`` begins
    at the first record that begins at it or later; records that begin at ``stop`` or later are left."""
    at = start // BLOCK * BLOCK
    if start % BLOCK > BLOCK - 6:
        at += BLOCK
    held, begun, resync = bytearray(), None, at > 0
    while at + HEADER <= len(data):
        room = BLOCK - at % BLOCK
        if room < HEADER:
            at += room
            continue
        crc, size, kind = struct.unpack_from("<IHB", data, at)
        here, problem = at, None
        if kind == ZERO and size == 0:
            at += room
            continue
        if HEADER + size > room:
            if at + room >= len(data):
                return  # cut off at the end
            problem = "bad fragment length"
        elif at + HEADER + size > len(data):
            return
        elif verify and unmask(crc) != crc32c(data[at + 6 : at + HEADER + size]):
            problem = "checksum mismatch"
        elif kind > LAST:
            problem = "unknown fragment type"
        if problem:
            yield here, None, problem
            held, begun, resync = bytearray(), None, False
            at += room
            continue
        part = data[at + HEADER : at + HEADER + size]
        at += HEADER + size
        if resync and kind in (MIDDLE, LAST):
            resync = kind == MIDDLE
            continue
        resync = False
        if kind in (FULL, FIRST):
            if begun is not None:
                yield begun, None, "partial record without end"
            begun, held = here, bytearray(part)
        elif begun is None:
            yield here, None, "missing start of a record"
            continue
        else:
            held += part
        if kind in (FULL, LAST):
            if stop is not None and begun >= stop:
                return
            if begun >= start:
                yield begun, bytes(held), None
            begun = None
        elif stop is not None and begun is not None and begun >= stop:
            return


def batch_bytes(seq: int, ops) -> bytes:
    """One batch; ops are (op, key, value)."""
    body = b"".join(bytes([PUT]) + prefixed(k) + prefixed(v) if op == PUT else bytes([DELETE]) + prefixed(k) for op, k, v in ops)
    return struct.pack("<QI", seq, len(ops)) + body


def batch_ops(data: bytes) -> tuple[int, list[tuple[int, bytes, bytes | None]]]:
    """(first sequence number, operations); ValueError if the batch is damaged."""
    if len(data) < 12:
        raise ValueError("batch is too small")
    seq, count = struct.unpack_from("<QI", data)
    ops, at = [], 12
    while at < len(data):
        op = data[at]
        if op not in (PUT, DELETE):
            raise ValueError("unknown tag in batch")
        key, at = read_prefixed(data, at + 1)
        value = None
        if op == PUT:
            value, at = read_prefixed(data, at)
        ops.append((op, key, value))
    if len(ops) != count:
        raise ValueError("batch has a wrong count")
    return seq, ops


SCHEMA = "file string, offset long, key binary, seq long, op tinyint, value binary, problem string"
ARROW = pa.schema([("file", pa.string()), ("offset", pa.int64()), ("key", pa.binary()), ("seq", pa.int64()), ("op", pa.int8()), ("value", pa.binary()), ("problem", pa.string())])


def log_rows(file: str, data: bytes, verify: bool = True, start: int = 0, stop: int | None = None):
    """Mutations of a log as rows of SCHEMA; damage is a row with a problem."""
    for offset, record, problem in log_records(data, verify, start, stop):
        if problem is None:
            try:
                seq, ops = batch_ops(record)
            except ValueError as e:
                problem = str(e)
        if problem:
            yield {"file": file, "offset": offset, "problem": problem}
        else:
            for i, (op, key, value) in enumerate(ops):
                yield {"file": file, "offset": offset, "key": key, "seq": seq + i, "op": op, "value": value}


def in_batches(rows, schema: pa.Schema, size: int = 5000):
    held = []
    for r in rows:
        held.append(r)
        if len(held) == size:
            yield pa.RecordBatch.from_pylist(held, schema)
            held = []
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


def read_wal(spark: SparkSession, path, verify: bool = True, fail_fast: bool = False) -> DataFrame:
    """Rows of SCHEMA from all .log files under ``path`` (any store that Spark reaches), a task a file.
    ``fail_fast`` raises at the first damage, otherwise damage is rows with a problem."""

    def decode(batches):
        for batch in batches:
            for name, data in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                for out in in_batches(log_rows(name, data.as_py(), verify), ARROW):
                    if fail_fast and any(p is not None for p in out.column("problem").to_pylist()):
                        raise ValueError(f"damaged log {name}")
                    yield out

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.log").load(path).select("path", "content")
    return files.mapInArrow(decode, SCHEMA)


def replay(rows: DataFrame) -> DataFrame:
    """(key, seq, op, value) of the sound rows; replayed logs give the same mutations once."""
    return rows.where("problem IS NULL").select("key", "seq", "op", "value").dropDuplicates(["key", "seq"])


def as_logs(muts: DataFrame, batch_rows: int = 1000, log_bytes_each: int = 4 << 20) -> DataFrame:
    """(content, first_seq) logs of about ``log_bytes_each``, from mutations in partitions sorted by seq: runs
    of consecutive sequence numbers are batches."""

    def encode(batches):
        records, size, ops, start, first = [], 0, [], None, None

        def flush():
            return pa.RecordBatch.from_pylist([{"content": log_bytes(records), "first_seq": first}], pa.schema([("content", pa.binary()), ("first_seq", pa.int64())]))

        for batch in batches:
            for r in batch.to_pylist():
                if ops and (r["seq"] != start + len(ops) or len(ops) == batch_rows):
                    records.append(batch_bytes(start, ops))
                    size += len(records[-1])
                    first = start if first is None else first
                    ops = []
                    if size >= log_bytes_each:
                        yield flush()
                        records, size, first = [], 0, None
                start = r["seq"] if not ops else start
                ops.append((r["op"], r["key"], r["value"]))
        if ops:
            records.append(batch_bytes(start, ops))
            first = start if first is None else first
        if records:
            yield flush()

    rows = muts.select(F.col("key").cast("binary").alias("key"), "seq", F.col("op").cast("tinyint").alias("op"), F.col("value").cast("binary").alias("value"))
    return rows.repartitionByRange("seq").sortWithinPartitions("seq").mapInArrow(encode, "content binary, first_seq long")
