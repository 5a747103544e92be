"""Sorted tables: prefix-compressed blocks, an index, an optional filter, and a 48-byte footer.

A block ends with its restart places and their number, then a type byte (0 plain, 1 snappy) and a
masked CRC-32C of block and type. The footer holds the handles (offset, size) of the metaindex and
of the index.
"""

from __future__ import annotations

import struct

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from kvlake.functions import bloom
from kvlake.functions.coding import crc32c, internal_key, mask, read_varint, split_internal_key, unmask, varint
from kvlake.sources.wal import in_batches

MAGIC, FOOTER, PLAIN, SNAPPY = 0xDB4775248B80FB57, 48, 0, 1
FILTER_NAME, FILTER_BASE = "bloom2", 11


class _Block:
    def __init__(self, restart: int):
        self.every, self.out, self.places, self.n, self.last = restart, bytearray(), [0], 0, b""

    def add(self, key: bytes, value: bytes) -> None:
        same = 0
        if self.n and self.n % self.every == 0:
            self.places.append(len(self.out))
        else:
            limit = min(len(key), len(self.last))
            while same < limit and key[same] == self.last[same]:
                same += 1
        self.out += varint(same) + varint(len(key) - same) + varint(len(value)) + key[same:] + value
        self.last, self.n = key, self.n + 1

    def finish(self) -> bytes:
        return bytes(self.out) + struct.pack(f"<{len(self.places) + 1}I", *self.places, len(self.places))


def block_rows(block: bytes):
    """(key, value) in order; ValueError if damaged."""
    if len(block) < 4:
        raise ValueError("block is too small")
    (n,) = struct.unpack_from("<I", block, len(block) - 4)
    end, at, key = len(block) - 4 * (n + 1), 0, b""
    if end < 0:
        raise ValueError("bad restart count")
    while at < end:
        same, at = read_varint(block, at)
        more, at = read_varint(block, at)
        size, at = read_varint(block, at)
        if same > len(key) or at + more + size > end:
            raise ValueError("bad block entry")
        key = key[:same] + block[at : at + more]
        yield key, block[at + more : at + more + size]
        at += more + size


def table_bytes(rows, block_size: int = 4096, restart: int = 16, compress: bool = True, bits_per_key: int = 0) -> bytes:
    """A table of (internal key, value) rows in order."""
    out, index, keys, starts = bytearray(), _Block(1), [], []

    def put(block: bytes, plain: bool = False) -> bytes:
        kind, data = PLAIN, block
        if compress and not plain:
            packed = pa.compress(block, codec="snappy", asbytes=True)
            if len(packed) < len(block) - len(block) // 8:
                kind, data = SNAPPY, packed
        handle = varint(len(out)) + varint(len(data))
        out.extend(data + bytes([kind]) + struct.pack("<I", mask(crc32c(data + bytes([kind])))))
        return handle

    block, waiting = _Block(restart), None
    starts.append((0, 0))

    def flush() -> None:
        nonlocal block
        if block.n:
            index.add(block.last, put(block.finish()))
            block = _Block(restart)
            starts.append((len(out), len(keys)))

    for key, value in rows:
        if waiting is not None and key == waiting:
            raise ValueError("keys must be strictly increasing")
        waiting = key
        block.add(key, value)
        keys.append(key[:-8])
        if len(block.out) >= block_size:
            flush()
    flush()
    meta = _Block(1)
    if bits_per_key:
        meta.add(f"filter.{FILTER_NAME}".encode(), put(_filters(keys, starts, len(out), bits_per_key), True))
    tail = put(meta.finish()) + put(index.finish())
    return bytes(out) + tail.ljust(FOOTER - 8, b"\0") + struct.pack("<Q", MAGIC)


def _filters(keys: list[bytes], starts: list[tuple[int, int]], end: int, bits_per_key: int) -> bytes:
    """One filter per 2 KiB of block offsets: a block's keys are in the filter of where it begins."""
    step, groups = 1 << FILTER_BASE, {}
    for (offset, a), (_, b) in zip(starts, starts[1:]):
        groups.setdefault(offset // step, []).extend(keys[a:b])
    body, places = b"", []
    for i in range((end + step - 1) // step if keys else 0):
        places.append(len(body))
        body += bloom.filter_of(groups[i], bits_per_key) if i in groups else b""
    return body + struct.pack(f"<{len(places) + 1}I", *places, len(body)) + bytes([FILTER_BASE])


def _read_block(data: bytes, handle: bytes, verify: bool) -> bytes:
    offset, at = read_varint(handle, 0)
    size, _ = read_varint(handle, at)
    if offset + size + 5 > len(data):
        raise ValueError("block is cut off")
    raw, kind = data[offset : offset + size], data[offset + size]
    if verify and unmask(struct.unpack_from("<I", data, offset + size + 1)[0]) != crc32c(raw + bytes([kind])):
        raise ValueError("block checksum mismatch")
    if kind == PLAIN:
        return raw
    if kind == SNAPPY:
        return pa.decompress(raw, decompressed_size=read_varint(raw, 0)[0], codec="snappy", asbytes=True)
    raise ValueError("unknown block type")


def table_rows(data: bytes, verify: bool = True, lo: bytes | None = None, hi: bytes | None = None, skip_damage: bool = False):
    """(key, seq, op, value) of a table; with bounds on the user key only the blocks in between are read.
    ``skip_damage`` leaves out damaged blocks instead of raising."""
    if len(data) < FOOTER or struct.unpack("<Q", data[-8:])[0] != MAGIC:
        raise ValueError("not a table")
    foot = data[-FOOTER:]
    _, at = read_varint(foot, 0)
    _, at = read_varint(foot, at)
    for last, handle in block_rows(_read_block(data, foot[at:], verify)):
        if lo is not None and last[:-8] < lo:
            continue
        try:
            for ikey, value in block_rows(_read_block(data, handle, verify)):
                key, seq, op = split_internal_key(ikey)
                if hi is not None and key >= hi:
                    return
                if lo is None or key >= lo:
                    yield key, seq, op, value if op else None
        except ValueError:
            if not skip_damage:
                raise


def table_filter(data: bytes, key: bytes) -> bool | None:
    """Whether any filter of the table may hold the key; None if it has none."""
    foot = data[-FOOTER:]
    for name, handle in block_rows(_read_block(data, foot, True)):
        if name == f"filter.{FILTER_NAME}".encode():
            f = _read_block(data, handle, True)
            (end,) = struct.unpack_from("<I", f, len(f) - 5)
            places = struct.unpack(f"<{(len(f) - 1 - end) // 4}I", f[end:-1])
            return any(b > a and bloom.may_match(key, f[a:b]) for a, b in zip(places, places[1:]))
    return None


SCHEMA = "file string, key binary, seq long, op tinyint, value binary"
ARROW = pa.schema([("file", pa.string()), ("key", pa.binary()), ("seq", pa.int64()), ("op", pa.int8()), ("value", pa.binary())])


def read_tables(spark: SparkSession, path, verify: bool = True, lo: bytes | None = None, hi: bytes | None = None, salvage: bool = False) -> DataFrame:
    """Rows of SCHEMA from all .ldb and .sst files under ``path``, a task a file."""

    def decode(batches):
        for batch in batches:
            for name, data in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                rows = ({"file": name, "key": k, "seq": s, "op": o, "value": v} for k, s, o, v in _tried(data.as_py(), verify, lo, hi, salvage))
                yield from in_batches(rows, ARROW)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{ldb,sst}").load(path).select("path", "content")
    return files.mapInArrow(decode, SCHEMA)


def _tried(data: bytes, verify: bool, lo, hi, salvage: bool):
    try:
        yield from table_rows(data, verify, lo, hi, salvage)
    except ValueError:
        if not salvage:
            raise


def as_tables(muts: DataFrame, table_size: int = 2 << 20, bits_per_key: int = 10) -> DataFrame:
    """(content, smallest_key, largest_key, num_entries): tables of about ``table_size`` over ranges of keys."""
    meta = pa.schema([("content", pa.binary()), ("smallest_key", pa.binary()), ("largest_key", pa.binary()), ("num_entries", pa.int64())])

    def encode(batches):
        rows, size = [], 0

        def flush():
            return pa.RecordBatch.from_pylist([{"content": table_bytes(rows, bits_per_key=bits_per_key), "smallest_key": rows[0][0][:-8], "largest_key": rows[-1][0][:-8], "num_entries": len(rows)}], meta)

        for batch in batches:
            for r in batch.to_pylist():
                if size >= table_size:
                    yield flush()
                    rows, size = [], 0
                rows.append((internal_key(r["key"], r["seq"], r["op"]), r["value"] or b""))
                size += len(rows[-1][0]) + len(rows[-1][1])
        if rows:
            yield flush()

    rows = muts.select(F.col("key").cast("binary").alias("key"), "seq", F.col("op").cast("tinyint").alias("op"), F.col("value").cast("binary").alias("value"))
    return rows.repartitionByRange("key").sortWithinPartitions("key", F.desc("seq")).mapInArrow(encode, "content binary, smallest_key binary, largest_key binary, num_entries long")
