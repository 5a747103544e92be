"""The raw formats as Spark data sources: spark.read.format("kv_wal" | "kv_sstable" | "kv_manifest").

These read and write files on mounted file systems; ``read_wal``, ``read_tables`` and
``read_manifests`` read any store that Spark reaches. Logs are split at block borders into partitions
of ``split`` bytes: a partition takes the records that begin in it. Tables push key bounds down to
their index blocks.
"""

from __future__ import annotations

import os
import uuid
from glob import glob
from itertools import islice

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage

from kvlake.functions.coding import internal_key
from kvlake.sources import edits, sstable, wal


FILE_ROWS = 500_000


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def _files(path: str, *patterns: str) -> list[str]:
    path = path.removeprefix("file://").removeprefix("file:")
    return [path] if os.path.isfile(path) else sorted(f for p in patterns for f in glob(os.path.join(path, p)))


class _Part(InputPartition):
    def __init__(self, file: str, start: int = 0, stop: int | None = None):
        super().__init__((file, start, stop))


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.options = options

    def rows(self, file: str, data: bytes, start: int, stop: int | None):
        raise NotImplementedError

    def read(self, partition):
        file, start, stop = partition.value
        with open(file, "rb") as f:
            data = f.read()
        for r in self.rows(file, data, start, stop):
            yield tuple(r.get(c) for c in self.columns)


class WalReader(_Reader):
    columns = _names(wal.SCHEMA)

    def partitions(self):
        split = int(self.options.get("split", 64 << 20)) // wal.BLOCK * wal.BLOCK or wal.BLOCK  # on block borders
        return [_Part(f, a, a + split) for f in _files(self.options["path"], "*.log") for a in range(0, max(1, os.path.getsize(f)), split)]

    def read(self, partition):
        """Only the split's own blocks are read, the one before for its place, and what its last record still takes."""
        file, start, stop = partition.value
        base = max(0, start - wal.BLOCK)
        with open(file, "rb") as f:
            end = self.record_end(f, stop)
            f.seek(base)
            data = f.read(end - base)
        for r in wal.log_rows(file, data, self.options.get("verify", "true") == "true", start - base, stop - base):
            yield tuple((r | {"offset": r["offset"] + base}).get(c) for c in self.columns)

    @staticmethod
    def record_end(f, at: int) -> int:
        """The end of the record that goes on at ``at``, a block border, by its fragments' headers."""
        size = f.seek(0, os.SEEK_END)
        while at < size:
            room = wal.BLOCK - at % wal.BLOCK
            if room >= wal.HEADER:
                f.seek(at)
                head = f.read(wal.HEADER)
                if len(head) < wal.HEADER or head[6] not in (wal.MIDDLE, wal.LAST):
                    return at
                at += min(room, wal.HEADER + int.from_bytes(head[4:6], "little"))
                if head[6] == wal.LAST:
                    return min(at, size)
            else:
                at += room
        return size


class TableReader(_Reader):
    columns = _names(sstable.SCHEMA)

    def __init__(self, options):
        super().__init__(options)
        self.lo = self.hi = None

    def pushFilters(self, filters):
        for f in filters:
            if getattr(f, "attribute", None) == ("key",) and isinstance(getattr(f, "value", None), (bytes, bytearray)):
                v = bytes(f.value)
                if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual)):
                    self.lo = v if self.lo is None else max(self.lo, v)
                if isinstance(f, (EqualTo, LessThanOrEqual)):
                    v += b"\0"
                if isinstance(f, (EqualTo, LessThan, LessThanOrEqual)):
                    self.hi = v if self.hi is None else min(self.hi, v)
            yield f  # Spark tests every row again

    def partitions(self):
        return [_Part(f) for f in _files(self.options["path"], "*.ldb", "*.sst")]

    def rows(self, file, data, start, stop):
        for k, s, o, v in sstable.table_rows(data, self.options.get("verify", "true") == "true", self.lo, self.hi, self.options.get("salvage", "false") == "true"):
            yield {"file": file, "key": k, "seq": s, "op": o, "value": v}


class ManifestReader(_Reader):
    columns = _names(edits.SCHEMA)

    def partitions(self):
        return [_Part(f) for f in _files(self.options["path"], "MANIFEST-*")]

    def rows(self, file, data, start, stop):
        return edits.manifest_rows(file, data)


class _Message(WriterCommitMessage):
    def __init__(self, made: list[tuple[str, str]]):
        self.made = made


class _Writer(DataSourceWriter):
    """Task files, of at most ``FILE_ROWS`` rows each, are written under temporary names and renamed at commit."""

    suffix = ""

    def __init__(self, options, overwrite: bool):
        self.path, self.overwrite = options["path"].removeprefix("file://").removeprefix("file:"), overwrite

    def content(self, rows) -> bytes:
        raise NotImplementedError

    def write(self, iterator):
        made = []
        while rows := [r.asDict() for r in islice(iterator, FILE_ROWS)]:
            os.makedirs(self.path, exist_ok=True)
            temp = os.path.join(self.path, f"{uuid.uuid4().hex}.dbtmp")
            with open(temp, "wb") as f:
                f.write(self.content(rows))
            made.append((temp, self.suffix))
        return _Message(made)

    def commit(self, messages):
        if self.overwrite:
            for old in _files(self.path, f"*.{self.suffix}") if os.path.isdir(self.path) else ():
                os.remove(old)
        taken = [int(x.split(".")[0]) for x in os.listdir(self.path) if x.split(".")[0].isdigit()] if os.path.isdir(self.path) else []
        number = max(taken, default=0)
        for m in messages:
            for temp, suffix in m.made if m else []:
                number += 1
                os.replace(temp, os.path.join(self.path, f"{number:06d}.{suffix}"))

    def abort(self, messages):
        for m in messages:
            for temp, _ in m.made if m else []:
                os.remove(temp)


class WalWriter(_Writer):
    suffix = "log"

    def content(self, rows):
        rows.sort(key=lambda r: r["seq"])
        return wal.log_bytes(wal.batch_bytes(r["seq"], [(r["op"], bytes(r["key"]), None if r["value"] is None else bytes(r["value"]))]) for r in rows)


class TableWriter(_Writer):
    suffix = "ldb"

    def content(self, rows):
        rows.sort(key=lambda r: (bytes(r["key"]), -r["seq"]))
        return sstable.table_bytes(((internal_key(bytes(r["key"]), r["seq"], r["op"]), bytes(r["value"] or b"")) for r in rows), bits_per_key=10)


class _Source(DataSource):
    def reader(self, schema):
        return self.reads(self.options)

    def writer(self, schema, overwrite):
        return self.writes(self.options, overwrite)


class WalSource(_Source):
    reads, writes = WalReader, WalWriter

    @classmethod
    def name(cls):
        return "kv_wal"

    def schema(self):
        return wal.SCHEMA


class TableSource(_Source):
    reads, writes = TableReader, TableWriter

    @classmethod
    def name(cls):
        return "kv_sstable"

    def schema(self):
        return sstable.SCHEMA


class ManifestSource(_Source):
    reads = ManifestReader

    @classmethod
    def name(cls):
        return "kv_manifest"

    def schema(self):
        return edits.SCHEMA


def register(spark: SparkSession) -> None:
    """Make the three formats known to a session, with filter pushdown to Python sources."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    for source in (WalSource, TableSource, ManifestSource):
        spark.dataSource.register(source)
