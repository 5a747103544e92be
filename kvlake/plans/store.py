"""A persistent store: sorted Parquet files of mutations in levels, and a manifest of versions.

Layout under the store's path: data/<number>/ (Parquet part files, range-partitioned by key and sorted
by key and newest first), manifest/<version>.json (what a version changes of the one before, and every
so often all live files; the last one is the store), log/<sequence>.log (small writes that no run holds
yet), LOCK. A write makes its data files first and its version file last, by a rename or link that fails
if that version is there, so readers see all of a write or nothing, and a lost race is an error rather
than a lost write. File systems that cannot do that are refused. All metadata access goes through
Hadoop's FileSystem.

Reads are the queries of operators.read over the version's files, cut down by their key bounds in the
store's order, and over the buffer of small writes. A snapshot is a sequence number that compaction
respects and vacuum keeps files for. Keys that the order holds equal are one key everywhere.
"""

from __future__ import annotations

import json
import time
from dataclasses import asdict, dataclass, field
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession, functions as F

from kvlake.functions.keys import ORDERS, Order
from kvlake.operators import compact, mutate, read
from kvlake.schema import FILE_META, LEVELS, MAX_SEQUENCE, MUTATION, PUT
from kvlake.sources import wal

BUFFER_BYTES, WHOLE_EVERY = 4 << 20, 64
#: Spark's Parquet reader holds so many entries of a row group at once. Where these could take more bytes, row groups end by bytes.
READ_ROWS, READ_BYTES = 4096, 32 << 20
#: Object stores whose rename overwrites, so that two writers could both believe to be first.
NOT_EXCLUSIVE = frozenset("s3 s3a s3n gs wasb wasbs oss cosn obs".split())


class StoreError(Exception):
    """A store that cannot be opened or used as asked."""


@dataclass
class Version:
    version: int = 0
    comparator: str = "bytewise"
    last_sequence: int = 0
    next_file: int = 1
    files: list[dict] = field(default_factory=list)
    stats: dict[str, list] = field(default_factory=dict)  # level: seconds, bytes read, bytes written
    pointers: dict[str, str] = field(default_factory=dict)  # level: key where its last compaction ended
    whole: bool = False  # write all of it at the next commit


def _account(version: Version, level: int, seconds: float, read_bytes: int, written: int) -> None:
    have = version.stats.setdefault(str(level), [0.0, 0, 0])
    version.stats[str(level)] = [have[0] + seconds, have[1] + read_bytes, have[2] + written]


def _ended_by_bytes(largest: int) -> dict[str, object]:
    """Parquet's options for row groups of about ``READ_BYTES`` before compression, where an entry has ``largest`` bytes at most.
    Parquet counts what is in pages as compressed and what is not yet as it is, so pages don't end before their row group."""
    every = max(1, READ_BYTES // 4 // largest)  # entries between two looks at the bytes
    return {
        "parquet.block.size": READ_BYTES * 3 // 4, "parquet.page.size": READ_BYTES * 2, "parquet.page.size.row.check.min": every, "parquet.page.size.row.check.max": every,
        "parquet.bloom.filter.adaptive.enabled": "true",
    }


class _Fs:
    """The few file operations a store needs, on file systems where a file can be made exclusively."""

    def __init__(self, spark: SparkSession, root: str):
        self.jvm, self.root = spark._jvm, root.rstrip("/")
        self.fs = self.path("").getFileSystem(spark._jsc.hadoopConfiguration())
        self.scheme = self.fs.getUri().getScheme()
        if self.scheme in NOT_EXCLUSIVE:
            raise StoreError(f"{self.scheme} cannot make a file exclusively, so that writers could lose each other's work")

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def exists(self, name: str) -> bool:
        return self.fs.exists(self.path(name))

    def list(self, name: str) -> list[str]:
        return sorted(s.getPath().getName() for s in self.fs.listStatus(self.path(name))) if self.exists(name) else []

    def files(self, name: str) -> set[str]:
        """All files below a folder, relative to the root; one call a folder."""
        out, rest = set(), [name]
        while rest:
            folder = rest.pop()
            for s in self.fs.listStatus(self.path(folder)) if self.exists(folder) else ():
                at = f"{folder}/{s.getPath().getName()}"
                rest.append(at) if s.isDirectory() else out.add(at)
        return out

    def create(self, name: str, data: str | bytes) -> bool:
        """Write a new file in one go: others see all of it or nothing; False if it is there."""
        temp = f"{name}.{uuid4().hex}.tmp"
        out = self.fs.create(self.path(temp), False)
        out.write(bytearray(data.encode() if isinstance(data, str) else data))
        out.close()
        done = self.rename(temp, name)
        if not done:
            self.delete(temp)
        return done

    def read(self, name: str) -> bytes:
        stream = self.fs.open(self.path(name))
        try:
            return bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
        finally:
            stream.close()

    def rename(self, old: str, new: str) -> bool:
        """False if ``new`` is there. A rename onto a file fails in distributed file systems; on local disks only a link does."""
        if self.scheme != "file":
            return not self.exists(new) and self.fs.rename(self.path(old), self.path(new))
        there, here = (self.jvm.java.nio.file.Paths.get(self.path(n).toUri().getPath(), self.jvm.java.lang.reflect.Array.newInstance(self.jvm.java.lang.Class.forName("java.lang.String"), 0)) for n in (new, old))
        try:
            self.jvm.java.nio.file.Files.createLink(there, here)
        except Exception:  # noqa: BLE001  the link is there
            if self.exists(new):
                return False
            raise
        self.delete(old)
        return True

    def delete(self, name: str) -> None:
        self.fs.delete(self.path(name), True)


class Store:
    def __init__(self, spark: SparkSession, path: str, version: Version, fs_: _Fs, owner: str, buffer_bytes: int = BUFFER_BYTES, flush_to: int = 0):
        self.spark, self.path, self.version, self._fs, self._owner = spark, path.rstrip("/"), version, fs_, owner
        self._snapshots: list[int] = []
        self._closed = False
        self._buffer: list[tuple[bytes, int, int, bytes | None]] = []  # key, seq, op, value in order of seq
        self._logs: list[str] = []
        self._buffered, self._room, self._flush_to = 0, buffer_bytes, flush_to

    # -- opening and closing -----------------------------------------------------------------------

    @classmethod
    def open(cls, spark: SparkSession, path: str, create_if_missing: bool = False, error_if_exists: bool = False, comparator: str = "bytewise", lock: bool = True, buffer_bytes: int = BUFFER_BYTES, flush_to: int = 0) -> Store:
        """``comparator`` is the name of a registered order. Small writes are logged and held in memory up to
        ``buffer_bytes`` (0: none is). A new run goes as deep as level ``flush_to`` while nothing is in its way."""
        if comparator not in ORDERS:
            raise StoreError(f"unknown comparator {comparator}")
        fs_, owner = _Fs(spark, path), uuid4().hex
        there = any(n.endswith(".json") for n in fs_.list("manifest"))
        if there and error_if_exists:
            raise StoreError(f"{path} exists")
        if not there and not create_if_missing:
            raise StoreError(f"{path} does not exist")
        if lock and not fs_.create("LOCK", owner):
            raise StoreError(f"{path} is locked")
        store = cls(spark, path, Version(comparator=comparator), fs_, owner if lock else "", buffer_bytes, flush_to)
        try:
            if there:
                store.version = store._load()
                if store.version.comparator != comparator:
                    raise StoreError(f"the store's comparator is {store.version.comparator}, not {comparator}")
                have = fs_.files("data")
                lost = [f["path"] for f in store.version.files if f["path"] not in have]
                if lost:
                    raise StoreError(f"{len(lost)} missing files, such as {lost[0]}")
                store._replay()
            else:
                store._commit(Version(comparator=comparator))
        except BaseException:
            store.close()
            raise
        return store

    def _load(self) -> Version:
        """The last whole version and the changes since, at most ``WHOLE_EVERY`` files."""
        names, changes = [n for n in self._fs.list("manifest") if n.endswith(".json")], []
        for name in reversed(names):
            changes.append(json.loads(self._fs.read(f"manifest/{name}")))
            if changes[-1].get("whole"):
                break
        else:
            raise StoreError(f"{self.path} has no whole version")
        files: dict[int, dict] = {}
        for c in reversed(changes):
            for number in c["gone"]:
                files.pop(number, None)
            files |= {f["number"]: f for f in c["files"]}
        keep = {k: v for k, v in changes[0].items() if k not in ("whole", "gone", "files")}
        return Version(files=list(files.values()), **keep)

    def _commit(self, new: Version) -> None:
        """Write what ``new`` changes, or every ``WHOLE_EVERY`` versions all of it."""
        self._live()
        new.version = self.version.version + 1
        record, old = asdict(new), {f["number"]: f for f in self.version.files}
        whole = new.version == 1 or new.version % WHOLE_EVERY == 0 or not self.version.version or new.whole
        live = {f["number"] for f in new.files}
        record |= {"whole": whole, "gone": [] if whole else [n for n in old if n not in live], "files": new.files if whole else [f for f in new.files if old.get(f["number"]) != f]}
        if not self._fs.create(f"manifest/{new.version:012d}.json", json.dumps(record)):
            raise StoreError("another writer was faster; open the store again")
        new.whole = False
        self.version = new

    def _replay(self) -> None:
        """Take in the logs of writes that no run holds yet; a log that was cut off was never acknowledged."""
        for name in self._fs.list("log"):
            rows = [r for r in wal.log_rows(name, self._fs.read(f"log/{name}")) if not r.get("problem")] if name.endswith(".log") else []
            fresh = [(r["key"], r["seq"], r["op"], r["value"]) for r in rows if r["seq"] > self.version.last_sequence]
            self._keep(fresh)
            self._logs.append(name)
        self._buffer.sort(key=lambda r: r[1])

    def _keep(self, rows: list) -> None:
        self._buffer += rows
        self._buffered += sum(len(k) + len(v or b"") + 64 for k, _, _, v in rows)

    def _live(self) -> None:
        if self._closed:
            raise StoreError("the store is closed")

    @property
    def last_sequence(self) -> int:
        return self._buffer[-1][1] if self._buffer else self.version.last_sequence

    def close(self) -> None:
        """Writes in the buffer are in logs, and are taken in when the store is opened again."""
        if not self._closed and self._owner and self._fs.exists("LOCK") and self._fs.read("LOCK").decode() == self._owner:
            self._fs.delete("LOCK")
        self._closed = True

    def __enter__(self) -> Store:
        return self

    def __exit__(self, *_) -> None:
        self.close()

    @staticmethod
    def destroy(spark: SparkSession, path: str) -> None:
        """Delete what belongs to a store, and its folder if nothing else is in it."""
        fs_ = _Fs(spark, path)
        if fs_.exists("LOCK"):
            raise StoreError(f"{path} is locked")
        for name in ("data", "manifest", "log", "lost"):
            fs_.delete(name)
        if fs_.exists("") and not fs_.list(""):
            fs_.delete("")

    # -- files ---------------------------------------------------------------------------------------

    def files(self) -> DataFrame:
        """The live files as FILE_META rows."""
        rows = [(f["level"], f["number"], f["file_size"], bytes.fromhex(f["smallest_key"]), f["smallest_seq"], bytes.fromhex(f["largest_key"]), f["largest_seq"], f["num_entries"]) for f in self.version.files]
        return self.spark.createDataFrame(rows, FILE_META)

    def _span(self, f: dict) -> tuple:
        """A file's smallest and largest key as the order compares them."""
        return self.order.value(bytes.fromhex(f["smallest_key"])), self.order.value(bytes.fromhex(f["largest_key"]))

    def _meets(self, f: dict, lo: bytes | None, hi: bytes | None) -> bool:
        first, last = self._span(f)
        return (lo is None or last >= self.order.value(lo)) and (hi is None or first <= self.order.value(hi))

    def _bounds(self, files: list[dict]) -> tuple[bytes, bytes]:
        keys = [bytes.fromhex(f[k]) for f in files for k in ("smallest_key", "largest_key")]
        return min(keys, key=self.order.value), max(keys, key=self.order.value)

    def overlapping(self, level: int, lo: bytes | None = None, hi: bytes | None = None) -> list[dict]:
        """Files of a level that meet [lo, hi]; at level 0 also those that meet what is found."""
        while True:
            found = [f for f in self.version.files if f["level"] == level and self._meets(f, lo, hi)]
            if level or not found:
                return found
            low, high = self._bounds(found)
            grown = (low if lo is not None and self.order.value(low) < self.order.value(lo) else lo, high if hi is not None and self.order.value(high) > self.order.value(hi) else hi)
            if grown == (lo, hi):
                return found
            lo, hi = grown

    def _write_run(self, muts: DataFrame, level: int, version: Version, cuts: list[bytes] = [], entry_bytes: float = 0.0, largest: int | None = None) -> list[dict]:  # noqa: B006
        """Write mutations as a sorted run; its part files' metadata. No file holds keys on both sides of a cut (a key that
        begins a file), nor, where the mean size of an entry is known, much over ``FILE_BYTES``. ``largest`` is a bound on the
        bytes of an entry's key and value; it is looked up where it isn't known."""
        folder, by = f"data/{version.next_file:08d}-{uuid4().hex[:8]}", self.order(F.col("key"))
        dealt = muts.select(F.col("key").cast("binary").alias("key"), F.col("seq").cast("long").alias("seq"), F.col("op").cast("tinyint").alias("op"), F.col("value").cast("binary").alias("value"))
        if largest is None:
            largest = dealt.agg(F.max(F.octet_length("key").cast("long") + F.coalesce(F.octet_length("value"), F.lit(0)))).first()[0] or 0
        dealt = dealt.repartitionByRange(by.alias("by")).withColumn("cut", F.lit(0) if not cuts else F.size(F.filter(F.array(*[self.order(F.lit(c)) for c in cuts]), lambda c: c <= by)))
        dealt = dealt.sortWithinPartitions("cut", by, F.desc("seq"))
        writer = dealt.write if cuts else dealt.drop("cut").write
        if entry_bytes:
            writer = writer.option("maxRecordsPerFile", max(1, int(compact.FILE_BYTES / entry_bytes)))
        if largest * READ_ROWS > READ_BYTES:
            writer = writer.options(**_ended_by_bytes(largest))
        (writer.partitionBy("cut") if cuts else writer).option("parquet.bloom.filter.enabled#key", "true").parquet(f"{self.path}/{folder}")
        return [f | {"largest_entry": largest} for f in self._describe([f"{self.path}/{folder}"], level, version)]

    def _describe(self, paths: list[str], level: int, version: Version) -> list[dict]:
        got, by = self.spark.read.schema(MUTATION).parquet(*paths), self.order(F.col("key"))
        name = F.col("_metadata.file_path")
        placed = F.struct(by.alias("by"), "key")
        meta = got.groupBy(name.alias("path"), F.col("_metadata.file_size").alias("size")).agg(
            F.min(placed)["key"].alias("lo"), F.max(placed)["key"].alias("hi"), F.min("seq").alias("s"), F.max("seq").alias("t"), F.count("*").alias("n")
        )
        out = []
        for r in sorted(meta.collect(), key=lambda r: self.order.value(bytes(r["lo"]))):  # one row a file
            rel = "data/" + r["path"].split("/data/")[-1].replace("%3D", "=")
            out.append({"level": level, "number": version.next_file, "path": rel, "file_size": r["size"], "smallest_key": bytes(r["lo"]).hex(), "smallest_seq": r["s"], "largest_key": bytes(r["hi"]).hex(), "largest_seq": r["t"], "num_entries": r["n"]})
            version.next_file += 1
        return out

    def _next(self) -> Version:
        return Version(**json.loads(json.dumps(asdict(self.version))))

    def mutations(self, lo: bytes | None = None, hi: bytes | None = None, files: list[dict] | None = None) -> DataFrame:
        """The log, from the buffer and the files whose bounds meet [lo, hi], or of some files only."""
        self._live()
        held = [f for f in self.version.files if self._meets(f, lo, hi)] if files is None else files
        fresh = [r for r in self._buffer if (lo is None or self.order.value(r[0]) >= self.order.value(lo)) and (hi is None or self.order.value(r[0]) <= self.order.value(hi))] if files is None else []
        stored = self.spark.read.schema(MUTATION).parquet(*[f"{self.path}/{f['path']}" for f in held]).select(*MUTATION.names) if held else None
        if not fresh and stored is not None:
            return stored
        rows = self.spark.createDataFrame([(bytearray(k), q, o, None if v is None else bytearray(v)) for k, q, o, v in fresh], MUTATION)
        return rows if stored is None else stored.unionByName(rows)

    # -- writing -------------------------------------------------------------------------------------

    def put(self, key: bytes, value: bytes) -> int:
        return self.write(mutate.Batch().put(key, value))

    def delete(self, key: bytes) -> int:
        return self.write(mutate.Batch().delete(key))

    def write(self, batch) -> int:
        """Apply a Batch, or a DataFrame of operations (pos, op, key, value) in order of pos, atomically; the
        last sequence number after it. A small Batch is logged and held in the buffer, without a Spark job."""
        self._live()
        if isinstance(batch, mutate.Batch):
            return self.write_many([batch])
        self.flush()
        return self.ingest(mutate.batch_mutations(batch, self.version.last_sequence + 1, ("pos",)))

    def write_many(self, batches: list[mutate.Batch]) -> int:
        """Apply some batches in order as one log record and one file: all of them are there after a crash, or none."""
        self._live()
        ops = [op for b in batches for op in b.ops]
        if not ops:
            return self.last_sequence
        size = sum(len(k) + len(v or b"") + 64 for _, k, v in ops)
        if size > self._room:
            self.flush()
            return self.ingest(mutate.batch_mutations(mutate.Batch(ops).rows(self.spark), self.version.last_sequence + 1, ("pos",)))
        first = self.last_sequence + 1
        name = f"{first:020d}.log"
        if first + len(ops) - 1 > MAX_SEQUENCE:
            raise ValueError("sequence numbers are used up")
        if not self._fs.create(f"log/{name}", wal.log_bytes([wal.batch_bytes(first, ops)])):
            raise StoreError("another writer was faster; open the store again")
        self._logs.append(name)
        self._keep([(k, first + i, op, v) for i, (op, k, v) in enumerate(ops)])
        if self._buffered > self._room:
            self.flush()
        return self.last_sequence

    def flush(self) -> int:
        """Write the buffer as a run; the number of mutations that it held. Its logs go once the run is committed."""
        rows, logs = self._buffer, self._logs
        if rows:
            self._buffer = []
            try:
                self.ingest(self.spark.createDataFrame([(bytearray(k), q, o, None if v is None else bytearray(v)) for k, q, o, v in rows], MUTATION).coalesce(1), max(len(k) + len(v or b"") for k, _, _, v in rows))
            except BaseException:
                self._buffer = rows
                raise
        self._buffered, self._logs = 0, []
        for name in logs:
            self._fs.delete(f"log/{name}")
        return len(rows)

    def ingest(self, muts: DataFrame, largest: int | None = None) -> int:
        """Add numbered mutations (key, seq, op, value) as a run. ``largest``: a bound on the bytes of an entry, where it is known."""
        self._live()
        if self._buffer:
            self.flush()
        new = self._next()
        began = time.time()
        made = self._write_run(muts, 0, new, largest=largest)
        if made:
            level = self._run_level(*self._bounds(made))
            new.files += [f | {"level": level} for f in made]
            new.last_sequence = max(new.last_sequence, *(f["largest_seq"] for f in made))
            _account(new, level, time.time() - began, 0, sum(f["file_size"] for f in made))
            self._commit(new)
        return self.version.last_sequence

    def _run_level(self, lo: bytes, hi: bytes) -> int:
        """Level of a new run: as deep as ``flush_to`` while nothing overlaps it and little does two levels below."""
        level = 0
        while level < self._flush_to and not self.overlapping(level, lo, hi) and not self.overlapping(level + 1, lo, hi):
            if self._size(self.overlapping(level + 2, lo, hi)) > compact.GRANDPARENT_FACTOR * compact.FILE_BYTES:
                break
            level += 1
        return level

    # -- reading -------------------------------------------------------------------------------------

    @property
    def order(self) -> Order:
        return ORDERS[self.version.comparator]

    def snapshot(self) -> int:
        """Pin the present state; its reads stay as they are until release."""
        self._snapshots.append(self.last_sequence)
        return self.last_sequence

    def release(self, snapshot: int) -> None:
        self._snapshots.remove(snapshot)

    def _at(self, snapshot: int | None) -> int:
        return self.last_sequence if snapshot is None else snapshot

    def get(self, key: bytes, snapshot: int | None = None) -> bytes | None:
        """The value of a key, None if absent. What the buffer or the files' bounds can tell needs no Spark job."""
        self._live()
        want, at = self.order.value(key), self._at(snapshot)
        for k, seq, op, value in reversed(self._buffer):
            if seq <= at and self.order.value(k) == want:
                return value if op == PUT else None
        held = [f for f in self.version.files if self._meets(f, key, key) and f["smallest_seq"] <= at]
        row = read.get(self.mutations(files=held), key, at, self.order).first() if held else None
        return None if row is None else bytes(row["value"])

    def multi_get(self, keys: DataFrame, snapshot: int | None = None, keep_missing: bool = False) -> DataFrame:
        return read.multi_get(self.mutations(), keys, self._at(snapshot), keep_missing, self.order)

    def scan(self, lo: bytes | None = None, hi: bytes | None = None, snapshot: int | None = None, limit: int | None = None, reverse: bool = False) -> DataFrame:
        """Live rows of [lo, hi) in order, as of now or of a snapshot, whatever is written later."""
        return read.scan(self.mutations(lo, hi), lo, hi, self._at(snapshot), limit, reverse, self.order)

    def prefix(self, prefix: bytes, snapshot: int | None = None) -> DataFrame:
        return read.prefix_scan(self.mutations(), prefix, self._at(snapshot), self.order)

    def _move(self, target: bytes | None, back: bool, strict: bool, snapshot: int | None):
        """The nearest live row from ``target`` on (from the end: None). Key ranges of files are read one after the other, each
        twice as many files as the one before, until one holds a live row."""
        self._live()
        move = (read.last if back else read.first) if target is None else (read.previous if strict else read.floor) if back else (read.next_after if strict else read.seek)
        value, want = self.order.value, None if target is None else self.order.value(target)
        keys = [bytes.fromhex(f["smallest_key" if back else "largest_key"]) for f in self.version.files]
        ahead = sorted((k for k in keys if target is None or (value(k) <= want if back else value(k) >= want)), key=value, reverse=back)
        near, at, step = target, 0, 1
        while True:
            # the last range is open: the buffer may reach beyond all files
            edge = ahead[at] if at < len(ahead) - 1 else None
            found = self.mutations(*((edge, near) if back else (near, edge)))
            by = self.order(F.col("key"))
            if edge is not None:
                found = found.where(by >= self.order(F.lit(edge)) if back else by <= self.order(F.lit(edge)))
            row = (move(found, target, self._at(snapshot), self.order) if target is not None else move(found, self._at(snapshot), self.order)).first()
            if row is not None or edge is None:
                return None if row is None else (bytes(row["key"]), bytes(row["value"]))
            near, at, step = edge, at + step, step * 2

    def first(self, snapshot: int | None = None):
        return self._move(None, False, False, snapshot)

    def last(self, snapshot: int | None = None):
        return self._move(None, True, False, snapshot)

    def seek(self, key: bytes, snapshot: int | None = None):
        return self._move(key, False, False, snapshot)

    def floor(self, key: bytes, snapshot: int | None = None):
        return self._move(key, True, False, snapshot)

    def next(self, key: bytes, snapshot: int | None = None):
        return self._move(key, False, True, snapshot)

    def previous(self, key: bytes, snapshot: int | None = None):
        return self._move(key, True, True, snapshot)

    def history(self, key: bytes) -> DataFrame:
        """(key, seq, op, value) of all stored versions of a key, newest first."""
        return read.history(self.mutations(key, key), key, self.order)

    # -- compaction ----------------------------------------------------------------------------------

    def smallest_snapshot(self) -> int:
        return min(self._snapshots, default=self.version.last_sequence)

    @staticmethod
    def _size(files: list[dict]) -> int:
        return sum(f["file_size"] for f in files)

    def compact_level(self, level: int, lo: bytes | None = None, hi: bytes | None = None) -> int:
        """Merge the files of a level that meet [lo, hi] (null bounds: all) with those below; the number of
        files that were merged or moved."""
        self._live()
        if not 0 <= level < LEVELS - 1:
            raise StoreError(f"no level below {level}")
        return self._compact_files(level, self.overlapping(level, lo, hi))

    def _compact_files(self, level: int, own: list[dict]) -> int:
        if not own:
            return 0
        began, (low, high) = time.time(), self._bounds(own)
        below = self.overlapping(level + 1, low, high)
        if below:
            own, below = self._grown(level, own, below)
            low, high = self._bounds(own + below)
        far = sorted(self.overlapping(level + 2, low, high), key=self._span) if level + 2 < LEVELS else []
        if len(own) == 1 and not below and self._size(far) <= compact.GRANDPARENT_FACTOR * compact.FILE_BYTES:
            new = self._next()
            for f in new.files:
                f["level"] += f["number"] == own[0]["number"]
            self._commit(new)
            return 1
        return self._merge(own + below, level + 1, began, compact.grandparent_cuts([(bytes.fromhex(f["smallest_key"]), f["file_size"]) for f in far]))

    def _grown(self, level: int, own: list[dict], below: list[dict]) -> tuple[list[dict], list[dict]]:
        """More files of ``level``, where they add none below and all stay under ``EXPAND_FACTOR`` files' bytes."""
        wider = self.overlapping(level, *self._bounds(own + below))
        if len(wider) > len(own) and self._size(wider + below) < compact.EXPAND_FACTOR * compact.FILE_BYTES:
            under = self.overlapping(level + 1, *self._bounds(wider))
            if len(under) == len(below):
                return wider, under
        return own, below

    def _merge(self, used: list[dict], level: int, began: float, cuts: list[bytes] = []) -> int:  # noqa: B006
        """Replace some files by what is retained of them, at ``level``."""
        new, gone = self._next(), {f["number"] for f in used}
        deeper = self.files().where(F.col("level") > level)
        kept = compact.retained_over(self.mutations(files=used), self.smallest_snapshot(), deeper, self.order).select("key", "seq", "op", "value")
        new.files = [f for f in new.files if f["number"] not in gone]
        read_bytes, entries = self._size(used), sum(f["num_entries"] for f in used)
        sizes = [f.get("largest_entry") for f in used]  # not known of files from a repair
        made = self._write_run(kept, level, new, cuts, read_bytes / max(entries, 1), None if None in sizes else max(sizes))
        new.files += made
        _account(new, level, time.time() - began, read_bytes, self._size(made))
        self._commit(new)
        return len(used)

    def compact(self, lo: bytes | None = None, hi: bytes | None = None) -> None:
        """Push everything in [lo, hi] down to the deepest level that holds any of it, at least to level 1, and
        rewrite that level once, so that deletions and covered versions go."""
        self._live()
        self.flush()
        deepest = max((f["level"] for f in self.version.files if self._meets(f, lo, hi)), default=0)
        for level in range(max(deepest, 1)):
            self.compact_level(level, lo, hi)
        last = self.overlapping(max(deepest, 1), lo, hi)
        if last:
            self._merge(last, max(deepest, 1), time.time())

    def compact_if_needed(self) -> int | None:
        """One compaction in the level with the highest score, if that is 1 or more: of the first file beyond where the
        last one in that level ended (at level 0 with all that it overlaps), then wrapping round."""
        self._live()
        score, level = compact.best_level([(f["level"], f["file_size"]) for f in self.version.files])
        if score < 1:
            return None
        here = sorted((f for f in self.version.files if f["level"] == level), key=lambda f: (self._span(f), f["number"]))
        after = self.version.pointers.get(str(level))
        start = next((f for f in here if after is None or self._span(f)[1] > self.order.value(bytes.fromhex(after))), here[0])
        own = [start] if level else self.overlapping(0, *self._bounds([start]))
        self.version.pointers[str(level)] = self._bounds(own)[1].hex()
        self._compact_files(level, own)
        return level

    def maintain(self, rounds: int = 100) -> int:
        """Compact while a level needs it; the number of compactions. Run it beside the writes of one owner, after a batch."""
        done = 0
        while done < rounds and self.compact_if_needed() is not None:
            done += 1
        return done

    def vacuum(self) -> int:
        """Delete data that no version file kept needs, and all version files but the present one."""
        self._live()
        new = self._next()
        new.whole = True
        self._commit(new)
        used = {f["path"].split("/")[1] for f in self.version.files}
        n = 0
        for name in self._fs.list("data"):
            if name not in used:
                self._fs.delete(f"data/{name}")
                n += 1
        for name in self._fs.list("manifest"):
            if name != f"{self.version.version:012d}.json":
                self._fs.delete(f"manifest/{name}")
        return n

    # -- facts ---------------------------------------------------------------------------------------

    def property(self, name: str) -> str | None:
        """num-files-at-level<N>, stats, sstables or approximate-memory-usage; None for other names."""
        if name.startswith("num-files-at-level") and name[18:].isdigit():
            level = int(name[18:])
            return str(sum(f["level"] == level for f in self.version.files)) if level < LEVELS else None
        if name == "sstables":
            lines = []
            for level in range(LEVELS):
                lines.append(f"--- level {level} ---")
                lines += [f" {f['number']}:{f['file_size']}['{f['smallest_key']}' .. '{f['largest_key']}']" for f in self.version.files if f["level"] == level]
            return "\n".join(lines)
        if name == "stats":
            rows = ["level  files  bytes  seconds  read  written"]
            for level in range(LEVELS):
                own, work = [f for f in self.version.files if f["level"] == level], self.version.stats.get(str(level))
                if own or work:
                    seconds, got, put = work or (0.0, 0, 0)
                    rows.append(f"{level:5d} {len(own):6d} {self._size(own):6d} {seconds:8.1f} {got:5d} {put:8d}")
            return "\n".join(rows)
        return str(self._buffered) if name == "approximate-memory-usage" else None

    def approximate_sizes(self, ranges: list[tuple[bytes | None, bytes | None]]) -> list[int]:
        """Estimated bytes of each [lo, hi), from file metadata only."""
        spans, value = [(*self._span(f), f["file_size"]) for f in self.version.files], self.order.value

        def offset(key: bytes | None, none: int) -> int:
            if key is None:
                return none
            k = value(key)
            return sum(size if last < k else 0 if first > k else size // 2 for first, last, size in spans)

        total = sum(size for *_, size in spans)
        return [max(0, offset(hi, total) - offset(lo, 0)) for lo, hi in ranges]

    def data_range(self) -> str:
        """The key range of every file, as text."""
        return "\n".join(f"level {f['level']} file {f['number']}: {f['smallest_key']} .. {f['largest_key']}" for f in self.version.files)

    @staticmethod
    def repair(spark: SparkSession, path: str) -> Store:
        """Build a new version from whatever data files can be read, all at level 0; unreadable ones and the
        old version files are moved to lost/."""
        fs_ = _Fs(spark, path)
        if fs_.exists("LOCK"):
            raise StoreError(f"{path} is locked")
        comparator, last = "bytewise", 0
        for name in fs_.list("manifest"):
            try:
                old = json.loads(fs_.read(f"manifest/{name}"))
                comparator, last = old["comparator"], max(last, old["version"])
            except (ValueError, KeyError):
                pass
            fs_.fs.mkdirs(fs_.path("lost"))
            fs_.rename(f"manifest/{name}", f"lost/{name}")
        fs_.create("LOCK", owner := uuid4().hex)
        store = Store(spark, path, Version(comparator=comparator, version=last), fs_, owner)
        new = store._next()
        for folder in fs_.list("data"):
            for part in fs_.list(f"data/{folder}"):
                if not part.endswith(".parquet"):
                    continue
                try:
                    new.files += store._describe([f"{store.path}/data/{folder}/{part}"], 0, new)
                except Exception:  # noqa: BLE001  a file that Spark cannot read
                    fs_.fs.mkdirs(fs_.path("lost"))
                    fs_.rename(f"data/{folder}/{part}", f"lost/{folder}-{part}")
        new.last_sequence, new.whole = max((f["largest_seq"] for f in new.files), default=0), True
        store._commit(new)
        store._replay()
        return store


