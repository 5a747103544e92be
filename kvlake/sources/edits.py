"""Version edits: the records of a manifest file, as tagged fields."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from kvlake.functions.coding import internal_key, prefixed, read_prefixed, read_varint, split_internal_key, varint
from kvlake.sources.wal import in_batches, log_records

#: Fixed values of the format.
COMPARATOR, LOG, NEXT_FILE, LAST_SEQUENCE, POINTER, DELETED, ADDED, PREV_LOG = 1, 2, 3, 4, 5, 6, 7, 9
_COUNTERS = {LOG: "log_number", NEXT_FILE: "next_file", LAST_SEQUENCE: "last_sequence", PREV_LOG: "prev_log_number"}


def edit_bytes(rows: list[dict]) -> bytes:
    """One edit from rows of read_edits' shape."""
    out, tags = b"", {v: k for k, v in _COUNTERS.items()}
    for r in rows:
        kind = r["kind"]
        if kind == "comparator":
            out += varint(COMPARATOR) + prefixed(r["name"].encode())
        elif kind in tags:
            out += varint(tags[kind]) + varint(r["number"])
        elif kind == "compact_pointer":
            out += varint(POINTER) + varint(r["level"]) + prefixed(internal_key(r["smallest_key"], r["smallest_seq"], 1))
        elif kind == "delete":
            out += varint(DELETED) + varint(r["level"]) + varint(r["number"])
        else:
            low, high = internal_key(r["smallest_key"], r["smallest_seq"], 1), internal_key(r["largest_key"], r["largest_seq"], 1)
            out += varint(ADDED) + varint(r["level"]) + varint(r["number"]) + varint(r["file_size"]) + prefixed(low) + prefixed(high)
    return out


def edit_rows(data: bytes) -> list[dict]:
    """Rows of one edit; ValueError if it is damaged."""
    rows, at = [], 0
    while at < len(data):
        tag, at = read_varint(data, at)
        if tag == COMPARATOR:
            name, at = read_prefixed(data, at)
            rows.append({"kind": "comparator", "name": name.decode()})
        elif tag in _COUNTERS:
            n, at = read_varint(data, at)
            rows.append({"kind": _COUNTERS[tag], "number": n})
        elif tag == POINTER:
            level, at = read_varint(data, at)
            ikey, at = read_prefixed(data, at)
            key, seq, _ = split_internal_key(ikey)
            rows.append({"kind": "compact_pointer", "level": level, "smallest_key": key, "smallest_seq": seq})
        elif tag == DELETED:
            level, at = read_varint(data, at)
            n, at = read_varint(data, at)
            rows.append({"kind": "delete", "level": level, "number": n})
        elif tag == ADDED:
            level, at = read_varint(data, at)
            n, at = read_varint(data, at)
            size, at = read_varint(data, at)
            low, at = read_prefixed(data, at)
            high, at = read_prefixed(data, at)
            (a, s, _), (b, t, _) = split_internal_key(low), split_internal_key(high)
            rows.append({"kind": "add", "level": level, "number": n, "file_size": size, "smallest_key": a, "smallest_seq": s, "largest_key": b, "largest_seq": t})
        else:
            raise ValueError("unknown tag in edit")
    return rows


SCHEMA = "file string, edit_id long, kind string, name string, level int, number long, file_size long, smallest_key binary, smallest_seq long, largest_key binary, largest_seq long, problem string"
ARROW = pa.schema([("file", pa.string()), ("edit_id", pa.int64()), ("kind", pa.string()), ("name", pa.string()), ("level", pa.int32()), ("number", pa.int64()), ("file_size", pa.int64()), ("smallest_key", pa.binary()), ("smallest_seq", pa.int64()), ("largest_key", pa.binary()), ("largest_seq", pa.int64()), ("problem", pa.string())])


def manifest_rows(file: str, data: bytes):
    for i, (_, record, problem) in enumerate(log_records(data)):
        try:
            rows = edit_rows(record) if problem is None else [{"problem": problem}]
        except ValueError as e:
            rows = [{"problem": str(e)}]
        for r in rows:
            yield {"file": file, "edit_id": i} | r


def read_manifests(spark: SparkSession, path) -> DataFrame:
    """Rows of SCHEMA from all MANIFEST files under ``path``; replay them with operators.manifest."""

    def decode(batches):
        for batch in batches:
            for name, data in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                yield from in_batches(manifest_rows(name, data.as_py()), ARROW)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "MANIFEST-*").load(path).select("path", "content")
    return files.mapInArrow(decode, SCHEMA)
