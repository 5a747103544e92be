"""Bloom filters per run, bit-exact with the raw tables' filter blocks.

A filter is built in parts: each task marks the places of its own keys, and the parts of a run are or-ed,
so no run's keys ever meet in one task; only filters (``bits_per_key`` bits a key) do.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from kvlake.functions.coding import hash32, hash32_column


def probes(bits_per_key: int) -> int:
    return max(1, min(30, int(bits_per_key * 0.69)))


def _places(h: int, k: int, bits: int):
    delta = (h >> 17 | h << 15) & 0xFFFFFFFF
    for _ in range(k):
        yield h % bits
        h = (h + delta) & 0xFFFFFFFF


def filter_of(keys: list[bytes], bits_per_key: int = 10) -> bytes:
    """The filter of a small list of keys: bits, then one byte with the number of probes."""
    size, k = (max(64, len(keys) * bits_per_key) + 7) // 8, probes(bits_per_key)
    out = bytearray(size)
    for key in keys:
        for p in _places(hash32(key), k, size * 8):
            out[p >> 3] |= 1 << (p & 7)
    return bytes(out) + bytes([k])


def may_match(key: bytes, filt: bytes) -> bool:
    """No false negatives. Filters too short say no; more than 30 probes means an unknown kind: yes."""
    if len(filt) < 2:
        return False
    k, bits = filt[-1], (len(filt) - 1) * 8
    return k > 30 or all(filt[p >> 3] >> (p & 7) & 1 for p in _places(hash32(key), k, bits))


def _mark(bits: np.ndarray, h: np.ndarray, k: int) -> None:
    """Set the ``k`` places of each hash in an array of one byte a bit."""
    h, delta = h.astype(np.uint32), (h.astype(np.uint32) >> np.uint32(17)) | (h.astype(np.uint32) << np.uint32(15))
    for _ in range(k):
        bits[h % np.uint32(len(bits))] = 1
        h = h + delta


def build(rows: DataFrame, run: str, key: str, bits_per_key: int = 10) -> DataFrame:
    """(run, n_keys, filter) over the distinct keys of every run. Each task makes a filter of its own keys of a run, of the size
    that the run's count asks for, and these are or-ed: no list of places or keys is ever gathered."""
    k = probes(bits_per_key)
    keys = rows.select(F.col(run).alias("run"), F.col(key).cast("binary").alias("k")).distinct()
    sizes = keys.groupBy("run").agg(F.count("*").alias("n_keys")).withColumn("size", F.floor((F.greatest(F.lit(64), F.col("n_keys") * bits_per_key) + 7) / 8))
    hashed = keys.select("run", hash32_column(F.col("k")).alias("h")).join(sizes, "run").select(F.struct("run", "n_keys", "size").alias("r"), "h")
    shape = hashed.schema["r"].dataType.simpleString()

    def mark(batches):
        have: dict = {}
        for batch in batches:
            rows_, h = batch.column("r"), batch.column("h").to_numpy(zero_copy_only=False)
            coded = rows_.field("run").dictionary_encode()
            codes = coded.indices.to_numpy(zero_copy_only=False)
            for code in np.unique(codes):
                at = np.flatnonzero(codes == code)
                r = rows_[int(at[0])].as_py()
                bits = have.setdefault(r["run"], (r, np.zeros(r["size"] * 8, np.uint8)))[1]
                _mark(bits, h[at], k)
        for r, bits in have.values():
            yield pa.RecordBatch.from_arrays([pa.array([r], out_type), pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())], ["r", "part"])

    out_type = to_arrow_type(hashed.schema["r"].dataType)

    @F.arrow_udf("binary")
    def ored(parts: pa.Array) -> pa.Array:
        return pa.array([np.bitwise_or.reduce([np.frombuffer(p, np.uint8) for p in row]).tobytes() + bytes([k]) for row in parts.to_pylist()], pa.binary())

    partial = hashed.mapInArrow(mark, f"r {shape}, part binary")
    return partial.groupBy("r").agg(F.collect_list("part").alias("parts")).select(F.col("r.run").alias(run), "r.n_keys", ored("parts").alias("filter"))


def probe(rows: DataFrame, filters: DataFrame, run: str, key: str, hit: str = "hit", limit: int = 256 << 20) -> DataFrame:
    """``rows`` with ``hit``: whether their key may be in their run, by ``filters`` (run, n_keys, filter) as of ``build``; false for
    runs without a filter. Filters of at most ``limit`` bytes in all are sent to every task once; more of them are
    joined to the rows of their run."""
    spark = rows.sparkSession
    if (filters.agg(F.sum(F.length("filter"))).first()[0] or 0) > limit:
        @F.arrow_udf("boolean")
        def joined(keys: pa.Array, found: pa.Array) -> pa.Array:
            return pa.array([f is not None and may_match(x, f) for x, f in zip(keys.to_pylist(), found.to_pylist(), strict=True)], pa.bool_())

        return rows.join(filters.select(run, "filter"), run, "left").withColumn(hit, joined(F.col(key).cast("binary"), F.col("filter"))).drop("filter")
    sent = spark.sparkContext.broadcast({r[0]: bytes(r[1]) for r in filters.select(run, "filter").collect()})

    @F.arrow_udf("boolean")
    def asked(runs: pa.Array, keys: pa.Array) -> pa.Array:
        return pa.array([r in sent.value and may_match(x, sent.value[r]) for r, x in zip(runs.to_pylist(), keys.to_pylist(), strict=True)], pa.bool_())

    return rows.withColumn(hit, asked(F.col(run), F.col(key).cast("binary")))
