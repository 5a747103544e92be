import random
import struct

import pytest
from pyspark.sql import functions as F

from kvlake.functions.coding import internal_key
from kvlake.operators import manifest, read
from kvlake.sources import edits, formats, sstable, wal
from kvlake.sources.dump import dump_edits, dump_mutations


def batches(n, size=100):
    return [wal.batch_bytes(i + 1, [(1, b"%016d" % i, bytes([i % 251]) * size)]) for i in range(n)]


def whole(data, **more):
    return [r for _, r, p in wal.log_records(data, **more) if p is None]


@pytest.mark.parametrize("sizes", [[], [0], [5, 0, 7], [32768 - 7], [32768 - 14, 10], [32768 - 8, 3], [100_000, 1, 70_000], [32761, 32761]])
def test_log_round_trip(sizes):
    records = [bytes([i + 1]) * n for i, n in enumerate(sizes)]
    assert whole(wal.log_bytes(records)) == records
    first = wal.log_bytes(records)
    assert whole(first + wal.log_bytes([b"more"], len(first))) == [*records, b"more"]


def test_log_cut_off_at_the_end_is_silent():
    data = wal.log_bytes([b"a" * 10, b"b" * 40_000])
    for cut in (1, 5, 100, 7000):
        assert [(r, p) for _, r, p in wal.log_records(data[:-cut])] == [(b"a" * 10, None)]


def test_log_damage_costs_the_rest_of_its_block():
    records = [b"%04d" % i * 250 for i in range(100)]
    data = bytearray(wal.log_bytes(records))
    data[19] ^= 1
    out = list(wal.log_records(bytes(data)))
    assert out[0][2] == "checksum mismatch"
    got = [r for _, r, p in out if p is None]
    assert got == records[-len(got) :] and 60 <= len(got) < 100
    assert len(whole(bytes(data), verify=False)) == 100


def test_log_from_an_offset():
    records = [b"%06d" % i * 2000 for i in range(40)]
    data = wal.log_bytes(records)
    offsets = [o for o, _, _ in wal.log_records(data)]
    for start in (0, 1, 12_006, 32_768, 60_000, len(data) - 20):
        assert whole(data, start=start) == [r for o, r in zip(offsets, records) if o >= start]
    parts = [whole(data, start=a, stop=a + 65_536) for a in range(0, len(data), 65_536)]
    assert [r for p in parts for r in p] == records


def test_batches():
    ops = [(1, b"foo", b"bar"), (0, b"box", None), (1, b"", b"")]
    assert wal.batch_ops(wal.batch_bytes(100, ops)) == (100, ops)
    good = wal.batch_bytes(1, ops)
    for bad in (good[:5], good[:-1], good[:8] + struct.pack("<I", 9) + good[12:], good[:12] + b"\x07" + good[13:]):
        with pytest.raises(ValueError):
            wal.batch_ops(bad)


@pytest.mark.parametrize("restart", [1, 16, 1024])
@pytest.mark.parametrize("compress", [True, False])
@pytest.mark.parametrize("bits", [0, 10])
def test_tables(restart, compress, bits):
    rng = random.Random(restart)
    keys = sorted({bytes(rng.choice(b"ab\x00\xff") for _ in range(rng.randint(0, 6))) for _ in range(300)})
    rows = [(k, s, int(s != 2), b"" if s == 2 else bytes([s]) * rng.randint(0, 90)) for k in keys for s in (5, 2)]
    data = sstable.table_bytes(((internal_key(k, s, o), v) for k, s, o, v in rows), 256, restart, compress, bits)
    want = [(k, s, o, v if o else None) for k, s, o, v in rows]
    assert list(sstable.table_rows(data)) == want
    lo, hi = keys[40], keys[120]
    assert list(sstable.table_rows(data, True, lo, hi)) == [r for r in want if lo <= r[0] < hi]
    if bits:
        assert all(sstable.table_filter(data, k) for k in keys) and sum(sstable.table_filter(data, b"no%d" % i) for i in range(50)) < 25
    broken = bytearray(data)
    broken[10] ^= 0xFF
    with pytest.raises(ValueError):
        list(sstable.table_rows(bytes(broken)))
    left = list(sstable.table_rows(bytes(broken), skip_damage=True))
    assert 0 < len(left) < len(want) and set(left) <= set(want)
    with pytest.raises(ValueError):
        list(sstable.table_rows(data[:-1]))


def test_empty_table():
    assert list(sstable.table_rows(sstable.table_bytes([]))) == []


EDIT = [
    {"kind": "comparator", "name": "bytewise"}, {"kind": "log_number", "number": 1 << 50}, {"kind": "next_file", "number": 200}, {"kind": "last_sequence", "number": 1000},
    {"kind": "compact_pointer", "level": 2, "smallest_key": b"x", "smallest_seq": 901}, {"kind": "delete", "level": 4, "number": (1 << 40) + 7},
    {"kind": "add", "level": 3, "number": 300, "file_size": 400, "smallest_key": b"foo", "smallest_seq": 500, "largest_key": b"zoo", "largest_seq": 600},
]


def test_edits():
    assert edits.edit_rows(edits.edit_bytes(EDIT)) == EDIT
    with pytest.raises(ValueError):
        edits.edit_rows(b"\x63")


def test_files_through_spark(spark, tmp_path):
    (tmp_path / "000003.log").write_bytes(wal.log_bytes(batches(50)))
    damaged = bytearray(wal.log_bytes(batches(50)))
    damaged[30] ^= 1
    (tmp_path / "000004.log").write_bytes(bytes(damaged))
    rows = wal.read_wal(spark, str(tmp_path))
    assert rows.where("problem IS NOT NULL").count() == 1 and wal.replay(rows).count() == 50
    with pytest.raises(Exception, match="damaged"):
        wal.read_wal(spark, str(tmp_path), fail_fast=True).collect()
    (tmp_path / "000005.ldb").write_bytes(sstable.table_bytes([(internal_key(b"a", 9, 1), b"x"), (internal_key(b"b", 8, 0), b"")]))
    (tmp_path / "000006.sst").write_bytes(sstable.table_bytes([(internal_key(b"c", 7, 1), b"z")]))
    (tmp_path / "000007.sst").write_bytes(b"junk")
    with pytest.raises(Exception, match="not a table"):
        sstable.read_tables(spark, str(tmp_path)).collect()
    assert sorted(bytes(r["key"]) for r in sstable.read_tables(spark, str(tmp_path), salvage=True).collect()) == [b"a", b"b", b"c"]
    (tmp_path / "MANIFEST-000002").write_bytes(wal.log_bytes([edits.edit_bytes(EDIT), edits.edit_bytes([{"kind": "delete", "level": 3, "number": 300}])]))
    got = edits.read_manifests(spark, str(tmp_path))
    assert got.count() == 8 and manifest.live_files(got.select("edit_id", "kind", "level", "number", "file_size")).isEmpty()
    assert any("'foo' .. 'zoo'" in r["line"] for r in dump_edits(got).collect())
    lines = {r["line"] for r in dump_mutations(sstable.read_tables(spark, str(tmp_path), salvage=True)).collect()}
    assert {"'a' @ 9 : put => 'x'", "'b' @ 8 : del"} <= lines


def test_data_sources(spark, tmp_path):
    formats.register(spark)
    muts = spark.createDataFrame([(b"%03d" % i, i, 1, b"v" * 500) for i in range(200)], "key binary, seq long, op tinyint, value binary")
    shaped = lambda s: muts.selectExpr(*[c.split()[0] if c.split()[0] in muts.columns else f"CAST(NULL AS {c.split()[1]}) AS {c.split()[0]}" for c in s.split(", ")])
    shaped(wal.SCHEMA).coalesce(1).write.format("kv_wal").mode("append").save(str(tmp_path / "w"))
    back = spark.read.format("kv_wal").option("split", 32768).load(str(tmp_path / "w"))
    assert back.rdd.getNumPartitions() > 1 and sorted(r["seq"] for r in back.collect()) == list(range(200))
    shaped(sstable.SCHEMA).coalesce(2).write.format("kv_sstable").mode("append").save(str(tmp_path / "t"))
    tables = spark.read.format("kv_sstable").load(str(tmp_path / "t"))
    assert tables.count() == 200 and read.visible(tables.where("key >= X'303530'")).count() == 150
    (tmp_path / "m").mkdir()
    (tmp_path / "m/MANIFEST-000001").write_bytes(wal.log_bytes([edits.edit_bytes(EDIT)]))
    assert spark.read.format("kv_manifest").load(str(tmp_path / "m")).count() == 7


def test_overwrite_splits_and_many_files(spark, tmp_path, monkeypatch):
    formats.register(spark)
    path = str(tmp_path / "logs")
    rows = spark.range(3000).select(F.format_string("%06d", "id").cast("binary").alias("key"), (F.col("id") + 1).alias("seq"), F.lit(1).cast("byte").alias("op"), F.repeat(F.lit("v"), (F.col("id") % 97 * 40).cast("int")).cast("binary").alias("value"))
    shaped = rows.selectExpr("cast(null as string) file", "cast(null as long) offset", "key", "seq", "op", "value", "cast(null as string) problem")
    for _ in range(2):
        shaped.coalesce(1).write.format("kv_wal").mode("overwrite").save(path)
    back = spark.read.format("kv_wal").option("split", 3 * 32768).load(path)
    assert back.rdd.getNumPartitions() > 10 and back.where("problem IS NOT NULL").count() == 0
    assert sorted((r["seq"], len(r["value"])) for r in back.collect()) == [(i + 1, i % 97 * 40) for i in range(3000)]
    offsets = [r["offset"] for r in back.collect()]
    assert len(set(offsets)) == 3000
    shaped.coalesce(1).write.format("kv_wal").mode("append").save(path)
    assert spark.read.format("kv_wal").load(path).count() == 6000


def test_filters_in_parts_equal_whole_ones(spark):
    from kvlake.functions import bloom

    rows = spark.range(2000).select((F.col("id") % 3).alias("run"), F.concat(F.lit("k"), F.col("id").cast("string")).alias("key")).repartition(5)
    built = bloom.build(rows, "run", "key")
    for r in built.collect():
        keys = [f"k{i}".encode() for i in range(2000) if i % 3 == r["run"]]
        assert bytes(r["filter"]) == bloom.filter_of(keys) and r["n_keys"] == len(keys)
    asks = rows.unionByName(rows.select("run", F.concat("key", F.lit("!")).alias("key"))).unionByName(rows.select(F.lit(9).cast("long").alias("run"), "key").limit(5))
    for limit in (1 << 20, 10):
        got = {(r["run"], r["key"]): r["hit"] for r in bloom.probe(asks, built, "run", "key", limit=limit).collect()}
        assert all(v for (run, k), v in got.items() if run < 9 and not k.endswith("!")) and not any(v for (run, _), v in got.items() if run == 9)
        assert sum(v for (_, k), v in got.items() if k.endswith("!")) < 80
