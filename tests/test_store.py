import json
import random

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from kvlake.functions.keys import ORDERS
from kvlake.operators import compact
from kvlake.operators.mutate import Batch
from kvlake.plans import store as store_module
from kvlake.plans.store import Store, StoreError
from kvlake.sources import wal
from kvlake.streaming import ingest


@pytest.fixture
def path(tmp_path):
    return str(tmp_path / "store")


def scan(store, **more):
    return [(bytes(r["key"]), bytes(r["value"])) for r in store.scan(**more).collect()]


def history(store, key):
    return [(r["seq"], bytes(r["value"]) if r["op"] else None) for r in store.history(key).collect()]


def test_open_options(spark, path):
    with pytest.raises(StoreError, match="not exist"):
        Store.open(spark, path)
    Store.open(spark, path, create_if_missing=True).close()
    with pytest.raises(StoreError, match="exists"):
        Store.open(spark, path, create_if_missing=True, error_if_exists=True)
    with pytest.raises(StoreError, match="comparator"):
        Store.open(spark, path, comparator="reverse_bytewise")
    with Store.open(spark, path) as store:
        with pytest.raises(StoreError, match="locked"):
            Store.open(spark, path)
        assert scan(store) == [] and store.get(b"foo") is None and store.first() is None
    with pytest.raises(StoreError, match="closed"):
        store.get(b"foo")


def test_life_of_a_store(spark, path):
    with Store.open(spark, path, create_if_missing=True, buffer_bytes=0) as s:
        s.put(b"foo", b"v1")
        first = s.snapshot()
        assert s.write(Batch().put(b"foo", b"v2").put(b"bar", b"b1").delete(b"none").put(b"foo", b"v3")) == 5
        s.delete(b"bar")
        s.put(b"", b"")
        assert (s.get(b"foo"), s.get(b"bar"), s.get(b""), s.get(b"foo", first)) == (b"v3", None, b"", b"v1")
        assert s.property("num-files-at-level0") == "4" and s.property("num-files-at-level9") is None and s.property("nonsense") is None
        held = s.scan()
        s.put(b"foo", b"v4")
        assert [bytes(r["value"]) for r in held.collect()] == [b"", b"v3"]
        assert history(s, b"foo") == [(s.version.last_sequence, b"v4"), (5, b"v3"), (2, b"v2"), (1, b"v1")]
        s.compact()
        assert s.property("num-files-at-level0") == "0" and s.get(b"foo", first) == b"v1"
        s.release(first)
        s.put(b"zoo", b"z")
        s.compact()
        assert [v for _, v in history(s, b"foo")] == [b"v4"] and history(s, b"bar") == []
        before = scan(s)
        assert s.vacuum() > 0 and scan(s) == before == [(b"", b""), (b"foo", b"v4"), (b"zoo", b"z")]
        assert "level" in s.property("stats") and "--- level 0 ---" in s.property("sstables") and s.data_range()
        assert s.approximate_sizes([(None, None), (b"x", b"x")])[1] == 0
    with Store.open(spark, path) as s:
        assert scan(s, reverse=True, limit=2) == [(b"zoo", b"z"), (b"foo", b"v4")]
        assert s.seek(b"g") == (b"zoo", b"z") and s.previous(b"zoo") == (b"foo", b"v4") and s.next(b"zoo") is None and s.last() == (b"zoo", b"z")
        assert [bytes(r["key"]) for r in s.prefix(b"f").collect()] == [b"foo"]
        keys = spark.createDataFrame([(bytearray(b"foo"),), (bytearray(b"no"),)], "key binary")
        assert s.multi_get(keys).count() == 1
    Store.destroy(spark, path)
    with pytest.raises(StoreError):
        Store.open(spark, path)


def test_deletions_stay_above_data(spark, path):
    with Store.open(spark, path, create_if_missing=True, buffer_bytes=0) as s:
        s.put(b"foo", b"v1")
        s.compact()
        s.compact_level(1)  # moves to level 2 by a manifest edit
        assert s.property("num-files-at-level2") == "1"
        s.delete(b"foo")
        s.compact_level(0)
        assert s.get(b"foo") is None and [v for _, v in history(s, b"foo")] == [None, b"v1"]
        s.compact()
        assert history(s, b"foo") == []


def test_races_and_missing_files(spark, path, tmp_path):
    a = Store.open(spark, path, create_if_missing=True, lock=False, buffer_bytes=0)
    b = Store.open(spark, path, lock=False, buffer_bytes=0)
    a.put(b"x", b"1")
    with pytest.raises(StoreError, match="faster"):
        b.put(b"x", b"2")
    assert Store.open(spark, path, lock=False).get(b"x") == b"1"
    import os

    os.remove(f"{path}/{a.version.files[0]['path']}")
    with pytest.raises(StoreError, match="missing"):
        Store.open(spark, path)


def test_repair(spark, path):
    with Store.open(spark, path, create_if_missing=True, buffer_bytes=0) as s:
        for i in range(3):
            s.put(b"k", b"v%d" % i)
        spoilt = s.version.files[0]["path"]
    for name in ("/" + spoilt,):
        with open(path + name, "wb") as f:
            f.write(b"junk")
    with open(f"{path}/manifest/000000000001.json", "w") as f:
        f.write("{")
    import glob
    import os

    for crc in glob.glob(f"{path}/**/.*.crc", recursive=True):
        os.remove(crc)
    with Store.repair(spark, path) as s:
        assert s.get(b"k") == b"v2" and s.version.last_sequence == 3 and s.property("num-files-at-level0") == "2"
        s.put(b"k", b"v6")
    with Store.open(spark, path) as s:
        assert s.get(b"k") == b"v6"


def test_numeric_order(spark, path):
    with Store.open(spark, path, create_if_missing=True, comparator="bracketed_number") as s:
        s.write(Batch().put(b"[10]", b"ten").put(b"[0x14]", b"twenty"))
        assert s.get(b"[0xa]") == b"ten" and s.get(b"[20]") == b"twenty" and s.get(b"[15]") is None
        assert [k for k, _ in scan(s)] == [b"[10]", b"[0x14]"]


def test_compaction_by_score(spark, path):
    with Store.open(spark, path, create_if_missing=True) as s:
        assert s.compact_if_needed() is None
        for i in range(4):
            s.put(b"a", b"%d" % i)
            s.flush()
        assert s.compact_if_needed() == 0 and s.property("num-files-at-level0") == "0" and s.get(b"a") == b"3"


def test_streams(spark, path, tmp_path):
    logs, done = tmp_path / "logs", str(tmp_path / "done")
    logs.mkdir()
    for i in range(3):
        (logs / f"{i:06d}.log").write_bytes(wal.log_bytes([wal.batch_bytes(1 + i * 2, [(1, b"a", b"%d" % i), (i % 2, b"b", b"x" if i % 2 else None)])]))
    with Store.open(spark, path, create_if_missing=True) as s:
        rows = ingest.stream_wal(spark, str(logs)).where("problem IS NULL").select("key", "seq", "op", "value")
        ingest.apply_to_store(rows, s, done).awaitTermination()
        assert s.version.last_sequence == 6 and s.get(b"a") == b"2" and s.get(b"b") is None
        (logs / "000009.log").write_bytes(wal.log_bytes([wal.batch_bytes(7, [(1, b"b", b"back")])]))
        ingest.apply_to_store(rows, s, done).awaitTermination()
        assert s.get(b"b") == b"back"
        latest = ingest.run_to_memory(ingest.latest_stream(rows), "latest_test")
        assert {bytes(r["key"]): None if r["value"] is None else bytes(r["value"]) for r in latest.collect()} == {b"a": b"2", b"b": b"back"}


def test_order_holds_through_compaction_and_every_read(spark, path):
    with Store.open(spark, path, create_if_missing=True, comparator="bracketed_number") as s:
        for key, value in ((b"[10]", b"ten"), (b"[20]", b"twenty"), (b"[3]", b"three")):
            s.put(key, value)
        pin = s.snapshot()
        s.delete(b"[0xa]")
        s.compact()
        assert s.get(b"[10]") is None and s.get(b"[0xa]") is None and s.get(b"[0xA]", pin) == b"ten"
        s.release(pin)
        s.compact()
        assert history(s, b"[10]") == [] and [k for k, _ in scan(s)] == [b"[3]", b"[20]"]
        keys = spark.createDataFrame([(bytearray(k),) for k in (b"[0x14]", b"[0x3]", b"[5]")], "key binary")
        for _ in range(2):
            assert sorted((bytes(r["key"]), bytes(r["value"])) for r in s.multi_get(keys).collect()) == [(b"[0x14]", b"twenty"), (b"[0x3]", b"three")]
            assert s.multi_get(keys, keep_missing=True).count() == 3
            s.put(b"[0x3]", b"three")
        assert s.seek(b"[4]") == (b"[20]", b"twenty") and s.previous(b"[0x14]") == (b"[0x3]", b"three") and s.last()[0] == b"[20]" and s.next(b"[20]") is None
        assert s.approximate_sizes([(b"[0]", b"[0x100]")])[0] > 0 == s.approximate_sizes([(b"[100]", b"[200]")])[0]
        assert [bytes(r["key"]) for r in s.prefix(b"[0x").collect()] == [b"[0x3]"]


@pytest.mark.parametrize("name", sorted(ORDERS))
def test_random_histories_in_every_order(spark, path, name):
    rng, order = random.Random(11), ORDERS[name]
    model, pins = {}, []
    form = (lambda i: b"[%d]" % i, lambda i: b"[0x%x]" % i) if name == "bracketed_number" else (lambda i: b"k%02d" % i, lambda i: b"k%02d" % i)
    with Store.open(spark, path, create_if_missing=True, comparator=name, buffer_bytes=1500, flush_to=2) as s:
        for step in range(60):
            key = rng.choice(form)(rng.randrange(12))
            if rng.random() < 0.3:
                s.delete(key)
                model.pop(order.value(key), None)
            else:
                s.put(key, b"%d" % step)
                model[order.value(key)] = b"%d" % step
            if step in (20, 40):
                pins.append((s.snapshot(), dict(model)))
            if step in (30, 50):
                s.compact()
            if step == 45:
                s.flush()
                s.compact_if_needed()
        live = scan(s)
        assert [order.value(k) for k, _ in live] == sorted(model) and {order.value(k): v for k, v in live} == model
        for pin, then in pins:
            assert {order.value(k): v for k, v in scan(s, snapshot=pin)} == then
            for i in range(0, 12, 5):
                assert s.get(form[1](i), pin) == then.get(order.value(form[1](i)))
        assert s.first() == live[0] and s.last() == live[-1]
    with Store.open(spark, path, comparator=name) as s:
        assert scan(s) == live


def test_buffer_log_and_group_commit(spark, path):
    with Store.open(spark, path, create_if_missing=True) as s:
        assert s.put(b"a", b"1") == 1 and s.write_many([Batch().put(b"b", b"2").delete(b"a"), Batch().put(b"c", b"3")]) == 4
        assert s.get(b"a") is None and s.get(b"a", 1) == b"1" and s.get(b"c") == b"3" and s.get(b"zz") is None
        assert int(s.property("approximate-memory-usage")) > 0 and s.property("num-files-at-level0") == "0"
        assert scan(s) == [(b"b", b"2"), (b"c", b"3")] and s.seek(b"bb") == (b"c", b"3")
    with Store.open(spark, path) as s:  # the logs are taken in
        assert scan(s) == [(b"b", b"2"), (b"c", b"3")] and s.put(b"d", b"4") == 5
        assert s.flush() == 5 and s.property("approximate-memory-usage") == "0" and s._fs.list("log") == []
        assert scan(s) == [(b"b", b"2"), (b"c", b"3"), (b"d", b"4")]
        s.put(b"e", b"x" * (5 << 20))  # more than the buffer holds
        assert s.last()[0] == b"e" and s.property("num-files-at-level0") != "0"


def test_manifests_are_changes(spark, path, monkeypatch):
    monkeypatch.setattr(store_module, "WHOLE_EVERY", 4)
    with Store.open(spark, path, create_if_missing=True, buffer_bytes=0) as s:
        for i in range(6):
            s.put(b"%d" % i, b"v")
        sizes = [len(json.loads(s._fs.read(f"manifest/{n}"))["files"]) for n in s._fs.list("manifest")]
        assert sizes == [0, 1, 1, 3, 1, 1, 1]
    with Store.open(spark, path) as s:
        assert len(s.version.files) == 6 and len(scan(s)) == 6


def test_cuts_and_levels(spark, path, monkeypatch):
    assert compact.grandparent_cuts([(b"a", 5), (b"b", 5), (b"c", 5), (b"d", 20), (b"e", 1)], 10) == [b"c", b"d", b"e"] and compact.grandparent_cuts([]) == []
    assert compact.best_level([(0, 1)] * 6 + [(1, 10 << 20)]) == (1.5, 0) and compact.best_level([]) == (0.0, 0)
    monkeypatch.setattr(compact, "FILE_BYTES", 300)
    with Store.open(spark, path, create_if_missing=True, buffer_bytes=0, flush_to=2) as s:
        s.write(Batch([(1, b"%03d" % i, b"x" * 20) for i in range(0, 200)]))
        assert {f["level"] for f in s.version.files} == {2}
        s.write(Batch([(1, b"%03d" % i, b"y" * 20) for i in range(0, 200, 2)]))
        assert s.property("num-files-at-level0") != "0"
        s.compact_level(0)
        one = [f for f in s.version.files if f["level"] == 1]
        assert len(one) > 1 and max(f["num_entries"] for f in one) < 100
        assert sum(v == b"y" * 20 for _, v in scan(s)) == 100 and len(scan(s)) == 200


def test_stores_without_exclusive_files_are_refused(spark):
    assert "s3a" in store_module.NOT_EXCLUSIVE and "hdfs" not in store_module.NOT_EXCLUSIVE


def test_readers_never_hold_many_large_entries_at_once(spark, path):
    """Spark's reader takes up to 4,096 entries of a row group together: of 1 MB each, 60 were in one row group."""
    big, most = 1 << 20, (32 << 20) // (1 << 20)

    def rows_at_once(s):
        groups = [pq.ParquetFile(f"{path}/{f['path']}").metadata for f in s.version.files]
        return max(m.row_group(i).num_rows for m in groups for i in range(m.num_row_groups))

    def sizes(s):
        return [(bytes(r["key"]), r["n"]) for r in s.scan().select("key", F.octet_length("value").alias("n")).collect()]

    rows = spark.range(60).select(F.format_string("%02d", "id").alias("key"), (F.col("id") + 1).alias("seq"), F.lit(1).alias("op"), F.rpad(F.col("id").cast("string"), big, "ab").alias("value"))
    want = [(b"%02d" % i, big) for i in range(60)]
    with Store.open(spark, path, create_if_missing=True, buffer_bytes=64 << 20) as s:
        s.ingest(rows.coalesce(1))
        assert rows_at_once(s) < most and sizes(s) == want
        s.compact()
        assert rows_at_once(s) < most and sizes(s) == want
        s.write(Batch([(1, b"%02d" % i, b"y" * big) for i in range(40)]))
        assert s.flush() == 40 and rows_at_once(s) < most and sizes(s) == want
    with Store.repair(spark, path) as s:
        s.compact()
        assert rows_at_once(s) < most and sizes(s) == want


def test_small_entries_keep_large_row_groups(spark, path):
    rows = spark.range(9000).select(F.format_string("%05d", "id").alias("key"), (F.col("id") + 1).alias("seq"), F.lit(1).alias("op"), F.lit("v").alias("value"))
    with Store.open(spark, path, create_if_missing=True) as s:
        s.ingest(rows.coalesce(1))
        assert all(pq.ParquetFile(f"{path}/{f['path']}").metadata.num_row_groups == 1 for f in s.version.files)
        assert {f["largest_entry"] for f in s.version.files} == {6}


def test_one_large_entry_leaves_the_others_together(spark, path):
    value = F.when(F.col("id") == 9000, F.rpad(F.lit("x"), 9 << 20, "ab")).otherwise("v")
    rows = spark.range(18000).select(F.format_string("%05d", "id").alias("key"), (F.col("id") + 1).alias("seq"), F.lit(1).alias("op"), value.alias("value"))
    with Store.open(spark, path, create_if_missing=True) as s:
        s.ingest(rows.coalesce(1))
        groups = [pq.ParquetFile(f"{path}/{f['path']}").metadata.num_row_groups for f in s.version.files]
        assert sum(groups) <= len(groups) + 1 and s.scan().agg(F.sum(F.octet_length("value"))).first()[0] == (9 << 20) + 17999
