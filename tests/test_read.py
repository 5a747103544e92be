import random

import pytest
from pyspark.sql import functions as F

from kvlake.functions.keys import bracketed_number
from kvlake.operators import compact, merge, mutate, read

SCHEMA = "key string, seq long, op int, value string"


def log(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def puts(spark, text):
    """'foo=v1 bar=v2 -foo' as mutations from sequence 1."""
    rows = [(w[1:], i, 0, None) if w[0] == "-" else (*w.split("=")[:1], i, 1, w.split("=")[1]) for i, w in enumerate(text.split(), 1)]
    return log(spark, rows)


def state(df):
    return {r["key"]: r["value"] for r in df.collect()}


@pytest.mark.parametrize("text, want", [("foo=v1 bar=v2 foo=v3", {"foo": "v3", "bar": "v2"}), ("foo=v1 foo=v2 -foo", {}), ("-a", {}), ("a=x -a a=y -b", {"a": "y"})])
def test_overwrite_and_delete(spark, text, want):
    m = puts(spark, text)
    assert state(read.visible(m)) == want == state(read.visible_by_aggregate(m))


def test_snapshots(spark):
    m = puts(spark, "foo=v1 foo=v2 foo=v3 foo=v4")
    assert [state(read.visible(m, s)).get("foo") for s in (0, 1, 2, 3, 4)] == [None, "v1", "v2", "v3", "v4"]
    assert [[r["value"] for r in read.get(m, "foo", s).collect()] for s in (0, 1, 4)] == [[], ["v1"], ["v4"]]


def test_empty_value_is_live(spark):
    m = log(spark, [("", 1, 1, ""), ("c", 2, 1, "cv"), ("d", 3, 0, None)])
    assert state(read.visible(m)) == {"": "", "c": "cv"}


def test_moves(spark):
    m = puts(spark, "a=va b=vb c=vc")
    one = lambda df: [tuple(r) for r in df.select("key", "value").collect()]
    assert [one(read.seek(m, k)) for k in ("", "a", "ax", "b", "z")] == [[("a", "va")], [("a", "va")], [("b", "vb")], [("b", "vb")], []]
    assert one(read.floor(m, "bb")) == [("b", "vb")] and one(read.next_after(m, "a")) == [("b", "vb")] and one(read.previous(m, "a")) == []
    assert one(read.first(m)) == [("a", "va")] and one(read.last(m)) == [("c", "vc")]


def test_previous_skips_deleted(spark):
    assert read.previous(puts(spark, "a=va b=vb c=vc -b"), "c").first()["key"] == "a"


def test_reads_do_not_see_later_writes(spark):
    before = puts(spark, "a=va b=vb c=vc")
    last = read.last_sequence(before)
    after = before.unionByName(log(spark, [("a", 4, 1, "x"), ("a2", 5, 1, "y"), ("b", 6, 0, None)]))
    assert state(read.scan(after, snapshot=last)) == {"a": "va", "b": "vb", "c": "vc"}


def test_custom_order(spark):
    m = log(spark, [("[10]", 1, 1, "ten"), ("[0x14]", 2, 1, "twenty"), ("[0xa]", 3, 1, "TEN")])
    got = read.scan(m, order=bracketed_number).collect()
    assert [(r["key"], r["value"]) for r in got] == [("[0xa]", "TEN"), ("[0x14]", "twenty")]
    assert [r["value"] for r in read.scan(m, "[15]", order=bracketed_number).collect()] == ["twenty"]
    assert read.seek(m, "[0xb]", order=bracketed_number).first()["key"] == "[0x14]"


def test_history_and_hidden(spark):
    m = puts(spark, "foo=v1 -foo foo=v2 bar=x")
    assert [r["value"] for r in read.history(m, "foo").collect()] == ["v2", None, "v1"]
    assert sorted(r["seq"] for r in read.hidden_versions(m).collect()) == [1, 2]
    assert state(read.deleted_keys(m, 2).withColumn("value", F.col("seq"))) == {"foo": 2}


def test_key_bounds_and_snapshot_reach_the_scan(spark, tmp_path):
    path = str(tmp_path / "m")
    puts(spark, "a=1 b=2 c=3").write.parquet(path)
    plan = read.scan(spark.read.parquet(path), "b", "c", snapshot=2)._jdf.queryExecution().executedPlan().toString()
    pushed = [x for x in plan.splitlines() if "PushedFilters" in x][0]
    assert "GreaterThanOrEqual(key,b)" in pushed and "LessThan(key,c)" in pushed and "LessThanOrEqual(seq,2)" in pushed


def test_many_seeks_match_single_ones(spark):
    rng = random.Random(4)
    m = log(spark, [(f"{rng.randrange(500):04d}", i, int(rng.random() < 0.8), f"v{i}") for i in range(1, 400)])
    live = sorted(state(read.visible(m)))
    probes = spark.createDataFrame([(f"{rng.randrange(520):04d}",) for _ in range(150)], "key string")
    up = {r["probe"]: r["key"] for r in read.seek_many(m, probes).collect()}
    down = {r["probe"]: r["key"] for r in read.floor_many(m, probes).collect()}
    assert up == {p: next((k for k in live if k >= p), None) for p in up} and len(up) == probes.distinct().count()
    assert down == {p: next((k for k in reversed(live) if k <= p), None) for p in down}
    near = {r["key"]: (r["prev_key"], r["next_key"]) for r in read.neighbours(m).collect()}
    assert near == {k: (live[i - 1] if i else None, live[i + 1] if i + 1 < len(live) else None) for i, k in enumerate(live)}


def model(rows, snapshot):
    out = {}
    for k, s, op, v in sorted(rows, key=lambda r: r[1]):
        if s <= snapshot:
            out.pop(k, None)
            if op:
                out[k] = v
    return out


@pytest.mark.parametrize("seed", [301, 7])
def test_random_operations_against_a_model(spark, seed):
    rng = random.Random(seed)
    key = lambda: "".join(rng.choice("abc\0\x7f") for _ in range(rng.choice([1, 1, 2, 3])))
    rows = [(k, i, 0, None) if rng.random() < 0.45 else (k, i, 1, f"v{i}") for i, k in enumerate((key() for _ in range(600)), 1)]
    m = log(spark, rng.sample(rows, len(rows)))  # the order of input must not matter
    for s in (0, 100, 333, 600):
        assert state(read.visible(m, s)) == model(rows, s)
    kept = {base: compact.retained(m, 333, base).cache() for base in (True, False)}
    for base, small in kept.items():
        assert small.count() < len(rows)
        for s in (333, 450, 600):
            assert state(read.visible(small, s)) == model(rows, s), base
    assert {r["seq"] for r in kept[True].collect()} | {r["seq"] for r in compact.garbage(m, 333).collect()} == {r[1] for r in rows}
    got = {(r["key"], r["change"]) for r in read.diff(m, 100, 600).collect()}
    old, new = model(rows, 100), model(rows, 600)
    assert got == {(k, "added" if k not in old else "removed" if k not in new else "changed") for k in old.keys() | new.keys() if old.get(k) != new.get(k)}


def test_as_of_join(spark):
    m = puts(spark, "a=1 b=2 a=3 -a b=5")
    asks = spark.createDataFrame([("a", 0), ("a", 1), ("a", 2), ("a", 3), ("a", 4), ("b", 9), ("c", 9)], "key string, as_of long")
    got = {(r["key"], r["as_of"]): r["value"] for r in read.as_of_join(asks, m).collect()}
    assert got == {("a", 0): None, ("a", 1): "1", ("a", 2): "1", ("a", 3): "3", ("a", 4): None, ("b", 9): "5", ("c", 9): None}


def test_batches(spark):
    b = mutate.Batch().put(b"foo", b"bar").delete(b"box").put(b"baz", b"boo")
    got = sorted((bytes(r["key"]), r["op"], r["seq"]) for r in mutate.batch_mutations(b.rows(spark), 100, ("pos",)).collect())
    assert got == [(b"baz", 1, 102), (b"box", 0, 101), (b"foo", 1, 100)]
    a = mutate.Batch().put(b"a", b"va").append(mutate.Batch().put(b"b", b"vb")).append(mutate.Batch().put(b"b", b"vb").delete(b"foo"))
    got = sorted((bytes(r["key"]), r["op"], -r["seq"]) for r in mutate.batch_mutations(a.rows(spark), 200, ("pos",)).collect())
    assert got == [(b"a", 1, -200), (b"b", 1, -202), (b"b", 1, -201), (b"foo", 0, -203)]
    seen = []
    handler = type("H", (), {"put": lambda _, k, v: seen.append((k, v)), "delete": lambda _, k: seen.append(k)})()
    b.iterate(handler)
    assert seen == [(b"foo", b"bar"), b"box", (b"baz", b"boo")] and len(b) == 3


def test_sequence_over_many_partitions(spark):
    ops = spark.range(0, 5000, 1, 7).select(F.col("id").alias("batch_id"), F.lit(0).alias("pos"), F.lit(1).alias("op"), F.col("id").cast("string").alias("key"), F.lit("v").alias("value"))
    got = mutate.batch_mutations(ops.orderBy(F.rand(3)), 10).collect()
    assert sorted((int(r["key"]), r["seq"]) for r in got) == [(i, i + 10) for i in range(5000)]


def test_merge_is_idempotent(spark):
    m = puts(spark, "a=1 b=2 a=3")
    assert [(r["key"], r["seq"]) for r in merge.merge_runs(m, m.where("seq = 1"), m).collect()] == [("a", 3), ("a", 1), ("b", 2)]
    with pytest.raises(ValueError):
        merge.union_runs()


def test_multi_get(spark):
    m = puts(spark, "a=1 b=2 -b")
    keys = spark.createDataFrame([("a",), ("a",), ("b",), ("z",)], "key string")
    assert state(read.multi_get(m, keys)) == {"a": "1"}
    assert state(read.multi_get(m, keys, keep_missing=True)) == {"a": "1", "b": None, "z": None}
    assert state(read.prefix_scan(puts(spark, "ab=1 ac=2 b=3"), "a")) == {"ab": "1", "ac": "2"}
