import pytest
from pyspark.sql import functions as F

from kvlake.operators import compact, files as fs, histogram, manifest
from kvlake.operators.intervals import join_ranges

FILE = "level int, number long, file_size long, smallest_key string, largest_key string, num_entries long"


def files(spark, spans, level=1):
    return spark.createDataFrame([(level, i, 10, a, b, 1) for i, (a, b) in enumerate(spans)], FILE)


#: Four files without a key in common but for one border, and gaps of one, two and more keys between them.
DISJOINT = [("07", "13"), ("13", "21"), ("34", "40"), ("58", "63")]


@pytest.mark.parametrize("lo, hi", [(None, None), (None, "06"), (None, "07"), ("64", None), ("63", None), ("22", "33"), ("22", "34"), ("21", "33"), ("08", "09"), ("41", "57"), ("00", "99"), ("40", "58"), ("64", "65")])
def test_any_overlap(spark, lo, hi):
    """Against the definition, key by key."""
    keys = [f"{k:02d}" for k in range(100)]
    asked = {k for k in keys if (lo is None or k >= lo) and (hi is None or k <= hi)}
    assert fs.any_overlap(files(spark, DISJOINT), lo, hi) == any(a <= k <= b for k in asked for a, b in DISJOINT)


def test_overlapping_files(spark):
    f = files(spark, [("20", "80"), ("31", "44")], 0)
    assert [fs.any_overlap(f, *r) for r in (("81", "90"), ("50", "60"), ("10", "19"), ("35", "36"), ("80", "81"), ("19", "20"))] == [False, True, False, True, True, True]


def test_level_zero_grows_to_a_fixpoint(spark):
    chain = [("a", "c"), ("b", "e"), ("d", "g"), ("x", "z")]
    grown = {r["number"] for r in fs.overlapping(files(spark, chain, 0), 0, "a", "a").collect()}
    assert grown == {0, 1, 2}
    assert {r["number"] for r in fs.overlapping(files(spark, chain, 1), 1, "a", "a").collect()} == {0}


def test_find_file(spark):
    keys = spark.createDataFrame([(k,) for k in ("00", "07", "13", "14", "22", "63", "64")], "key string")
    got = {r["key"]: r["file"] for r in fs.find_file(files(spark, DISJOINT), keys, "number").collect()}
    assert got == {"00": 0, "07": 0, "13": 0, "14": 1, "22": 2, "63": 3, "64": None}
    assert fs.find_file(files(spark, []), keys, "number").where("file IS NOT NULL").isEmpty()


def test_base_level(spark):
    m = spark.createDataFrame([("a", 1, 1, "x"), ("a", 2, 0, None), ("m", 3, 0, None)], "key string, seq long, op int, value string")
    deeper = spark.createDataFrame([("k", "p")], "smallest_key string, largest_key string")
    assert [(r["key"], r["seq"]) for r in compact.retained_over(m, 10, deeper).collect()] == [("m", 3)]


def test_scores_and_picking(spark):
    rows = [(0, i, 100, "a", "z", 1) for i in range(2)] + [(1, 5, 30 * 1048576, "a", "c", 1), (2, 6, 1, "b", "d", 1)]
    f = spark.createDataFrame(rows, FILE)
    got = {r["level"]: r["score"] for r in compact.level_scores(f).collect()}
    assert got[0] == 0.5 and got[1] == 3.0 and got[3] == 0 and len(got) == 6
    assert compact.pick_level(f).first()["level"] == 1
    inputs, below = compact.pick_inputs(f, 1)
    assert [r["number"] for r in inputs.collect()] == [5] and [r["number"] for r in below.collect()] == [6]
    assert not compact.is_trivial_move(inputs, below, f.limit(0)) and compact.is_trivial_move(inputs, below.limit(0), f.limit(0))
    assert compact.flush_level(f, "e", "f") == 0 and compact.flush_level(f.where("level > 0"), "x", "z") == 2


def test_sizes(spark):
    m = spark.createDataFrame([(f"k{i}", i, 1, "x" * 9) for i in range(8)], "key string, seq long, op int, value string")
    ranges = spark.createDataFrame([(0, None, "k3"), (1, "k3", None), (2, "k5", "k5")], "range_id long, lo string, hi string")
    assert {r["range_id"]: r["n_bytes"] for r in fs.exact_sizes(m, ranges).collect()} == {0: 33, 1: 55, 2: 0}
    f = files(spark, [("k0", "k3"), ("k4", "k7")])
    assert {r["range_id"]: r["n_bytes"] for r in fs.approximate_sizes(f, ranges).collect()} == {0: 5, 1: 15, 2: 0}


def test_output_cuts(spark):
    rows = spark.createDataFrame([(f"k{i}", 0, 10) for i in range(6)], "key string, part int, size int")
    assert [r["file_no"] for r in fs.output_cuts(rows, F.col("size"), 20).orderBy("key").collect()] == [0, 0, 1, 1, 2, 2]


def test_manifest_replay(spark):
    rows = [(1, "add", 0, 7, 10), (2, "delete", 0, 7, None), (2, "add", 1, 7, 10), (3, "add", 0, 8, 5), (3, "delete", 0, 8, None), (1, "next_file", None, 3, None), (4, "next_file", None, 9, None)]
    edits = spark.createDataFrame(rows, "edit_id long, kind string, level int, number long, file_size long")
    live = manifest.live_files(edits)
    assert sorted((r["level"], r["number"]) for r in live.collect()) == [(0, 8), (1, 7)]
    assert {r["kind"]: r["number"] for r in manifest.counters(edits).collect()} == {"next_file": 9}
    listing = spark.createDataFrame([(7,), (99,)], "number long")
    assert [r["number"] for r in manifest.obsolete_files(listing, live).collect()] == [99]
    assert [r["number"] for r in manifest.missing_files(live, listing).collect()] == [8]


def test_file_names(spark):
    good = {"100.log": (100, "log"), "0.sst": (0, "table"), "5.ldb": (5, "table"), "CURRENT": (0, "current"), "LOCK": (0, "lock"), "MANIFEST-2": (2, "manifest"), "LOG": (0, "info_log"), "LOG.old": (0, "info_log"), "9223372036854775807.log": (9223372036854775807, "log"), "3.dbtmp": (3, "temp")}
    bad = ["", "foo", "foo-dx-100.log", ".log", "manifest", "CURREN", "CURRENTX", "MANIFES", "MANIFEST-", "XMANIFEST-3", "MANIFEST-3x", "LOC", "LOGx", "18446744073709551616.log", "100", "100.", "100.lop"]
    got = {r["name"]: (r["number"], r["type"]) for r in manifest.parse_names(spark.createDataFrame([(n,) for n in [*good, *bad]], "name string")).collect()}
    assert got == good | {n: (None, None) for n in bad}


def test_histogram(spark):
    assert len(histogram.LIMITS) == 154 and histogram.LIMITS[9:12] == [10.0, 12.0, 14.0] and histogram.LIMITS[-2] == 9e9
    values = [0.5, 1, 1, 5, 11, 150, 1e9, 1e12]
    df = spark.createDataFrame([(float(v),) for v in values] + [(None,)], "v double")
    got = {r["bucket"]: r["n"] for r in histogram.buckets(df, "v").collect()}
    want = {}
    for v in values:
        b = next(i for i, x in enumerate(histogram.LIMITS) if v < x)
        want[b] = want.get(b, 0) + 1
    assert got == want
    half = histogram.buckets(df.where("v < 10"), "v"), histogram.buckets(df.where("v >= 10"), "v")
    assert {r["bucket"]: r["n"] for r in histogram.merge(*half).collect()} == want
    p = {r["p"]: r["value"] for r in histogram.percentiles(df, "v", [0, 50, 100]).collect()}
    assert p[0] == 0.5 and p[100] == 1e12 and 5 <= p[50] <= 6


@pytest.mark.parametrize("limit", [100, 0])
def test_join_with_ranges_either_way(spark, limit):
    keys = spark.createDataFrame([(f"{i:03d}",) for i in range(0, 300, 2)], "key string")
    spans = [("010", "020"), ("015", "150"), (None, "003"), ("290", None), ("7", "8"), ("151", "151")]
    ranges = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(spans)], "n int, smallest_key string, largest_key string")
    want = {(k, i) for k in (f"{i:03d}" for i in range(0, 300, 2)) for i, (a, b) in enumerate(spans) if (a is None or k >= a) and (b is None or k <= b)}
    assert {(r["key"], r["n"]) for r in join_ranges(keys, ranges, limit=limit).collect()} == want
    assert {r["key"] for r in join_ranges(keys, ranges, "left_anti", limit=limit).collect()} == {r["key"] for r in keys.collect()} - {k for k, _ in want}
    assert {r["key"] for r in join_ranges(keys, ranges, "left_semi", limit=limit).collect()} == {k for k, _ in want}
