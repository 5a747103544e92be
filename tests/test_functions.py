import random

import pytest
from pyspark.sql import functions as F

from kvlake.functions import bloom, coding, keys


def test_hash_goldens():
    cases = {b"": "bc9f1d34", b"\x62": "ef1345c4", b"\xc3\x97": "5b663814", b"\xe2\x99\xa5": "323c078f", b"\xe1\x80\xb9\x32": "ed21633a"}
    assert {k: f"{coding.hash32(k):08x}" for k in cases} == cases


def test_crc_goldens():
    cases = [(b"\0" * 32, "8a9136aa"), (b"\xff" * 32, "62a8ab43"), (bytes(range(32)), "46dd794e"), (bytes(range(31, -1, -1)), "113fdb5c")]
    assert all(f"{coding.crc32c(d):08x}" == c for d, c in cases)
    assert coding.crc32c(b"world", coding.crc32c(b"hello ")) == coding.crc32c(b"hello world")
    crc = coding.crc32c(b"foo")
    assert coding.mask(crc) != crc and coding.unmask(coding.mask(crc)) == crc


def test_varints():
    for n in [0, 1, 127, 128, 300, 2**32 - 1, 2**63 - 1, *(1 << k for k in range(63))]:
        data = coding.varint(n)
        assert coding.read_varint(data + b"\x01", 0) == (n, len(data))
        if len(data) > 1:
            with pytest.raises(ValueError):
                coding.read_varint(data[:-1], 0)
    assert coding.read_prefixed(coding.prefixed(b"foo"), 0) == (b"foo", 4)


def test_internal_keys():
    assert coding.split_internal_key(coding.internal_key(b"foo", 100, 1)) == (b"foo", 100, 1)
    for bad in (b"short", b"foo" + b"\x02" + b"\0" * 7):
        with pytest.raises(ValueError):
            coding.split_internal_key(bad)


def test_separators():
    assert keys.shortest_separator(b"foo", b"hello") == b"g"
    assert keys.shortest_separator(b"foo", b"foobar") == b"foo"
    assert keys.shortest_separator(b"foobar", b"foo") == b"foobar"
    assert keys.short_successor(b"foo") == b"g" and keys.short_successor(b"\xff\xff") == b"\xff\xff"
    assert keys.prefix_end(b"ab") == b"ac" and keys.prefix_end(b"a\xff") == b"b" and keys.prefix_end(b"\xff") is None


def test_bloom_membership():
    filt = bloom.filter_of([b"hello", b"world"])
    assert bloom.may_match(b"hello", filt) and bloom.may_match(b"world", filt)
    assert not bloom.may_match(b"x", filt) and not bloom.may_match(b"foo", filt)
    assert not bloom.may_match(b"hello", b"") and not bloom.may_match(b"hello", bloom.filter_of([]))


def test_bloom_varying_lengths():
    poor = good = 0
    for n in [1, 2, 5, 10, 50, 100, 500, 1000, 4000]:
        mine = [i.to_bytes(4, "little") for i in range(n)]
        filt = bloom.filter_of(mine)
        assert len(filt) <= n * 10 / 8 + 40 and all(bloom.may_match(k, filt) for k in mine)
        rate = sum(bloom.may_match((i + 10**9).to_bytes(4, "little"), filt) for i in range(4000)) / 4000
        poor, good = poor + (rate > 0.0125), good + (rate <= 0.0125)
    assert poor <= good / 5 + 1


def test_bloom_in_spark_is_the_same_filter(spark):
    rows = [(i % 3, f"key{i:04d}".encode()) for i in range(300)]
    built = bloom.build(spark.createDataFrame(rows + rows[:50], "run int, k binary"), "run", "k").collect()
    for r in built:
        mine = sorted({k for run, k in rows if run == r["run"]})
        assert bytes(r["filter"]) == bloom.filter_of(mine) and r["n_keys"] == 100


def test_escape(spark):
    data = [b"foo", b"\0a\xff\\", b"", bytes(range(256))]
    got = spark.createDataFrame([(bytearray(d),) for d in data], "d binary").select(coding.escape_column(F.col("d")).alias("e")).collect()
    assert [r["e"] for r in got] == [coding.escape(d) for d in data]


def test_typed_keys_keep_order(spark):
    numbers = [-(2**63), -5, -1, 0, 1, 7, 10, 255, 256, 2**63 - 1]
    shuffled = random.Random(1).sample(numbers, len(numbers))
    df = spark.createDataFrame([(n,) for n in shuffled], "n long").select("n", keys.big_endian(F.col("n")).alias("k"))
    assert [r["n"] for r in df.orderBy("k").collect()] == numbers
    got = spark.createDataFrame([(n,) for n in [3, 20, 100]], "n long").select(keys.padded(F.col("n")).alias("k")).collect()
    assert [r["k"] for r in got] == ["0" * 15 + "3", "0" * 14 + "20", "0" * 13 + "100"]


def test_pack_and_clip(spark):
    row = spark.createDataFrame([(100, 1, 77)], "s long, o int, x int").select(keys.pack_sequence(F.col("s"), F.col("o")).alias("p"), keys.clip(F.col("x"), 1, 50).alias("c")).first()
    assert row["p"] == 100 << 8 | 1 and row["c"] == 50


def test_generator():
    r = coding.Random(301)
    first = [r.next() for _ in range(3)]
    assert first[0] == 301 * 16807 and first[1] == first[0] * 16807 % (2**31 - 1)
    assert all(0 <= coding.Random(5).uniform(10) < 10 for _ in range(5))
