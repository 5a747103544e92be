import glob
import gzip

import duckdb

from kvlake.llm import warc as W
from tests.conftest import SF

PAGES = "page_id long, url string, html string, payload string"


def write(spark, rows, **more):
    path = W.archive_folder(spark)
    W.write_archives(spark.createDataFrame([(*r, "x") for r in rows], PAGES), path, **more)
    return path


def test_matches_its_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{SF}/pages.parquet'")
    want, got = con.sql(W.ORACLE), W.query(spark, SF)
    assert sorted(map(tuple, got.select(*want.columns).collect())) == sorted(want.fetchall())


def test_revisits_segments_and_odd_rows(spark):
    big = "<p>é</p>\r\n\r\nWARC/1.0\r\n" * 4000
    rows = [(1, "u", "same"), (2, "u", "same"), (3, None, None), (4, "a\r\nb", ""), (5, "v", big), (6, "v", big + "!"), (7, "v", big), (7, "v", big), (None, "n", "no id")]
    path = write(spark, rows, segment=10_000, frame=999)
    got = W.read_archives(spark, path)
    by = {}
    for r in got.collect():
        assert r["problem"] is None
        by.setdefault(r["record_id"].split(":")[2], []).append((r["type"], None if r["payload"] is None else bytes(r["payload"]).decode(), r["refers_to"] and r["refers_to"].split(":")[2]))
    assert by["1"] == [("revisit", None, "2")] and by["2"] == [("response", "same", None)] and by["3"] == [("revisit", None, "4")] and by["4"] == [("response", "", None)]
    assert by["5"] == [("revisit", None, "7")] and by["6"] == [("response", big + "!", None)] and by["7"] == [("response", big, None)] * 2 and by[""] == [("response", "no id", None)]
    text = b"".join(gzip.open(f).read() for f in glob.glob(path.removeprefix("file:") + "/part-*"))
    assert text.count(b"WARC-Type: continuation") > 10 and b"WARC-Segment-Total-Length" in text and text.endswith(b"\r\n\r\n")
    short = {r["record_id"].split(":")[2]: r["payload_bytes"] for r in W.read_archives(spark, path, payloads=False).where("type = 'response'").collect()}
    assert short["6"] == len((big + "!").encode()) and short["4"] == 0


def test_damage_is_told(spark, tmp_path):
    def at(name, *records):
        (tmp_path / name).mkdir()
        (tmp_path / name / "part-0").write_bytes(b"".join(records))
        return {r["problem"] for r in W.read_archives(spark, str(tmp_path / name)).collect()}

    members = W.page_records(1, "u", "x" * 5000, None, 2000, 512)
    assert len(members) == 3 and at("whole", *members[::-1]) == {None}
    assert at("gap", members[0], members[2]) == {"a segment is missing"} == at("tail", *members[:2])
    plain = [gzip.decompress(m) for m in members]
    assert at("plain", *plain) == {None}
    assert at("length", plain[0], plain[1], plain[2].replace(b"Total-Length: 5", b"Total-Length: 9")) == {"total length differs"}
    single = gzip.decompress(W.page_records(1, "u", "hello", None, 2000, 512)[0])
    assert at("digest", single.replace(b"hello", b"jello")) == {"payload digest differs"}
    assert at("frame", single.replace(b"\r\n5\r\n", b"\r\n9\r\n")) == {"chunk is cut off"}


def test_chunked_framing():
    for n in (0, 1, 511, 512, 513, 5000):
        assert W.unchunked(W.chunked(b"z" * n, 512)) == b"z" * n
    assert W.unchunked(b"3;ext=1\r\nabc\r\n0\r\nTrailer: x\r\n\r\n") == b"abc"


def test_separator_is_an_empty_member():
    assert gzip.decompress(W.SEPARATOR) == b"" and gzip.decompress(gzip.compress(b"a") + W.SEPARATOR + gzip.compress(b"b")) == b"ab"


def test_shared_payload_threshold(spark):
    path = write(spark, [(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcd"), (4, "u", "abcd")], min_bytes=3)
    assert sorted((r["record_id"].split(":")[2], r["type"]) for r in W.read_archives(spark, path).collect()) == [("1", "response"), ("2", "response"), ("3", "revisit"), ("4", "response")]


def test_empty_table(spark):
    assert W.read_archives(spark, write(spark, [])).collect() == []


def test_cut_and_broken_input_is_told(spark, tmp_path):
    def at(name, data):
        (tmp_path / name).mkdir()
        (tmp_path / name / "part-0").write_bytes(data)
        for payloads in (True, False):
            rows = W.read_archives(spark, str(tmp_path / name), payloads).collect()
        return sorted(str(r["problem"]) for r in rows)

    a, b = (W.page_records(i, "u", f"hello {i} " * 50, None, 1 << 20, 512)[0] for i in (1, 2))
    plain = gzip.decompress(a)
    assert at("header", plain + gzip.decompress(b)[:40]) == ["None", "header is cut off"]
    assert at("length", plain.replace(b"Content-Length", b"Content-Size") + gzip.decompress(b)) == ["None", "no content length"]
    assert at("words", plain.replace(b"Content-Length: ", b"Content-Length: x")) == ["no content length"]
    assert at("block", plain[:-60]) == ["block is cut off"]
    assert at("member", a + b[:-30]) == ["None", "gzip member is cut off"]
    spoilt = bytearray(a)
    spoilt[40:60] = b"\xff" * 20
    assert at("broken", bytes(spoilt) + b) == ["None", "gzip member is broken"]
    assert at("segment", plain.replace(b"WARC-Date", b"WARC-Segment-Number: one\r\nWARC-Date")) == ["segment is not numbered"]


def test_part_files_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(W, "FILE_BYTES", 20 * (1000 + W.FRAME))
    path = write(spark, [(i, "u", f"page {i}") for i in range(90)], segment=1000)
    files = glob.glob(path.removeprefix("file:") + "/part-*")
    assert len(files) >= 5 and all(gzip.open(f).read().count(b"WARC/1.0") <= 20 for f in files)
    assert W.read_archives(spark, path).where("problem IS NULL").count() == 90
