"""WARC archives: writing with revisits and segments, and reading back by segment reassembly.

Writing: a page is an HTTP response whose body is sent with chunked transfer framing. Of pages with
equal payloads the one with the largest id is stored, the others are revisit records that name it. A
record whose block is longer than ``segment`` bytes is split: the first segment is a response
record with WARC-Segment-Number 1, the rest are continuation records that name it in
WARC-Segment-Origin-ID, and the last one gives WARC-Segment-Total-Length.

Reading: files are parsed record by record. Records in one piece are decoded in place. Segments are
grouped by their origin's id, ordered by number, and put together if none is missing and the total
length is right; then the chunked framing is decoded and the digest verified. A record that fails
any of this is returned with its ``problem`` rather than dropped, and so is what is left of damaged files: a
header that is cut off or gives no usable length, a block that is cut off, a gzip member that is broken
or cut off (reading goes on at the next member).

Archives are made of one gzip member per record, written by Spark's text writer into the shared
folder: its line separator is an empty gzip member, so each part file is a valid .warc.gz. They are
read by Spark's binary reader, so any store that Spark reaches will do, and a lost task is simply
run again. A part file holds at most so many records of at most ``segment`` bytes that it stays under 2 GB,
the most that one row of the binary reader can hold.

Scale: only ids and digests are shuffled to decide roles (one row per page; a group of equal
payloads is one map-side combined maximum); pages meet their role in a join that adaptive execution
splits if a payload is very common. Only split records are shuffled by origin.

Defined results: null html is an empty payload; empty payloads are equal to each other; very long
payloads span segments; repeated rows (same id, same payload) are the same response, and a repeated
id with another payload is a record of its own; a null id is written as empty and read back as null;
an empty table gives an empty result; columns other than id, url and html are ignored. A page whose record cannot
be read back is returned without payload_bytes.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from uuid import uuid4

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from kvlake.llm.common import bounded_batches, checkpoint, ensure_checkpoint_dir, remove, table

SEGMENT, FRAME, MIN_BYTES, FILE_BYTES = 1 << 20, 1 << 16, 0, 1_900_000_000
_DATE = "2024-01-01T00:00:00Z"


def _member(data: bytes) -> bytes:
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


#: A fixed value: the empty gzip member, with no time stamp.
SEPARATOR = bytes.fromhex("1f8b080000000000000303000000000000000000")


def _record(kind: str, record_id: str, block: bytes, **more: str | int | None) -> bytes:
    head = {"WARC-Type": kind, "WARC-Record-ID": f"<{record_id}>", "WARC-Date": _DATE} | {k.replace("_", "-"): v for k, v in more.items() if v is not None}
    lines = "".join(f"{k}: {v}\r\n" for k, v in head.items()) + f"Content-Length: {len(block)}\r\n"
    return f"WARC/1.0\r\n{lines}\r\n".encode() + block + b"\r\n\r\n"


def chunked(body: bytes, frame: int = FRAME) -> bytes:
    """Chunked transfer framing of a body."""
    return b"".join(b"%x\r\n%b\r\n" % (len(c), c) for c in (body[i : i + frame] for i in range(0, len(body), frame))) + b"0\r\n\r\n"


def unchunked(data: bytes) -> bytes:
    """The body of chunked transfer framing, extensions and trailers skipped; ValueError if broken."""
    out, at = [], 0
    while True:
        end = data.find(b"\r\n", at)
        if end < 0:
            raise ValueError("chunk size line is cut off")
        n = int(data[at:end].split(b";")[0], 16)
        if not n:
            return b"".join(out)
        if len(data) < end + 2 + n + 2 or data[end + 2 + n : end + 4 + n] != b"\r\n":
            raise ValueError("chunk is cut off")
        out.append(data[end + 2 : end + 2 + n])
        at = end + 4 + n


def digest32(body: bytes) -> str:
    return base64.b32encode(hashlib.sha1(body).digest()).decode()


def _name(page_id, digest: str) -> str:
    return f"urn:page:{'' if page_id is None else page_id}:{digest}"


def page_records(page_id, url, html, keeper, segment: int, frame: int) -> list[bytes]:
    """The gzip members of one page."""
    body = (html or "").encode()
    digest = digest32(body)
    name, common = _name(page_id, digest), {"WARC_Target_URI": (url or "").replace("\r", "").replace("\n", ""), "WARC_Payload_Digest": f"sha1:{digest}"}
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
    http = {"Content_Type": "application/http; msgtype=response"}
    if keeper is not None:
        profile = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
        return [_member(_record("revisit", name, head, **common, **http, WARC_Profile=profile, WARC_Refers_To=f"<{_name(keeper, digest)}>"))]
    block = head + chunked(body, frame)
    if len(block) <= segment:
        return [_member(_record("response", name, block, **common, **http))]
    parts = [block[i : i + segment] for i in range(0, len(block), segment)]
    out = [_record("response", name, parts[0], **common, **http, WARC_Segment_Number=1)]
    for n, part in enumerate(parts[1:], 2):
        total = len(block) if n == len(parts) else None
        out.append(_record("continuation", f"{name}:{n}", part, WARC_Target_URI=common["WARC_Target_URI"], WARC_Segment_Origin_ID=f"<{name}>", WARC_Segment_Number=n, WARC_Segment_Total_Length=total))
    return [_member(r) for r in out]


def roles(pages: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """(digest, keeper, copies): the page to store for each payload of at least ``min_bytes``."""
    body = F.coalesce("html", F.lit("")).cast("binary")
    return pages.select("page_id", F.sha1(body).alias("digest"), F.octet_length(body).alias("n")).where(F.col("n") >= min_bytes).groupBy("digest").agg(F.max("page_id").alias("keeper"), F.count("*").alias("copies"))


def write_archives(pages: DataFrame, path: str, segment: int = SEGMENT, frame: int = FRAME, min_bytes: int = MIN_BYTES) -> None:
    """Write the records of ``pages`` (page_id, url, html) as .warc.gz part files under ``path``."""
    bounded_batches()
    shared = roles(pages, min_bytes).where("copies > 1").select(F.col("digest").alias("d"), "keeper")
    known = pages.select("page_id", "url", "html").join(shared, F.sha1(F.coalesce("html", F.lit("")).cast("binary")) == F.col("d"), "left")
    keeper = F.when(F.col("keeper").isNotNull() & ~F.col("keeper").eqNullSafe(F.col("page_id")), F.col("keeper"))

    @F.arrow_udf("array<binary>")
    def warc_records(page_id: pa.Array, url: pa.Array, html: pa.Array, kept: pa.Array) -> pa.Array:
        rows = zip(page_id, url, html, kept, strict=True)
        return pa.array([page_records(*(x.as_py() for x in row), segment, frame) for row in rows], pa.list_(pa.binary()))

    records = known.select(F.explode(warc_records("page_id", "url", "html", keeper)).alias("r")).select(F.col("r").cast("string").alias("value"))
    records.write.option("maxRecordsPerFile", max(1, FILE_BYTES // (segment + FRAME))).option("lineSep", SEPARATOR.decode("latin-1")).option("encoding", "ISO-8859-1").text(path)


def _members(data: bytes):
    """(content, problem) of each gzip member. Compressed bytes are fed in small steps, so that what a member
    leaves over, which zlib hands back as a copy, is short."""
    view, at, step = memoryview(data), 0, 4096
    while at < len(view):
        z, out, begun = zlib.decompressobj(31), [], at
        try:
            while not z.eof and at < len(view):
                out.append(z.decompress(view[at : at + step]))
                at += step
        except zlib.error:
            yield b"".join(out), "gzip member is broken"
            at = data.find(b"\x1f\x8b\x08", begun + 1)
            if at < 0:
                return
            continue
        if not z.eof:
            yield b"".join(out), "gzip member is cut off"
            return
        at = min(at, len(view)) - len(z.unused_data)
        step = min(max(1024, at - begun), 1 << 20)
        yield b"".join(out), None


def parse_archive(data: bytes):
    """(headers by lower-case name, block, problem) of every record of a .warc or .warc.gz file; a gzip member holds
    whole records, or many members one stream (of at most 4 MB at a time if records end with members)."""
    if data[:2] != b"\x1f\x8b":
        yield from _records(data)
        return
    held, size = [], 0
    for part, problem in _members(data):
        held.append(part)
        size += len(part)
        if problem:
            yield from _records(b"".join(held), problem)
        if problem or size > 4_000_000 and part.endswith(b"\r\n\r\n"):
            yield from _records(b"".join(held)) if not problem else ()
            held, size = [], 0
    yield from _records(b"".join(held))


def _records(data: bytes, damage: str | None = None):
    """``damage``: what is wrong with the end of ``data``; its last record, or one without headers, tells it."""
    at, told = 0, damage is None
    while (at := data.find(b"WARC/", at)) >= 0:
        end = data.find(b"\r\n\r\n", at)
        lines = data[at : end if end >= 0 else len(data)].decode("utf-8", "replace").split("\r\n")[1:]
        head = {k.strip().lower(): v.strip() for k, colon, v in (x.partition(":") for x in lines) if colon}
        n, start = head.get("content-length", ""), end + 4
        if end < 0:
            yield head, b"", damage or "header is cut off"
            return
        if not n.isascii() or not n.isdigit():
            yield head, b"", "no content length"
            at = start
            continue
        at = start + int(n)
        cut = at > len(data)
        told = told or cut
        yield head, data[start:at], (damage or "block is cut off") if cut else None
    if not told:
        yield {}, b"", damage


def decode_block(head_digest: str | None, block: bytes) -> dict:
    """Payload bytes and digest of a whole HTTP block, or what is wrong with it."""
    top, _, rest = block.partition(b"\r\n\r\n")
    try:
        body = unchunked(rest) if b"transfer-encoding: chunked" in top.lower() else rest
    except ValueError as e:
        return {"payload": None, "problem": str(e)}
    if head_digest and digest32(body) != head_digest:
        return {"payload": None, "problem": "payload digest differs"}
    return {"payload": body, "problem": None}


_ROW = "record_id string, type string, uri string, digest string, refers_to string, segment int, origin string, total long, block binary, payload binary, payload_bytes long, problem string"
_ARROW = pa.schema([("record_id", pa.string()), ("type", pa.string()), ("uri", pa.string()), ("digest", pa.string()), ("refers_to", pa.string()), ("segment", pa.int32()), ("origin", pa.string()), ("total", pa.int64()), ("block", pa.binary()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("problem", pa.string())])


def _row(head: dict, block: bytes, problem: str | None, payloads: bool) -> dict:
    bare = lambda k: head.get(k, "").strip("<>") or None
    row = {"record_id": bare("warc-record-id"), "type": head.get("warc-type"), "uri": head.get("warc-target-uri") or None, "digest": head.get("warc-payload-digest", "").removeprefix("sha1:") or None, "refers_to": bare("warc-refers-to")}
    if problem:
        return row | {"problem": problem}
    if "warc-segment-number" in head:
        number, total = head["warc-segment-number"], head.get("warc-segment-total-length", "0")
        if not (number.isascii() and number.isdigit() and total.isascii() and total.isdigit()):
            return row | {"problem": "segment is not numbered"}
        number = int(number)
        return row | {"segment": number, "origin": bare("warc-segment-origin-id") or row["record_id"], "total": int(head["warc-segment-total-length"]) if "warc-segment-total-length" in head else None, "block": block}
    if row["type"] == "response":
        got = decode_block(row["digest"], block)
        row |= {"payload": got["payload"] if payloads else None, "payload_bytes": None if got["payload"] is None else len(got["payload"]), "problem": got["problem"]}
    return row


def read_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """One row per page record: record_id, type, uri, digest, refers_to, payload (null if not asked for,
    and for revisits), payload_bytes and problem."""

    def parse(batches, kinds: tuple):
        for batch in batches:
            for data in batch.column("content"):
                rows, held = [], 0
                for head, block, problem in parse_archive(data.as_py()):
                    row = _row(head, block, problem, payloads)
                    if ("segment" in row) not in kinds:
                        continue
                    rows.append(row)
                    held += len(block)
                    if held > 8_000_000:
                        yield pa.RecordBatch.from_pylist(rows, _ARROW)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, _ARROW)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    if payloads:  # two passes over the files: payloads stay where they are, only segments are shuffled
        whole_rows, segments = (files.mapInArrow(lambda x, k=k: parse(x, (k,)), _ROW) for k in (False, True))
    else:  # rows are short: one pass, written down
        rows = checkpoint(files.mapInArrow(lambda x: parse(x, (False, True)), _ROW))
        whole_rows, segments = rows.where("segment IS NULL"), rows.where("segment IS NOT NULL")
    single = whole_rows.select("record_id", "type", "uri", "digest", "refers_to", "payload", "payload_bytes", "problem")
    grouped = segments.groupBy("origin").agg(
        F.sort_array(F.collect_set(F.struct("segment", "block"))).alias("parts"), F.count(F.when(F.col("segment") == 1, 1)).alias("copies"), F.max("total").alias("total"), F.max("digest").alias("digest"), F.max(F.when(F.col("segment") == 1, F.col("type"))).alias("type"), F.max("uri").alias("uri")
    )

    @F.arrow_udf("struct<payload: binary, payload_bytes: bigint, problem: string>")
    def reassemble(parts: pa.Array, total: pa.Array, digest: pa.Array) -> pa.Array:
        out = []
        for p, t, d in zip(parts.to_pylist(), total.to_pylist(), digest.to_pylist(), strict=True):
            block = b"".join(x["block"] for x in p)
            if [x["segment"] for x in p] != list(range(1, len(p) + 1)) or t is None:
                got = {"payload": None, "problem": "a segment is missing"}
            elif len(block) != t:
                got = {"payload": None, "problem": "total length differs"}
            else:
                got = decode_block(d, block)
            out.append({"payload": got["payload"] if payloads else None, "payload_bytes": None if got["payload"] is None else len(got["payload"]), "problem": got["problem"]})
        return pa.array(out, pa.struct([("payload", pa.binary()), ("payload_bytes", pa.int64()), ("problem", pa.string())]))

    # a page that came twice has each segment twice: put together once, returned as often
    whole = grouped.withColumn("r", reassemble("parts", "total", "digest")).withColumn("again", F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), F.col("copies").cast("int")))))
    whole = whole.select(F.col("origin").alias("record_id"), "type", "uri", "digest", F.lit(None).cast("string").alias("refers_to"), "r.payload", "r.payload_bytes", "r.problem")
    return single.unionByName(whole)


def _page_of(name: str):
    return F.expr(f"try_cast(nullif(split_part({name}, ':', 3), '') AS BIGINT)")


def archive_folder(spark: SparkSession) -> str:
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/warc-{uuid4()}"


def query(spark, sf_dir: str) -> DataFrame:
    """op9: every page as its record is read back."""
    path = archive_folder(spark)
    write_archives(table(spark, sf_dir, "pages"), path)
    read = checkpoint(read_archives(spark, path, payloads=False))
    remove(spark, path)
    sizes = read.where("type = 'response'").select(F.col("record_id").alias("kept"), F.col("payload_bytes").alias("kept_bytes")).dropDuplicates(["kept"])
    joined = read.join(sizes, F.coalesce("refers_to", "record_id") == F.col("kept"), "left")
    return joined.select(_page_of("record_id").alias("page_id"), F.col("kept_bytes").alias("payload_bytes"), F.col("digest").alias("payload_digest"), F.col("type").alias("record_type"), _page_of("refers_to").alias("refers_to"))


_GROUPS = " || ".join(f"to_base(('0x' || substr(d, {i}, 10))::BIGINT, 32, 8)" for i in (1, 11, 21, 31))
ORACLE = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS d FROM pages),
k AS (SELECT d, max(page_id) AS keeper FROM p GROUP BY d)
SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes,
  translate({_GROUPS}, '0123456789ABCDEFGHIJKLMNOPQRSTUV', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567') AS payload_digest,
  CASE WHEN page_id = keeper THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = keeper THEN NULL ELSE keeper END AS refers_to
FROM p JOIN k USING (d)
"""
