"""Personal data: base patterns, and bootstrapped contextual extraction of what they miss.

Base spans come from four fixed patterns (e-mail, IP, card, phone), leftmost and non-overlapping
per kind; matches that fail their check are dropped without another try. They are the seeds. Each
seed's neighbouring words make lexical patterns; what has over ``LONGEST`` characters without white space is no
word, wherever it stands. Other identifier-like tokens (with an at sign or
four digits or more) that stand in the same contexts are instances too, and Spark scores the graph
of patterns and instances in rounds: a pattern is worth the mean worth of its instances. Seeds are
worth 1, an unseen instance what the best pattern trusted in an earlier round is worth, and nothing
before there is one, so no pattern lifts itself. Patterns with at least ``MIN_SEEDS`` distinct seeds
of one kind and a worth of ``MIN_WORTH`` or more are trusted, and the unseen instances that they name
are seeds of that kind for other patterns, until a round adds no pattern. These instances are added
as spans where they stand in a trusted context; base spans always stay.

Scale: one pass over the texts emits spans and contexts, which are few and short; rounds run on
those (map-side combined sums per pattern, joins by pattern or value that AQE may split), cut by
checkpoints.

Defined results: a null or empty text has no span; very long texts are read whole, and tokens of any
length are told apart by all of their characters; repeated rows get the same spans; ties between kinds
of a pattern go to the kind listed first; an empty table gives an empty result; columns other than the
id and the text are ignored, and those of clashing names are carried along by ``redact``.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from kvlake.llm.common import bounded_batches, checkpoint, fresh, give_back, table

KINDS = ("email", "ip", "card", "phone")
MIN_SEEDS, MIN_WORTH, LONGEST = 5, 0.8, 64

_AT = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_IP = re.compile(r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_HINT = re.compile(r"[0-9@]")
_SPACE = re.compile(r"\s")
_EDGE = re.compile(r"^\W+|\W+$")


def _luhn(digits: str) -> bool:
    values = [int(d) for d in reversed(digits)]
    return (sum(values[::2]) + sum(v * 2 - 9 * (v > 4) for v in values[1::2])) % 10 == 0


def base_spans(text: str | None) -> list[tuple[int, int, int]]:
    """(kind number, start, end) in code points, by kind and then start."""
    if not text:
        return []
    out, done = [], 0
    for m in _AT.finditer(text) if "@" in text else ():
        start = m.start()
        while start > done and _LOCAL.match(text, start - 1):
            start -= 1
        if start < m.start():  # without a local part the at sign is no match, and later ones may use what follows
            out.append((0, start, m.end()))
            done = m.end()
    if _HINT.search(text):
        out += [(1, *m.span()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split("."))]
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 13 and 13 <= len(d := m[0].replace(" ", "").replace("-", "")) <= 19 and _luhn(d):
                out.append((2, *m.span()))
        if "+" in text:
            out += [(3, *m.span()) for m in _PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    return out


def _before(text: str, at: int) -> tuple[str, int]:
    """The word that ends before ``at``, white space skipped, and where it begins; empty if it is too long."""
    end = at
    while end and text[end - 1].isspace():
        end -= 1
    start = end
    while start and end - start <= LONGEST and not text[start - 1].isspace():
        start -= 1
    return (text[start:end].lower(), start) if end - start <= LONGEST else ("", start)


def _after(text: str, at: int) -> str:
    """The word that begins after ``at``; empty if it is too long."""
    start = at
    while start < len(text) and text[start].isspace():
        start += 1
    end = start
    while end < len(text) and end - start <= LONGEST and not text[end].isspace():
        end += 1
    return text[start:end].lower() if end - start <= LONGEST else ""


def _context(text: str, start: int, end: int) -> list[str]:
    """Lexical patterns: the two words before, the word before and the word after, and more generally
    the word before or the word after alone, without punctuation."""
    last, at = _before(text, start)
    first, right = _before(text, at)[0] if last else "", _after(text, end)
    out = [f"{first} {last} _"] if first else []
    if last and right:
        out.append(f"{last} _ {right}")
    before, after = _EDGE.sub("", last), _EDGE.sub("", right)
    if before:
        out.append(f"{before} _")
    if after:
        out.append(f"_ {after}")
    return out


def _tokens(text: str, taken: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Identifier-like tokens that overlap no span: an at sign, or four digits or more."""
    out, at, taken = [], 0, sorted(taken)
    while m := _HINT.search(text, at):
        start = m.start()
        while start > at and not text[start - 1].isspace():
            start -= 1
        stop = _SPACE.search(text, m.start())
        end = at = stop.start() if stop else len(text)
        while start < end and not text[start].isalnum():
            start += 1
        while end > start and not text[end - 1].isalnum():
            end -= 1
        token = text[start:end]
        if ("@" in token or sum("0" <= c <= "9" for c in token) >= 4) and not any(a < end and start < b for a, b in taken):
            out.append((start, end))
    return out


def _value(token: str) -> str:
    """The token, or for a long one its digest, which no token can equal: it is longer than any that is kept."""
    return token if len(token) <= LONGEST else f"{hashlib.sha256(token.encode()).hexdigest()}:{len(token)}"


def read_text(text: str | None) -> dict:
    """Base spans, and one record per span or unseen token: kind (-1: unseen), place, value, patterns."""
    spans = base_spans(text)
    seen = []
    for kind, a, b in [*spans, *((-1, a, b) for a, b in (_tokens(text, [s[1:] for s in spans]) if text else ()))]:
        seen.append({"kind": kind, "start": a, "end": b, "value": _value(text[a:b].lower()), "patterns": _context(text, a, b)})
    return {"base": [{"kind": k, "start": a, "end": b} for k, a, b in spans], "seen": seen}


_SPAN = pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32())])
_SEEN = pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("value", pa.string()), ("patterns", pa.list_(pa.string()))])
_READ = "struct<base: array<struct<kind: int, start: int, end: int>>, seen: array<struct<kind: int, start: int, end: int, value: string, patterns: array<string>>>>"


def read_spans(text: Column) -> Column:
    """Not deterministic to the planner: a filter on what was read would otherwise read every text a second time, in a second
    worker process of each task."""
    bounded_batches()

    @F.arrow_udf(_READ)
    def pii_read(column: pa.Array) -> pa.Array:
        return pa.array([read_text(x.as_py()) for x in column], pa.struct([("base", pa.list_(_SPAN)), ("seen", pa.list_(_SEEN))]))

    return pii_read.asNondeterministic()(text)


def learn_patterns(seen: DataFrame, min_seeds: int = MIN_SEEDS, min_worth: float = MIN_WORTH) -> DataFrame:
    """(pattern, kind, worth) of the patterns to trust, from occurrences (kind, value, patterns).

    A pattern is scored from what was trusted before its own round and keeps that worth."""
    links = seen.select("kind", "value", F.explode("patterns").alias("pattern"))
    graph = checkpoint(links.groupBy("pattern", "kind", "value").agg(F.count("*").alias("n")))
    totals = checkpoint(graph.groupBy("pattern").agg(F.sum("n").alias("total"), F.count("*").alias("values")).where(F.col("values") >= min_seeds).drop("values"))
    unseen = graph.where("kind < 0").select("pattern", "value", "n")
    sure = graph.where("kind >= 0").select("pattern", F.col("kind").alias("of"), F.col("n").cast("double").alias("credit"))
    trusted, credits = None, sure
    while True:
        scored = credits.groupBy("pattern", "of").agg(F.count("*").alias("seeds"), F.sum("credit").alias("credit")).where(F.col("seeds") >= min_seeds)
        scored = scored.join(totals, "pattern").withColumn("worth", F.col("credit") / F.col("total")).where(F.col("worth") >= min_worth)
        more = scored.groupBy("pattern").agg(F.max(F.struct("seeds", (-F.col("of")).alias("k"), "worth")).alias("m")).select("pattern", (-F.col("m.k")).alias("kind"), "m.worth")
        if trusted is not None:
            more = more.join(trusted, "pattern", "left_anti")
        more = checkpoint(more)
        if more.isEmpty():
            return more if trusted is None else trusted
        trusted = more if trusted is None else checkpoint(trusted.unionByName(more))
        held = unseen.join(trusted, "pattern").groupBy("value", F.col("kind").alias("of")).agg(F.max("worth").alias("held"))
        credits = sure.unionByName(unseen.join(held, "value").select("pattern", "of", (F.col("n") * F.col("held")).alias("credit")))


def discovered(read: DataFrame, trusted: DataFrame, keys: list[str]) -> DataFrame:
    """Keys and ``added``: spans of unseen tokens in trusted contexts. Rows with equal keys count once."""
    unseen = read.select(*keys, F.explode("seen").alias("s")).where("s.kind < 0").select(*keys, "s.start", "s.end", F.explode("s.patterns").alias("pattern"))
    named = unseen.join(trusted, "pattern").groupBy(*keys, "start", "end").agg(F.max(F.struct("worth", (-F.col("kind")).alias("k"))).alias("m"))
    spans = F.struct((-F.col("m.k")).cast("int").alias("kind"), "start", "end")
    return named.groupBy(*keys).agg(F.sort_array(F.collect_set(spans)).alias("added"))


def _joined(spans: Column) -> Column:
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(F.sort_array(spans), lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def _row_key() -> Column:
    """128 bits of id and text: rows of one key are equal rows."""
    return F.md5(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.coalesce("text", F.lit(""))))


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", _row_key().alias("row_key"), read_spans(F.col("text")).alias("r")).select("doc_id", "row_key", "r.base", "r.seen")


def find(docs: DataFrame, min_seeds: int = MIN_SEEDS, min_worth: float = MIN_WORTH) -> DataFrame:
    """Per document: doc_id, base and added spans (arrays of kind, start, end)."""
    read = checkpoint(_keyed(docs))
    trusted = learn_patterns(read.select(F.explode("seen").alias("s")).select("s.kind", "s.value", "s.patterns"), min_seeds, min_worth)
    more = discovered(read, trusted, ["row_key"])
    none = F.array().cast("array<struct<kind: int, start: int, end: int>>")
    return read.drop("seen").join(more, "row_key", "left").select("doc_id", "base", F.coalesce("added", none).alias("added"))


def redact_text(text: str | None, added: list | None) -> str | None:
    """The text with each span replaced by its kind in angle brackets; of overlapping spans the one
    that starts first (then the longer) names the kind and the union is replaced."""
    if not text:
        return text
    spans = sorted([(a, -b, k) for k, a, b in base_spans(text)] + [(s["start"], -s["end"], s["kind"]) for s in added or ()])
    out, at = [], 0
    for a, b, kind in spans:
        if a >= at:
            out += [text[at:a], f"<{KINDS[kind].upper()}>"]
        at = max(at, -b)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with all spans replaced in the text, and n_chars (where present) set anew."""
    key, found, text = fresh(docs, "row_key"), fresh(docs, "added_spans"), F.col("text")
    read = checkpoint(_keyed(docs).where(F.size("seen") > 0))
    trusted = learn_patterns(read.select(F.explode("seen").alias("s")).select("s.kind", "s.value", "s.patterns"))
    more = discovered(read, trusted, ["row_key"]).select(F.col("row_key").alias(key), F.col("added").alias(found))

    bounded_batches()

    @F.arrow_udf("string")
    def pii_redact(column: pa.Array, added: pa.Array) -> pa.Array:
        out = pa.array([redact_text(x.as_py(), y.as_py()) for x, y in zip(column, added, strict=True)], pa.string())
        give_back()
        return out

    joined = docs.withColumn(key, _row_key()).join(more, key, "left")
    done = joined.withColumn("text", pii_redact(text, F.col(found)))
    if "n_chars" in docs.columns:
        done = done.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return done.select(*docs.columns)


def query(spark, sf_dir: str) -> DataFrame:
    """op10: counts and digest of base spans, and all spans, of every document."""
    found = find(table(spark, sf_dir, "documents"))
    return found.select("doc_id", *_counts(), F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(F.array_union("base", "added")).alias("spans"))


def _counts() -> list[Column]:
    def one(i: int) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == i)).cast("long").alias(f"n_{KINDS[i]}")

    return [one(i) for i in range(len(KINDS))]
