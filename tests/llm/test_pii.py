import hashlib
import random
import re

from kvlake.llm import pii as P
from tests.conftest import SF


def naive_spans(text):
    """The base patterns applied one by one with plain regular expressions."""
    text, out = text or "", []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append((0, *m.span()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            out.append((1, *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in re.sub("[ -]", "", m[0])][::-1]
        if 13 <= len(d) <= 19 and sum(c if i % 2 == 0 else sum(divmod(2 * c, 10)) for i, c in enumerate(d)) % 10 == 0:
            out.append((2, *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append((3, *m.span()))
    return out


def digest(spans):
    return hashlib.sha256(",".join(f"{P.KINDS[k]}:{a}:{b}" for k, a, b in sorted(spans)).encode()).hexdigest()


def test_base_spans_equal_plain_patterns():
    rng = random.Random(1)
    parts = [*"a.@-1 2+(_%é", "453", "9148803436467", "4539148803436467", "@x.y", "10.0.0.255", "+1 (706) 555"]
    for _ in range(20_000):
        t = "".join(rng.choice(parts) for _ in range(rng.randint(0, 14)))
        assert sorted(P.base_spans(t)) == sorted(naive_spans(t)), t


def test_query(spark):
    rows = P.query(spark, SF).collect()
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert len(rows) == 200
    for r in rows:
        base = naive_spans(texts[r["doc_id"]])
        assert r["base_sha256"] == digest(base) and [r[f"n_{k}"] for k in P.KINDS] == [sum(s[0] == i for s in base) for i in range(4)]
        assert {f"{P.KINDS[k]}:{a}:{b}" for k, a, b in base} <= set(r["spans"].split(",")) | {""}


def seeded():
    rows = [(i, f"Dear all, write to user{i}@mail.example.com today. Number {i}.") for i in range(8)]
    return rows + [(50, "Dear all, write to bob@localhost today."), (51, "The figure 20481 stands, ask nobody@all here.")]


def test_contexts_find_unseen_identifiers(spark, make_docs):
    got = {r["doc_id"]: r for r in P.find(make_docs(seeded())).collect()}
    added = [(s["kind"], s["start"], s["end"]) for s in got[50]["added"]]
    text = dict(seeded())[50]
    assert added == [(0, text.index("bob"), text.index(" today"))] and not got[51]["added"] and len(got[3]["base"]) == 1
    few = P.find(make_docs([r for r in seeded() if r[0] > 5])).collect()
    assert all(not r["added"] for r in few)


def test_doubtful_contexts_are_not_trusted(spark, make_docs):
    rows = [(i, f"call me at +4420794601{i:02d} now") for i in range(6)] + [(90 + i, f"call me at 12345{i} now") for i in range(20)]
    assert all(not r["added"] for r in P.find(make_docs(rows)).collect())


def test_redaction(spark, make_docs):
    out = {r["doc_id"]: r for r in P.redact(make_docs(seeded() + [(60, None), (61, "")])).collect()}
    assert out[3]["text"] == "Dear all, write to <EMAIL> today. Number 3." and out[50]["text"] == "Dear all, write to <EMAIL> today."
    assert out[51]["text"] == dict(seeded())[51] and out[60]["text"] is None and out[61]["text"] == "" and out[3]["n_chars"] == len(out[3]["text"])


def test_overlaps_are_replaced_once():
    assert P.redact_text("+4222222222222 x", None) == "<PHONE> x"
    assert P.redact_text("a@b.c", [{"kind": 3, "start": 0, "end": 5}]) == "<EMAIL>"


def test_odd_rows(spark, odd_docs, make_docs):
    rows = P.find(odd_docs).collect()
    assert len(rows) == 10 and all(not r["base"] for r in rows if r["doc_id"] in (1, 2, 3))
    assert P.redact(odd_docs).columns == odd_docs.columns and P.redact(odd_docs).count() == 10
    assert P.find(make_docs([])).collect() == [] and P.redact(make_docs([])).collect() == []
    assert hashlib.sha256(b"").hexdigest() == digest([])


def test_contexts_do_not_lift_themselves(spark, make_docs):
    rows = [(i, f"call me at +4420794601{i:02d} now") for i in range(6)] + [(90 + i, f"call me at 12345{i} now") for i in range(8)]
    assert all(not r["added"] for r in P.find(make_docs(rows)).collect())


def test_accepted_instances_seed_further_contexts(spark, make_docs):
    rows = [(i, f"Dear all, write to user{i}@mail.example.com today.") for i in range(40)]
    rows += [(100 + i, f"Dear all, write to desk{i}@localhost today.") for i in range(5)]
    rows += [(200 + i, f"Kindly ask desk{i % 5}@localhost instead.") for i in range(15)]
    rows += [(300, "Kindly ask nobody@all instead."), (301, "The figure 20481 stands.")]
    got = {r["doc_id"]: [(s["kind"], s["start"], s["end"]) for s in r["added"]] for r in P.find(make_docs(rows)).collect()}
    assert got[100] and got[200] and got[300] == [(0, 11, 21)] and not got[301] and not got[0]


def test_contexts_have_no_cut(spark, make_docs):
    gap = " " * 500
    rows = [(i, f"Dear all, write{gap}to user{i}@mail.example.com{gap}today.") for i in range(8)] + [(50, f"Dear all, write{gap}to bob@localhost{gap}today.")]
    got = {r["doc_id"]: r for r in P.find(make_docs(rows)).collect()}
    assert [(s["kind"], s["start"]) for s in got[50]["added"]] == [(0, rows[-1][1].index("bob"))]
    long = "1234" + "x" * 300
    assert P._value(long + "a") != P._value(long + "b") and P._value("Short".lower()) == "short"
    assert P._context("a " + "y" * 65 + " 12345 z", 68, 73) == ["_ z"] and P._context("12345", 0, 5) == []


def test_planted_identifiers_are_found(spark, make_docs):
    """Identifiers that no base pattern knows, in contexts that base identifiers seed: found; the same tokens elsewhere: left."""
    rng = random.Random(5)
    cues = [("please mail", "for access"), ("reach me under", "after lunch"), ("the account of", "was closed")]
    rows, planted = [], set()
    for i in range(300):
        left, right = cues[i % 3]
        known = i % 10 > 0
        token = f"name{i}@host{i}.example.org" if known else f"name{i}@intranet{i}"
        rows.append((i, f"{' '.join(rng.choice('abcde') * 4 for _ in range(20))} {left} {token} {right} {' '.join(rng.choice('fghij') * 4 for _ in range(20))}"))
        if not known:
            planted.add(i)
    rows += [(1000 + i, f"ticket {i}4711 refers to build {i}0815@node somewhere in rack {i}9") for i in range(60)]
    got = {r["doc_id"]: len(r["added"]) for r in P.find(make_docs(rows)).collect()}
    assert {d for d, n in got.items() if n} == planted and len(planted) == 30


def test_texts_are_read_once_and_by_one_process_of_a_task(spark, make_docs, monkeypatch):
    """A filter on what was read must not read every text again."""
    plans, real = [], P.checkpoint
    monkeypatch.setattr(P, "checkpoint", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or real(df))
    out = P.redact(make_docs([(1, "write to anna@example.org now"), (2, "nothing here"), (3, None)]))
    assert sorted(r["text"] or "" for r in out.collect()) == ["", "nothing here", "write to <EMAIL> now"]
    assert [p.count("ArrowEvalPython") for p in plans if "pii_read" in p] == [1]
