import math
from collections import Counter

import duckdb
import pytest

from kvlake.llm import mixing as M
from tests.conftest import SF


def corpus(make_docs, sizes, words=10):
    rows, i = [], 0
    for source, n in sizes.items():
        for _ in range(n):
            rows.append((i, " ".join(["w"] * (1 + i % words)), source))
            i += 1
    return make_docs(rows)


def spent(out):
    got = Counter()
    for r in out.collect():
        got[r["source"]] += len((r["text"] or "").split())
    return got


def test_matches_its_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = con.sql(M.ORACLE)
    got = M.query(spark, SF)
    assert sorted(map(tuple, got.select(*want.columns).collect()), key=str) == sorted(want.fetchall(), key=str)


def test_repetition_limit(spark, make_docs):
    docs = corpus(make_docs, {"hot": 300, "mid": 60, "small": 20})
    for limit in (1.0, 1.5, 2.0, 7.0):
        plan = {r["src"]: r for r in M.weights(M.source_totals(docs, "source", "text"), max_repetition=limit).collect()}
        reps = {s: r["allotted"] / r["tokens"] for s, r in plan.items()}
        assert reps["hot"] == 1 and max(reps.values()) <= limit + 0.02 and math.isclose(sum(r["weight"] for r in plan.values()), 1)
        got, out = spent(docs), spent(M.mix(docs, max_repetition=limit))
        assert all(plan[s]["allotted"] - 10 <= out[s] <= plan[s]["allotted"] for s in out) and out["hot"] == got["hot"]
    assert max(reps.values()) > 6.5


def test_entropy_target(spark, make_docs):
    docs = corpus(make_docs, {"a": 200, "b": 50, "c": 10})
    totals = M.source_totals(docs, "source", "text")
    for target in (0.8, 0.95, 1.05):
        w = [r["weight"] for r in M.weights(totals, target_entropy=target, max_repetition=None).collect()]
        assert math.isclose(-sum(x * math.log(x) for x in w), target, rel_tol=1e-9)
    flat = [r["weight"] for r in M.weights(totals, target_entropy=9.0, max_repetition=None).collect()]
    assert all(math.isclose(w, 1 / 3) for w in flat)


def test_budget_cuts_and_passes(spark, make_docs):
    docs = corpus(make_docs, {"a": 400, "b": 40})
    for budget in (300, 2000, 12_000):
        out = M.mix(docs, target_entropy=0.6, max_repetition=None, budget=budget)
        n = spent(out)
        assert budget - 20 <= sum(n.values()) <= budget
        copies = Counter((r["doc_id"], r["epoch"]) for r in out.collect())
        assert set(copies.values()) == {1}
        per = Counter(r["doc_id"] for r in out.where("source = 'b'").collect())
        assert max(per.values()) - min(per.get(i, 0) for i in range(400, 440)) <= 1


def test_every_epoch_is_another_permutation(spark, make_docs):
    docs = corpus(make_docs, {"a": 50, "b": 500})
    out = M.mix(docs, max_repetition=5.0).where("source = 'a'").collect()
    order = {e: [r["doc_id"] for r in sorted((r for r in out if r["epoch"] == e), key=lambda r: (r["block_order"], r["row_order"]))] for e in (1, 2)}
    assert sorted(order[1]) == sorted(order[2]) == list(range(50)) and order[1] != order[2] != sorted(order[2])
    other = M.mix(docs, max_repetition=5.0, seed=3).where("source = 'a'").collect()
    assert {r["row_order"] for r in out} != {r["row_order"] for r in other}


def test_odd_rows(spark, odd_docs, make_docs):
    out = M.mix(odd_docs)
    assert out.columns[:15] == odd_docs.columns and [c for c in out.columns if c not in odd_docs.columns] == ["epoch_", "block_order", "row_order"]
    first = out.where("epoch_ = 1")
    assert Counter(r["doc_id"] for r in first.collect()) == Counter(r["doc_id"] for r in odd_docs.collect())
    assert M.mix(make_docs([])).collect() == [] and M.mix(make_docs([(1, ""), (2, None)])).count() == 2


def test_main_path_is_native(spark):
    plan = M.query(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))
