import sentencepiece as sp

import corpus_pipeline as C
from kvlake.llm import pieces
from kvlake.llm.queries import ORACLES, QUERIES
from tests.conftest import SF
from tests.llm.test_pii import naive_spans
from tests.llm.test_simhash import slow_classes

LIB = sp.SentencePieceProcessor(model_file=pieces.MODEL)


def test_stages_one_by_one(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, {}
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    for name, stage in C.STAGES:
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        out = spark.read.parquet(str(tmp_path / name))
        rows, came = out.collect(), docs.collect()
        if name != "tokens":
            assert out.columns == columns
        if name == "quality":
            kept = {r["doc_id"] for r in rows}
            right = [(d in kept) == bool(q) for d, q in labels.items()]
            assert sum(right) / len(right) > 0.9
        elif name == "near_duplicates":
            group = slow_classes([r["text"] for r in came])
            least = {}
            for r, g in zip(came, group, strict=True):
                least[g] = min(least.get(g, r["doc_id"]), r["doc_id"])
            assert sorted(r["doc_id"] for r in rows) == sorted(least.values())
        elif name == "personal_data":
            assert len(rows) == len(came) and not any(naive_spans(r["text"]) for r in rows)
        elif name == "mixing":
            assert {r["doc_id"] for r in rows} == {r["doc_id"] for r in came} and len(rows) >= len(came)
        else:
            assert len(rows) == len(came) and all(r["ids"] == LIB.encode(before[r["doc_id"]]) and r["exact"] for r in rows)
        docs, before = out, {r["doc_id"]: r["text"] for r in rows} if "text" in out.columns else {}


def test_run_and_registry(spark):
    assert C.run(spark, SF).count() > 100
    assert {q.split("_")[0] for q in QUERIES} == {*(f"op{n}" for n in range(1, 11)), "pipeline"} and set(ORACLES) <= set(QUERIES)


def test_empty_and_odd_documents(spark, odd_docs, make_docs):
    for docs in (make_docs([]), odd_docs):
        for name, stage in C.STAGES:
            out = stage(spark, docs, SF)
            assert out.count() >= (docs.count() and name != "quality"), name
            if name != "tokens":
                assert out.columns == docs.columns


def test_one_row_of_each_group_stays(spark, make_docs):
    a, b, c, d = ("".join(f"{x}{i} " for i in range(300)) for x in ("alpha", "beta", "gamma", "delta"))
    rows = [(None, a), (None, a), (None, a), (3, b), (None, b), (4, b), (7, c), (7, d), (8, d), (7, c), (9, None), (None, "")]
    out = C.near_duplicate_stage(spark, make_docs(rows), SF).select("doc_id", "text").collect()
    assert sorted(map(tuple, out), key=str) == sorted([(None, a), (3, b), (7, c), (7, d), (9, None)], key=str)
