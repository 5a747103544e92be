import random
from pathlib import Path

import numpy as np
import pytest
import sentencepiece as sp
from sentencepiece import sentencepiece_model_pb2 as pb

from kvlake.llm import pieces as P
from tests.conftest import SF

PROTO = Path(P.MODEL).read_bytes()
LIB = sp.SentencePieceProcessor(model_proto=PROTO)
BPE = P.Pieces(PROTO)


def unigram_proto():
    m = pb.ModelProto.FromString(PROTO)
    m.trainer_spec.model_type = 1
    for p in m.pieces:
        p.score = max(p.score, -40_000)
    return m.SerializeToString()


def texts(n, seed, low=0, high=60):
    rng, parts = random.Random(seed), [*"  thea\n\n\t.▁éß日1\U0001f600", "the ", "ing", " ", "tion", "   "]
    return ["".join(rng.choice(parts) for _ in range(rng.randint(low, high))) for _ in range(n)]


def chunked(model, text, size):
    whole, edge = model.normal(text), 2 * model.longest
    n, parts = len(whole), []
    for a in range(0, len(whole), size):
        lo, hi = max(0, a - edge), min(n, a + size + edge)
        parts.append((whole[lo:hi], a - lo, min(n, a + size) - lo))
    states = P.best_states([{(s, e): w for s, e, w in model.transfer(*p)} for p in parts])
    return np.concatenate([model.backtrace(*p, states[i], states[i + 1]) for i, p in enumerate(parts)]).tolist()


def test_same_ids_as_the_library():
    for t in texts(3000, 1) + [" " * k + "the" for k in range(40)]:
        assert BPE.encode(t).tolist() == LIB.encode(t), t


def test_supplied_texts_and_round_trip(spark):
    rows = [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    BPE.learn([BPE.split(t) for t in rows])
    for t in rows:
        ids = BPE.encode(t).tolist()
        assert ids == LIB.encode(t) and BPE.decode(ids) == t == LIB.decode(ids)


@pytest.mark.parametrize("size", [17, 33, 64])
def test_chunks_give_the_same_ids(size):
    rng = random.Random(size)
    for t in texts(150, size, 60, 300) + ["".join(rng.choice("theinga") for _ in range(250)) for _ in range(30)]:
        assert chunked(BPE, t, size) == LIB.encode(t), t


def test_unigram_model():
    proto = unigram_proto()
    lib, model, rng = sp.SentencePieceProcessor(model_proto=proto), P.Pieces(proto), random.Random(5)
    worth = lambda ids: sum(lib.get_score(i) for i in ids)
    for _ in range(200):
        t = " ".join(rng.choice(["the", "thing", "tion", "reheat", "onanst"]) + rng.choice(["er", "ing", "s", "and"]) for _ in range(rng.randint(1, 30)))
        ids = model.encode(t).tolist()
        assert abs(worth(ids) - worth(lib.encode(t))) < 0.5 and abs(worth(chunked(model, t, 40)) - worth(ids)) < 0.5


def test_product_is_associative():
    rng = random.Random(1)
    make = lambda: {((rng.randrange(3), 0), (rng.randrange(3), 0)): rng.random() for _ in range(6)}
    for _ in range(50):
        a, b, c = make(), make(), make()
        x, y = P.combine(P.combine(a, b), c), P.combine(a, P.combine(b, c))
        assert x.keys() == y.keys() and all(abs(x[k] - y[k]) < 1e-12 for k in x)


def test_merges_by_heap_and_by_scan():
    for t in texts(300, 9, 25, 80):
        assert "".join(BPE.merged(t)) == t
        short = t[:24]
        assert BPE._merged_short(list(short)) == BPE.merged(short)


def test_giant_texts_in_spark(spark, odd_docs):
    out = P.encode(odd_docs, PROTO, chunk=5000)
    rows = out.collect()
    assert len(rows) == 10 and out.columns[-2:] == ["ids_", "exact_"] and out.columns[:-2] == odd_docs.columns
    for r in rows:
        assert (r["ids_"] is None and r["exact_"] is None) if r["text"] is None else r["ids_"] == LIB.encode(r["text"])
        assert r["text"] is None or r["exact_"] == ("▁" not in r["text"])
    back = out.where("ids_ IS NOT NULL").withColumn("back", P.decode_column(out["ids_"], PROTO)).collect()
    assert all(r["back"] == r["text"].replace("▁", " ") for r in back)
    assert P.encode(odd_docs.limit(0), PROTO).collect() == []


def test_refused_models():
    m = pb.ModelProto.FromString(PROTO)
    m.normalizer_spec.remove_extra_whitespaces = True
    with pytest.raises(ValueError):
        P.Pieces(m.SerializeToString())


def test_query(spark):
    rows = P.query(spark, SF).collect()
    assert len(rows) == 200 and all(r["exact"] and r["n_tokens"] == len(r["ids"]) for r in rows)


def test_many_words_are_solved_together(monkeypatch):
    import pyarrow as pa

    rng, model, calls = random.Random(5), P.Pieces(PROTO), []
    learn = model.learn
    monkeypatch.setattr(model, "learn", lambda words: (calls.append(len(words)), learn(words)))
    rows = [" ".join("".join(rng.choice("theaingos") for _ in range(5)) for _ in range(50)) for _ in range(3000)] + [None, ""]
    ids, exact = P.encode_all(model, pa.array(rows))
    assert len(calls) == 1 and [x.tolist() for x in ids[:-2]] == LIB.encode(rows[:-2]) and all(exact[:-2])
    assert ids[-2] is None and exact[-2] is None and len(ids[-1]) == 0


def test_few_words_held_give_the_same_ids(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    many, few = ({r["doc_id"]: (r["ids"], r["exact"]) for r in P.encode(docs, PROTO, **more).collect()} for more in ({}, {"learn": 20_000, "kept": 50}))
    assert many == few and len(few) == 200
