import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from kvlake.llm import quality as Q, toxicity as X
from kvlake.llm.common import labelled_sample
from tests.conftest import SF

BIG = "/root/testdata/sf0.1"


def auc(y, p):
    rank, y = pd.Series(p).rank().to_numpy(), np.asarray(y)
    n = y.sum()
    return (rank[y == 1].sum() - n * (n + 1) / 2) / (n * (len(y) - n))


def folds(label, mod, out):
    docs, labels = (pd.read_parquet(f"{BIG}/{t}.parquet") for t in ("documents", "labels"))
    both = docs.merge(labels, on="doc_id").drop_duplicates("doc_id")
    held = np.array([zlib.crc32(str(i).encode()) % mod == out for i in both.doc_id])
    return both[~held & (both.text.str.len() <= 20_000)], both[held]


def test_quality_held_out():
    train, test = folds("quality", 4, Q.HELD_OUT)
    model = Q.fit(pa.array(train.text.iloc[:1500]), train.quality.to_numpy()[:1500])
    score = model.score(*Q.line_features(pa.array(test.text)))
    assert auc(test.quality, score) > 0.98 and ((score >= Q.THRESHOLD) == test.quality).mean() > 0.97


def test_toxicity_held_out():
    train, test = folds("toxic", 5, X.HELD_OUT)
    model = X.fit(pa.array(train.text), train.toxic.to_numpy(), steps=100)
    score = model.score(pa.array(test.text))
    assert auc(test.toxic, score) > 0.93 and ((score >= 0.5) == test.toxic).mean() > 0.97


def test_misspellings_share_ngrams():
    rng = np.random.default_rng(1)
    calm = ["the quick river runs along stone " * 3, "many people walk in green gardens " * 3, "she wrote a letter about the weather " * 3]
    texts = [calm[rng.integers(3)] + ("you horrible idiot " if i % 2 else "you lovely person ") for i in range(200)]
    model = X.fit(pa.array(texts), np.arange(200) % 2, steps=80)
    seen = model.score(pa.array([calm[0] + "you horribble idiott", calm[0] + "you lovelly persoon"]))
    assert seen[0] > 0.5 > seen[1]


def slow_marginals(u, turn):
    n, z, out = len(u), 0.0, np.zeros(len(u))
    for path in range(2**n):
        y = [path >> i & 1 for i in range(n)]
        w = np.exp(sum(u[i] * y[i] for i in range(n)) + sum(turn[a, b] for a, b in zip(y, y[1:])))
        z += w
        out += w * np.array(y)
    return out / z


def test_forward_backward_against_all_paths():
    rng = np.random.default_rng(2)
    u, turn = rng.normal(size=(4, 7)), rng.normal(size=(2, 2))
    mask = np.arange(7)[None, :] < np.array([7, 5, 2, 1])[:, None]
    got, pairs = Q.forward_backward(u, mask, turn)
    for i, n in enumerate((7, 5, 2, 1)):
        assert np.allclose(got[i, :n], slow_marginals(u[i, :n], turn))
    assert np.isclose(pairs.sum(), mask[:, 1:].sum())


def test_line_features_do_not_depend_on_neighbouring_texts():
    texts = ["A b, c!\n\nd d d\n", "", None, "x", "é\n#$% 12 || A A", "\n", "w " * 5000]
    whole, length, first = Q.line_features(pa.array(texts))
    for i, t in enumerate(texts):
        x, n, _ = Q.line_features(pa.array([t], pa.string()))
        assert np.allclose(x, whole[first[i] : first[i + 1]]) and (n == length[first[i] : first[i + 1]]).all()
    assert np.diff(first).tolist() == [3, 0, 0, 1, 2, 1, 1]
    assert len(Q.line_features(pa.array([], pa.string()))[0]) == 0


def test_scores_do_not_depend_on_the_batch():
    train, test = folds("toxic", 5, X.HELD_OUT)
    tox = X.fit(pa.array(train.text.iloc[:300]), train.toxic.to_numpy()[:300], steps=20)
    good = Q.fit(pa.array(train.text.iloc[:300]), train.quality.to_numpy()[:300], steps=20)
    texts = test.text.iloc[:40].tolist()
    alone = [tox.score(pa.array([t]))[0] for t in texts], [good.score(*Q.line_features(pa.array([t])))[0] for t in texts]
    assert np.allclose(tox.score(pa.array(texts)), alone[0]) and np.allclose(good.score(*Q.line_features(pa.array(texts))), alone[1])


@pytest.mark.parametrize("op, mod, out", [(Q, 4, Q.HELD_OUT), (X, 5, X.HELD_OUT)])
def test_queries(spark, op, mod, out):
    got = op.query(spark, SF)
    assert [c for c, _ in got.dtypes] == ["doc_id", "held_out", "score", "predicted"]
    rows = got.collect()
    assert len(rows) == 200 and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= op.THRESHOLD) for r in rows)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % mod == out) for r in rows)


def test_odd_rows(spark, odd_docs, make_docs):
    labels = spark.createDataFrame([(4, 1, 0), (6, 0, 1), (7, None, 3), (None, 1, 1), (99, 0, 0)], "doc_id long, quality int, toxic int")
    for op, empty in ((Q, 0.0), (X, 0.0)):
        for have in (labels, labels.limit(0)):
            model = op.train(odd_docs, have, F.lit(True))
            got = {r["doc_id"]: r["s"] for r in odd_docs.withColumn("s", op.score(model, F.col("text"))).collect()}
            assert got[1] == got[2] == empty and all(0 <= s <= 1 for s in got.values())
            assert make_docs([]).withColumn("s", op.score(model, F.col("text"))).collect() == []


def test_labels_that_clash_and_ids_that_repeat(spark, make_docs):
    docs = make_docs([(1, "b text"), (1, "a text"), (1, "c text"), (2, "two"), (3, "three"), (None, "none")])
    labels = spark.createDataFrame([(1, 1), (1, 1), (2, 0), (2, 1), (3, 0), (None, 1), (9, 1)], "doc_id long, toxic int")
    got = labelled_sample(docs, labels, "toxic", F.lit(True), 10, 100).to_pylist()
    assert got == [{"doc_id": 1, "text": "a text", "y": 1}, {"doc_id": 3, "text": "three", "y": 0}]


def test_one_long_text_costs_no_more_than_itself():
    first = np.concatenate(([0], np.cumsum([2] * 500 + [50_000] + [0, 3])))
    blocks = list(Q._blocks(first))
    assert sum(m.size for _, m in blocks) < 1.2 * first[-1] and max(len(m) for _, m in blocks if m.shape[1] == 50_000) == 1
    places = np.sort(np.concatenate([p[m] for p, m in blocks]))
    assert (places == np.arange(first[-1])).all()
    x = np.random.default_rng(3).normal(size=(first[-1], Q.N_FEATURES)).astype(np.float32)
    crf = Q.LineCrf(*(np.random.default_rng(4).normal(size=(3, Q.N_FEATURES)) / 9), 0.1, np.array([[0.5, -0.2], [0.1, 0.3]]), np.zeros(Q.N_FEATURES), np.ones(Q.N_FEATURES))
    good = crf.goodness(x, np.ones(len(x), np.int64), first)
    assert np.isclose(good[0], slow_marginals(crf.unary(x[:2], np.array([0, 2])), crf.turn).mean()) and np.isclose(good[-1], slow_marginals(crf.unary(x[-3:], np.array([0, 3])), crf.turn).mean())
    assert np.isnan(good[-2])


def test_toxicity_against_a_slow_scorer():
    rng = np.random.default_rng(5)
    model = X.Toxicity(rng.normal(size=1 << X.BITS).astype(np.float32) / 50, -0.3)
    texts = ["You horrible idi0t, g0 away!", "ÄÖ ü 日本 x", "", "...", "a b", "don't re-do e.g. this", "word " * 50]
    for t, got in zip(texts, model.score(pa.array(texts)), strict=True):
        raw = bytes(b + 32 if 65 <= b <= 90 else b for b in t.encode())
        solid = [48 <= b <= 57 or 97 <= b <= 122 or b >= 128 for b in raw]
        keep = [s or 0 < i < len(raw) - 1 and solid[i - 1] and solid[i + 1] and raw[i] not in b"\0\t\n\x0b\f\r " for i, s in enumerate(solid)]
        words = bytes(b if k else 32 for b, k in zip(raw, keep)).split(b" ")
        values = []
        for w in filter(None, words):
            marked, found = b" " + w + b" ", []
            for n in X.SIZES:
                for i in range(len(marked) - n + 1):
                    h = marked[i]
                    for k in range(2, n + 1):
                        h = (h * 0x01000193 + marked[i + k - 1] + k) % 2**32
                    found.append(float(model.weight[(h * 0x9E3779B1 % 2**32) >> (32 - X.BITS)]))
            values.append(sum(found) / max(len(found), 1))
        want = 1 / (1 + np.exp(0.3 - X.GAIN * np.mean(values))) if values else 0.0
        assert np.isclose(got, want, atol=1e-4), t
