"""Toxicity from subword bags averaged into a linear softmax.

A word is the bag of its byte n-grams (3 to 6, with word-boundary marks), hashed into a table of
embeddings. The embeddings of a word's n-grams are averaged, then those of a document's words, and
a linear softmax gives the document's odds. The average is scaled by a fixed gain, since a few
telling words in a hundred must be able to decide. Embeddings and softmax are trained jointly in
numpy; a misspelling never seen before shares most n-grams, and so most of its vector, with the
word it comes from.

Since the softmax is linear, the product of the embedding table with its weights is one number per
n-gram bucket: scoring needs that table (1 MB) only and runs in numpy over the bytes of many texts.

Only n-grams with evidence are learnt: found in at least ``MIN_DOCS`` words of documents, in toxic ones so
many standard deviations more often than chance, at so many times the odds. How many is chosen from
``EVIDENCE`` by the log loss over folds of the learnable rows, never by rows that are held out. All other
n-grams could only be learnt by heart and keep weight zero.

The model is fitted on the driver from at most ``train_rows`` labelled documents of at most
``train_chars`` characters; all documents are scored whole. Defined results: a null or empty text,
or one of punctuation only, scores 0; ties and repeated rows score alike, in whatever batch they come;
labels other than 0 and 1 are ignored, and so is an id labelled both ways; without labels of both
classes every score is below 1e-20; an empty table gives an empty result. Only the text enters a score,
whatever other columns are named. Texts are scored in slices of 250 KB; a longer one is a slice of its own.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from kvlake.llm.common import bounded_batches, give_back, id_crc, labelled_sample, slices, table, utf8

TRAIN_ROWS, TRAIN_CHARS, THRESHOLD = 4000, 20_000, 0.5
HELD_OUT = 0  # remainder of crc32 mod 5
SIZES, BITS, GAIN, DIM, MIN_DOCS = (3, 4, 5, 6), 18, 300.0, 8, 12
EVIDENCE = ((8.0, 4.0), (5.0, 3.0), (3.5, 2.5))  # least surplus in standard deviations, least odds
FOLDS = 2

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SOLID = np.zeros(256, bool)
_SOLID[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True
_BLANK = np.isin(np.arange(256), [0, 9, 10, 11, 12, 13, 32])


def prepare(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes with a blank around every text and for all punctuation but that inside a
    word, the places where words begin, and n + 1 word offsets by text."""
    data, offsets = utf8(column)
    n = len(offsets) - 1
    out = np.full(len(data) + n + 1, 32, np.uint8)
    at = np.arange(len(data)) + np.repeat(np.arange(1, n + 1), np.diff(offsets))
    out[at] = _LOWER[data]
    solid = _SOLID[out]
    inside = np.zeros(len(out), bool)
    inside[1:-1] = ~solid[1:-1] & solid[:-2] & solid[2:] & ~_BLANK[out[1:-1]]
    out[~(solid | inside)] = 32
    full = out != 32
    begin = np.flatnonzero(full[1:] & ~full[:-1]) + 1
    return out, begin, np.searchsorted(begin, offsets + np.arange(n + 1))


def ngram_buckets(out: np.ndarray):
    """For each n: the hash bucket of the n bytes from each place, and whether they are an n-gram of
    one word (a blank may stand at either end only)."""
    blank = np.flatnonzero(out == 32)
    after = blank[np.minimum(np.searchsorted(blank, np.arange(1, len(out) + 1)), max(len(blank) - 1, 0))] if len(blank) else np.zeros(0, np.int64)
    room = after - np.arange(len(out))  # bytes from here to the next blank
    value = out.astype(np.uint32)
    for n in range(2, max(SIZES) + 1):
        nxt = np.zeros(len(out), np.uint32)
        nxt[: len(out) - n + 1] = out[n - 1 :]
        value = value * np.uint32(0x01000193) + nxt + np.uint32(n)
        if n in SIZES:
            ok = room >= n - 1
            ok[max(0, len(out) - n + 1) :] = False
            yield n, ((value * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)).astype(np.int64), ok


def word_values(out: np.ndarray, begin: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Mean of the n-gram weights of each word (words of one byte make one 3-gram with both marks)."""
    if not len(begin):
        return np.zeros(0)
    total, count = np.zeros(len(out), np.float32), np.zeros(len(out), np.uint8)
    for _, bucket, ok in ngram_buckets(out):
        total += np.where(ok, weight[bucket], 0)
        count += ok
    return np.add.reduceat(total, begin - 1, dtype=np.float64) / np.maximum(np.add.reduceat(count, begin - 1, dtype=np.int64), 1)


@dataclass
class Toxicity:
    weight: np.ndarray
    bias: float

    def score(self, column: pa.Array) -> np.ndarray:
        out, begin, first = prepare(column)
        odds = self.bias + GAIN * mean_by_text(word_values(out, begin, self.weight), first)
        return np.where(np.diff(first) > 0, 1 / (1 + np.exp(-np.clip(odds, -50, 50))), 0.0)


def mean_by_text(words: np.ndarray, first: np.ndarray) -> np.ndarray:
    n = np.diff(first)
    out, full = np.zeros(len(n)), n > 0
    if full.any():
        out[full] = np.add.reduceat(words, first[:-1][full]) / n[full]
    return out


def choose(texts: pa.Array, y: np.ndarray, steps: int = 40) -> tuple[float, float]:
    """The evidence to ask for: that with the least log loss over ``FOLDS`` folds; the strictest of equals."""
    fold, loss = np.arange(len(y)) % FOLDS, []
    if len(set(y)) < 2:
        return EVIDENCE[0]
    for evidence in EVIDENCE:
        total = 0.0
        for k in range(FOLDS):
            p = np.clip(fit(texts.filter(pa.array(fold != k)), y[fold != k], evidence, steps).score(texts.filter(pa.array(fold == k))), 1e-6, 1 - 1e-6)
            total -= float((y[fold == k] * np.log(p) + (1 - y[fold == k]) * np.log(1 - p)).sum())
        loss.append(total)
    return EVIDENCE[int(np.argmin(loss))]


def fit(texts: pa.Array, y: np.ndarray, evidence: tuple[float, float] | None = None, steps: int = 100, rate: float = 0.01, ridge: float = 1e-5, seed: int = 11) -> Toxicity:
    """Joint maximum likelihood of embeddings and softmax by Adam; deterministic. ``evidence`` is chosen if not given."""
    y = np.asarray(y, float)
    if len(set(y)) < 2:
        return Toxicity(np.zeros(1 << BITS, np.float32), -50.0)
    surplus_least, lift_least = evidence or choose(texts, y)
    out, begin, first = prepare(texts)
    full = out != 32
    finish = np.flatnonzero(full[:-1] & ~full[1:]) + 1
    raw, seen, ids = out.tobytes(), {}, np.empty(len(begin), np.int64)
    for i, (a, b) in enumerate(zip(begin.tolist(), finish.tolist(), strict=True)):
        ids[i] = seen.setdefault(raw[a:b], len(seen))
    small = pa.array([w.decode("utf-8", "replace") for w in seen])
    o2, b2, _ = prepare(small)
    owner = np.searchsorted(b2 - 1, np.arange(len(o2)), side="right") - 1
    pairs = [(owner[ok], bucket[ok]) for _, bucket, ok in ngram_buckets(o2)]
    word, bucket = np.concatenate([p[0] for p in pairs]), np.concatenate([p[1] for p in pairs])
    word, bucket = word[word >= 0], bucket[word >= 0]
    order = np.argsort(word, kind="stable")
    word, bucket = word[order], bucket[order]
    count = np.maximum(np.bincount(word, minlength=len(b2)), 1)
    if len(b2) != len(seen):
        raise AssertionError("a word of the sample was split")
    # an n-gram without clear evidence could only be learnt by heart: it keeps weight zero
    met = np.unique(np.repeat(np.arange(len(y)), np.diff(first)) * len(b2) + ids)
    in_toxic = np.bincount(met % len(b2), y[met // len(b2)], minlength=len(b2))
    hits = np.bincount(bucket, in_toxic[word], minlength=1 << BITS)
    spread = np.bincount(bucket, np.bincount(met % len(b2), minlength=len(b2))[word], minlength=1 << BITS)
    share = hits.sum() / max(spread.sum(), 1)
    surplus = (hits - share * spread) / np.sqrt(np.maximum(spread * share * (1 - share), 1e-9))
    keep = ((spread >= MIN_DOCS) & (surplus >= surplus_least) & (hits * (1 - share) >= lift_least * share * (spread - hits)))[bucket]
    if not keep.any():
        return Toxicity(np.zeros(1 << BITS, np.float32), float(np.log(y.mean() / (1 - y.mean()))))
    word, bucket = word[keep], bucket[keep]
    used, local = np.unique(bucket, return_inverse=True)
    rng = np.random.default_rng(seed)
    params = [rng.normal(0, 0.1, (len(used), DIM)), rng.normal(0, 1, DIM), np.array([-2.0])]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
    for step in range(1, steps + 1):
        emb, soft, bias = params
        value = np.bincount(word, (emb @ soft)[local], minlength=len(b2)) / count
        odds = bias[0] + GAIN * mean_by_text(value[ids], first)
        gap = np.where(np.diff(first) > 0, 1 / (1 + np.exp(-np.clip(odds, -50, 50))) - y, 0) / len(y)
        by_word = np.bincount(ids, np.repeat(GAIN * gap / np.maximum(np.diff(first), 1), np.diff(first)), minlength=len(b2)) / count
        by_bucket = np.bincount(local, by_word[word], minlength=len(used))
        slopes = [by_bucket[:, None] * soft + ridge * emb, emb.T @ by_bucket + ridge * soft, np.array([gap.sum()])]
        for p, g, (m, v) in zip(params, slopes, moments, strict=True):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-9)
    weight = np.zeros(1 << BITS, np.float32)
    weight[used] = params[0] @ params[1]
    return Toxicity(weight, float(params[2][0]))


def train(docs: DataFrame, labels: DataFrame, fold: Column, train_rows: int = TRAIN_ROWS, train_chars: int = TRAIN_CHARS) -> Toxicity:
    """Fit from labelled documents on the true side of ``fold``, a condition on the id."""
    got = labelled_sample(docs, labels, "toxic", fold, train_rows, train_chars)
    return fit(got["text"].combine_chunks(), got["y"].to_numpy())


def score(model: Toxicity, text: Column) -> Column:
    """Toxicity of a text, 0 to 1."""
    bounded_batches()

    @F.arrow_udf("double")
    def toxicity(column: pa.Array) -> pa.Array:
        parts = [model.score(part) for part in slices(column)]
        give_back()
        return pa.array(np.concatenate(parts) if parts else np.zeros(0))

    return toxicity(text)


def query(spark, sf_dir: str) -> DataFrame:
    """op3: held-out flag, score and prediction of every document."""
    docs = table(spark, sf_dir, "documents")
    model = train(docs, table(spark, sf_dir, "labels"), id_crc("doc_id") % 5 != HELD_OUT)
    scored = docs.select("doc_id", (id_crc("doc_id") % 5 == HELD_OUT).alias("held_out"), score(model, F.col("text")).alias("score"))
    return scored.select("*", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
