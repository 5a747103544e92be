"""Document quality from a linear-chain conditional random field over lines.

Every line is labelled good or bad. The unary potential of a line is linear in its own features and
in those of the lines before and after it; a 2 x 2 table scores label changes between neighbours.
Forward-backward gives each line's marginal, and the length-weighted mean of the marginals, put
through a logistic calibration, is the document's score.

Line labels are not given, only document labels: lines of good documents count as good; lines of
bad documents count as bad unless a first, independent fit finds them clearly good (a bad document
may hold normal passages; it keeps at least its worst line as bad). The model is fitted on the
driver from at most ``train_rows`` labelled documents of at most ``train_chars`` characters; the
weights, a few hundred numbers, travel to the executors inside the scoring function.

Texts are scored in blocks of similar numbers of lines and a bounded number of cells, so that one text
of very many lines costs no more than itself.

Defined results: a null or empty text has no line and scores 0; very long texts are scored whole;
ties and repeated rows are scored alike; labels other than 0 and 1 are ignored, and so is an id labelled
both ways; without labels of both classes the score is 1 for any text that is not empty; an empty table
gives an empty result. Other columns, whatever their names, never enter a score.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from kvlake.llm.common import bounded_batches, give_back, id_crc, labelled_sample, slices, table, utf8

TRAIN_ROWS, TRAIN_CHARS, THRESHOLD = 3000, 20_000, 0.7
HELD_OUT, CELLS = 2, 50_000  # remainder of crc32 mod 4; cells of a block

_CLASSES = {
    "upper": [*range(65, 91)],
    "lower": [*range(97, 123)],
    "digit": [*range(48, 58)],
    "wide": [*range(128, 256)],
    "space": [9, 11, 12, 13, 32],
    "stop": [33, 44, 46, 58, 59, 63],
    "bang": [33],
    "bar": [124],
    "mark": [*b"#$%&*+/<=>@\\^_`{|}~[]"],
}
_LUT = {k: np.isin(np.arange(256), v).astype(np.uint8) for k, v in _CLASSES.items()}
_MULT = (np.random.default_rng(7).integers(1, 2**62, 256, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)


def _per(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    return np.add.reduceat(values, starts, dtype=np.int64) if len(starts) else np.zeros(0, np.int64)


def line_features(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of every line of every text, line lengths in bytes, and n + 1 line offsets by text."""
    data, offsets = utf8(column)
    if not len(data):
        return np.zeros((0, N_FEATURES), np.float32), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    starts = np.flatnonzero(data == 10) + 1
    starts = np.unique(np.concatenate((offsets[:-1][np.diff(offsets) > 0], starts[starts < len(data)])))
    first = np.searchsorted(starts, offsets)
    length = np.diff(np.append(starts, len(data)))
    n = {k: _per(lut[data], starts) for k, lut in _LUT.items()}
    # words: maximal runs without ASCII white space; hashed by byte and place in the word
    blank = _LUT["space"][data] | (data == 10)
    begin = blank == 0
    begin[1:] &= blank[:-1] == 1
    begin[starts] = blank[starts] == 0
    words = np.flatnonzero(begin)
    line = np.searchsorted(starts, words, side="right") - 1
    n_words = np.bincount(line, minlength=len(starts))
    if len(words):
        place = np.arange(len(data), dtype=np.int64)
        place[words[0] :] -= np.repeat(words, np.diff(words, append=len(data)))
        value = _MULT[data] * (np.uint64(2) * place.view(np.uint64) + np.uint64(3))
        del place
        value[blank == 1] = 0
        value[: words[0]] = 0
        hashed = np.add.reduceat(value, words)
        same = np.zeros(len(words), bool)
        same[1:] = (hashed[1:] == hashed[:-1]) & (line[1:] == line[:-1])
        again = np.bincount(line[same], minlength=len(starts))
        order = np.lexsort((hashed, line))
        new = np.ones(len(words), bool)
        new[1:] = (hashed[order][1:] != hashed[order][:-1]) | (line[order][1:] != line[order][:-1])
        distinct = np.bincount(line[order][new], minlength=len(starts))
        line_hash = np.zeros(len(starts), np.uint64)
        np.add.at(line_hash, line, hashed * (np.uint64(2) * (np.arange(len(words)) - np.searchsorted(line, line)).astype(np.uint64) + np.uint64(1)))
    else:
        again = distinct = np.zeros(len(starts), np.int64)
        line_hash = np.zeros(len(starts), np.uint64)
    text = np.searchsorted(first, np.arange(len(starts)), side="right") - 1
    order = np.lexsort((line_hash, text))
    twin = np.zeros(len(starts), bool)
    equal = (line_hash[order][1:] == line_hash[order][:-1]) & (text[order][1:] == text[order][:-1])
    twin[order[1:][equal]] = True
    letters = np.maximum(n["upper"] + n["lower"] + n["wide"], 1)
    solid = np.maximum(length - n["space"], 1)
    tokens = np.maximum(n_words, 1)
    last = np.minimum(starts + length - 1, len(data) - 1)
    last = np.where((data[last] == 10) & (length > 1), last - 1, last)
    ratio = np.stack([n["upper"] / letters, n["digit"] / solid, n["stop"] / solid, n["mark"] / solid, n["bang"] / tokens, n["bar"] / tokens, again / tokens, 1 - distinct / tokens, n["wide"] / letters, n["stop"] / tokens, n["mark"] / tokens], axis=1)
    rest = np.stack([np.log1p(length) / 8, np.log1p(n_words) / 6, np.minimum(solid / tokens, 30) / 10, _LUT["stop"][data[last]], twin, n_words < 3], axis=1)
    ratio = np.minimum(ratio, 3)
    return np.concatenate((ratio, np.sqrt(ratio), rest), axis=1).astype(np.float32), length, first


N_FEATURES = 11 * 2 + 6


@dataclass
class LineCrf:
    """own, before, after: weights of a line's features and its neighbours'; turn[i, j]: score of
    label j after label i (1 is good); scale and shift standardise; slope and cut calibrate."""

    own: np.ndarray
    before: np.ndarray
    after: np.ndarray
    bias: float
    turn: np.ndarray
    shift: np.ndarray
    scale: np.ndarray
    slope: float = 1.0
    cut: float = 0.0

    def unary(self, x: np.ndarray, first: np.ndarray) -> np.ndarray:
        x = (x - self.shift) / self.scale
        u, p, q = x @ self.own + self.bias, x @ self.before, x @ self.after
        if len(u):
            head, tail = first[:-1][np.diff(first) > 0], first[1:][np.diff(first) > 0] - 1
            left, right = np.roll(p, 1), np.roll(q, -1)
            left[head], right[tail] = 0, 0
            u = u + left + right
        return u

    def goodness(self, x: np.ndarray, length: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Length-weighted mean marginal of label good by text; NaN for texts without a line."""
        u = self.unary(x, first)
        texts = np.flatnonzero(np.diff(first) > 0)
        good = np.zeros(len(u))
        for place, mask in _blocks(first):
            good[place[mask]] = forward_backward(np.where(mask, u[place], 0), mask, self.turn)[0][mask]
        out = np.full(len(first) - 1, np.nan)
        if len(texts):
            out[texts] = np.add.reduceat(good * length, first[texts]) / np.add.reduceat(length, first[texts])
        return out

    def score(self, x: np.ndarray, length: np.ndarray, first: np.ndarray) -> np.ndarray:
        mean = self.goodness(x, length, first)
        return np.where(np.isnan(mean), 0.0, 1 / (1 + np.exp(-np.clip(self.slope * np.nan_to_num(mean) + self.cut, -50, 50))))


def _blocks(first: np.ndarray, cells: int = CELLS):
    """(places, mask) of blocks of texts, fewest lines first: places[i, j] is line j of a block's text i where mask is set. A
    block has at most ``cells`` cells, or one text."""
    n = np.diff(first)
    order = np.argsort(n, kind="stable")
    order, at = order[n[order] > 0], 0
    while at < len(order):
        # as many texts as fit at the width of the last of them
        room = n[order[at:]] * np.arange(1, len(order) - at + 1)
        to = at + max(1, int(np.searchsorted(room, cells, side="right")))
        rows, width = order[at:to], int(n[order[to - 1]])
        mask = np.arange(width)[None, :] < n[rows][:, None]
        yield np.where(mask, first[:-1][rows][:, None] + np.arange(width), 0), mask
        at = to


def forward_backward(u: np.ndarray, mask: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marginals of label 1 by (chain, place), and expected label changes summed over chains (2 x 2).
    u is the score of label 1 against 0; log space, vectorised over chains."""
    n, width = u.shape
    alpha, beta = np.zeros((width, n, 2)), np.zeros((width, n, 2))
    if width:
        alpha[0, :, 1] = u[:, 0]
    for t in range(1, width):
        step = np.logaddexp(alpha[t - 1, :, 0, None] + turn[0], alpha[t - 1, :, 1, None] + turn[1])
        step[:, 1] += u[:, t]
        alpha[t] = np.where(mask[:, t, None], step, alpha[t - 1])
    for t in range(width - 2, -1, -1):
        ahead = beta[t + 1].copy()
        ahead[:, 1] += u[:, t + 1]
        step = np.logaddexp(turn[:, 0] + ahead[:, 0, None], turn[:, 1] + ahead[:, 1, None])
        beta[t] = np.where(mask[:, t + 1, None], step, 0)
    both = alpha + beta
    marginal = np.where(mask, (1 / (1 + np.exp(np.clip(both[:, :, 0] - both[:, :, 1], -50, 50)))).T, 0)
    pairs = np.zeros((2, 2))
    if width > 1:
        total = np.logaddexp(alpha[-1, :, 0], alpha[-1, :, 1])
        for i in range(2):
            for j in range(2):
                p = alpha[:-1, :, i].T + turn[i, j] + beta[1:, :, j].T + (u[:, 1:] if j else 0) - total[:, None]
                pairs[i, j] = np.exp(np.minimum(p, 0))[mask[:, 1:]].sum()
    return marginal, pairs


def _logistic(x: np.ndarray, y: np.ndarray, steps: int = 25, ridge: float = 1e-2) -> np.ndarray:
    """Newton's method with ridge; the last weight is the bias."""
    x = np.concatenate((x, np.ones((len(x), 1))), axis=1)
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hess = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        w += np.linalg.solve(hess, x.T @ (y - p) - ridge * w)
    return w


def fit(texts: pa.Array, y: np.ndarray, steps: int = 120, ridge: float = 1e-3) -> LineCrf:
    """Conditional maximum likelihood by Adam; deterministic."""
    x, length, first = line_features(texts)
    n, y = x.shape[1], np.asarray(y, float)
    crf = LineCrf(np.zeros(n), np.zeros(n), np.zeros(n), 0.0, np.zeros((2, 2)), x.mean(axis=0) if len(x) else np.zeros(n), x.std(axis=0) + 1e-3 if len(x) else np.ones(n))
    if len(set(y)) < 2 or not len(x):
        crf.cut = 50.0
        return crf
    lines = np.diff(first)
    label = np.repeat(y, lines)
    z = ((x - crf.shift) / crf.scale).astype(np.float64)
    alone = np.concatenate((z, np.ones((len(z), 1))), axis=1) @ _logistic(z, label, ridge=1.0)
    label[(label == 0) & (alone > 1.5)] = 1
    for a, b, doc in zip(first[:-1], first[1:], y, strict=True):
        if b > a and not doc and label[a:b].all():
            label[a + np.argmin(alone[a:b])] = 0
    head, tail = first[:-1][lines > 0], first[1:][lines > 0] - 1
    gold, inner = label.astype(int), np.ones(len(z), bool)
    inner[head] = False
    seen = np.array([[np.sum(inner[1:] & (gold[:-1] == i) & (gold[1:] == j)) for j in range(2)] for i in range(2)], float)
    left, right = np.roll(z, 1, axis=0), np.roll(z, -1, axis=0)
    left[head], right[tail] = 0, 0
    wide = np.concatenate((z, left, right, np.ones((len(z), 1))), axis=1)
    w = np.zeros(wide.shape[1] + 4)
    w[-5] = 1.0
    m, v, blocks = np.zeros_like(w), np.zeros_like(w), list(_blocks(first))
    for step in range(1, steps + 1):
        u, marginal, pairs = wide @ w[:-4], np.zeros(len(z)), np.zeros((2, 2))
        for place, mask in blocks:
            got, changes = forward_backward(np.where(mask, u[place], 0), mask, w[-4:].reshape(2, 2))
            marginal[place[mask]] = got[mask]
            pairs += changes
        slope = np.concatenate((wide.T @ (label - marginal), (seen - pairs).ravel())) / len(z) - ridge * w
        m, v = 0.9 * m + 0.1 * slope, 0.99 * v + 0.01 * slope**2
        w += 0.08 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    crf.own, crf.before, crf.after, crf.bias, crf.turn = w[:n], w[n : 2 * n], w[2 * n : 3 * n], float(w[-5]), w[-4:].reshape(2, 2)
    mean = crf.goodness(x, length, first)
    ok = ~np.isnan(mean)
    crf.slope, crf.cut = map(float, _logistic(mean[ok, None], y[ok], ridge=0.05))
    return crf


def train(docs: DataFrame, labels: DataFrame, fold: Column, train_rows: int = TRAIN_ROWS, train_chars: int = TRAIN_CHARS) -> LineCrf:
    """Fit from labelled documents on the true side of ``fold``, a condition on the id."""
    got = labelled_sample(docs, labels, "quality", fold, train_rows, train_chars)
    return fit(got["text"].combine_chunks(), got["y"].to_numpy())


def score(model: LineCrf, text: Column) -> Column:
    """Quality of a text, 0 to 1."""
    bounded_batches()

    @F.arrow_udf("double")
    def quality(column: pa.Array) -> pa.Array:
        parts = [model.score(*line_features(part)) for part in slices(column)]
        give_back()
        return pa.array(np.concatenate(parts) if parts else np.zeros(0))

    return quality(text)


def learnable() -> Column:
    """Labelled rows that may be learnt from."""
    return id_crc("doc_id") % 4 != HELD_OUT


def query(spark, sf_dir: str) -> DataFrame:
    """op4: held-out flag, score and prediction of every document."""
    docs = table(spark, sf_dir, "documents")
    model = train(docs, table(spark, sf_dir, "labels"), learnable())
    scored = docs.select("doc_id", (id_crc("doc_id") % 4 == HELD_OUT).alias("held_out"), score(model, F.col("text")).alias("score"))
    return scored.select("*", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
