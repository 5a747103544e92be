"""SentencePiece encoding and decoding by a max-plus parallel scan.

Encoding is a best path in the lattice of vocabulary pieces over the text. Scores live in the
max-plus semiring: paths add, alternatives take the maximum.

* Unigram models: a piece is worth its score, and the best path is the encoding.
* BPE models: a sequence of pieces is the encoding exactly if no merge of the model crosses any of
  its inner borders, which depends on two neighbouring pieces only. A pair is worth 0 if merging its
  joined text gives back that pair and minus infinity otherwise; just one path is worth 0, and it is
  the one that the model's merges give.

A giant text is cut into chunks. The state at a cut is the piece that covers the character before
it (for Unigram, where that piece ends). A chunk yields its transfer matrix, from the states at its
left cut to those at its right cut; matrices are combined pairwise up a tree (the max-plus product
is associative), the best states at all cuts are read off down the same tree, and every chunk is
then backtraced by itself. Chunks of one text are spread over the cluster and only matrices of a
few entries meet by text. Shorter texts are one chunk.

No piece of a model may run over the start of a word or over a newline (checked when it is read):
there all states meet, so words are solved once and kept in a bounded table.

Defined results: a null text gives null ids, an empty text none; a character without a piece is
spelt in byte pieces (or is the unknown piece, where a model has none); repeated rows give
repeated results; an empty table gives an empty result; other columns are carried along. Decoding
gives back every text but those that hold U+2581 themselves (the model's sign for a space, which
comes back as a space, as in the public library). Models with a normaliser other than the identity
are refused.
"""

from __future__ import annotations

import heapq
import re
from array import array
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from kvlake.llm.common import bounded_batches, checkpoint, fresh, give_back, slices, table

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
CHUNK, SPACE, NONE = 65_536, "▁", -float("inf")
_WORDS_KEPT, _PAIRS_KEPT = 250_000, 600_000
LEARN_BYTES = 1_000_000  # of text whose words are solved together: the more, the more beginnings they share
_SPANS = re.compile(f"{SPACE}+[^{SPACE}\n]*|\n[^{SPACE}\n]*|[^{SPACE}\n]+")
State = tuple[int, int]  # characters of the piece before the cut and after it
START, END = (0, 0), (0, 0)


class _Words(dict):
    """Ids of a word, as bytes of int32, solved when first met. When full, the table becomes the old
    generation and words still in use move over to the new one."""

    def __init__(self, solve, prefix: str):
        super().__init__()
        self.solve, self.prefix, self.old, self.kept = solve, prefix, {}, _WORDS_KEPT

    def __missing__(self, word: str) -> bytes:
        if (found := self.old.get(word)) is None:
            found = self.solve(word if word[:1] == "\n" else self.prefix + word)
        if len(word) <= 48:
            self.put(word, found)
        return found

    def put(self, word: str, found: bytes) -> None:
        if len(self) >= self.kept:
            self.old = dict(self)
            self.clear()
        self[word] = found


class Pieces:
    """A SentencePiece model: its lattice, and encoding and decoding of single texts."""

    def __init__(self, proto: bytes):
        from sentencepiece import sentencepiece_model_pb2 as pb

        model = pb.ModelProto.FromString(proto)
        spec, kind = model.normalizer_spec, model.trainer_spec.model_type
        if spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.escape_whitespaces or kind not in (1, 2):
            raise ValueError("only Unigram and BPE models with the identity normaliser are supported")
        self.bpe, self.dummy = kind == 2, spec.add_dummy_prefix
        self.ids = {p.piece: i for i, p in enumerate(model.pieces) if p.type in (1, 4)}
        self.scores = {p.piece: p.score for p in model.pieces if p.type in (1, 4)}
        self.bytes = {int(p.piece[3:5], 16): i for i, p in enumerate(model.pieces) if p.type == 6}
        self.unknown = next((i for i, p in enumerate(model.pieces) if p.type == 2), 0)
        self.longest = max(map(len, self.ids), default=1)
        self.tails = {p[i:] for p in self.ids for i in range(len(p))}
        if any(re.search(f"[^{SPACE}]{SPACE}|\n.|.\n", p, re.S) for p in self.ids):
            raise ValueError("a piece runs over the start of a word")
        self.worst = min(self.scores.values(), default=0.0) - 10
        self.spelt = [b"" for _ in model.pieces]
        for i, p in enumerate(model.pieces):
            self.spelt[i] = bytes([int(p.piece[3:5], 16)]) if p.type == 6 else " ⁇ ".encode() if p.type == 2 else b"" if p.type == 3 else p.piece.replace(SPACE, " ").encode()
        self.names, self.count = [p.piece for p in model.pieces], len(model.pieces)
        self.score_of = [p.score for p in model.pieces]
        self.pairs: dict[int, bool] = {}
        self.words = _Words(self.solve, SPACE)
        self.spans = _Words(self.solve, "")

    # -- the lattice ---------------------------------------------------------------------------

    def merged(self, text: str) -> list[str]:
        """Symbols after all merges of a BPE model: best score first, leftmost of equals."""
        if len(text) <= 24:
            return self._merged_short(list(text))
        piece, after, before = list(text), list(range(1, len(text) + 1)), list(range(-1, len(text) - 1))
        heap: list[tuple[float, int, str]] = []

        def offer(i: int) -> None:
            if i >= 0 and after[i] < len(text) and (s := self.scores.get(joined := piece[i] + piece[after[i]])) is not None:
                heapq.heappush(heap, (-s, i, joined))

        for i in range(len(text) - 1):
            offer(i)
        while heap:
            _, i, joined = heapq.heappop(heap)
            j = after[i]
            if j < len(text) and piece[i] and piece[j] and piece[i] + piece[j] == joined:
                piece[i], piece[j], after[i] = joined, "", after[j]
                if after[j] < len(text):
                    before[after[j]] = i
                offer(i)
                offer(before[i])
        return [p for p in piece if p]

    def _merged_short(self, piece: list[str]) -> list[str]:
        """The same by plain scanning."""
        scores = self.scores
        offers = [scores.get(a + b, NONE) for a, b in zip(piece, piece[1:])]
        while offers and (best := max(offers)) > NONE:
            i = offers.index(best)
            piece[i : i + 2] = [piece[i] + piece[i + 1]]
            del offers[i]
            if i:
                offers[i - 1] = scores.get(piece[i - 1] + piece[i], NONE)
            if i < len(offers):
                offers[i] = scores.get(piece[i] + piece[i + 1], NONE)
        return piece

    def fits(self, a: str, b: str) -> bool:
        """Whether no merge crosses the border between two pieces."""
        return self.merged(a + b) == [a, b]

    def _fit(self, a: int, b: int) -> bool:
        """The same by id, remembered."""
        if len(self.pairs) >= _PAIRS_KEPT:
            self.pairs.clear()
        fit = self.pairs[a * self.count + b] = self.fits(self.names[a], self.names[b])
        return fit

    def extend(self, text: str, size: list[int], tok: list[int], worth: list[float], first: str | None = None) -> None:
        """Best paths from the start of ``text`` (after the piece ``first``, if given) to every place not
        yet in the lists: length and id (-1: a character without a piece) of the last piece on each,
        and the path's worth. A place that no path reaches has length 0 and worth NONE."""
        ids, tails, known, count, scores = self.ids.get, self.tails, self.pairs.get, self.count, self.score_of
        bpe, worst = self.bpe, self.worst
        for i in range(len(size), len(text) + 1):
            j = i - 1
            found = [(j, ids(text[j:i], -1))]
            while j:  # pieces that end here, shortest first
                j -= 1
                piece = text[j:i]
                if piece not in tails:
                    break
                if (k := ids(piece)) is not None:
                    found.append((j, k))
            best, length, last = NONE, 0, -1
            if bpe:
                while found:
                    j, k = found.pop()
                    if not j:
                        fit = first is None or self.fits(first, text[:i])
                    elif not (back := size[j]):
                        continue
                    elif k < 0 or (a := tok[j]) < 0:
                        fit = self.fits(text[j - back : j], text[j:i])
                    elif (fit := known(a * count + k)) is None:
                        fit = self._fit(a, k)
                    if fit:
                        best, length, last = 0.0, i - j, k
                        break
            else:
                for j, k in reversed(found):
                    if (w := worth[j] + (scores[k] if k >= 0 else worst)) > best:
                        best, length, last = w, i - j, k
            worth.append(best)
            size.append(length)
            tok.append(last)

    def sweep(self, text: str, at: int, to: int, first: str | None = None) -> tuple[list[int], list[int], list[float]]:
        lists = [0], [-1], [0.0]
        self.extend(text[at:to], *lists, first)
        return lists

    def spell(self, text: str, size: list[int], tok: list[int]) -> bytes:
        """Ids of the best path over ``text``, as bytes of int32."""
        out, i = [], len(text)
        while i:
            if (k := tok[i]) >= 0:
                out.append(k)
            elif self.bytes:
                out += [self.bytes[x] for x in reversed(text[i - 1].encode())]
            else:
                out.append(self.unknown)
            i -= size[i]
        return array("i", out[::-1]).tobytes()

    def solve(self, span: str, first: str | None = None) -> bytes:
        """Ids of the best path over a whole span."""
        size, tok, _ = self.sweep(span, 0, len(span), first)
        return self.spell(span, size, tok)

    def split(self, text: str) -> list[str]:
        """Words without their leading mark, or [""] where a text needs the careful way: it has marks of
        its own or runs of spaces. A newline begins a word that has no mark."""
        return text.replace("\n", " \n").split(" ") if self.dummy and SPACE not in text else [""]

    def learn(self, texts: list[list[str]]) -> None:
        """Solve the words of some split texts that are not in the table yet, in sorted order: words
        with a common beginning share the paths over it."""
        met = set().union(*texts)
        met.discard("")
        words, old, past = self.words, self.words.old, ""
        size, tok, worth = lists = [0], [-1], [0.0]
        for word in sorted(w for w in met if len(w) <= 48 and w not in words and w not in old):
            same = 0
            for x, y in zip(past, word):
                if x != y:
                    break
                same += 1
            if (word[0] == "\n") != (past[:1] == "\n"):
                same = -1
            span = word if word[0] == "\n" else SPACE + word
            keep = same + 1 + (word[0] != "\n")
            del size[keep or 1 :], tok[keep or 1 :], worth[keep or 1 :]
            self.extend(span, *lists)
            words.put(word, self.spell(span, size, tok))
            past = word

    def forget(self) -> None:
        """Empty the tables of words; worker processes outlive their tasks."""
        for words in (self.words, self.spans):
            words.clear()
            words.old = {}

    # -- whole texts ---------------------------------------------------------------------------

    def normal(self, text: str) -> str:
        return (SPACE if self.dummy else "") + text.replace(" ", SPACE) if text else ""

    def encode(self, text: str, words: list[str] | None = None) -> np.ndarray:
        """Ids of a text; ``words`` is what split gave for it."""
        if not text:
            return np.zeros(0, np.int32)
        words = words or self.split(text)
        if words[0] == "" and words[1:2] and words[1][:1] == "\n" and text[0] == "\n":
            # the mark before a leading newline
            found = self.spans[SPACE] + b"".join(map(self.words.__getitem__, words[1:])) if "" not in words[1:] else None
        else:
            found = b"".join(map(self.words.__getitem__, words)) if "" not in words else None
        if found is None:
            found = b"".join(map(self.spans.__getitem__, _SPANS.findall(self.normal(text))))
        return np.frombuffer(found, np.int32)

    def decode(self, ids) -> str:
        spelt = self.spelt
        text = b"".join([spelt[i] for i in ids]).decode("utf-8", "replace")
        return text[1:] if self.dummy and text[:1] == " " else text

    # -- chunks of a giant text ------------------------------------------------------------------

    def states(self, text: str, cut: int) -> list[State]:
        """Pieces that cover the character before ``cut``: (characters before it, after it)."""
        out = []
        for back in range(1, min(self.longest, cut) + 1):
            for ahead in range(min(self.longest - back, len(text) - cut) + 1):
                if back + ahead == 1 or text[cut - back : cut + ahead] in self.ids:
                    out.append((back, ahead))
        return out

    def _resets(self, text: str, a: int, b: int) -> tuple[int, int] | None:
        """The first and last place in (a, b] where a span begins, so that all states meet."""
        found = [m.start() for m in re.finditer(f"(?<=[^{SPACE}]){SPACE}|\n", text[a - 1 if a else 0 : b])]
        found = [x + (a - 1 if a else 0) for x in found]
        found = [x for x in found if x >= a + self.longest and x > 0]
        return (found[0], found[-1]) if found else None

    def transfer(self, text: str, a: int, b: int) -> list[tuple[State, State, float]]:
        """Max-plus matrix of the chunk [a, b) of ``text``, which also holds some characters around it.
        a = 0 is the start of the text and b = len(text) its end."""
        lefts = [START] if a == 0 else self.states(text, a)
        meet = self._resets(text, a, b)
        far = min(len(text), b + self.longest)

        def tails(at: int, first: str | None, base: float):
            size, _, worth = self.sweep(text, at, far if b < len(text) else b, first)
            if b == len(text):
                return [(END, base + worth[-1])] if worth[-1] > NONE else []
            return [((n - (e - b), e - b), base + worth[e - at]) for e in range(max(b, at + 1), far + 1) if (n := size[e - at]) and e - n < b]

        out, shared = [], None
        for left in lefts:
            at = a + left[1]
            first = text[a - left[0] : at] if a else None
            if meet and at <= meet[0]:
                if at < meet[0]:
                    base = self.sweep(text, at, meet[0], first)[2][-1]
                else:
                    base = 0.0
                if base > NONE:
                    if shared is None:
                        middle = 0.0 if self.bpe else self._between(text, *meet)
                        shared = [(s, w + middle) for s, w in tails(meet[1], None, 0.0)]
                    out += [(left, s, base + w) for s, w in shared]
            elif at >= b and b < len(text):
                out.append((left, (b - a + left[0], at - b), 0.0))
            else:
                out += [(left, s, w) for s, w in tails(at, first, 0.0)]
        return out

    def _between(self, text: str, a: int, b: int) -> float:
        return self.sweep(text, a, b)[2][-1] if b > a else 0.0

    def backtrace(self, text: str, a: int, b: int, left: State, right: State) -> np.ndarray:
        """Ids of the pieces that begin in the chunk, between two states of its cuts."""
        at, end = a + left[1], b + right[1] if b < len(text) else b
        if at >= b and b < len(text):
            return np.zeros(0, np.int32)
        first = text[a - left[0] : at] if a else None
        meet = self._resets(text, a, b)
        if not meet or at > meet[0]:
            return np.frombuffer(self._path(text, at, end, first), np.int32)
        parts = [self._path(text, at, meet[0], first), *map(self.spans.__getitem__, _SPANS.findall(text[meet[0] : meet[1]])), self._path(text, meet[1], end, None)]
        return np.frombuffer(b"".join(parts), np.int32)

    def _path(self, text: str, at: int, end: int, first: str | None) -> bytes:
        return self.solve(text[at:end], first) if end > at else b""


def combine(x: dict, y: dict) -> dict:
    """Max-plus product of two transfer matrices {(from, to): worth}."""
    rows: dict = {}
    for (m, e), w in y.items():
        rows.setdefault(m, []).append((e, w))
    out: dict = {}
    for (s, m), w in x.items():
        for e, v in rows.get(m, ()):
            if w + v > out.get((s, e), NONE):
                out[s, e] = w + v
    return out


def best_states(matrices: list[dict]) -> list[State]:
    """The best path's states at the start, at every cut and at the end: products up a balanced
    tree, then each node's middle state from its own two ends."""
    levels = [matrices]
    while len(levels[-1]) > 1:
        row = levels[-1]
        levels.append([combine(row[i], row[i + 1]) if i + 1 < len(row) else row[i] for i in range(0, len(row), 2)])
    (ends, _) = max(levels[-1][0].items(), key=lambda x: x[1])
    marks = [ends]
    for row in reversed(levels[:-1]):
        below = []
        for i, (s, e) in enumerate(marks):
            if 2 * i + 1 == len(row):
                below.append((s, e))
                continue
            x, y = row[2 * i], row[2 * i + 1]
            mid = max((m for (f, m) in x if f == s and (m, e) in y), key=lambda m: x[s, m] + y[m, e])
            below += [(s, mid), (mid, e)]
        marks = below
    return [marks[0][0], *(e for _, e in marks)]


_LOADED: dict[int, Pieces] = {}


def load(proto: bytes) -> Pieces:
    """One model per worker process."""
    if (key := hash(proto)) not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = Pieces(proto)
    return _LOADED[key]


def _lists(parts: list[np.ndarray | None]) -> pa.Array:
    sizes = np.array([0 if p is None else len(p) for p in parts], np.int64)
    offsets = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
    values = np.concatenate([p for p in parts if p is not None and len(p)]) if sizes.any() else np.zeros(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values), mask=pa.array([p is None for p in parts]) if parts else None)


def encode_all(model: Pieces, column: pa.Array, learn: int | None = None) -> tuple[list[np.ndarray | None], list[bool | None]]:
    """Ids of each text of a column as one chunk, and whether decoding gives it back."""
    ids, exact = [], []
    for part in slices(column, learn or LEARN_BYTES):
        texts = part.to_pylist()
        words = [model.split(x) if x else [] for x in texts]
        model.learn(words)
        for x, split in zip(texts, words, strict=True):
            ids.append(None if x is None else model.encode(x, split))
            exact.append(None if x is None else model.decode(ids[-1].tolist()) == x)
    return ids, exact


def encode_column(text: Column, proto: bytes, learn: int | None = None, kept: int | None = None) -> Column:
    """struct<ids: array<int>, exact: boolean>: ids of a text as one chunk, and whether decoding gives
    it back. ``learn`` bytes are solved together and ``kept`` words held at once; less is slower and takes less memory."""
    bounded_batches()

    @F.arrow_udf("struct<ids: array<int>, exact: boolean>")
    def encode_pieces(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = load(proto)
        model.words.kept = model.spans.kept = kept or _WORDS_KEPT
        for column in columns:
            ids, exact = encode_all(model, column, learn)
            yield pa.StructArray.from_arrays([_lists(ids), pa.array(exact, pa.bool_())], ["ids", "exact"])
            give_back()
        model.forget()
        give_back()

    return encode_pieces(text)


def decode_column(ids: Column, proto: bytes) -> Column:
    """Text of an array of ids; null for null."""
    bounded_batches()

    @F.arrow_udf("string")
    def decode_pieces(column: pa.Array) -> pa.Array:
        model = load(proto)
        return pa.array([None if x is None else model.decode(x) for x in column.to_pylist()], pa.string())

    return decode_pieces(ids)


_STATE = "struct<b: int, a: int>"
_CELLS = f"array<struct<s: {_STATE}, e: {_STATE}, w: double>>"


def encode(docs: DataFrame, proto: bytes, text: str = "text", chunk: int = CHUNK, learn: int | None = None, kept: int | None = None) -> DataFrame:
    """``docs`` with two more columns, ids (array of int) and exact (decoding gives the text back). ``learn`` and ``kept``
    are those of ``encode_column`` and change no id."""
    names = {k: fresh(docs, k) for k in ("ids", "exact")}
    size = F.coalesce(F.length(text), F.lit(0))
    done = docs.where(size <= chunk).withColumn("_t", encode_column(F.col(text), proto, learn, kept))
    done = done.select(*docs.columns, F.col("_t.ids").alias(names["ids"]), F.col("_t.exact").alias(names["exact"]))
    key, giant = fresh(docs, "giant_key"), docs.where(size > chunk)
    coded = _encode_giants(giant.select(F.col(text).alias("text")), proto, chunk)
    giant = giant.withColumn(key, _text_key(text)).join(coded.withColumnRenamed("key", key), key)
    return done.unionByName(giant.select(*docs.columns, F.col("coded").alias(names["ids"]), (decode_column(F.col("coded"), proto) == F.col(text)).alias(names["exact"])))


def _text_key(text: str) -> Column:
    return F.sha2(F.col(text), 256)


def _encode_giants(texts: DataFrame, proto: bytes, chunk: int) -> DataFrame:
    """(key, coded) of distinct giant texts."""
    dummy, edge = load(proto).dummy, 2 * load(proto).longest
    whole = F.concat(F.lit(SPACE if dummy else ""), F.translate("text", " ", SPACE))
    cut = texts.withColumn("key", _text_key("text")).dropDuplicates(["key"]).select("key", whole.alias("t"))
    cut = cut.select("key", "t", F.length("t").alias("n"), F.explode(F.sequence(F.lit(0), F.floor((F.length("t") - 1) / chunk).cast("int"))).alias("no"))
    lo, hi = F.greatest(F.lit(0), F.col("no") * chunk - edge), F.least(F.col("n"), (F.col("no") + 1) * chunk + edge)
    cut = cut.select("key", "no", F.col("t").substr(lo + 1, hi - lo).alias("part"), (F.col("no") * chunk - lo).cast("int").alias("a"), (F.least(F.col("n"), (F.col("no") + 1) * chunk) - lo).cast("int").alias("b"))
    cut = checkpoint(cut.repartition("key", "no"))

    @F.arrow_udf(_CELLS)
    def chunk_transfer(part: pa.Array, a: pa.Array, b: pa.Array) -> pa.Array:
        model, out = load(proto), []
        for t, x, y in zip(part.to_pylist(), a.to_pylist(), b.to_pylist(), strict=True):
            out.append([{"s": {"b": s[0], "a": s[1]}, "e": {"b": e[0], "a": e[1]}, "w": w} for s, e, w in model.transfer(t, x, y)])
        state = pa.struct([("b", pa.int32()), ("a", pa.int32())])
        return pa.array(out, pa.list_(pa.struct([("s", state), ("e", state), ("w", pa.float64())])))

    @F.arrow_udf(f"array<{_STATE}>")
    def path_states(matrices: pa.Array) -> pa.Array:
        out = []
        for rows in matrices.to_pylist():
            mats = [{((c["s"]["b"], c["s"]["a"]), (c["e"]["b"], c["e"]["a"])): c["w"] for c in r["m"]} for r in rows]
            out.append([{"b": s[0], "a": s[1]} for s in best_states(mats)])
        return pa.array(out, pa.list_(pa.struct([("b", pa.int32()), ("a", pa.int32())])))

    @F.arrow_udf("array<int>")
    def chunk_ids(part: pa.Array, a: pa.Array, b: pa.Array, left: pa.Array, right: pa.Array) -> pa.Array:
        model, out = load(proto), []
        for t, x, y, s, e in zip(*(c.to_pylist() for c in (part, a, b, left, right)), strict=True):
            out.append(model.backtrace(t, x, y, (s["b"], s["a"]), (e["b"], e["a"])))
        return _lists(out)

    moves = cut.select("key", "no", chunk_transfer("part", "a", "b").alias("m"))
    states = moves.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("no", "m"))).alias("all")).select("key", path_states("all").alias("states"))
    ends = states.select("key", F.posexplode(F.arrays_zip(F.slice("states", F.lit(1), F.size("states") - 1).alias("l"), F.slice("states", F.lit(2), F.size("states") - 1).alias("r"))).alias("no", "z"))
    coded = cut.join(ends.select("key", "no", "z.l", "z.r"), ["key", "no"]).select("key", "no", chunk_ids("part", "a", "b", "l", "r").alias("ids"))
    return coded.groupBy("key").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("no", "ids"))), lambda x: x["ids"])).alias("coded"))


def query(spark, sf_dir: str, model_path: str = MODEL) -> DataFrame:
    """op2: ids of every document, their number, and whether decoding gives the text back."""
    coded = encode(table(spark, sf_dir, "documents").select("doc_id", "text"), Path(model_path).read_bytes())
    return coded.select("doc_id", "ids", F.size("ids").alias("n_tokens"), "exact")
