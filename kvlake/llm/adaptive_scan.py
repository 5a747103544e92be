"""Approximate nearest neighbours by inner product: inverted lists and an adaptive dimension scan.

Vectors are lifted so that the largest inner product is the smallest distance (see ``vectors``) and
turned by a random rotation, so that any few coordinates are a fair sample of a difference. A list
stores its rotated rows in blocks of columns. Each probed list is scanned column block by column
block: after t of D coordinates the partial squared distance times D / t estimates the whole one,
and a candidate is given up once the estimate exceeds the k-th best by more than the factor
(1 + eps / sqrt(t))^2, the test of the hypothesis that it is still among the k best. Survivors are
scored exactly, in double precision on the original vectors.

There are about sqrt(n) lists, within ``LISTS``; centres are fitted on half of a bounded sample, and every
row is in a list. The number of lists to probe is measured on the other half: so many that ``RECALL`` of the
neighbours there, as near as k of all rows would be, lie in them. A query's ``FIRST`` nearest lists are
scanned whole and give the score that the rest has to beat. Queries that find fewer than k rows go
through all other lists too.

Defined results: rows that are null, zero, or hold null or non-finite components take no part; ties
go to the smaller id; fewer candidates than k give fewer rows; rows with the query's own id are its
own, and ids that repeat are rows of their own; vectors are compared with those of their own length;
an empty table gives an empty result; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from kvlake.llm import vectors as V
from kvlake.llm.common import checkpoint, table

K, EVERY, LISTS, RECALL, FIRST, COLUMNS, EPS = 20, 20, (1, 1024), 0.955, 4, 13, 2.1


def rotation(n: int, seed: int = 9) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).normal(size=(n, n)))
    return q * np.sign(np.diag(r))


def pack(ids: np.ndarray, rows: np.ndarray, top_sq: float, turn: np.ndarray) -> tuple:
    """(ids, original rows, blocks of rotated columns)."""
    x = (V.lift(rows, top_sq) @ turn).astype(np.float32)
    return ids, rows, [np.ascontiguousarray(x[:, i : i + COLUMNS]) for i in range(0, x.shape[1], COLUMNS)]


def probes_for(held_out: np.ndarray, centre: np.ndarray, top_sq: float, k: int, recall: float = RECALL, queries: int = 256) -> int:
    """The least number of nearest lists that hold ``recall`` of the ``k`` nearest of each of some rows among ``held_out``."""
    if len(held_out) < 2:
        return len(centre)
    q = held_out[:queries]
    score = q @ held_out.T
    score[np.arange(len(q)), np.arange(len(q))] = -np.inf
    near = np.argsort(-score, axis=1, kind="stable")[:, : max(1, min(k, len(held_out) - 1))]
    order = _by_distance(q, centre)
    rank = np.empty_like(order)
    np.put_along_axis(rank, order, np.broadcast_to(np.arange(len(centre)), order.shape), axis=1)
    ranks = np.sort(np.take_along_axis(rank, V.nearest(V.lift(held_out, top_sq), centre)[near], axis=1).ravel())
    return int(ranks[math.ceil(recall * len(ranks)) - 1]) + 1


def _by_distance(q: np.ndarray, centre: np.ndarray) -> np.ndarray:
    return np.argsort((centre**2).sum(axis=1)[None, :] - 2 * V.flat(q) @ centre.T, axis=1, kind="stable")


class Scanner:
    """Scans blocks for a set of queries, all pairs of a column block at a time while most are alive, one by one after that."""

    def __init__(self, query_ids: np.ndarray, queries: np.ndarray, floors: np.ndarray, top_sq: float, turn: np.ndarray, k: int):
        self.ids, self.k = query_ids, k
        self.queries = queries.astype(np.float64)
        lifted = V.flat(queries)
        self.turned = (lifted @ turn).astype(np.float32)
        self.reach = np.where(np.isneginf(floors), np.inf, (lifted**2).sum(axis=1) + top_sq - 2 * floors)
        self.floors = floors
        self.read = self.offered = 0

    def __call__(self, block: tuple) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        ids, rows, parts = block
        wide, at = self.turned.shape[1], 0
        total, r, q = np.zeros((len(ids), len(self.ids)), np.float32), None, None
        self.offered += total.size * wide
        if not np.isinf(self.reach).all():
            for p in parts:
                to = at + p.shape[1]
                turned = self.turned[:, at:to]
                ratio = 1.0 if to == wide else to / wide * (1 + EPS / np.sqrt(to)) ** 2
                most = self.reach * ratio * 1.00001 + 1e-5
                if r is None:
                    self.read += total.size * p.shape[1]
                    total += (p * p).sum(axis=1)[:, None] + (turned * turned).sum(axis=1)[None, :] - 2 * p @ turned.T
                    alive = total <= most[None, :]
                    if np.count_nonzero(alive) < 0.25 * alive.size or to == wide:
                        r, q = np.nonzero(alive)
                        total = total[r, q]
                else:
                    self.read += len(r) * p.shape[1]
                    total = total + ((p[r] - turned[q]) ** 2).sum(axis=1)
                    keep = total <= most[q]
                    r, q, total = r[keep], q[keep], total[keep]
                at = to
        if r is None:
            r, q = (x.ravel() for x in np.meshgrid(np.arange(len(ids)), np.arange(len(self.ids)), indexing="ij"))
        other = ids[r] != self.ids[q]
        r, q = r[other], q[other]
        score = np.concatenate([np.einsum("ij,ij->i", rows[r[i : i + 65536]].astype(np.float64), self.queries[q[i : i + 65536]]) for i in range(0, len(r), 65536)] or [np.zeros(0)])
        good = score >= self.floors[q]
        r, q, score = r[good], q[good], score[good]
        top = V.top_rows(q, ids[r], score, self.k)
        return self.ids[q[top]], ids[r[top]], score[top]


def nearest_neighbours(vectors: DataFrame, queries, k: int = K, lists: int | None = None, probes: int | None = None, id_col: str = "vec_id", vector_col: str = "embedding", block_rows: int = V.BLOCK_ROWS, query_rows: int = V.QUERY_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score); ``queries`` is a condition on vec_id that names the query rows."""
    rows = checkpoint(V.finite_rows(vectors, lambda c: c, False, id_col, vector_col))
    found = [_search(part, top, n, queries, k, lists, probes, block_rows, query_rows) for part, top, n in V.by_length(rows)]
    return V.union(found) if found else rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")


def _search(rows: DataFrame, top: float, n: int, queries, k: int, lists: int | None, probes: int | None, block_rows: int, query_rows: int) -> DataFrame:
    lists, dtype, some = lists or min(max(math.isqrt(n), LISTS[0]), LISTS[1]), V.numbers(rows), V.sample(rows)
    half = len(some) // 2
    centre = V.centres(V.lift(some[half:], top), lists)
    tried = probes or probes_for(some[:half], centre, top, math.ceil(k * max(half, 1) / n))
    tried, turn = min(tried, len(centre)), rotation(centre.shape[1])
    index = V.build_index(V.with_cell(rows.select("vec_id", "v"), centre, top), lambda i, x: pack(i, x, top, turn), dtype, block_rows)

    @F.arrow_udf("array<int>")
    def lists_of(v: pa.Array) -> pa.Array:
        order = _by_distance(V.matrix(v, np.float64), centre).astype(np.int32) if len(v) else np.zeros((0, len(centre)), np.int32)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(v) + 1, dtype=np.int32) * order.shape[1]), pa.array(order.ravel()))

    def step(asks: DataFrame, first: int, last: int) -> DataFrame:
        cells = F.slice(lists_of("v"), F.lit(first + 1), F.lit(last - first))
        return V.meet(index, V.asked(asks, cells), lambda i, x, f: Scanner(i, x, f, top, turn, k), k, dtype, "double", query_rows)

    asks, start = rows.where(queries).select("vec_id", "v").dropDuplicates(["vec_id", "v"]), min(FIRST, tried)
    have = checkpoint(V.best(step(asks.withColumn("floor", F.lit(float("-inf"))), 0, start), k))
    if tried > start:
        more = step(V.floors(asks, have, k), start, tried)
        have = checkpoint(V.best(have.drop("rank").unionByName(more), k))
    if tried < len(centre):
        short = V.floors(asks, have, k).where(F.col("n_found") < k)
        have = V.best(have.drop("rank").unionByName(step(short, tried, len(centre))), k)
    return have


def query(spark, sf_dir: str) -> DataFrame:
    """op8: the twenty nearest found for every twentieth id."""
    return nearest_neighbours(table(spark, sf_dir, "embeddings"), V.every(EVERY))
