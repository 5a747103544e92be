"""Exact top-k by inner product with an M-tree, searched best-first.

Vectors are lifted so that the largest inner product is the smallest distance (see ``vectors``). A
block of rows is bulk-loaded into an M-tree: every node has a pivot, the covering radius of all rows
below it, and its distance to its parent's pivot; a leaf is a page of rows, each with its distance
to the page's pivot. The queries of a block go through a tree together: those without a floor first go
down to their nearest page, then nodes are opened in the order of their least possible distance to any
query, by the queries that still reach them. Before a distance is computed, the stored ones bound it by
the triangle inequality, |d(q, p) - d(x, p)| <= d(q, x): children and rows that cannot enter the k best
of any of these queries are never compared. Scores are exact integer
inner products; bounds carry a slack for rounding, so nothing that could tie is cut off.

The cells that rows are dealt to are the top level: each has a centre and a covering radius. A query goes
to its nearest cells first, and with the k-th best score found there to those others that its reach
still meets; within a cell it goes through the tree of each block.

Defined results: rows that are null or hold null or non-finite components take no part, neither as
queries nor as candidates; ties go to the smaller id; fewer candidates than k give fewer rows; rows
with the query's own id are its own, and ids that repeat are rows of their own; vectors are compared with
those of their own length; an empty table gives an empty result; other columns, whatever their names,
are ignored.
"""

from __future__ import annotations

import heapq
import math
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from kvlake.llm import vectors as V
from kvlake.llm.common import checkpoint, table

K, EVERY, CELLS, FIRST, PAGE, FANOUT, SLACK = 5, 50, (1, 2048), 2, 160, 12, 1e-6


@dataclass
class Tree:
    """Nodes in arrays: pivot, radius, distance to the parent's pivot, and [first, last) of the node's
    children or, for a leaf, of its rows. Rows are stored page by page."""

    ids: np.ndarray
    rows: np.ndarray
    to_pivot: np.ndarray
    pivot: list = field(default_factory=list)
    radius: list = field(default_factory=list)
    to_parent: list = field(default_factory=list)
    span: list = field(default_factory=list)
    leaf: list = field(default_factory=list)


def _distances(x: np.ndarray, p: np.ndarray) -> np.ndarray:
    return np.sqrt(((x - p) ** 2).sum(axis=1))


def load(ids: np.ndarray, rows: np.ndarray, top_sq: float, page: int = PAGE, fanout: int = FANOUT) -> Tree:
    """Bulk-load a tree level by level: rows of a node go to the nearest of a few of its own rows."""
    x = V.lift(rows, top_sq)
    order, tree = np.arange(len(ids)), Tree(ids, rows, np.zeros(len(ids)))
    tree.pivot.append(x.mean(axis=0))
    tree.radius.append(float(_distances(x, tree.pivot[0]).max(initial=0)))
    tree.to_parent.append(0.0)
    tree.span.append((0, len(ids)))
    tree.leaf.append(True)
    queue, rng = [0], np.random.default_rng(3)
    while queue:
        node = queue.pop(0)
        a, b = tree.span[node]
        own = order[a:b]
        if b - a <= page:
            tree.to_pivot[a:b] = _distances(x[own], tree.pivot[node])
            continue
        pivots = np.unique(x[own[rng.permutation(b - a)[: 4 * fanout]]], axis=0)
        pivots = pivots[rng.permutation(len(pivots))[:fanout]]
        near = V.nearest(x[own], pivots) if len(pivots) > 1 else np.arange(b - a) * 2 // (b - a)
        if len(pivots) == 1:  # equal rows: halve them
            pivots = np.repeat(pivots, 2, axis=0)
        order[a:b] = own[np.argsort(near, kind="stable")]
        sizes, first = np.bincount(near, minlength=len(pivots)), len(tree.pivot)
        ends = a + np.cumsum(sizes)
        for p, n, e in zip(pivots, sizes, ends, strict=True):
            if n:
                tree.pivot.append(p)
                tree.radius.append(float(_distances(x[order[e - n : e]], p).max()))
                tree.to_parent.append(float(_distances(p[None], tree.pivot[node])[0]))
                tree.span.append((int(e - n), int(e)))
                tree.leaf.append(True)
                queue.append(len(tree.pivot) - 1)
        tree.leaf[node], tree.span[node] = False, (first, len(tree.pivot))
    tree.ids, tree.rows = ids[order], rows[order]
    for name in ("pivot", "radius", "to_parent"):
        setattr(tree, name, np.array(getattr(tree, name)))
    return tree


class Searcher:
    def __init__(self, query_ids: np.ndarray, queries: np.ndarray, top_sq: float, k: int, floors: np.ndarray | None = None):
        # no sum of products exceeds the largest squared norm: below 2^52 doubles are exact
        self.exact = np.float64 if top_sq < 2.0**52 else object
        self.query_ids, self.queries, self.top_sq = query_ids, queries.astype(self.exact), top_sq
        self.lifted = np.concatenate((queries.astype(np.float64), np.zeros((len(queries), 1))), axis=1)
        self.base = (self.lifted**2).sum(axis=1) + top_sq
        self.k, self.floors, self.best_of = k, floors, V.Best(len(queries), k, np.int64, floors)
        self.slack = SLACK * (1 + np.sqrt(self.base.max(initial=0)))
        self.compared = 0

    def __call__(self, tree: Tree) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The rows of one tree that may be among the k best."""
        self.best_of = V.Best(len(self.queries), self.k, np.int64, self.floors)
        self.feed(tree)
        return self.best()

    def feed(self, tree: Tree) -> None:
        """All queries go through the tree together: a node is opened once, by those that still reach it."""
        rows, every = tree.rows.astype(self.exact), np.arange(len(self.queries))
        self.pivot_sq, self.reach = (tree.pivot**2).sum(axis=1), self._reach(every)
        top, home = self._away(tree, every, slice(0, 1))[:, 0], np.full(len(every), -1)
        lost = np.flatnonzero(np.isinf(self.reach))  # without a floor yet: each goes down to its nearest page first
        stack = [(0, lost, top[lost])] if len(lost) else []
        while stack:
            node, q, d = stack.pop()
            if tree.leaf[node]:
                home[q] = node
                self._compare(tree, rows, node, q, d)
                continue
            first, last = tree.span[node]
            away = self._away(tree, q, slice(first, last))
            near = away.argmin(axis=1)
            for i in np.unique(near).tolist():
                stack.append((first + i, q[near == i], away[near == i, i]))
        if not len(every):
            return
        least = np.maximum(top - tree.radius[0], 0)
        heap, pushed = [(float(least.min()), 0, 0, every, top, least)], 0
        while heap:
            _, _, node, q, d, least = heapq.heappop(heap)
            still = (least <= self.reach[q]) & (home[q] != node)
            q, d = q[still], d[still]
            if not len(q):
                continue
            if tree.leaf[node]:
                self._compare(tree, rows, node, q, d)
                continue
            first, last = tree.span[node]
            reach, radius = self.reach[q][:, None], tree.radius[first:last]
            some = np.flatnonzero((np.abs(d[:, None] - tree.to_parent[first:last]) - radius <= reach).any(axis=0))
            self.compared += len(q) * len(some)
            away = self._away(tree, q, first + some)
            low = np.maximum(away - radius[some], 0)
            for j, i in enumerate((first + some).tolist()):
                if (near := low[:, j] <= reach[:, 0]).any():
                    pushed += 1
                    heapq.heappush(heap, (float(low[near, j].min()), pushed, i, q[near], away[near, j], low[near, j]))

    def _reach(self, q: np.ndarray) -> np.ndarray:
        """Distances beyond these cannot enter the k best of the queries ``q``."""
        return np.sqrt(np.maximum(self.base[q] - 2.0 * self.best_of.floor(q), 0)) + self.slack

    def _away(self, tree: Tree, q: np.ndarray, nodes) -> np.ndarray:
        """Distances of queries to the pivots of nodes."""
        return np.sqrt(np.maximum((self.base[q] - self.top_sq)[:, None] + self.pivot_sq[nodes] - 2 * self.lifted[q] @ tree.pivot[nodes].T, 0))

    def _compare(self, tree: Tree, rows: np.ndarray, node: int, q: np.ndarray, d: np.ndarray) -> None:
        """Scores of the page's rows that one of the queries may still need."""
        a, b = tree.span[node]
        near = np.flatnonzero((np.abs(d[:, None] - tree.to_pivot[a:b]) <= self.reach[q][:, None]).any(axis=0)) + a
        self.compared += len(q) * len(near)
        scores = (self.queries[q] @ rows[near].T).astype(np.int64)
        i, j = np.nonzero((scores >= self.best_of.floor(q)[:, None]) & (tree.ids[near] != self.query_ids[q][:, None]))
        if len(i):
            self.best_of.add(q[i], tree.ids[near[j]], scores[i, j])
            self.reach[q] = self._reach(q)

    def best(self):
        return self.best_of.rows(self.query_ids)


def top_k(vectors: DataFrame, queries, k: int = K, cells: int | None = None, id_col: str = "vec_id", vector_col: str = "embedding", block_rows: int = V.BLOCK_ROWS, query_rows: int = V.QUERY_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score) by integer inner product of floor(256 x); ``queries`` is a
    condition on vec_id that names the query rows."""
    rows = checkpoint(V.finite_rows(vectors, lambda c: F.floor(c.cast("double") * 256), True, id_col, vector_col))
    found = [_search(part, top, n, queries, k, cells, block_rows, query_rows) for part, top, n in V.by_length(rows)]
    return V.union(found) if found else rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")


def _search(rows: DataFrame, top: float, n: int, queries, k: int, cells: int | None, block_rows: int, query_rows: int) -> DataFrame:
    cells = cells or min(max(math.isqrt(n) // 8, CELLS[0]), CELLS[1])
    centre = V.centres(V.lift(V.sample(rows), top), cells)
    celled = checkpoint(V.with_cell(rows.select("vec_id", "v"), centre, top))
    index = V.build_index(celled, lambda i, x: load(i, x, top), np.int64, block_rows)
    radius = np.full(len(centre), -np.inf)
    for cell, away in celled.groupBy("cell").agg(F.max("away")).collect():  # one row a cell, of a bounded number
        radius[cell] = away

    def cells_of(first: bool):
        @F.arrow_udf("array<int>")
        def dealt(v: pa.Array, floor: pa.Array) -> pa.Array:
            q, out = V.flat(V.matrix(v, np.float64)) if len(v) else np.zeros((0, centre.shape[1])), []
            base = (q * q).sum(axis=1) + top
            away = np.sqrt(np.maximum((q * q).sum(axis=1)[:, None] + (centre * centre).sum(axis=1)[None, :] - 2 * q @ centre.T, 0))
            least = np.where(np.isneginf(radius), np.inf, away - radius)
            order = np.argsort(away + np.where(np.isneginf(radius), np.inf, 0)[None, :], axis=1, kind="stable")
            lowest = floor.to_numpy(zero_copy_only=False)
            for i in range(len(q)):
                reach = np.inf if np.isneginf(lowest[i]) else np.sqrt(max(base[i] - 2 * lowest[i], 0)) + SLACK * (1 + np.sqrt(base[i]))
                near, far = order[i, :FIRST], order[i, FIRST:]
                out.append((near if first else far[least[i, far] <= reach]).astype(np.int32))
            return pa.array(out, pa.list_(pa.int32()))

        return dealt("v", "floor")

    def step(asks: DataFrame, first: bool) -> DataFrame:
        return V.meet(index, V.asked(asks, cells_of(first)), lambda i, x, f: Searcher(i, x, top, k, f), k, np.int64, "long", query_rows)

    asks = rows.where(queries).select("vec_id", "v").dropDuplicates(["vec_id", "v"])
    have = checkpoint(V.best(step(asks.withColumn("floor", F.lit(float("-inf"))), True), k))
    return V.best(have.drop("rank").unionByName(step(V.floors(asks, have, k), False)), k)


def query(spark, sf_dir: str) -> DataFrame:
    """op6: the five best rows for every fiftieth id."""
    return top_k(table(spark, sf_dir, "embeddings"), V.every(EVERY))


ORACLE = f"""
WITH e AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM e q JOIN e c ON q.vec_id % {EVERY} = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= {K}
"""
