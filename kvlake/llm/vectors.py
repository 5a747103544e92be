"""What the two vector searches share: valid rows, the lift to a metric, cells, blocks, dealing and merging.

Largest inner product is not a metric. With M the largest norm, a row x is lifted to
(x, sqrt(M^2 - |x|^2)) and a query to (q, 0): then |x' - q'|^2 = |q|^2 + M^2 - 2 q.x, so that the
nearest lifted row is the one with the largest inner product, and the triangle inequality holds.

Rows are dealt into cells by the nearest of a bounded number of centres, which are fitted on a
bounded sample, and range-partitioned by cell and hash of the id: a hot cell, even of equal vectors,
is split over partitions. Each partition is packed into blocks of at most so many rows of one cell.
Queries are rows too: each is dealt to the cells that it asks, packed likewise, and meets the blocks of a
cell in a join on the cell. Neither rows nor queries pass through the driver. A search is made in steps:
the cells nearest to a query first, whose k-th best score is the floor of all further ones, so that a
block returns only rows that may still be among the k best.

Inner products are between vectors of equal length: rows of each length are searched among themselves,
one length after the other.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T, Window as W

from kvlake.llm.common import checkpoint

QUERY_ROWS, BLOCK_ROWS, SAMPLE_ROWS = 512, 2048, 16384
_INDEX = T.StructType([T.StructField("cell", T.IntegerType()), T.StructField("block", T.BinaryType())])


def finite_rows(table: DataFrame, value, zero: bool, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, v, sq) of the rows that take part: not null, no null or non-finite component, an id, one
    component at least, and not zero unless ``zero``. ``value`` maps a component to what is compared; sq is the
    squared norm of that."""
    fine = F.col(vector_col).isNotNull() & F.col(id_col).isNotNull() & (F.size(vector_col) > 0)
    fine = fine & ~F.exists(vector_col, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    rows = table.where(fine).select(F.col(id_col).cast("long").alias("vec_id"), F.transform(vector_col, value).alias("v"))
    rows = rows.withColumn("sq", F.aggregate("v", F.lit(0.0), lambda a, c: a + c.cast("double") * c.cast("double")))
    return rows if zero else rows.where("sq > 0")


def by_length(rows: DataFrame):
    """(rows, largest sq, number) of every length that occurs."""
    for n, top, count in sorted(tuple(r) for r in rows.groupBy(F.size("v").alias("n")).agg(F.max("sq"), F.count("*")).collect()):
        yield rows.where(F.size("v") == n), top, count


def numbers(rows: DataFrame):
    """The numpy type that holds the components as they are."""
    kind = rows.schema["v"].dataType.elementType
    return np.float32 if isinstance(kind, T.FloatType) else np.int64 if isinstance(kind, T.LongType) else np.float64


def matrix(column: pa.Array, dtype) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(dtype).reshape(len(column), -1) if len(column) else np.zeros((0, 0), dtype)


def lift(x: np.ndarray, top_sq: float) -> np.ndarray:
    x = x.astype(np.float64)
    return np.concatenate((x, np.sqrt(np.maximum(top_sq - (x * x).sum(axis=1), 0))[:, None]), axis=1)


def flat(q: np.ndarray) -> np.ndarray:
    """Lifted queries."""
    return np.concatenate((q.astype(np.float64), np.zeros((len(q), 1))), axis=1)


def sample(rows: DataFrame, n: int = SAMPLE_ROWS) -> np.ndarray:
    """At most ``n`` vectors, picked by hash of the id."""
    got = rows.select("vec_id", "v").orderBy(F.xxhash64("vec_id"), "vec_id").limit(n).toArrow()
    return matrix(got["v"].combine_chunks(), np.float64)


def centres(x: np.ndarray, n: int, rounds: int = 8, seed: int = 5) -> np.ndarray:
    """Lloyd's k-means from distinct rows of a bounded sample; deterministic."""
    x = np.unique(x, axis=0)
    c = x[np.random.default_rng(seed).permutation(len(x))[: min(n, len(x))]]
    for _ in range(rounds):
        near = nearest(x, c)
        count = np.bincount(near, minlength=len(c))
        total = np.stack([np.bincount(near, x[:, j], minlength=len(c)) for j in range(x.shape[1])], axis=1)
        c = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], c)
    return c


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    sq = (c * c).sum(axis=1)
    return np.concatenate([np.argmin(sq[None, :] - 2 * x[i : i + 4096] @ c.T, axis=1) for i in range(0, len(x), 4096)] or [np.zeros(0, np.int64)])


def with_cell(rows: DataFrame, c: np.ndarray, top_sq: float) -> DataFrame:
    """``rows`` with the cell of each and ``away``, the distance to its centre."""

    @F.arrow_udf("struct<cell: int, away: double>")
    def cell_of(v: pa.Array) -> pa.Array:
        x = lift(matrix(v, np.float64), top_sq) if len(v) else np.zeros((0, c.shape[1]))
        near = nearest(x, c)
        return pa.StructArray.from_arrays([pa.array(near.astype(np.int32)), pa.array(np.sqrt(((x - c[near]) ** 2).sum(axis=1)))], ["cell", "away"])

    return rows.withColumn("p", cell_of("v")).select(*rows.columns, "p.cell", "p.away")


def packed(rows: DataFrame, pack, dtype, most: int) -> DataFrame:
    """(cell, block): pack(ids, vectors, floors) of at most ``most`` rows of one cell each, over all of ``rows`` (vec_id, v, floor,
    cell)."""

    def row(cell: int, held: list) -> pa.RecordBatch:
        block = pickle.dumps(pack(*(np.concatenate([h[i] for h in held]) for i in range(3))), 5)
        return pa.RecordBatch.from_pylist([{"cell": cell, "block": block}], pa.schema([("cell", pa.int32()), ("block", pa.binary())]))

    def blocks(batches):
        """Rows come sorted by cell; a block never mixes cells."""
        held, size, current = [], 0, None
        for batch in batches:
            cells, ids, vecs, floors = batch.column("cell").to_numpy(), batch.column("vec_id").to_numpy(), matrix(batch.column("v"), dtype), batch.column("floor").to_numpy(zero_copy_only=False)
            at = 0
            while at < len(cells):
                cell = int(cells[at])
                if size and (cell != current or size == most):
                    yield row(current, held)
                    held, size = [], 0
                to = min(int(np.searchsorted(cells, cell, side="right")), at + most - size)
                held.append((ids[at:to], vecs[at:to], floors[at:to]))
                size, current, at = size + to - at, cell, to
        if size:
            yield row(current, held)

    dealt = rows.select("vec_id", "v", "floor", "cell", F.xxhash64("vec_id").alias("h")).repartitionByRange("cell", "h").sortWithinPartitions("cell", "h").drop("h")
    return dealt.mapInArrow(blocks, _INDEX)


def build_index(celled: DataFrame, pack, dtype, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(cell, block) of all rows, written down."""
    return checkpoint(packed(celled.withColumn("floor", F.lit(0.0)), lambda i, x, _: pack(i, x), dtype, block_rows))


def meet(index: DataFrame, asks: DataFrame, searcher, k: int, dtype, score_type: str, query_rows: int = QUERY_ROWS) -> DataFrame:
    """(query_id, vec_id, score): the rows of the index's blocks that may be among the ``k`` best of the queries ``asks``
    (vec_id, v, floor, cell) of the same cell. searcher(query_ids, vectors, floors) makes on an executor a function of a
    block that gives (query_ids, vec_ids, scores), at most k a query."""
    kind = pa.int64() if score_type == "long" else pa.float64()

    def run(batches):
        for batch in batches:
            last = state = None
            for block, sent in zip(batch.column("block"), batch.column("sent"), strict=True):
                if state is None or sent != last:
                    last, state = sent, searcher(*pickle.loads(sent.as_py()))
                q, v, s = state(pickle.loads(block.as_py()))
                for at in range(0, len(q), 50_000):
                    yield pa.RecordBatch.from_arrays([pa.array(q[at : at + 50_000], pa.int64()), pa.array(v[at : at + 50_000], pa.int64()), pa.array(s[at : at + 50_000], kind)], ["query_id", "vec_id", "score"])

    sent = packed(asks, lambda *x: x, dtype, query_rows).withColumnRenamed("block", "sent")
    return index.join(sent, "cell").select("block", "sent").mapInArrow(run, f"query_id long, vec_id long, score {score_type}")


def best(found: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, vec_id, score) of each query's ``k`` best; ranked in part before anything is shuffled."""
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def floors(queries: DataFrame, found: DataFrame, k: int) -> DataFrame:
    """``queries`` with floor, the k-th best score found for each, minus infinity while there are fewer, and ``n_found``."""
    kth = found.groupBy("query_id").agg(F.min("score").cast("double").alias("least"), F.count("*").alias("n_found"))
    joined = queries.join(kth, queries["vec_id"] == kth["query_id"], "left")
    floor = F.when(F.col("n_found") >= k, F.col("least")).otherwise(float("-inf"))
    return joined.select(*queries.columns, floor.alias("floor"), F.coalesce("n_found", F.lit(0)).alias("n_found"))


def asked(queries: DataFrame, cells) -> DataFrame:
    """``queries`` (vec_id, v, floor) once per cell of the array column ``cells``."""
    return queries.withColumn("cell", F.explode(cells)).select("vec_id", "v", "floor", "cell")


def union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def every(n: int) -> Column:
    return F.col("vec_id") % n == 0


def top_rows(q: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` best (score, smaller id first) of each query number in ``q``."""
    order = np.lexsort((ids, -scores, q))
    by = q[order]
    first = np.searchsorted(by, by, side="left")
    return order[np.arange(len(by)) - first < k]


class Best:
    """The k best (score, smaller id first) of each of n queries, none of them below the query's floor."""

    def __init__(self, n: int, k: int, dtype, floors: np.ndarray | None = None):
        self.k = k
        self.ids = np.full((n, k), np.iinfo(np.int64).max)
        self.scores = np.full((n, k), np.iinfo(np.int64).min if dtype == np.int64 else -np.inf, dtype)
        self.full = np.zeros(n, np.int64)
        self.floors = np.full(n, -np.inf) if floors is None else floors

    def floor(self, q: np.ndarray) -> np.ndarray:
        """The scores that a row has to reach for the queries ``q``, minus infinity while any will do."""
        return np.where(self.full[q] >= self.k, np.maximum(self.scores[q, -1].astype(np.float64), self.floors[q]), self.floors[q])

    def add(self, q: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        """Rows (query number, id, score), of any queries."""
        own = np.unique(q)
        there = np.arange(self.k)[None, :] < self.full[own][:, None]
        q, ids, scores = np.concatenate((np.repeat(own, self.full[own]), q)), np.concatenate((self.ids[own][there], ids)), np.concatenate((self.scores[own][there], scores))
        kept = top_rows(q, ids, scores, self.k)
        by = q[kept]
        place = np.arange(len(by)) - np.searchsorted(by, by, side="left")
        self.ids[by, place], self.scores[by, place] = ids[kept], scores[kept]
        self.full[own] = np.bincount(by, minlength=len(self.full))[own]

    def rows(self, query_ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        there = np.arange(self.k)[None, :] < self.full[:, None]
        return np.repeat(query_ids, self.full), self.ids[there], self.scores[there]
