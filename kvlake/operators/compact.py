"""Compaction: which versions survive, and which files to compact next.

A mutation is dropped if a newer one of the same key is visible to every live snapshot, or if it is
a deletion that every live snapshot sees and no deeper level can hold the key. Reads at the smallest
live snapshot or later are unchanged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, Window as W

from kvlake.functions.keys import Order, bytewise
from kvlake.operators.files import overlapping
from kvlake.operators.intervals import join_ranges
from kvlake.schema import DELETE, LEVELS

L0_FILES, LEVEL1_BYTES, FILE_BYTES = 4, 10 * 1048576, 2 * 1048576
GRANDPARENT_FACTOR, EXPAND_FACTOR = 10, 25


def dropped(smallest_snapshot: int, at_base: Column | bool) -> Column:
    """Condition on rows that carry newer_seq, the sequence of the next newer version of their key."""
    base = at_base if isinstance(at_base, Column) else F.lit(at_base)
    covered = F.coalesce(F.col("newer_seq") <= smallest_snapshot, F.lit(False))
    gone = (F.col("op") == DELETE) & (F.col("seq") <= smallest_snapshot) & base
    return covered | gone


def with_newer(muts: DataFrame, order: Order = bytewise) -> DataFrame:
    return muts.withColumn("newer_seq", F.lag("seq").over(W.partitionBy(order(F.col("key"))).orderBy(F.desc("seq"))))


def retained(muts: DataFrame, smallest_snapshot: int, at_base: Column | bool = True, order: Order = bytewise) -> DataFrame:
    """Mutations that survive a compaction of ``muts``."""
    return with_newer(muts, order).where(~dropped(smallest_snapshot, at_base)).drop("newer_seq")


def garbage(muts: DataFrame, smallest_snapshot: int, at_base: Column | bool = True, order: Order = bytewise) -> DataFrame:
    """Mutations that a compaction drops."""
    return with_newer(muts, order).where(dropped(smallest_snapshot, at_base)).drop("newer_seq")


def retained_over(muts: DataFrame, smallest_snapshot: int, deeper: DataFrame, order: Order = bytewise) -> DataFrame:
    """The same, where a key is at its base level if no range of ``deeper`` (smallest_key, largest_key)
    covers it. The ranges are a manifest's: one small row a file. Keys without a place in the order stay."""
    by = order(F.col("key"))
    keys = muts.where((F.col("op") == DELETE) & by.isNotNull()).select(by.alias("_by")).distinct()
    lo, hi = order(F.col("smallest_key")), order(F.col("largest_key"))
    held = join_ranges(keys, deeper.select(lo.alias("_lo"), hi.alias("_hi")), "left_semi", lo="_lo", hi="_hi", key="_by")
    rows = with_newer(muts, order).withColumn("_by", by).join(held.withColumn("_deep", F.lit(True)), "_by", "left")
    return rows.where(~dropped(smallest_snapshot, F.col("_deep").isNull() & F.col("_by").isNotNull())).drop("newer_seq", "_deep", "_by")


def max_bytes(level: Column) -> Column:
    """Target size of a level from 1 on."""
    return F.lit(float(LEVEL1_BYTES)) * F.pow(F.lit(10.0), F.greatest(level - 1, F.lit(0)).cast("double"))


def level_scores(files: DataFrame) -> DataFrame:
    """(level, files, bytes, score) of all levels but the last: level 0 by count, others by size."""
    have = files.groupBy("level").agg(F.count("*").alias("n_files"), F.sum("file_size").alias("n_bytes"))
    levels = files.sparkSession.range(LEVELS - 1).select(F.col("id").cast("int").alias("level"))
    out = levels.join(have, "level", "left").na.fill(0, ["n_files", "n_bytes"])
    score = F.when(F.col("level") == 0, F.col("n_files") / float(L0_FILES)).otherwise(F.col("n_bytes") / max_bytes(F.col("level")))
    return out.select("level", "n_files", "n_bytes", score.alias("score"))


def pick_level(files: DataFrame) -> DataFrame:
    """The level with the highest score (the lower of equals), as one row."""
    return level_scores(files).orderBy(F.desc("score"), "level").limit(1)


def pick_inputs(files: DataFrame, level: int, after: bytes | None = None) -> tuple[DataFrame, DataFrame]:
    """The files to compact from ``level`` and those they meet one level below. The first file whose largest key
    is beyond ``after`` (or else the first of all) starts; level 0 takes all that overlap it."""
    at = files.where(F.col("level") == level)
    chosen = at.where(F.col("largest_key") > F.lit(after)).orderBy("smallest_key", "number").limit(1) if after is not None else at.limit(0)
    if chosen.isEmpty():
        chosen = at.orderBy("smallest_key", "number").limit(1)
    row = chosen.first()
    if row is None:
        return at, at
    inputs = overlapping(files, level, row["smallest_key"], row["largest_key"])
    span = inputs.agg(F.min("smallest_key"), F.max("largest_key")).first()
    below = overlapping(files, level + 1, span[0], span[1])
    return inputs, below


def is_trivial_move(inputs: DataFrame, below: DataFrame, grandparents: DataFrame) -> bool:
    """One input file, none below, little overlap two levels below: the file can move by a manifest edit."""
    size = grandparents.agg(F.coalesce(F.sum("file_size"), F.lit(0))).first()[0]
    return inputs.count() == 1 and below.isEmpty() and size <= GRANDPARENT_FACTOR * FILE_BYTES


def flush_level(files: DataFrame, lo, hi, max_level: int = 2) -> int:
    """Level for a fresh run: as deep as ``max_level`` while nothing overlaps and little does two levels below."""
    if not overlapping(files, 0, lo, hi).isEmpty():
        return 0
    level = 0
    while level < max_level and overlapping(files, level + 1, lo, hi).isEmpty():
        size = overlapping(files, level + 2, lo, hi).agg(F.coalesce(F.sum("file_size"), F.lit(0))).first()[0]
        if size > GRANDPARENT_FACTOR * FILE_BYTES:
            break
        level += 1
    return level


def best_level(files: list[tuple[int, int]]) -> tuple[float, int]:
    """The highest score and its level (the lower of equals), from (level, bytes) of a manifest's files on the driver."""
    best = (0.0, 0)
    for level in range(LEVELS - 1):
        sizes = [size for at, size in files if at == level]
        score = len(sizes) / L0_FILES if not level else sum(sizes) / (LEVEL1_BYTES * 10.0 ** (level - 1))
        best = max(best, (score, level), key=lambda x: (x[0], -x[1]))
    return best


def grandparent_cuts(far: list[tuple[bytes, int]], limit: int = GRANDPARENT_FACTOR * FILE_BYTES) -> list[bytes]:
    """Keys at which an output file has to end, so that no output overlaps much more than ``limit`` bytes two levels below;
    ``far`` gives the smallest key and the bytes of the files there, in order."""
    out, held = [], 0
    for key, size in far:
        if held and held + size > limit:
            out.append(key)
            held = 0
        held += size
    return out
