"""Joins of keys with closed key ranges.

File metadata is one small row a file, and mostly small enough to broadcast; that is counted first.
Beyond ``BROADCAST_ROWS`` ranges, keys are cut into buckets at a bounded number of sampled borders, a
range goes to each bucket it meets, and the two sides meet in an equi-join on the bucket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

BROADCAST_ROWS, BORDERS = 100_000, 256


def small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` marked for broadcast if its count allows it, else left to the planner."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def _bucket(key: Column, borders: list) -> Column:
    return F.size(F.filter(F.array(*map(F.lit, borders)), lambda b: b <= key)) if borders else F.lit(0)


def join_ranges(keys: DataFrame, ranges: DataFrame, how: str = "inner", lo: str = "smallest_key", hi: str = "largest_key", key: str = "key", limit: int = BROADCAST_ROWS) -> DataFrame:
    """``keys`` joined to the ``ranges`` whose [lo, hi] holds their key (null bounds are infinite); how is
    inner, left_semi or left_anti. The sides share no column names."""
    inside = (F.col(lo).isNull() | (F.col(key) >= F.col(lo))) & (F.col(hi).isNull() | (F.col(key) <= F.col(hi)))
    if ranges.limit(limit + 1).count() <= limit:
        return keys.join(F.broadcast(ranges), inside, how)
    picked = keys.select(key).where(F.col(key).isNotNull()).orderBy(F.xxhash64(key)).limit(BORDERS * 16).distinct().collect()  # bounded
    values = sorted(r[0] for r in picked)
    borders = values[:: max(1, len(values) // BORDERS)]
    first, last = F.when(F.col(lo).isNull(), 0).otherwise(_bucket(F.col(lo), borders)), F.when(F.col(hi).isNull(), len(borders)).otherwise(_bucket(F.col(hi), borders))
    dealt = ranges.withColumn("_rb", F.explode(F.sequence(first, F.greatest(first, last))))
    asked = keys.withColumn("_kb", _bucket(F.col(key), borders))
    out = asked.join(dealt, (F.col("_kb") == F.col("_rb")) & inside, how)
    return out.drop("_kb", "_rb")
