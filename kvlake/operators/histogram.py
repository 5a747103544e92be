"""A mergeable histogram of 154 fixed buckets with moments and interpolated percentiles.

Bucket limits are 1 to 9 by one, then 16 steps a decade up to 9e9, and a last one without a real
limit. A value is in the first bucket whose limit is above it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, Window as W

_STEPS = (10, 12, 14, 16, 18, 20, 25, 30, 35, 40, 45, 50, 60, 70, 80, 90)
LIMITS = [float(i) for i in range(1, 10)] + [float(s * 10**d) for d in range(9) for s in _STEPS] + [1e200]


def bucket_of(x: Column) -> Column:
    """Bucket number by binary search, as nested built-in comparisons."""
    def pick(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(x < LIMITS[mid], pick(lo, mid)).otherwise(pick(mid + 1, hi))

    return pick(0, len(LIMITS) - 1)


def buckets(rows: DataFrame, value: str) -> DataFrame:
    """(bucket, n) of the buckets that have rows; null values take no part."""
    return rows.where(F.col(value).isNotNull()).groupBy(bucket_of(F.col(value).cast("double")).alias("bucket")).agg(F.count("*").alias("n"))


def moments(rows: DataFrame, value: str) -> DataFrame:
    """Count, sum, smallest, largest, average and population standard deviation."""
    x = F.col(value).cast("double")
    return rows.agg(F.count(x).alias("n"), F.sum(x).alias("total"), F.min(x).alias("low"), F.max(x).alias("high"), F.avg(x).alias("average"), F.stddev_pop(x).alias("deviation"))


def merge(*parts: DataFrame) -> DataFrame:
    """Sum of some histograms (bucket, n)."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("bucket").agg(F.sum("n").alias("n"))


def percentiles(rows: DataFrame, value: str, ps: list[float]) -> DataFrame:
    """(p, value): linear between the limits of the bucket where the count reaches p per cent, kept within
    the smallest and largest value. The window runs over at most 154 rows."""
    counts = buckets(rows, value)
    run = F.sum("n").over(W.orderBy("bucket").rowsBetween(W.unboundedPreceding, 0))
    total = F.sum("n").over(W.partitionBy())
    cum = counts.withColumn("upto", run).withColumn("total", total)
    limits = F.array(*map(F.lit, LIMITS))
    left = F.when(F.col("bucket") == 0, 0.0).otherwise(F.get(limits, F.col("bucket") - 1))
    right = F.get(limits, F.col("bucket"))
    edge = rows.agg(F.min(F.col(value).cast("double")).alias("low"), F.max(F.col(value).cast("double")).alias("high"))
    asked = F.explode(F.array(*[F.lit(float(p)) for p in ps])).alias("p")
    cand = cum.select("bucket", "n", "upto", "total", asked).where(F.col("upto") >= F.col("total") * F.col("p") / 100)
    hit = cand.withColumn("_r", F.row_number().over(W.partitionBy("p").orderBy("bucket"))).where("_r = 1")
    at = left + (right - left) * (F.col("total") * F.col("p") / 100 - (F.col("upto") - F.col("n"))) / F.col("n")
    joined = hit.withColumn("_k", F.lit(1)).join(F.broadcast(edge.withColumn("_k", F.lit(1))), "_k")
    return joined.select("p", F.greatest(F.least(at, F.col("high")), F.col("low")).alias("value"))
