"""Queries over file metadata: overlap, lookup, level statistics and size estimates.

File metadata is one small row a file. Ranges are closed; a null bound is infinite.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, Window as W

from kvlake.operators.intervals import join_ranges, small
from kvlake.plans.scratch import pinned


def run_metadata(muts: DataFrame, run: str = "run_id") -> DataFrame:
    """Bounds, counts and bytes of every run."""
    size = F.length("key") + F.coalesce(F.length("value"), F.lit(0))
    return muts.groupBy(run).agg(
        F.min("key").alias("smallest_key"), F.max("key").alias("largest_key"), F.min("seq").alias("smallest_seq"), F.max("seq").alias("largest_seq"),
        F.count("*").alias("num_entries"), F.sum(size).cast("long").alias("file_size"),
    )


def _meets(lo, hi) -> Column:
    out = F.lit(True)
    if lo is not None:
        out = out & (F.col("largest_key") >= F.lit(lo))
    if hi is not None:
        out = out & (F.col("smallest_key") <= F.lit(hi))
    return out


def overlapping(files: DataFrame, level: int, lo=None, hi=None) -> DataFrame:
    """Files of a level that meet [lo, hi]. At level 0 files may overlap each other: the range grows with
    the files found until nothing more joins it."""
    at = files.where(F.col("level") == level)
    while True:
        found = at.where(_meets(lo, hi))
        if level:
            return found
        span = found.agg(F.min("smallest_key"), F.max("largest_key")).first()
        grown_lo = span[0] if lo is not None and span[0] is not None and span[0] < lo else lo
        grown_hi = span[1] if hi is not None and span[1] is not None and span[1] > hi else hi
        if (grown_lo, grown_hi) == (lo, hi):
            return found
        lo, hi = grown_lo, grown_hi


def any_overlap(files: DataFrame, lo=None, hi=None) -> bool:
    """Whether any file meets [lo, hi]."""
    return not files.where(_meets(lo, hi)).limit(1).isEmpty()


def overlap_pairs(files: DataFrame, number: str = "run_id") -> DataFrame:
    """Pairs of files that share a key, each pair once. This is over file metadata, never over rows."""
    a = files.select(F.col(number).alias("a"), F.col("smallest_key").alias("alo"), F.col("largest_key").alias("ahi"))
    b = files.select(F.col(number).alias("b"), F.col("smallest_key").alias("blo"), F.col("largest_key").alias("bhi"))
    return a.join(b, (F.col("a") < F.col("b")) & (F.col("alo") <= F.col("bhi")) & (F.col("blo") <= F.col("ahi"))).select("a", "b", F.greatest("alo", "blo").alias("lo"), F.least("ahi", "bhi").alias("hi"))


def covering(files: DataFrame, keys: DataFrame, number: str = "run_id") -> DataFrame:
    """(key, file) of every file whose range covers a key of ``keys``, with rank 1 for the newest file."""
    hit = join_ranges(keys.select("key").distinct(), files)
    return hit.select("key", F.col(number).alias("file"), F.row_number().over(W.partitionBy("key").orderBy(F.desc(number))).alias("rank"))


def meeting_ranges(files: DataFrame, ranges: DataFrame, number: str = "run_id") -> DataFrame:
    """(range_id, file) for ranges (range_id, lo, hi; nulls are infinite)."""
    return files.join(small(ranges), (F.col("lo").isNull() | (F.col("largest_key") >= F.col("lo"))) & (F.col("hi").isNull() | (F.col("smallest_key") <= F.col("hi")))).select("range_id", F.col(number).alias("file"))


def find_file(files: DataFrame, keys: DataFrame, number: str = "run_id") -> DataFrame:
    """For sorted disjoint files: (key, file) with the first file whose largest key is not below the key,
    null beyond the last."""
    k = keys.select("key").distinct()
    # a file answers for the keys after its predecessor's largest and up to its own
    line = W.orderBy("largest_key")
    spans = files.select(F.col(number).alias("file"), F.lag("largest_key").over(line).alias("lo"), F.col("largest_key").alias("hi"))
    hit = join_ranges(k, spans, lo="lo", hi="hi").groupBy("key").agg(F.min_by("file", "hi").alias("file"))
    return k.join(hit, "key", "left")


def base_level_keys(keys: DataFrame, deeper: DataFrame) -> DataFrame:
    """Keys that no range of the deeper levels covers."""
    return join_ranges(keys.select("key").distinct(), deeper.select("smallest_key", "largest_key"), "left_anti")


def level_stats(files: DataFrame) -> DataFrame:
    return files.groupBy("level").agg(F.count("*").alias("n_files"), F.sum("file_size").alias("n_bytes"), F.sum("num_entries").alias("n_entries"), F.min("smallest_key").alias("lo"), F.max("largest_key").alias("hi"))


def exact_sizes(muts: DataFrame, ranges: DataFrame) -> DataFrame:
    """(range_id, n_bytes, n_rows) of key and value bytes stored in [lo, hi)."""
    size = F.length("key") + F.coalesce(F.length("value"), F.lit(0))
    hit = small(ranges).join(muts, (F.col("lo").isNull() | (F.col("key") >= F.col("lo"))) & (F.col("hi").isNull() | (F.col("key") < F.col("hi"))), "left")
    return hit.groupBy("range_id").agg(F.coalesce(F.sum(size), F.lit(0)).cast("long").alias("n_bytes"), F.count("key").alias("n_rows"))


def approximate_sizes(files: DataFrame, ranges: DataFrame) -> DataFrame:
    """(range_id, n_bytes) from metadata only: offset of hi less offset of lo, where a file before a key
    counts whole, one after it not at all, and one around it half."""
    both = ranges.select("range_id", F.explode(F.array(F.struct(F.lit(1).alias("sign"), F.col("hi").alias("key")), F.struct(F.lit(-1).alias("sign"), F.col("lo").alias("key")))).alias("e")).select("range_id", "e.sign", "e.key")
    asks = both.where(F.col("key").isNotNull()).select("range_id", "sign", "key", F.lit(1).alias("place"), F.lit(0).cast("long").alias("bytes"))
    half = F.floor(F.col("file_size") / 2).cast("long")
    # a file's lower half counts from its smallest key on, the rest beyond its largest
    none = (F.lit(None).cast(ranges.schema["range_id"].dataType).alias("range_id"), F.lit(None).cast("int").alias("sign"))
    points = files.select(*none, F.col("smallest_key").alias("key"), F.lit(0).alias("place"), half.alias("bytes")).unionByName(files.select(*none, F.col("largest_key").alias("key"), F.lit(2).alias("place"), (F.col("file_size") - half).cast("long").alias("bytes")))
    at = running_sum(points.unionByName(asks), ["key", "place"], "bytes", "upto").where(F.col("sign").isNotNull())
    total = files.agg(F.coalesce(F.sum("file_size"), F.lit(0)).cast("long"))
    ends = both.where(F.col("key").isNull() & (F.col("sign") == 1)).select("range_id", "sign", total.scalar().alias("upto"))
    span = at.select("range_id", "sign", "upto").unionByName(ends).groupBy("range_id").agg(F.sum(F.col("sign") * F.col("upto")).alias("n"))
    return ranges.select("range_id").join(span, "range_id", "left").select("range_id", F.greatest(F.coalesce("n", F.lit(0)), F.lit(0)).cast("long").alias("n_bytes"))


def running_sum(rows: DataFrame, order: list[str], value: str, name: str) -> DataFrame:
    """``rows`` with the sum of ``value`` up to and with their own place in ``order``: ranges of rows are summed in tasks of
    their own, and one total a range is carried over."""
    part = "_part"
    dealt = pinned(rows.repartitionByRange(*order).withColumn(part, F.spark_partition_id()))
    inside = F.sum(value).over(W.partitionBy(part).orderBy(*order))
    totals = dealt.groupBy(part).agg(F.sum(value).alias("_sum"))
    before = totals.alias("a").join(totals.alias("b"), F.col("b._part") < F.col("a._part")).groupBy("a._part").agg(F.sum("b._sum").alias("_before"))
    return dealt.withColumn(name, inside).join(F.broadcast(before), part, "left").withColumn(name, F.col(name) + F.coalesce("_before", F.lit(0))).drop(part, "_before")


def next_level_overlap(files: DataFrame) -> DataFrame:
    """(level, number, n_bytes): bytes of the next level that each file from level 1 on overlaps."""
    below = files.select((F.col("level") - 1).alias("up"), F.col("smallest_key").alias("lo"), F.col("largest_key").alias("hi"), F.col("file_size").alias("size"))
    upper = files.where("level >= 1").select("level", "number", "smallest_key", "largest_key")
    met = upper.join(below, (F.col("up") == F.col("level")) & (F.col("largest_key") >= F.col("lo")) & (F.col("smallest_key") <= F.col("hi")), "left")
    return met.groupBy("level", "number").agg(F.coalesce(F.sum("size"), F.lit(0)).cast("long").alias("n_bytes"))


def output_cuts(rows: DataFrame, size: Column, limit: int, order: str = "key", part: str = "part") -> DataFrame:
    """``rows`` with file_no, a cut by running bytes within each range partition ``part``."""
    w = W.partitionBy(part).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    return rows.withColumn("file_no", F.floor(F.coalesce(F.sum(size).over(w), F.lit(0)) / limit))
