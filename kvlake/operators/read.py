"""Reads: snapshots, point and multi lookups, range and prefix scans, cursor moves, history, as-of.

All take a mutation relation with key, seq, op and value (other columns are carried where the shape
allows). ``snapshot`` is the last visible sequence number, None for all. ``order`` is a user-defined
order (see functions.keys): grouping and comparing use the sort key.

Plans: newest version per key is row_number() = 1, which Spark runs with a group limit before the
shuffle; predicates on the key and on the sequence are applied to the log itself, so that they reach
the Parquet scan; cursor moves are a top-1 by key of what passes the bound. Only the newest visible
version may be tested for deletion, so that test always comes after.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, Window as W

from kvlake.functions.keys import Order, bytewise, prefix_end
from kvlake.plans.scratch import pinned
from kvlake.schema import DELETE, PUT


def upto(muts: DataFrame, snapshot: int | None) -> DataFrame:
    return muts if snapshot is None else muts.where(F.col("seq") <= snapshot)


def last_sequence(muts: DataFrame) -> int:
    """The largest sequence number; 0 for an empty log."""
    return muts.agg(F.max("seq")).first()[0] or 0


def newest(muts: DataFrame, snapshot: int | None = None, order: Order = bytewise) -> DataFrame:
    """The newest visible mutation of every key, deletions included."""
    w = W.partitionBy(order(F.col("key"))).orderBy(F.desc("seq"))
    return upto(muts, snapshot).withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def visible(muts: DataFrame, snapshot: int | None = None, order: Order = bytewise) -> DataFrame:
    """(key, seq, value) of every live key."""
    return newest(muts, snapshot, order).where(F.col("op") == PUT).select("key", "seq", "value")


def visible_by_aggregate(muts: DataFrame, snapshot: int | None = None) -> DataFrame:
    """The same as a mergeable aggregate: the newest sequence per key is a hash aggregate with a partial
    stage, and its row is fetched by an equi-join on (key, seq)."""
    seen = upto(muts, snapshot)
    top = seen.groupBy("key").agg(F.max("seq").alias("seq"))
    return seen.join(top, ["key", "seq"]).where(F.col("op") == PUT).select("key", "seq", "value")


def _same(order: Order, key) -> Column:
    """Whether a row's key is ``key`` in this order; with the default, a plain comparison that reaches the scan."""
    return F.col("key") == F.lit(key) if order is bytewise else order(F.col("key")).eqNullSafe(order(F.lit(key)))


def get(muts: DataFrame, key, snapshot: int | None = None, order: Order = bytewise) -> DataFrame:
    """(key, seq, value) of one key: at most one row, none if it was never put or is deleted."""
    found = upto(muts, snapshot).where(_same(order, key)).orderBy(F.desc("seq")).limit(1)
    return found.where(F.col("op") == PUT).select("key", "seq", "value")


def multi_get(muts: DataFrame, keys: DataFrame, snapshot: int | None = None, keep_missing: bool = False, order: Order = bytewise) -> DataFrame:
    """Values of a set of keys (column key; repeated keys count once); ``keep_missing`` returns absent
    keys with nulls. The log is cut to the asked keys before versions are compared. Keys are returned as they are asked."""
    keys = keys.select("key").distinct().withColumn("_by", order(F.col("key")))
    asked = keys.select(F.col("_by").alias("_asked")).distinct()
    by = order(F.col("key"))
    live = visible(muts.join(asked, by.eqNullSafe(F.col("_asked")), "left_semi"), snapshot, order)
    live = live.select(by.alias("_have"), "seq", "value")
    met = F.col("_by") == F.col("_have") if order is bytewise else F.col("_by").eqNullSafe(F.col("_have"))
    return keys.join(live, met, "left" if keep_missing else "inner").select("key", "seq", "value")


def scan(muts: DataFrame, lo=None, hi=None, snapshot: int | None = None, limit: int | None = None, reverse: bool = False, order: Order = bytewise, sort: bool = True) -> DataFrame:
    """Live rows with lo <= key < hi in order (None: unbounded)."""
    by = order(F.col("key"))
    if lo is not None:
        muts = muts.where(by >= order(F.lit(lo)))
    if hi is not None:
        muts = muts.where(by < order(F.lit(hi)))
    out = visible(muts, snapshot, order)
    if sort or limit is not None:
        out = out.orderBy(by.desc() if reverse else by.asc())
    return out if limit is None else out.limit(limit)


def prefix_scan(muts: DataFrame, prefix, snapshot: int | None = None, order: Order = bytewise, **more) -> DataFrame:
    """Live rows whose key begins with ``prefix``, as a range, so that it prunes; in other orders than the default the
    prefix is no range, and every live key is looked at."""
    if order is not bytewise:
        live = visible(muts, snapshot, order)
        return live.where(F.startswith("key", F.lit(prefix))).orderBy(order(F.col("key")))
    end = prefix_end(prefix if isinstance(prefix, bytes) else prefix.encode())
    if end is not None and not isinstance(prefix, bytes):
        try:
            end = end.decode()
        except UnicodeDecodeError:
            return scan(muts.where(F.startswith("key", F.lit(prefix))), prefix, None, snapshot, **more)
    return scan(muts, prefix, end, snapshot, **more)


def _edge(muts: DataFrame, bound: Column | None, snapshot: int | None, order: Order, last: bool) -> DataFrame:
    by = order(F.col("key"))
    muts = muts if bound is None else muts.where(bound)
    return visible(muts, snapshot, order).orderBy(by.desc() if last else by.asc()).limit(1)


def seek(muts: DataFrame, target, snapshot: int | None = None, order: Order = bytewise) -> DataFrame:
    """The first live row at or after ``target``."""
    return _edge(muts, order(F.col("key")) >= order(F.lit(target)), snapshot, order, False)


def floor(muts: DataFrame, target, snapshot: int | None = None, order: Order = bytewise) -> DataFrame:
    """The last live row at or before ``target``."""
    return _edge(muts, order(F.col("key")) <= order(F.lit(target)), snapshot, order, True)


def first(muts: DataFrame, snapshot: int | None = None, order: Order = bytewise) -> DataFrame:
    return _edge(muts, None, snapshot, order, False)


def last(muts: DataFrame, snapshot: int | None = None, order: Order = bytewise) -> DataFrame:
    return _edge(muts, None, snapshot, order, True)


def next_after(muts: DataFrame, key, snapshot: int | None = None, order: Order = bytewise) -> DataFrame:
    """The first live row after ``key``."""
    return _edge(muts, order(F.col("key")) > order(F.lit(key)), snapshot, order, False)


def previous(muts: DataFrame, key, snapshot: int | None = None, order: Order = bytewise) -> DataFrame:
    """The last live row before ``key``."""
    return _edge(muts, order(F.col("key")) < order(F.lit(key)), snapshot, order, True)


def _beside(muts: DataFrame, probes: DataFrame, snapshot: int | None, ahead: bool) -> DataFrame:
    """(probe, key, value) of the nearest live row at or beyond each distinct probe. Keys are cut into ranges by a global sort;
    within a range it is a running value, and between ranges only one edge row per range is carried over."""
    live = visible(muts, snapshot).select("key", F.lit(False).alias("asked"), F.struct("key", "value").alias("found"))
    asks = probes.select("key").distinct().select("key", F.lit(True).alias("asked"), F.lit(None).cast(live.schema["found"].dataType).alias("found"))
    ranked = pinned(live.unionByName(asks).repartitionByRange("key").withColumn("part", F.spark_partition_id()))
    # rows come from the far side, equal live keys before probes, so that the frame only ever grows
    order = [F.col("key").desc() if ahead else F.col("key").asc(), F.col("asked").asc()]
    near = F.last("found", ignorenulls=True).over(W.partitionBy("part").orderBy(*order).rowsBetween(W.unboundedPreceding, 0))
    edges = ranked.where("NOT asked").groupBy("part").agg((F.min_by if ahead else F.max_by)("found", "key").alias("edge"))
    carry = edges.alias("e").join(ranked.select("part").distinct().alias("p"), (F.col("e.part") > F.col("p.part")) if ahead else (F.col("e.part") < F.col("p.part")))
    carry = carry.groupBy("p.part").agg((F.min_by if ahead else F.max_by)("e.edge", "e.edge.key").alias("edge"))
    met = ranked.withColumn("near", near).where("asked").join(F.broadcast(carry), "part", "left").select(F.col("key").alias("probe"), F.coalesce("near", "edge").alias("m"))
    return met.select("probe", "m.key", "m.value")


def seek_many(muts: DataFrame, probes: DataFrame, snapshot: int | None = None) -> DataFrame:
    """(probe, key, value): for every row of ``probes`` (column key) the first live row at or after it,
    nulls if there is none. Distinct probes. The log is read and reduced to live rows once."""
    return _beside(muts, probes, snapshot, True)


def floor_many(muts: DataFrame, probes: DataFrame, snapshot: int | None = None) -> DataFrame:
    """(probe, key, value): the last live row at or before every probe."""
    return _beside(muts, probes, snapshot, False)


def neighbours(muts: DataFrame, snapshot: int | None = None) -> DataFrame:
    """(key, prev_key, next_key) of every live key. Ranges of keys are windows of their own; the keys at
    their edges, two a range, are joined across."""
    live = pinned(visible(muts, snapshot).select("key").repartitionByRange("key").withColumn("part", F.spark_partition_id()))
    w = W.partitionBy("part").orderBy("key")
    inside = live.withColumn("p", F.lag("key").over(w)).withColumn("n", F.lead("key").over(w))
    edges = live.groupBy("part").agg(F.min("key").alias("lo"), F.max("key").alias("hi"))
    line = W.orderBy("part")
    around = edges.select("part", F.lag("hi").over(line).alias("before"), F.lead("lo").over(line).alias("after"))
    return inside.join(F.broadcast(around), "part").select("key", F.coalesce("p", "before").alias("prev_key"), F.coalesce("n", "after").alias("next_key"))


def history(muts: DataFrame, key, order: Order = bytewise) -> DataFrame:
    """All versions of one key, newest first."""
    return muts.where(_same(order, key)).select("key", "seq", "op", "value").orderBy(F.desc("seq"))


def version_counts(muts: DataFrame, order: Order = bytewise) -> DataFrame:
    """Versions, deletions and newest sequence of every key; of keys that are equal in the order the newest is named."""
    dels = F.sum(F.when(F.col("op") == DELETE, 1).otherwise(0))
    found = muts.groupBy(order(F.col("key")).alias("_by")).agg(F.max_by("key", "seq").alias("key"), F.count("*").alias("versions"), dels.alias("deletions"), F.max("seq").alias("newest_seq"))
    return found.drop("_by")


def deleted_keys(muts: DataFrame, snapshot: int | None = None, order: Order = bytewise) -> DataFrame:
    """Keys whose newest visible mutation is a deletion."""
    return newest(muts, snapshot, order).where(F.col("op") == DELETE).select("key", "seq")


def hidden_versions(muts: DataFrame, snapshot: int | None = None, order: Order = bytewise) -> DataFrame:
    """Visible mutations that a newer visible one of the same key covers."""
    w = W.partitionBy(order(F.col("key"))).orderBy(F.desc("seq"))
    return upto(muts, snapshot).withColumn("_n", F.row_number().over(w)).where("_n > 1").select("key", "seq", "op", "value")


def as_of_join(probes: DataFrame, muts: DataFrame, key: str = "key", at: str = "as_of", order: Order = bytewise) -> DataFrame:
    """``probes`` with the value (and its seq) that each row's key had at its own sequence number, nulls if
    absent or deleted. Probes and versions are merged in one pass in order of key and sequence, never paired up. Ranges of that
    order are merged in tasks of their own, so that a key with very many rows is split, and the last version of each
    range is carried over to those behind it."""
    log = muts.select(order(F.col("key")).alias("_k"), F.col("seq").alias("_t"), F.lit(False).alias("_ask"), F.struct("seq", "op", "value").alias("_v"), F.lit(None).cast(probes.schema).alias("_p"))
    asks = probes.select(order(F.col(key)).alias("_k"), F.col(at).alias("_t"), F.lit(True).alias("_ask"), F.lit(None).cast(log.schema["_v"].dataType).alias("_v"), F.struct(*probes.columns).alias("_p"))
    ranked = pinned(log.unionByName(asks).repartitionByRange("_k", "_t", "_ask").withColumn("_part", F.spark_partition_id()))
    near = F.last("_v", ignorenulls=True).over(W.partitionBy("_part", "_k").orderBy("_t", "_ask").rowsBetween(W.unboundedPreceding, 0))
    edges = ranked.where("NOT _ask").groupBy("_part").agg(F.max(F.struct("_k", "_t", "_v")).alias("edge"))
    carry = edges.alias("e").join(ranked.select("_part").distinct().alias("p"), F.col("e._part") < F.col("p._part")).groupBy("p._part").agg(F.max("e.edge").alias("edge"))
    met = ranked.withColumn("_l", near).where("_ask").join(F.broadcast(carry), "_part", "left")
    met = met.withColumn("_l", F.coalesce("_l", F.when(F.col("edge._k").eqNullSafe(F.col("_k")), F.col("edge._v"))))
    live = F.col("_l.op") == PUT
    return met.select("_p.*", F.when(live, F.col("_l.seq")).alias("value_seq"), F.when(live, F.col("_l.value")).alias("value"))


def diff(muts: DataFrame, old: int, new: int, order: Order = bytewise) -> DataFrame:
    """(key, change, old_value, new_value) between two snapshots: added, removed or changed (a value put
    again unchanged is no change). One pass: both states of a key come from one aggregate."""
    def state(s: int) -> Column:
        at = F.when(F.col("seq") <= s, F.col("seq"))
        return F.max_by(F.struct("op", "value"), at)

    both = upto(muts, max(old, new)).groupBy(order(F.col("key")).alias("_by")).agg(F.max_by("key", "seq").alias("key"), state(old).alias("o"), state(new).alias("n"))
    had, has = F.coalesce(F.col("o.op") == PUT, F.lit(False)), F.coalesce(F.col("n.op") == PUT, F.lit(False))
    kind = F.when(~had & has, "added").when(had & ~has, "removed").when(had & has & ~F.col("o.value").eqNullSafe(F.col("n.value")), "changed")
    out = both.select("key", kind.alias("change"), F.when(had, F.col("o.value")).alias("old_value"), F.when(has, F.col("n.value")).alias("new_value"))
    return out.where("change IS NOT NULL")
