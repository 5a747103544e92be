"""Registered queries over the supplied tables and the SQL each of them must agree with.

The mutation log is derived from ``events``: key is the padded user id, seq the event id plus one, an
error event deletes, any other puts its props. Runs are quarters of the sequence; the snapshot is
half of it.
"""

from __future__ import annotations

from uuid import uuid4

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from kvlake.functions import bloom
from kvlake.functions.coding import crc32c
from kvlake.functions.keys import padded, reverse_bytewise
from kvlake.operators import compact, files as fs, histogram, manifest, merge, mutate, read
from kvlake.plans.scratch import shared_folder
from kvlake.plans.store import Store
from kvlake.sources import dump, edits, sstable, wal
from kvlake.streaming import ingest


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def mutations(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _t(spark, sf_dir, "events")
    put = F.col("event_type") != "error"
    return e.select(padded(F.col("user_id")).alias("key"), (F.col("event_id") + 1).alias("seq"), put.cast("int").alias("op"), F.when(put, F.col("props")).alias("value"))


def order_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Disjoint runs: one put per order, five runs by key."""
    o = _t(spark, sf_dir, "orders")
    return o.select(padded(F.col("o_orderkey")).alias("key"), F.col("o_orderkey").alias("seq"), F.lit(1).alias("op"), F.col("o_orderpriority").alias("value"))


def _half(muts: DataFrame) -> int:
    return read.last_sequence(muts) // 2


def _runs(muts: DataFrame) -> DataFrame:
    quarter = max(1, read.last_sequence(muts) // 4)
    return muts.withColumn("run_id", F.least(F.floor((F.col("seq") - 1) / quarter), F.lit(3)))


def _order_runs(muts: DataFrame) -> DataFrame:
    fifth = read.last_sequence(muts) // 5 + 1
    return muts.withColumn("run_id", F.floor(F.col("seq") / fifth))


def _manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of two levels: the overlapping event runs at level 0, the disjoint order runs at level 1
    and, twice as coarse, at level 2."""
    events, orders = _runs(mutations(spark, sf_dir)), _order_runs(order_log(spark, sf_dir))
    cols = ["level", "number", "file_size", "smallest_key", "largest_key", "num_entries"]
    l0 = fs.run_metadata(events).select(F.lit(0).alias("level"), F.col("run_id").alias("number"), *cols[2:])
    l1 = fs.run_metadata(orders).select(F.lit(1).alias("level"), (F.col("run_id") + 10).alias("number"), *cols[2:])
    l2 = fs.run_metadata(orders.withColumn("run_id", F.floor(F.col("run_id") / 2))).select(F.lit(2).alias("level"), (F.col("run_id") + 20).alias("number"), *cols[2:])
    return l0.unionByName(l1).unionByName(l2)


def _edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edits from ``lineitem``: the n-th line of an order adds the file, returned lines delete it."""
    li = _lines(spark, sf_dir)
    return li.select(
        F.col("l_linenumber").cast("long").alias("edit_id"), F.when(F.col("flag") == "R", "delete").otherwise("add").alias("kind"),
        (F.col("l_orderkey") % 3).cast("int").alias("level"), F.col("l_orderkey").alias("number"), F.col("quantity").alias("file_size"),
    )


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per order and line number."""
    return _t(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_returnflag").alias("flag"), F.max("l_partkey").alias("part"), F.max("l_quantity").cast("long").alias("quantity"))


def _probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys to look for, some absent: customers' numbers times three."""
    return _t(spark, sf_dir, "customer").select(padded(F.col("c_custkey") * 3).alias("key"))


def _ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = _t(spark, sf_dir, "nation")
    lo, hi = padded(F.col("n_nationkey").cast("long") * 7), padded(F.col("n_nationkey").cast("long") * 11 + 5)
    return n.select(F.col("n_nationkey").cast("long").alias("range_id"), F.when(F.col("n_nationkey") > 0, lo).alias("lo"), F.when(F.col("n_nationkey") < 24, hi).alias("hi"))


def _batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One batch per order, its lines in order; returned lines delete their part's key."""
    put = F.col("flag") != "R"
    return _lines(spark, sf_dir).select(F.col("l_orderkey").alias("batch_id"), F.col("l_linenumber").alias("pos"), put.cast("int").alias("op"), padded(F.col("part") % 50).alias("key"), F.when(put, F.col("quantity").cast("string")).alias("value"))


QUERIES: dict = {}
ORACLES: dict[str, str] = {}

_BASE = """m AS (SELECT printf('%016d', user_id) AS key, event_id + 1 AS seq, CASE WHEN event_type = 'error' THEN 0 ELSE 1 END AS op,
  CASE WHEN event_type = 'error' THEN NULL ELSE props END AS value FROM events),
s AS (SELECT max(seq) // 2 AS s, greatest(1, max(seq) // 4) AS q FROM m),
r AS (SELECT m.*, CAST(least((seq - 1) // q, 3) AS BIGINT) AS run_id FROM m, s),
n AS (SELECT key, seq, op, value FROM m, s WHERE seq <= s QUALIFY row_number() OVER (PARTITION BY key ORDER BY seq DESC) = 1),
v AS (SELECT key, seq, value FROM n WHERE op = 1),
l AS (SELECT key, seq, value FROM (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY key ORDER BY seq DESC) = 1) WHERE op = 1),
o AS (SELECT printf('%016d', o_orderkey) AS key, o_orderkey AS seq, 1 AS op, o_orderpriority AS value,
  o_orderkey // ((SELECT max(o_orderkey) FROM orders) // 5 + 1) AS run_id FROM orders),
p AS (SELECT printf('%016d', c_custkey * 3) AS key FROM customer),
g AS (SELECT CAST(n_nationkey AS BIGINT) AS range_id, CASE WHEN n_nationkey > 0 THEN printf('%016d', CAST(n_nationkey AS BIGINT) * 7) END AS lo,
  CASE WHEN n_nationkey < 24 THEN printf('%016d', CAST(n_nationkey AS BIGINT) * 11 + 5) END AS hi FROM nation),
x AS (SELECT run_id, min(key) AS smallest_key, max(key) AS largest_key, min(seq) AS smallest_seq, max(seq) AS largest_seq, count(*) AS num_entries,
  CAST(sum(strlen(key) + coalesce(strlen(value), 0)) AS BIGINT) AS file_size FROM r GROUP BY run_id),
ox AS (SELECT run_id, min(key) AS smallest_key, max(key) AS largest_key, count(*) AS num_entries,
  CAST(sum(strlen(key) + coalesce(strlen(value), 0)) AS BIGINT) AS file_size FROM o GROUP BY run_id),
ox2 AS (SELECT run_id // 2 AS run_id, min(smallest_key) AS smallest_key, max(largest_key) AS largest_key, CAST(sum(num_entries) AS BIGINT) AS num_entries,
  CAST(sum(file_size) AS BIGINT) AS file_size FROM ox GROUP BY 1),
f AS (SELECT 0 AS level, run_id AS number, file_size, smallest_key, largest_key, num_entries FROM x
  UNION ALL SELECT 1, run_id + 10, file_size, smallest_key, largest_key, num_entries FROM ox
  UNION ALL SELECT 2, run_id + 20, file_size, smallest_key, largest_key, num_entries FROM ox2),
li AS (SELECT l_orderkey, l_linenumber, min(l_returnflag) AS flag, max(l_partkey) AS part, CAST(max(l_quantity) AS BIGINT) AS quantity FROM lineitem GROUP BY 1, 2),
ed AS (SELECT CAST(l_linenumber AS BIGINT) AS edit_id, CASE WHEN flag = 'R' THEN 'delete' ELSE 'add' END AS kind,
  CAST(l_orderkey % 3 AS INTEGER) AS level, l_orderkey AS number, quantity AS file_size FROM li),
lv AS (SELECT level, number, file_size, kind FROM ed QUALIFY row_number() OVER (PARTITION BY level, number ORDER BY edit_id DESC) = 1),
bt AS (SELECT l_orderkey AS batch_id, l_linenumber AS pos, CASE WHEN flag = 'R' THEN 0 ELSE 1 END AS op, printf('%016d', part % 50) AS key,
  CASE WHEN flag = 'R' THEN NULL ELSE CAST(quantity AS VARCHAR) END AS value FROM li),
c AS (SELECT m.*, s.s, lag(seq) OVER (PARTITION BY key ORDER BY seq DESC) AS newer FROM m, s)"""


def _register(name: str, sql: str | None, base: bool = True):
    def keep(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = f"WITH {_BASE} {sql}" if base else sql
        return f

    return keep


@_register("snapshot_read", "SELECT * FROM v")
def snapshot_read(spark, d):
    m = mutations(spark, d)
    return read.visible(m, _half(m))


@_register("latest_by_agg", "SELECT * FROM l")
def latest_by_agg(spark, d):
    return read.visible_by_aggregate(mutations(spark, d))


@_register("point_get", "SELECT * FROM l WHERE key = (SELECT min(key) FROM l)")
def point_get(spark, d):
    m = mutations(spark, d)
    return read.get(m, read.first(m).first()["key"])


@_register("point_get_missing", "SELECT * FROM l WHERE key = '0000000000000000.'")
def point_get_missing(spark, d):
    return read.get(mutations(spark, d), "0000000000000000.")


@_register("multi_get", "SELECT l.* FROM l JOIN (SELECT DISTINCT key FROM p) USING (key)")
def multi_get(spark, d):
    return read.multi_get(mutations(spark, d), _probes(spark, d))


@_register("multi_get_left", "SELECT k.key, v.seq, v.value FROM (SELECT DISTINCT key FROM p) k LEFT JOIN v USING (key)")
def multi_get_left(spark, d):
    m = mutations(spark, d)
    return read.multi_get(m, _probes(spark, d), _half(m), keep_missing=True)


@_register("range_scan", "SELECT * FROM l WHERE key >= '0000000000000020' AND key < '0000000000000090'")
def range_scan(spark, d):
    return read.scan(mutations(spark, d), "0000000000000020", "0000000000000090")


@_register("prefix_scan", "SELECT * FROM l WHERE starts_with(key, '000000000000001')")
def prefix_scan(spark, d):
    return read.prefix_scan(mutations(spark, d), "000000000000001")


@_register("reverse_scan_limit", "SELECT * FROM l ORDER BY key DESC LIMIT 20")
def reverse_scan_limit(spark, d):
    return read.scan(mutations(spark, d), limit=20, reverse=True)


@_register("scan_limit", "SELECT * FROM v WHERE key >= '0000000000000007' ORDER BY key LIMIT 20")
def scan_limit(spark, d):
    m = mutations(spark, d)
    return read.scan(m, "0000000000000007", snapshot=_half(m), limit=20)


@_register("seek_ceiling", "SELECT k.key AS probe, l.key, l.value FROM (SELECT k.key, min(l.key) AS hit FROM (SELECT DISTINCT key FROM p) k LEFT JOIN l ON l.key >= k.key GROUP BY 1) k LEFT JOIN l ON l.key = k.hit")
def seek_ceiling(spark, d):
    return read.seek_many(mutations(spark, d), _probes(spark, d))


@_register("floor_lookup", "SELECT k.key AS probe, l.key, l.value FROM (SELECT k.key, max(l.key) AS hit FROM (SELECT DISTINCT key FROM p) k LEFT JOIN l ON l.key <= k.key GROUP BY 1) k LEFT JOIN l ON l.key = k.hit")
def floor_lookup(spark, d):
    return read.floor_many(mutations(spark, d), _probes(spark, d))


@_register("first_last", "SELECT * FROM l WHERE key IN ((SELECT min(key) FROM l), (SELECT max(key) FROM l))")
def first_last(spark, d):
    m = mutations(spark, d)
    return read.first(m).union(read.last(m)).distinct()


@_register("seek_one", "(SELECT 'seek' AS move, * FROM l WHERE key >= '0000000000000011' ORDER BY key LIMIT 1) UNION ALL (SELECT 'floor', * FROM l WHERE key <= '0000000000000011' ORDER BY key DESC LIMIT 1) UNION ALL (SELECT 'next', * FROM l WHERE key > '0000000000000011' ORDER BY key LIMIT 1) UNION ALL (SELECT 'prev', * FROM l WHERE key < '0000000000000011' ORDER BY key DESC LIMIT 1)")
def seek_one(spark, d):
    m, k = mutations(spark, d), "0000000000000011"
    moves = {"seek": read.seek(m, k), "floor": read.floor(m, k), "next": read.next_after(m, k), "prev": read.previous(m, k)}
    return merge.union_runs(*[df.select(F.lit(name).alias("move"), "key", "seq", "value") for name, df in moves.items()])


@_register("next_prev", "SELECT key, lag(key) OVER (ORDER BY key) AS prev_key, lead(key) OVER (ORDER BY key) AS next_key FROM l")
def next_prev(spark, d):
    return read.neighbours(mutations(spark, d))


@_register("history_of_key", "SELECT key, seq, op, value FROM m WHERE key = '0000000000000005'")
def history_of_key(spark, d):
    return read.history(mutations(spark, d), "0000000000000005")


@_register("version_counts", "SELECT key, count(*) AS versions, CAST(sum(CASE WHEN op = 0 THEN 1 ELSE 0 END) AS BIGINT) AS deletions, max(seq) AS newest_seq FROM m GROUP BY key")
def version_counts(spark, d):
    return read.version_counts(mutations(spark, d))


@_register("deleted_keys", "SELECT key, seq FROM n WHERE op = 0")
def deleted_keys(spark, d):
    m = mutations(spark, d)
    return read.deleted_keys(m, _half(m))


@_register("hidden_versions", "SELECT key, seq, op, value FROM m, s WHERE seq <= s QUALIFY row_number() OVER (PARTITION BY key ORDER BY seq DESC) > 1")
def hidden_versions(spark, d):
    m = mutations(spark, d)
    return read.hidden_versions(m, _half(m))


@_register("asof_join", "SELECT a.event_id, a.key, a.as_of, CASE WHEN m.op = 1 THEN m.seq END AS value_seq, m.value FROM (SELECT event_id, printf('%016d', (user_id * 13 + event_id) % (SELECT max(user_id) + 11 FROM events)) AS key, event_id AS as_of FROM events) a ASOF LEFT JOIN m ON a.key = m.key AND a.as_of >= m.seq")
def asof_join(spark, d):
    e = _t(spark, d, "events")
    domain = e.agg(F.max("user_id")).first()[0] + 11  # all keys and ten absent ones
    asks = e.select("event_id", padded((F.col("user_id") * 13 + F.col("event_id")) % domain).alias("key"), F.col("event_id").alias("as_of"))
    return read.as_of_join(asks, mutations(spark, d))


@_register("snapshot_diff", "SELECT coalesce(v.key, l.key) AS key, CASE WHEN v.key IS NULL THEN 'added' WHEN l.key IS NULL THEN 'removed' ELSE 'changed' END AS change, v.value AS old_value, l.value AS new_value FROM v FULL JOIN l ON v.key = l.key WHERE v.key IS NULL OR l.key IS NULL OR v.value IS DISTINCT FROM l.value")
def snapshot_diff(spark, d):
    m = mutations(spark, d)
    last = read.last_sequence(m)
    return read.diff(m, last // 2, last)


@_register("batch_sequence", "SELECT key, 1000 + row_number() OVER (ORDER BY batch_id, pos) - 1 AS seq, op, value FROM bt")
def batch_sequence(spark, d):
    return mutate.batch_mutations(_batches(spark, d), 1000).withColumn("op", F.col("op").cast("int"))


@_register("overwrite_in_batch", "SELECT batch_id, key, pos, op, value FROM bt QUALIFY row_number() OVER (PARTITION BY batch_id, key ORDER BY pos DESC) = 1")
def overwrite_in_batch(spark, d):
    return mutate.overwritten(_batches(spark, d))


@_register("merge_runs", "SELECT key, seq, op, value FROM m")
def merge_runs(spark, d):
    m = _runs(mutations(spark, d))
    return merge.merge_runs(*[m.where(F.col("run_id") == i).drop("run_id") for i in range(4)], m.where("run_id = 1").drop("run_id"))


@_register("merged_read", "SELECT * FROM l")
def merged_read(spark, d):
    m = _runs(mutations(spark, d))
    return read.visible(merge.union_runs(*[m.where(F.col("run_id") == i) for i in range(4)]))


@_register("compaction_retained", "SELECT key, seq, op, value FROM c WHERE NOT (coalesce(newer <= s, false) OR (op = 0 AND seq <= s))")
def compaction_retained(spark, d):
    m = mutations(spark, d)
    return compact.retained(m, _half(m))


@_register("compaction_no_snapshot", "SELECT key, seq, op, value FROM c WHERE newer IS NULL AND op = 1")
def compaction_no_snapshot(spark, d):
    m = mutations(spark, d)
    return compact.retained(m, read.last_sequence(m))


@_register("compaction_non_base_level", "SELECT key, seq, op, value FROM c WHERE NOT coalesce(newer <= s, false)")
def compaction_non_base_level(spark, d):
    m = mutations(spark, d)
    return compact.retained(m, _half(m), False)


@_register("compaction_dropped", "SELECT key, seq, op, value FROM c WHERE coalesce(newer <= s, false) OR (op = 0 AND seq <= s)")
def compaction_dropped(spark, d):
    m = mutations(spark, d)
    return compact.garbage(m, _half(m))


@_register("compaction_over_levels", "SELECT key, seq, op, value FROM c WHERE NOT (coalesce(newer <= s, false) OR (op = 0 AND seq <= s AND NOT EXISTS (SELECT 1 FROM ox WHERE c.key BETWEEN smallest_key AND largest_key AND run_id >= 1)))")
def compaction_over_levels(spark, d):
    m = mutations(spark, d)
    return compact.retained_over(m, _half(m), fs.run_metadata(_order_runs(order_log(spark, d))).where("run_id >= 1"))


@_register("run_metadata", "SELECT * FROM x")
def run_metadata(spark, d):
    return fs.run_metadata(_runs(mutations(spark, d)))


@_register("file_overlap_pairs", "SELECT a.run_id AS a, b.run_id AS b, greatest(a.smallest_key, b.smallest_key) AS lo, least(a.largest_key, b.largest_key) AS hi FROM x a JOIN x b ON a.run_id < b.run_id AND a.smallest_key <= b.largest_key AND b.smallest_key <= a.largest_key")
def file_overlap_pairs(spark, d):
    return fs.overlap_pairs(fs.run_metadata(_runs(mutations(spark, d))))


@_register("files_for_key", "SELECT k.key, x.run_id AS file, CAST(row_number() OVER (PARTITION BY k.key ORDER BY x.run_id DESC) AS INTEGER) AS rank FROM (SELECT DISTINCT key FROM p) k JOIN x ON k.key BETWEEN smallest_key AND largest_key")
def files_for_key(spark, d):
    return fs.covering(fs.run_metadata(_runs(mutations(spark, d))), _probes(spark, d))


@_register("files_for_range", "SELECT range_id, run_id AS file FROM ox JOIN g ON (lo IS NULL OR largest_key >= lo) AND (hi IS NULL OR smallest_key <= hi)")
def files_for_range(spark, d):
    return fs.meeting_ranges(fs.run_metadata(_order_runs(order_log(spark, d))), _ranges(spark, d))


@_register("overlapping_inputs", "SELECT f.number, f.smallest_key, f.largest_key FROM f WHERE level = 1 AND largest_key >= '0000000000000300' AND smallest_key <= '0000000000001500'")
def overlapping_inputs(spark, d):
    return fs.overlapping(_manifest(spark, d), 1, "0000000000000300", "0000000000001500").select("number", "smallest_key", "largest_key")


@_register("find_file", "SELECT k.key, (SELECT arg_min(run_id, largest_key) FROM ox WHERE largest_key >= k.key) AS file FROM (SELECT DISTINCT key FROM p) k")
def find_file(spark, d):
    return fs.find_file(fs.run_metadata(_order_runs(order_log(spark, d))), _probes(spark, d))


@_register("base_level_keys", "SELECT DISTINCT key FROM m WHERE NOT EXISTS (SELECT 1 FROM ox WHERE m.key BETWEEN smallest_key AND largest_key AND run_id >= 1)")
def base_level_keys(spark, d):
    return fs.base_level_keys(mutations(spark, d), fs.run_metadata(_order_runs(order_log(spark, d))).where("run_id >= 1"))


@_register("level_stats", "SELECT level, count(*) AS n_files, CAST(sum(file_size) AS BIGINT) AS n_bytes, CAST(sum(num_entries) AS BIGINT) AS n_entries, min(smallest_key) AS lo, max(largest_key) AS hi FROM f GROUP BY level")
def level_stats(spark, d):
    return fs.level_stats(_manifest(spark, d))


@_register("compaction_score", "SELECT CAST(i.level AS INTEGER) AS level, count(f.number) AS n_files, CAST(coalesce(sum(file_size), 0) AS BIGINT) AS n_bytes, CASE WHEN i.level = 0 THEN count(f.number) / 4.0::DOUBLE ELSE coalesce(sum(file_size), 0)::DOUBLE / (10485760.0::DOUBLE * pow(10.0::DOUBLE, greatest(i.level - 1, 0))) END AS score FROM range(6) i(level) LEFT JOIN f ON f.level = i.level GROUP BY i.level")
def compaction_score(spark, d):
    return compact.level_scores(_manifest(spark, d))


@_register("compaction_pick", "SELECT 0 AS level, count(*) AS n_files, CAST(sum(file_size) AS BIGINT) AS n_bytes, count(*) / 4.0::DOUBLE AS score FROM x")
def compaction_pick(spark, d):
    return compact.pick_level(_manifest(spark, d))


@_register("exact_sizes", "SELECT range_id, CAST(coalesce(sum(strlen(key) + coalesce(strlen(value), 0)), 0) AS BIGINT) AS n_bytes, count(key) AS n_rows FROM g LEFT JOIN m ON (lo IS NULL OR key >= lo) AND (hi IS NULL OR key < hi) GROUP BY range_id")
def exact_sizes(spark, d):
    return fs.exact_sizes(mutations(spark, d), _ranges(spark, d))


@_register("approximate_sizes", "SELECT range_id, CAST(greatest(sum(CASE WHEN hi IS NULL THEN file_size WHEN largest_key < hi THEN file_size WHEN smallest_key > hi THEN 0 ELSE file_size // 2 END - CASE WHEN lo IS NULL THEN 0 WHEN largest_key < lo THEN file_size WHEN smallest_key > lo THEN 0 ELSE file_size // 2 END), 0) AS BIGINT) AS n_bytes FROM f, g GROUP BY range_id")
def approximate_sizes(spark, d):
    return fs.approximate_sizes(_manifest(spark, d), _ranges(spark, d))


@_register("next_level_overlap", "SELECT a.level, a.number, CAST(coalesce(sum(b.file_size), 0) AS BIGINT) AS n_bytes FROM f a LEFT JOIN f b ON b.level = a.level + 1 AND a.largest_key >= b.smallest_key AND a.smallest_key <= b.largest_key WHERE a.level >= 1 GROUP BY 1, 2")
def next_level_overlap(spark, d):
    return fs.next_level_overlap(_manifest(spark, d))


@_register("max_next_level_overlap", "SELECT CAST(max(n) AS BIGINT) AS n_bytes FROM (SELECT coalesce(sum(b.file_size), 0) AS n FROM f a LEFT JOIN f b ON b.level = a.level + 1 AND a.largest_key >= b.smallest_key AND a.smallest_key <= b.largest_key WHERE a.level >= 1 GROUP BY a.level, a.number)")
def max_next_level_overlap(spark, d):
    return fs.next_level_overlap(_manifest(spark, d)).agg(F.max("n_bytes").alias("n_bytes"))


@_register("manifest_replay", "SELECT level, number, file_size FROM lv WHERE kind = 'add'")
def manifest_replay(spark, d):
    return manifest.live_files(_edits(spark, d))


@_register("obsolete_files", "SELECT o_orderkey AS number FROM orders WHERE o_orderkey NOT IN (SELECT number FROM lv WHERE kind = 'add')")
def obsolete_files(spark, d):
    listing = _t(spark, d, "orders").select(F.col("o_orderkey").alias("number"))
    return manifest.obsolete_files(listing, manifest.live_files(_edits(spark, d)))


@_register("missing_files", "SELECT number, level, file_size FROM lv WHERE kind = 'add' AND number NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'F')")
def missing_files(spark, d):
    """The files of fulfilled orders are gone from the disk."""
    listing = _t(spark, d, "orders").where("o_orderstatus <> 'F'").select(F.col("o_orderkey").alias("number"))
    return manifest.missing_files(manifest.live_files(_edits(spark, d)), listing)


_LIMITS_SQL = "[" + ", ".join(f"{x!r}::DOUBLE" for x in histogram.LIMITS) + "]"
_BUCKETS = f"b AS (SELECT value, len(list_filter({_LIMITS_SQL}, lambda x: x <= value)) AS bucket FROM events WHERE value IS NOT NULL)"


@_register("histogram_buckets", f"WITH {_BUCKETS} SELECT CAST(bucket AS INTEGER) AS bucket, count(*) AS n FROM b GROUP BY bucket", base=False)
def histogram_buckets(spark, d):
    return histogram.buckets(_t(spark, d, "events"), "value")


@_register(
    "histogram_percentiles",
    f"""WITH {_BUCKETS}, h AS (SELECT bucket, count(*) AS n FROM b GROUP BY bucket),
    u AS (SELECT bucket, n, sum(n) OVER (ORDER BY bucket) AS upto, sum(n) OVER () AS total FROM h),
    k AS (SELECT u.*, p FROM u, (VALUES (1.0::DOUBLE), (50.0::DOUBLE), (90.0::DOUBLE), (99.0::DOUBLE)) t(p) WHERE upto >= total * p / 100 QUALIFY row_number() OVER (PARTITION BY p ORDER BY bucket) = 1)
    SELECT p, round(greatest(least(CASE WHEN bucket = 0 THEN 0 ELSE {_LIMITS_SQL}[bucket] END + ({_LIMITS_SQL}[bucket + 1] - CASE WHEN bucket = 0 THEN 0 ELSE {_LIMITS_SQL}[bucket] END) * (total * p / 100 - (upto - n)) / n,
      (SELECT max(value) FROM events)), (SELECT min(value) FROM events)), 6) AS value FROM k""",
    base=False,
)
def histogram_percentiles(spark, d):
    return histogram.percentiles(_t(spark, d, "events"), "value", [1, 50, 90, 99]).select("p", F.round("value", 6).alias("value"))


@_register("histogram_moments", "SELECT count(value) AS n, round(sum(value), 4) AS total, min(value) AS low, max(value) AS high, round(avg(value), 6) AS average, round(stddev_pop(value), 6) AS deviation FROM events", base=False)
def histogram_moments(spark, d):
    m = histogram.moments(_t(spark, d, "events"), "value")
    return m.select("n", F.round("total", 4).alias("total"), "low", "high", F.round("average", 6).alias("average"), F.round("deviation", 6).alias("deviation"))


@_register("custom_order_scan", "SELECT * FROM l ORDER BY reverse(key)")
def custom_order_scan(spark, d):
    return read.scan(mutations(spark, d), order=reverse_bytewise)


@_register("read_seq", "SELECT count(*) AS n, CAST(sum(strlen(key) + strlen(value)) AS BIGINT) AS n_bytes FROM l")
def read_seq(spark, d):
    live = read.visible(mutations(spark, d))
    return live.agg(F.count("*").alias("n"), F.sum(F.octet_length("key") + F.octet_length("value")).cast("long").alias("n_bytes"))


@_register("read_reverse", "SELECT * FROM v ORDER BY key DESC")
def read_reverse(spark, d):
    m = mutations(spark, d)
    return read.scan(m, snapshot=_half(m), reverse=True)


@_register("read_random", "SELECT count(*) AS asked, count(l.key) AS found FROM (SELECT printf('%016d', l_partkey) AS key FROM lineitem) a LEFT JOIN l USING (key)")
def read_random(spark, d):
    live = read.visible(mutations(spark, d)).select("key", F.lit(1).alias("hit"))
    asks = _t(spark, d, "lineitem").groupBy(padded(F.col("l_partkey")).alias("key")).agg(F.count("*").alias("n"))
    return asks.join(live, "key", "left").agg(F.sum("n").alias("asked"), F.coalesce(F.sum(F.when(F.col("hit") == 1, F.col("n"))), F.lit(0)).alias("found"))


@_register("read_missing", "SELECT count(*) AS asked, count(l.key) AS found FROM (SELECT DISTINCT key || '.' AS key FROM m) a LEFT JOIN l USING (key)")
def read_missing(spark, d):
    m = mutations(spark, d)
    got = read.multi_get(m, m.select(F.concat("key", F.lit(".")).alias("key")), keep_missing=True)
    return got.agg(F.count("*").alias("asked"), F.count("seq").alias("found"))


@_register("read_hot", "SELECT l.* FROM l WHERE key < printf('%016d', greatest(1, (SELECT max(user_id) FROM events) // 100 + 1))")
def read_hot(spark, d):
    top = _t(spark, d, "events").agg(F.max("user_id")).first()[0]
    return read.scan(mutations(spark, d), None, f"{max(1, top // 100 + 1):016d}")


@_register("seek_random", "SELECT count(*) AS asked, count(hit) AS found FROM (SELECT a.key, min(l.key) AS hit FROM (SELECT DISTINCT printf('%016d', l_partkey) AS key FROM lineitem) a LEFT JOIN l ON l.key >= a.key GROUP BY a.key)")
def seek_random(spark, d):
    asks = _t(spark, d, "lineitem").select(padded(F.col("l_partkey")).alias("key"))
    return read.seek_many(mutations(spark, d), asks).agg(F.count("*").alias("asked"), F.count("key").alias("found"))


@_register("delete_random", "SELECT l.* FROM l WHERE key NOT IN (SELECT DISTINCT key FROM p)")
def delete_random(spark, d):
    m = mutations(spark, d)
    last = read.last_sequence(m)
    drops = _probes(spark, d).distinct().select("key", F.lit(last + 1).alias("seq"), F.lit(0).alias("op"), F.lit(None).cast("string").alias("value"))
    return read.visible(m.unionByName(drops))


@_register("overwrite", "SELECT key, seq + (SELECT max(seq) FROM m) AS seq, upper(value) AS value FROM l")
def overwrite(spark, d):
    m = mutations(spark, d)
    last = read.last_sequence(m)
    again = read.visible(m).select("key", (F.col("seq") + last).alias("seq"), F.lit(1).alias("op"), F.upper("value").alias("value"))
    return read.visible(m.unionByName(again))


@_register("bloom_membership", "SELECT run_id, count(DISTINCT key) AS n_keys, count(DISTINCT key) AS n_found, true AS small_enough FROM r GROUP BY run_id")
def bloom_membership(spark, d):
    m = _runs(mutations(spark, d))
    filters = bloom.build(m, "run_id", "key")
    sizes = filters.select("run_id", F.length("filter").alias("n"), (F.col("n_keys") * 10 / 8 + 40).alias("most"))
    tried = bloom.probe(m.select("run_id", "key").distinct(), filters, "run_id", "key").join(sizes, "run_id")
    size = F.max(F.col("n") <= F.col("most"))
    return tried.groupBy("run_id").agg(F.count("*").alias("n_keys"), F.sum(F.col("hit").cast("long")).alias("n_found"), size.alias("small_enough"))


@_register("wal_roundtrip", "SELECT key, seq, op, value FROM m")
def wal_roundtrip(spark, d):
    """All mutations written as checksummed logs of batches, and decoded again."""
    def decode(batches):
        for batch in batches:
            for data in batch.column("content"):
                yield from wal.in_batches(wal.log_rows("", data.as_py()), wal.ARROW)

    rows = wal.replay(wal.as_logs(mutations(spark, d)).select("content").mapInArrow(decode, wal.SCHEMA))
    return rows.select(F.col("key").cast("string").alias("key"), "seq", F.col("op").cast("int").alias("op"), F.col("value").cast("string").alias("value"))


@_register("sstable_scan", "SELECT key, seq, op, value FROM m WHERE key >= '0000000000000003' AND key < '0000000000000012'")
def sstable_scan(spark, d):
    """All mutations written as sorted tables, and a key range of them read back by index blocks."""
    def decode(batches):
        for batch in batches:
            for data in batch.column("content"):
                rows = ({"file": "", "key": k, "seq": s, "op": o, "value": v} for k, s, o, v in sstable.table_rows(data.as_py(), True, b"0000000000000003", b"0000000000000012"))
                yield from wal.in_batches(rows, sstable.ARROW)

    rows = sstable.as_tables(mutations(spark, d)).select("content").mapInArrow(decode, sstable.SCHEMA)
    return rows.select(F.col("key").cast("string").alias("key"), "seq", F.col("op").cast("int").alias("op"), F.col("value").cast("string").alias("value"))


@_register("stream_latest", "SELECT key, seq, value FROM l")
def stream_latest(spark, d):
    schema = spark.read.parquet(f"{d}/events.parquet").schema
    e = ingest.stream_log(spark, d, schema, pattern="events.parquet")
    put = F.col("event_type") != "error"
    log = e.select(padded(F.col("user_id")).alias("key"), (F.col("event_id") + 1).alias("seq"), put.cast("int").alias("op"), F.when(put, F.col("props")).alias("value"))
    return ingest.run_to_memory(ingest.latest_stream(log), f"latest_{uuid4().hex}").where("op = 1").select("key", "seq", "value")


@_register("store_compacted_read", "SELECT * FROM l")
def store_compacted_read(spark, d):
    """Four runs written to a store, compacted, and scanned."""
    m = _runs(mutations(spark, d))
    store = Store.open(spark, shared_folder(spark, "store"), create_if_missing=True)
    for i in range(4):
        store.ingest(m.where(F.col("run_id") == i))
    store.compact()
    out = store.scan().select(F.col("key").cast("string").alias("key"), "seq", F.col("value").cast("string").alias("value"))
    store.close()
    return out

def _text(rows: DataFrame) -> DataFrame:
    return rows.select(F.col("key").cast("string").alias("key"), "seq", F.col("op").cast("int").alias("op"), F.col("value").cast("string").alias("value"))


@_register("wal_split_read", "SELECT key, seq, op, value FROM m")
def wal_split_read(spark, d):
    """Logs of all mutations read in splits of three blocks each: a split takes the records that begin in it."""
    split = 3 * wal.BLOCK

    def decode(batches):
        for batch in batches:
            for data in batch.column("content"):
                raw = data.as_py()
                for at in range(0, len(raw), split):
                    yield from wal.in_batches(wal.log_rows("", raw, True, at, at + split), wal.ARROW)

    return _text(wal.as_logs(mutations(spark, d), batch_rows=300, log_bytes_each=1 << 20).select("content").mapInArrow(decode, wal.SCHEMA).where("problem IS NULL"))


@_register("manifest_roundtrip", "SELECT level, number, file_size, smallest_key, largest_key FROM f WHERE level > 0")
def manifest_roundtrip(spark, d):
    """Edits that add all files and then delete those of level 0, written as manifest records and read back."""
    files = _manifest(spark, d).select("level", "number", "file_size", F.col("smallest_key").cast("binary").alias("lo"), F.col("largest_key").cast("binary").alias("hi"))

    def code(batches):
        for batch in batches:
            rows = batch.to_pylist()
            adds = [{"kind": "add", "level": r["level"], "number": r["number"], "file_size": r["file_size"], "smallest_key": r["lo"], "smallest_seq": 1, "largest_key": r["hi"], "largest_seq": 2} for r in rows]
            drops = [{"kind": "delete", "level": r["level"], "number": r["number"]} for r in rows if r["level"] == 0]
            records = [edits.edit_bytes([{"kind": "comparator", "name": "bytewise"}, *adds]), edits.edit_bytes([*drops, {"kind": "next_file", "number": 99}])]
            yield from wal.in_batches(edits.manifest_rows("", wal.log_bytes(records)), edits.ARROW)

    live = manifest.live_files(files.mapInArrow(code, edits.SCHEMA).drop("file", "problem", "name"))
    return live.select("level", "number", "file_size", F.col("smallest_key").cast("string").alias("smallest_key"), F.col("largest_key").cast("string").alias("largest_key"))


@_register(
    "file_names",
    """SELECT name, CASE k WHEN 0 THEN 'log' WHEN 1 THEN 'table' WHEN 2 THEN 'table' WHEN 3 THEN 'temp' WHEN 4 THEN 'manifest' END AS type, CASE WHEN k < 5 THEN o_orderkey END AS number
    FROM (SELECT o_orderkey, o_orderkey % 6 AS k, CASE o_orderkey % 6 WHEN 0 THEN printf('%06d.log', o_orderkey) WHEN 1 THEN printf('%06d.ldb', o_orderkey) WHEN 2 THEN printf('%06d.sst', o_orderkey)
    WHEN 3 THEN printf('%06d.dbtmp', o_orderkey) WHEN 4 THEN printf('MANIFEST-%06d', o_orderkey) ELSE printf('%06d.bak', o_orderkey) END AS name FROM orders)""",
    base=False,
)
def file_names(spark, d):
    """Names of all kinds are built for every order, and told apart again."""
    n, made = F.col("o_orderkey"), None
    for i, kind in enumerate(("log", "table", "old_table", "temp", "manifest")):
        made = (F if made is None else made).when(n % 6 == i, manifest.file_name(n, kind))
    listing = _t(spark, d, "orders").select(made.otherwise(F.format_string("%06d.bak", n)).alias("name"))
    return manifest.parse_names(listing).select("name", "type", "number")


@_register("ranges_with_files", "SELECT range_id, EXISTS (SELECT 1 FROM ox WHERE (lo IS NULL OR largest_key >= lo) AND (hi IS NULL OR smallest_key <= hi)) AS any_file FROM g")
def ranges_with_files(spark, d):
    """Whether any file meets each range."""
    ranges, met = _ranges(spark, d), fs.meeting_ranges(fs.run_metadata(_order_runs(order_log(spark, d))), _ranges(spark, d))
    return ranges.select("range_id").join(met.select("range_id").distinct().withColumn("met", F.lit(True)), "range_id", "left").select("range_id", F.coalesce("met", F.lit(False)).alias("any_file"))


@_register("output_cuts", "SELECT key, CAST(coalesce(sum(strlen(key) + strlen(value)) OVER (PARTITION BY run_id ORDER BY key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) // 4000 AS BIGINT) AS file_no FROM o")
def output_cuts(spark, d):
    """The output file of every order's row: each run is cut by running bytes."""
    rows = _order_runs(order_log(spark, d))
    return fs.output_cuts(rows, F.octet_length("key") + F.octet_length("value"), 4000, part="run_id").select("key", F.col("file_no").cast("long").alias("file_no"))


@_register("dump_lines", "SELECT chr(39) || key || chr(39) || ' @ ' || seq || ' : ' || CASE WHEN op = 1 THEN 'put => ' || chr(39) || value || chr(39) ELSE 'del' END AS line FROM m")
def dump_lines(spark, d):
    return dump.dump_mutations(mutations(spark, d))


def _store(spark, **more) -> Store:
    return Store.open(spark, shared_folder(spark, "store"), create_if_missing=True, **more)


@_register("read_while_writing", "SELECT * FROM v")
def read_while_writing(spark, d):
    """A snapshot taken at half the log, read after the rest was written and all of it compacted."""
    m = mutations(spark, d)
    half = _half(m)
    with _store(spark) as store:
        store.ingest(m.where(F.col("seq") <= half))
        pin = store.snapshot()
        store.ingest(m.where(F.col("seq") > half))
        store.compact()
        return store.scan(snapshot=pin).select(F.col("key").cast("string").alias("key"), "seq", F.col("value").cast("string").alias("value"))


@_register("store_incremental", "SELECT * FROM l")
def store_incremental(spark, d):
    """Four runs, put as deep as nothing is in their way, compacted level by level as scores ask for it, and vacuumed."""
    m = _runs(mutations(spark, d))
    with _store(spark, flush_to=2) as store:
        for i in range(4):
            store.ingest(m.where(F.col("run_id") == i))
            store.maintain()
        store.vacuum()
        return store.scan().select(F.col("key").cast("string").alias("key"), "seq", F.col("value").cast("string").alias("value"))


@_register(
    "store_custom_order",
    "SELECT user_id AS number, event_id + 1 AS seq, props AS value FROM (SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1) WHERE event_type <> 'error'",
    base=False,
)
def store_custom_order(spark, d):
    """Numbers in brackets, decimal and hexadecimal by turns, with deletions; compacted after each half."""
    e = _t(spark, d, "events")
    put, n = F.col("event_type") != "error", F.col("user_id")
    key = F.when(F.col("event_id") % 2 == 0, F.format_string("[%d]", n)).otherwise(F.format_string("[0x%x]", n))
    m = e.select(key.alias("key"), (F.col("event_id") + 1).alias("seq"), put.cast("int").alias("op"), F.when(put, F.col("props")).alias("value"))
    half = _half(m)
    with _store(spark, comparator="bracketed_number") as store:
        for part in (F.col("seq") <= half, F.col("seq") > half):
            store.ingest(m.where(part))
            store.compact()
        return store.scan().select(store.order(F.col("key")).alias("number"), "seq", F.col("value").cast("string").alias("value"))


@_register("store_level_entries", "SELECT 1 AS level, count(*) AS n_entries FROM l")
def store_level_entries(spark, d):
    """Entries by level after a whole compaction, from the manifest."""
    with _store(spark) as store:
        store.ingest(mutations(spark, d))
        store.compact()
        return store.files().groupBy("level").agg(F.sum("num_entries").alias("n_entries"))


@_register("fill_batch", "SELECT printf('%016d', event_id % 997) AS key, event_id + 1 AS seq, props AS value FROM events QUALIFY row_number() OVER (PARTITION BY event_id % 997 ORDER BY event_id DESC) = 1", base=False)
def fill_batch(spark, d):
    """Every event put, a thousand to a batch; what is live then."""
    e, n = _t(spark, d, "events"), F.col("event_id")
    ops = e.select(F.floor(n / 1000).alias("batch_id"), (n % 1000).alias("pos"), F.lit(1).alias("op"), padded(n % 997).alias("key"), F.col("props").alias("value"))
    return read.visible(mutate.batch_mutations(ops, 1))


@_register("fill_random", "SELECT key, seq, value FROM (SELECT printf('%016d', user_id) AS key, row_number() OVER (ORDER BY md5(CAST(event_id AS VARCHAR))) AS seq, props AS value FROM events) QUALIFY row_number() OVER (PARTITION BY key ORDER BY seq DESC) = 1", base=False)
def fill_random(spark, d):
    """Every event put in a random order; what is live then."""
    e = _t(spark, d, "events")
    ops = e.select(F.md5(F.col("event_id").cast("string")).alias("pos"), F.lit(1).alias("op"), padded(F.col("user_id")).alias("key"), F.col("props").alias("value"))
    return read.visible(mutate.batch_mutations(ops, 1, ("pos",)))


@_register("fill_large", "SELECT printf('%016d', CAST(s_suppkey AS BIGINT)) AS key, CAST(100000 AS BIGINT) AS n_bytes, md5(rpad(s_name, 100000, s_name)) AS digest FROM supplier", base=False)
def fill_large(spark, d):
    """Values of 100,000 bytes, one a supplier, written to a store and read back."""
    s = _t(spark, d, "supplier")
    big = F.rpad("s_name", 100_000, F.col("s_name"))
    with _store(spark) as store:
        store.ingest(s.select(padded(F.col("s_suppkey").cast("long")).alias("key"), (F.col("s_suppkey") + 1).alias("seq"), F.lit(1).alias("op"), big.alias("value")))
        return store.scan().select(F.col("key").cast("string").alias("key"), F.octet_length("value").cast("long").alias("n_bytes"), F.md5("value").alias("digest"))


@_register("delete_seq", "SELECT l.* FROM l WHERE key > (SELECT quantile_disc(key, 0.5) FROM l)")
def delete_seq(spark, d):
    """The lower half of the live keys deleted in key order."""
    m = mutations(spark, d)
    live = read.visible(m).select("key")
    middle = (live.count() + 1) // 2
    ranked = mutate.number_rows(live, ["key"], 1)
    drops = ranked.where(F.col("seq") <= middle).select("key", (F.col("seq") + read.last_sequence(m)).alias("seq"), F.lit(0).alias("op"), F.lit(None).cast("string").alias("value"))
    return read.visible(m.unionByName(drops))


@_register("read_random_small", "SELECT s.key, l.seq, l.value FROM (SELECT DISTINCT printf('%016d', CAST(s_suppkey AS BIGINT)) AS key FROM supplier) s LEFT JOIN l USING (key)")
def read_random_small(spark, d):
    """A small set of random gets, one a supplier."""
    asks = _t(spark, d, "supplier").select(padded(F.col("s_suppkey").cast("long")).alias("key"))
    return read.multi_get(mutations(spark, d), asks, keep_missing=True)


@_register("crc32c", None)
def checksums(spark, d):
    """The checksum of every event's properties."""

    @F.arrow_udf("long")
    def checksum(column: pa.Array) -> pa.Array:
        return pa.array([None if x is None else crc32c(x.encode()) for x in column.to_pylist()], pa.int64())

    return _t(spark, d, "events").select("event_id", checksum("props").alias("crc"))
