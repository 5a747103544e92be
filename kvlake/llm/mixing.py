"""Mixing sources to target weights by temperature, in DataFrame operations only.

Each source's share p of all tokens is raised to an exponent a in [0, 1] and normalised: w = p^a / Z.
a = 1 keeps the natural mix, a = 0 makes all sources equal. The smallest a is bisected at which the
entropy of w is at most ``target_entropy`` (in nats) and no source is repeated more than
``max_repetition`` times; both fall as a grows. Without a ``budget`` of tokens the total is the least at
which no source loses a row (the source with the lowest w / p gets exactly its own tokens). With it,
a source whose allotment is below its tokens keeps only a part.

The allotment of a source is spent in epochs: whole passes, then one partial pass. A source is cut
into about sqrt(rows) blocks by hash of the id; every epoch permutes the blocks and the rows in a
block by keyed hashes. The partial pass takes blocks in its permutation while they fit, and of the
one block that does not fit, rows while they fit.

Scale: sources are summed with map-side combination; the bisection is an expression on one row of
shares (its size is the number of sources, never that of the documents); block sums are as small as
their number. Rows meet these two tables, which are written first, in equi-joins; a table is broadcast only
if it has at most ``BROADCAST_ROWS`` rows of a few numbers by count; running sums are taken over the tables of
blocks and inside one block per source, never over a source. Texts are not shuffled but for the
blocks that do not fit.

Defined results: a null text has no tokens, and rows without tokens go with every pass that reaches
them; sources without tokens keep one pass; a null source is a source of its own; ties in hash order are
broken by id and tokens; repeated rows share a block and are counted as often as they come; an
empty table gives an empty result; other columns are carried along.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, Window as W

from kvlake.llm.common import checkpoint, fresh, table

MAX_REPETITION, SEED, STEPS, BROADCAST_ROWS = 1.25, 17, 50, 500_000
_WORD = r"[^ \t\n\x0B\f\r]+"


def tokens_of(text: Column) -> Column:
    """Words of a text: runs without ASCII white space."""
    return F.coalesce(F.regexp_count(text, F.lit(_WORD)), F.lit(0)).cast("long")


def _key(*parts) -> Column:
    return F.md5(F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("-")) if isinstance(p, Column) else F.lit(str(p)) for p in parts]))


def source_totals(docs: DataFrame, source: str, text: str) -> DataFrame:
    return docs.groupBy(F.col(source).alias("src")).agg(F.sum(tokens_of(F.col(text))).alias("tokens"), F.count("*").alias("n_rows"))


def _sums(logs: Column, a: Column) -> Column:
    """Z = sum p^a and Y = sum p^a ln p over the array of log shares."""
    return F.aggregate(logs, F.struct(F.lit(0.0).alias("z"), F.lit(0.0).alias("y")), lambda acc, x: F.struct((acc["z"] + F.exp(a * x)).alias("z"), (acc["y"] + x * F.exp(a * x)).alias("y")))


def weights(totals: DataFrame, target_entropy: float | None = None, max_repetition: float | None = MAX_REPETITION, budget: int | None = None) -> DataFrame:
    """Per source of ``totals`` (src, tokens, n_rows): exponent, weight, allotted tokens, whole passes
    and the tokens of the partial pass."""
    one = totals.where("tokens > 0").agg(F.sort_array(F.collect_list(F.col("tokens").cast("double"))).alias("t"), F.sum("tokens").cast("double").alias("total"))
    one = one.select("total", F.transform("t", lambda x: F.log(x / F.col("total"))).alias("logs")).where(F.size("logs") > 0)
    low, high = F.element_at("logs", 1), F.element_at("logs", -1)

    def meets(a: Column) -> Column:
        s, good = _sums(F.col("logs"), a), F.lit(True)
        if target_entropy is not None:
            good = good & ((F.log(s["z"]) - a * s["y"] / s["z"]) <= target_entropy)
        if max_repetition is not None:
            rep = F.exp((F.lit(1.0) - a) * (high - low)) if budget is None else F.lit(float(budget)) / F.col("total") * F.exp((a - 1) * low) / s["z"]
            good = good & (rep <= max_repetition)
        return good

    def halve(acc: Column, _: Column) -> Column:
        mid = (acc["lo"] + acc["hi"]) / 2
        return F.when(meets(mid), F.struct(acc["lo"].alias("lo"), mid.alias("hi"))).otherwise(F.struct(mid.alias("lo"), acc["hi"].alias("hi")))

    start = F.struct(F.lit(0.0).alias("lo"), F.lit(1.0).alias("hi"))
    a = F.when(meets(F.lit(0.0)), F.lit(0.0)).otherwise(F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), start, halve)["hi"])
    found = one.select("total", "logs", a.alias("exponent"))
    z = _sums(F.col("logs"), F.col("exponent"))["z"]
    spend = F.lit(float(budget)) if budget is not None else F.col("total") * z * F.exp((1 - F.col("exponent")) * high)
    found = found.select("total", "exponent", z.alias("z"), spend.alias("spend"))
    # one row, so a scalar subquery rather than a join
    joined = totals.withColumn("_f", found.select(F.struct("total", "exponent", "z", "spend")).scalar()).select(*totals.columns, "_f.total", "_f.exponent", "_f.z", "_f.spend")
    weight = F.when(F.col("tokens") > 0, F.exp(F.col("exponent") * F.log(F.col("tokens") / F.col("total"))) / F.col("z")).otherwise(0.0)
    out = joined.withColumn("weight", weight).withColumn("allotted", F.round(F.col("weight") * F.col("spend")).cast("long"))
    if budget is None:
        out = out.withColumn("allotted", F.greatest("allotted", "tokens"))
    passes = F.when(F.col("tokens") > 0, F.floor(F.col("allotted") / F.col("tokens"))).otherwise(1).cast("int")
    out = out.withColumn("passes", passes).withColumn("rest", F.when(F.col("tokens") > 0, F.col("allotted") - F.col("passes") * F.col("tokens")).otherwise(0))
    return out.select("src", "tokens", "n_rows", "exponent", "weight", "allotted", "passes", "rest")


def _block_number(doc_id: Column, n_rows: Column, seed: int) -> Column:
    blocks = F.greatest(F.lit(1), F.ceil(F.sqrt(n_rows.cast("double")))).cast("long")
    return F.pmod(F.conv(F.substring(_key(seed, doc_id), 1, 8), 16, 10).cast("long"), blocks)


def _small(df: DataFrame) -> DataFrame:
    """``df`` marked for broadcast if its count allows it."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def mix(docs: DataFrame, target_entropy: float | None = None, max_repetition: float | None = MAX_REPETITION, budget: int | None = None, seed: int = SEED, source: str = "source", id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` repeated or cut to the target weights, with three more columns: epoch (from 1), and the
    keys block_order and row_order; sorted by all three, a source streams in its permuted order."""
    plan = checkpoint(weights(checkpoint(source_totals(docs, source, text)), target_entropy, max_repetition, budget))
    c = {k: fresh(docs, k) for k in ("epoch", "block_order", "row_order", "mix_src", "mix_passes", "mix_rest", "mix_block", "mix_before", "mix_size", "mix_tokens", "mix_state", "mix_rows", "mix_run")}
    plan = plan.select(F.col("src").alias(c["mix_src"]), F.col("n_rows").alias(c["mix_rows"]), F.col("passes").alias(c["mix_passes"]), F.col("rest").alias(c["mix_rest"]))
    rows = docs.join(_small(plan), docs[source].eqNullSafe(plan[c["mix_src"]]))
    rows = rows.withColumn(c["mix_block"], _block_number(F.col(id_col), F.col(c["mix_rows"]), seed))
    last = F.col(c["mix_passes"]) + 1
    blocks = rows.groupBy(c["mix_src"], c["mix_passes"], c["mix_rest"], c["mix_block"]).agg(F.sum(tokens_of(F.col(text))).alias(c["mix_size"]))
    order = W.partitionBy(c["mix_src"]).orderBy(_key(seed, last, F.col(c["mix_block"])), c["mix_block"])
    blocks = blocks.withColumn(c["mix_before"], F.sum(c["mix_size"]).over(order.rowsBetween(W.unboundedPreceding, 0)) - F.col(c["mix_size"]))
    end = F.col(c["mix_before"]) + F.col(c["mix_size"])
    # 1: the block fits, 2: it fits in part, 0: it does not
    state = F.when(F.col(c["mix_rest"]) <= 0, 0).when(end <= F.col(c["mix_rest"]), 1).when(F.col(c["mix_before"]) < F.col(c["mix_rest"]), 2).otherwise(0)
    blocks = blocks.select(F.col(c["mix_src"]).alias("_s"), F.col(c["mix_block"]).alias("_b"), c["mix_before"], state.alias(c["mix_state"]))
    blocks = checkpoint(blocks)
    rows = rows.join(_small(blocks), rows[c["mix_src"]].eqNullSafe(blocks["_s"]) & (rows[c["mix_block"]] == blocks["_b"])).drop("_s", "_b")
    passes, part = F.col(c["mix_passes"]), F.col(c["mix_state"])
    whole = rows.where((passes > 0) | (part == 1)).withColumn(c["epoch"], F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), passes + (part == 1).cast("int")))))
    inside = W.partitionBy(c["mix_src"], c["mix_block"]).orderBy(_key(seed, last, F.col(id_col), "row"), id_col, c["mix_tokens"])
    split = rows.where(part == 2).withColumn(c["mix_tokens"], tokens_of(F.col(text))).withColumn(c["mix_run"], F.sum(c["mix_tokens"]).over(inside.rowsBetween(W.unboundedPreceding, 0)))
    split = split.where(F.col(c["mix_run"]) + F.col(c["mix_before"]) <= F.col(c["mix_rest"])).withColumn(c["epoch"], last)
    keys = [_key(seed, F.col(c["epoch"]), F.col(c["mix_block"])).alias(c["block_order"]), _key(seed, F.col(c["epoch"]), F.col(id_col), "row").alias(c["row_order"])]
    kept = [*docs.columns, c["epoch"], *keys]
    return whole.select(*kept).unionByName(split.select(*kept))


def query(spark, sf_dir: str) -> DataFrame:
    """op7: every row of the mix with its source, tokens, epoch and place in the permutation."""
    mixed = mix(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return mixed.select("doc_id", "source", tokens_of(F.col("text")).alias("n_tokens"), "epoch", "block_order", "row_order")


ORACLE = rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^ \t\n\x0B\f\r]+')) AS BIGINT) AS n_tokens FROM documents),
t AS (SELECT source, CAST(sum(n_tokens) AS BIGINT) AS tokens, count(*) AS n_rows FROM d GROUP BY source),
g AS (SELECT sum(tokens)::DOUBLE AS total FROM t),
l AS (SELECT min(ln(tokens / total)) AS lo_log, max(ln(tokens / total)) AS hi_log FROM t, g WHERE tokens > 0),
b(i, lo, hi) AS (
  SELECT 0, 0.0::DOUBLE, 1.0::DOUBLE
  UNION ALL
  SELECT i + 1,
    CASE WHEN exp((1 - (lo + hi) / 2) * (hi_log - lo_log)) <= {MAX_REPETITION} THEN lo ELSE (lo + hi) / 2 END,
    CASE WHEN exp((1 - (lo + hi) / 2) * (hi_log - lo_log)) <= {MAX_REPETITION} THEN (lo + hi) / 2 ELSE hi END
  FROM b, l WHERE i < {STEPS}),
a AS (SELECT CASE WHEN exp(hi_log - lo_log) <= {MAX_REPETITION} THEN 0.0 ELSE hi END AS alpha FROM b, l WHERE i = {STEPS}),
z AS (SELECT sum(exp(alpha * ln(tokens / total))) AS z FROM t, g, a WHERE tokens > 0),
w AS (
  SELECT source, tokens, n_rows,
    CASE WHEN tokens > 0 THEN greatest(tokens, CAST(round(exp(alpha * ln(tokens / total)) / z * (total * z * exp((1 - alpha) * hi_log))) AS BIGINT)) ELSE 0 END AS allotted
  FROM t, g, a, z, l),
p AS (
  SELECT *, CASE WHEN tokens > 0 THEN allotted // tokens ELSE 1 END AS passes,
    CASE WHEN tokens > 0 THEN allotted - (allotted // tokens) * tokens ELSE 0 END AS rest FROM w),
k AS (
  SELECT d.*, passes, rest,
    ('0x' || substr(md5('{SEED}:' || coalesce(doc_id::VARCHAR, '-')), 1, 8))::BIGINT % greatest(1, CAST(ceil(sqrt(n_rows)) AS BIGINT)) AS block
  FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source),
s AS (
  SELECT *, sum(n_tokens) OVER (PARTITION BY source ORDER BY md5('{SEED}:' || (passes + 1) || ':' || block), block, md5('{SEED}:' || (passes + 1) || ':' || coalesce(doc_id::VARCHAR, '-') || ':row'), doc_id, n_tokens ROWS UNBOUNDED PRECEDING) AS run FROM k),
e AS (
  SELECT doc_id, source, n_tokens, block, unnest(range(1, passes + 1)) AS epoch FROM s
  UNION ALL
  SELECT doc_id, source, n_tokens, block, passes + 1 FROM s WHERE rest > 0 AND run <= rest)
SELECT doc_id, source, n_tokens, CAST(epoch AS INTEGER) AS epoch, md5('{SEED}:' || epoch || ':' || block) AS block_order,
  md5('{SEED}:' || epoch || ':' || coalesce(doc_id::VARCHAR, '-') || ':row') AS row_order FROM e
"""
