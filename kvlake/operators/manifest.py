"""The manifest: version edits replayed into the live files, and what follows from them.

An edit row: edit_id, kind ('add', 'delete' or a counter's name), level, number, and for added files
the rest of their metadata, for counters the number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def live_files(edits: DataFrame) -> DataFrame:
    """Files whose last add or delete by edit order is an add (in one edit deletes come first)."""
    moves = edits.where(F.col("kind").isin("add", "delete"))
    data = [c for c in edits.columns if c not in ("level", "number", "edit_id", "kind")]
    rank = F.struct("edit_id", (F.col("kind") == "add").alias("a"))
    last = moves.groupBy("level", "number").agg(F.max_by(F.struct("kind", "edit_id", *data), rank).alias("m"))
    return last.where("m.kind = 'add'").select("level", "number", *[f"m.{c}" for c in data])


def counters(edits: DataFrame) -> DataFrame:
    """(kind, number): the last value of each counter."""
    other = edits.where(~F.col("kind").isin("add", "delete"))
    return other.groupBy("kind").agg(F.max_by("number", "edit_id").alias("number"))


def obsolete_files(listing: DataFrame, live: DataFrame) -> DataFrame:
    """Files on disk that no version needs."""
    return listing.join(live.select("number").distinct(), "number", "left_anti")


def missing_files(live: DataFrame, listing: DataFrame) -> DataFrame:
    """Files that the manifest needs and the disk lacks."""
    return live.join(listing.select("number").distinct(), "number", "left_anti")


_NAMES = {"log": "%06d.log", "table": "%06d.ldb", "old_table": "%06d.sst", "temp": "%06d.dbtmp", "manifest": "MANIFEST-%06d"}
_FIXED = {"current": "CURRENT", "lock": "LOCK", "info_log": "LOG", "old_info_log": "LOG.old"}


def file_name(number: Column | int | None, kind: str) -> Column:
    """Name of a file of some kind; current, lock and log files have none of their own number."""
    return F.lit(_FIXED[kind]) if kind in _FIXED else F.format_string(_NAMES[kind], F.lit(number) if isinstance(number, int) else number)


def parse_names(listing: DataFrame, name: str = "name") -> DataFrame:
    """``listing`` with the type and number of each recognised file name, nulls for others. Numbers over
    64 bits are not recognised."""
    n = F.col(name)
    digits = F.coalesce(F.nullif(F.regexp_extract(n, r"^([0-9]+)\.(?:log|ldb|sst|dbtmp)$", 1), F.lit("")), F.nullif(F.regexp_extract(n, r"^MANIFEST-([0-9]+)$", 1), F.lit("")))
    number = F.try_to_number(digits, F.lit("9" * 38))
    suffix = F.regexp_extract(n, r"^[0-9]+\.(log|ldb|sst|dbtmp)$", 1)
    kind = (
        F.when(n == "CURRENT", "current").when(n == "LOCK", "lock").when(n.isin("LOG", "LOG.old"), "info_log").when(n.rlike("^MANIFEST-[0-9]+$"), "manifest")
        .when(suffix == "log", "log").when(suffix.isin("ldb", "sst"), "table").when(suffix == "dbtmp", "temp")
    )
    fits = F.coalesce(number <= F.lit((1 << 63) - 1), n.isin("CURRENT", "LOCK", "LOG", "LOG.old"))
    return listing.withColumn("type", F.when(fits, kind)).withColumn("number", F.when(fits & kind.isNotNull(), F.coalesce(number.cast("long"), F.lit(0))))
