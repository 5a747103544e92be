"""Logs, tables and manifests as text, one line a row."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from kvlake.functions.coding import escape_column


def dump_mutations(rows: DataFrame) -> DataFrame:
    """(line) such as 'foo' @ 3 : put => 'bar'."""
    kind = F.when(F.col("op") == 1, "put").otherwise("del")
    value = F.when(F.col("op") == 1, F.concat(F.lit(" => '"), escape_column(F.col("value").cast("binary")), F.lit("'"))).otherwise("")
    return rows.select(F.concat(F.lit("'"), escape_column(F.col("key").cast("binary")), F.lit("' @ "), F.col("seq").cast("string"), F.lit(" : "), kind, value).alias("line"))


def dump_edits(rows: DataFrame) -> DataFrame:
    span = F.concat(F.lit(" '"), escape_column("smallest_key"), F.lit("' .. '"), escape_column("largest_key"), F.lit("'"))
    return rows.select(F.concat_ws(" ", F.concat(F.lit("edit "), F.col("edit_id").cast("string"), F.lit(":")), "kind", "name", F.concat(F.lit("level "), F.col("level").cast("string")), F.col("number").cast("string"), F.when(F.col("kind") == "add", F.concat(F.col("file_size").cast("string"), F.lit(" bytes"), span)), "problem").alias("line"))
