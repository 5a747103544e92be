"""Runs: ordered merge, union and concatenation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F


def union_runs(*runs: DataFrame) -> DataFrame:
    """All mutations of some runs; column order may differ. No run gives an error, one is passed through."""
    if not runs:
        raise ValueError("no runs")
    return reduce(lambda a, b: a.unionByName(b), runs)


def merge_runs(*runs: DataFrame) -> DataFrame:
    """The k-way merge: all mutations by key, newest first. Replayed copies of a mutation count once."""
    return union_runs(*runs).dropDuplicates(["key", "seq"]).orderBy(F.asc("key"), F.desc("seq"))


def last_of_runs(*runs: DataFrame) -> int:
    """The largest sequence number over all runs, 0 if they are empty."""
    return union_runs(*runs).agg(F.max("seq")).first()[0] or 0
