import duckdb
import pytest

from kvlake.queries import ORACLES, QUERIES
from tests.conftest import SF


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in "nation customer supplier orders lineitem events".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def shaped(rows, names):
    text = lambda v: "" if v is None else f"{float(v):.6f}" if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(names), sorted(tuple(text(r[i]) for i in order) for r in rows)


def test_checksums(spark):
    rows = QUERIES["crc32c"](spark, SF).collect()
    assert len(rows) == spark.read.parquet(f"{SF}/events.parquet").count() and all(0 <= r["crc"] < 2**32 for r in rows)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_its_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    want = duck.sql(ORACLES[name])
    assert shaped([tuple(r) for r in df.collect()], df.columns) == shaped(want.fetchall(), want.columns)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0 and set(ORACLES) <= set(entry.oracle_sql()) and set(QUERIES) <= set(entry.queries())
