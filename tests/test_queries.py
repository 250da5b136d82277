"""Every query of the catalogue against its SQL in DuckDB, on the smallest tables."""

import datetime
import math
from pathlib import Path

import duckdb
import pytest

from tidemark.queries import QUERIES, SQL

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="no test data")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 5) + 0.0
    if isinstance(v, datetime.date):
        return v.isoformat()
    return float(v) if type(v).__name__ == "Decimal" else v


def table(rows):
    return sorted((tuple(plain(v) for v in r) for r in rows), key=lambda r: [(v is None, str(v)) for v in r])


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    got = table(df.select(*columns).collect())
    if name not in SQL:
        assert got
        return
    want = duck.sql(SQL[name])
    assert sorted(want.columns) == columns
    assert got == table(want.project(", ".join(f'"{c}"' for c in columns)).fetchall())


@pytest.mark.parametrize("hours", [3, 23, 24, 40])
def test_last_row_windows_on_odd_events(spark, tmp_path, hours):
    rows = [(i, datetime.datetime(2024, 1, 1) + datetime.timedelta(hours=i % hours), i % 7, ("click", "error", "view")[i % 3], None if i % 11 == 0 else i / 3, "{}") for i in range(7 * hours)]
    rows += [(10**6 + i, None, 1, "click", 5.0, "{}") for i in range(3)] + [(10**7 + i, datetime.datetime(2024, 1, 1 + i), 1, None, None, None) for i in range(2)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").write.parquet(f"{tmp_path}/events.parquet")
    c = duckdb.connect()
    c.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    got = QUERIES["last_row_windows"](spark, str(tmp_path)).select("total", "window_ts").collect()
    assert table(got) == table(c.sql(SQL["last_row_windows"]).project("total, window_ts").fetchall()) and bool(got) == (hours > 22)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
