"""Every registered query against its oracle on the smallest tables."""

import math
import os

import duckdb
import pandas as pd
import pytest

from tidemark.plans import registry

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="the tables are not here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return con


def plain(v):
    if v is None or v is pd.NaT or v is pd.NA or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, pd.Timestamp):
        return str(v.to_pydatetime().replace(tzinfo=None))
    if isinstance(v, bool):
        return v
    return round(float(v), 5) + 0.0 if isinstance(v, (int, float)) or hasattr(v, "dtype") and v.dtype.kind in "if" else v


def rows(pdf):
    names = sorted(pdf.columns)
    return names, sorted((tuple(map(plain, r)) for r in pdf[names].astype(object).itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_oracle(spark, duck, name):
    got, expected = rows(registry.queries()[name](spark, DIR).toPandas()), rows(duck.execute(registry.oracle_sql()[name]).df())
    assert got == expected


#: The queries that give rows where no bar breaks out of its channel, so that there are no trades.
WITHOUT_TRADES = ["bootstrap_ci", "report_sections", "report_verdict", "shuffle_dd"]


@pytest.mark.parametrize("name", WITHOUT_TRADES)
def test_query_equals_oracle_without_trades(spark, tmp_path, name):
    con = duckdb.connect()
    con.execute(f"COPY (SELECT * FROM '{DIR}/events.parquet' WHERE ts < TIMESTAMP '2024-01-01 18:00') TO '{tmp_path}/events.parquet'")  # a channel looks 20 bars back
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    got, expected = rows(registry.queries()[name](spark, str(tmp_path)).toPandas()), rows(con.execute(registry.oracle_sql()[name]).df())
    assert got == expected and len(got[1]) > 0


def test_verdict_equals_oracle_with_one_instrument(spark, tmp_path):
    con = duckdb.connect()
    con.execute(f"COPY (SELECT * REPLACE ('view' AS event_type) FROM '{DIR}/events.parquet') TO '{tmp_path}/events.parquet'")
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    got, expected = rows(registry.queries()["report_verdict"](spark, str(tmp_path)).toPandas()), rows(con.execute(registry.oracle_sql()["report_verdict"]).df())
    assert got == expected and dict(zip(got[0], got[1][0], strict=True))["n_instruments"] == 1


@pytest.mark.parametrize("name", sorted({*registry.queries()} - {*registry.oracle_sql()}))
def test_query_without_oracle_runs(spark, name):
    assert registry.queries()[name](spark, DIR).count() > 0
