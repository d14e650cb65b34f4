"""Every query with an SQL equivalent gives the same rows as DuckDB; the others run."""

import math

import duckdb
import pytest

from ledgerline import plans

from ..conftest import SMALL

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value:.9g}"
    return str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted(tuple(plain(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(plans.ORACLE_SQL))
def test_matches_sql(spark, duck, name):
    df = plans.QUERIES[name](spark, SMALL)
    got = rows_of(df.columns, df.collect())
    cur = duck.execute(plans.ORACLE_SQL[name])
    columns = [c[0] for c in cur.description]
    wanted = rows_of(columns, cur.fetchall())
    assert got[0] == wanted[0]
    assert len(got[1]) == len(wanted[1])
    assert got[1] == wanted[1]


@pytest.mark.parametrize("name", sorted(plans.QUERIES.keys() - plans.ORACLE_SQL.keys()))
def test_runs(spark, name):
    assert plans.QUERIES[name](spark, SMALL).count() > 0
