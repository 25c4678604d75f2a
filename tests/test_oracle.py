"""Every registered query against its DuckDB twin (row count, columns, values)."""

import math

import duckdb
import pytest

import __spark_entry__ as E
from vidmart.plans.driver import catalogue
from testkit import SF_SMALL

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()
QUERIES, ORACLE = catalogue.QUERIES, catalogue.ORACLE


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        return None if math.isnan(v) else round(v + 0.0, 6)
    if hasattr(v, "isoformat"):
        return v.isoformat(sep=" ") if hasattr(v, "hour") else v.isoformat()
    return v


def _canon(records, cols):
    return sorted((tuple(_norm(r[c]) for c in cols) for r in records), key=repr)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return c


def test_every_query_has_an_oracle_or_is_declared_rows_only():
    assert set(QUERIES) - set(ORACLE) == {"top_contributions", "train_report"}  # what fitted trees give
    assert set(QUERIES) <= set(E.queries()) and set(ORACLE) <= set(E.oracle_sql())


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_duckdb(spark, con, name):
    df = QUERIES[name](spark, SF_SMALL)
    got = [r.asDict() for r in df.collect()]
    cur = con.execute(ORACLE[name])
    cols = [d[0] for d in cur.description]
    want = [dict(zip(cols, r)) for r in cur.fetchall()]
    assert sorted(df.columns) == sorted(cols)
    assert len(got) == len(want)
    assert _canon(got, sorted(cols)) == _canon(want, sorted(cols))


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_rows_only_queries_run(spark, name):
    df = QUERIES[name](spark, SF_SMALL)
    assert df.count() > 0


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.columns == ["weekday", "n_positive", "n", "rate"]
    assert 0 < df.count() <= 7
