"""Every query with SQL gives the rows that DuckDB gives for it."""

import math

import duckdb
import pytest

from lodestrata.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)) or str(value) == "NaT":
        return None
    if hasattr(value, "isoformat"):
        return value.isoformat()[:10] if not hasattr(value, "hour") or (value.hour, value.minute, value.second) == (0, 0, 0) else value.isoformat()
    if isinstance(value, float):
        return float(f"{value:.9g}")
    return value


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_matches_sql(spark, duck, sf_dir, name):
    df = catalog.QUERIES[name](spark, sf_dir)
    got = df.collect()
    rel = duck.execute(catalog.ORACLES[name])
    names = [c[0] for c in rel.description]
    want = rel.fetchall()
    assert sorted(df.columns) == sorted(names)
    assert rows(df.columns, got) == rows(names, want)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_runs_and_repeats(spark, sf_dir, name):
    first = rows(df.columns, df.collect()) if (df := catalog.QUERIES[name](spark, sf_dir)) else []
    again = catalog.QUERIES[name](spark, sf_dir)
    assert first and first == rows(again.columns, again.collect())
