"""Every registered query outside the training-data subpackage against its SQL."""

import datetime
import math

import duckdb
import pytest

from sluice.plans import claims, gates, models, rates, scores

QUERIES = {**rates.QUERIES, **gates.QUERIES, **claims.QUERIES, **scores.QUERIES, **models.QUERIES}
ORACLES = {**rates.ORACLES, **gates.ORACLES, **claims.ORACLES, **scores.ORACLES, **models.ORACLES}
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return v.isoformat() if isinstance(v, datetime.datetime) else v


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf_dir, con, name):
    df = QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=str)
    assert got
    if name not in ORACLES:
        return
    result = con.execute(ORACLES[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    want = sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in result.fetchall()), key=str)
    assert got == want


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(ORACLES) <= set(entry.oracle_sql()) <= set(entry.queries())
