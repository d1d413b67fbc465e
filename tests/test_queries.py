"""Every query that has SQL against that SQL, and the driver's entry points."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from wireloom.plans import catalogue, oracles

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return c


@pytest.mark.parametrize("name", list(catalogue.QUERIES))
def test_query(spark, con, sf_dir, name):
    q = con.execute(oracles.ORACLE_SQL[name])
    cols = [c[0] for c in q.description]
    want = sorted(q.fetchall(), key=repr)
    df = catalogue.QUERIES[name](spark, sf_dir)
    assert sorted(df.columns) == sorted(cols)
    got = sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)
    assert got[:20] == want[:20] and got == want
    assert got or name == "consistency_check"


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
