"""Every query of the catalog: against DuckDB where there is SQL, else that it gives rows."""

import duckdb
import pytest

from tidewave.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con


def plain(rows, names):
    """Rows as sorted strings, columns in order of name."""
    order = sorted(range(len(names)), key=names.__getitem__)
    number = lambda v: repr(float(v)) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)
    return sorted(tuple(number(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_against_sql(spark, sf, duck, name):
    found = catalog.QUERIES[name](spark, sf)
    expected = duck.execute(catalog.ORACLES[name])
    names = [c[0] for c in expected.description]
    assert sorted(found.columns) == sorted(names)
    assert plain(map(tuple, found.collect()), found.columns) == plain(expected.fetchall(), names)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_gives_rows(spark, sf, name):
    assert catalog.QUERIES[name](spark, sf).count() > 0
