"""Every registered query of the event operators against its SQL in DuckDB."""

import datetime
import decimal
import math

import duckdb
import pytest

from eventlab.catalog import ORACLE_SQL, QUERIES
import eventlab.queries  # noqa: F401

TABLES = "region nation customer supplier part orders lineitem events".split()


def plain(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else str(int(v)) if v.is_integer() and abs(v) < 2**53 else f"{v:.7g}"
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat(" ")
    if isinstance(v, datetime.date):
        return v.isoformat() + " 00:00:00"
    if isinstance(v, bool) or v is None:
        return str(v)
    if isinstance(v, dict):
        return str(sorted((k, plain(x)) for k, x in v.items()))
    if isinstance(v, (list, tuple)):
        return str([plain(x) for x in v])
    return str(v)


@pytest.fixture(scope="module")
def db(sf_dir):
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, sf_dir, db):
    df = QUERIES[name](spark, sf_dir)
    cols = sorted(df.columns)
    got = sorted(tuple(plain(x) for x in r) for r in df.select(*cols).collect())
    if name not in ORACLE_SQL:
        assert got
        return
    rel = db.execute(ORACLE_SQL[name])
    names = [d[0] for d in rel.description]
    order = [names.index(c) for c in cols]
    assert sorted(names) == cols
    want = sorted(tuple(plain(r[i]) for i in order) for r in rel.fetchall())
    assert got == want
    assert got, "the query has no rows here"
