"""Every registered query against its SQL."""

import datetime
import decimal
import math

import duckdb
import pytest

from sluice.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


def plain(x):
    if isinstance(x, (float, decimal.Decimal)):
        return "nan" if math.isnan(x) else f"{float(x):.9g}"
    if isinstance(x, datetime.datetime):
        return str(x.replace(tzinfo=None))
    if isinstance(x, (list, tuple)):
        return [plain(y) for y in x]
    return x if x is None else str(x)


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_gives_what_its_sql_gives(spark, con, sf_dir, name):
    found = catalog.QUERIES[name](spark, sf_dir)
    asked = con.execute(catalog.SQL[name])
    names = [c[0] for c in asked.description]
    assert sorted(names) == sorted(found.columns)
    expected = sorted(repr([plain(x) for x in r]) for r in asked.fetchall())
    got = sorted(repr([plain(r[c]) for c in names]) for r in found.collect())
    assert got == expected
