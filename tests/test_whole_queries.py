"""Searches with whole texts as queries, against their SQL."""

from collections import Counter

import duckdb
import pytest

from sluice.operators import search as T
from sluice.plans import catalog


@pytest.fixture(scope="module")
def db(sf_dir):
    out = duckdb.connect()
    for t in ("documents", "conversations"):
        out.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return out


def rows(df):
    return Counter(tuple(r) for r in df.collect())


def test_search_returns_the_documents_and_scores(spark, sf_dir, db):
    got = rows(catalog.QUERIES["t10_search_whole_queries"](spark, sf_dir))
    assert got and got == Counter(db.execute(catalog.SQL["t10_search_whole_queries"]).fetchall())


def test_queries_are_whole_up_to_the_limit_of_terms(spark, sf_dir, db):
    got = rows(catalog.QUERIES["t6_weigh_whole_query"](spark, sf_dir))
    assert got == Counter(db.execute(catalog.SQL["t6_weigh_whole_query"]).fetchall())
    assert max(Counter(r[0] for r in got).values()) == T.Scoring().most_terms


@pytest.mark.parametrize("name", ["u5_intersect_whole_queries", "t7_retrieve_whole_queries", "t8_score_whole_queries", "t5_tag_query_terms", "t10_search_boosted"])
def test_steps_of_the_search(spark, sf_dir, db, name):
    assert rows(catalog.QUERIES[name](spark, sf_dir)) == Counter(db.execute(catalog.SQL[name]).fetchall())


def test_terms_inherit_their_section(spark):
    rows = spark.createDataFrame([(1, "red carpet in redwood"), (2, None), (3, ""), (4, "  ")], "q int, t string")
    found = sorted((r.q, r.pos, r.term, r.attr) for r in T.tag_query(rows, "q", "t", {"red": 7, "redwood": 8}).collect())
    assert found == [(1, 0, "red", 7), (1, 1, "carpet", 0), (1, 2, "in", 0), (1, 3, "redwood", 8)]
