"""All matches of all queries, over many blocks and passes, against joins; nothing but the postings is shuffled."""

import pytest
from pyspark.sql import functions as F

from sluice.operators import search as T
from sluice.operators import topk as K
from sluice.plans import catalog


@pytest.fixture
def case(spark, monkeypatch):
    """Blocks of some documents and blobs that a pass takes one of; a term twice in a query, and terms that no text has."""
    monkeypatch.setattr(K, "BLOCK", 8)
    monkeypatch.setattr(K, "SENT", 1)
    words = [f"w{i}" for i in range(9)]
    docs = [(f"d{i}", " ".join(w for j, w in enumerate(words) if (i * 7 + j * j) % (j + 2) == 0) + f"\nonly{i}", "en") for i in range(60)]
    postings = T.build_index(spark.createDataFrame(docs, "id string, text string, lang string"), "id", "text", "lang").cache()
    rows = [(q, p, words[(q * p + q) % 9] if p < 4 else "none", (0, 1, 2, 3, 10)[(q + p) % 5] if q % 3 == 0 else 0, 0.5 + p, 20) for q in range(24) for p in range(5)]
    rows += [(99, 0, "absent", 1, 1.0, 9), (99, 1, "w0", 0, 1.0, 9), (98, 0, "w1", 0, 1.0, 9), (98, 1, "w1", 0, 1.0, 9)]
    terms = spark.createDataFrame(rows, "query_id int, pos int, term string, attr int, idf double, query_bytes int").repartition(3)
    return T.weigh_query(terms).cache(), postings


def rows(df, *columns):
    return sorted(map(str, map(tuple, df.select(*columns).collect())))


def test_all_matches_are_those_of_joins(case):
    hits = T.retrieve(*case, "id")
    assert len(K._send(T._blocked(*case, "id", T.Scoring())[0])) > 1
    assert rows(T.find_documents(*case, "id"), "query_id", "id") == rows(T.intersect_terms(*case, "id"), "query_id", "id") != []
    assert rows(T.score_documents(*case, "id"), "query_id", "id", "score") == rows(T.score(hits, "id"), "query_id", "id", "score")
    columns = "query_id", "id", "term", "pos", "w_main", "w_title", "w_kw"
    assert rows(T.list_hits(*case, "id"), *columns) == rows(hits, *columns)
    assert rows(T.explain_documents(*case, "id"), "query_id", "id", "why") == rows(T.explain_scores(hits, "id"), "query_id", "id", "why")


def test_pages_over_passes(case, spark):
    terms = case[0].select("query_id", "pos", "term", "attr", "idf", "query_bytes")
    scored = T.rank_results(T.score(T.retrieve(*case, "id"), "id"), "id", 0, 3, "score")
    got = T.search(terms, case[1], "id", size=3)
    assert rows(got, "query_id", "id", F.col("weight"), "rank", "total") == rows(scored, "query_id", "id", F.col("score"), "rank", "total")


def test_queries_without_a_chance_are_left_out(case):
    """99 lacks a mandatory term; what the others find stays as it is."""
    known = case[1].select("term").distinct()
    sent = {r.query_id: {t.term for t in r.terms} for r in T._blocked(case[0], case[1], "id", T.Scoring(), known=known)[0].collect()}
    assert 99 not in sent and 98 in sent and all("none" not in x for x in sent.values())
    terms = case[0].select("query_id", "pos", "term", "attr", "idf", "query_bytes")
    found = [rows(T.search(terms, case[1], "id", size=3, known=k), "query_id", "id", "weight", "rank", "total") for k in (None, known)]
    assert found[0] == found[1]


@pytest.mark.parametrize("name", ["u5_intersect_terms", "t7_retrieve", "t8_score", "t11_explain_scores"])
def test_matches_are_not_shuffled(spark, sf_dir, name):
    plan = catalog.QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "Exchange" not in plan.split("MapInArrow")[0]
