"""Search on small tables against plain Python, and what spans make up."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sluice.operators import matching as M
from sluice.operators import search as T

DOCS = [(1, "red shoe\nred leather shoe for men", "Shoe"), (2, "blue shoe\nblue", None), (3, None, "red"), (4, "", "x"), (5, "men\nred red red", "men"), (6, "green coat", "coat")]
QUERY = [(10, 0, "red", 1), (10, 1, "shoe", 0), (10, 2, "red", 1), (11, 0, "shoe", 0), (11, 1, "men", 10), (12, 0, "absent", 2), (12, 1, "red", 0), (13, 0, "nowhere", 0)]


@pytest.fixture(scope="module")
def index(spark):
    return T.build_index(spark.createDataFrame(DOCS, "doc_id int, text string, brand string"), "doc_id", "text", "brand")


def plain_index():
    out = {}
    steps = lambda x: math.floor(min(max(x, 0.0), 1.0) * 255) / 255
    for d, text, brand in DOCS:
        line = (text or "").split("\n")[0]
        for w in set((text or "").lower().split()):
            main = steps(len(w) / len(line)) if w in line.lower().split() else 0.0
            out[w, d] = [main, steps(len(w) / len(text)), 0.0]
        out.setdefault((brand and brand.lower(), d), [0.0, 0.0, 0.0])[2] = 1.0
    return out


def test_index(index):
    assert {(r.term, r.doc_id): [r.w_main, r.w_title, r.w_kw] for r in index.collect()} == plain_index()


def terms(spark):
    rows = [(q, p, t, a, 1.5, 20) for q, p, t, a in QUERY]
    return T.weigh_query(spark.createDataFrame(rows, "query_id int, pos int, term string, attr int, idf double, query_bytes int"))


def test_retrieval(spark, index):
    found = {}
    for q in {x[0] for x in QUERY}:
        must = {t for i, _, t, a in QUERY if i == q and a in (1, 2)}
        own = {t for i, _, t, _ in QUERY if i == q}
        for d in {d for _, d in plain_index()}:
            has = {t for t, i in plain_index() if i == d}
            if own & has and must <= has:
                found[q, d] = sorted(t for i, _, t, _ in QUERY if i == q and t in has)
    assert {(r.query_id, r.doc_id) for r in T.intersect_terms(terms(spark), index, "doc_id").collect()} == set(found)
    got = {}
    for r in T.retrieve(terms(spark), index, "doc_id").collect():
        got.setdefault((r.query_id, r.doc_id), []).append(r.term)
    assert {k: sorted(v) for k, v in got.items()} == found
    assert {q for q, _ in found} == {10, 11}


def test_scores_and_pages(spark, index):
    hits = T.retrieve(terms(spark), index, "doc_id")
    scores = {(r.query_id, r.doc_id): r.score for r in T.score(hits, "doc_id").collect()}
    raw = spark.createDataFrame([(q, p, t, a, 1.5, 20) for q, p, t, a in QUERY], "query_id int, pos int, term string, attr int, idf double, query_bytes int")
    for page, size in ((0, 2), (1, 2), (0, 10)):
        want = []
        for q in (10, 11):
            order = sorted((-s, d) for (i, d), s in scores.items() if i == q)
            want += [(q, d, -s, i + 1, len(order)) for i, (s, d) in enumerate(order)][page * size : (page + 1) * size]
        got = T.search(raw, index, "doc_id", page, size).select("query_id", "doc_id", "weight", "rank", "total").collect()
        assert sorted(map(tuple, got)) == sorted(want)
    why = T.explain_scores(hits, "doc_id").where("query_id = 10 AND doc_id = 5").first().why
    assert len(why.split("\n")) == 2 and why.startswith("red: query ")


def test_top_keywords_and_words(spark):
    docs = spark.createDataFrame([(1, "a", "x x y the"), (2, "a", "x z"), (3, "b", "z")], "doc_id int, g string, text string")
    idf = T.corpus_idf(T.distinct_terms(docs, "doc_id", "text"), "doc_id", 3, distinct=True)
    assert {r.term: r.df for r in idf.collect()} == {r.term: r.df for r in T.corpus_idf(T.tokenise_table(docs, "doc_id", "text"), "doc_id", 3).collect()} == {"x": 2, "y": 1, "z": 2, "the": 1}
    top = T.top_keywords(T.tokenise_table(docs, "g", "text"), idf, "g", 2, 0.2, ("the",)).collect()
    assert {(r.g, r.term, r.times) for r in top} == {("a", "x", 3), ("a", "y", 1), ("b", "z", 1)}


@pytest.mark.parametrize("words", [{"ab": 1, "abc": 2, "b": 3, "c.d": 4, "é": 5, "🙂x": 6}, {"aa": 1, "a": 2}, {"(": 1, "\n": 2}])
def test_spans_make_up_the_text(spark, words):
    rng = np.random.default_rng(3)
    texts = ["".join(rng.choice(list("abcd.é🙂x(\n "), int(n))) for n in rng.integers(0, 30, 80)] + [None, "", "abcabcab", "no"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    joined = {}
    for i, n, section, attr in sorted(map(tuple, M.tag_spans(df, "id", "t", words).collect())):
        assert attr == words.get(section, 0)
        joined[i] = joined.get(i, "") + section
    assert all(joined.get(i, "") == (t or "") for i, t in enumerate(texts))


def test_tables_have_a_bound(spark, monkeypatch):
    queries = spark.createDataFrame([(1, None), (2, "xx")], "query_id int, query string")
    assert M.match_templates(queries, [(1, "x[W:0-3]", "a")], {}, []).select("query_id").collect()[0][0] == 2
    monkeypatch.setattr(M, "TABLE_CHARS", 9)
    with pytest.raises(ValueError, match="characters"):
        M.match_templates(queries, [(i, "x", "a") for i in range(10)], {}, [])
    assert T.has_word(spark.createDataFrame([(1, "a1"), (2, "b")], "k int, term string"), "k", "[0-9]").where(F.col("has_word")).count() == 1


def test_index_of_repeated_keys(spark):
    """Rows that share a key are one document: of each term the largest weights count, whichever row has them."""
    rows = [(1, "red\nblue sky", "Red"), (1, "a long line with blue\nred", None), (2, "red", "red"), (3, None, None)]
    docs = spark.createDataFrame(rows, "doc_id int, text string, brand string")
    one = T.build_index(docs.where("doc_id <> 1").unionByName(docs.where("brand = 'Red'")), "doc_id", "text", "brand")
    two = T.build_index(docs.where("doc_id = 1 AND brand IS NULL"), "doc_id", "text", "brand")
    expected = {}
    for r in one.collect() + two.collect():
        old = expected.get((r.term, r.doc_id), [0.0] * 3)
        expected[r.term, r.doc_id] = [max(x) for x in zip(old, (r.w_main, r.w_title, r.w_kw))]
    got = T.build_index(docs, "doc_id", "text", "brand").collect()
    assert {(r.term, r.doc_id): [r.w_main, r.w_title, r.w_kw] for r in got} == expected and len(got) == len(expected)
