"""Registered queries over all rows of their tables."""

import os
from collections import Counter

import duckdb

from sluice.plans import catalog


def rows(df):
    return Counter(tuple(r) for r in df.collect())


def by_sql(name, sf_dir, *tables):
    db = duckdb.connect()
    for t in tables:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet{'/*.parquet' if os.path.isdir(f'{sf_dir}/{t}.parquet') else ''}'")
    return Counter(db.execute(catalog.SQL[name]).fetchall())


def test_urls_with_escapes_ports_and_parents(spark, tmp_path):
    pages = {
        1: ("http://A.b/%41%20c", "http://a.b/A%20c"), 2: ("http://a.b/x/../y", "http://a.b/y"), 3: ("http://a.b:80/y#f", "http://a.b/y"), 4: ("https://a.b:8443/y", "https://a.b:8443/y"),
        5: ("http://a.b/%4", None), 6: ("http://a.b/../x", None), 7: ("http://a.b/y", "http://a.b/y"), 8: ("http://a.b/q?u=http://c:90/../%41", "http://a.b/q?u=http://c:90/../%41"),
        9: ("http://a.b/a/b/../../c/./", "http://a.b/c/"), 10: ("mailto:x", None), 11: ("http://a.b/../../../../x", None), 12: ("HTTPS://a.b:443", "https://a.b/"), 13: ("http://a.b/a%2fb%25%7E%zz", None), 14: ("http://a.b/a%2fb%25%7E/..", "http://a.b/"),
        15: ("http://a.b/a%2fb%25%7E%e9", "http://a.b/a%2fb%25~%e9"),
    }
    spark.createDataFrame([(i, u, "") for i, (u, _) in pages.items()], "page_id bigint, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    assert {r.page_id: r.canonical for r in catalog.QUERIES["l1_canonical_urls"](spark, str(tmp_path)).collect()} == {i: c for i, (_, c) in pages.items()}
    for name in ("l1_canonical_urls", "u6_dedupe_urls"):
        assert rows(catalog.QUERIES[name](spark, str(tmp_path)).select("page_id", "canonical")) == by_sql(name, str(tmp_path), "pages")
    least = {}
    for i, (_, c) in pages.items():
        if c:  # what is no URL has no first page
            least.setdefault(c, i)
    assert {r.canonical: r.page_id for r in catalog.QUERIES["u6_dedupe_urls"](spark, str(tmp_path)).collect()} == least


def test_merged_lists_hold_every_document(spark, sf_dir):
    merged = catalog.QUERIES["u4_merge_all_indexes"](spark, sf_dir)
    every = catalog.QUERIES["a12_build_postings"](spark, sf_dir)
    assert rows(merged.select("term", "doc_id")) == rows(every.select("term", "doc_id"))
    assert rows(merged) == by_sql("u4_merge_all_indexes", sf_dir, "documents")
    assert rows(catalog.QUERIES["u3_merge_all_postings"](spark, sf_dir)) == by_sql("u3_merge_all_postings", sf_dir, "documents")


def test_urls_of_the_tables_are_as_their_sql_says(spark, sf_dir):
    for name in ("l1_canonical_urls", "u6_dedupe_urls"):
        assert rows(catalog.QUERIES[name](spark, sf_dir).select("page_id", "canonical")) == by_sql(name, sf_dir, "pages")
