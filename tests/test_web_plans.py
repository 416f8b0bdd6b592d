"""Plans and files of the web queries: nothing is worked out again for a filter, a step writes few files."""

from sluice.operators import web as W


def repeated(df):
    """How often the pattern of a URL stands in the plan that runs."""
    return df._jdf.queryExecution().optimizedPlan().toString().count("^(?i)(https?)://(")


def test_links_are_resolved_once(spark):
    links = spark.createDataFrame([(1, "http://A.b/x/y", "../z"), (2, "http://a.b", "mailto:q"), (3, "https://a.b:8443/p/?q", "//C.d:443/./%41"), (4, "http://a.b/", "../up")], "i int, base string, href string")
    found = W.resolve_links(links)
    assert [(r.i, r.target) for r in found.orderBy("i").collect()] == [(1, "http://a.b/z"), (3, "https://c.d/A")]
    assert repeated(found) <= 12


def test_a_step_writes_a_file_a_bucket(spark):
    links = spark.createDataFrame([(f"s{i}", f"t{i}") for i in range(400)], "source string, target string")
    seeds = spark.createDataFrame([(f"s{i}",) for i in range(400)], "url string")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = W.expand_frontier(seeds, links, 1, buckets=8)
        assert {(r.url, r.depth) for r in out.collect()} == {(f"{x}{i}", d) for x, d in (("s", 0), ("t", 1)) for i in range(400)}
        assert len(out.inputFiles()) <= 16  # of two steps
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_a_filter_of_canonical_urls_repeats_little(spark):
    urls = spark.createDataFrame([("http://A.b/x//y/../%41?q#f",), ("ftp://a.b/",), (None,)], "url string")
    found = W.canonical_urls(urls, "url").where("canonical IS NOT NULL").select("canonical")
    assert [r.canonical for r in found.collect()] == ["http://a.b/x/A?q"]
    assert repeated(found) <= 12
