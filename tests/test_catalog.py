import __spark_entry__
from sluice.operators import cleaning as C
from sluice.operators import web as W
from sluice.plans import catalog


def test_registered_queries_have_sql_or_are_named():
    assert set(catalog.SQL) <= set(catalog.QUERIES)
    without = set(catalog.QUERIES) - set(catalog.SQL)
    assert not without
    assert set(catalog.QUERIES) <= set(__spark_entry__.queries())


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_url_cases(spark):
    cases = {
        "http://A.b/x//y": "http://a.b/x/y", "http://a.b/x/./y/": "http://a.b/x/y/", "http://a.b/x/../y": "http://a.b/y", "http://a.b/%41%20%2F": "http://a.b/A%20%2F",
        "http://a.b:80#f": "http://a.b/", "https://a.b:81/q?x=/../#z": "https://a.b:81/q?x=/../", "http://a.b/../x": None, "http://a.b/%4": None, "ftp://a.b/": None,
    }
    rows = spark.createDataFrame(list(cases.items()), "url string, want string")
    assert [(r.url, r.canonical) for r in W.canonical_urls(rows, "url").collect()] == list(cases.items())


def test_links_and_robots(spark):
    html = '<base href="http://h.c/d/e.html"><a class=x href="f.html"><!-- <a href="no"> --><a href=\'..\\g\'><frame src=/r><a href="mailto:x@y"><a href="s?q=1"><img src="i.png">'
    pages = spark.createDataFrame([(1, "http://p.q/", html)], "page_id int, url string, html string")
    assert [r.target for r in W.resolve_links(W.extract_links(pages)).orderBy("ordinal").collect()] == ["http://h.c/d/f.html", "http://h.c/g", "http://h.c/r"]
    text = "User-agent: *\nDisallow: /all\n\nUser-agent: me\nUser-agent: you\nDisallow: /a*b # x\nDisallow:\n"
    rules = W.robots_rules(spark.createDataFrame([("h.c", text)], "host string, text string"), "me")
    assert [r.pattern for r in rules.collect()] == ["/a*b"]
    urls = spark.createDataFrame([("http://h.c/axxb1",), ("http://h.c/all",), ("http://o.c/axxb",)], "url string")
    assert {r.url for r in W.apply_robots(urls, rules, "url").collect()} == {"http://h.c/all", "http://o.c/axxb"}


def test_required_values(spark):
    rows = spark.createDataFrame([(1, "/a/", "x"), (1, "/b/", "y"), (2, "/a/", "x"), (2, "/b/", None), (3, "/a/", ""), (4, "/b/", "y")], "id int, path string, value string")
    assert {r.id: r.code for r in C.check_required(rows, ["/a/"]).collect()} == {1: 0, 2: 1, 3: 2, 4: 0}
    assert {r.id: r.code for r in C.check_required(rows, ["/a/"], strict=True).collect()} == {1: 0, 2: 1, 3: 2, 4: 2}


def test_percentages(spark):
    rows = spark.createDataFrame([(1, "/p/", "10%"), (2, "/p/", "50%"), (3, "/p/", "99%"), (4, "/p/", "x%")], "id int, path string, value string")
    out = C.clean_values(rows, {"/p/": [("is_percent", "percent_to_score")]})
    assert [(r.cleaned, r.code) for r in out.orderBy("id").collect()] == [("1", 0), ("3", 0), ("5", 0), ("x%", 1)]


def test_frontier_over_page_links(spark, tmp_path):
    """Against a plain breadth-first walk; a link to another host starts over."""
    pages = {1: ("http://a.b/", "/x http://c.d/"), 2: ("http://a.b/x", "y"), 3: ("http://a.b/y", "/z ../../no"), 4: ("http://c.d/", "p/q"), 5: ("http://c.d/p/q", "/p/r http://a.b/x"), 6: ("http://e.f/lone", "lone"), 7: ("http://g.h/g", "/g")}
    rows = [(i, u, " ".join(f'<a href="{x}">' for x in links.split())) for i, (u, links) in pages.items()]
    spark.createDataFrame(rows, "page_id bigint, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    edges = {"http://a.b/": ["http://a.b/x", "http://c.d/"], "http://a.b/x": ["http://a.b/y"], "http://a.b/y": ["http://a.b/z"], "http://c.d/": ["http://c.d/p/q"], "http://c.d/p/q": ["http://c.d/p/r", "http://a.b/x"], "http://g.h/g": ["http://g.h/g"]}
    edges["http://e.f/lone"] = ["http://e.f/lone"]
    best = {u: 0 for u in ("http://a.b/", "http://e.f/lone", "http://g.h/g")}
    moved = True
    while moved:
        moved = False
        for u, d in list(best.items()):
            for v in edges.get(u, []) if d < 5 else []:
                new = d + 1 if u.split("/")[2] == v.split("/")[2] else 0
                if new < best.get(v, 99):
                    best[v], moved = new, True
    got = catalog.QUERIES["l8_expand_page_links"](spark, str(tmp_path)).collect()
    assert {r.url: r.depth for r in got} == best
