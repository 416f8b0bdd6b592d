"""Registered queries: web corpus."""

from __future__ import annotations

from pyspark.sql import functions as F

from sluice.operators import web as W
from sluice.plans.registry import Registry, table
from sluice.sources.scratch import Scratch

register = Registry()
QUERIES, SQL = register.queries, register.sql

_CANON = r"CASE WHEN regexp_matches(url, '^(https?)://([^/?#:]+)(?::(\d+))?([^?#]*)(\?[^#]*)?') THEN regexp_extract(url, '^(https?)', 1) || '://' || lower(regexp_extract(url, '^https?://([^/?#:]+)', 1)) || regexp_replace(regexp_replace(CASE WHEN regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1) = '' THEN '/' ELSE regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1) END, '//+', '/', 'g'), '/\./', '/', 'g') || regexp_extract(url, '(\?[^#]*)', 1) END"
_SITE = "lower(regexp_extract(url, '^https?://([^/?#:]+)', 1))"
_HREFS = r"""SELECT page_id, url, unnest(regexp_extract_all(h, '(?i)<(?:(?:a|link)\b[^>]*?\shref|frame\b[^>]*?\ssrc)\s*=\s*["'']?([^"''\s>]+)', 1)) AS href, unnest(range(len(regexp_extract_all(h, '(?i)<(?:(?:a|link)\b[^>]*?\shref|frame\b[^>]*?\ssrc)\s*=\s*["'']?([^"''\s>]+)', 1)))) AS ordinal
FROM (SELECT page_id, url, regexp_replace(html, '(?s)<!--.*?-->', '', 'g') AS h FROM pages)"""
_LINKS = f"SELECT page_id, ordinal::INTEGER AS ordinal, replace(href, chr(92), '/') AS href FROM ({_HREFS}) WHERE NOT regexp_matches(href, '[?=*]')"

_URL = r"(?i)^(https?)://([^/?#:]+)(?::(\d+))?([^?#]*)(\?[^#]*)?"
#: Canonical URLs step by step, with escapes, ports and parents.
_STEPS = rf"""u AS (SELECT page_id, lower(regexp_extract(url, '{_URL}', 1)) AS scheme, lower(regexp_extract(url, '{_URL}', 2)) AS host, regexp_extract(url, '{_URL}', 3) AS port, regexp_extract(url, '{_URL}', 4) AS path, regexp_extract(url, '{_URL}', 5) AS query FROM pages WHERE regexp_matches(url, '{_URL}')),
parts AS (SELECT *, string_split(CASE WHEN path = '' THEN '/' ELSE path END, '/')[2:] AS p FROM u),
kept AS (SELECT *, list_reduce(list_prepend('', p), lambda a, x: CASE WHEN a = '!' OR x IN ('', '.') THEN a WHEN x = '..' THEN CASE WHEN a = '' THEN '!' ELSE regexp_replace(a, '/[^/]*$', '') END ELSE a || '/' || x END) AS k FROM parts),
folded AS (SELECT *, string_split(CASE WHEN k = '' THEN '/' WHEN p[-1] IN ('', '.', '..') THEN k || '/' ELSE k END, '%') AS f FROM kept WHERE k <> '!'),
decoded AS (SELECT *, f[1] || coalesce(array_to_string(list_transform(f[2:], lambda x: CASE WHEN try_cast('0x' || x[1:2] AS INTEGER) IN (32, 37, 47) OR try_cast('0x' || x[1:2] AS INTEGER) < 32 OR try_cast('0x' || x[1:2] AS INTEGER) > 126 THEN '%' || x ELSE chr(try_cast('0x' || x[1:2] AS INTEGER)) || x[3:] END), ''), '') AS d
  FROM folded WHERE len(list_filter(f[2:], lambda x: NOT regexp_matches(x, '^[0-9A-Fa-f]{{2}}'))) = 0),
canonical AS (SELECT pages.page_id, scheme || '://' || host || CASE WHEN port <> '' AND port <> CASE scheme WHEN 'http' THEN '80' ELSE '443' END THEN ':' || port ELSE '' END || d || query AS canonical FROM pages LEFT JOIN decoded ON decoded.page_id = pages.page_id)"""
register("l1_canonical_urls", f"WITH {_STEPS} SELECT page_id, canonical FROM canonical")(
    lambda s, d: W.canonical_urls(table(s, d, "pages"), "url").select("page_id", "canonical"))
register("l2_extract_links", _LINKS)(lambda s, d: W.extract_links(table(s, d, "pages")).select("page_id", "ordinal", "href"))
_ORIGIN = "lower(regexp_extract(url, '^(https?://[^/?#:]+)', 1))"
_TARGETS = f"""SELECT page_id, ordinal, {_ORIGIN} || regexp_replace(regexp_replace(p, '//+', '/', 'g'), '/\\.(/|$)', '/', 'g') AS target FROM (SELECT l.page_id, ordinal, url, regexp_extract(CASE WHEN starts_with(href, '/') THEN href ELSE '/' || href END, '^([^?#]*)', 1) AS p FROM ({_LINKS}) l JOIN pages ON l.page_id = pages.page_id)
WHERE NOT regexp_matches(p, '%([^0-9A-Fa-f]|$|[0-9A-Fa-f]([^0-9A-Fa-f]|$))')"""
# The tables' links are all rooted and without escapes; other forms are compared in tests.
register("l3_resolve_links", _TARGETS)(lambda s, d: W.resolve_links(W.extract_links(table(s, d, "pages"))).select("page_id", "ordinal", "target"))
register("l4_filter_links", f"SELECT page_id, url FROM pages WHERE ({_SITE} LIKE '%.com' OR {_SITE} LIKE '%.net') AND NOT regexp_matches(lower(regexp_replace(url, '[?#].*$', '')), '(5|\\.gif)$')")(
    lambda s, d: W.filter_links(table(s, d, "pages").select("page_id", "url"), "url", [".com", ".net"], ["5", ".gif"]))
register("l5_valid_urls", f"SELECT page_id FROM pages WHERE length(regexp_extract(url, '^https?://([^/?#:]+)', 1)) < 40 AND length(regexp_replace(url, '^https?://', '')) + 18 < 512")(
    lambda s, d: W.valid_urls(table(s, d, "pages"), "url").select("page_id"))
_ROBOTS = "User-agent: *\nDisallow: /fr\n\nUser-agent: other\nDisallow: /\n"
_NAMED = "User-agent: sluice\nUser-agent: more\nDisallow: */x # all\nDisallow: \n\nUser-agent: *\nDisallow: /none\n"


def robots(s, d):
    site = W.url_site(table(s, d, "pages"), "url").select(F.col("site").alias("host")).distinct()
    return site.withColumn("text", F.when(F.length("host") % 3 == 0, _NAMED).otherwise(_ROBOTS))


_RULE = f"CASE WHEN length({_SITE}) % 3 = 0 THEN '/' ELSE '/fr' END"
register("l6_robots_rules", f"SELECT DISTINCT {_SITE} AS host, 1::INTEGER AS ordinal, {_RULE} AS pattern FROM pages")(lambda s, d: W.robots_rules(robots(s, d), "sluice"))
register("l7_apply_robots", f"SELECT page_id, url FROM pages WHERE NOT starts_with(regexp_replace(url, '^https?://[^/?#]+', ''), {_RULE})")(lambda s, d: W.apply_robots(table(s, d, "pages").select("page_id", "url"), W.robots_rules(robots(s, d), "sluice"), "url"))


def graph(s, d):
    """Pages as nodes that point to the next pages of their numbers, so that SQL can walk them too."""
    p = table(s, d, "pages").select("page_id")
    return p.select(F.concat(F.lit("http://h/"), "page_id").alias("source"), F.explode(F.array(F.expr("page_id * 2 + 1"), F.expr("page_id * 3 % 101"))).alias("t")).select("source", F.concat(F.lit("http://h/"), "t").alias("target"))


register("l8_expand_frontier", """WITH RECURSIVE e AS (SELECT page_id AS s, unnest([page_id * 2 + 1, page_id * 3 % 101]) AS t FROM pages),
r AS (SELECT page_id AS v, 0 AS depth FROM pages WHERE page_id % 50 = 7 UNION SELECT e.t, depth + 1 FROM r JOIN e ON e.s = r.v WHERE depth < 4)
SELECT 'http://h/' || v AS url, min(depth)::INTEGER AS depth FROM r GROUP BY v""")(
    lambda s, d: W.expand_frontier(table(s, d, "pages").where("page_id % 50 = 7").select(F.concat(F.lit("http://h/"), "page_id").alias("url")), graph(s, d), 4))
register("l9_prioritise", "SELECT page_id, CASE WHEN regexp_matches(lower(regexp_replace(url, '[?#].*$', '')), '(7|\\.pdf)$') THEN 0 WHEN page_id % 3 = 0 THEN 1 ELSE 2 END::INTEGER AS priority FROM pages")(
    lambda s, d: W.prioritise(table(s, d, "pages").withColumn("waiting", F.col("page_id") % 3 == 0), ["7", ".pdf"]).select("page_id", "priority"))
register("l10_classify_fetches", """SELECT page_id, CASE WHEN status BETWEEN 300 AND 399 THEN 'redirect' WHEN status BETWEEN 400 AND 499 THEN 'err40X' WHEN status >= 500 THEN 'err50X' WHEN kind = 'image/png' THEN 'badType' WHEN n > 100000 THEN 'tooBig' WHEN dup THEN 'duplicate' ELSE 'success' END AS outcome
FROM (SELECT page_id, 200 + (page_id % 5) * 100 AS status, CASE WHEN page_id % 11 = 0 THEN 'image/png' ELSE 'text/html' END AS kind, length(html) * 10 AS n, page_id % 13 = 0 AS dup FROM pages)""")(
    lambda s, d: W.classify_fetches(table(s, d, "pages").selectExpr("page_id", "200 + (page_id % 5) * 100 AS status", "CASE WHEN page_id % 11 = 0 THEN 'image/png' ELSE 'text/html' END AS content_type", "length(html) * 10 AS length", "page_id % 13 = 0 AS duplicate")).select("page_id", "outcome"))
register("l11_url_site", f"SELECT page_id, {_SITE} AS site FROM pages")(lambda s, d: W.url_site(table(s, d, "pages"), "url").select("page_id", "site"))
register("u6_dedupe_urls", f"WITH {_STEPS} SELECT min(page_id) AS page_id, canonical FROM canonical WHERE canonical IS NOT NULL GROUP BY canonical")(
    lambda s, d: W.dedupe_urls(W.canonical_urls(table(s, d, "pages"), "url").select("page_id", "canonical"), "canonical", "page_id"))
register("u7_dedupe_pages", "SELECT min(doc_id) AS doc_id FROM documents GROUP BY sha256(regexp_replace(text, '[^B-y]', '', 'g'))")(
    lambda s, d: W.dedupe_pages(table(s, d, "documents").select("doc_id", "text"), "text", "doc_id").select("doc_id"))
register("w2_cap_per_group", f"SELECT page_id, row_number() OVER (PARTITION BY {_SITE} ORDER BY page_id) > 2 AS deferred FROM pages")(
    lambda s, d: W.cap_per_group(W.url_site(table(s, d, "pages"), "url"), "site", 2, "page_id").select("page_id", "deferred"))
register("w3_politeness_schedule", f"SELECT page_id, ((row_number() OVER (PARTITION BY {_SITE} ORDER BY page_id) - 1) * 30)::BIGINT AS fetch_at FROM pages")(
    lambda s, d: W.politeness_schedule(W.url_site(table(s, d, "pages"), "url"), "site", "page_id", 30).select("page_id", "fetch_at"))


def page_links(s, d):
    return W.resolve_links(W.extract_links(table(s, d, "pages"))).select(F.col("base").alias("source"), F.col("target"))


_HOST_OF = "regexp_extract({}, '^https?://([^/?#:]+)', 1)"


@register("l8_expand_page_links", f"""WITH RECURSIVE {_STEPS}, t AS (SELECT DISTINCT canonical AS s, target AS t FROM ({_TARGETS}) JOIN canonical USING (page_id)),
r AS (SELECT canonical AS url, 0 AS depth FROM canonical WHERE canonical IS NOT NULL AND canonical NOT IN (SELECT t FROM t WHERE s <> t)
UNION SELECT t, CASE WHEN {_HOST_OF.format('s')} <> {_HOST_OF.format('t')} THEN 0 ELSE depth + 1 END FROM r JOIN t ON s = url WHERE depth < 5)
SELECT url, min(depth)::INTEGER AS depth FROM r GROUP BY url""")
def l8_pages(s, d):
    """What the pages reach over their own links, from the pages that no other page links to, five steps deep."""
    links = W.canonical_urls(page_links(s, d), "source").select(F.col("canonical").alias("source"), "target").distinct()
    links = Scratch(s, "links").save(links, "links")  # every step reads them
    seeds = W.canonical_urls(table(s, d, "pages"), "url").select(F.col("canonical").alias("url")).where("url IS NOT NULL")
    return W.expand_frontier(W.unlinked(seeds, links), links, 5, reset_on_new_site=True)


_TARGET_SITE, _TARGET_PATH = "regexp_extract(target, '^https?://([^/?#:]+)', 1)", "lower(target)"
_KEPT = f"({_TARGET_SITE} LIKE '%.com' OR {_TARGET_SITE} LIKE '%.net') AND (regexp_matches({_TARGET_PATH}, '(\\.html?|/)$') OR NOT regexp_matches({_TARGET_PATH}, '(5|\\.gif)$')) AND length({_TARGET_SITE}) < 40 AND length(regexp_replace(target, '^https?://', '')) + 18 < 512"
register("b4_crawl_corpus_report", f"""WITH p AS (SELECT page_id, {_SITE} AS site, {_CANON} AS canonical, sha256(regexp_replace(html, '[^B-y]', '', 'g')) AS key, octet_length(encode(html)) AS n,
  starts_with(regexp_replace(url, '^https?://[^/?#]+', ''), {_RULE}) AS forbidden, regexp_matches(lower(regexp_replace(url, '[?#].*$', '')), '(7|\\.pdf)$') AS first FROM pages),
t AS (SELECT * FROM ({_TARGETS})), k AS (SELECT page_id, count(*) AS links, count(*) FILTER ({_KEPT}) AS kept FROM t GROUP BY page_id),
o AS (SELECT p.*, links, kept, CASE WHEN n > 100000 THEN 'tooBig' WHEN page_id > min(page_id) OVER (PARTITION BY key) THEN 'duplicate' ELSE 'success' END AS outcome FROM p LEFT JOIN k USING (page_id)),
z AS (SELECT site, string_agg(b || ':' || c, ',' ORDER BY b) AS sizes FROM (SELECT site, least(n // 4096, 24)::INTEGER AS b, count(*) AS c FROM p GROUP BY 1, 2) GROUP BY site),
f AS (SELECT {_TARGET_SITE} AS site, count(DISTINCT target)::BIGINT AS fresh FROM t WHERE target NOT IN (SELECT canonical FROM p WHERE canonical IS NOT NULL) GROUP BY 1)
SELECT o.site, count(*)::BIGINT AS pages, count(DISTINCT canonical)::BIGINT AS urls, count(DISTINCT key)::BIGINT AS distinct_pages, sum(n)::BIGINT AS bytes, count(*) FILTER (outcome = 'success')::BIGINT AS success, count(*) FILTER (outcome = 'tooBig')::BIGINT AS tooBig,
count(*) FILTER (outcome = 'duplicate')::BIGINT AS duplicate, count(*) FILTER (forbidden)::BIGINT AS forbidden, count(*) FILTER (first)::BIGINT AS privileged, coalesce(sum(links), 0)::BIGINT AS links, coalesce(sum(kept), 0)::BIGINT AS kept_links, any_value(sizes) AS sizes, coalesce(any_value(fresh), 0)::BIGINT AS fresh
FROM o LEFT JOIN z ON z.site = o.site LEFT JOIN f ON f.site = o.site GROUP BY o.site""")(
    lambda s, d: W.crawl_report(table(s, d, "pages"), W.robots_rules(robots(s, d), "sluice"), [".com", ".net"], ["5", ".gif"], ["7", ".pdf"]))
