"""Web-corpus processing: canonical URLs, links, filters, robots rules, deduplication, frontier and crawl order."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sluice.operators.joins import small
from sluice.operators.ordering import row_numbers
from sluice.sources.scratch import Scratch

MAX_URL, MAX_HOST, MAX_PAGE = 512, 40, 100_000
_DROPPED = "\x00"


def _decoded(pieces: Column) -> Column:
    """A path in its pieces between % signs: printable %xx decoded, but %20 and %2F (and %25, whose sign would start
    another escape) kept; a bad escape makes null."""
    rest = F.slice(pieces, F.lit(2), F.greatest(F.size(pieces) - 1, F.lit(0)))
    code = lambda p: F.conv(F.substring(p, 1, 2), 16, 10).cast("int")
    fine = lambda p: F.substring(p, 1, 2).rlike("^[0-9A-Fa-f]{2}$")
    keep = lambda p: code(p).isin(0x20, 0x25, 0x2F) | (code(p) < 0x20) | (code(p) > 0x7E)
    one = lambda p: F.when(keep(p), F.concat(F.lit("%"), p)).otherwise(F.concat(F.char(code(p)), F.substring(p, F.lit(3), F.length(p))))
    return F.when(~F.exists(rest, lambda p: ~fine(p)), F.concat(F.element_at(pieces, 1), F.array_join(F.transform(rest, one), "")))


def _kept(parts: Column) -> Column:
    """The parts of a path between slashes, /./, // and /../ resolved; _DROPPED alone if it ever climbs above its root."""
    start = F.array().cast("array<string>")
    up = lambda a: F.when(F.size(a) == 0, F.array(F.lit(_DROPPED))).otherwise(F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(0))))
    return F.aggregate(parts, start, lambda a, p: F.when(p.isin("", ".") | F.array_contains(a, _DROPPED), a).when(p == "..", up(a)).otherwise(F.concat(a, F.array(p))))


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), where the value is worked out once, however often `then` uses it and whatever filter the result meets."""
    return F.element_at(F.transform(F.array(value), then), 1)


def _canonical(url: Column) -> Column:
    pattern = r"^(?i)(https?)://([^/?#:]+)(?::(\d+))?([^?#]*)(\?[^#]*)?"
    part = lambda c, i: F.regexp_extract(c, pattern, i)

    def head(u: Column) -> Column:
        default = F.when(u["scheme"] == "http", "80").otherwise("443")
        return F.concat(u["scheme"], F.lit("://"), u["host"], F.when((u["port"] != "") & (u["port"] != default), F.concat(F.lit(":"), u["port"])).otherwise(""))

    def folded(parts: Column) -> Column:
        last = F.element_at(parts, -1)
        join = lambda k: F.when(~F.array_contains(k, _DROPPED), F.concat(F.lit("/"), F.array_join(k, "/"), F.when((F.size(k) > 0) & last.isin("", ".", ".."), "/").otherwise("")))
        return _let(_kept(parts), join)

    def fold(path: Column) -> Column:
        """Most paths have neither empty parts nor such as begin with a point: they stay as they are."""
        slow = _let(F.split(path, "/"), lambda p: folded(F.slice(p, F.lit(2), F.size(p))))
        return F.when(path.startswith("/") & ~path.rlike(r"/[/.]"), path).when(path == "", "/").otherwise(slow)

    decode = lambda path: F.when(path.contains("%"), _let(F.split(path, "%"), _decoded)).otherwise(path)
    fields = lambda c: F.struct(F.lower(part(c, 1)).alias("scheme"), F.lower(part(c, 2)).alias("host"), part(c, 3).alias("port"), part(c, 4).alias("path"), part(c, 5).alias("query"))
    whole = lambda u: F.concat(head(u), _let(fold(u["path"]), decode), u["query"])
    return _let(url, lambda c: F.when(c.rlike(pattern), _let(fields(c), whole)))


def canonical_urls(df: DataFrame, column: str, name: str = "canonical") -> DataFrame:
    """http(s) URLs with a lower-case host, no default port, no fragment, a folded and decoded path, the query as it is;
    null for anything else. A port is kept if it is not 80 (443 for https)."""
    return df.withColumn(name, _canonical(F.col(column)))


def url_site(df: DataFrame, column: str, name: str = "site") -> DataFrame:
    return df.withColumn(name, F.lower(F.regexp_extract(column, r"^(?i)https?://([^/?#:]+)", 1)))


def extract_links(pages: DataFrame, images: bool = False, plain_only: bool = True) -> DataFrame:
    """page_id, url, base (of <base href>, else the page), ordinal and href of a, link and frame tags outside comments;
    backslashes become slashes, and addresses with ? = * are left out at the default level."""
    html = F.regexp_replace("html", "(?s)<!--.*?-->", "")
    tags = r"(?:a|link)\b[^>]*?\shref|frame\b[^>]*?\ssrc" + (r"|img\b[^>]*?\ssrc" if images else "")
    found = F.regexp_extract_all(F.col("_h"), F.lit(rf"""(?i)<(?:{tags})\s*=\s*["']?([^"'\s>]+)"""), 1)
    base = F.regexp_extract("_h", r"""(?i)<base\b[^>]*?\shref\s*=\s*["']?([^"'\s>]+)""", 1)
    rows = pages.select("page_id", "url", html.alias("_h"))
    rows = rows.select("page_id", "url", F.when(base != "", base).otherwise(F.col("url")).alias("base"), F.posexplode(found).alias("ordinal", "href"))
    rows = rows.withColumn("href", F.translate("href", "\\", "/"))
    return rows.where(~F.col("href").rlike(r"[?=*]")) if plain_only else rows


def resolve_links(links: DataFrame, href: str = "href", base: str = "base", name: str = "target") -> DataFrame:
    """Absolute, rooted and relative links as canonical URLs; links of other protocols are dropped."""
    def full(h: Column, b: Column) -> Column:
        origin = F.regexp_extract(b, r"^(?i)(https?://[^/?#]+)", 1)
        folder = F.regexp_extract(F.regexp_replace(b, "[?#].*$", ""), r"^(?i)https?://[^/]+(/.*/|/)?", 1)
        out = F.when(h.rlike(r"^(?i)https?://"), h).when(h.startswith("//"), F.concat(F.regexp_extract(b, r"^(?i)(https?:)", 1), h))
        out = out.when(h.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), F.lit(None)).when(h.startswith("/"), F.concat(origin, h))
        return out.otherwise(F.concat(origin, _let(folder, lambda f: F.when(f == "", "/").otherwise(f)), h))

    # Rows without a target go by explode(), not by a filter: Spark would write the whole expression into a filter below it.
    found = F.array_compact(F.array(_canonical(full(F.col(href), F.col(base)))))
    return links.withColumn(name, F.explode(found))


def filter_links(df: DataFrame, column: str, domains: list[str] | None, banned: list[str]) -> DataFrame:
    """Hosts that end in an allowed domain (any, where None); html, htm and folders pass, banned extensions do not."""
    path = F.lower(F.regexp_replace(column, r"[?#].*$", ""))
    host = F.lower(F.regexp_extract(column, r"^(?i)https?://([^/?#:]+)", 1))
    allowed = F.lit(True)
    if domains is not None:
        allowed = F.lit(False)
        for x in domains:
            allowed = allowed | host.endswith(x)
    ends = F.lit(False)
    for x in banned:
        ends = ends | path.endswith(x)
    return df.where(allowed & (path.rlike(r"(\.html?|/)$") | ~ends))


def valid_urls(df: DataFrame, column: str) -> DataFrame:
    rest = F.length(F.regexp_replace(column, r"^(?i)https?://", ""))
    host = F.length(F.regexp_extract(column, r"^(?i)https?://([^/?#:]+)", 1))
    return df.where((host < MAX_HOST) & (rest + 18 < MAX_URL))


def robots_rules(robots: DataFrame, agent: str, most: int = 100) -> DataFrame:
    """host, ordinal and pattern of the Disallow lines that concern the agent: a record that names it beats the record
    of *; a pattern that begins with * becomes /. A record is a run of User-agent lines and the lines below it."""
    lines = robots.select("host", F.posexplode(F.split("text", r"\r?\n")).alias("i", "line"))
    line = F.trim(F.regexp_replace("line", "#.*$", ""))
    lines = lines.select("host", "i", F.lower(F.trim(F.split_part(line, F.lit(":"), F.lit(1)))).alias("k"), F.trim(F.regexp_replace(line, "^[^:]*:", "")).alias("v")).where("k IN ('user-agent', 'disallow')")
    order = Window.partitionBy("host").orderBy("i")
    begins = (F.col("k") == "user-agent") & F.coalesce(F.lag("k").over(order) != "user-agent", F.lit(True))
    lines = lines.withColumn("record", F.sum(begins.cast("int")).over(order))
    named = F.when(F.col("k") == "user-agent", F.when(F.lower("v").contains(agent.lower()), 2).when(F.col("v") == "*", 1).otherwise(0))
    lines = lines.withColumn("rank", F.max(named).over(Window.partitionBy("host", "record")))
    lines = lines.withColumn("best", F.max("rank").over(Window.partitionBy("host"))).where("rank > 0 AND rank = best AND k = 'disallow' AND v <> ''")
    lines = lines.withColumn("ordinal", F.row_number().over(order)).where(F.col("ordinal") <= most)
    return lines.select("host", "ordinal", F.when(F.col("v").startswith("*"), "/").otherwise(F.col("v")).alias("pattern"))


def apply_robots(urls: DataFrame, rules: DataFrame, column: str) -> DataFrame:
    """URLs that no pattern of their host matches as a prefix, * standing for any run of characters."""
    quoted = F.array_join(F.transform(F.split("pattern", r"\*"), lambda p: F.concat(F.lit(r"\Q"), p, F.lit(r"\E"))), ".*")
    rules = small(rules.select(F.col("host").alias("_host"), F.concat(F.lit("^"), quoted).alias("_p")).distinct())
    host = F.lower(F.regexp_extract(column, r"^(?i)https?://([^/?#:]+)", 1))
    path = F.regexp_replace(column, r"^(?i)https?://[^/?#]+", "")
    return urls.join(rules, (host == F.col("_host")) & F.regexp_like(path, F.col("_p")), "left_anti")


def dedupe_urls(df: DataFrame, canonical: str, order: str) -> DataFrame:
    """The first row of each canonical URL, found by an aggregate, which no hot URL can slow down."""
    first = df.where(F.col(canonical).isNotNull()).groupBy(canonical).agg(F.min(order).alias(order))
    return df.join(first, [canonical, order], "left_semi")


def page_key(column: str) -> Column:
    """Of a page's text, the characters between A and z, both excluded, hashed: pages that agree there are the same."""
    return F.sha2(F.regexp_replace(column, "[^B-y]", ""), 256)


def dedupe_pages(df: DataFrame, column: str, order: str) -> DataFrame:
    """The first row of each page key. `order` identifies a row, so that a page's key is worked out once, and no row moves
    with its text but those that stay."""
    first = df.select(page_key(column).alias("page_key"), order).groupBy("page_key").agg(F.min(order).alias(order))
    return df.join(first, order, "inner").select(*df.columns, "page_key")


def cap_per_group(df: DataFrame, key: str, n: int, order: str, name: str = "deferred") -> DataFrame:
    """The first n rows of each key are taken, the others deferred; a hot key is numbered by many tasks."""
    out = row_numbers(df, [key], [order], "_rn", Scratch(df.sparkSession, "cap"))
    return out.withColumn(name, F.col("_rn") > n).drop("_rn")


def politeness_schedule(frontier: DataFrame, key: str, order: str, wait: int, start: int = 0) -> DataFrame:
    out = row_numbers(frontier, [key], [order], "_rn", Scratch(frontier.sparkSession, "polite"))
    return out.withColumn("fetch_at", (F.lit(start) + (F.col("_rn") - 1) * wait).cast("bigint")).drop("_rn")


def expand_frontier(seeds: DataFrame, links: DataFrame, depth: int, reset_on_new_site: bool = False, buckets: int = 64, reads: list | None = None) -> DataFrame:
    """(url, depth) of all that seeds reach over links (source, target) in `depth` steps, at their least depth. With
    reset_on_new_site a link to another host starts over, for as long as a better budget turns up.

    A step follows the links of the rows that the step before it found, and nothing else. What it finds is held against
    the visited URLs of the same hash buckets only: those are folders, of which a step opens the ones that its own rows
    fall into, so that late steps of few rows read little. reads: a list that gets the buckets that each step opened."""
    spark = seeds.sparkSession
    scratch = Scratch(spark, "frontier")
    seen, fields = f"{scratch.root}/seen", "url string, depth int, step int, bucket int"
    place = F.pmod(F.xxhash64("url"), F.lit(buckets)).cast("int").alias("bucket")

    def keep(rows: DataFrame, step: int) -> list[int]:
        """Stores a step's rows by bucket; the buckets, at most `buckets`."""
        rows.select("url", "depth", place).hint("rebalance", "bucket").write.partitionBy("bucket").parquet(f"{seen}/step={step}")
        return sorted(r.bucket for r in fresh(step, None).select("bucket").distinct().collect())

    def fresh(step: int, within: list[int] | None) -> DataFrame:
        rows = spark.read.schema(fields).parquet(seen).where(F.col("step") == step)
        return rows if within is None else rows.where(F.col("bucket").isin(within))

    touched, step = keep(seeds.select("url", F.lit(0).alias("depth")).distinct(), 0), 0
    while touched:
        found = fresh(step, touched).where(F.col("depth") < depth).join(links, F.col("url") == F.col("source"))
        new_depth = F.col("depth") + 1
        if reset_on_new_site:
            host = lambda c: F.regexp_extract(c, r"^https?://([^/?#:]+)", 1)
            new_depth = F.when(host("source") != host("target"), 0).otherwise(new_depth)
        found = found.select(F.col("target").alias("url"), new_depth.alias("depth")).groupBy("url").agg(F.min("depth").alias("depth"))
        found = scratch.save(found.withColumn("bucket", place), "found")
        opened = sorted(r.bucket for r in found.select("bucket").distinct().collect())
        had = spark.read.schema(fields).parquet(seen).where(F.col("bucket").isin(opened)).groupBy("url").agg(F.min("depth").alias("had"))
        step += 1
        touched = keep(found.join(had, "url", "left").where("had IS NULL OR depth < had"), step)
        scratch.drop(found)
        if reads is not None:
            reads.append(len(opened))
    return spark.read.schema(fields).parquet(seen).groupBy("url").agg(F.min("depth").alias("depth"))


def unlinked(seeds: DataFrame, links: DataFrame) -> DataFrame:
    """Seeds (url) that no link from another page has as its target."""
    return seeds.join(links.where("source <> target").select(F.col("target").alias("url")), "url", "left_anti")


def prioritise(frontier: DataFrame, privileged: list[str], url: str = "url", waiting: str = "waiting") -> DataFrame:
    """Privileged extensions first, then what already waits, then the rest; 0 is fetched first."""
    path = F.lower(F.regexp_replace(url, r"[?#].*$", ""))
    first = F.lit(False)
    for x in privileged:
        first = first | path.endswith(x)
    return frontier.withColumn("priority", F.when(first, 0).when(F.col(waiting), 1).otherwise(2))


def classify_fetches(headers: DataFrame) -> DataFrame:
    """Outcome of (status, content_type, length, duplicate) rows."""
    out = F.when(F.col("status").between(300, 399), "redirect").when(F.col("status").between(400, 499), "err40X").when(F.col("status") >= 500, "err50X")
    out = out.when(~F.lower("content_type").startswith("text/html"), "badType").when(F.col("length") > MAX_PAGE, "tooBig").when(F.col("duplicate"), "duplicate").otherwise("success")
    return headers.withColumn("outcome", out)


def crawl_report(pages: DataFrame, rules: DataFrame, domains: list[str] | None, banned: list[str], privileged: list[str]) -> DataFrame:
    """Of each site of a crawl (page_id, url, html): pages, canonical URLs, pages that differ, bytes and how sizes spread
    (bucket:pages, of 4 KB, the last open); what each fetch came to (success, tooBig, duplicate: a page seen under a
    smaller id); pages that robots forbid and privileged ones; links, those that pass the filters, and the URLs of the
    site that one step from the pages finds and that are no pages yet."""
    spark = pages.sparkSession
    scratch = Scratch(spark, "report")
    rows = canonical_urls(url_site(pages, "url"), "url").withColumn("key", page_key("html")).withColumn("length", F.octet_length("html"))
    rows = scratch.save(rows.select("page_id", "url", "site", "canonical", "key", "length"), "pages")
    first = rows.groupBy("key").agg(F.min("page_id").alias("page_id")).withColumn("_first", F.lit(True))
    allowed = apply_robots(rows.select("page_id", "url"), rules, "url").select("page_id", F.lit(True).alias("_allowed"))
    one = rows.join(first, ["key", "page_id"], "left").join(allowed, "page_id", "left")  # by key and id: a page that many repeat is spread
    fetched = one.withColumns({"duplicate": F.col("_first").isNull(), "status": F.lit(200), "content_type": F.lit("text/html")})
    fetched = prioritise(classify_fetches(fetched).withColumn("waiting", F.lit(False)), privileged)
    targets = scratch.save(resolve_links(extract_links(pages)).select("page_id", "base", "target"), "links")
    links = targets.groupBy("page_id").agg(F.count("*").alias("links"))
    kept = valid_urls(filter_links(targets, "target", domains, banned), "target").groupBy("page_id").agg(F.count("*").alias("kept"))
    came = lambda what: F.count_if(F.col("outcome") == what).alias(what)
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(f"{c}_links" if c == "kept" else c)
    out = fetched.join(links, "page_id", "left").join(kept, "page_id", "left").groupBy("site").agg(
        F.count("*").alias("pages"), F.countDistinct("canonical").alias("urls"), F.countDistinct("key").alias("distinct_pages"), F.sum("length").alias("bytes"),
        came("success"), came("tooBig"), came("duplicate"), F.count_if(F.col("_allowed").isNull()).alias("forbidden"), F.count_if(F.col("priority") == 0).alias("privileged"), zero("links"), zero("kept"),
    )
    bucket = F.least(F.floor(F.col("length") / F.lit(4096)), F.lit(24)).cast("int")
    spread = rows.groupBy("site", bucket.alias("bucket")).agg(F.count("*").alias("n")).groupBy("site").agg(F.array_sort(F.collect_list(F.struct("bucket", "n"))).alias("sizes"))  # 25 at most
    spread = spread.withColumn("sizes", F.array_join(F.transform("sizes", lambda x: F.concat(x["bucket"], F.lit(":"), x["n"])), ","))
    seeds = rows.where("canonical IS NOT NULL").select(F.col("canonical").alias("url"))
    hops = scratch.save(canonical_urls(targets.select("base", "target"), "base").select(F.col("canonical").alias("source"), "target").distinct(), "hops")
    fresh = url_site(expand_frontier(seeds, hops, 1).where("depth = 1"), "url").groupBy("site").agg(F.count("*").alias("fresh"))
    return out.join(spread, "site", "left").join(fresh, "site", "left").na.fill(0, ["fresh"])
