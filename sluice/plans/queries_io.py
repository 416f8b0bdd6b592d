"""Registered queries: sources and sinks, read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from sluice.operators.web import url_site
from sluice.plans.registry import Registry, table
from sluice.sources import tables as T
from sluice.sources.scratch import Scratch

register = Registry()
QUERIES, SQL = register.queries, register.sql


def place(s, name):
    return f"{Scratch(s, 'io').root}/{name}"


register("s1_scan_table", "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey > 500")(lambda s, d: T.scan_table(s, f"{d}/orders.parquet", "o_orderkey", 500, ["o_orderkey", "o_custkey"]))


@register("s3_read_delimited", "SELECT p_partkey, p_name || chr(9) || '\"x\"' AS p_name, p_size FROM part")
def s3(s, d):
    df = table(s, d, "part").select("p_partkey", F.concat("p_name", F.lit('\t"x"')).alias("p_name"), "p_size")
    T.write_delimited(df, p := place(s, "tsv"))
    return T.read_delimited(s, p, "p_partkey bigint, p_name string, p_size int")


@register("s5_write_json_docs", "SELECT doc_id, text, lang FROM documents")
def s5(s, d):
    T.write_json_docs(table(s, d, "documents").select("doc_id", "text", "lang"), p := place(s, "json"))
    return s.read.schema("doc_id bigint, text string, lang string").json(p)


@register("s6_write_csv", "SELECT c_custkey, c_name, c_acctbal FROM customer")
def s6(s, d):
    T.write_csv(table(s, d, "customer").select("c_custkey", "c_name", "c_acctbal"), p := place(s, "csv"))
    return s.read.schema("c_custkey bigint, c_name string, c_acctbal double").csv(p, header=True)


register("s7_upsert", """SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'new' ELSE 'old' END AS state, CASE WHEN o_orderkey % 3 = 0 THEN 2 ELSE 1 END::INTEGER AS v FROM orders""")(
    lambda s, d: T.upsert(table(s, d, "orders").selectExpr("o_orderkey", "'old' AS state", "1 AS v"), table(s, d, "orders").where("o_orderkey % 3 = 0").selectExpr("o_orderkey", "'new' AS state", "2 AS v"), ["o_orderkey"], "v"))


@register("s8_publish_snapshot", "SELECT o_orderkey, o_custkey FROM orders")
def s8(s, d):
    df = table(s, d, "orders").select("o_orderkey", "o_custkey")
    T.publish_snapshot(df.limit(10), p := place(s, "snapshot"), 1, 5)
    T.publish_snapshot(df, p, 2, 5)
    T.publish_snapshot(df.limit(2), p, 3, 5)
    return T.read_snapshot(s, p, 1)


@register("s9_write_pages_by_host", "SELECT page_id, lower(regexp_extract(url, '^https?://([^/?#:]+)', 1)) AS host, length(html)::INTEGER AS n FROM pages")
def s9(s, d):
    T.write_pages_by_host(url_site(table(s, d, "pages"), "url", "host"), p := place(s, "pages"))
    return s.read.parquet(p).select("page_id", "host", F.length("html").alias("n"))
