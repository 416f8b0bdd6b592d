"""Registered queries: aggregation, joins, sorting and set operators."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from sluice.operators import joins as J
from sluice.operators import relational as R
from sluice.plans.registry import Registry, table
from sluice.sources.scratch import Scratch, partitions

register = Registry()
QUERIES, SQL = register.queries, register.sql


@register("a5_group_aggregate", """
SELECT l_returnflag, l_linestatus, sum(l_quantity::DECIMAL(24,2))::DOUBLE AS sum_qty, count(*)::BIGINT AS n FROM lineitem
GROUP BY ALL HAVING count(*) > 10 ORDER BY l_returnflag, l_linestatus LIMIT 10""")
def a5(spark, d):
    out = R.group_aggregate(table(spark, d, "lineitem"), ["l_returnflag", "l_linestatus"], {"sum_qty": R.exact_sum("l_quantity"), "n": F.count("*")})
    return R.slice_rows(R.sort_rows(R.having(out, "n", ">", 10), [("l_returnflag", "asc"), ("l_linestatus", "asc")]), 0, 10)


register("a1_merge_count", "SELECT l_suppkey, count(*)::BIGINT AS n FROM lineitem GROUP BY 1")(
    lambda s, d: R.merge_count(table(s, d, "lineitem"), ["l_suppkey"]))
register("a2_merge_sum", "SELECT l_returnflag, sum(l_extendedprice::DECIMAL(24,2))::DOUBLE AS total FROM lineitem GROUP BY 1")(
    lambda s, d: R.merge_sum(table(s, d, "lineitem"), ["l_returnflag"], "l_extendedprice"))
register("a3_merge_min", "SELECT l_partkey, min(l_extendedprice) AS least FROM lineitem GROUP BY 1")(
    lambda s, d: R.merge_min(table(s, d, "lineitem"), ["l_partkey"], "l_extendedprice"))
register("a3_merge_max", "SELECT l_partkey, max(l_extendedprice) AS most FROM lineitem GROUP BY 1")(
    lambda s, d: R.merge_max(table(s, d, "lineitem"), ["l_partkey"], "l_extendedprice"))
register("a4_merge_avg", "SELECT l_linenumber, round(sum(l_quantity::DECIMAL(24,2))::DOUBLE / count(l_quantity), 4) AS mean FROM lineitem GROUP BY 1")(
    lambda s, d: R.merge_avg(table(s, d, "lineitem"), ["l_linenumber"], "l_quantity"))
register("a6_global_aggregate", "SELECT count(*)::BIGINT AS n, sum(l_quantity::DECIMAL(24,2))::DOUBLE AS qty, max(l_shipdate) AS last FROM lineitem")(
    lambda s, d: R.global_aggregate(table(s, d, "lineitem"), {"n": F.count("*"), "qty": R.exact_sum("l_quantity"), "last": F.max("l_shipdate")}))
register("a7_having", "SELECT l_suppkey, count(*)::BIGINT AS n FROM lineitem GROUP BY 1 HAVING count(*) >= 600")(
    lambda s, d: R.having(R.merge_count(table(s, d, "lineitem"), ["l_suppkey"]), "n", ">=", 600))
register("a8_distinct_rows", "SELECT DISTINCT user_id, event_type FROM events")(
    lambda s, d: R.distinct_rows(table(s, d, "events"), ["user_id", "event_type"]))
register("a9_two_phase_aggregate", """
SELECT l_returnflag, sum(l_quantity::DECIMAL(24,2))::DOUBLE AS total, count(l_quantity)::BIGINT AS n, min(l_quantity) AS least, max(l_quantity) AS most,
  round(sum(l_quantity::DECIMAL(24,2))::DOUBLE / count(l_quantity), 4) AS mean FROM lineitem GROUP BY 1""")(
    lambda s, d: R.two_phase_aggregate(table(s, d, "lineitem").withColumn("shard", F.col("l_orderkey") % 8), "shard", ["l_returnflag"], "l_quantity"))

register("j1_cross_shard_join", """
SELECT o_orderkey, o_custkey, o_totalprice, c_name, c_nationkey FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 200000 AND c_acctbal > 0""")(
    lambda s, d: J.cross_shard_join(
        table(s, d, "orders").where("o_totalprice > 200000").select("o_orderkey", "o_custkey", "o_totalprice"),
        table(s, d, "customer").where("c_acctbal > 0").select("c_custkey", "c_name", "c_nationkey"), "o_custkey", "c_custkey"))
register("j2_cross_shard_left_join", "SELECT c_custkey, c_name, o_orderkey FROM customer LEFT JOIN (SELECT * FROM orders WHERE o_orderstatus = 'P') ON c_custkey = o_custkey")(
    lambda s, d: J.cross_shard_join(table(s, d, "customer").select("c_custkey", "c_name"), table(s, d, "orders").where("o_orderstatus = 'P'").select("o_custkey", "o_orderkey"), "c_custkey", "o_custkey", "left"))
register("j3_semi_join_keys", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT')")(
    lambda s, d: J.semi_join_keys(table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity"), table(s, d, "orders").where("o_orderpriority = '1-URGENT'"), "l_orderkey", "o_orderkey"))
register("j4_replicated_join", """
SELECT r_name, n_name, count(*)::BIGINT AS n FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2""")(
    lambda s, d: J.replicated_join(J.replicated_join(J.replicated_join(
        table(s, d, "lineitem").select("l_suppkey"), table(s, d, "supplier").select("s_suppkey", "s_nationkey"), "l_suppkey", "s_suppkey"),
        table(s, d, "nation"), "s_nationkey", "n_nationkey"), table(s, d, "region"), "n_regionkey", "r_regionkey").groupBy("r_name", "n_name").agg(F.count("*").alias("n")))
@register("j5_colocated_join", "SELECT o_orderkey, count(*)::BIGINT AS lines, max(l_quantity) AS most FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1")
def j5(s, d):
    """Both tables in equal buckets of the order's key, under names of this run; the join and its aggregate move no rows."""
    root = Scratch(s, "colocated").root

    def bucketed(t, key, *more):
        name = f"sluice_{t}_{uuid.uuid4().hex}"
        out = J.write_bucketed(table(s, d, t).select(key, *more), name, key, partitions(s), f"{root}/{t}")
        s.sql(f"DROP TABLE {name}")  # the plan has the files and their buckets
        return out

    out = J.colocated_join(bucketed("orders", "o_orderkey"), bucketed("lineitem", "l_orderkey", "l_quantity"), "o_orderkey", "l_orderkey")
    return out.groupBy("o_orderkey").agg(F.count("*").alias("lines"), F.max("l_quantity").alias("most"))


FAMILY = ("c_custkey", "o_custkey", "o_orderkey", "l_orderkey")


def family(s, d):
    tables = table(s, d, "customer").select("c_custkey", "c_nationkey"), table(s, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice"), table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    return J.write_family(*tables, FAMILY, partitions(s), Scratch(s, "family").root)


@register("j5_family_join", """SELECT c_custkey, count(DISTINCT o_orderkey)::BIGINT AS orders, count(*)::BIGINT AS lines, sum(l_quantity::DECIMAL(24,2))::DOUBLE AS quantity FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1""")
def j5_family(s, d):
    """Customers, their orders and the orders' lines, laid out by the customer; joins and aggregate move no rows."""
    rows = J.family_join(*family(s, d), FAMILY)
    return rows.groupBy("c_custkey").agg(F.countDistinct("o_orderkey").alias("orders"), F.count("*").alias("lines"), R.exact_sum("l_quantity").alias("quantity"))


register("j6_inherit_shard", "SELECT l_orderkey, l_linenumber, (o_custkey % 16)::INTEGER AS shard FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey")(
    lambda s, d: J.inherit_shard(table(s, d, "lineitem").select("l_orderkey", "l_linenumber"), table(s, d, "orders").select("o_orderkey", (F.col("o_custkey") % 16).cast("int").alias("shard")), "l_orderkey", "o_orderkey"))
register("j7_lookup", """
SELECT p_partkey, coalesce(v, p_type) AS kind FROM part LEFT JOIN (VALUES ('ECONOMY', 'budget'), ('PROMO', 'sale')) AS t(k, v) ON p_type = k""")(
    lambda s, d: J.lookup(table(s, d, "part").select("p_partkey", "p_type"), s.createDataFrame([("ECONOMY", "budget"), ("PROMO", "sale")], "p_type string, v string"), "p_type", "v", "kind").select("p_partkey", "kind"))
register("j8_qa_documents", "SELECT d.doc_id, lang, quality FROM documents d JOIN labels l ON d.doc_id = l.doc_id")(
    lambda s, d: J.qa_documents(table(s, d, "documents").select("doc_id", "lang"), table(s, d, "labels").select("doc_id", "quality")))
register("j9_attach_entity", "SELECT d.doc_id, source, toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")(
    lambda s, d: J.attach_entity(table(s, d, "documents").select("doc_id", "source"), table(s, d, "labels").select("doc_id", "toxic"), "doc_id"))


@register("j10_reconcile_entities", r"""
WITH snap AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 3 <> 0 THEN 'a' || c_custkey END AS alias, CASE WHEN c_custkey % 2 = 0 THEN c_name END AS account, md5(c_name || chr(1) || c_mktsegment) AS print,
  CASE WHEN c_custkey % 10 = 0 THEN 'X' ELSE c_mktsegment END AS segment FROM customer),
known AS (SELECT c_custkey AS known_id, 'a' || c_custkey AS alias, c_name AS account, md5(c_name || chr(1) || c_mktsegment) AS print, c_mktsegment AS segment FROM customer WHERE c_custkey % 7 <> 0)
SELECT id, coalesce(a.known_id, b.known_id, c.known_id) AS known_id,
  CASE WHEN coalesce(a.known_id, b.known_id, c.known_id) IS NULL THEN 'insert' WHEN coalesce(a.segment, b.segment, c.segment) = s.segment THEN 'same' ELSE 'update' END AS action
FROM snap s LEFT JOIN known a ON s.alias = a.alias LEFT JOIN known b ON s.account = b.account LEFT JOIN known c ON s.print = c.print""")
def j10(s, d):
    c = table(s, d, "customer").withColumn("print", J.fingerprint("c_name", "c_mktsegment"))
    snap = c.selectExpr("c_custkey AS id", "CASE WHEN c_custkey % 3 <> 0 THEN concat('a', c_custkey) END AS alias", "CASE WHEN c_custkey % 2 = 0 THEN c_name END AS account", "print", "CASE WHEN c_custkey % 10 = 0 THEN 'X' ELSE c_mktsegment END AS segment")
    known = c.where("c_custkey % 7 <> 0").selectExpr("c_custkey AS known_id", "concat('a', c_custkey) AS alias", "c_name AS account", "print", "c_mktsegment AS segment")
    return J.reconcile_entities(snap, known, ["alias", "account", "print"], ["segment"]).select("id", "known_id", "action")


register("j11_unseen", "SELECT url FROM pages WHERE url NOT IN (SELECT url FROM pages WHERE page_id % 3 = 0)")(
    lambda s, d: J.unseen(table(s, d, "pages").select("url"), table(s, d, "pages").where("page_id % 3 = 0").select("url"), "url"))
register("j12_range_lookup", """
SELECT o_orderkey, CASE WHEN o_custkey BETWEEN 0 AND 300 THEN 0 WHEN o_custkey BETWEEN 200 AND 900 THEN 1 WHEN o_custkey BETWEEN 901 AND 1200 THEN 2 ELSE 9 END::INTEGER AS node FROM orders""")(
    lambda s, d: J.range_lookup(table(s, d, "orders"), [(0, 300, 0), (200, 900, 1), (901, 1200, 2)], "o_custkey", 9).select("o_orderkey", "node"))

register("o1_sort_rows", "SELECT o_orderkey, o_orderpriority, o_totalprice FROM orders ORDER BY o_orderpriority, o_totalprice DESC, o_orderkey")(
    lambda s, d: R.sort_rows(table(s, d, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice"), [("o_orderpriority", "asc"), ("o_totalprice", "desc"), ("o_orderkey", "asc")]))
register("o2_slice_rows", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50 OFFSET 100")(
    lambda s, d: R.slice_rows(R.sort_rows(table(s, d, "orders").select("o_orderkey", "o_totalprice"), [("o_totalprice", "desc"), ("o_orderkey", "asc")]), 100, 50))
register("o3_cap_rows", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 100")(
    lambda s, d: R.cap_rows(R.sort_rows(table(s, d, "orders").select("o_orderkey"), [("o_orderkey", "asc")]), 100))
register("w6_page_by_row_number", """
SELECT o_orderkey, o_totalprice, rn::INTEGER AS rn FROM (SELECT *, row_number() OVER (ORDER BY o_totalprice, o_orderkey) AS rn FROM orders) WHERE rn BETWEEN 21 AND 40""")(
    lambda s, d: R.page_by_row_number(table(s, d, "orders").select("o_orderkey", "o_totalprice"), ["o_totalprice", "o_orderkey"], 21, 40))
register("u1_union_shards", "SELECT o_orderkey, o_custkey FROM orders")(
    lambda s, d: R.union_shards([table(s, d, "orders").where(F.col("o_orderkey") % 4 == i).select("o_orderkey", "o_custkey") for i in range(4)]))
register("u2_union_queries", "SELECT o_custkey AS k FROM orders UNION SELECT c_custkey AS k FROM customer")(
    lambda s, d: R.union_queries(table(s, d, "orders").select(F.col("o_custkey").alias("k")), table(s, d, "customer").select(F.col("c_custkey").alias("k"))))