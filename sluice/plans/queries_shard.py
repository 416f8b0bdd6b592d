"""Registered queries: shard rules, keys, and changes of layout."""

from __future__ import annotations

from pyspark.sql import functions as F

from sluice.functions import keys as K
from sluice.functions import shard_rules as H
from sluice.operators import sharding as S
from sluice.plans.registry import Registry, table
from sluice.sources.scratch import Scratch

register = Registry()
QUERIES, SQL = register.queries, register.sql

RANGES = [(0, 3000, 0), (3001, 6000, 1), (6001, 12000, 2)]
_HASH = "list_reduce(list_prepend(0::BIGINT, list_transform(string_split(c_name, ''), lambda c: ascii(c)::BIGINT)), lambda h, c: (h * 31 + c) % 4294967296)"


def rule_query(name: str, t: str, key: str, column: str, rule: H.Rule, sql: str | None, cast: str | None = None):
    """The shard of every row of a table by a rule on one column; `cast` makes the rule's input of the column."""

    def run(spark, d):
        rows = table(spark, d, t).select(key, F.expr(cast or column).alias("_value"))
        return S.assign_shards(rows, "_value", rule).select(key, F.col("shard").cast("int").alias("shard"))

    register(name, f"SELECT {key}, ({sql})::INTEGER AS shard FROM {t}" if sql else None)(run)


rule_query("h1_mod", "orders", "o_orderkey", "o_custkey", H.mod(7), "abs(o_custkey) % 7")
rule_query("h2_range", "orders", "o_orderkey", "o_orderkey", H.ranges(RANGES, 5), "CASE WHEN o_orderkey BETWEEN 0 AND 3000 THEN 0 WHEN o_orderkey BETWEEN 3001 AND 6000 THEN 1 WHEN o_orderkey BETWEEN 6001 AND 12000 THEN 2 ELSE 5 END")
rule_query("h3_enum_map", "orders", "o_orderkey", "o_orderstatus", H.enum_map({"O": 0, "F": 1}, 2), "CASE o_orderstatus WHEN 'O' THEN 0 WHEN 'F' THEN 1 ELSE 2 END")
rule_query("h4_range_mod", "orders", "o_orderkey", "o_orderkey", H.range_mod([(0, 3000, 5), (3001, 6000, 1), (6001, 20000, 4)]),
           "CASE WHEN o_orderkey BETWEEN 0 AND 3000 THEN o_orderkey % 5 WHEN o_orderkey BETWEEN 3001 AND 6000 THEN 5 WHEN o_orderkey BETWEEN 6001 AND 20000 THEN 6 + o_orderkey % 4 END")
rule_query("h5_segments", "orders", "o_orderkey", "o_orderkey", H.segments([2, 1], [256, 512]), "CASE WHEN o_orderkey & 1023 < 256 THEN 0 WHEN o_orderkey & 1023 < 512 THEN 1 ELSE 2 END")
rule_query("h6_string_slice", "customer", "c_custkey", "c_name", H.string_slice(-4, 0, [4], [256]),
           "list_reduce(list_prepend(0::BIGINT, list_transform(string_split(c_name[-4:], ''), lambda c: ascii(c)::BIGINT)), lambda h, c: (h * 31 + c) % 1024) // 256")


def _sar(x: str, s: int) -> str:
    """An arithmetic shift of an unsigned 32-bit number."""
    return f"((floor((CASE WHEN {x} >= 2147483648 THEN {x} - 4294967296 ELSE {x} END)::DOUBLE / {1 << s})::BIGINT + 4294967296) % 4294967296)"


_MIX = f"""WITH a AS (SELECT c_custkey, {_HASH} AS k FROM customer),
b AS (SELECT c_custkey, ((k * 2097152) % 4294967296 - k - 1 + 8589934592) % 4294967296 AS k FROM a), c AS (SELECT c_custkey, xor(k, {_sar('k', 24)}) AS k FROM b),
d AS (SELECT c_custkey, (k * 265) % 4294967296 AS k FROM c), e AS (SELECT c_custkey, xor(k, {_sar('k', 14)}) AS k FROM d),
f AS (SELECT c_custkey, (k * 21) % 4294967296 AS k FROM e), g AS (SELECT c_custkey, xor(k, {_sar('k', 28)}) AS k FROM f),
h AS (SELECT c_custkey, (k + (k % 2) * 2147483648) % 4294967296 AS k FROM g)
SELECT c_custkey, (abs(CASE WHEN k >= 2147483648 THEN k - 4294967296 ELSE k END) % 12)::INTEGER AS shard FROM h"""
rule_query("h7_hash_mod", "customer", "c_custkey", "c_name", H.hash_mod(12), "0")
SQL["h7_hash_mod"] = _MIX


def _jump_sql(keys: str, n: int, out: str) -> str:
    """SQL of a jump consistent hash: `keys` gives id and k (64 bits, unsigned), `out` makes the shard of id and b."""
    return f"""WITH RECURSIVE r AS (SELECT id, k::HUGEINT AS k, -1::BIGINT AS b, 0::BIGINT AS j FROM ({keys}) UNION ALL
SELECT id, nk, j, trunc((j + 1) * (2147483648.0::DOUBLE / ((nk // 8589934592)::DOUBLE + 1.0::DOUBLE)))::BIGINT FROM (SELECT *, (k * 2862933555777941757::HUGEINT + 1) % 18446744073709551616::HUGEINT AS nk FROM r WHERE j < {n}))
{out}"""


_DIGITS = "list_reduce(list_prepend(0::BIGINT, list_transform(string_split(o_orderkey::VARCHAR, ''), lambda c: ascii(c)::BIGINT)), lambda h, c: (h * 31 + c) % 4294967296)"
_JUMP = _jump_sql(f"SELECT o_orderkey AS id, CASE WHEN h >= 2147483648 THEN h::HUGEINT - 4294967296 + 18446744073709551616::HUGEINT ELSE h::HUGEINT END AS k FROM (SELECT o_orderkey, {_DIGITS} AS h FROM orders)", 16, "SELECT id AS o_orderkey, b::INTEGER AS shard FROM r WHERE j >= 16")
_SPAN = _jump_sql("SELECT o_orderkey AS id, date_diff('second', TIMESTAMP '1970-01-01', o_orderdate::TIMESTAMP)::HUGEINT * 1000 AS k FROM orders", 6,
                  "SELECT id AS o_orderkey, (trunc(date_diff('second', TIMESTAMP '1992-01-01', o_orderdate::TIMESTAMP) / 2592000.0) * 6 + b)::INTEGER AS shard FROM r JOIN orders ON o_orderkey = id WHERE j >= 6")


def _turn(x: str, n: int) -> str:
    return f"((({x})::HUGEINT << {n}) % 4294967296 + (({x})::HUGEINT >> {32 - n}))"


def _murmur_sql(rows: str) -> str:
    """SQL of Murmur3 of the ASCII strings of rows (id, x), with seed 0: id and h, signed."""
    mixed = f"({_turn('(k * 3432918353::HUGEINT) % 4294967296', 15)} * 461845907::HUGEINT) % 4294967296 + full * 4294967296"
    step = f"CASE WHEN e >= 4294967296 THEN ({_turn('xor(h, e % 4294967296)', 13)} * 5 + 3864292196) % 4294967296 ELSE xor(h, e) END"
    blocks = "list_transform(range((length(x) + 1) // 2), lambda i: {'k': ascii(x[2 * i + 1])::HUGEINT + CASE WHEN length(x) > 2 * i + 1 THEN ascii(x[2 * i + 2]) * 65536 ELSE 0 END, 'full': (length(x) > 2 * i + 1)::HUGEINT})"
    mixed = mixed.replace("k *", "b.k *").replace("full *", "b.full *")
    last = "SELECT id, xor(h, h >> 16) AS h FROM (SELECT id, (xor(h, h >> 13) * 3266489909::HUGEINT) % 4294967296 AS h FROM (SELECT id, (xor(h, h >> 16) * 2246822507::HUGEINT) % 4294967296 AS h FROM m2))"
    return f"""SELECT id, (CASE WHEN h >= 2147483648 THEN h - 4294967296 ELSE h END)::BIGINT AS h FROM (WITH m1 AS (SELECT id, length(x) AS n, list_transform({blocks}, lambda b: ({mixed})::HUGEINT) AS e FROM ({rows})),
m2 AS (SELECT id, xor(list_reduce(list_prepend(0::HUGEINT, e), lambda h, e: ({step})::HUGEINT), (2 * n)::HUGEINT) AS h FROM m1) {last})"""


_RING = f"""WITH names AS (SELECT s * 1000 + v AS id, 'SHARD-' || s || (SELECT string_agg('-NODE-' || i, '' ORDER BY i) FROM range(v + 1) t(i)) AS x FROM range(8) a(s), range(160) b(v)),
ring AS MATERIALIZED (SELECT h, max(id // 1000) AS shard FROM ({_murmur_sql('SELECT id, x FROM names')}) GROUP BY h),
keys AS MATERIALIZED (SELECT id, h FROM ({_murmur_sql('SELECT o_orderkey AS id, o_orderkey::VARCHAR AS x FROM orders')}))
SELECT id AS o_orderkey, coalesce(shard, (SELECT arg_min(shard, h) FROM ring))::INTEGER AS shard FROM keys ASOF LEFT JOIN ring ON keys.h <= ring.h"""

rule_query("h8_jump_hash", "orders", "o_orderkey", "o_orderkey", H.jump_hash(16), None, "cast(o_orderkey AS string)")
rule_query("h9_murmur_ring", "orders", "o_orderkey", "o_orderkey", H.murmur_ring(8), None, "cast(o_orderkey AS string)")
SQL["h8_jump_hash"], SQL["h9_murmur_ring"] = _JUMP, _RING
rule_query("h10_pattern", "orders", "o_orderkey", "o_custkey", H.pattern(256, [(1, 64, 0), (65, 128, 1), (129, 255, 2), (0, 0, 3)], 9),
           "CASE WHEN o_custkey % 5 = 0 THEN 9 WHEN o_custkey % 256 BETWEEN 1 AND 64 THEN 0 WHEN o_custkey % 256 BETWEEN 65 AND 128 THEN 1 WHEN o_custkey % 256 BETWEEN 129 AND 255 THEN 2 ELSE 3 END",
           "CASE WHEN o_custkey % 5 = 0 THEN concat('c', o_custkey) ELSE cast(o_custkey AS string) END")
rule_query("h11_prefix_pattern", "part", "p_partkey", "p_name", H.prefix_pattern(5, 32, [(0, 7, 0), (8, 15, 1), (16, 23, 2), (24, 31, 3)]),
           "list_sum(list_transform(string_split(p_name[:5], ''), lambda c: ascii(c))) % 32 // 8")
rule_query("h12_by_day", "orders", "o_orderkey", "o_orderdate", H.by_day("1996-01-01", 30, "1997-12-31"),
           "CASE WHEN o_orderdate > TIMESTAMP '1997-12-31' THEN trunc(date_diff('second', TIMESTAMP '1996-01-01', o_orderdate) / 2592000.0) % 25 ELSE trunc(date_diff('second', TIMESTAMP '1996-01-01', o_orderdate) / 2592000.0) END")
rule_query("h13_by_month", "orders", "o_orderkey", "o_orderdate", H.by_month("1996-01-01", "1997-06-01"),
           "(((year(o_orderdate) * 12 + month(o_orderdate) - 1996 * 12 - 1) % 18) + 18) % 18")
rule_query("h14_latest_month", "orders", "o_orderkey", "o_orderdate", H.latest_month(12), "(day(o_orderdate) - 1) * 12 + (o_orderkey % 24) // 2",
           "concat(date_format(o_orderdate, 'yyyyMMdd'), lpad(cast(o_orderkey % 24 AS string), 2, '0'))")
QUERIES["h14_latest_month"] = lambda s, d: S.assign_shards(
    table(s, d, "orders").select("o_orderkey", F.expr("concat(date_format(o_orderdate, 'yyyyMMdd'), lpad(cast(o_orderkey % 24 AS string), 2, '0'))").alias("v")), "v", H.latest_month(12)).select("o_orderkey", "shard")
rule_query("h15_range_date_hash", "orders", "o_orderkey", "o_orderdate", H.range_date_hash("1992-01-01", 30, 6), None)
SQL["h15_range_date_hash"] = _SPAN
rule_query("h16_substring_direct", "customer", "c_custkey", "c_name", H.substring_direct(16, 2, 40, 41), "CASE WHEN c_name[17:18]::INTEGER >= 40 THEN 41 ELSE c_name[17:18]::INTEGER END")


def _written(spark, d, rule=None):
    path = f"{Scratch(spark, 'shards').root}/orders"
    S.write_sharded(table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice"), "o_orderkey", rule or H.mod(8), path)
    return path


@register("h17_prune_shards", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey IN (3, 11, 20, 1003)")
def h17(spark, d):
    shards = S.prune_shards(spark, H.mod(8), "bigint", values=[3, 11, 20, 1003])
    return S.scan_shards(spark, _written(spark, d), shards).where(F.col("o_orderkey").isin(3, 11, 20, 1003)).select("o_orderkey", "o_totalprice")


register("s2_scan_shards", "SELECT o_orderkey, (o_orderkey % 8)::INTEGER AS shard FROM orders WHERE o_orderkey % 8 IN (1, 5)")(
    lambda s, d: S.scan_shards(s, _written(s, d), [1, 5]).select("o_orderkey", "shard"))
register("s4_write_sharded", "SELECT (o_orderkey % 8)::INTEGER AS shard, count(*)::BIGINT AS n, sum(o_custkey)::BIGINT AS keys FROM orders GROUP BY 1")(
    lambda s, d: S.scan_shards(s, _written(s, d)).groupBy("shard").agg(F.count("*").alias("n"), F.sum("o_custkey").alias("keys")))

register("i1_assign_sequence", "SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice, o_orderkey) + 999 AS seq FROM orders")(
    lambda s, d: K.assign_sequence(table(s, d, "orders").select("o_orderkey", "o_totalprice"), ["o_totalprice", "o_orderkey"], 1000).select("o_orderkey", "seq"))
register("i2_assign_time_ids", """
SELECT o_orderkey, (((1700000000000 - 1288834974657 + p // 131072) << 22) + (((p // 4096) % 32) << 12) + p % 4096)::BIGINT AS time_id
FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS p FROM orders)""")(
    lambda s, d: K.assign_time_ids(table(s, d, "orders").select("o_orderkey"), 1700000000000, ["o_orderkey"]))
register("i3_assign_hash_key", """
SELECT doc_id, ((('0x' || h[1:8])::BIGINT + ('0x' || h[9:16])::BIGINT + ('0x' || h[17:24])::BIGINT + ('0x' || h[25:32])::BIGINT) % 4294967296)::BIGINT AS hash_key
FROM (SELECT doc_id, md5(source || lang || doc_id) AS h FROM documents)""")(
    lambda s, d: K.assign_hash_key(table(s, d, "documents").select("doc_id", "source", "lang"), ["source", "lang", "doc_id"]).select("doc_id", "hash_key"))

register("a15_shard_distribution", "SELECT (o_custkey % 7)::INTEGER AS shard, count(*)::BIGINT AS n, round(count(*) / sum(count(*)) OVER (), 6) AS ratio FROM orders GROUP BY 1")(
    lambda s, d: S.shard_distribution(S.assign_shards(table(s, d, "orders"), "o_custkey", H.mod(7))))
register("a16_rehash_report", """
SELECT count(*)::BIGINT AS n, sum((o_custkey % 7 = o_custkey % 9)::INTEGER)::BIGINT AS stay, round(sum((o_custkey % 7 = o_custkey % 9)::INTEGER) / count(*), 6) AS stay_ratio,
  round(1 - sum((o_custkey % 7 = o_custkey % 9)::INTEGER) / count(*), 6) AS move_ratio FROM orders""")(
    lambda s, d: S.rehash_report(table(s, d, "orders"), "o_custkey", H.mod(7), H.mod(9)))
register("a17_migration_plan", "SELECT (o_custkey % 7)::INTEGER AS source, (o_custkey % 9)::INTEGER AS target, count(*)::BIGINT AS n FROM orders WHERE o_custkey % 7 <> o_custkey % 9 GROUP BY ALL")(
    lambda s, d: S.migration_plan(table(s, d, "orders"), "o_custkey", H.mod(7), H.mod(9)))


register("a17_moving_keys", "SELECT o_orderkey, (o_custkey % 7)::INTEGER AS source, (o_custkey % 9)::INTEGER AS target FROM orders WHERE o_custkey % 7 <> o_custkey % 9")(
    lambda s, d: S.moving_keys(table(s, d, "orders"), "o_custkey", "o_orderkey", H.mod(7), H.mod(9)))


def _migrated(spark, d):
    """The table before and after it went from 8 shards to 12; only the rows that move are written, then their old shards cleared."""
    path = f"{Scratch(spark, 'migrated').root}/orders"
    S.write_layout(table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice"), path, ("o_orderkey", "mod", 8))
    before = S.scan_layout(spark, path)
    S.migrate(spark, path, ("o_orderkey", "mod", 12))
    S.clear_moved(spark, path)
    return before, S.scan_layout(spark, path)


register("a18_apply_migration", "SELECT o_orderkey, o_totalprice, (o_orderkey % 12)::INTEGER AS shard FROM orders")(
    lambda s, d: _migrated(s, d)[1].select("o_orderkey", "o_totalprice", "shard"))
register("a19_validate_migration", "SELECT count(*)::BIGINT AS rows_before, count(*)::BIGINT AS rows_after, 0::BIGINT AS lost, 0::BIGINT AS extra, true AS valid FROM orders")(
    lambda s, d: S.validate_migration(*_migrated(s, d), "o_orderkey"))
register("a20_replica_consistency", """
WITH r AS (SELECT 'a' AS replica, count(*)::BIGINT AS n, max(o_orderkey)::BIGINT AS last_op, true AS has_op_time FROM orders
  UNION ALL SELECT 'b', count(*), max(o_orderkey), true FROM orders WHERE o_orderkey % 100 <> 0 UNION ALL SELECT 'c', count(*), NULL, false FROM orders)
SELECT *, false AS consistent FROM r""")(
    lambda s, d: S.replica_consistency({"a": table(s, d, "orders"), "b": table(s, d, "orders").where("o_orderkey % 100 <> 0"), "c": table(s, d, "orders").drop("o_orderkey")}, "o_orderkey"))
