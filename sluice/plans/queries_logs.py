"""Registered queries over a statement log, which is made of the events table by a rule that SQL repeats."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.operators import logs as L
from sluice.plans.registry import Registry, table

register = Registry()
QUERIES, SQL = register.queries, register.sql

_KIND = "CASE event_type WHEN 'click' THEN 'SELECT' WHEN 'view' THEN 'SELECT' WHEN 'purchase' THEN 'INSERT' WHEN 'signup' THEN 'INSERT' WHEN 'login' THEN 'SHOW' ELSE 'UPDATE' END"
_LOG = f"""SELECT event_id AS id, user_id AS user, {_KIND} AS sql_type, cast(value AS BIGINT) AS exec_ms, event_id * 37 % 20000 AS sql_rows, user_id % 100 AS net_in, event_id % 1000 AS net_out, ts AS end_ts,
CASE {_KIND} WHEN 'SELECT' THEN concat('SELECT * FROM orders o JOIN customer c ON o.k = c.k WHERE id = ', event_id % 50, '  AND name = ''n', user_id % 9, '''')
  WHEN 'INSERT' THEN concat('INSERT INTO orders VALUES (', event_id, ', ', value, ')') WHEN 'SHOW' THEN 'SHOW TABLES' ELSE concat('UPDATE customer SET v = ', event_id % 7, ' WHERE id = ', user_id) END AS sql FROM events"""
_WITH = f"WITH log AS ({_LOG.replace('cast(value AS BIGINT)', 'trunc(value)::BIGINT')}), fp AS (SELECT *, trim(regexp_replace(regexp_replace(regexp_replace(sql, '''[^'']*''', '?', 'g'), '\\b[0-9]+(\\.[0-9]+)?\\b', '?', 'g'), '\\s+', ' ', 'g')) AS statement FROM log)"


def log(spark, d) -> DataFrame:
    return spark.sql(_LOG.replace("FROM events", "FROM {rows}"), rows=table(spark, d, "events"))


register("a21_statement_frequency", f"""{_WITH} SELECT statement, count(*)::BIGINT AS n, min(CASE WHEN exec_ms > 0 THEN exec_ms END) AS least_ms, max(exec_ms) AS most_ms, (sum(exec_ms) // count(*))::BIGINT AS mean_ms, max(end_ts) AS last_ts, sum(exec_ms)::BIGINT AS total_ms FROM fp GROUP BY 1
ORDER BY n DESC, last_ts DESC, total_ms DESC, statement LIMIT 1024""")(lambda s, d: L.statement_frequency(log(s, d)))
register("a22_read_write_counts", f"""{_WITH} SELECT "user", count(*) FILTER (sql_type IN ('SELECT', 'SHOW'))::BIGINT AS reads, count(*) FILTER (sql_type IN ('UPDATE', 'INSERT', 'DELETE', 'REPLACE'))::BIGINT AS writes,
sum(net_in)::BIGINT AS net_in, sum(net_out)::BIGINT AS net_out, max(end_ts) AS last_ts FROM log GROUP BY 1""")(lambda s, d: L.read_write_counts(log(s, d)))
register("a23_latency_histogram", f"""{_WITH} SELECT "user", count(*) FILTER (exec_ms <= 10)::BIGINT AS le_10, count(*) FILTER (exec_ms > 10 AND exec_ms <= 200)::BIGINT AS le_200,
count(*) FILTER (exec_ms > 200 AND exec_ms <= 1000)::BIGINT AS le_1000, count(*) FILTER (exec_ms > 1000)::BIGINT AS over_1000 FROM log GROUP BY 1""")(lambda s, d: L.latency_histogram(log(s, d)))
register("a24_time_of_day_histogram", f"""{_WITH} SELECT "user", CASE WHEN h < 6 OR h >= 22 THEN '22-06' WHEN h < 13 THEN '06-13' WHEN h < 18 THEN '13-18' ELSE '18-22' END AS part, count(*)::BIGINT AS n
FROM (SELECT "user", hour(end_ts + INTERVAL 8 HOUR) AS h FROM log) GROUP BY ALL""")(lambda s, d: L.time_of_day_histogram(log(s, d), "UTC+8"))
register("a25_table_heat", f"""{_WITH}, t AS (SELECT *, list_distinct(list_transform(regexp_extract_all(sql, '(?i)\\b(?:FROM|JOIN|INTO|UPDATE)\\s+([A-Za-z_][A-Za-z0-9_]*)', 1), lambda x: lower(x))) AS t FROM log),
m AS (SELECT *, CASE WHEN sql LIKE 'SELECT%' OR sql LIKE 'INSERT%' THEN 'orders' WHEN sql LIKE 'UPDATE%' THEN 'customer' END AS main FROM t WHERE len(t) > 0)
SELECT main, count(*) FILTER (sql_type IN ('SELECT', 'SHOW'))::BIGINT AS reads, count(*) FILTER (sql_type IN ('UPDATE', 'INSERT'))::BIGINT AS writes, max(end_ts) AS last_ts,
CASE WHEN count(*) FILTER (len(t) > 1) > 0 THEN 'customer=' || count(*) FILTER (len(t) > 1) ELSE '' END AS used_with FROM m GROUP BY main""")(lambda s, d: L.table_heat(log(s, d)))
register("a26_condition_value_counts", f"{_WITH} SELECT regexp_extract(sql, '\\bid = ([0-9]+)', 1) AS literal, count(*)::BIGINT AS n FROM log WHERE sql_type = 'SELECT' GROUP BY 1")(
    lambda s, d: L.condition_value_counts(log(s, d), "orders", "id"))
register("a27_result_size_by_statement", f"{_WITH} SELECT statement, count(*)::BIGINT AS n, arg_max(sql_rows, (end_ts, sql_rows))::BIGINT AS last_rows FROM fp GROUP BY 1")(lambda s, d: L.result_size_by_statement(log(s, d)))
register("a28_command_counts", f"{_WITH} SELECT sql_type, count(*)::BIGINT AS n FROM log GROUP BY 1")(lambda s, d: L.command_counts(log(s, d)))
register("a29_page_size_histogram", """SELECT least(n // 4096, 24)::INTEGER AS bucket, count(*)::BIGINT AS pages, sum(n)::BIGINT AS bytes, round(sum(n) / count(*), 4) AS mean FROM (SELECT octet_length(encode(html)) AS n FROM pages) GROUP BY 1""")(
    lambda s, d: L.page_size_histogram(table(s, d, "pages")))
register("a30_fetch_outcomes", "SELECT event_type, count(*)::BIGINT AS n FROM events GROUP BY 1")(lambda s, d: L.fetch_outcomes(table(s, d, "events"), "event_type"))
register("a31_throughput_histogram", "SELECT date_trunc('hour', ts) AS start, count(*)::BIGINT AS n FROM events GROUP BY 1")(
    lambda s, d: L.throughput_histogram(table(s, d, "events"), "ts", "hour"))
register("o4_slow_statements", f"{_WITH} SELECT id, exec_ms FROM log WHERE exec_ms >= 100 ORDER BY exec_ms DESC, id LIMIT 10")(lambda s, d: L.slow_statements(log(s, d)).select("id", "exec_ms"))
register("o5_large_results", f"{_WITH} SELECT id, sql_rows FROM log WHERE sql_type = 'SELECT' AND sql_rows > 10000 ORDER BY sql_rows DESC, id LIMIT 10")(lambda s, d: L.large_results(log(s, d)).select("id", "sql_rows"))
_AVG = ", ".join(f"round((sum(v) OVER w{m})::DOUBLE / count(v) OVER w{m}, 4) AS avg_{m}m" for m in (1, 10, 30))
_WIN = ", ".join(f"w{m} AS (PARTITION BY event_type ORDER BY ts RANGE BETWEEN INTERVAL {m} MINUTE PRECEDING AND CURRENT ROW)" for m in (1, 10, 30))
register("w4_trailing_averages", f"SELECT event_id, {_AVG} FROM (SELECT *, value::DECIMAL(24,4) AS v FROM events WHERE value >= 0) WINDOW {_WIN}")(
    lambda s, d: L.trailing_averages(table(s, d, "events"), "event_type", "ts", "value").select("event_id", "avg_1m", "avg_10m", "avg_30m"))
register("w5_last_n", "SELECT event_id, user_id, rn::INTEGER AS rn FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn <= 5")(
    lambda s, d: L.last_n(table(s, d, "events"), "user_id", "ts", "event_id", 5).select("event_id", "user_id", "rn"))
