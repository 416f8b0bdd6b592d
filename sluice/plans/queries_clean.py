"""Registered queries: catalogue cleaning."""

from __future__ import annotations

from pyspark.sql import functions as F

from sluice.operators import cleaning as C
from sluice.plans import cleaning_job as B
from sluice.plans.registry import Registry, table

register = Registry()
QUERIES, SQL = register.queries, register.sql

_MELT = "SELECT p_partkey AS id, unnest(['/p_name/', '/p_brand/', '/p_type/', '/p_size/']) AS path, unnest([p_name, p_brand, p_type, CASE WHEN p_size % 10 = 0 THEN '' ELSE p_size::VARCHAR END]) AS value FROM part"


def melted(s, d):
    part = table(s, d, "part").withColumn("p_size", F.expr("CASE WHEN p_size % 10 = 0 THEN '' ELSE cast(p_size AS string) END"))
    return C.melt(part, "p_partkey", ["p_name", "p_brand", "p_type", "p_size"])


def mapping(s):
    return s.createDataFrame([(1, "/p_name/", "/name/"), (1, "/p_size/", "/size/"), (2, "/p_type/", "/kind/"), (2, "/p_size/", "/size/")], "template_id int, path string, target string")


_MAPPED = f"SELECT id, CASE path WHEN '/p_name/' THEN '/name/' WHEN '/p_size/' THEN '/size/' ELSE '/kind/' END AS path, value FROM ({_MELT}) WHERE path = '/p_size/' OR (id % 2 = 0 AND path = '/p_name/') OR (id % 2 = 1 AND path = '/p_type/')"


def mapped(s, d):
    rows = melted(s, d).withColumn("template_id", (F.col("id") % 2 + 1).cast("int"))
    return C.map_schema(rows, mapping(s)).select("id", "path", "value")


register("p1_clean_rows", "SELECT doc_id FROM documents WHERE n_chars % 3 = 0 AND source = 'src1'")(
    lambda s, d: C.clean_rows(table(s, d, "documents").withColumn("exception_code", F.col("n_chars") % 3), "src1", "source").select("doc_id"))
register("p2_flatten_content", """SELECT event_id, '/k/' AS path, props->>'$.k' AS value FROM events UNION ALL SELECT event_id, '/u/id/', user_id::VARCHAR FROM events UNION ALL SELECT event_id, '/u/d/e/', event_type FROM events""")(
    lambda s, d: C.flatten_content(table(s, d, "events").withColumn("props", F.expr("""concat(substring(props, 1, length(props) - 1), ', "u": {"id": ', user_id, ', "d": {"e": "', event_type, '"}}}')""")), "props", "event_id"))
register("p2_flatten_text_leaves", """SELECT event_id, '/c/' AS path, '{' || event_type AS value FROM events UNION ALL SELECT event_id, '/d/', NULL FROM events UNION ALL SELECT event_id, '/j/', props FROM events
UNION ALL SELECT event_id, '/l/', '[' || user_id || ',{"z":"{"}]' FROM events UNION ALL SELECT event_id, '/o/p/k/', props->>'$.k' FROM events UNION ALL SELECT event_id, '/o/p/s/t/', '{"u":"' || event_type || '"}' FROM events""")(
    lambda s, d: C.flatten_content(table(s, d, "events").withColumn("content", F.expr(r"""concat('{"c": "{', event_type, '", "d": null, "e": {}, "j": "', replace(props, '"', '\\"'), '", "l": [', user_id, ', {"z": "{"}], "o": {"p": ', substring(props, 1, length(props) - 1), ', "s": {"t": {"u": "', event_type, '"}}}}}')""")), "content", "event_id"))
register("p3_map_schema", _MAPPED)(mapped)
register("p4_check_required", f"""SELECT id, max(CASE WHEN value = '' AND path = '/size/' THEN 2 WHEN value = '' THEN 1 ELSE 0 END)::INTEGER AS code, coalesce(string_agg(CASE WHEN value = '' THEN path END, ','), '') AS missing FROM ({_MAPPED}) GROUP BY id""")(
    lambda s, d: C.check_required(mapped(s, d), ["/size/"]).withColumn("missing", F.array_join("missing", ",")))
register("p5_clean_values", f"""SELECT id, path, CASE WHEN path = '/p_type/' THEN lower(value) ELSE value END AS cleaned,
CASE WHEN path = '/p_type/' AND NOT regexp_matches(value, '^[a-zA-Z]+$') THEN 1 WHEN path = '/p_name/' THEN 1 ELSE 0 END::INTEGER AS code FROM ({_MELT})""")(
    lambda s, d: C.clean_values(melted(s, d), {"/p_type/": [("is_percent", "percent_to_score"), ("is_english", "lower")], "/p_name/": [("is_english", "lower")]}).select("id", "path", "cleaned", "code"))
register("p6_recognisers", "SELECT doc_id, regexp_matches(lang, '^[a-zA-Z]+$') AS english, regexp_matches(n_chars % 120 || '%', '^[0-9]{1,2}%$') AS percent FROM documents")(
    lambda s, d: table(s, d, "documents").select("doc_id", C._RECOGNISERS["is_english"](F.col("lang")).alias("english"), C._RECOGNISERS["is_percent"](F.expr("concat(n_chars % 120, '%')")).alias("percent")))
register("p7_cleaners", "SELECT DISTINCT l_discount, round(round(l_discount * 100) / 20)::INTEGER::VARCHAR AS score FROM lineitem")(
    lambda s, d: table(s, d, "lineitem").select("l_discount").distinct().select("l_discount", C._CLEANERS["percent_to_score"](F.expr("concat(cast(round(l_discount * 100) AS int), '%')")).alias("score")))
register("p8_replace_synonyms", f"""SELECT id, path, CASE WHEN path = '/p_type/' AND value IN ('ECONOMY', 'SMALL') THEN 'cheap' WHEN path = '/p_type/' AND value = 'PROMO' THEN 'sale' ELSE value END AS canonical,
CASE WHEN path = '/p_type/' AND value NOT IN ('ECONOMY', 'SMALL', 'PROMO') THEN 1 ELSE 0 END::INTEGER AS code FROM ({_MELT})""")(
    lambda s, d: C.replace_synonyms(melted(s, d), s.createDataFrame([("/p_type/", ["ECONOMY", "SMALL"], "cheap"), ("/p_type/", ["PROMO"], "sale")], "path string, synonyms array<string>, target string")).select("id", "path", "canonical", "code"))
register("p9_normalise_whitespace", r"SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS text FROM documents")(
    lambda s, d: C.normalise_whitespace(table(s, d, "documents").select("doc_id", "text"), ["text"]))
register("p10_audit_missing", """SELECT o_orderkey, concat_ws(',', CASE WHEN o_orderstatus = 'P' THEN 'status' END, CASE WHEN o_custkey % 4 = 0 THEN 'priority' END) AS missing, (o_orderstatus = 'P' OR o_custkey % 4 = 0)::INTEGER AS code FROM orders""")(
    lambda s, d: C.audit_missing(table(s, d, "orders").selectExpr("o_orderkey", "nullif(o_orderstatus, 'P') AS status", "CASE WHEN o_custkey % 4 = 0 THEN '' ELSE o_orderpriority END AS priority"), ["status", "priority"]).select("o_orderkey", F.array_join("missing", ",").alias("missing"), "code"))
register("p11_assign_row_key", "SELECT doc_id, source || doc_id AS row_key FROM documents")(
    lambda s, d: C.assign_row_key(table(s, d, "documents").select("doc_id", "source"), "source", "doc_id").select("doc_id", "row_key"))
register("p12_attributes_to_map", """WITH l AS (SELECT conv_id, turn, unnest(string_split(text || chr(10) || 'a: ' || turn || chr(10) || 'a: ' || conv_id || chr(10) || 'b:', chr(10))) AS line FROM conversations)
SELECT conv_id, turn, conv_id::VARCHAR AS a FROM conversations""")(
    lambda s, d: C.attributes_to_map(table(s, d, "conversations").withColumn("text", F.expr("concat(text, '\n', 'a: ', turn, '\n', 'a: ', conv_id, '\n', 'b:')")), "text", ":").select("conv_id", "turn", F.col("attributes")["a"].alias("a")))
register("p13_unwrap_jsonp", "SELECT event_id, (props->>'$.k')::BIGINT AS k FROM events")(
    lambda s, d: C.unwrap_jsonp(table(s, d, "events").select("event_id", F.concat(F.lit("callback("), "props", F.lit(");")).alias("body")), "body", "k bigint").select("event_id", "parsed.k"))
register("p14_split_multi", "SELECT p_partkey, p_brand AS a, p_type AS b, 3::INTEGER AS n FROM part")(
    lambda s, d: C.split_multi(table(s, d, "part").select("p_partkey", F.concat_ws("##", "p_brand", "p_type", "p_name").alias("v")), "v").select("p_partkey", F.col("parts")[0].alias("a"), F.col("parts")[1].alias("b"), F.size("parts").alias("n")))
register("p15_score_items", """SELECT l_orderkey, l_linenumber, 'discount=' || round(round(l_discount * 100) / 20)::INTEGER || '/percent,flag=' || l_returnflag || '/text,width=' || round(l_quantity / 16)::INTEGER || '/stars' AS items FROM lineitem""")(
    lambda s, d: C.score_items(table(s, d, "lineitem").selectExpr("struct(l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice) AS k", "stack(4, 'discount', concat(cast(round(l_discount * 100) AS int), '%'), 'flag', l_returnflag, 'width', concat(cast(l_quantity AS int), 'px'), 'skip', 'x') AS (label, raw)"), "k", ("skip",)).select("k.l_orderkey", "k.l_linenumber", F.array_join(F.transform("items", lambda x: F.concat(x["label"], F.lit("="), x["value"], F.lit("/"), x["type"])), ",").alias("items")))
register("p16_strip_markup", r"SELECT page_id, substr(regexp_replace(regexp_replace(html, '[\x{10000}-\x{10FFFF}]', '', 'g'), '<[^>]*>', '', 'g'), 1, 18) AS plain FROM pages")(
    lambda s, d: C.strip_markup(table(s, d, "pages"), "html", 18).select("page_id", "plain"))
register("p17_extract_mentions", r"SELECT conv_id, turn, 'str:hi ,at:' || role || ',str: you ' AS parts, 'hi  you' AS clean_text FROM conversations")(
    lambda s, d: C.extract_mentions(table(s, d, "conversations").select("conv_id", "turn", F.concat(F.lit("hi @"), "role", F.lit(" you ")).alias("t")), "t").select("conv_id", "turn", F.array_join(F.transform("parts", lambda x: F.concat(x["type"], F.lit(":"), x["value"])), ",").alias("parts"), "clean_text"))
register("p18_filter_response", "SELECT doc_id, n_chars FROM documents WHERE n_chars >= 2000")(lambda s, d: C.filter_response(table(s, d, "documents").select("doc_id", "n_chars"), 2000, "n_chars"))
_POLICY = {"p_name": "longest", "p_type": "most_frequent", "p_size": "union_values", "p_retailprice": "first_non_empty"}
register("a10_merge_entities", """SELECT md5(p_brand || p_name) AS item_id, count(*)::BIGINT AS n, arg_min(p_retailprice, p_partkey) AS p_retailprice FROM part GROUP BY 1""")(
    lambda s, d: C.merge_entities(table(s, d, "part"), ["p_brand", "p_name"], {"p_retailprice": "first_non_empty"}, "p_partkey"))
register("a11_survivorship", """WITH m AS (SELECT p_brand, p_type, count(*) AS c FROM part GROUP BY ALL), u AS (SELECT p_brand, string_agg(DISTINCT p_size::VARCHAR, '|' ORDER BY p_size::VARCHAR) AS p_size FROM part GROUP BY 1)
SELECT md5(part.p_brand) AS item_id, count(*)::BIGINT AS n, arg_max(p_name, (length(p_name), -p_partkey)) AS p_name, (SELECT p_type FROM m WHERE m.p_brand = part.p_brand ORDER BY c DESC, p_type LIMIT 1) AS p_type,
any_value(u.p_size) AS p_size, arg_min(p_retailprice, p_partkey) AS p_retailprice FROM part JOIN u ON part.p_brand = u.p_brand GROUP BY part.p_brand""")(
    lambda s, d: C.merge_entities(table(s, d, "part"), ["p_brand"], _POLICY, "p_partkey"))


def job(s, d):
    rows = melted(s, d).withColumn("template_id", (F.col("id") % 2 + 1).cast("int"))
    synonyms = s.createDataFrame([("/kind/", ["economy", "promo"], "cheap"), ("/kind/", ["standard"], "plain")], "path string, synonyms array<string>, target string")
    return B.run_cleaning(rows, B.Tables(mapping(s), ["/size/"], {"/kind/": [("is_english", "lower")]}, synonyms))


_JOB = f"""WITH m AS ({_MAPPED}), ok AS (SELECT * FROM m WHERE id NOT IN (SELECT id FROM m WHERE path = '/size/' AND value = '')),
c AS (SELECT id, path, CASE WHEN path = '/kind/' THEN lower(value) ELSE value END AS value FROM ok WHERE id NOT IN (SELECT id FROM ok WHERE path = '/kind/' AND NOT regexp_matches(value, '^[a-zA-Z]+$'))),
k AS (SELECT id, path, CASE WHEN path = '/kind/' AND value IN ('economy', 'promo') THEN 'cheap' WHEN path = '/kind/' AND value = 'standard' THEN 'plain' ELSE value END AS value FROM c
  WHERE id NOT IN (SELECT id FROM c WHERE path = '/kind/' AND value NOT IN ('economy', 'promo', 'standard')))"""
register("b1_run_cleaning", f"{_JOB} SELECT id, path, value FROM k")(lambda s, d: job(s, d)[0])
register("b2_fill_entities", f"{_JOB} SELECT id, string_agg(path || '=' || value, ';' ORDER BY path) AS attributes, 'qa' AS checked_by FROM k GROUP BY id")(
    lambda s, d: B.fill_checked(B.fill_entities(job(s, d)[0]), "qa").select("id", F.array_join(F.transform(F.map_entries("attributes"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";").alias("attributes"), "checked_by"))
