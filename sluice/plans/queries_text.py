"""Registered queries: search and query understanding."""

from __future__ import annotations

from pyspark.sql import functions as F

from sluice.operators import matching as M
from sluice.operators import search as T
from sluice.plans.registry import Registry, table
from sluice.sources.scratch import Scratch

register = Registry()
QUERIES, SQL = register.queries, register.sql

_TOK = r"tok AS MATERIALIZED (SELECT doc_id, unnest(range(len(x)))::INTEGER AS pos, unnest(x) AS term FROM (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS x FROM documents))"
_IDF = "idf AS MATERIALIZED (SELECT term, count(DISTINCT doc_id)::BIGINT AS df, round(ln((SELECT count(*) FROM documents) / count(DISTINCT doc_id)), 6) AS idf FROM tok GROUP BY term)"


def tokens(s, d):
    return T.tokenise_table(table(s, d, "documents"), "doc_id", "text")


def idf(s, d):
    docs = table(s, d, "documents")
    return T.corpus_idf(T.distinct_terms(docs, "doc_id", "text"), "doc_id", docs.count(), distinct=True)


register("t1_tokenise_table", f"WITH {_TOK} SELECT * FROM tok")(tokens)
register("t2_corpus_idf", f"WITH {_TOK}, {_IDF} SELECT * FROM idf")(idf)
_WEIGHED = f"""WITH {_TOK}, {_IDF}, b AS (SELECT doc_id, octet_length(encode(text)) AS n FROM documents),
w AS (SELECT tok.doc_id, tok.term, max((octet_length(encode(tok.term))::DOUBLE / n + CASE WHEN idf > 0 THEN log10(idf) ELSE 0 END) * 0.9) AS w FROM tok JOIN idf ON tok.term = idf.term JOIN b ON tok.doc_id = b.doc_id GROUP BY ALL)
SELECT doc_id, term, floor(least(greatest(w, 0.0), 1.0) * 255) / 255 AS w FROM w"""


@register("t3_weigh_terms", _WEIGHED)
def t3(s, d):
    scratch, docs = Scratch(s, "weigh"), table(s, d, "documents")
    found = scratch.save(T.distinct_terms(docs, "doc_id", "text"), "terms")  # parted once, for the idf and for the weights
    known = scratch.save(T.corpus_idf(found, "doc_id", docs.count(), distinct=True), "idf")
    return T.weigh_terms(T.join_idf(found, known), "doc_id", 0.9)


_PTOK = r"SELECT p_partkey, t AS term, floor(least(max(octet_length(encode(t))::DOUBLE / octet_length(encode(p_name)) * 0.9), 1.0) * 255) / 255 AS w FROM (SELECT p_partkey, p_name, unnest(regexp_extract_all(lower(p_name), '[\p{L}\p{N}]+')) AS t FROM part) GROUP BY ALL"
register("t4_index_fields", f"SELECT p_partkey, 'whole_p_brand_' || lower(p_brand) AS term, 1.0::DOUBLE AS w FROM part UNION ALL SELECT * FROM ({_PTOK.replace('GROUP BY ALL', 'GROUP BY p_partkey, t')}) UNION ALL SELECT p_partkey, 'field_p_name_' || term, w FROM ({_PTOK.replace('GROUP BY ALL', 'GROUP BY p_partkey, t')})")(
    lambda s, d: T.index_fields(table(s, d, "part"), "p_partkey", ["p_brand"], ["p_name"]))
register("a12_build_postings", f"WITH {_TOK} SELECT term, doc_id, max(pos)::INTEGER AS pos FROM tok GROUP BY term, doc_id")(lambda s, d: T.build_postings(tokens(s, d), "doc_id", ["pos"]))
register("a13_top_keywords", f"""WITH {_TOK}, {_IDF}, k AS (SELECT lang, tok.term, count(*)::BIGINT AS times, round(count(*) * max(idf), 4) AS weight FROM tok JOIN idf ON tok.term = idf.term JOIN documents ON tok.doc_id = documents.doc_id WHERE idf >= 0.2 AND tok.term NOT IN ('the', 'and') GROUP BY ALL)
SELECT lang, term, times, weight FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY weight DESC, term) AS rn FROM k) WHERE rn <= 20""")(
    lambda s, d: T.top_keywords(T.tokenise_table(table(s, d, "documents"), "lang", "text"), idf(s, d), "lang", 20, 0.2, ("the", "and")))
register("a14_select_words", f"WITH {_TOK} SELECT DISTINCT term FROM tok WHERE regexp_matches(term, '^[0-9]+$')")(lambda s, d: T.select_words(tokens(s, d), "^[0-9]+$"))
register("a14_has_word", f"WITH {_TOK} SELECT doc_id, bool_or(regexp_matches(term, '^[0-9]+$')) AS has_word FROM tok GROUP BY doc_id")(lambda s, d: T.has_word(tokens(s, d), "doc_id", "^[0-9]+$"))


def overlapping(s, d):
    """Two lists that share every third document and together hold all."""
    p = tokens(s, d).groupBy("term", "doc_id").agg(F.count("*").alias("n"))
    return p.where("doc_id % 3 <> 2"), p.where("doc_id % 3 <> 1").withColumn("n", F.col("n") + 100)


_OVERLAPPING = f"WITH {_TOK}, p AS (SELECT term, doc_id, count(*)::BIGINT AS n FROM tok GROUP BY ALL), m AS (SELECT term, doc_id, CASE WHEN doc_id % 3 <> 2 THEN n ELSE n + 100 END AS n FROM p)"
for name in ("u3_merge_postings", "u3_merge_all_postings"):
    register(name, f"{_OVERLAPPING} SELECT term, doc_id, n FROM (SELECT *, row_number() OVER (PARTITION BY term ORDER BY doc_id) AS rn FROM m) WHERE rn <= 5")(
        lambda s, d: T.merge_postings(list(overlapping(s, d)), "doc_id", 5))
for name in ("u4_merge_indexes", "u4_merge_all_indexes"):
    register(name, f"{_OVERLAPPING} SELECT term, doc_id, n FROM m")(lambda s, d: T.merge_indexes(*overlapping(s, d), "doc_id"))

DICTIONARY = {"the": T.OMIT, "and": T.KEYWORD_OMIT, "edsh": T.KEYWORD, "thon": T.NAME, "der": T.KEYWORD, "que": T.NAME}
_DICT = "dict(word, attr) AS (VALUES " + ", ".join(f"('{w}', {a})" for w, a in DICTIONARY.items()) + ")"


def index(s, d):
    """Postings and idf of the documents, from one stored table of their terms."""
    docs = table(s, d, "documents")
    found = Scratch(s, "index").save(T.document_terms(docs.select("doc_id", "text", "lang"), "doc_id", "text", "lang"), "terms", free=True)
    return T.weigh_postings(found, "doc_id"), T.corpus_idf(found.where("title"), "doc_id", docs.count(), distinct=True)


def query_terms(s, d, idf):
    """The whole text of every document whose id is divisible by 20 as a query; Scoring.most_terms is the only limit."""
    docs = table(s, d, "documents").where("doc_id % 20 = 0").withColumnRenamed("doc_id", "query_id")
    size = docs.select("query_id", F.octet_length("text").alias("query_bytes"))
    words = s.createDataFrame(list(DICTIONARY.items()), "term string, attr int")
    tagged = T.tokenise_table(docs, "query_id", "text").join(size, "query_id").join(F.broadcast(words), "term", "left").na.fill(T.UNKNOWN, ["attr"])
    scratch = Scratch(s, "queries")
    return T.join_idf(scratch.save(tagged, "terms"), scratch.save(idf, "idf")).drop("df")


_WEIGH = """qr AS (SELECT *, round((octet_length(encode(term))::DOUBLE / query_bytes + CASE WHEN idf > 1 THEN log10(idf) ELSE 0 END) * CASE attr WHEN 1 THEN 1.5::DOUBLE WHEN 2 THEN 1.1::DOUBLE WHEN 3 THEN 1.0::DOUBLE WHEN 10 THEN 0.1::DOUBLE ELSE 0.3::DOUBLE END, 9)::DECIMAL(18,9) AS raw FROM qt),
qw AS MATERIALIZED (SELECT query_id, pos, term, attr, raw::DOUBLE / (sum(raw) OVER (PARTITION BY query_id))::DOUBLE AS weight, attr IN (1, 2) AS mandatory FROM qr)"""
_POST = r"""mt AS (SELECT doc_id, split_part(text, chr(10), 1) AS m, text, lang FROM documents),
pm AS (SELECT doc_id, t AS term, floor(least(max(octet_length(encode(t))::DOUBLE / octet_length(encode(m))), 1.0) * 255) / 255 AS w FROM (SELECT doc_id, m, unnest(regexp_extract_all(lower(m), '[\p{L}\p{N}]+')) AS t FROM mt) GROUP BY doc_id, t),
pt AS (SELECT doc_id, t AS term, floor(least(max(octet_length(encode(t))::DOUBLE / octet_length(encode(text))), 1.0) * 255) / 255 AS w FROM (SELECT doc_id, text, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS t FROM mt) GROUP BY doc_id, t),
post AS MATERIALIZED (SELECT term, doc_id, max(w_main) AS w_main, max(w_title) AS w_title, max(w_kw) AS w_kw FROM (SELECT term, doc_id, w AS w_main, 0.0::DOUBLE AS w_title, 0.0::DOUBLE AS w_kw FROM pm UNION ALL SELECT term, doc_id, 0.0, w, 0.0 FROM pt UNION ALL SELECT lang, doc_id, 0.0, 0.0, 1.0 FROM mt) GROUP BY term, doc_id)"""
_FOUND = """need AS (SELECT query_id, count(DISTINCT CASE WHEN mandatory THEN term END) AS need FROM qw GROUP BY query_id),
found AS MATERIALIZED (SELECT qw.query_id, doc_id FROM qw JOIN post ON qw.term = post.term JOIN need ON need.query_id = qw.query_id GROUP BY qw.query_id, doc_id, need HAVING count(DISTINCT CASE WHEN mandatory THEN qw.term END) = need),
hits AS MATERIALIZED (SELECT qw.*, post.doc_id, w_main, w_title, w_kw FROM qw JOIN post ON qw.term = post.term JOIN found ON found.query_id = qw.query_id AND found.doc_id = post.doc_id)"""
_SCORE = """sums AS (SELECT query_id, doc_id, sum(round(weight * CASE WHEN w_main > 0 THEN 1.0::DOUBLE WHEN w_kw > 0 THEN 0.9::DOUBLE WHEN w_title > 0 THEN 0.8::DOUBLE ELSE 0 END, 9)::DECIMAL(24,9))::DOUBLE AS q,
  sum(round(greatest(w_main, w_title) * CASE attr WHEN 1 THEN 1.0::DOUBLE WHEN 2 THEN 0.4::DOUBLE ELSE 0.9::DOUBLE END + w_kw * CASE attr WHEN 1 THEN 0.2::DOUBLE WHEN 2 THEN 1.0::DOUBLE ELSE 0.2::DOUBLE END, 9)::DECIMAL(24,9))::DOUBLE AS d FROM hits GROUP BY ALL),
scored AS (SELECT query_id, doc_id, round(least(q, 1.0) * least(d, 1.0) * 10000, 3) AS score FROM sums)"""
#: Queries of whole texts: positions count from 0, and Scoring.most_terms = 31.
_WQT = f"""{_DICT}, q0 AS (SELECT tok.doc_id AS query_id, pos, term, octet_length(encode(text)) AS query_bytes FROM tok JOIN documents ON tok.doc_id = documents.doc_id WHERE tok.doc_id % 20 = 0 AND pos < 31),
qt AS (SELECT q0.*, coalesce(attr, 0) AS attr, idf FROM q0 LEFT JOIN dict ON q0.term = word JOIN idf ON idf.term = q0.term), {_WEIGH}"""
_WHOLE = f"WITH {_TOK}, {_IDF}, {_WQT}, {_POST}, {_FOUND}, {_SCORE}"


def postings(s, d):
    return T.build_index(table(s, d, "documents").select("doc_id", "text", "lang"), "doc_id", "text", "lang")


def weighed(s, d):
    """Postings, and the queries' weighed terms."""
    found, idf = index(s, d)
    return T.weigh_query(query_terms(s, d, idf)), found


def searched(s, d, **how):
    found, idf = index(s, d)
    return T.search(query_terms(s, d, idf), found, "doc_id", **how)


def both(name: str, sql: str):
    """Registers a query under its name and under the name that tells that its queries are whole texts."""
    head, _, tail = name.partition("_")
    whole = {"t6": "weigh_whole_query", "u5": "intersect_whole_queries", "t7": "retrieve_whole_queries", "t8": "score_whole_queries", "t10": "search_whole_queries"}[head]

    def keep(f):
        return register(name, sql)(register(f"{head}_{whole}", sql)(f))

    return keep


SPEAKERS = {"user": 1, "assistant": 2, "system": 3, "the": 4}
_PARTED = r"""p AS (SELECT conv_id, turn, list_filter(string_split(regexp_replace(role || ' ' || text, '(user|assistant|system|the)', chr(1) || '\1' || chr(1), 'g'), chr(1)), lambda x: x <> '') AS p FROM conversations),
s AS (SELECT conv_id, turn, unnest(p) AS section, unnest(range(len(p))) AS ordinal FROM p),
t AS (SELECT *, CASE section WHEN 'user' THEN 1 WHEN 'assistant' THEN 2 WHEN 'system' THEN 3 WHEN 'the' THEN 4 ELSE 0 END::INTEGER AS attr FROM s)"""


def said(s, d):
    return table(s, d, "conversations").select(F.struct("conv_id", "turn").alias("k"), F.expr("conv_id * 1000 + turn").alias("query_id"), F.concat_ws(" ", "role", "text").alias("t"))


register("t5_tag_query", f"WITH {_PARTED} SELECT conv_id, turn, ordinal::INTEGER AS ordinal, section, attr FROM t")(
    lambda s, d: M.tag_spans(said(s, d), "k", "t", SPEAKERS).select("k.conv_id", "k.turn", "ordinal", "section", "attr"))
both("t6_weigh_query", f"WITH {_TOK}, {_IDF}, {_WQT} SELECT query_id, pos, term, round(weight, 6) AS weight, mandatory FROM qw")(
    lambda s, d: weighed(s, d)[0].select("query_id", "pos", "term", F.round("weight", 6).alias("weight"), "mandatory"))
both("u5_intersect_terms", f"{_WHOLE} SELECT query_id, doc_id FROM found")(lambda s, d: T.find_documents(*weighed(s, d), "doc_id"))
both("t7_retrieve", f"{_WHOLE} SELECT query_id, doc_id, term, pos, w_main, w_title, w_kw FROM hits")(
    lambda s, d: T.list_hits(*weighed(s, d), "doc_id"))
both("t8_score", f"{_WHOLE} SELECT query_id, doc_id, score FROM scored")(lambda s, d: T.score_documents(*weighed(s, d), "doc_id"))
register("t9_adjust_scores", "SELECT doc_id, (n_chars::BIGINT + trunc(n_chars * (doc_id % 10) * 0.5::DOUBLE * 0.01::DOUBLE)::BIGINT)::BIGINT AS weight FROM documents")(
    lambda s, d: T.adjust_scores(table(s, d, "documents").selectExpr("doc_id", "cast(n_chars AS double) AS score", "doc_id % 10 AS v"), {"v": 0.5}).select("doc_id", "weight"))
_RANK = "r AS (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank, count(*) OVER (PARTITION BY query_id) AS total FROM scored)"
both("t10_search", f"{_WHOLE}, {_RANK} SELECT query_id, doc_id, score, rank::INTEGER AS rank, total::BIGINT AS total FROM r WHERE rank <= 10")(
    lambda s, d: searched(s, d).select("query_id", "doc_id", F.col("weight").alias("score"), "rank", "total"))
_TERMS = f"""{_PARTED}, w AS (SELECT conv_id * 1000 + turn AS query_id, ordinal, attr, unnest(x) AS term, unnest(range(len(x))) AS k FROM (SELECT *, regexp_extract_all(lower(section), '[\\p{{L}}\\p{{N}}]+') AS x FROM t)),
tagged AS (SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY ordinal, k) - 1)::INTEGER AS pos, term, attr FROM w)"""
register("t5_tag_query_terms", f"WITH {_TERMS} SELECT * FROM tagged")(lambda s, d: T.tag_query(said(s, d), "query_id", "t", SPEAKERS))
register("t10_search_texts", f"""WITH {_TOK}, {_IDF}, {_TERMS},
qt AS (SELECT tagged.*, octet_length(encode(role || ' ' || text)) AS query_bytes, coalesce(idf, 0) AS idf FROM tagged JOIN conversations ON conv_id * 1000 + turn = query_id LEFT JOIN idf ON idf.term = tagged.term WHERE pos < 31), {_WEIGH}, {_POST}, {_FOUND}, {_SCORE}, {_RANK}
SELECT query_id, doc_id, score, rank::INTEGER AS rank, total::BIGINT AS total FROM r WHERE rank <= 10""")(
    lambda s, d: T.search_texts(said(s, d), "query_id", "t", SPEAKERS, *index(s, d), "doc_id").select("query_id", "doc_id", F.col("weight").alias("score"), "rank", "total"))
register("t10_search_boosted", f"""{_WHOLE}, b AS (SELECT query_id, scored.doc_id, (trunc(score)::BIGINT + trunc(score * (n_chars % 10) * 0.5::DOUBLE * 0.01::DOUBLE)::BIGINT)::BIGINT AS weight FROM scored JOIN documents USING (doc_id)),
r AS (SELECT query_id, doc_id, weight, row_number() OVER (PARTITION BY query_id ORDER BY weight DESC, doc_id) AS rank, count(*) OVER (PARTITION BY query_id) AS total FROM b)
SELECT query_id, doc_id, weight, rank::INTEGER AS rank, total::BIGINT AS total FROM r WHERE rank <= 10""")(
    lambda s, d: searched(s, d, values=table(s, d, "documents").selectExpr("doc_id", "n_chars % 10 AS v"), boosts={"v": 0.5}).select("query_id", "doc_id", "weight", "rank", "total"))
register("t11_explain_scores", f"""{_WHOLE}, lines AS (SELECT query_id, doc_id, printf('%s: query %.4f, main %.4f, title %.4f, keyword %.4f', term, weight, w_main, w_title, w_kw) AS x FROM hits)
SELECT query_id, doc_id, string_agg(x, chr(10) ORDER BY x) AS why FROM lines GROUP BY query_id, doc_id""")(lambda s, d: T.explain_documents(*weighed(s, d), "doc_id"))
register("o6_rank_results", "SELECT query_id, doc_id, rank::INTEGER AS rank, total::BIGINT AS total FROM (SELECT source AS query_id, doc_id, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS rank, count(*) OVER (PARTITION BY source) AS total FROM documents) WHERE rank BETWEEN 11 AND 20")(
    lambda s, d: T.rank_results(table(s, d, "documents").select(F.col("source").alias("query_id"), "doc_id", "n_chars"), "doc_id", 1, 10, "n_chars").select("query_id", "doc_id", "rank", "total"))
register("o7_best_answer", "SELECT query_id, doc_id, n_chars FROM (SELECT source AS query_id, doc_id, n_chars, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS rank FROM documents WHERE n_chars >= 2000) WHERE rank = 1")(
    lambda s, d: T.best_answer(table(s, d, "documents").select(F.col("source").alias("query_id"), "doc_id", "n_chars"), "doc_id", 2000, "n_chars"))
register("w1_dedupe_clusters", "SELECT source, doc_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id DESC) AS n FROM documents) WHERE n = 1")(
    lambda s, d: T.dedupe_clusters(table(s, d, "documents").select("source", "doc_id", F.col("doc_id").alias("iid"), "n_chars"), "source", "doc_id", "iid", "n_chars").select("source", "doc_id"))
register("b3_build_index", f"WITH {_POST} SELECT term, doc_id, w_main, w_title, w_kw FROM post")(postings)

#: Queries of which a template matches some and misses others, with words to ignore, parts too long and nulls.
SOME = [(1, "what[D:role][W:1-3]?", "what"), (2, "[D:role]is[F:num]", "number")]


def mixed(s, d):
    kind = "CASE conv_id % 6 WHEN 0 THEN concat('what', role, 'ab?') WHEN 1 THEN concat('what', role, 'abcd?') WHEN 2 THEN concat('um', role, 'umis', turn) WHEN 3 THEN concat(role, 'is', turn, 'x') WHEN 4 THEN text END"
    return table(s, d, "conversations").selectExpr("conv_id * 1000 + turn AS query_id", f"{kind} AS query")


register("q1_match_some_templates", "SELECT conv_id * 1000 + turn AS query_id, CASE conv_id % 6 WHEN 0 THEN 1 ELSE 2 END::INTEGER AS template_id FROM conversations WHERE role IN ('user', 'assistant') AND conv_id % 6 IN (0, 2)")(
    lambda s, d: M.match_templates(mixed(s, d), SOME, {"role": ["user", "assistant"]}, ["um"]).select("query_id", "template_id"))

#: Templates over whole texts, of any length: [W:...] is longer than any of them.
LONG = f"[W:1-{1 << 30}]"
TEXT_TEMPLATES = [(1, f"{LONG}[D:end].", "end"), (2, f"[D:start]{LONG}[D:end]{LONG}", "framed"), (3, f"{LONG}[F:num]% {LONG}", "share"), (4, f"The {LONG}", "article")]
TEXT_LEXICON = {"start": ["the", "The", "de", "De"], "end": ["the", "en", "is", "than", "a"]}
_TEXT_PATTERNS = {1: r"^ *.+? *(a|en|is|the|than) *\. *$", 2: r"^ *(De|The|de|the) *.+? *(a|en|is|the|than) *.+? *$", 3: r"^ *.+? *([0-9.]*) *% .+? *$", 4: r"^ *The +.+? *$"}
_TEXT_MATCHES = " UNION ALL ".join(f"SELECT doc_id, {i}::INTEGER AS template_id FROM documents WHERE regexp_matches(text, '(?s){p}')" for i, p in _TEXT_PATTERNS.items())


def text_matches(s, d, templates, columns=()):
    return M.match_templates(table(s, d, "documents").selectExpr("doc_id AS query_id", "text AS query"), templates, TEXT_LEXICON, [" "], columns)


register("q1_match_text_templates", _TEXT_MATCHES)(lambda s, d: text_matches(s, d, TEXT_TEMPLATES).select(F.col("query_id").alias("doc_id"), "template_id"))
register("j13_match_text_theta", f"SELECT doc_id, CASE template_id WHEN 1 THEN 'end' WHEN 2 THEN 'framed' WHEN 3 THEN 'share' ELSE 'article' END AS attr FROM ({_TEXT_MATCHES})")(
    lambda s, d: text_matches(s, d, TEXT_TEMPLATES).select(F.col("query_id").alias("doc_id"), "attr"))
_TEXT_SLOTS = {1: r"^ *(.+?) *(a|en|is|the|than) *\. *$", 2: r"^ *(De|The|de|the) *(.+?) *(a|en|is|the|than) *(.+?) *$"}
register("q2_extract_text_slots", " UNION ALL ".join(
    f"SELECT doc_id, {i}::INTEGER AS template_id, {n}::INTEGER AS ordinal, md5(regexp_extract(text, '(?s){p}', {n + 1})) AS value FROM documents WHERE regexp_matches(text, '(?s){p}')"
    for i, p in _TEXT_SLOTS.items() for n in range(2 * i)))(
    lambda s, d: M.extract_slots(text_matches(s, d, TEXT_TEMPLATES[:2], ("slots",))).select(F.col("query_id").alias("doc_id"), "template_id", "ordinal", F.md5("value").alias("value")))
register("q3_match_text_domains", f"SELECT doc_id, lang AS domain, string_agg(CASE template_id WHEN 1 THEN 'end' ELSE 'framed' END, ',' ORDER BY template_id) AS intents FROM ({_TEXT_MATCHES}) JOIN documents USING (doc_id) WHERE template_id < 3 AND lang IN ('en', 'de') GROUP BY ALL")(
    lambda s, d: M.match_domains(table(s, d, "documents").selectExpr("doc_id AS query_id", "text AS query", "array(lang, 'zz') AS domains"), {x: (TEXT_TEMPLATES[:2], TEXT_LEXICON, [" "]) for x in ("en", "de")}).select(F.col("query_id").alias("doc_id"), "domain", F.array_join("intents", ",").alias("intents")))

TEMPLATES = [(1, "please [D:role][W:1-4]now", "ask"), (2, "please [D:role][F:num]now", "count")]
LEXICON = {"role": ["user", "assistant"]}


def asked(s, d):
    return table(s, d, "conversations").selectExpr("conv_id * 1000 + turn AS query_id", "concat('please ', role, turn, CASE WHEN conv_id % 3 = 0 THEN 'um' ELSE '' END, 'now') AS query", "CASE WHEN conv_id % 2 = 0 THEN array('a', 'zz') ELSE array('b') END AS domains")


_ASKED = "asked AS (SELECT conv_id * 1000 + turn AS query_id, conv_id, role, turn FROM conversations WHERE role IN ('user', 'assistant'))"
register("q1_match_templates", f"WITH {_ASKED} SELECT query_id, 1::INTEGER AS template_id FROM asked UNION ALL SELECT query_id, 2 FROM asked")(
    lambda s, d: M.match_templates(asked(s, d), TEMPLATES, LEXICON, ["um"]).select("query_id", "template_id"))
register("q2_extract_slots", f"WITH {_ASKED} SELECT query_id, 0::INTEGER AS ordinal, 'role' AS slot, role AS value FROM asked UNION ALL SELECT query_id, 1, 'num', turn::VARCHAR FROM asked")(
    lambda s, d: M.extract_slots(M.match_templates(asked(s, d), TEMPLATES[1:], LEXICON, ["um"])).select("query_id", "ordinal", "slot", "value"))
register("q3_match_domains", f"WITH {_ASKED} SELECT query_id, 'a' AS domain, 'ask,count' AS intents, 1.0::DOUBLE AS score FROM asked WHERE conv_id % 2 = 0 UNION ALL SELECT query_id, 'b', 'ask', 1.0 FROM asked WHERE conv_id % 2 = 1")(
    lambda s, d: M.match_domains(asked(s, d), {"a": (TEMPLATES, LEXICON, ["um"]), "b": (TEMPLATES[:1], LEXICON, ["um"])}).withColumn("intents", F.array_join("intents", ",")))
register("q4_tag_spans", "SELECT doc_id, section, attr::INTEGER AS attr FROM (SELECT doc_id, unnest(['edsh', 'x', lang]) AS section, unnest([2, 0, CASE lang WHEN 'en' THEN 1 ELSE 0 END]) AS attr FROM documents)")(
    lambda s, d: M.tag_spans(table(s, d, "documents").select("doc_id", F.concat(F.lit("edshx"), F.when(F.col("lang") == "en", "en").otherwise("")).alias("t")), "doc_id", "t", {"ed": 3, "edsh": 2, "en": 1}).select("doc_id", "section", "attr"))
SQL["q4_tag_spans"] = "SELECT doc_id, 'edsh' AS section, 2::INTEGER AS attr FROM documents UNION ALL SELECT doc_id, 'x', 0 FROM documents UNION ALL SELECT doc_id, 'en', 1 FROM documents WHERE lang = 'en'"
SPANS = {"the": 3, "der": 2, "tion": 1, "an": 4, "ander": 5}
register("q4_tag_text_spans", rf"""WITH p AS (SELECT doc_id, string_split(regexp_replace(replace(coalesce(text, ''), chr(1), chr(2)), '({'|'.join(sorted(SPANS, key=lambda w: (-len(w), w)))})', chr(1) || '\1' || chr(1), 'g'), chr(1)) AS x FROM documents),
u AS (SELECT doc_id, unnest(x) AS section, unnest(range(len(x))) AS i FROM p)
SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1)::INTEGER AS ordinal, section, CASE WHEN i % 2 = 1 THEN CASE section {' '.join(f"WHEN '{w}' THEN {a}" for w, a in SPANS.items())} END ELSE 0 END::INTEGER AS attr FROM u WHERE section <> ''""")(
    lambda s, d: M.tag_spans(table(s, d, "documents").select("doc_id", F.translate("text", "\x01", "\x02").alias("text")), "doc_id", "text", SPANS))
register("q5_arbitrate", """WITH r AS (SELECT event_id // 4 AS query_id, event_id % 4 AS ord, event_type AS system, event_id % 7 <> 0 AS ok, value AS score, event_id % 3 AS level, 1 AS rl FROM events),
l AS (SELECT * FROM r WHERE ok AND score >= 5), f AS (SELECT query_id, min(ord) AS o0 FROM l GROUP BY 1), z AS (SELECT l.*, f.o0, h.score AS s0, h.level AS l0 FROM l JOIN f ON l.query_id = f.query_id JOIN l h ON h.query_id = f.query_id AND h.ord = f.o0),
k AS (SELECT *, CASE WHEN ord = o0 AND s0 >= 20 THEN 0 WHEN s0 < 20 AND ord > o0 AND score >= 20 AND abs(level - l0) <= 1 THEN 1 WHEN ord = o0 THEN 2 END AS rank FROM z)
SELECT query_id, arg_min(system, rank * 10 + ord) AS system, arg_min(score, rank * 10 + ord) AS score FROM k WHERE rank IS NOT NULL GROUP BY query_id""")(
    lambda s, d: M.arbitrate(table(s, d, "events").selectExpr("event_id div 4 AS query_id", "event_id % 4 AS ord", "event_type AS system", "event_id % 7 <> 0 AS ok", "value AS score", "event_id % 3 AS level", "1 AS replace_level"), 5, 20))
register("j13_match_theta", f"WITH {_ASKED} SELECT query_id, 'count' AS attr FROM asked")(
    lambda s, d: M.match_templates(asked(s, d), TEMPLATES[1:], LEXICON, ["um"]).select("query_id", "attr"))
