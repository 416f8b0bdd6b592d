"""Weighted inverted index: terms of documents, postings, retrieval and scoring of many queries at once."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sluice.operators.joins import small
from sluice.operators.matching import tag_spans
from sluice.operators.topk import all_documents, best_documents, billionths

NAME, KEYWORD, KEYWORD_OMIT, OMIT, UNKNOWN = 1, 2, 3, 10, 0
#: Terms whose idf every task may hold.
FREQUENT = 50_000


@dataclass(frozen=True)
class Scoring:
    """Factors by attribute of a query term, by field of a match, and of a document's match."""

    attribute: dict[int, float] = field(default_factory=lambda: {NAME: 1.5, KEYWORD: 1.1, KEYWORD_OMIT: 1.0, OMIT: 0.1, UNKNOWN: 0.3})
    title_boost: float = 0.9
    fields: tuple[float, float, float] = (1.0, 0.9, 0.8)  # main, keyword, title
    document: dict[int, tuple[float, float]] = field(default_factory=lambda: {NAME: (1.0, 0.2), KEYWORD: (0.4, 1.0)})
    other: tuple[float, float] = (0.9, 0.2)
    scale: float = 10_000
    most_terms: int = 31


def _pick(column: str, table: dict, default) -> Column:
    out = F.lit(default)
    for k, v in table.items():
        out = F.when(F.col(column) == k, F.lit(v)).otherwise(out)
    return out


def terms(text: Column) -> Column:
    """Lower-case runs of letters and digits; a run of CJK characters gives its pairs (or its only character)."""
    runs = F.regexp_extract_all(F.lower(text), F.lit(r"[\x{4E00}-\x{9FFF}]+|[\p{L}\p{N}&&[^\x{4E00}-\x{9FFF}]]+"), 0)
    pairs = lambda r: F.when(F.length(r) == 1, F.array(r)).otherwise(F.transform(F.sequence(F.lit(1), F.length(r) - 1), lambda i: F.substring(r, i, F.lit(2))))
    mixed = F.flatten(F.transform(runs, lambda r: F.when(r.rlike(r"^[\x{4E00}-\x{9FFF}]"), pairs(r)).otherwise(F.array(r))))
    return F.when(text.rlike(r"[\x{4E00}-\x{9FFF}]"), mixed).otherwise(runs)  # a text without CJK characters is done with its runs


def tokenise_table(df: DataFrame, key: str, column: str) -> DataFrame:
    """(key, pos, term) of a text column."""
    return df.select(key, F.posexplode(terms(F.col(column))).alias("pos", "term"))


def distinct_terms(df: DataFrame, key: str, column: str) -> DataFrame:
    """(key, field_bytes, term) of a text column, each term of a row once; nothing is shuffled."""
    rows = df.select(key, F.octet_length(column).alias("field_bytes"), F.array_distinct(terms(F.col(column))).alias("_terms"))
    return rows.select(key, "field_bytes", F.explode("_terms").alias("term"))  # in two steps: what stands beside explode() is worked out for each term


def corpus_idf(tokens: DataFrame, key: str, documents: int, distinct: bool = False) -> DataFrame:
    """df and idf of each term; `distinct` tells that the tokens have each term of a document once."""
    df = F.count("*") if distinct else F.countDistinct(key)
    return tokens.groupBy("term").agg(df.alias("df")).withColumn("idf", F.round(F.log(F.lit(documents) / F.col("df")), 6))


def weigh_terms(rows: DataFrame, key: str, boost: float = 1.0) -> DataFrame:
    """The weight of a term in a field: its share of the field's bytes and log10 of its idf (idf over 0), boosted, held
    in [0, 1] and cut to 255 steps; it is the same at all of a term's places. rows: key, term (once a key), idf,
    field_bytes."""
    share = F.octet_length("term") / F.col("field_bytes")
    raw = (share + F.when(F.col("idf") > 0, F.log10("idf")).otherwise(0)) * boost
    return rows.select(key, "term", _steps(raw).alias("w"))


def _steps(raw: Column) -> Column:
    return F.floor(F.least(F.greatest(raw, F.lit(0.0)), F.lit(1.0)) * 255) / 255


def index_fields(df: DataFrame, key: str, whole: list[str], titles: list[str]) -> DataFrame:
    """whole_<field>_<value> terms of weight 1, and the tokens of title fields, bare and as field_<field>_<term>. The key
    identifies a row."""
    parts = [df.select(key, F.concat(F.lit(f"whole_{c}_"), F.lower(F.col(c).cast("string"))).alias("term"), F.lit(1.0).alias("w")) for c in whole]
    for c in titles:
        rows = weigh_terms(distinct_terms(df, key, c).withColumn("idf", F.lit(0.0)), key, Scoring().title_boost)
        parts += [rows, rows.withColumn("term", F.concat(F.lit(f"field_{c}_"), "term"))]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out.where(F.col("term").isNotNull())


def build_postings(tokens: DataFrame, key: str, weights: list[str]) -> DataFrame:
    """One posting for each term and document: the largest weight of each feature."""
    return tokens.groupBy("term", key).agg(*[F.max(w).alias(w) for w in weights])


def merge_postings(lists: list[DataFrame], key: str, most: int | None = None) -> DataFrame:
    """Postings of several lists in order; of a document in two lists of one term, the earlier list's entry counts."""
    out = None
    for i, part in enumerate(lists):
        part = part.withColumn("_list", F.lit(i))
        out = part if out is None else out.unionByName(part)
    first = out.withColumn("_n", F.row_number().over(Window.partitionBy("term", key).orderBy("_list"))).where("_n = 1").drop("_n", "_list")
    if most is None:
        return first
    return first.withColumn("_n", F.row_number().over(Window.partitionBy("term").orderBy(key))).where(F.col("_n") <= most).drop("_n")


def merge_indexes(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    return merge_postings([a, b], key)


def top_keywords(tokens: DataFrame, idf: DataFrame, group: str, limit: int, least_idf: float = 0.2, stop: tuple[str, ...] = ()) -> DataFrame:
    """Of each group (of tokens: group, term) the words of greatest weight, times and the sum of idf; rare enough words
    only. Words are counted before they meet their idf, so that a frequent word is one row of each group there."""
    rows = tokens.where(~F.col("term").isin(list(stop))) if stop else tokens
    rows = rows.groupBy(group, "term").agg(F.count("*").alias("times")).join(idf.where(F.col("idf") >= least_idf).select("term", "idf"), "term")
    rows = rows.select(group, "term", "times", F.round(F.col("times") * F.col("idf"), 4).alias("weight"))
    w = Window.partitionBy(group).orderBy(F.desc("weight"), "term")
    return rows.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= limit).drop("rn")


def select_words(tokens: DataFrame, pattern: str) -> DataFrame:
    return tokens.where(F.col("term").rlike(pattern)).select("term").distinct()


def has_word(tokens: DataFrame, key: str, pattern: str) -> DataFrame:
    return tokens.groupBy(key).agg(F.max(F.col("term").rlike(pattern)).alias("has_word"))


def weigh_query(terms: DataFrame, scoring: Scoring = Scoring()) -> DataFrame:
    """(query_id, term, attr, idf, query_bytes) with weight (of sum 1 in a query) and mandatory (names and keywords)."""
    raw = (F.octet_length("term") / F.col("query_bytes") + F.when(F.col("idf") > 1, F.log10("idf")).otherwise(0)) * _pick("attr", scoring.attribute, 0.3)
    raw = F.round(raw, 9)
    first = terms.withColumn("_n", F.row_number().over(Window.partitionBy("query_id").orderBy("pos"))).where(F.col("_n") <= scoring.most_terms).drop("_n")
    out = first.withColumn("raw", raw.cast("decimal(18,9)"))
    total = F.sum("raw").over(Window.partitionBy("query_id"))
    return out.withColumn("weight", F.col("raw").cast("double") / total.cast("double")).withColumn("mandatory", F.col("attr").isin(NAME, KEYWORD)).drop("raw")


def _needed(query_terms: DataFrame) -> DataFrame:
    """Adds _counts (1 at the first place of a mandatory term of a query) and _need (their number in the query)."""
    first = F.row_number().over(Window.partitionBy("query_id", "term").orderBy("pos")) == 1
    marked = query_terms.withColumn("_counts", (F.col("mandatory") & first).cast("int"))
    return marked.withColumn("_need", F.sum("_counts").over(Window.partitionBy("query_id")))


def intersect_terms(query_terms: DataFrame, postings: DataFrame, key: str) -> DataFrame:
    """(query_id, key) of documents with all mandatory terms of a query, or with any term where none is mandatory."""
    hits = _needed(query_terms).join(postings.select("term", key), "term")
    return hits.groupBy("query_id", key).agg(F.sum("_counts").alias("met"), F.max("_need").alias("need")).where("met = need").select("query_id", key)


def retrieve(query_terms: DataFrame, postings: DataFrame, key: str) -> DataFrame:
    """All matches (query, document, term, weights) of the documents that a query finds, by one join."""
    hits = _needed(query_terms).join(postings, "term")
    met = F.sum("_counts").over(Window.partitionBy("query_id", key))
    return hits.withColumn("_met", met).where("_met = _need").drop("_met", "_need", "_counts")


def _scored(hits: DataFrame, key: str, scoring: Scoring, found: Column | None = None) -> DataFrame:
    main, kw, title = scoring.fields
    place = F.when(F.col("w_main") > 0, main).when(F.col("w_kw") > 0, kw).when(F.col("w_title") > 0, title).otherwise(0.0)
    exact = lambda x: F.round(x, 9).cast("decimal(24,9)")
    a = _pick("attr", {k: v[0] for k, v in scoring.document.items()}, scoring.other[0])
    b = _pick("attr", {k: v[1] for k, v in scoring.document.items()}, scoring.other[1])
    sums = hits.groupBy("query_id", key).agg(
        F.sum(exact(F.col("weight") * place)).cast("double").alias("q"), F.sum(exact(F.greatest("w_main", "w_title") * a + F.col("w_kw") * b)).cast("double").alias("d"),
        (F.lit(True) if found is None else found).alias("found"),
    ).where("found")
    return sums.select("query_id", key, F.round(F.least("q", F.lit(1.0)) * F.least("d", F.lit(1.0)) * scoring.scale, 3).alias("score"))


def score(hits: DataFrame, key: str, scoring: Scoring = Scoring()) -> DataFrame:
    """(query_id, key, score) of matches with w_main, w_title, w_kw: the query's match times the document's match."""
    return _scored(hits, key, scoring)


def adjust_scores(hits: DataFrame, boosts: dict[str, float], base: str = "score") -> DataFrame:
    """base + the whole parts of base * value * boost / 100, for each value column."""
    total = F.col(base).cast("bigint")
    for value, boost in boosts.items():
        total = total + (F.col(base) * F.col(value) * boost * 0.01).cast("bigint")
    return hits.withColumn("weight", total)


def rank_results(results: DataFrame, key: str, page: int, size: int, weight: str = "weight") -> DataFrame:
    """A page of each query's results, best first, with the rank and the count of all. Ranks are cut in each task before
    rows move; the count is an aggregate of its own, which reads the results once more."""
    q = Window.partitionBy("query_id").orderBy(F.desc(weight), F.asc(key))
    out = results.withColumn("rank", F.row_number().over(q)).where(F.col("rank") <= (page + 1) * size).where(F.col("rank") > page * size)
    totals = results.groupBy(F.col("query_id").alias("_query")).agg(F.count("*").alias("total"))
    return out.join(totals, F.col("query_id").eqNullSafe(F.col("_query"))).drop("_query")


def best_answer(results: DataFrame, key: str, least: float, weight: str = "weight") -> DataFrame:
    q = Window.partitionBy("query_id").orderBy(F.desc(weight), F.asc(key))
    return results.where(F.col(weight) >= least).withColumn("_n", F.row_number().over(q)).where("_n = 1").drop("_n")


def dedupe_clusters(df: DataFrame, cluster: str, doc: str, internal: str, weight: str) -> DataFrame:
    """Of each document its newest entry; then of each cluster the entry of most weight, then of the larger id."""
    newest = df.withColumn("_n", F.row_number().over(Window.partitionBy(cluster, doc).orderBy(F.desc(internal)))).where("_n = 1").drop("_n")
    return newest.withColumn("_n", F.row_number().over(Window.partitionBy(cluster).orderBy(F.desc(weight), F.desc(internal)))).where("_n = 1").drop("_n")


def explain_scores(hits: DataFrame, key: str) -> DataFrame:
    line = F.format_string("%s: query %.4f, main %.4f, title %.4f, keyword %.4f", "term", "weight", "w_main", "w_title", "w_kw")
    return hits.groupBy("query_id", key).agg(F.array_join(F.array_sort(F.collect_list(line)), "\n").alias("why"))


def document_terms(docs: DataFrame, key: str, title: str, keyword: str) -> DataFrame:
    """(term, key, main, title, kw, m, t): each term of a document once, where it stands (first line, text, keyword) and its
    share of the line's and the text's bytes. Stored, it serves postings and idf alike.

    The first line's terms are the first of the text's, so that a text is parted once, and a row's terms are told apart
    before they leave it: nothing is shuffled but the keys, to see that each is there once. Where keys repeat, their
    rows' terms meet in an aggregate, and the largest share counts."""
    line = F.split_part(title, F.lit("\n"), F.lit(1))
    once = lambda text: F.coalesce(F.array_distinct(terms(text)), F.array().cast("array<string>"))
    rows = docs.select(
        key, F.octet_length(title).alias("_bytes"), F.octet_length(line).alias("_line"), F.size(once(line)).alias("_first"), F.lower(F.col(keyword)).alias("_kw"), once(F.col(title)).alias("_terms"),
    )
    listed = F.when(F.array_contains("_terms", F.col("_kw")), F.col("_terms")).otherwise(F.array_append("_terms", F.col("_kw")))
    rows = rows.select(key, "_bytes", "_line", "_first", "_kw", F.size("_terms").alias("_n"), F.posexplode(listed).alias("_pos", "term"))
    share = lambda place, size: F.when(F.col(place), F.try_divide(F.octet_length("term"), F.col(size)))
    rows = rows.select("term", key, (F.col("_pos") < F.col("_first")).alias("main"), (F.col("_pos") < F.col("_n")).alias("title"), F.col("term").eqNullSafe(F.col("_kw")).alias("kw"), "_line", "_bytes")
    rows = rows.select("term", key, "main", "title", "kw", share("main", "_line").alias("m"), share("title", "_bytes").alias("t"))
    if docs.groupBy(key).count().where("count > 1").isEmpty():
        return rows
    return rows.groupBy("term", key).agg(*[F.bool_or(c).alias(c) for c in ("main", "title", "kw")], F.max("m").alias("m"), F.max("t").alias("t"))


def weigh_postings(found: DataFrame, key: str) -> DataFrame:
    """Postings (term, key, w_main, w_title, w_kw) of document_terms()."""
    weight = lambda on, w: F.when(F.col(on), w).otherwise(0.0)
    return found.select("term", key, weight("main", _steps(F.col("m"))).alias("w_main"), weight("title", _steps(F.col("t"))).alias("w_title"), weight("kw", F.lit(1.0)).alias("w_kw"))


def build_index(docs: DataFrame, key: str, title: str, keyword: str) -> DataFrame:
    """Postings (term, key, w_main, w_title, w_kw): the first line as main title, the text as title, the keyword whole."""
    return weigh_postings(document_terms(docs, key, title, keyword), key)


def join_idf(rows: DataFrame, idf: DataFrame) -> DataFrame:
    """Rows (term, ...) with their df and idf; terms without one are left out. Both tables are stored ones. Rows of a
    frequent term stay where they are: of terms that make up more than 1 / FREQUENT of all (term, document) pairs there are
    fewer than FREQUENT, which every task holds; the others' rows meet by the term."""
    total = idf.agg(F.sum("df")).first()[0] or 0
    often = F.col("df") * FREQUENT > total
    marked = rows.join(F.broadcast(idf.where(often)), "term", "left")
    return marked.where("df IS NOT NULL").unionByName(marked.where("df IS NULL").drop("df", "idf").join(idf.where(~often), "term"))


def tag_query(queries: DataFrame, key: str, column: str, dictionary: dict[str, int], unknown: int = 0) -> DataFrame:
    """(key, pos, term, attr) of texts: parted into dictionary words and what lies between, each part's terms inherit its
    attribute. A null or empty text has no terms."""
    spans = tag_spans(queries, key, column, dictionary, unknown)
    rows = spans.select(key, "ordinal", "attr", F.posexplode(terms(F.col("section"))).alias("_at", "term"))
    at = F.row_number().over(Window.partitionBy(key).orderBy("ordinal", "_at")) - 1
    return rows.select(key, at.alias("pos"), "term", "attr")


def search(
    query_terms: DataFrame, postings: DataFrame, key: str, page: int = 0, size: int = 10, scoring: Scoring = Scoring(),
    values: DataFrame | None = None, boosts: dict[str, float] | None = None, known: DataFrame | None = None,
) -> DataFrame:
    """Terms (query_id, pos, term, attr, idf, query_bytes) of many queries to a page of ranked documents each, with the
    number of all that match. Documents are scored block by block, and only those that can still reach a page; matches
    are never written down. known: the postings' terms; queries that can match nothing are then left out before any block
    meets them. With boosts, scores are adjusted by the documents' `values`, one row a document; a document
    without any has zeros."""
    queries, rows = _blocked(weigh_query(query_terms, scoring), postings, key, scoring, known=known)
    return best_documents(queries, rows, key, page, size, scoring.scale, values, boosts)


def _blocked(query_terms: DataFrame, postings: DataFrame, key: str, scoring: Scoring, raw: bool = False, known: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Weighed terms and postings as topk takes them; raw: with the postings' own weights; known: terms (term) of the
    postings, without which a query's terms, and queries that lack a mandatory one or have none, are left out."""
    main, kw, title = scoring.fields
    kinds = {attr: i + 1 for i, attr in enumerate(scoring.document)}
    share = lambda place: billionths(F.col("weight") * place)
    entry = F.struct("term", share(main).alias("main"), share(kw).alias("keyword"), share(title).alias("title"), _pick("attr", kinds, 0).alias("kind"), F.col("_counts").alias("counts"), *(["pos", "weight"] if raw else []))
    marked = _needed(query_terms)
    if known is None:
        queries = marked.groupBy("query_id").agg(F.max("_need").cast("int").alias("need"), F.collect_list(entry).alias("terms"))  # most_terms at most
    else:
        marked = marked.join(known.select("term", F.lit(True).alias("_known")), "term", "left")
        have = F.coalesce(F.sum(F.when(F.col("_known"), F.col("_counts"))), F.lit(0)).alias("have")
        queries = marked.groupBy("query_id").agg(F.max("_need").cast("int").alias("need"), have, F.collect_list(F.when(F.col("_known"), entry)).alias("terms"))
        queries = queries.where("size(terms) > 0 AND have = coalesce(need, 0)").drop("have")
    place = F.when(F.col("w_main") > 0, 3).when(F.col("w_kw") > 0, 2).when(F.col("w_title") > 0, 1).otherwise(0).cast("tinyint")
    weight = [billionths(F.greatest("w_main", "w_title") * a + F.col("w_kw") * b).alias(f"d{i}") for i, (a, b) in enumerate([scoring.other, *scoring.document.values()])]
    weight = [F.lit(0).cast("bigint").alias("d0"), "w_main", "w_title", "w_kw"] if raw else weight
    return queries, postings.where("term IS NOT NULL").select("term", key, place.alias("place"), *weight)


def find_documents(query_terms: DataFrame, postings: DataFrame, key: str) -> DataFrame:
    """intersect_terms() by blocks of documents: matches leave the task that finds them and are never shuffled."""
    return all_documents(*_blocked(query_terms, postings, key, Scoring()), key, "ids")


def score_documents(query_terms: DataFrame, postings: DataFrame, key: str, scoring: Scoring = Scoring()) -> DataFrame:
    """score() of retrieve() by blocks of documents."""
    return all_documents(*_blocked(query_terms, postings, key, scoring), key, "scores", scoring.scale)


def list_hits(query_terms: DataFrame, postings: DataFrame, key: str) -> DataFrame:
    """(query_id, key, term, pos, w_main, w_title, w_kw) of retrieve() by blocks of documents."""
    return all_documents(*_blocked(query_terms, postings, key, Scoring(), True), key, "hits")


def explain_documents(query_terms: DataFrame, postings: DataFrame, key: str) -> DataFrame:
    """explain_scores() of retrieve() by blocks of documents."""
    return all_documents(*_blocked(query_terms, postings, key, Scoring(), True), key, "why")


def lookup_idf(terms: DataFrame, idf: DataFrame) -> DataFrame:
    return terms.join(small(idf.select("term", "idf")), "term", "left").na.fill(0.0, ["idf"])


def search_texts(
    queries: DataFrame, key: str, column: str, dictionary: dict[str, int], postings: DataFrame, idf: DataFrame, document: str, page: int = 0, size: int = 10,
    scoring: Scoring = Scoring(), values: DataFrame | None = None, boosts: dict[str, float] | None = None,
) -> DataFrame:
    """From raw queries (key, text; a key is one query) to pages of documents: texts are tagged by the dictionary, their
    terms weighed by the corpus' idf (0 where it lacks one) and searched. A null or empty query finds nothing."""
    queries = queries.select(F.col(key).alias("query_id"), F.col(column).alias("_text"))
    terms = tag_query(queries, "query_id", "_text", dictionary, UNKNOWN)
    terms = terms.join(queries.select("query_id", F.octet_length("_text").alias("query_bytes")), "query_id")
    known = postings.select("term").distinct()
    return search(lookup_idf(terms, idf), postings, document, page, size, scoring, values, boosts, known).withColumnRenamed("query_id", key)
