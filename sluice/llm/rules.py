"""Quality rules: a table of thresholds compiled into one projection, without user functions.

Inputs and edge cases: a null text counts as a text without words; a text of any length is measured whole; equal
rows get equal verdicts; other columns of the input, whatever their names, are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Frequent function words of the languages served.
STOP_WORDS = {
    "en": "the be to of and that have with a in for is it was on are as by this from or an not at".split(),
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an".split(),
    "fr": "de la le et les des en un du une que est pour qui dans par sur pas au avec ce il plus".split(),
    "es": "de la que el en y a los del se las por un para con no una su al lo como más o".split(),
}
SPACE = r"[ \t\n\x0B\f\r]+"
#: Places of a word that fit beside a hash in one number; a text with more words is compared without hashes.
_PLACE_BITS = 24


@dataclass(frozen=True)
class Threshold:
    """A text passes if low <= value <= high; a bound of None is open. `value` names a measure or a ratio of two."""

    rule: str
    value: str
    low: float | None = None
    high: float | None = None


#: Lengths, symbols, stop words, lines: the limits in production.
THRESHOLDS = (
    Threshold("words", "n_words", low=50),
    Threshold("repeats", "n_repeat_words / n_words", high=0.5),
    Threshold("word_length", "word_chars / n_words", low=2, high=16),
    Threshold("symbols", "n_symbols / n_words", high=0.8),
    Threshold("stop_words", "n_stop_words", low=2),
    Threshold("lines", "n_dup_lines / n_lines", high=0.7),
)


def measures(docs: DataFrame) -> DataFrame:
    """doc_id with n_words, word_chars, n_symbols, n_lines (with a word), n_dup_lines, n_stop_words, n_repeat_words.

    Repeated three-word windows: 40 bits of each window's hash are sorted beside its place; windows whose bits meet a
    neighbour's are sorted again as text, so that the count is exact at the cost of hashes only.
    """
    mask = (1 << _PLACE_BITS) - 1
    stop = sorted({w for words in STOP_WORDS.values() for w in words})
    at = lambda a, i: F.get(F.col(a), i)
    window = lambda i: [at("_w", i), at("_w", i + 1), at("_w", i + 2)]
    n = F.size("_w")
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(F.col("_t"), "\n"), lambda x: x.rlike(r"[^ \t\n\x0B\f\r]"))
    words = docs.select("doc_id", text.alias("_t"), F.array_remove(F.split(text, SPACE), "").alias("_w"))
    hashed = words.select(
        "doc_id", "_w", n.cast("bigint").alias("n_words"),
        F.length(F.array_join("_w", "")).cast("bigint").alias("word_chars"),
        (F.length("_t") - F.length(F.regexp_replace("_t", "[#*$%&|<>]", ""))).cast("bigint").alias("n_symbols"),
        lines.alias("_l"),
        F.size(F.filter("_w", lambda x: F.lower(x).isin(stop))).cast("bigint").alias("n_stop_words"),
        F.when(n < 3, F.array().cast("array<bigint>")).when(
            n < mask, F.sort_array(F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(*window(i)).bitwiseAND(F.lit(~mask)).bitwiseOR(i.cast("bigint"))))
        ).otherwise(F.transform(F.sequence(F.lit(0), n - 3), lambda i: i.cast("bigint"))).alias("_h"),
    )
    bits = lambda x: F.shiftright(x, _PLACE_BITS)
    meets = lambda x, i: F.coalesce(bits(x) == bits(at("_h", i - 1)), F.lit(False)) | F.coalesce(bits(x) == bits(at("_h", i + 1)), F.lit(False))
    place = lambda x: x.bitwiseAND(F.lit(mask)).cast("int")
    texts = F.sort_array(F.transform(F.filter("_h", meets), lambda x: F.struct(F.concat_ws(" ", *window(place(x))).alias("s"), place(x).alias("p"))))
    compared = hashed.withColumn("_s", texts)
    same = lambda x, i: F.coalesce(x["s"] == at("_s", i - 1)["s"], F.lit(False)) | F.coalesce(x["s"] == at("_s", i + 1)["s"], F.lit(False))
    places = F.sort_array(F.transform(F.filter("_s", same), lambda x: x["p"]))
    covered = F.aggregate(
        places, F.struct(F.lit(-3).alias("last"), F.lit(0).cast("bigint").alias("n")),
        lambda a, p: F.struct(p.alias("last"), (a["n"] + F.least(F.lit(3), p - a["last"])).cast("bigint").alias("n")), lambda a: a["n"],
    )
    return compared.select(
        "doc_id", "n_words", "word_chars", "n_symbols", F.size("_l").cast("bigint").alias("n_lines"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("bigint").alias("n_dup_lines"), "n_stop_words", covered.alias("n_repeat_words"),
    )


def compile_rules(thresholds: tuple[Threshold, ...]) -> Column:
    """The names of the rules that a row of measures breaks, as one array expression.

    A ratio is compared by multiplying out, so that a text without words or lines has no ratio to break.
    """
    broken = []
    for t in thresholds:
        over, _, under = (x.strip() for x in t.value.partition("/"))
        scale = F.col(under) if under else F.lit(1)
        wrong = F.lit(False)
        if t.low is not None:
            wrong = wrong | (F.col(over) < scale * F.lit(float(t.low)))
        if t.high is not None:
            wrong = wrong | (F.col(over) > scale * F.lit(float(t.high)))
        broken.append(F.when(wrong, F.lit(t.rule)))
    return F.array_compact(F.array(*broken))


def apply_rules(docs: DataFrame, thresholds: tuple[Threshold, ...] = THRESHOLDS) -> DataFrame:
    """The measures of every document, with broken_rules (an array) and kept (no rule is broken)."""
    return measures(docs).withColumn("broken_rules", compile_rules(thresholds)).withColumn("kept", F.size("broken_rules") == 0)


def op4_quality_rules(spark, sf_dir: str) -> DataFrame:
    out = apply_rules(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return out.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"),
        (~failed & F.col("kept")).alias("kept"), "n_stop_words", F.array_join("broken_rules", ",").alias("broken_rules"),
    )


def _sql() -> str:
    stop = ", ".join(f"'{w}'" for w in sorted({w for words in STOP_WORDS.values() for w in words}))
    rules = []
    for t in THRESHOLDS:
        over, _, under = (x.strip() for x in t.value.partition("/"))
        tests = [f"{over} {sign} {under or 1} * {float(bound)}::DOUBLE" for sign, bound in (("<", t.low), (">", t.high)) if bound is not None]
        rules.append(f"CASE WHEN {' OR '.join(tests)} THEN '{t.rule}' END")
    return rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) >= 3)),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, s) AS c FROM win) WHERE c > 1),
cov AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM rep) GROUP BY doc_id),
li AS (SELECT doc_id, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
m AS (SELECT d.doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
  len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols, len(l)::BIGINT AS n_lines, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
  len(list_filter(w, lambda x: lower(x) IN ({stop})))::BIGINT AS n_stop_words, coalesce(n, 0)::BIGINT AS n_repeat_words
  FROM d JOIN li ON d.doc_id = li.doc_id LEFT JOIN cov ON d.doc_id = cov.doc_id),
r AS (SELECT *, concat_ws(',', {', '.join(rules)}) AS broken_rules, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND broken_rules = '' AS kept, n_stop_words, broken_rules FROM r
"""


QUERIES = {"op4_quality_rules": op4_quality_rules}
SQL = {"op4_quality_rules": _sql()}
