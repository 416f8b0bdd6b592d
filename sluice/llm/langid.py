"""Language identification by compression: the language whose dictionary encodes a text in the fewest bytes.

Each language has a zstandard raw-content dictionary of excerpts from labelled texts. A text, reduced to lower-case
letters, is encoded whole, in blocks, by each dictionary; the smallest sum wins. Where the next is near, a slower
coder encodes the text again; if it is near still, the text is rejected.

Inputs and edge cases: a null text, or one without a letter (of Unicode category L), is `und`, score 0, rejected. Ties go to the language with
more labelled texts, then to the first name. Equal rows get equal results; an input without labelled rows gives `und`
everywhere. Only doc_id, text and lang are read, the last for learning only.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
import regex
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: For each language: so many excerpts of so many characters at most make its dictionary (64 KB and more).
EXCERPTS, EXCERPT_CHARS = 96, 1000
BLOCK = 2048
#: Settings of the two coders; short matches count, as texts of one language share syllables more than words.
COARSE = {"min_match": 3}
FINE = {"min_match": 3, "strategy": zstandard.STRATEGY_BTOPT, "search_log": 4}
LEVEL = 5
#: Bytes by which the next language must be longer, as a share of the smallest code: else the fine coder is asked, or
#: the text is rejected. It is rejected too if it is not longer by MARGIN_BYTES.
NEAR, MARGIN, MARGIN_BYTES = 0.05, 0.003, 1
#: Languages at most: the dictionaries go to every task, and each encodes every text.
MAX_LANGUAGES = 256
_NOT_LETTERS = regex.compile(r"\P{L}+")


def letters(text: str) -> str:
    """Runs of letters (Unicode category L; numerals and marks are none) in lower case, a space between them."""
    return _NOT_LETTERS.sub(" ", text.lower()).strip()


def learn(labelled: DataFrame, excerpts: int = EXCERPTS, chars: int = EXCERPT_CHARS) -> dict[str, str]:
    """language -> text of its dictionary, the commonest language first.

    Of each language and each of `excerpts` hash buckets, the text with the least hash gives one excerpt, so that the
    sample is spread over the whole corpus, takes copies once, and is bounded by excerpts * chars for a language. More
    than MAX_LANGUAGES languages are an error.
    """
    if len(labelled.where("lang IS NOT NULL").select("lang").distinct().limit(MAX_LANGUAGES + 1).collect()) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages; their dictionaries would not fit a task")
    rows = labelled.where(F.col("lang").isNotNull() & (F.length("text") > 0)).select("lang", "text", F.xxhash64("text").alias("h"))
    rows = rows.withColumn("bucket", F.pmod("h", F.lit(excerpts)))
    least = rows.groupBy("lang", "bucket").agg(F.min("h").alias("h"), F.count("*").alias("n"))
    start = F.pmod(F.xxhash64("h"), F.greatest(F.length("text") - chars, F.lit(1))).cast("int") + 1
    found = rows.join(F.broadcast(least), ["lang", "bucket", "h"])  # MAX_LANGUAGES * excerpts rows at most
    found = found.select("lang", "bucket", "n", F.substring("text", start, F.lit(chars)).alias("x")).dropDuplicates(["lang", "bucket"]).collect()
    texts: dict[str, list] = {}
    for r in sorted(found, key=lambda r: (r.lang, r.bucket)):
        texts.setdefault(r.lang, []).append((r.n, letters(r.x)))
    order = sorted(texts, key=lambda k: (-sum(n for n, _ in texts[k]), k))
    return {k: " ".join(x for _, x in texts[k]) for k in order}


class Classifier:
    def __init__(self, dictionaries: dict[str, str]):
        self.names = list(dictionaries)
        self.coarse, self.fine = ([self._coder(text.encode() or b" ", how) for text in dictionaries.values()] for how in (COARSE, FINE))

    @staticmethod
    def _coder(data: bytes, how: dict):
        found = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        how = zstandard.ZstdCompressionParameters.from_level(LEVEL, dict_size=len(data), source_size=BLOCK, write_content_size=0, write_checksum=0, write_dict_id=0, **how)
        found.precompute_compress(compression_params=how)
        return zstandard.ZstdCompressor(dict_data=found, compression_params=how).compress

    @staticmethod
    def _judge(coders: list, blocks: list[bytes]) -> tuple[list[int], int, int]:
        """Bytes by language, the first with the fewest, and by how many the next is longer."""
        sizes = [sum(len(code(b)) for b in blocks) for code in coders]
        best = sizes.index(min(sizes))
        return sizes, best, min((x for i, x in enumerate(sizes) if i != best), default=2 * sizes[best]) - sizes[best]

    def __call__(self, text: str | None) -> tuple[str, float, bool]:
        text = letters(text or "")
        if not text or not self.names:
            return "und", 0.0, True
        data = text.encode(errors="replace")
        blocks = [data[i : i + BLOCK] for i in range(0, len(data), BLOCK)]
        sizes, best, margin = self._judge(self.coarse, blocks)
        if margin < NEAR * sizes[best]:
            sizes, best, margin = self._judge(self.fine, blocks)
        scale = max(1.0, 0.01 * sizes[best])
        score = 1 / sum(math.exp(max(-50.0, (sizes[best] - x) / scale)) for x in sizes)
        return self.names[best], score, margin < max(MARGIN_BYTES, MARGIN * sizes[best])


def identify(docs: DataFrame, dictionaries: dict[str, str]) -> DataFrame:
    """doc_id, lang_pred, score (0 to 1), rejected (the margin is narrow, or nothing to judge) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classify = Classifier(dictionaries)
        for b in batches:
            found = [classify(x.as_py()) for x in b["text"]]
            yield pa.RecordBatch.from_arrays(
                [b["doc_id"].cast(pa.int64()), pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64()), pa.array([x[2] for x in found], pa.bool_())],
                ["doc_id", "lang_pred", "score", "rejected"],
            )

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, "doc_id bigint, lang_pred string, score double, rejected boolean")


def drop_rejected(docs: DataFrame, dictionaries: dict[str, str]) -> DataFrame:
    """The documents whose language is told; rows and columns pass through as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classify = Classifier(dictionaries)
        for b in batches:
            yield b.filter(pa.array([not classify(x.as_py())[2] for x in b["text"]], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def held_out(divisor: int, remainder: int):
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % divisor == remainder


def op9_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    found = identify(docs, learn(docs.where(~held_out(4, 2))))
    return found.select("doc_id", held_out(4, 2).alias("held_out"), "lang_pred", "score", "rejected")


QUERIES = {"op9_language_id": op9_language_id}
SQL: dict[str, str] = {}
