"""Token counts of whole texts, without their ids: batches of equal bytes go to the tokenizer, lengths alone come back.

A long text is cut at safe boundaries, so that no call holds more than about CHUNK characters of it. With a piece model
a place is safe if none of its pieces has the two characters around it side by side: no merge can reach over it. The
model puts a space before all that it is given, so every later part is given with a fence before it, a character that
no piece has beside another one, whose own tokens are taken off again. With a vocabulary of `tokenizers`, which parts
texts at white space before it merges, a single space between two letters of A-Z, a-z is safe.

Inputs and edge cases: a null or empty text has no tokens; a text without a safe boundary is encoded whole; special
strings in texts are what the library makes of them; rows that share a doc_id are counted one by one; an empty table
gives no rows; only doc_id and text are read. Nothing is shuffled.
"""

from __future__ import annotations

import functools
import os
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters of a part of a long text, and bytes of text that one call encodes.
CHUNK, BATCH_BYTES = 1 << 14, 1 << 20
_SPACE = "▁"
_BETWEEN_LETTERS = re.compile(r"(?<=[A-Za-z]) (?=[A-Za-z])")


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


#: Text that a model which normalises texts, or drops white space, would change.
_PROBE = "  \ufb01  \uff21 a\u0301 "


class PieceCounter:
    """Counts by a sentencepiece model. Texts of a model that normalises them are never cut."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.beside = {p[i : i + 2] for p in pieces for i in range(len(p) - 1)}
        inside = {c for pair in self.beside for c in pair}
        plain = self.model.decode(self.model.encode(_PROBE)) == _PROBE
        self.fence = next((c for c in "\n\t\x01\x02" if plain and c not in inside), "")
        self.own = len(self.model.encode(self.fence))

    def lengths(self, parts: list[str], later: list[bool]) -> list[int]:
        """later: parts that are not the first of their text."""
        ids = self.model.encode([self.fence + p if x else p for p, x in zip(parts, later, strict=True)], num_threads=1)
        return [len(i) - self.own * x for i, x in zip(ids, later, strict=True)]

    def cuts(self, text: str, chunk: int) -> Iterator[int]:
        """Safe places, the last one in each `chunk` characters, or else the first after them."""
        safe = lambda i: text[i - 1 : i + 1].replace(" ", _SPACE) not in self.beside
        at = 0
        while self.fence and len(text) - at > chunk:
            ahead = next((i for i in range(at + chunk, at, -1) if safe(i)), None) or next((i for i in range(at + chunk + 1, len(text)) if safe(i)), None)
            if ahead is None:
                return
            yield ahead
            at = ahead


class WordCounter:
    """Counts by a file of the tokenizers library whose rules do not look over white space."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks are the parallel ones
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.model.no_truncation()
        self.model.no_padding()

    def lengths(self, parts: list[str], later: list[bool]) -> list[int]:
        return [len(x.ids) for x in self.model.encode_batch(parts, add_special_tokens=False)]

    def cuts(self, text: str, chunk: int) -> Iterator[int]:
        at = 0
        while len(text) - at > chunk:
            ends = [m.start() for m in _BETWEEN_LETTERS.finditer(text, at + 1, at + chunk + 2)]  # the window's last character is only looked at
            found = ends[-1] if ends else next((m.start() for m in _BETWEEN_LETTERS.finditer(text, at + 1)), None)
            if found is None:
                return
            yield found
            at = found


@functools.lru_cache(2)
def counter(path: str) -> PieceCounter | WordCounter:
    """What a Python worker loads once, for all its tasks."""
    return PieceCounter(path) if path.endswith(".model") else WordCounter(path)


def count_texts(texts: list[str | None], how: PieceCounter | WordCounter, chunk: int = CHUNK, batch_bytes: int = BATCH_BYTES) -> list[int]:
    """The number of tokens of each text."""
    out = [0] * len(texts)
    parts: list[str] = []
    owners: list[int] = []
    later: list[bool] = []
    held = 0

    def flush() -> None:
        nonlocal held
        for i, n in zip(owners, how.lengths(parts, later), strict=True):
            out[i] += n
        parts.clear(), owners.clear(), later.clear()
        held = 0

    for i, text in enumerate(texts):
        if not text:
            continue
        at = 0
        for end in (*(how.cuts(text, chunk) if len(text) > chunk else ()), len(text)):
            parts.append(text[at:end])
            owners.append(i)
            later.append(at > 0)
            held += 4 * (end - at) if not parts[-1].isascii() else end - at
            at = end
            if held >= batch_bytes:
                flush()
    if parts:
        flush()
    return out


def count_tokens(docs: DataFrame, path: str | None = None, chunk: int = CHUNK) -> DataFrame:
    """doc_id, n_bytes, n_tokens of every row of docs (doc_id, text)."""
    path = path or vocabulary_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        how = counter(path)
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                n = count_texts(part["text"].to_pylist(), how, chunk)
                yield pa.RecordBatch.from_arrays([part["doc_id"], part["n_bytes"], pa.array(n, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    size = F.coalesce(F.octet_length("text").cast("bigint"), F.lit(0).cast("bigint"))
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"), size.alias("n_bytes"))
    return rows.mapInArrow(run, "doc_id bigint, n_bytes bigint, n_tokens bigint")


def over_limit(counts: DataFrame, limit: int = 4096) -> DataFrame:
    return counts.withColumn("over_limit", F.col("n_tokens") > limit)


def op13_token_counts(spark, sf_dir: str) -> DataFrame:
    return over_limit(count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet")))


QUERIES = {"op13_token_counts": op13_token_counts}
SQL: dict[str, str] = {}
