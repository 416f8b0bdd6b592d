"""Benchmark decontamination with a generalised suffix automaton of the test items.

The words of all items build one automaton; the words of each document stream through it, and the length of the
longest match that ends at each word tells which words lie in a test passage.

A benchmark of up to BLOCK_CHARS goes to the tasks whole. A larger one is taken in blocks, one after another: the driver
holds one block at a time, a job streams all rows through its automaton and writes the rows that it hits, and the hits
of all blocks meet, by the row and not by its doc_id, before anything is judged or cut. Both ways give the same rows.

Inputs and edge cases: a null or empty text has no words and no hits; an item without words is ignored; an item of
fewer than `window` words counts only whole; equal items are each reported; a text of any length is scanned whole;
an empty benchmark hits nothing; rows that share a doc_id are scanned one by one. Other columns pass through clean()
untouched, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.sources.scratch import Scratch

WINDOW = 10
#: clean(): a run of hit words at least this long is cut, and so are a run that holds a whole short item, however few
#: its words, and any run in a text with more than this share hit.
MIN_RUN, MAX_COVERAGE = 10, 0.5
#: Characters of items in one automaton; a larger benchmark is scanned in several blocks.
BLOCK_CHARS = 1 << 21
#: A-Z become a-z; what is neither letter, digit nor beyond ASCII becomes a space.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


class SuffixAutomaton:
    """Of several sequences of words. State 0 is the root; a state stands for the substrings that end alike."""

    def __init__(self, items: list[tuple[int, bytes]], window: int = WINDOW):
        self.window, self.ids = window, {}
        self.next, self.link, self.length = [{}], [-1], [0]
        sequences = []
        for item, text in items:
            if seq := [self.ids.setdefault(w, len(self.ids)) for w in words_of(text)]:
                sequences.append((item, seq))
                last = 0
                for token in seq:
                    last = self._extend(last, token)
        n = len(self.next)
        self.owners = [None] * n  # of the state's substring of `window` words: the items that have it
        self.short = [()] * n  # (words, item) of whole short items that end as the state's substrings do
        own_short: dict[int, list] = {}
        for item, seq in sequences:
            state = length = 0
            for token in seq:
                state, length = self.next[state][token], length + 1
                while length > window and self.length[self.link[state]] >= window:
                    state = self.link[state]
                length = min(length, self.length[state])
                if length >= window:
                    at = state
                    while self.length[self.link[at]] >= window:
                        at = self.link[at]
                    if self.owners[at] is None:
                        self.owners[at] = set()
                    self.owners[at].add(item)
            if len(seq) < window:
                state = 0
                for token in seq:
                    state = self.next[state][token]
                while self.length[self.link[state]] >= len(seq):
                    state = self.link[state]
                own_short.setdefault(state, []).append((len(seq), item))
        self.holder = [0] * n  # the state that holds the suffix of `window` words
        for state in sorted(range(1, n), key=self.length.__getitem__):
            up = self.link[state]
            self.short[state] = self.short[up] + tuple(sorted(own_short.get(state, ())))
            self.holder[state] = self.holder[up] if self.length[up] >= window else state

    def _extend(self, last: int, token: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        if token in nxt[last]:
            return self._split(last, token, nxt[last][token])
        new = len(nxt)
        nxt.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and token not in nxt[p]:
            nxt[p][token] = new
            p = link[p]
        if p >= 0:
            link[new] = self._split(p, token, nxt[p][token])
        return new

    def _split(self, p: int, token: int, q: int) -> int:
        """The state of p's longest substring and the token: q, or q's part that is no longer than that."""
        if self.length[p] + 1 == self.length[q]:
            return q
        clone = len(self.next)
        self.next.append(dict(self.next[q]))
        self.length.append(self.length[p] + 1)
        self.link.append(self.link[q])
        self.link[q] = clone
        while p >= 0 and self.next[p].get(token) == q:
            self.next[p][token] = clone
            p = self.link[p]
        return clone

    def scan(self, words: list[bytes]) -> tuple[list[list[int]], set[int], int]:
        """Runs [first, end) of hit words and whether each holds a whole short item, the items met, and the
        longest match of `window` words or more (else 0)."""
        runs, items, longest = [], set(), 0
        nxt, link, length, short, window = self.next, self.link, self.length, self.short, self.window
        state = matched = 0
        for i, token in enumerate(map(self.ids.get, words)):
            if token is None:
                state = matched = 0
                continue
            while state and token not in nxt[state]:
                state = link[state]
                matched = length[state]
            if token in nxt[state]:
                state = nxt[state][token]
                matched += 1
            cover, whole = 0, False
            if matched >= window:
                items |= self.owners[self.holder[state]]
                cover, longest = window, max(longest, matched)
            if short[state]:
                for n, item in short[state]:
                    if n <= matched:
                        items.add(item)
                        cover, whole = max(cover, n), True
            if cover:
                first = i + 1 - cover
                while runs and runs[-1][0] >= first:
                    whole |= runs.pop()[2]
                if runs and first <= runs[-1][1]:
                    runs[-1][1:] = i + 1, runs[-1][2] or whole
                else:
                    runs.append([first, i + 1, whole])
        return runs, items, longest


def _items(benchmark: DataFrame) -> tuple[DataFrame, int]:
    """The items, and how many blocks of about BLOCK_CHARS they make."""
    items = benchmark.where(F.length("text") > 0).select(F.col("item_id").cast("bigint").alias("item_id"), "text")
    return items, -(-(items.agg(F.sum(F.length("text"))).first()[0] or 0) // BLOCK_CHARS) or 1


def _block(items: DataFrame, n: int, b: int) -> list[tuple[int, bytes]]:
    """Block b of n, on the driver: all rows of an item are in one block, whose size the number of blocks bounds."""
    part = items.where(F.pmod(F.xxhash64("item_id"), F.lit(n)) == b) if n > 1 else items
    return [(r.item_id, r.text.encode()) for r in part.collect()]


_RUN = pa.struct([("first", pa.int64()), ("end", pa.int64()), ("whole", pa.bool_())])
_FIELDS = {"n_words": pa.int64(), "item_ids": pa.list_(pa.int64()), "runs": pa.list_(_RUN), "longest": pa.int64()}
_FOUND = "n_words bigint, item_ids array<bigint>, runs array<struct<first:bigint,end:bigint,whole:boolean>>, longest bigint"
_ROW = "_sluice_row"


def _scan(rows: DataFrame, key: str, items: list[tuple[int, bytes]], window: int, hits_only: bool) -> DataFrame:
    """The key of each row (of key and text), and what an automaton of the items finds in its text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = SuffixAutomaton(items, window)
        for b in batches:
            out = []
            for name, text in zip(b[key].to_pylist(), b["text"]):
                words = words_of(text.as_py() or b"")
                runs, found, longest = automaton.scan(words)
                if runs or not hits_only:
                    out.append((name, len(words), sorted(found), [dict(zip(("first", "end", "whole"), r)) for r in runs], longest))
            columns = zip(*out, strict=True) if out else [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.int64(), *_FIELDS.values()], strict=True)], [key, *_FIELDS])

    return rows.select(key, F.col("text").cast("binary").alias("text")).mapInArrow(run, f"{key} bigint, {_FOUND}")


def merged(runs: list[tuple[int, int, bool]]) -> list[list]:
    """Runs that meet or overlap as one, which holds a whole short item if one of them does."""
    out: list[list] = []
    for first, end, whole in sorted(runs):
        if out and first <= out[-1][1]:
            out[-1][1:] = max(end, out[-1][1]), whole or out[-1][2]
        else:
            out.append([first, end, whole])
    return out


def _scan_blocks(rows: DataFrame, items: DataFrame, n: int, window: int, scratch: Scratch) -> DataFrame:
    """_scan() of stored rows with a key _ROW for n blocks: every row that any block hits, once."""
    parts = [scratch.save(_scan(rows, _ROW, _block(items, n, b), window, True), f"hits-{b}") for b in range(n)]
    hits = rows.sparkSession.read.schema(parts[0].schema).parquet(*[scratch.paths[id(p)][0] for p in parts])
    hits = hits.groupBy(_ROW).agg(
        F.max("n_words").alias("n_words"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("item_ids")))).alias("item_ids"),
        F.flatten(F.collect_list("runs")).alias("runs"), F.max("longest").alias("longest"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            runs = [[dict(zip(("first", "end", "whole"), r)) for r in merged([(x["first"], x["end"], x["whole"]) for x in row])] for row in b["runs"].to_pylist()]
            yield b.set_column(b.schema.get_field_index("runs"), "runs", pa.array(runs, pa.list_(_RUN)))

    return hits.mapInArrow(run, f"{_ROW} bigint, {_FOUND}")


def _keyed(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """The rows with a number of their own, which stays as they are stored."""
    return scratch.save(docs.withColumn(_ROW, F.monotonically_increasing_id()), "rows")


def matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_hit, item_ids, runs (of hit words: first, end), longest (match of `window` words or more, else 0) of each document."""
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    items, n = _items(benchmark)
    if n == 1:
        out = _scan(docs, "doc_id", _block(items, 1, 0), window, False)
    else:
        scratch = Scratch(docs.sparkSession, "decontam")
        rows = _keyed(docs, scratch)
        words = _scan(rows, _ROW, [], window, False).select(_ROW, F.col("n_words").alias("all_words"))
        hits = _scan_blocks(rows, items, n, window, scratch).drop("n_words")
        out = rows.select(_ROW, "doc_id").join(words, _ROW).join(hits, _ROW, "left").select(
            "doc_id", F.col("all_words").alias("n_words"), F.coalesce("item_ids", F.array().cast("array<bigint>")).alias("item_ids"),
            F.coalesce("runs", F.array().cast("array<struct<first:bigint,end:bigint,whole:boolean>>")).alias("runs"), F.coalesce("longest", F.lit(0).cast("bigint")).alias("longest"),
        )
    hit = F.aggregate("runs", F.lit(0).cast("bigint"), lambda n, r: n + r["end"] - r["first"])
    spans = F.transform("runs", lambda r: F.struct(r["first"].alias("first"), r["end"].alias("end")))
    return out.select("doc_id", "n_words", hit.alias("n_hit"), "item_ids", spans.alias("runs"), "longest")


def cut(text: str, runs: list[list[int]]) -> str:
    """The text without the words of the runs; what stood between two of them goes too."""
    data = text.encode()
    places = [m.span() for m in _WORD.finditer(data)]
    out, end = [], 0
    for first, last, *_ in runs:
        out.append(data[end : places[first][0]])
        end = places[last - 1][1]
    return b"".join([*out, data[end:]]).decode()


class _Rule:
    """Which runs of a text are cut, and whether anything is left of it."""

    def __init__(self, min_run: int, max_coverage: float):
        self.min_run, self.max_coverage = min_run, max_coverage

    def apply(self, text: str | None, n_words: int, runs: list[list]) -> tuple[str | None, bool]:
        if runs and sum(y - x for x, y, _ in runs) <= self.max_coverage * n_words:
            runs = [r for r in runs if r[2] or r[1] - r[0] >= self.min_run]
        if not runs:
            return text, True
        return cut(text, runs), sum(y - x for x, y, _ in runs) < n_words


def _rewritten(b: pa.RecordBatch, texts: list[str | None]) -> pa.RecordBatch:
    b = b.set_column(b.schema.get_field_index("text"), b.schema.field("text"), pa.array(texts, b.schema.field("text").type))
    if (at := b.schema.get_field_index("n_chars")) >= 0:
        b = b.set_column(at, b.schema.field("n_chars"), pa.array([None if t is None else len(t) for t in texts], b.schema.field("n_chars").type))
    return b


def clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, min_run: int = MIN_RUN, max_coverage: float = MAX_COVERAGE) -> DataFrame:
    """The documents without test passages: runs of min_run words or more are cut out of a text, and runs of any length
    that hold a whole item of fewer than `window` words (an item of one word goes wherever it stands), and all its runs
    if more than max_coverage of its words are hit. With min_run up to `window`, all that matches() hits is cut. A text
    of which no word is left goes; a text without hits stays as it is, a null text included. n_chars, where there is
    such a column, follows the text."""
    items, n = _items(benchmark)
    rule, schema = _Rule(min_run, max_coverage), docs.schema
    if n == 1:
        block = _block(items, 1, 0)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            automaton = SuffixAutomaton(block, window)
            for b in batches:
                texts, keep, changed = b["text"].to_pylist(), [], False
                for i, text in enumerate(texts):
                    words = words_of((text or "").encode())
                    runs = automaton.scan(words)[0]
                    texts[i], left = rule.apply(text, len(words), runs)
                    keep.append(left)
                    changed = changed or bool(runs)
                yield (_rewritten(b, texts) if changed else b).filter(pa.array(keep, pa.bool_()))

        return docs.mapInArrow(run, schema)
    scratch = Scratch(docs.sparkSession, "decontam")
    rows = _keyed(docs, scratch)
    hits = _scan_blocks(rows, items, n, window, scratch).select(_ROW, F.struct("n_words", "runs").alias("_sluice_hits"))

    def cut_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, keep = b["text"].to_pylist(), []
            for i, (text, h) in enumerate(zip(texts, b["_sluice_hits"].to_pylist())):
                texts[i], left = rule.apply(text, h["n_words"], [[r["first"], r["end"], r["whole"]] for r in h["runs"]]) if h else (text, True)
                keep.append(left)
            yield _rewritten(b.select(schema.names), texts).filter(pa.array(keep, pa.bool_()))

    return rows.join(hits, _ROW, "left").drop(_ROW).mapInArrow(cut_all, schema)


def op1_decontaminate(spark, sf_dir: str) -> DataFrame:
    found = matches(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    items = F.array_join(F.array_sort(F.transform("item_ids", lambda x: x.cast("string"))), ",")
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("item_ids").cast("bigint").alias("n_items"), F.sha2(items, 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"), "longest",
    )


_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORDS = rf"regexp_extract_all(translate(coalesce(text, ''), '{_UP}', '{_LOW}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
QUERIES = {"op1_decontaminate": lambda spark, sf_dir: op1_decontaminate(spark, sf_dir).drop("longest")}
SQL = {"op1_decontaminate": f"""
WITH iw AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS s
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS i FROM iw WHERE len(w) > 0)),
d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
pos AS (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d), (SELECT DISTINCT n FROM win) WHERE i + n - 1 <= len(w)),
hit AS (SELECT doc_id, i, pos.n, item_id FROM pos JOIN win ON pos.s = win.s AND pos.n = win.n),
nh AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS x FROM hit) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN nh ON d.doc_id = nh.doc_id LEFT JOIN it ON d.doc_id = it.doc_id"""}
