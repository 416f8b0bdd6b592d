"""Removal of repeated byte strings, by blockwise sorting of suffixes with a difference cover.

Only equality over the first `length` bytes of two suffixes matters, so suffixes are compared by ranks: fingerprints of
fixed length. The places of a difference cover D modulo V are sampled: any two places i and j have a shift k < V after
which both are in the sample. The cover sample's ranks (over length - V + 1 bytes) are computed and sorted first, one
bucket of ranks at a time; a suffix can have an equal elsewhere only if, within V places, a sampled rank occurs twice.
Those suffixes - the long ties - get their rank over `length` bytes, are sorted one bucket at a time in turn, and all
but the first of equal ones are repeats. A task holds one block of texts or one bucket of ranks, both of bounded size;
a string that fills many texts counts once in each block, so that a hot passage is one record a block.

Ranks are 64-bit fingerprints. Two different strings share one with a chance of 2^-64; among n candidate suffixes some
pair does with about n^2 / 2^65 (under one in ten thousand at 30 million; at 5 billion, 0.7 such pairs are expected).
Nothing confirms equality by bytes or by the sample's ranks, and ranks cannot be made wider.

Inputs and edge cases: a null text has no bytes; a text shorter than `length` keeps all; matches never cross texts; of
equal strings the one in the smallest doc_id, then at the earliest start, stays; rows that share a doc_id count as
texts of their own, in order of their bytes; texts of any length are treated whole; an empty table gives no rows. Other
columns pass through remove_repeats() untouched.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.sources.scratch import Scratch

LENGTH = 100
#: A perfect difference set: modulo 57, every difference occurs. Fixed values.
V, COVER = 57, (0, 1, 3, 13, 32, 36, 43, 52)
#: Bytes of text in a block; ranks in a bucket; starts looked at in one go (a multiple of V).
BLOCK_BYTES, BUCKET_RANKS, SEGMENT = 8 << 20, 2 << 20, V << 14
#: Ranges of suffix ranks that are sorted one after another.
PASSES = 3
_BLOCK = "_sluice_block"


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out)


class Ranks:
    """Fingerprints of the fixed-length substrings of a text: polynomials modulo 2^64 in an odd base, mixed."""

    def __init__(self, length: int):
        if length < V + 8:
            raise ValueError(f"length must be {V + 8} at least")
        self.length, self.sample_length = length, length - V + 1
        base = 0x9E3779B97F4A7C15
        n = SEGMENT + length
        self.up, self.down = _powers(base, n), _powers(pow(base, -1, 1 << 64), n)
        self.byte = np.random.default_rng(57).integers(1, 1 << 63, 256, dtype=np.uint64)
        self.sample = np.flatnonzero(np.isin(np.arange(n) % V, COVER))

    def sums(self, data: np.ndarray) -> np.ndarray:
        out = np.empty(len(data) + 1, np.uint64)
        out[0] = 0
        np.cumsum(self.byte[data] * self.up[: len(data)], out=out[1:])
        return out

    def at(self, sums: np.ndarray, places: np.ndarray, length: int) -> np.ndarray:
        x = (sums[places + length] - sums[places]) * self.down[places]
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return x ^ (x >> np.uint64(29))

    def samples(self, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        places = self.sample[: np.searchsorted(self.sample, len(sums) - 1 - self.sample_length, "right")]
        return places, self.at(sums, places, self.sample_length)

    def ties(self, sums: np.ndarray, places: np.ndarray) -> np.ndarray:
        """Starts, within the segment, that have one of the sampled places fewer than V bytes ahead."""
        n = min(len(sums) - self.length, SEGMENT)
        edge = np.zeros(n + 1, np.int32)
        np.add.at(edge, np.clip(places - V + 1, 0, n), 1)
        np.add.at(edge, np.clip(places + 1, 0, n), -1)
        return np.flatnonzero(np.cumsum(edge[:-1]) > 0)


def _segments(text: bytes, length: int):
    """(offset, bytes) pieces that overlap so that each start has its `length` bytes in just one."""
    for offset in range(0, max(1, len(text) - length + 1), SEGMENT):
        yield offset, np.frombuffer(text, np.uint8, min(SEGMENT + length - 1, len(text) - offset), offset)


def _pack(*columns: np.ndarray) -> bytes:
    """Columns of 64-bit numbers, the first ascending: differences and byte planes compress."""
    first = columns[0].copy()
    first[1:] -= columns[0][:-1]
    planes = [np.ascontiguousarray(c.view(np.uint8).reshape(-1, 8).T).tobytes() for c in (first, *columns[1:])]
    return zstandard.compress(b"".join(planes), 1)


def _unpack(data: bytes, columns: int = 1) -> list[np.ndarray]:
    raw = np.frombuffer(zstandard.decompress(data), np.uint8)
    n = len(raw) // 8 // columns
    out = [np.ascontiguousarray(raw[8 * n * i : 8 * n * (i + 1)].reshape(8, n).T).reshape(-1).view(np.uint64) for i in range(columns)]
    return [np.cumsum(out[0]), *out[1:]]


def _within(known: np.ndarray, x: np.ndarray) -> np.ndarray:
    if not len(known):
        return np.zeros(len(x), bool)
    return known[np.minimum(np.searchsorted(known, x), len(known) - 1)] == x


def _new(x: np.ndarray) -> np.ndarray:
    """Where a sorted column has a value for the first time."""
    return np.append(True, x[1:] != x[:-1]) if len(x) else np.zeros(0, bool)


def _least(values: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    """For each row the least value among rows of its rank; the ranks are in order."""
    at = np.flatnonzero(_new(ranks))
    return np.repeat(np.minimum.reduceat(values, at), np.diff(np.append(at, len(ranks)))) if len(at) else values


def _twice(x: np.ndarray) -> np.ndarray:
    """Each value in order, once or, if there are more, twice."""
    x = np.sort(x)
    first = _new(x)
    return x[first | np.append(True, first[:-1])] if len(x) else x


class _Block:
    """The texts of one block in order of (doc_id, text), with what is known of their ranks."""

    def __init__(self, table: pa.Table, how: dict):
        self.how, self.ranks = how, Ranks(how["length"])
        ids = table["doc_id"].to_pylist()
        texts = [t or b"" for t in table["text"].cast(pa.binary()).to_pylist()]
        self.order = sorted(range(len(ids)), key=lambda i: (ids[i] is not None, ids[i], texts[i]) if ids[i] is not None else (False, 0, texts[i]))
        self.ids, self.texts = [ids[i] for i in self.order], [texts[i] for i in self.order]
        self.cut = np.uint64(64 - how["bits"])

    def pieces(self):
        for i, text in enumerate(self.texts):
            if len(text) >= self.ranks.length:
                for offset, data in _segments(text, self.ranks.length):
                    yield i, offset, data

    def sample_ranks(self) -> np.ndarray:
        found = [self.ranks.samples(self.ranks.sums(data))[1] >> self.cut for _, _, data in self.pieces()]
        return np.concatenate(found) if found else np.empty(0, np.uint64)

    def suffixes(self, tied: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(rank, text, start, whether it is the block's first of its rank), by rank, of the suffixes that may have an
        equal: those near a tied sample."""
        known = np.sort(np.concatenate([np.empty(0, np.uint64), *(_unpack(x)[0] for x in tied)]))
        ranks, texts, starts = [np.empty(0, np.uint64)], [np.empty(0, np.int32)], [np.empty(0, np.int64)]
        for i, offset, data in self.pieces():
            sums = self.ranks.sums(data)
            places, own = self.ranks.samples(sums)
            places = places[_within(known, own >> self.cut)]
            if len(places):
                at = self.ranks.ties(sums, places)
                ranks.append(self.ranks.at(sums, at, self.ranks.length))
                texts.append(np.full(len(at), i, np.int32))
                starts.append(at + offset)
        ranks, texts, starts = map(np.concatenate, (ranks, texts, starts))
        by = np.argsort(ranks)
        ranks = ranks[by]
        return ranks, texts[by], starts[by], by == _least(by, ranks)  # unsorted, texts and starts ascend


_SENT = pa.schema([("bucket", pa.int64()), (_BLOCK, pa.int64()), ("data", pa.binary())])
_BACK = pa.schema([(_BLOCK, pa.int64()), ("kind", pa.int64()), ("data", pa.binary())])
_SENT_SQL, _BACK_SQL = f"bucket bigint, {_BLOCK} bigint, data binary", f"{_BLOCK} bigint, kind bigint, data binary"


def _deal(block: int, buckets: int, bits: int, *columns: np.ndarray) -> pa.Table:
    """Records in order of rank, a piece for each bucket of ranks."""
    edges = np.array([(b << bits) // buckets for b in range(1, buckets)], np.uint64)
    cuts = [0, *np.searchsorted(columns[0], edges).tolist(), len(columns[0])]
    rows = [{"bucket": b, _BLOCK: block, "data": _pack(*(c[x:y] for c in columns))} for b, (x, y) in enumerate(zip(cuts, cuts[1:])) if y > x]
    return pa.Table.from_pylist(rows, _SENT)


def _answer(blocks: np.ndarray, ranks: np.ndarray, kind: int) -> pa.Table:
    """The ranks, ascending, that concern each block."""
    by = np.argsort(blocks, kind="stable")
    blocks, ranks = blocks[by], ranks[by]
    names, first = np.unique(blocks, return_index=True)
    ends = [*first[1:].tolist(), len(blocks)]
    return pa.Table.from_pylist([{_BLOCK: int(b), "kind": kind, "data": _pack(ranks[x:y])} for b, x, y in zip(names, first.tolist(), ends)], _BACK)


def _gather(table: pa.Table, columns: int) -> list[np.ndarray]:
    found = [_unpack(x, columns) for x in table["data"].to_pylist()]
    blocks = np.repeat(np.array(table[_BLOCK].to_pylist(), np.int64), [len(x[0]) for x in found])
    return [blocks, *(np.concatenate([x[i] for x in found]) for i in range(columns))]


def _replies(left: pa.Table, kind: int) -> list[bytes]:
    return [d for k, d in zip(left["kind"].to_pylist(), left["data"].to_pylist()) if k == kind]


def _spread(df: DataFrame, key: str, keys: int) -> DataFrame:
    """Partitions in number by the groups, whatever the session's setting: few groups meet in a task at any size."""
    return df.repartition(2 * keys, key)


def _repeats(docs: DataFrame, length: int, scratch: Scratch) -> tuple[DataFrame, DataFrame, dict]:
    """The documents with their block, the ranks that concern each block, and the settings."""
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-total // BLOCK_BYTES))
    how = {"length": length, "bits": min(64, total.bit_length() + 12), "buckets": max(1, int(total * len(COVER) / V / BUCKET_RANKS))}
    docs = docs.withColumn(_BLOCK, F.pmod(F.xxhash64(F.col("doc_id").cast("bigint")), F.lit(n)))
    texts = _spread(docs.select(_BLOCK, F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("binary").alias("text")), _BLOCK, n)

    def sample(table: pa.Table) -> pa.Table:
        return _deal(table[_BLOCK][0].as_py(), how["buckets"], how["bits"], _twice(_Block(table, how).sample_ranks()))

    def sort_sample(table: pa.Table) -> pa.Table:
        blocks, ranks = _gather(table, 1)
        by = np.argsort(ranks)
        blocks, ranks = blocks[by], ranks[by]
        same = ranks[1:] == ranks[:-1]
        tied = np.append(same, False) | np.insert(same, 0, False) if len(ranks) else np.zeros(0, bool)
        return _answer(blocks[tied], ranks[tied], 0)

    def suffix(turn: int):
        low, high = (np.uint64((t << 64) // PASSES - (t > 0)) for t in (turn, turn + 1))

        def send(left: pa.Table, right: pa.Table) -> pa.Table:
            if not left.num_rows:
                return _SENT.empty_table()
            block = _Block(left, how)
            ranks, at, _, first = block.suffixes(_replies(right, 0))
            first &= (ranks <= high) & ((ranks > low) | (turn == 0))
            ids = np.array([-(1 << 63) if x is None else x for x in block.ids], np.int64)[at[first]]
            return _deal(left[_BLOCK][0].as_py(), how["buckets"], 64, ranks[first], ids.view(np.uint64))

        return send

    def sort_suffixes(table: pa.Table) -> pa.Table:
        blocks, ranks, ids = _gather(table, 2)
        by = np.argsort(ranks)
        blocks, ranks, ids = blocks[by], ranks[by], ids.view(np.int64)[by]
        later = ids != _least(ids, ranks)  # a text is in one block only
        return _answer(blocks[later], ranks[later], 1)

    sent = texts.groupBy(_BLOCK).applyInArrow(sample, _SENT_SQL)
    sampled = scratch.save(_spread(sent, "bucket", how["buckets"]).groupBy("bucket").applyInArrow(sort_sample, _BACK_SQL), "sample", free=True)
    known = sampled
    for turn in range(PASSES):
        sent = texts.groupBy(_BLOCK).cogroup(_spread(sampled, _BLOCK, n).groupBy(_BLOCK)).applyInArrow(suffix(turn), _SENT_SQL)
        known = known.union(scratch.save(_spread(sent, "bucket", how["buckets"]).groupBy("bucket").applyInArrow(sort_suffixes, _BACK_SQL), "later", free=True))
    return _spread(docs, _BLOCK, n), _spread(known, _BLOCK, n), how


def _removed(left: pa.Table, right: pa.Table, how: dict):
    """(row, text, mask of removed bytes or None) of each text of a block."""
    block = _Block(left, how)
    ranks, at, starts, first = block.suffixes(_replies(right, 0))
    known = [_unpack(x)[0] for x in _replies(right, 1)]
    later = ~first | _within(np.sort(np.concatenate(known)) if known else np.empty(0, np.uint64), ranks)
    at, starts = at[later], starts[later]
    by = np.argsort(at, kind="stable")
    at, starts = at[by], starts[by]
    edges = np.searchsorted(at, np.arange(len(block.texts) + 1))
    for i, text in enumerate(block.texts):
        mask = None
        if edges[i + 1] > edges[i]:
            edge = np.zeros(len(text) + 1, np.int32)
            own = starts[edges[i] : edges[i + 1]]
            edge[own] += 1  # starts are distinct, and so are their ends
            edge[own + how["length"]] -= 1
            mask = np.cumsum(edge[:-1]) > 0
        yield block.order[i], text, mask


def repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every document."""
    docs, known, how = _repeats(docs.select("doc_id", "text"), length, Scratch(docs.sparkSession, "suffixes"))
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])

    def report(left: pa.Table, right: pa.Table) -> pa.Table:
        rows, ids = [], left["doc_id"].to_pylist()
        for row, text, mask in _removed(left, right, how):
            kept, spans = text, 0
            if mask is not None:
                kept = np.frombuffer(text, np.uint8)[~mask].tobytes()
                spans = int(mask[0]) + int((mask[1:] & ~mask[:-1]).sum())
            rows.append((ids[row], len(text), len(text) - len(kept), spans, hashlib.sha256(kept).hexdigest()))
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema) if rows else schema.empty_table()

    texts = docs.select(_BLOCK, F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return texts.groupBy(_BLOCK).cogroup(known.groupBy(_BLOCK)).applyInArrow(report, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string")


def remove_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """The documents without repeated strings; characters cut in two go whole. A text of which only white space is left
    goes, if anything was removed from it. n_chars, where there is such a column, follows the text."""
    schema = docs.schema
    docs, known, how = _repeats(docs, length, Scratch(docs.sparkSession, "suffixes"))

    def rewrite(left: pa.Table, right: pa.Table) -> pa.Table:
        texts, keep = left["text"].to_pylist(), [True] * left.num_rows
        for row, text, mask in _removed(left, right, how):
            if mask is not None:
                texts[row] = np.frombuffer(text, np.uint8)[~mask].tobytes().decode(errors="ignore")
                keep[row] = bool(texts[row].strip())
        out = left.set_column(left.schema.get_field_index("text"), left.schema.field("text"), pa.array(texts, left.schema.field("text").type))
        if (at := out.schema.get_field_index("n_chars")) >= 0:
            field = out.schema.field("n_chars")
            out = out.set_column(at, field, pa.array([None if t is None else len(t) for t in texts], field.type))
        return out.drop_columns([_BLOCK]).filter(pa.array(keep, pa.bool_()))

    return docs.groupBy(_BLOCK).cogroup(known.groupBy(_BLOCK)).applyInArrow(rewrite, schema)


def op6_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    return repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op6_suffix_dedup": op6_suffix_dedup}
SQL = {"op6_suffix_dedup": """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
k AS (SELECT doc_id, unnest(list_transform(range(n - 99), lambda i: md5_number(substr(h, 2 * i + 1, 200)))) AS k, unnest(range(n - 99)) AS i FROM d WHERE n >= 100),
f AS (SELECT doc_id, i, row_number() OVER (PARTITION BY k ORDER BY doc_id, i) AS r FROM k),
b AS (SELECT doc_id, unnest(list_transform(range(n), lambda i: substr(h, 2 * i + 1, 2))) AS b, unnest(range(n)) AS i FROM d),
c AS (SELECT b.doc_id, b.i, b, coalesce(max(CASE WHEN r > 1 THEN b.i END) OVER (PARTITION BY b.doc_id ORDER BY b.i ROWS BETWEEN 99 PRECEDING AND CURRENT ROW) IS NOT NULL, false) AS gone
  FROM b LEFT JOIN f ON b.doc_id = f.doc_id AND b.i = f.i),
e AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY i), false) AS starts FROM c),
g AS (SELECT doc_id, count(*) FILTER (gone) AS n_removed, count(*) FILTER (starts) AS n_spans, coalesce(string_agg(b, '' ORDER BY i) FILTER (NOT gone), '') AS kept FROM e GROUP BY doc_id)
SELECT d.doc_id, d.n::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256
FROM d LEFT JOIN g ON d.doc_id = g.doc_id"""}
