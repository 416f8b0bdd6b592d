"""Cross-tokenizer alignment: which tokens of two vocabularies cover the same bytes, by inverted pair bitmaps.

Two tokenizers spell the same bytes. Where a token of each ends at the same byte, the text is cut; tokens between two
cuts are one group, and every token of A there is linked with every token of B there. For each pair of ids, a compressed
bitmap holds the documents that link it; planes beside it hold the bits of its multiplicities (less one) in them.
Bitmaps of one pair and block of 65,536 documents are OR-merged, their bits counted: documents of a pair, and links.
The postings then carry each pair's score back to their documents, block by block.

A text is parted at white space where neither vocabulary can reach over. Of the words so made, a task aligns each once
for some megabytes of text, all of them together. Texts are read once.

Inputs and edge cases: a null or empty text has no tokens, nor has one that the tokens of A or of B do not spell out
(U+2581 in a text, which B takes for a space): zeros and an empty digest; equal texts, and rows that share a doc_id, are
documents of their own; strings of special tokens are plain text; an empty table gives no rows; only doc_id and text are
read. The links of a large group are counted by the ids in it, so that a group of many equal tokens is small work.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.llm.bitmaps import SPAN, pack, unpack
from sluice.llm.minhash import _by_key, _hot
from sluice.sources.scratch import Scratch, partitions

#: Bits of an id of B in the number of a pair.
_ID_BITS = 20
#: Bytes of text whose words and postings a task holds at once; words of one call; links of a group taken one by one.
_FLUSH, _CALL, _LARGE = 8 << 20, 4096, 1 << 16
_SPACE = "▁"
_CUT = re.compile(rf"(?<=[^\s{_SPACE}]) (?!\Z)")  # B makes nothing of an empty text, so that a last space stays with its word


def vocabulary_paths() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def byte_letters() -> dict[str, int]:
    """The letters by which byte-level vocabularies spell bytes: printable ones as themselves, others from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


@dataclass(frozen=True)
class Words:
    """Alignments of words, one after another: counts, groups as text, and by `starts` each word's distinct pairs and how
    often it links them. whole: spelled by both vocabularies."""

    n_a: np.ndarray
    n_b: np.ndarray
    n_groups: np.ndarray
    n_links: np.ndarray
    whole: np.ndarray
    groups: list[str]
    starts: np.ndarray
    pairs: np.ndarray
    times: np.ndarray


def _add(keys: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and the sums of their times."""
    order = np.argsort(keys, kind="stable")
    keys, times = keys[order], times[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, np.int64)
    return keys[first], np.add.reduceat(times, first) if len(first) else times


class Aligner:
    """Two vocabularies, and what their tokens spell."""

    def __init__(self, path_a: str, path_b: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks are the parallel ones
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.a.no_truncation()
        self.a.no_padding()
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        letters = byte_letters()
        size_a, size_b = self.a.get_vocab_size(), self.b.get_piece_size()
        if max(size_a, size_b) > 1 << _ID_BITS:
            raise ValueError(f"vocabularies of {size_a} and {size_b} ids; at most {1 << _ID_BITS} fit")
        self.bytes_a = [bytes(letters[c] for c in t) if all(c in letters for c in t) else t.encode() for t in (self.a.id_to_token(i) or "" for i in range(size_a))]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(_SPACE, " ").encode() for i, p in enumerate(map(self.b.id_to_piece, range(size_b)))]
        across = [p for p in map(self.b.id_to_piece, range(size_b)) if re.search(f"[^{_SPACE}]{_SPACE}", p)]
        if across:
            raise ValueError(f"{path_b} has pieces that reach over a space: {across[:3]}")
        self.length_a, self.length_b = (np.array([len(x) for x in spelled], np.int64) for spelled in (self.bytes_a, self.bytes_b))
        self.text_a = np.array([[f"{i}{end}" for i in range(size_a)] for end in ",|"], object)
        self.text_b = np.array([[f"{i}{end}" for i in range(size_b)] for end in ",;\n"], object)

    def _tokens(self, words: list[str]) -> tuple[list[list[int]], list[list[int]], np.ndarray]:
        """Ids of A and of B of a space and each word, and whether both spell it; words that they do not spell have none."""
        a = [x.ids for x in self.a.encode_batch([" " + w for w in words], add_special_tokens=False)]
        b = self.b.encode(words, num_threads=1)
        spell = lambda ids, spelled: b"".join([spelled[x] for i in ids for x in i])
        whole = np.ones(len(words), bool)
        text = (" " + " ".join(words)).encode()
        if spell(a, self.bytes_a) != text or spell(b, self.bytes_b) != text:
            for i, w in enumerate(words):
                text = (" " + w).encode()
                if spell(a[i : i + 1], self.bytes_a) != text or spell(b[i : i + 1], self.bytes_b) != text:
                    a[i], b[i], whole[i] = [], [], False
        return a, b, whole

    def _some(self, words: list[str]) -> Words:
        a, b, whole = self._tokens(words)
        n_a, n_b = (np.array([len(x) for x in ids], np.int64) for ids in (a, b))
        flat_a, flat_b = (np.fromiter(itertools.chain.from_iterable(ids), np.int64, int(n.sum())) for ids, n in ((a, n_a), (b, n_b)))
        ends_a, ends_b = np.cumsum(self.length_a[flat_a]), np.cumsum(self.length_b[flat_b])
        cuts = np.intersect1d(ends_a, ends_b)  # words end here too, as both spell them
        group_a, group_b = np.searchsorted(cuts, ends_a), np.searchsorted(cuts, ends_b)
        in_a, in_b = np.bincount(group_a, minlength=len(cuts)), np.bincount(group_b, minlength=len(cuts))
        word_a = np.repeat(np.arange(len(words)), n_a)
        last_a, last_b = np.cumsum(in_a) - 1, np.cumsum(in_b) - 1
        word_of = word_a[last_a]
        n_links = np.zeros(len(words), np.int64)
        np.add.at(n_links, word_of, in_a * in_b)
        # the groups as text: each group's ids of A, then those of B
        end_a, end_b = np.zeros(len(flat_a), np.int64), np.zeros(len(flat_b), np.int64)
        end_a[last_a], end_b[last_b] = 1, 1
        end_b[np.cumsum(n_b)[n_b > 0] - 1] = 2
        merged = np.empty(len(flat_a) + len(flat_b), object)
        merged[np.arange(len(flat_a)) + (np.cumsum(in_b) - in_b)[group_a]] = self.text_a[end_a, flat_a]
        merged[np.arange(len(flat_b)) + np.cumsum(in_a)[group_b]] = self.text_b[end_b, flat_b]
        lines = iter("".join(merged.tolist()).split("\n"))
        groups = [next(lines) if n else "" for n in n_b.tolist()]
        # links: every token of A with all of B in its group; of large groups, ids with their counts
        large = in_a * in_b > _LARGE
        own = np.flatnonzero(~large[group_a])
        many = in_b[group_a[own]]
        at = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat((last_b - in_b + 1)[group_a[own]], many)
        left = np.repeat(own, many)
        keys = [word_a[left] << 2 * _ID_BITS | flat_a[left] << _ID_BITS | flat_b[at]]
        times = [np.ones(len(left), np.int64)]
        for g in np.flatnonzero(large).tolist():
            x, n = np.unique(flat_a[last_a[g] - in_a[g] + 1 : last_a[g] + 1], return_counts=True)
            y, m = np.unique(flat_b[last_b[g] - in_b[g] + 1 : last_b[g] + 1], return_counts=True)
            keys.append((word_of[g] << 2 * _ID_BITS | x[:, None] << _ID_BITS | y[None, :]).ravel())
            times.append(np.outer(n, m).ravel())
        keys, times = _add(np.concatenate(keys), np.concatenate(times))
        starts = np.searchsorted(keys >> 2 * _ID_BITS, np.arange(len(words)))
        return Words(n_a, n_b, np.bincount(word_of, minlength=len(words)), n_links, whole, groups, starts, keys & ((1 << 2 * _ID_BITS) - 1), times)

    def words(self, words: list[str]) -> Words:
        """Alignments of a space and each word. No word may be empty."""
        parts = [self._some(words[at : at + _CALL]) for at in range(0, len(words), _CALL)]
        joined = lambda name: np.concatenate([getattr(p, name) for p in parts] or [np.empty(0, np.int64)])
        before = np.cumsum([0, *(len(p.pairs) for p in parts)])
        starts = np.concatenate([*(p.starts + n for p, n in zip(parts, before)), before[-1:]])
        return Words(*map(joined, ("n_a", "n_b", "n_groups", "n_links", "whole")), [g for p in parts for g in p.groups], starts, joined("pairs"), joined("times"))


@functools.lru_cache(1)
def aligner(path_a: str, path_b: str) -> Aligner:
    """What a Python worker loads once, for all its tasks."""
    return Aligner(path_a, path_b)


class Numbers(dict):
    """Words, numbered as they come."""

    def __missing__(self, word: str) -> int:
        n = self[word] = len(self)
        return n


_DIGEST = ["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
_SCHEMA = "row bigint, doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, groups string, pair bigint, block bigint, docs binary, planes array<binary>"
_TYPES = [pa.int64()] * 6 + [pa.string()] * 2 + [pa.int64()] * 2 + [pa.binary(), pa.list_(pa.binary())]


def _rows(n: int, **columns) -> pa.RecordBatch:
    """A batch of the schema whose other columns are null."""
    names = [c.split()[0] for c in _SCHEMA.split(", ")]
    arrays = [pa.array(columns[c], t) if isinstance(columns.get(c), list) else columns.get(c, pa.nulls(n, t)) for c, t in zip(names, _TYPES, strict=True)]
    return pa.RecordBatch.from_arrays(arrays, names)


def bit_planes(group: np.ndarray, number: np.ndarray, times: np.ndarray, groups: int) -> pa.Array:
    """For each group a list of bitmaps: the k-th holds the numbers whose (times - 1) has bit k."""
    more = times - 1
    top = np.zeros(groups, np.int64)
    np.maximum.at(top, group[more > 0], more[more > 0])
    depth = np.array([int(x).bit_length() for x in top.tolist()], np.int64) if top.any() else np.zeros(groups, np.int64)
    starts = np.concatenate([[0], np.cumsum(depth)])
    held = [((more >> k) & 1).astype(bool) for k in range(int(depth.max(initial=0)))]
    place = np.concatenate([starts[group[h]] + k for k, h in enumerate(held)]) if held else np.empty(0, np.int64)
    of = np.concatenate([number[h] for h in held]) if held else np.empty(0, np.int64)
    order = np.lexsort((of, place))
    return pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pack(place[order], of[order], int(starts[-1])))


def _postings(keys: np.ndarray, times: np.ndarray, block: int) -> pa.RecordBatch:
    """Bitmaps of one block. keys: pair and number of a document in the block, in order and distinct."""
    pairs, group = np.unique(keys >> 16, return_inverse=True)
    number, n = keys & (SPAN - 1), len(pairs)
    return _rows(n, pair=pa.array(pairs), block=pa.array(np.full(n, block)), docs=pack(group, number, n), planes=bit_planes(group, number, times, n))


def align(docs: DataFrame, path_a: str, path_b: str, with_groups: bool = False) -> DataFrame:
    """Two kinds of rows: of each document (row, doc_id, counts, digest, and its groups as text on request; `pair` is
    null), and of each pair and block (pair, block, docs, planes). A block's rows of a pair may be several, which no
    document shares."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        how = aligner(path_a, path_b)
        numbers, ids, rows, places, size = Numbers(), [], [], [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            words = how.words(list(numbers))
            whole = [p if len(p) and words.whole[p].all() else p[:0] for p in places]
            of_doc, flat = np.repeat(np.arange(len(rows)), [len(p) for p in whole]), np.concatenate(whole)
            counts = {c: np.zeros(len(rows), np.int64) for c in ("n_a", "n_b", "n_groups", "n_links")}
            for c, total in counts.items():
                np.add.at(total, of_doc, getattr(words, c)[flat])
            text = [";".join(map(words.groups.__getitem__, p.tolist())) for p in whole]
            yield _rows(
                len(rows), row=rows, doc_id=ids, **{c: pa.array(v) for c, v in counts.items()},
                groups_sha256=[hashlib.sha256(t.encode()).hexdigest() if t else "" for t in text], **({"groups": text} if with_groups else {}),
            )
            del text
            both, times = np.unique(of_doc * len(numbers) + flat, return_counts=True)  # words of a document, before they become pairs
            if not len(both):
                return
            doc, word = both // len(numbers), both % len(numbers)
            n = np.diff(words.starts)[word]
            at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(words.starts[word], n)
            row = np.array(rows, np.int64)[np.repeat(doc, n)]
            times = words.times[at] * np.repeat(times, n)
            for block in np.unique(row // SPAN).tolist():
                here = row // SPAN == block
                yield _postings(*_add(words.pairs[at[here]] << 16 | row[here] % SPAN, times[here]), block)

        for b in batches:
            for at in range(0, b.num_rows, 64):
                part = b.slice(at, 64)
                ids += part["doc_id"].to_pylist()
                rows += part["row"].to_pylist()
                for t in part["text"]:
                    words = _CUT.split(t) if (t := t.as_py()) else []
                    places.append(np.fromiter(map(numbers.__getitem__, words), np.int64, len(words)))
                size += pc.sum(pc.binary_length(part["text"])).as_py() or 0
                if size >= _FLUSH:
                    yield from flush()
                    numbers, ids, rows, places, size = Numbers(), [], [], [], 0
        if rows:
            yield from flush()

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, _SCHEMA)


def merge(parts: DataFrame) -> DataFrame:
    """(pair, block, docs, planes, n_docs, n_links): one row for each pair and block. The bitmaps of its parts are
    OR-merged and their bits counted."""
    names = ["pair", "block", "docs", "planes", "n_docs", "n_links"]

    def combine(t: pa.Table) -> pa.RecordBatch:
        t = t.combine_chunks()
        pair, block = t["pair"].to_numpy(), t["block"].to_numpy()
        first = np.concatenate([[True], (pair[1:] != pair[:-1]) | (block[1:] != block[:-1])])
        group, n = np.cumsum(first) - 1, int(first.sum())
        place, number = unpack(t["docs"].chunk(0))
        keys = np.unique(group[place] << 16 | number)
        listed = t["planes"].chunk(0)
        depth = np.diff(listed.offsets.to_numpy())
        plane_place, plane_number = unpack(listed.flatten())
        owner = np.repeat(group, depth)[plane_place]  # of each bit, its group and which plane it is in
        level = (np.arange(depth.sum()) - np.repeat(np.cumsum(depth) - depth, depth))[plane_place]
        bits = np.unique(np.stack([owner << 16 | plane_number, level], 1), axis=0) if len(owner) else np.empty((0, 2), np.int64)
        times = np.ones(len(keys), np.int64)
        np.add.at(times, np.searchsorted(keys, bits[:, 0]), 1 << bits[:, 1])
        links = np.bincount(keys >> 16, minlength=n) + 0
        np.add.at(links, bits[:, 0] >> 16, 1 << bits[:, 1])
        number = keys & (SPAN - 1)
        return pa.RecordBatch.from_arrays([
            pa.array(pair[first]), pa.array(block[first]), pack(keys >> 16, number, n), bit_planes(keys >> 16, number, times, n),
            pa.array(np.bincount(keys >> 16, minlength=n).astype(np.int64)), pa.array(links),
        ], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None
        for b in batches:
            t = pa.Table.from_batches([b])
            t = t if rest is None else pa.concat_tables([rest, t])
            pair, block = t["pair"].to_numpy(), t["block"].to_numpy()
            other = np.flatnonzero((pair != pair[-1]) | (block != block[-1]))
            cut = int(other[-1]) + 1 if len(other) else 0  # the last group may go on in the next batch
            if cut:
                yield combine(t.slice(0, cut))
            rest = t.slice(cut)
        if rest is not None and rest.num_rows:
            yield combine(rest)

    rows = parts.where("pair IS NOT NULL").select("pair", "block", "docs", "planes")
    rows = rows.repartition(partitions(parts.sparkSession), "pair", "block").sortWithinPartitions("pair", "block")
    return rows.mapInArrow(run, "pair bigint, block bigint, docs binary, planes array<binary>, n_docs bigint, n_links bigint")


def pair_counts(bitmaps: DataFrame) -> DataFrame:
    """(pair, a, b, n_docs, n_links, k rows, best): best tells that no other id of B shares more documents with a."""
    counts = bitmaps.groupBy("pair").agg(F.sum("n_docs").alias("n_docs"), F.sum("n_links").alias("n_links"), F.count("*").alias("k"))
    counts = counts.select("pair", F.shiftright("pair", _ID_BITS).alias("a"), (F.col("pair") % (1 << _ID_BITS)).alias("b"), "n_docs", "n_links", "k")
    top = counts.groupBy("a").agg(F.max("n_docs").alias("_top"))
    return counts.join(top, "a").select("pair", "a", "b", "n_docs", "n_links", "k", (F.col("n_docs") == F.col("_top")).alias("best"))


def score_documents(bitmaps: DataFrame, counts: DataFrame, scratch: Scratch) -> DataFrame:
    """(row, n_best, count_sum): a document's links whose pair is the best of its A id, and the sum of its links'
    counts. A frequent pair's postings stay where they are; a block's meet in one task, which holds two numbers for each
    of its documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        block = None

        def done() -> pa.RecordBatch:
            best, total, seen = sums.pop(block)
            found = np.flatnonzero(seen)
            return pa.RecordBatch.from_arrays([pa.array(found + block * SPAN), pa.array(best[found]), pa.array(total[found])], ["row", "n_best", "count_sum"])

        for b in batches:
            blocks = b["block"].to_numpy()
            ends = np.concatenate([np.flatnonzero(blocks[1:] != blocks[:-1]) + 1, [len(blocks)]])
            for at, end in zip(np.concatenate([[0], ends[:-1]]).tolist(), ends.tolist(), strict=True):
                if block is not None and blocks[at] != block:
                    yield done()
                block = int(blocks[at])
                best, total, seen = sums.setdefault(block, np.zeros((3, SPAN), np.int64))
                part = b.slice(at, end - at)
                score, wins = part["n_docs"].to_numpy(), part["best"].to_numpy(zero_copy_only=False).astype(np.int64)
                place, number = unpack(part["docs"])
                np.add.at(total, number, score[place])
                np.add.at(best, number, wins[place])
                seen[number] = 1
                depth = np.diff(part["planes"].offsets.to_numpy())
                place, number = unpack(part["planes"].flatten())
                owner = np.repeat(np.arange(len(depth)), depth)[place]
                times = 1 << (np.arange(depth.sum()) - np.repeat(np.cumsum(depth) - depth, depth))[place]
                np.add.at(total, number, score[owner] * times)
                np.add.at(best, number, wins[owner] * times)
        if block is not None:
            yield done()

    scores = counts.select("pair", "n_docs", "best")
    rows = _by_key(bitmaps.select("pair", "block", "docs", "planes"), scores, _hot(counts.select("pair", "k"), "pair", scratch), "pair")
    rows = rows.select("block", "docs", "planes", "n_docs", "best").repartition(partitions(bitmaps.sparkSession), "block").sortWithinPartitions("block")
    return rows.mapInArrow(run, "row bigint, n_best bigint, count_sum bigint")


@dataclass(frozen=True)
class Alignment:
    """documents: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 (groups on request); pairs: a, b,
    n_docs, n_links, best; bitmaps: pair, block, docs, planes, n_docs, n_links."""

    documents: DataFrame
    pairs: DataFrame
    bitmaps: DataFrame


def align_documents(docs: DataFrame, path_a: str | None = None, path_b: str | None = None, with_groups: bool = False) -> Alignment:
    """The alignment of the texts of docs (doc_id, text) under a byte-level vocabulary (A) and a piece model (B)."""
    paths = vocabulary_paths()
    scratch = Scratch(docs.sparkSession, "alignment")
    parts = scratch.save(align(docs, path_a or paths[0], path_b or paths[1], with_groups), "parts")
    bitmaps = scratch.save(merge(parts), "bitmaps")
    counts = scratch.save(pair_counts(bitmaps), "counts")
    scores = scratch.save(score_documents(bitmaps, counts, scratch), "scores")
    own = parts.where("row IS NOT NULL").select(*_DIGEST, *["groups"] * with_groups)
    zero = lambda c: F.coalesce(c, F.lit(0).cast("bigint")).alias(c)
    out = own.join(scores, "row", "left").select("doc_id", "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups_sha256", *["groups"] * with_groups)
    return Alignment(out, counts.select("a", "b", "n_docs", "n_links", "best"), bitmaps)


def op11_pair_bitmaps(spark, sf_dir: str) -> DataFrame:
    return align_documents(spark.read.parquet(f"{sf_dir}/documents.parquet")).documents


QUERIES = {"op11_pair_bitmaps": op11_pair_bitmaps}
SQL: dict[str, str] = {}
