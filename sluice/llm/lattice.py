"""Language-model scores by subword lattices.

The pieces of an existing vocabulary span every word in many ways; a unigram model weights each segmentation by the
product of its pieces, and a forward recursion in log space sums them all. A word that the training texts hold is one
more segmentation of itself, of a single piece, weighted by its count less a discount; what all discounts free is shared
out by the lattice of subwords, so that every word has a probability. A text's probability is the product of its words'
marginals and of its end. The vocabulary and its order of pieces are given; the weights are re-estimated here by
expectation-maximisation over the same lattices, from each training word once, as the subwords answer for new words.
Words are counted, and worked out once each, in Spark; a block of texts then gets the figures of its own words.

Inputs and edge cases: a null or empty text is its end alone; a word of any length or script has a lattice, as
characters without a piece are spelled in byte pieces (lattices are built for words of _BATCH_CHARS characters together,
or for one longer word); without training rows the weights follow the vocabulary's order and only subwords count;
rows that share a doc_id are scored one by one; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import math
from array import array
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.sources.scratch import Scratch

BLOCK_BYTES = 16 << 20
ROUNDS = 1
#: Added to each piece's expected count; the share of a vocabulary's piece at rank r, before training, is 1/(r + FLAT).
SMOOTHING, FLAT = 0.01, 100.0
#: Words, and about their characters, whose lattices are built together.
_BATCH, _BATCH_CHARS = 4096, 1 << 16
_MARK = "▁"


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def read_vocabulary(path: str) -> list[str]:
    """Pieces in the vocabulary's order; what lower-cased text cannot use (capitals, control pieces) is left out."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    rows = range(model.get_piece_size())
    keep = [i for i in rows if not model.is_control(i) and not model.is_unknown(i)]
    keep = [i for i in keep if model.is_byte(i) or not any("A" <= c <= "Z" for c in model.id_to_piece(i))]
    return [model.id_to_piece(i) for i in sorted(keep, key=lambda i: (-model.get_score(i), i))]


class Lattice:
    """All segmentations of words; nodes are the places between characters, arcs are pieces."""

    def __init__(self, pieces: list[str]):
        self.number = {p: i for i, p in enumerate(pieces)}
        self.starts = {p[:n] for p in pieces for n in range(1, len(p) + 1)}
        self.bytes = [self.number.get(f"<0x{b:02X}>") for b in range(256)]
        self.n = len(pieces)

    def arcs(self, words: list[str], logs: np.ndarray) -> dict[str, np.ndarray]:
        """Arcs in order of their end's place in the word; a spelled-out character is one arc without a piece."""
        number, starts = self.number, self.starts
        source, target, piece, level, spelled = array("q"), array("q"), array("q"), array("q"), []
        node, first, last = 0, [], []
        for word in words:
            s = _MARK + word
            first.append(node)
            for i in range(len(s)):
                found = False
                for j in range(i + 1, len(s) + 1):
                    part = s[i:j]
                    if part not in starts:
                        break
                    if (k := number.get(part)) is not None:
                        source.append(node + i)
                        target.append(node + j)
                        piece.append(k)
                        level.append(j)
                        found = found or j == i + 1
                if not found:
                    spelled.append((len(source), s[i]))
                    source.append(node + i)
                    target.append(node + i + 1)
                    piece.append(self.n)
                    level.append(i + 1)
            node += len(s) + 1
            last.append(node - 1)
        source, target, piece, level = (np.array(x, np.int64) for x in (source, target, piece, level))
        weight = np.append(logs, 0.0)[piece]
        for at, c in spelled:
            weight[at] = sum(logs[self.bytes[b]] for b in c.encode(errors="replace"))
        by = np.lexsort((target, level))
        out = {"source": source[by], "target": target[by], "piece": piece[by], "level": level[by]}
        return out | {"weight": weight[by], "first": np.array(first), "last": np.array(last), "nodes": node, "spelled": spelled}

    @staticmethod
    def _sums(x: np.ndarray, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """log of the sum of exponentials for each run of equal nodes."""
        at = np.flatnonzero(np.append(True, nodes[1:] != nodes[:-1]))
        return nodes[at], np.logaddexp.reduceat(x, at)

    def forward(self, a: dict) -> np.ndarray:
        value = np.full(a["nodes"], -np.inf)
        value[a["first"]] = 0.0
        edges = np.searchsorted(a["level"], np.arange(1, a["level"][-1] + 2)) if len(a["level"]) else [0]
        for x, y in zip(edges, edges[1:]):
            if y > x:
                nodes, sums = self._sums(value[a["source"][x:y]] + a["weight"][x:y], a["target"][x:y])
                value[nodes] = sums
        return value

    def backward(self, a: dict) -> np.ndarray:
        value = np.full(a["nodes"], -np.inf)
        value[a["last"]] = 0.0
        owner = np.searchsorted(a["first"], a["source"], "right") - 1
        place = a["source"] - a["first"][owner]
        by = np.lexsort((a["source"], -place))
        source, target, weight, place = a["source"][by], a["target"][by], a["weight"][by], place[by]
        edges = [*np.flatnonzero(np.append(True, place[1:] != place[:-1])).tolist(), len(place)] if len(place) else [0]
        for x, y in zip(edges, edges[1:]):
            nodes, sums = self._sums(value[target[x:y]] + weight[x:y], source[x:y])
            value[nodes] = sums
        return value

    def marginals(self, words: list[str], logs: np.ndarray) -> np.ndarray:
        """Natural log of each word's probability."""
        a = self.arcs(words, logs)
        return self.forward(a)[a["last"]]

    def expected(self, words: list[str], counts: np.ndarray, logs: np.ndarray) -> np.ndarray:
        """Expected uses of each piece in the words, so often each."""
        a = self.arcs(words, logs)
        ahead, behind = self.forward(a), self.backward(a)
        owner = np.searchsorted(a["first"], a["source"], "right") - 1
        share = np.exp(ahead[a["source"]] + a["weight"] + behind[a["target"]] - ahead[a["last"][owner]]) * counts[owner]
        out = np.bincount(a["piece"], share, self.n + 1)
        loose = a["piece"] == self.n  # spelled characters: their bytes' pieces
        if loose.any():
            use = Counter()
            text = {}
            for word, first in zip(words, a["first"].tolist()):
                for i, c in enumerate(_MARK + word):
                    text[first + i] = c
            for source, x in zip(a["source"][loose].tolist(), share[loose].tolist()):
                for b in text[source].encode(errors="replace"):
                    use[self.bytes[b]] += x
            for k, x in use.items():
                out[k] += x
        return out[: self.n]


def _text(word: bytes) -> str:
    return word.decode(errors="replace")


def _parts(batch: pa.RecordBatch):
    """The batch in slices of _BATCH words, ended sooner by _BATCH_CHARS characters."""
    first, size = 0, 0
    for i, n in enumerate(pc.binary_length(batch["word"]).to_pylist()):
        if i > first and (size + n > _BATCH_CHARS or i - first == _BATCH):
            yield batch.slice(first, i - first)
            first, size = i, 0
        size += n
    if first < batch.num_rows:
        yield batch.slice(first)


def _weights(uses: np.ndarray) -> np.ndarray:
    uses = uses + SMOOTHING
    return np.log(uses / uses.sum())


def train(words: DataFrame, pieces: list[str], rounds: int = ROUNDS) -> np.ndarray:
    """Log weights of the pieces from the training words (word, c), each counted once."""
    lattice = Lattice(pieces)
    logs = _weights(1 / (np.arange(len(pieces)) + FLAT))
    for _ in range(rounds):

        def run(batches, logs=logs):
            uses, seen = np.zeros(lattice.n), 0
            for b in batches:
                for part in _parts(b):
                    uses += lattice.expected([_text(w) for w in part["word"].to_pylist()], np.ones(part.num_rows), logs)
                    seen += part.num_rows
            if seen:
                at = np.flatnonzero(uses)
                yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(uses[at], pa.float64())], ["piece", "uses"])

        found = words.where("c > 0").select("word").mapInArrow(run, "piece bigint, uses double").groupBy("piece").agg(F.sum("uses").alias("uses")).collect()  # a row for each piece
        if found:
            uses = np.zeros(lattice.n)
            uses[[r.piece for r in found]] = [r.uses for r in found]
            logs = _weights(uses)
    return logs


class Words:
    """Whole words as pieces of their own: `total` of them, `distinct` different, `once` and `twice` seen so often.

    The discount is once / (once + 2 twice), with one added to `once` and to `twice` a half, so that it is never 0 or 1."""

    def __init__(self, total: int, distinct: int, once: int, twice: int):
        self.total = total
        self.discount = (once + 1) / (once + 2 * twice + 2)
        self.rest = self.discount * distinct / total if total else 1.0

    def mix(self, c: np.ndarray, subwords: np.ndarray) -> np.ndarray:
        """Natural log of the probability of words that were seen `c` times and whose subwords alone give `subwords`."""
        whole = np.where(c > 0, c - self.discount, 0.0) / max(self.total, 1)
        with np.errstate(divide="ignore"):
            return np.logaddexp(np.log(whole), math.log(self.rest) + subwords)


def score(docs: DataFrame, training, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score of every document; `training` is a condition on rows."""
    scratch = Scratch(docs.sparkSession, "lattice")
    pieces = read_vocabulary(path or vocabulary_path())
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-total // BLOCK_BYTES))
    texts = docs.select(
        F.pmod(F.xxhash64(F.col("doc_id").cast("bigint")), F.lit(blocks)).alias("block"), F.col("doc_id").cast("bigint").alias("doc_id"),
        F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"), F.coalesce(training, F.lit(False)).alias("train"),
    )

    def count(table: pa.Table) -> pa.Table:
        seen, learned = set(), Counter()
        for text, train in zip(table["text"], table["train"].to_pylist()):
            words = text.as_py().lower().split()
            (learned if train else seen).update(words)
        seen = sorted(seen | learned.keys())
        block = table["block"][0].as_py()
        return pa.table({"block": pa.array([block] * len(seen), pa.int64()), "word": pa.array(seen, pa.binary()), "n": pa.array([learned[w] for w in seen], pa.int64())})

    seen = scratch.save(texts.groupBy("block").applyInArrow(count, "block bigint, word binary, n bigint"), "seen")
    counts = scratch.save(seen.groupBy("word").agg(F.sum("n").alias("c")), "counts")
    docs_in = texts.where("train").count()
    n, v, once, twice = counts.where("c > 0").agg(F.sum("c"), F.count("*"), F.count_if(F.col("c") == 1), F.count_if(F.col("c") == 2)).first()
    whole = Words(n or 0, v, once or 0, twice or 0)
    ends, goes_on = max(docs_in, 1), max(whole.total, 1)  # a word comes, rather than the end
    end, go_on = math.log10(ends / (ends + goes_on)), math.log10(goes_on / (ends + goes_on))
    n, v = whole.total + docs_in, v + bool(docs_in)
    logs, lattice = train(counts, pieces), Lattice(pieces)

    def work_out(batches):
        for b in batches:
            for part in _parts(b):
                subwords = lattice.marginals([_text(w) for w in part["word"].to_pylist()], logs)
                found = whole.mix(part["c"].to_numpy(), subwords) / math.log(10) + go_on
                yield pa.RecordBatch.from_arrays([part["word"], part["c"], pa.array(found, pa.float64())], ["word", "c", "score"])

    scored = scratch.save(counts.mapInArrow(work_out, "word binary, c bigint, score double"), "scored")
    known = seen.select("block", "word").join(scored, "word")

    def add(left: pa.Table, right: pa.Table) -> pa.Table:
        place = {w: i for i, w in enumerate(right["word"].to_pylist())}
        c = right["c"].to_numpy().astype(np.int64)
        base, own = np.log10((c + 1) / (n + v + 1)), right["score"].to_numpy()
        end_base = math.log10((docs_in + 1) / (n + v + 1))
        out = []
        for doc_id, text in zip(left["doc_id"].to_pylist(), left["text"]):
            words = text.as_py().lower().split()
            at = np.fromiter(map(place.__getitem__, words), np.int64, len(words))
            out.append((doc_id, len(words) + 1, int((c[at] > 0).sum()) + bool(docs_in), n, float(base[at].sum()) + end_base, float(own[at].sum()) + end))
        types = [pa.int64()] * 4 + [pa.float64()] * 2
        names = ["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
        return pa.table([pa.array(x, t) for x, t in zip(zip(*out) if out else [()] * 6, types)], names)

    schema = "doc_id bigint, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"
    out = texts.select("block", "doc_id", "text").groupBy("block").cogroup(known.groupBy("block")).applyInArrow(add, schema)
    out = scratch.save(out, "result")
    scratch.drop(seen, counts, scored)
    return out


def op3_lattice_likelihood(spark, sf_dir: str) -> DataFrame:
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2
    out = score(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), ~held_out)
    return out.withColumn("held_out", held_out)


QUERIES = {"op3_lattice_likelihood": op3_lattice_likelihood}
SQL: dict[str, str] = {}
