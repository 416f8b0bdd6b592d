"""Mixture-controlled packing: every window holds the sources in the target proportions of tokens.

Each source is a queue of documents in order of doc_id. Deficit round-robin serves the queues token by token: a queue
is due when its share of what was served so far falls behind most. A token's turn is known in closed form - the j-th of
T tokens is due at (j + 1/2) / T of the whole - so every window finds, on its own, where each queue stands at its
start; the deficit carried over (under one token a queue) is part of that, across windows and across partitions.

With target weights, a token of a source of weight v is due at (j + 1/2) / v, and a source that is used up leaves its
share to the others; where the queues stand at a window's start follows from totals and weights alone, as before.
Weights are doubles, taken as the whole multiples of a power of two that they are, so that turns are compared exactly.

With more than MAX_QUEUES sources, no window holds counts of all queues: the tokens' turns are sorted by range instead,
a row a token, and a turn's place in the order gives its window. The order is the same but for due times that differ
and round to one double.

Inputs and edge cases: a null or empty text has only its end token; null sources share a queue; any number of sources
has a queue each; a document of any length is cut at window ends; equal rows are packed one by one;
an empty table gives no rows. Only the last window can be short.
"""

from __future__ import annotations

import functools
import heapq
import re
import zlib
from array import array
from collections.abc import Callable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sluice.operators.ordering import running_totals
from sluice.sources.scratch import Scratch, partitions

WINDOW = 4096
END = 2
#: Sources whose counts a task works out for every window; with more of them, turns are sorted.
MAX_QUEUES = 256
_PIECES = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "source"]
_SCHEMA = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint, source string"
#: Distinct pieces of words whose ids a worker remembers, also for the tasks to come (about 50 MB); those of the batch
#: at hand are held even if they are more.
_MEMORY = 1 << 18
#: Bytes of texts that are encoded together, or one larger text.
_TOGETHER = 1 << 24


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordIds:
    """Ids of texts. The vocabulary's rules never look beyond white space, so that the ids of a text are those of its
    words, one after another, and each distinct word of a batch of texts is encoded once.

    Words of printable Latin characters are put in lower case and parted here, as the vocabulary's file says, and each
    of their distinct pieces (letters of a word, a digit, a run of signs) goes to the vocabulary's model; any other word
    takes the whole way through the tokenizer. Pieces are remembered for the batches to come.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        self.encode, self.size, self.tokenize = tokenizer.encode, tokenizer.get_vocab_size(), tokenizer.model.tokenize
        self.pieces: dict[str, bytes] = {}

    def ids(self, text: str) -> bytes:
        """Little-endian 16-bit ids of a text and the end token."""
        return self.of_texts(pa.array([text], pa.string()))[0].as_py()

    def of_texts(self, texts: pa.Array) -> pa.Array:
        """ids() of each text."""
        # Only white space that all Unicode tables agree on parts words here; the tokenizer itself sees to the rest.
        ids = _joined(pc.ascii_split_whitespace(texts), self._of_words)
        return pc.binary_join_element_wise(ids, _END, b"")

    def _of_words(self, distinct: pa.Array) -> pa.Array:
        text, others = _lines(distinct), []
        if not _PLAIN.fullmatch(text) or "<|" in text:
            words = text.split("\n")
            others = [i for i, w in enumerate(words) if not _PLAIN.fullmatch(w) or "<|" in w]
            whole = [array("H", self.encode(words[i], add_special_tokens=False).ids).tobytes() for i in others]
            for i in others:
                words[i] = ""
            text = "\n".join(words)
        parted = pc.split_pattern(pa.array([_NO_LETTERS.sub(r" \g<0> ", text.lower())], pa.string()), "\n").flatten()
        ids = _joined(pc.ascii_split_whitespace(parted), self._of_pieces)
        if others:
            mask = np.zeros(len(distinct), bool)
            mask[others] = True
            ids = pc.replace_with_mask(ids, pa.array(mask), pa.array(whole, pa.binary()))
        return ids

    def _of_pieces(self, distinct: pa.Array) -> pa.Array:
        pieces = _lines(distinct).split("\n")
        new = [p for p in pieces if p not in self.pieces]
        spelled = [p if p.isascii() else p.encode().decode("latin-1").translate(_BYTE_LETTERS) for p in new]
        found = dict(zip(new, [array("H", [t.id for t in self.tokenize(p)]).tobytes() if p else b"" for p in spelled], strict=True))
        if len(self.pieces) + len(new) > _MEMORY:
            self.pieces = {p: ids for p in pieces if (ids := self.pieces.get(p)) is not None}
        self.pieces |= found
        return pa.array(map(self.pieces.__getitem__, pieces), pa.binary(), size=len(pieces))


def _lines(words: pa.Array) -> str:
    """Words without line ends, one a line."""
    return pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words), "\n")[0].as_py()


def _joined(lists: pa.ListArray, ids_of: Callable[[pa.Array], pa.Array]) -> pa.Array:
    """The ids of each list of strings, from those of the distinct strings."""
    coded = lists.flatten().dictionary_encode()
    ids = ids_of(coded.dictionary) if len(coded) else pa.array([], pa.binary())
    return pc.binary_join(pa.ListArray.from_arrays(lists.offsets, ids.take(coded.indices)), b"")


@functools.lru_cache(1)
def word_ids(path: str) -> WordIds:
    """What a Python worker remembers, from one task to the next."""
    return WordIds(path)


_END = np.array([END], "<u2").tobytes()
#: The vocabulary file's pattern of pieces, but for runs of letters, as it is for plain words in lower
#: case; and the letters by which byte-level vocabularies spell bytes: printable bytes as themselves, the others by the
#: letters from U+0100 on.
_LETTERS, _NUMBERS = "a-z\u00aa\u00b5\u00ba\u00df-\u00f6\u00f8-\u02af\u2c65\u2c66", "0-9\u00b2\u00b3\u00b9\u00bc-\u00be"
_NO_LETTERS = re.compile(rf"'(?:[stmd]|re|ve|ll)|[{_NUMBERS}]|[^\s{_LETTERS}{_NUMBERS}]+")
_PLAIN = re.compile("[\n!-~\u00a1-\u00ac\u00ae-\u0240]*")
_OTHERS = [b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or b >= 174)]
_BYTE_LETTERS = {b: 256 + i for i, b in enumerate(_OTHERS)}


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, source, tokens (with the end), ids (16-bit, as the vocabulary allows) of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = word_ids(path)
        if words.size > 1 << 16:
            raise ValueError(f"{path} has {words.size} ids; 16 bits hold 65,536")
        for b in batches:
            texts = pc.fill_null(b["text"], "")
            ends = np.cumsum(pc.binary_length(texts).to_numpy(), dtype=np.int64)
            at = 0
            while at < b.num_rows:
                upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + _TOGETHER, "right")))
                part, ids = b.slice(at, upto - at), words.of_texts(texts.slice(at, upto - at))
                tokens = pc.divide(pc.binary_length(ids), 2).cast(pa.int64())
                yield pa.RecordBatch.from_arrays([part["doc_id"], part["source"], tokens, ids], ["doc_id", "source", "tokens", "ids"])
                at = upto

    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", F.col("source").cast("string").alias("source"))
    return docs.mapInArrow(run, "doc_id bigint, source string, tokens bigint, ids binary")


def served(start: np.ndarray, totals: np.ndarray) -> np.ndarray:
    """[window, queue] -> tokens that each queue has given when `start[window]` tokens are packed.

    At the virtual time start / total, queue q with T_q tokens has floor(T_q * time + 1/2) behind it. The sum misses
    `start` by less than the number of queues; the tokens due next are added, or those last due taken back, one a
    queue in order of (due time, queue), until it fits. Two windows agree on the order, so the counts never fall.
    """
    total = int(totals.sum())
    start = start.astype(object)[:, None]
    wide = totals.astype(object)[None, :]
    given = (2 * wide * start + total) // (2 * total)
    given = np.minimum(given, wide)
    missing = (start[:, 0] - given.sum(1)).astype(np.int64)
    given = given.astype(np.int64)
    for w in np.flatnonzero(missing):
        row, n = given[w], int(missing[w])
        step = 1 if n > 0 else -1
        for _ in range(abs(n)):
            # due time (2j + 1) / 2T of the next token j = row (or of the last, j = row - 1), compared exactly
            best = None
            for q in range(len(totals)):
                t = int(totals[q])
                j = int(row[q]) if step > 0 else int(row[q]) - 1
                if not 0 <= j < t:
                    continue
                if best is None:
                    best = (2 * j + 1, t, q)
                    continue
                left, right = (2 * j + 1) * best[1], best[0] * t
                if left < right if step > 0 else left >= right:
                    best = (2 * j + 1, t, q)
            row[best[2]] += step
    return given


class Paces:
    """Queues with target weights: when a token is due, and how many tokens each has given by then."""

    def __init__(self, totals: np.ndarray, weights: list[float]):
        ratios = [w.as_integer_ratio() for w in weights]
        unit = max(b for _, b in ratios)  # powers of two
        self.totals, self.weights = totals, weights
        self.whole = [a * (unit // b) for a, b in ratios]
        self.unit = unit
        ends = totals / np.array(weights)
        order = np.argsort(ends, kind="stable")
        self.ends = ends[order]
        self.gone = np.concatenate([[0], np.cumsum(totals[order])])  # tokens of the queues that end first
        self.left = np.concatenate([np.cumsum(np.array(weights)[order][::-1])[::-1], [0.0]])  # weights of the others
        self.reached = self.gone[:-1] + self.ends * self.left[:-1]  # tokens served when a queue ends, about

    def about(self, q: int, place: int) -> int:
        """About how many tokens are served before a queue's token."""
        due = (place + 0.5) / self.weights[q]
        i = min(int(np.searchsorted(self.ends, due)), len(self.ends) - 1)
        return int(self.gone[i] + due * self.left[i])

    def served(self, start: np.ndarray) -> np.ndarray:
        """served(), by weights. The virtual time at which `start` tokens are due is near enough as a double: counts are
        exact for that double, and then tokens are added or taken back in the exact order of turns."""
        out = []
        for n in start.tolist():
            i = min(int(np.searchsorted(self.reached, n)), len(self.ends) - 1)
            top, bottom = max((n - int(self.gone[i])) / float(self.left[i]), 0.0).as_integer_ratio()
            bottom *= self.unit
            row = [min(int(t), (2 * v * top + bottom) // (2 * bottom)) for v, t in zip(self.whole, self.totals)]
            missing = n - sum(row)
            step = 1 if missing > 0 else -1
            turns = [t for q in range(len(row)) if (t := self._turn(q, row[q], step))]
            heapq.heapify(turns)
            for _ in range(abs(missing)):
                q = turns[0][1] * step
                row[q] += step
                if again := self._turn(q, row[q], step):
                    heapq.heapreplace(turns, again)
                else:
                    heapq.heappop(turns)
            out.append(row)
        return np.array(out, np.int64)

    def _turn(self, q: int, given: int, step: int) -> tuple | None:
        """What sorts a queue's next token, due at (2j + 1) / 2v, or with step -1 its last; the first of the latter is due last."""
        if step > 0:
            return (Fraction(2 * given + 1, self.whole[q]), q) if given < self.totals[q] else None
        return (-Fraction(2 * given - 1, self.whole[q]), -q) if given else None


def _checked_weights(weights: DataFrame, names: list[str]) -> list[float]:
    """The weight of each queue; at most MAX_QUEUES rows come to the driver."""
    queue = F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit(""))
    given = weights.select(queue.alias("queue"), F.col("weight").cast("double").alias("weight")).where(F.col("queue").isin(names))
    found = {r.queue: r for r in given.groupBy("queue").agg(F.count("*").alias("n"), F.max("weight").alias("weight")).collect()}
    if bad := [n for n in names if n not in found or not 0 < (found[n].weight or 0) < float("inf")]:
        raise ValueError(f"sources without a weight above 0: {[n[1:] if n else None for n in bad[:3]]}")
    if any(r.n > 1 for r in found.values()):
        raise ValueError("a source has more than one weight")
    return [found[n].weight for n in names]


def _pack_sorted(rows: DataFrame, window: int, with_ids: bool, weights: DataFrame | None, scratch: Scratch) -> DataFrame:
    """pack() for any number of sources. The j-th token of a source of weight v (its number of tokens, where none is
    given) is due at (j + 1/2) / v; due times are doubles, and equal ones go by the source."""
    spark = rows.sparkSession
    rows = rows.withColumn("queue", F.coalesce(F.concat(F.lit("="), "source"), F.lit("")))
    totals = rows.groupBy("queue").agg(F.sum("tokens").alias("tokens"))
    totals = running_totals(totals.withColumn("one", F.lit(1)), ["queue"], ["tokens", "one"], scratch)
    shares = totals.select("queue", F.col("before_tokens").alias("ahead"), F.col("before_one").alias("q"), F.col("tokens").cast("double").alias("weight"))
    if weights is not None:
        given = weights.select(F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("")).alias("queue"), F.col("weight").cast("double").alias("target"))
        shares = scratch.save(shares.drop("weight").join(given, "queue", "left").withColumnRenamed("target", "weight"), "shares")
        if bad := shares.where("weight IS NULL OR NOT weight > 0 OR isnan(weight)").limit(3).collect():
            raise ValueError(f"sources without a weight above 0: {[r.queue[1:] if r.queue else None for r in bad]}")
        if shares.groupBy("q").count().where("count > 1").limit(1).collect():
            raise ValueError("a source has more than one weight")
    placed = running_totals(rows.select("queue", "doc_id", "row", "tokens"), ["queue", "doc_id", "row"], ["tokens"], scratch)
    placed = placed.join(shares, "queue").select("row", "tokens", "q", "weight", (F.col("before_tokens") - F.col("ahead")).alias("place"))
    turns = placed.select("row", "q", "place", "weight", F.explode(F.sequence("place", F.col("place") + F.col("tokens") - 1)).alias("j"))
    turns = turns.select(((F.col("j") + 0.5) / F.col("weight")).alias("due"), "q", "j", "row", "place", F.lit(1).alias("one"))
    turns = running_totals(turns, ["due", "q", "j"], ["one"], scratch).withColumn("sequence_id", F.floor(F.col("before_one") / window).cast("bigint"))
    pieces = turns.groupBy("sequence_id", "q", "row", "place").agg(F.min("j").alias("first"), F.count("*").alias("length"))
    earlier = Window.partitionBy("sequence_id").orderBy("q", "first").rowsBetween(Window.unboundedPreceding, -1)
    pieces = pieces.withColumn("offset", F.coalesce(F.sum("length").over(earlier), F.lit(0)))
    pieces = pieces.select("row", (F.col("first") - F.col("place")).alias("start"), "length", "sequence_id", "offset")
    piece = F.expr("substring(ids, cast(2 * start + 1 AS int), cast(2 * length AS int))")
    cut = rows.select("row", "doc_id", "source", "tokens", "ids").join(pieces, "row").select(
        "doc_id", "start", "length", piece.alias("ids"), F.col("tokens").alias("doc_tokens"), "sequence_id", "offset", "source"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            wide = [np.frombuffer(x.as_buffer(), "<u2").astype("<u4").tobytes() for x in b["ids"]]
            columns = [pa.array([zlib.crc32(x) for x in wide], pa.int64()) if name == "ids" else b[name] for name in b.schema.names]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(wide, pa.binary())] if with_ids else columns, names=_PIECES + ["ids"] * with_ids)

    return cut.mapInArrow(run, _SCHEMA + ", ids binary" * with_ids)


def pack(docs: DataFrame, path: str | None = None, window: int = WINDOW, with_ids: bool = False, weights: DataFrame | None = None) -> DataFrame:
    """Pieces: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, source (and ids on request).

    weights (source, weight): the target proportions, of every source; without them, the sources' shares of all tokens.
    A source that is used up leaves its share to the others, in proportion to their weights.
    """
    spark, path = docs.sparkSession, path or vocabulary_path()
    scratch = Scratch(spark, "packing")
    rows = encode(docs, path).withColumn("row", F.monotonically_increasing_id())
    rows = scratch.save(rows, "ids")
    sources = rows.groupBy("source").agg(F.sum("tokens").alias("tokens"))
    if sources.count() > MAX_QUEUES:
        return _pack_sorted(rows, window, with_ids, weights, scratch)
    rows = rows.withColumn("queue", F.coalesce(F.concat(F.lit("="), "source"), F.lit("")))
    sums = sorted((r.queue, r.tokens) for r in rows.groupBy("queue").agg(F.sum("tokens").alias("tokens")).collect())  # MAX_QUEUES rows at most
    names, totals = [q for q, _ in sums], np.array([t for _, t in sums], np.int64)
    paces = Paces(totals, _checked_weights(weights, names)) if weights is not None and names else None
    before = dict(zip(names, np.concatenate([[0], np.cumsum(totals)[:-1]]).tolist() if names else [], strict=True))
    placed = running_totals(rows.select("queue", "doc_id", "row", "tokens"), ["queue", "doc_id", "row"], ["tokens"], scratch)
    number = {q: i for i, q in enumerate(names)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = int(totals.sum())
        known: dict[int, np.ndarray] = {}

        def at(w: int) -> np.ndarray:
            if w not in known:
                if len(known) > 50_000:
                    known.clear()
                more = np.arange(w, w + 64)
                starts = np.minimum(more * window, total)
                known.update(zip(more.tolist(), paces.served(starts) if paces else served(starts, totals), strict=True))
            return known[w]

        for b in batches:
            out = {k: [] for k in _PIECES}
            pieces = []
            for doc_id, source, name, tokens, ahead, ids in zip(*(b[c].to_pylist() for c in ("doc_id", "source", "queue", "tokens", "before_tokens")), b["ids"], strict=True):
                q, ids = number[name], np.frombuffer(ids.as_buffer(), "<u2").astype("<u4")
                place = ahead - before[name]  # of its first token in its queue
                end = place + tokens
                near = paces.about(q, place) if paces else int((2 * place + 1) * total // (2 * int(totals[q])))
                w = max(0, near // window - 1)
                while at(w + 1)[q] <= place:
                    w += 1
                while at(w)[q] > place:
                    w -= 1
                first = place
                while place < end:
                    here, there = at(w), at(w + 1)
                    upto = min(end, int(there[q]))
                    if upto > place:
                        piece = ids[place - first : upto - first].tobytes()
                        out["doc_id"].append(doc_id)
                        out["start"].append(place - first)
                        out["length"].append(upto - place)
                        out["ids_crc32"].append(zlib.crc32(piece))
                        out["doc_tokens"].append(tokens)
                        out["sequence_id"].append(w)
                        out["offset"].append(int((there[:q] - here[:q]).sum()) + place - int(here[q]))
                        out["source"].append(source)
                        if with_ids:
                            pieces.append(piece)
                        place = upto
                    w += 1
            types = [pa.int64()] * 7 + [pa.string()]
            arrays = [pa.array(c, t) for c, t in zip(out.values(), types, strict=True)]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(pieces, pa.binary())] if with_ids else arrays, [*out, "ids"] if with_ids else list(out))

    schema = _SCHEMA + ", ids binary" * with_ids
    # Documents of all queues that fall due together go to one task, so that each window is worked out about once.
    pace = paces.weights if paces else [float(t) for t in totals]
    shares = spark.createDataFrame([(q, before[q], v) for q, v in zip(names, pace)], "queue string, ahead bigint, pace double")
    due = placed.join(F.broadcast(shares), "queue").select("row", "before_tokens", ((F.col("before_tokens") - F.col("ahead")) / F.col("pace")).alias("due"))
    joined = rows.select("row", "doc_id", "source", "queue", "tokens", "ids").join(due, "row")
    return joined.repartitionByRange(partitions(spark), "due").drop("row", "due").mapInArrow(run, schema)


def op8_mixture_packing(spark, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("source")


QUERIES = {"op8_mixture_packing": op8_mixture_packing}
SQL: dict[str, str] = {}
