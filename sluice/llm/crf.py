"""Toxic spans by a linear-chain conditional random field.

Two labels a token, weights for the token, its beginnings and its ending, and a weight for each pair of neighbouring
labels. Documents are labelled only as a whole, so the tokens' labels are induced: in a toxic document, a word or
beginning that toxic documents have and others (nearly) never have. Forward-backward marginals of a document are
aggregated to its score, by a logistic curve fitted on the same sample, and to the offending offsets.

The field is fitted on the driver from a bounded sample of the labelled rows, spread over the corpus by a hash of the
text (copies count once): of each class at most SAMPLE documents and SAMPLE_BYTES of text in expectation, where a text
of more than SAMPLE_BYTES never enters. Weights are trained on CHUNKS runs of CHUNK tokens of these at most, half of
them with a marked token and half without, drawn at random; the score's curve is fitted on all of the sample. All
bounds are parameters of learn(). Scoring reads the text alone.

Inputs and edge cases: a null text, or one without a letter, gets the score of a text without offending tokens; without
labelled rows of both classes in the sample every score is 0; rows that share a doc_id are scored one by one; a text of any length is
scored whole; an empty table gives no rows; other columns are not read. Offsets are characters of the text as it is.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.sources.scratch import Scratch

SAMPLE = {1: 2000, 0: 3000}
SAMPLE_BYTES = 16 << 20
#: A feature marks tokens if this share of the sample's toxic documents, and LEAST of them, have it, and it is at least
#: ODDS times as frequent there as elsewhere.
SUPPORT, LEAST, ODDS = 0.01, 3, 40.0
#: Training chunks: their tokens, how many are taken at most, and how often a feature must occur in them.
CHUNK, CHUNKS, OFTEN = 48, 5000, 5
ROUNDS, PENALTY = 60, 0.3
_WORD = re.compile(r"[^\W\d_]+")
_MEMORY = 1 << 19


def features(word: str) -> tuple[str, ...]:
    return ("w" + word, "4" + word[:4], "5" + word[:5], "e" + word[-3:])


class Field:
    """start[y], step[y, y'], and the weight of each feature for label 1 (label 0 is the reference)."""

    def __init__(self, weights: dict[str, float], bias: float, step: np.ndarray, curve: tuple[float, ...]):
        self.weights, self.bias, self.step, self.curve = weights, bias, step, curve
        self.memory: dict[str, float] = {}

    def potential(self, word: str) -> float:
        """exp of a token's weight for label 1."""
        if (e := self.memory.get(word)) is None:
            if len(self.memory) >= _MEMORY:
                self.memory.clear()
            get = self.weights.get
            e = self.memory[word] = math.exp(max(-30.0, min(30.0, self.bias + sum(get(f, 0.0) for f in features(word)))))
        return e

    def marginals(self, words: list[str]) -> list[float]:
        """Probability of label 1 of each token. Odds are carried forward and backward, which needs no rescaling."""
        (t00, t01), (t10, t11) = np.exp(self.step).tolist()
        e = [*map(self.potential, words)]
        ahead, odds = [], 1.0
        for i, x in enumerate(e):
            odds = x if not i else x * (t01 + t11 * odds) / (t00 + t10 * odds)
            ahead.append(odds)
        behind, out = 1.0, ahead
        for i in range(len(e) - 1, -1, -1):
            o = ahead[i] * behind
            out[i] = o / (1.0 + o)
            x = e[i] * behind
            behind = (t10 + t11 * x) / (t00 + t01 * x)
        return out

    def measure(self, marginals: list[float]) -> tuple[float, float, float]:
        """Log odds that some token offends, their expected number, and their share."""
        none = sum(math.log1p(-min(p, 1 - 1e-12)) for p in marginals)
        some = -math.expm1(none)
        expected = sum(marginals)
        return max(-10.0, min(10.0, math.log(max(some, 1e-9)) - none)), math.log1p(expected), expected / max(1, len(marginals))

    def score(self, measures: tuple[float, float, float]) -> float:
        a, b, c, d = self.curve
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, a + b * measures[0] + c * measures[1] + d * measures[2]))))


def _words(text: str | None) -> list[str]:
    """In lower case, each for itself: the places of the words are those in the text as it is."""
    return [w.lower() for w in _WORD.findall(text or "")]


def _induce(texts: list[list[str]], labels: list[int]) -> list[np.ndarray]:
    """Token labels: the features of toxic documents that others lack, words and beginnings alike."""
    sizes = [max(1, labels.count(y)) for y in (0, 1)]
    seen = [Counter(), Counter()]
    for words, y in zip(texts, labels):
        seen[y].update({f for w in words for f in features(w)[:3] if len(w) >= 4 or f[0] == "w"})
    marks = {f for f, n in seen[1].items() if n >= max(LEAST, SUPPORT * sizes[1]) and (n + 0.5) / sizes[1] >= ODDS * (seen[0][f] + 0.02 * n) / sizes[0]}
    return [np.array([y and any(f in marks for f in features(w)[:3]) for w in words], bool) for words, y in zip(texts, labels)]


def _fit_curve(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, ...]:
    """Logistic regression by Newton steps, with a small penalty."""
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (weight * (p - y)) + 0.5 * w * [0, 1, 1, 1]
        bend = (x * (weight * p * (1 - p))[:, None]).T @ x + np.diag([1e-6, 0.5, 0.5, 0.5])
        w -= np.linalg.solve(bend, slope)
    return tuple(w.tolist())


def fit(texts: list[str], labels: list[int], shares: tuple[float, float], most: int = CHUNKS) -> Field:
    """The field of a sample; `shares` are the classes' shares of all labelled documents, `most` the chunks taken."""
    words = [_words(t) for t in texts]
    marked = _induce(words, labels)
    rng = np.random.default_rng(0)
    chunks, plain = [], []
    for w, m in zip(words, marked):
        for at in range(0, len(w), CHUNK):
            (chunks if m[at : at + CHUNK].any() else plain).append((w[at : at + CHUNK], m[at : at + CHUNK]))
    chunks = [part[i] for part in (chunks, plain) for i in rng.permutation(len(part))[: most // 2]]
    vocabulary = Counter(f for w, _ in chunks for x in w for f in features(x))
    number = {f: i for i, f in enumerate(sorted(f for f, n in vocabulary.items() if n >= OFTEN))}
    lost = len(number)
    n, k = len(chunks), len(features("x"))
    ids, gold, real = np.full((n, CHUNK, k), lost), np.zeros((n, CHUNK), int), np.zeros((n, CHUNK), bool)
    for i, (w, m) in enumerate(chunks):
        for j, x in enumerate(w):
            ids[i, j] = [number.get(f, lost) for f in features(x)]
        gold[i, : len(w)], real[i, : len(w)] = m, True
    theta, bias, step = np.zeros(lost + 1), -2.0, np.zeros((2, 2))
    moments = [np.zeros_like(theta), np.zeros_like(theta), np.zeros(5), np.zeros(5)]
    for it in range(1, ROUNDS + 1):
        unary = np.where(real, theta[ids].sum(2) + bias, 0.0)
        ahead, behind = np.zeros((n, CHUNK, 2)), np.zeros((n, CHUNK, 2))
        ahead[:, 0, 1] = unary[:, 0]
        for j in range(1, CHUNK):
            a = np.logaddexp(ahead[:, j - 1, :1] + step[0], ahead[:, j - 1, 1:] + step[1])
            a[:, 1] += unary[:, j]
            ahead[:, j] = np.where(real[:, j, None], a, ahead[:, j - 1])
        total = np.logaddexp(ahead[:, -1, 0], ahead[:, -1, 1])
        for j in range(CHUNK - 2, -1, -1):
            b = behind[:, j + 1] + np.stack([np.zeros(n), unary[:, j + 1]], 1)
            b = np.logaddexp(step[:, 0] + b[:, :1], step[:, 1] + b[:, 1:])
            behind[:, j] = np.where(real[:, j + 1, None], b, 0.0)
        p = np.exp(ahead[:, :, 1] + behind[:, :, 1] - total[:, None]) * real
        error = (p - gold) * real
        slope = np.bincount(ids.reshape(-1), np.repeat(error.reshape(-1), k), lost + 1) + PENALTY * theta
        slope[lost] = 0
        pairs, both = np.zeros((2, 2)), real[:, 1:]
        for y in (0, 1):
            for z in (0, 1):
                x = np.exp(ahead[:, :-1, y] + step[y, z] + unary[:, 1:] * z + behind[:, 1:, z] - total[:, None])
                pairs[y, z] = (x * both).sum() - ((gold[:, :-1] == y) & (gold[:, 1:] == z) & both).sum()
        small = np.append(pairs.reshape(-1) + PENALTY * step.reshape(-1), error.sum())
        for m, (g, first) in enumerate(((slope, 0), (small, 2))):
            moments[first] = 0.9 * moments[first] + 0.1 * g
            moments[first + 1] = 0.99 * moments[first + 1] + 0.01 * g * g
            move = 0.15 * (moments[first] / (1 - 0.9**it)) / (np.sqrt(moments[first + 1] / (1 - 0.99**it)) + 1e-8)
            if m == 0:
                theta = theta - move
            else:
                step, bias = step - move[:4].reshape(2, 2), bias - move[4]
    weights = {f: float(theta[i]) for f, i in number.items() if abs(theta[i]) > 1e-3}
    field = Field(weights, float(bias), step, (0.0, 0.0, 0.0, 0.0))
    x = np.array([field.measure(field.marginals(w)) for w in words])
    y = np.array(labels)
    weight = np.array([shares[v] * len(y) / max(1, labels.count(v)) for v in labels])
    field.curve = _fit_curve(x, y, weight)
    field.memory = {}
    return field


def learn(labelled: DataFrame, sample: dict[int, int] | None = None, sample_bytes: int = SAMPLE_BYTES, chunks: int = CHUNKS) -> Field | None:
    """The field of labelled texts (text, toxic); None unless both labels occur."""
    sample = sample or SAMPLE
    scratch = Scratch(labelled.sparkSession, "toxic")
    rows = labelled.where(F.col("text").isNotNull() & F.col("toxic").isin(0, 1)).select("text", "toxic", F.xxhash64("text").alias("h"))
    sizes = {r.toxic: r.n for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if len(sizes) < 2:
        return None

    def drawn(by, shares: dict[int, float]):
        grain, out = 1 << 20, F.lit(False)
        for y, share in shares.items():
            out = out | ((F.col("toxic") == y) & (F.pmod(by, F.lit(grain)) < math.ceil(grain * min(1.0, share))))
        return out

    found = rows.where(drawn(F.col("h"), {y: sample[y] / n for y, n in sizes.items()})).dropDuplicates(["toxic", "h"])
    found = scratch.save(found.where(F.octet_length("text") <= sample_bytes), "sample")
    held = {r.toxic: r.b for r in found.groupBy("toxic").agg(F.sum(F.octet_length("text")).alias("b")).collect()}
    found = found.where(drawn(F.xxhash64("h"), {y: sample_bytes / max(1, b) for y, b in held.items()})).select("text", "toxic").collect()
    scratch.drop(*[t for _, t in scratch.paths.values()])
    found = sorted((r.text, r.toxic) for r in found)
    if len({y for _, y in found}) < 2:
        return None
    total = sum(sizes.values())
    return fit([t for t, _ in found], [y for _, y in found], (sizes[0] / total, sizes[1] / total), chunks)


def tag(docs: DataFrame, field: Field | None) -> DataFrame:
    """doc_id, score, spans (first and end character of runs of tokens more likely toxic than not) of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.struct([("first", pa.int64()), ("end", pa.int64())])
        for b in batches:
            scores, spans = [], []
            for text in b["text"]:
                text = text.as_py() or ""
                found: list[dict] = []
                score = 0.0
                if field is not None:
                    marginals = field.marginals(_words(text))
                    score = field.score(field.measure(marginals))
                    if marginals and max(marginals) > 0.5:
                        last = -2
                        for i, (p, m) in enumerate(zip(marginals, _WORD.finditer(text))):
                            if p > 0.5:
                                if last == i - 1:
                                    found[-1]["end"] = m.end()
                                else:
                                    found.append({"first": m.start(), "end": m.end()})
                                last = i
                scores.append(score)
                spans.append(found)
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(scores, pa.float64()), pa.array(spans, pa.list_(span))], ["doc_id", "score", "spans"])

    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return docs.mapInArrow(run, "doc_id bigint, score double, spans array<struct<first:bigint,end:bigint>>")


def op5_toxic_spans(spark, sf_dir: str) -> DataFrame:
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    found = tag(docs, learn(docs.join(labels, "doc_id").where(~held_out).select("text", "toxic")))
    return found.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), F.to_json("spans").alias("spans"))


QUERIES = {"op5_toxic_spans": op5_toxic_spans}
SQL: dict[str, str] = {}
