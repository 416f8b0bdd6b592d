"""MinHash near-duplicates with circulant signatures.

Two permutations of the 32-bit shingle hashes make a whole signature: the first, s, scatters them; coordinate k is the
least p(s(x) + k) over the set, p being the second permutation and the sum circular. Bands of coordinates propose
pairs, which the exact Jaccard similarity of the full sets confirms; confirmed links make components.

A bucket of equal bands, however large, is not expanded into pairs. All its members are held against its least one and
components are formed; where a bucket still spans several, its members are held against its most central text (the one
whose shingles are the most common there), which gathers copies of one text. What then lies in different components
can only be linked if it shares a shingle among its rarest: of two sets of n <= m shingles with similarity t, the first
n - 2t/(1+t) n + 1 of the smaller and the first m - tm + 1 of the larger, in one order, must meet. Those pairs, which
are few between texts that are not similar, are confirmed too, so that no proposed link is lost.

Inputs and edge cases: a null or empty text, or one of white space, has an empty set, which links with nothing; a text
of fewer words than a shingle has one shingle, its whole sequence; equal sets are one class and meet others once; rows
that share a doc_id are one vertex; an empty table gives no rows; only doc_id and text are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.llm.components import connected_components
from sluice.sources.scratch import Scratch, partitions

#: Words whose hashes a task remembers; shingles whose signatures are worked out at once (they fit a core's cache); texts
#: and bytes of text whose sets a task holds at once.
_MEMORY, _CHUNK, _TEXTS, _BYTES = 1 << 17, 1 << 14, 512, 4 << 20
#: A bucket, or a shingle, with more rows than this and than an eighth of a partition's share is joined where they are.
_HOT = 256


@dataclass(frozen=True)
class Setting:
    """percent: the least similarity. A pair at that similarity is missed with (1 - (percent/100)^rows)^bands."""

    words: int = 3
    percent: int = 85
    rows: int = 6
    bands: int = 32  # misses 3 in 10 million


#: Near-duplicate stages without a contract of their own: five words, 0.8, 1 in 10 million missed.
FIVE_WORDS = Setting(5, 80, 5, 40)


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= _MEMORY:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


def _mix64(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def shingles(text: bytes, words: int, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of `words` words of a text."""
    tokens = text.lower().split()  # of bytes: A-Z only, and white space is \x20 \x09-\x0D
    if not tokens:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, tokens), np.uint64, len(tokens))
    size = min(words, len(tokens))
    total = np.full(len(tokens) - size + 1, size, np.uint64)
    for i in range(size):
        total = _mix64(total) + h[i : len(h) - size + 1 + i]
    return np.unique(_mix64(total))


def _permute(x: np.ndarray, first: int, second: int) -> np.ndarray:
    """A permutation of the 32-bit numbers, in place."""
    for constant, shift in ((first, 15), (second, 13)):
        x ^= x >> np.uint32(16)
        x *= np.uint32(constant)
        x ^= x >> np.uint32(shift)
    return x


def signatures(sets: list[np.ndarray], n: int) -> np.ndarray:
    """[set, coordinate]; no set may be empty."""
    out = np.empty((len(sets), n), np.uint32)
    sizes = np.array([len(s) for s in sets])
    first = 0
    while first < len(sets):
        last = first + max(1, int(np.searchsorted(np.cumsum(sizes[first:]), _CHUNK, "right")))
        starts = np.cumsum(sizes[first:last]) - sizes[first:last]
        scattered = _permute(np.concatenate(sets[first:last]).astype(np.uint32), 0x7FEB352D, 0x846CA68B)
        for k in range(n):
            out[first:last, k] = np.minimum.reduceat(_permute(scattered + np.uint32(k), 0x2C1B3C6D, 0x297A2D39), starts)
        first = last
    return out


def _slices(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of _TEXTS rows and _BYTES of text at most, or of one row."""
    sizes = pc.fill_null(pc.binary_length(b["text"]), 0).to_numpy(zero_copy_only=False)
    first = held = 0
    for i, n in enumerate(sizes.tolist()):
        if i > first and (i - first == _TEXTS or held + n > _BYTES):
            yield b.slice(first, i - first)
            first, held = i, 0
        held += n
    if b.num_rows > first:
        yield b.slice(first)


def _sketch(docs: DataFrame, how: Setting) -> DataFrame:
    """doc_id, n (shingles), key (of the set), bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for b in batches:
            for part in _slices(b):
                sets = [shingles(t.as_py() or b"", how.words, hashes) for t in part["text"]]
                full = [s for s in sets if len(s)]
                found = signatures(full, how.rows * how.bands).astype(np.uint64).reshape(len(full), how.bands, how.rows)
                total = np.arange(how.bands, dtype=np.uint64)[None, :] + np.zeros((len(full), 1), np.uint64)
                for r in range(how.rows):
                    total = _mix64(total) + found[:, :, r]
                bands = iter(_mix64(total).view(np.int64).tolist())
                yield pa.RecordBatch.from_arrays([
                    part["doc_id"], pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets], pa.binary()),
                    pa.array([next(bands) if len(s) else [] for s in sets], pa.list_(pa.int64())),
                ], ["doc_id", "n", "key", "bands"])

    return docs.mapInArrow(run, "doc_id bigint, n bigint, key binary, bands array<bigint>")


def _sets(docs: DataFrame, how: Setting) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for b in batches:
            for part in _slices(b):
                sets = [shingles(t.as_py() or b"", how.words, hashes).view(np.int64) for t in part["text"]]
                yield pa.RecordBatch.from_arrays([part["doc_id"], pa.array(sets, pa.list_(pa.int64()))], ["v", "s"])

    return docs.mapInArrow(run, "v bigint, s array<bigint>")


def _hot(counts: DataFrame, key: str, scratch: Scratch) -> DataFrame | None:
    """The keys of a table (key, k rows each) with more than _HOT rows and an eighth of a partition's share: few by
    construction, at most 8 a partition. None if there are none."""
    most = max(_HOT, (counts.agg(F.sum("k")).first()[0] or 0) // (8 * partitions(scratch.spark)))
    large = scratch.save(counts.where(F.col("k") > most).select(key).coalesce(1), "hot")
    if not large.isEmpty():
        return large
    scratch.drop(large)
    return None


def _by_key(rows: DataFrame, table: DataFrame, hot: DataFrame | None, key: str = "b") -> DataFrame:
    """rows joined with a table of one row a key. Rows of hot keys stay where they are, so that a cluster's members do
    not all go to one task."""
    if hot is None:
        return rows.join(table, key)
    few = F.broadcast(table.join(F.broadcast(hot), key, "left_semi"))
    return rows.join(F.broadcast(hot), key, "left_anti").join(table, key).unionByName(rows.join(few, key))


def _rarest_first(vertices: DataFrame, sets: DataFrame, how: Setting, scratch: Scratch) -> DataFrame:
    """(v, n) with the rarest shingles (their count among these sets, and itself) in order, as many as a partner of any
    size may have to meet, and `common`, the mean count of all its shingles. Counts only order the shingles."""
    tokens = vertices.join(sets, "v").select("v", "n", F.explode("s").alias("t"))
    counts = scratch.save(tokens.groupBy("t").agg(F.count("*").alias("k")), "counts")
    rows = _by_key(tokens, counts, _hot(counts, "t", scratch), "t").groupBy("v", "n").agg(F.sort_array(F.collect_list(F.struct("k", "t"))).alias("o"), F.avg("k").alias("common"))
    rows = scratch.save(rows.select("v", "n", "common", F.slice("o", 1, _prefix(F.col("n"), how.percent, 100)).alias("o")), "rarest")
    scratch.drop(counts)
    return rows


def _prefix(n, share: int, of: int):
    """n - ceil(n * share / of) + 1."""
    return (n - F.ceil(n * share / F.lit(of)) + 1).cast("int")


def _meet_by_rarest(rows: DataFrame, components: DataFrame, how: Setting, scratch: Scratch) -> DataFrame:
    """Pairs (a, b) of different components that may be linked by what their rarest shingles say."""
    t = how.percent
    rows = rows.join(components, "v", "left").withColumn("c", F.coalesce("component", "v"))
    large = rows.select("v", "n", "c", F.posexplode("o").alias("i", "x")).where("x.k > 1").select(F.col("x.t").alias("t"), *[F.col(x).alias(f"{x}_l") for x in ("v", "n", "c", "i")])
    small = rows.select("v", "n", "c", F.posexplode(F.slice("o", 1, _prefix(F.col("n"), 2 * t, 100 + t))).alias("i", "x")).where("x.k > 1").select(F.col("x.t").alias("t"), "v", "n", "c", "i")
    live = large.groupBy("t").agg(F.min("c_l").alias("least"), F.max("c_l").alias("most"), F.count("*").alias("k")).where("least < most")
    live = scratch.save(live.select("t", "k"), "live")  # shingles of more than one component; others link nothing new
    hot = _hot(live, "t", scratch)
    # Stored, so that no order of theirs keeps Spark from splitting a frequent shingle's rows in the join below.
    large, small = (scratch.save(_by_key(x, live.select("t"), hot, "t"), "meeting") for x in (large, small))
    fits = (F.col("c") != F.col("c_l")) & (F.struct("n", "v") < F.struct("n_l", "v_l")) & (100 * F.col("n") >= t * F.col("n_l"))
    left = F.least(F.col("n") - F.col("i"), F.col("n_l") - F.col("i_l"))  # shingles that can still meet, this one included
    fits = fits & ((100 + t) * left >= t * (F.col("n") + F.col("n_l")))
    met = small.join(large, (small["t"] == large["t"]) & fits)
    return met.select(F.least("v", "v_l").alias("a"), F.greatest("v", "v_l").alias("b")).distinct()


def near_duplicates(docs: DataFrame, how: Setting = Setting()) -> DataFrame:
    """doc_id, n_shingles, component_id (the least doc_id reachable over links, itself included) of every document."""
    scratch = Scratch(docs.sparkSession, "minhash")
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    base = scratch.save(_sketch(docs, how), "sketch")
    classes = base.where("n > 0").groupBy("key").agg(F.min("doc_id").alias("rep"))
    classes = scratch.save(classes, "classes")
    reps = base.join(classes.select("key", F.col("rep").alias("doc_id")), ["key", "doc_id"]).select("doc_id", "n", F.posexplode("bands").alias("i", "band"))
    rows = reps.select(F.xxhash64("i", "band").alias("b"), F.col("doc_id").alias("v"), "n")
    shared = rows.groupBy("b").agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.min_by("n", "v").alias("lo_n"), F.count("*").alias("k")).where("lo < hi")
    shared = scratch.save(shared, "shared")
    hot = _hot(shared, "b", scratch)
    members = scratch.save(_by_key(rows, shared.select("b", "lo", "lo_n"), hot).distinct(), "members")
    wanted = members.select(F.col("v").alias("doc_id")).distinct()
    sets = _sets(docs.join(wanted, "doc_id", "left_semi"), how)
    if not base.groupBy("doc_id").count().where("count > 1").isEmpty():
        sets = sets.dropDuplicates(["v"])
    sets = scratch.save(sets, "sets")

    def confirm(pairs: DataFrame) -> DataFrame:
        """Pairs (a, b) with links as a column; first those whose sizes alone rule a link out are left out."""
        a, b = (sets.select(F.col("v").alias(x), F.col("s").alias(f"s_{x}")) for x in "ab")
        both = F.size(F.array_intersect("s_a", "s_b"))
        linked = 100 * both >= how.percent * (F.size("s_a") + F.size("s_b") - both)
        return pairs.join(b, "b").join(a, "a").select("a", "b", linked.alias("linked"))

    def candidates(rows: DataFrame) -> DataFrame:
        """Distinct ordered pairs of rows (x, n_x, y, n_y) that can be similar enough."""
        can = (F.col("x") != F.col("y")) & (100 * F.least("n_x", "n_y") >= how.percent * F.greatest("n_x", "n_y"))
        return rows.where(can).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()

    def step(pairs: DataFrame, before: DataFrame | None) -> tuple[DataFrame, DataFrame]:
        """Links so far, with those among the pairs, and the components that they make."""
        links = confirm(pairs).where("linked").select("a", "b")
        links = scratch.save(links if before is None else before.union(links), "linked")
        return links, connected_components(links, scratch)

    pairs = candidates(members.select(F.col("v").alias("x"), F.col("n").alias("n_x"), F.col("lo").alias("y"), F.col("lo_n").alias("n_y")))
    links, components = step(pairs, None)
    named = members.join(components, "v", "left").select("b", "v", "n", F.coalesce("component", "v").alias("c"))
    split = named.groupBy("b").agg(F.min("c").alias("least"), F.max("c").alias("most")).where("least < most").select("b")
    split = scratch.save(_by_key(named, split, hot), "split")
    if not split.isEmpty():
        shared_by = _rarest_first(split.select("v", "n").distinct(), sets, how, scratch)
        central = split.join(shared_by.select("v", "common"), "v").groupBy("b").agg(F.max_by(F.struct("v", "n", "c"), F.struct("common", F.negate("v"))).alias("p"))
        meet = _by_key(split, central, hot).where(F.col("c") != F.col("p.c")).select(F.col("v").alias("x"), F.col("n").alias("n_x"), F.col("p.v").alias("y"), F.col("p.n").alias("n_y"))
        first, second = links, components
        links, components = step(candidates(meet), links)
        scratch.drop(first, second)
        first, second = links, components
        links, components = step(_meet_by_rarest(shared_by, components, how, scratch), links)
        scratch.drop(first, second, shared_by)
    out = base.join(classes, "key", "left").withColumn("rep", F.when(F.col("n") > 0, F.col("rep")).otherwise(F.col("doc_id")))
    out = out.join(components.withColumnRenamed("v", "rep"), "rep", "left")
    out = scratch.save(out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "rep").alias("component_id")), "result")
    scratch.drop(*[table for _, table in scratch.paths.values() if table is not out])
    return out


def op10_minhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
QUERIES = {"op10_minhash_near_dedup": op10_minhash_near_dedup}
SQL = {"op10_minhash_near_dedup": rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UP}', '{_LOW}'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(w[i:i + least(len(w), 3) - 1], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 0) + 2)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS i FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL),
l AS MATERIALIZED (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * i >= 85 * (na.n + nb.n - i)),
r AS (SELECT doc_id, doc_id AS c FROM d UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.doc_id),
m AS (SELECT doc_id, min(c) AS component_id FROM r GROUP BY doc_id)
SELECT m.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, m.doc_id = component_id AS kept FROM m LEFT JOIN n ON m.doc_id = n.doc_id"""}
