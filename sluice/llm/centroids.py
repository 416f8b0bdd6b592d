"""Exact k-means of integer vectors by rounds, with ns-bounds.

A vector keeps, for every centroid, the distance at its last evaluation and the round of it. The centroids of all rounds
are retained, so that a bound is loosened by the norm of the centroid's whole displacement since that round, never by
the sum of its moves round by round, which is longer. A vector whose nearest centroid stays nearest by these bounds is
not looked at; for any other one its own centroid is evaluated, then each centroid whose bound still does not rule it
out, in whole numbers: distances, ties (the smaller number wins) and means (floor of the exact quotient) are exact.

Each round is one pass over the stored vectors; their bounds are written beside them. The driver gets k rows of sums.

Inputs and edge cases: only vectors with exactly `dim` components, none null or non-finite, are kept; fewer kept vectors
than k make fewer centroids, none makes no rows; equal vectors and repeated ids stay apart (equal ids start in the
order of their components); a centroid without vectors stays; a component of 2^27 or more is an error, as distances
would not fit a long; a null id is kept, but starts no centroid; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.sources.scratch import Scratch

DIM, K, ROUNDS, SCALE = 64, 16, 3, 64
_LARGEST = 1 << 27
#: Vectors that a task works on at once.
_ROWS = 8192
#: Bounds are doubles; this much of a distance is more than all their rounding.
_SLACK = 1e-9


def quantise(df: DataFrame, key: str, column: str, dim: int = DIM, scale: float = SCALE) -> DataFrame:
    """(key, v): vectors of whole numbers, floor(scale * x), of the rows that have `dim` finite components."""
    x = F.col(column)
    fine = (F.size(x) == dim) & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf")))
    cells = F.transform(x, lambda c: F.floor(F.lit(float(scale)) * c.cast("double")))
    large = F.exists(x, lambda c: F.abs(F.lit(float(scale)) * c.cast("double")) >= _LARGEST)
    checked = F.when(large, F.raise_error(F.lit(f"a component of {_LARGEST} or more"))).otherwise(cells)
    return df.where(F.coalesce(fine, F.lit(False))).select(F.col(key).cast("bigint").alias(key), checked.cast("array<bigint>").alias("v"))


def first_centroids(vectors: DataFrame, key: str, k: int, seed: str) -> np.ndarray:
    """The vectors whose keys have the least hashes, in that order."""
    hashed = vectors.where(F.col(key).isNotNull()).select(F.sha2(F.concat(F.lit(seed), F.col(key).cast("string")), 256).alias("h"), "v")
    return np.array([r.v for r in hashed.orderBy("h", "v").limit(k).collect()], np.int64)


def squared(v: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows of v to the rows of c, pair by pair (or to one row)."""
    d = v - c
    return np.einsum("ij,ij->i", d, d)


def assign(v: np.ndarray, cluster: np.ndarray, far: np.ndarray, seen: np.ndarray, history: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """One round's clusters, distances and rounds of evaluation; and the number of distances worked out.

    cluster: -1 before the first round. far, seen [vector, centroid]: the distance at the last evaluation, and the index
    into history [round, centroid, component] of it.
    """
    now, k = len(history) - 1, history.shape[1]
    far, seen, cluster, worked = far.copy(), seen.copy(), cluster.copy(), 0
    if now == 0 or (cluster < 0).any():
        exact = np.stack([squared(v, history[now, j]) for j in range(k)], 1)
        return exact.argmin(1).astype(np.int32), np.sqrt(exact.astype(np.float64)), np.full_like(seen, now), exact.size
    moved = np.sqrt((((history - history[now]).astype(np.float64)) ** 2).sum(2))  # [round, centroid]: norm of the whole displacement
    slip = moved[seen, np.arange(k)[None, :]]
    rows = np.arange(len(v))
    low = (far - slip) * (1 - _SLACK) - _SLACK
    high = (far + slip)[rows, cluster] * (1 + _SLACK) + _SLACK
    low[rows, cluster] = np.inf
    left = np.flatnonzero(low.min(1) <= high) if k > 1 else np.empty(0, int)
    if len(left):
        own = squared(v[left], history[now, cluster[left]])
        far[left, cluster[left]], seen[left, cluster[left]] = np.sqrt(own.astype(np.float64)), now
        worked += len(left)
        near = np.sqrt(own.astype(np.float64)) * (1 + _SLACK) + _SLACK
        best, at = own, cluster[left].copy()
        for j in range(k):
            rescan = np.flatnonzero(low[left, j] <= near)
            if not len(rescan):
                continue
            d = squared(v[left[rescan]], history[now, j])
            far[left[rescan], j], seen[left[rescan], j] = np.sqrt(d.astype(np.float64)), now
            worked += len(rescan)
            wins = (d < best[rescan]) | ((d == best[rescan]) & (j < at[rescan]))
            best[rescan[wins]], at[rescan[wins]] = d[wins], j
        cluster[left] = at
    return cluster, far, seen, worked


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _round(vectors: DataFrame, key: str, history: np.ndarray) -> DataFrame:
    """The vectors with this round's clusters and bounds, and how many distances a batch needed (on its first row)."""
    k, dim = history.shape[1:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first in range(0, b.num_rows, _ROWS):
                part = b.slice(first, _ROWS)
                n = part.num_rows
                v = _matrix(part["v"], dim)
                if "cluster" in b.schema.names:
                    state = part["cluster"].to_numpy(), _matrix(part["far"], k), _matrix(part["seen"], k)
                else:
                    state = np.full(n, -1, np.int32), np.zeros((n, k)), np.zeros((n, k), np.int16)
                cluster, far, seen, worked = assign(v, *state, history)
                lists = [pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), k).cast(pa.list_(t)) for x, t in ((far, pa.float64()), (seen.astype(np.int16), pa.int16()))]
                evaluated = np.zeros(n, np.int64)
                evaluated[0] = worked
                yield pa.RecordBatch.from_arrays([part[key], part["v"], pa.array(cluster, pa.int32()), *lists, pa.array(evaluated)], [key, "v", "cluster", "far", "seen", "evaluated"])

    return vectors.drop("evaluated").mapInArrow(run, f"{key} bigint, v array<bigint>, cluster int, far array<double>, seen array<smallint>, evaluated bigint")


def _means(assigned: DataFrame, before: np.ndarray) -> np.ndarray:
    """Componentwise floor of the exact means; k rows come to the driver."""
    sums = assigned.groupBy("cluster").agg(F.count("*").alias("n"), *[F.sum(F.col("v")[i].cast("decimal(20,0)")).alias(f"s{i}") for i in range(before.shape[1])]).collect()
    after = before.copy()
    for r in sums:
        after[r.cluster] = [int(r[f"s{i}"]) // r.n for i in range(before.shape[1])]
    return after


def cluster(vectors: DataFrame, key: str, k: int = K, rounds: int = ROUNDS, seed: str = "1:", effort: list | None = None) -> DataFrame:
    """(key, v, cluster, distance, cluster_inertia, inertia, centroid) of vectors (key, v): `rounds` rounds of k-means and
    a last assignment. effort: a list that gets the number of distances that each round worked out."""
    spark = vectors.sparkSession
    scratch = Scratch(spark, "centroids")
    rows = scratch.save(vectors, "vectors")
    start = first_centroids(rows, key, k, seed)
    kind = "cluster int, distance bigint, cluster_inertia bigint, inertia bigint, centroid array<bigint>"
    if not len(start):
        return spark.createDataFrame([], f"{key} bigint, v array<bigint>, {kind}")
    history = start[None]
    for r in range(rounds + 1):
        before, rows = rows, scratch.save(_round(rows, key, history), f"round-{r}")
        scratch.drop(before)
        if effort is not None:
            effort.append(rows.agg(F.sum("evaluated")).first()[0])
        if r < rounds:
            history = np.concatenate([history, _means(rows, history[-1])[None]])
    last = spark.createDataFrame([(j, [int(x) for x in c]) for j, c in enumerate(history[-1])], "cluster int, centroid array<bigint>")
    gap = F.zip_with("v", "centroid", lambda a, b: (a - b) * (a - b))
    rows = rows.join(F.broadcast(last), "cluster").withColumn("distance", F.aggregate(gap, F.lit(0).cast("bigint"), lambda a, x: a + x))  # k rows
    rows = scratch.save(rows.select(key, "v", "cluster", "distance"), "distances")
    inertia = rows.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))
    inertia = inertia.join(F.broadcast(inertia.agg(F.sum("cluster_inertia").alias("inertia")))).join(F.broadcast(last), "cluster")  # one row, k rows
    return rows.join(F.broadcast(inertia), "cluster").select(key, "v", "cluster", "distance", "cluster_inertia", "inertia", "centroid")


def op12_centroid_clustering(spark, sf_dir: str) -> DataFrame:
    found = cluster(quantise(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "vec_id", "embedding"), "vec_id")
    digest = F.sha2(F.array_join(F.col("centroid").cast("array<string>"), ","), 256)
    return found.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", digest.alias("centroid_sha256"))


def _sql() -> str:
    """The same rounds, each a pair of common table expressions."""
    steps = [f"""k AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS v
  FROM embeddings WHERE len(embedding) = {DIM} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {DIM}),
c0 AS MATERIALIZED (SELECT (row_number() OVER (ORDER BY h) - 1)::INTEGER AS c, v FROM (SELECT sha256('1:' || vec_id) AS h, v FROM k ORDER BY h LIMIT {K}))"""]  # fmt: skip
    for i in range(ROUNDS + 1):
        steps.append(f"""d{i} AS (SELECT r, vec_id, k.v, c, list_sum(list_transform(list_zip(k.v, c{i}.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM k, c{i}),
a{i} AS MATERIALIZED (SELECT r, vec_id, v, c, d FROM (SELECT *, row_number() OVER (PARTITION BY r ORDER BY d, c) AS n FROM d{i}) WHERE n = 1)""")
        if i < ROUNDS:
            steps.append(f"""m{i} AS (SELECT c, list(m ORDER BY j) AS v FROM (SELECT c, j, floor(sum(x) / count(*))::BIGINT AS m FROM (SELECT c, unnest(v) AS x, unnest(range({DIM})) AS j FROM a{i}) GROUP BY c, j) GROUP BY c),
c{i + 1} AS MATERIALIZED (SELECT c{i}.c, coalesce(m{i}.v, c{i}.v) AS v FROM c{i} LEFT JOIN m{i} ON m{i}.c = c{i}.c)""")
    return f"""WITH {", ".join(steps)}
SELECT vec_id, a{ROUNDS}.c AS cluster, d AS distance, (sum(d) OVER (PARTITION BY a{ROUNDS}.c))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia, sha256(array_to_string(c{ROUNDS}.v, ',')) AS centroid_sha256
FROM a{ROUNDS} JOIN c{ROUNDS} ON c{ROUNDS}.c = a{ROUNDS}.c"""


QUERIES = {"op12_centroid_clustering": op12_centroid_clustering}
SQL = {"op12_centroid_clustering": _sql()}
