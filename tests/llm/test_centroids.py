"""k-means by bounds against k-means without any."""

import hashlib

import duckdb
import numpy as np
import pytest

from sluice.llm import centroids as C


def plain(vectors, k, rounds):
    """{id: (cluster, distance)} and centroids of whole-number vectors (id, list), in Python's own numbers."""
    if not vectors:
        return {}, []
    cents = [v for _, v in sorted(vectors, key=lambda x: (hashlib.sha256(f"1:{x[0]}".encode()).hexdigest(), x[1]))[:k]]
    dist = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    for r in range(rounds + 1):
        found = [min((dist(v, c), j) for j, c in enumerate(cents)) for _, v in vectors]
        if r < rounds:
            for j in range(len(cents)):
                own = [v for (_, v), (_, at) in zip(vectors, found) if at == j]
                if own:
                    cents[j] = [sum(x) // len(own) for x in zip(*own)]
    return sorted((i, j, d) for (i, _), (d, j) in zip(vectors, found)), cents


@pytest.mark.parametrize("seed,dim,k,rounds,spread", [(1, 3, 5, 6, 4), (2, 2, 7, 5, 1), (3, 8, 16, 3, 1000), (4, 1, 3, 8, 3), (5, 4, 1, 2, 9)])
def test_against_plain_rounds(spark, seed, dim, k, rounds, spread):
    rng = np.random.default_rng(seed)
    vectors = [(i, [int(x) for x in rng.integers(-spread, spread + 1, dim)]) for i in range(300)]
    effort = []
    out = C.cluster(spark.createDataFrame(vectors, "id bigint, v array<bigint>").repartition(3), "id", k, rounds, effort=effort).collect()
    expected, cents = plain(vectors, k, rounds)
    assert sorted((r.id, r.cluster, r.distance) for r in out) == expected
    assert all(list(r.centroid) == cents[r.cluster] for r in out)
    assert {r.inertia for r in out} == {sum(d for _, _, d in expected)}
    assert all(r.cluster_inertia == sum(d for _, j, d in expected if j == r.cluster) for r in out)
    assert effort[0] == 300 * len(cents) and all(e <= effort[0] for e in effort)


def test_bounds_spare_evaluations(spark):
    """Groups far apart: nobody is rescanned once the centroids hardly move; the whole displacement bounds more than moves."""
    rng = np.random.default_rng(7)
    vectors = [(i, [int(x) for x in rng.normal(0, 3, 4) + 1000 * (i % 4) * np.array([1, -1, 1, 0])]) for i in range(400)]
    effort = []
    C.cluster(spark.createDataFrame(vectors, "id bigint, v array<bigint>"), "id", 4, 6, effort=effort)
    assert effort[-1] < effort[0] / 2
    there = np.array([[[0, 0], [9, 9]], [[5, 0], [9, 9]], [[0, 0], [9, 9]]])  # a centroid that goes and comes back
    v = np.array([[1, 0]])
    first = C.assign(v, np.array([-1]), np.zeros((1, 2)), np.zeros((1, 2), np.int16), there[:1])
    assert C.assign(v, *first[:3], there)[3] == 0  # by the sum of its moves, 10, it would have to be looked at


def test_kept_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [0.5] * 64), (2, [0.5] * 63), (3, [0.5] * 65), (4, [nan] + [0.5] * 63), (5, [inf] + [0.0] * 63), (6, [None] + [0.0] * 63), (7, None), (8, []), (None, [-0.01] * 64), (1, [0.5] * 64)]
    df = spark.createDataFrame([(a, b, 1, 2) for a, b in rows], "vec_id bigint, embedding array<float>, cluster int, v int")
    kept = C.quantise(df, "vec_id", "embedding")
    assert sorted((r.vec_id or 0, r.v[0]) for r in kept.collect()) == [(0, -1), (1, 32), (1, 32)]
    out = C.cluster(kept, "vec_id").collect()
    assert sorted((r.vec_id or 0, r.cluster, r.distance) for r in out) == [(0, 0, 0), (1, 1, 0), (1, 1, 0)]
    assert C.cluster(kept.limit(0), "vec_id").count() == 0
    with pytest.raises(Exception, match="component"):
        C.quantise(spark.createDataFrame([(1, [3e30] * 64)], "vec_id bigint, embedding array<float>"), "vec_id", "embedding").collect()


def test_sql(spark, sf_dir):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf_dir}/embeddings.parquet'")
    expected = con.execute(C.SQL["op12_centroid_clustering"] + " ORDER BY vec_id").fetchall()
    got = C.op12_centroid_clustering(spark, sf_dir).orderBy("vec_id").collect()
    assert len(got) > 0 and [tuple(r) for r in got] == expected
