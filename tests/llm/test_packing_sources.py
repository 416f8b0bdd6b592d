"""Packing with many sources, and with target weights."""

from collections import defaultdict
from fractions import Fraction

import numpy as np
import pytest

from sluice.llm import packing


def corpus(spark, sources):
    rng = np.random.default_rng(6)
    rows = [(i, " ".join(rng.choice(["a", "bc", "the", "of"], int(rng.integers(1, 30)))), s) for i, s in enumerate(sources)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, source string").repartition(3)


def brute(docs, window, weights=None):
    """Pieces (doc_id, start, length, sequence_id, offset) by a sort of all tokens by due time, in fractions."""
    queues = defaultdict(list)
    for r in sorted(packing.encode(docs, packing.vocabulary_path()).select("doc_id", "source", "tokens").collect()):
        queues["" if r.source is None else "=" + r.source] += [(r.doc_id, k) for k in range(r.tokens)]
    names = sorted(queues)
    turns = sorted((Fraction(2 * j + 1) / Fraction(weights[n] if weights else len(queues[n])), q, j) for q, n in enumerate(names) for j in range(len(queues[n])))
    out = set()
    for w in range(-(-len(turns) // window)):
        at = 0
        for _, q, j in sorted(turns[w * window : (w + 1) * window], key=lambda x: x[1:]):
            doc, k = queues[names[q]][j]
            if at and last[0] == doc and last[1] + last[2] == k:
                last[2] += 1
            else:
                if at:
                    out.add(tuple(last))
                last = [doc, k, 1, w, at]
            at += 1
        out.add(tuple(last))
    return out


def test_every_one_of_many_sources_has_its_queue(spark):
    docs = corpus(spark, ["hot"] * 200 + [f"s{i % 300}" for i in range(420)] + [None])
    got = packing.pack(docs, window=64).collect()
    assert {(r.doc_id, r.start, r.length, r.sequence_id, r.offset) for r in got} == brute(docs, 64)


def test_sorted_turns_pack_as_counts_do(spark, monkeypatch):
    docs = corpus(spark, [f"s{i % 7}" for i in range(90)] + [None, "s1"])
    few = packing.pack(docs, window=64, with_ids=True).collect()
    monkeypatch.setattr(packing, "MAX_QUEUES", 2)
    many = packing.pack(docs, window=64, with_ids=True).collect()
    assert sorted(map(repr, few)) == sorted(map(repr, many))


def test_target_weights(spark):
    docs = corpus(spark, ["a"] * 60 + ["b"] * 60 + ["c"] * 20)
    weights = spark.createDataFrame([("a", 3.0), ("b", 1.0), ("c", 0.5), ("none", 2.0)], "source string, weight double")
    got = packing.pack(docs, window=64, weights=weights).collect()
    assert {(r.doc_id, r.start, r.length, r.sequence_id, r.offset) for r in got} == brute(docs, 64, {"=a": 3.0, "=b": 1.0, "=c": 0.5})
    first = defaultdict(int)
    for r in got:
        if r.sequence_id < 5:
            first[r.source] += r.length
    assert abs(first["a"] - 3 * first["b"]) <= 4 and abs(first["b"] - 2 * first["c"]) <= 3
    with pytest.raises(ValueError, match="weight"):
        packing.pack(docs, weights=weights.limit(1))
    with pytest.raises(ValueError, match="more than one"):
        packing.pack(docs, weights=weights.union(weights))
    assert packing.pack(docs.limit(0), weights=weights).count() == 0


def test_weights_sort_no_tokens(spark, monkeypatch):
    def unwanted(*a):
        raise AssertionError("a row a token")

    monkeypatch.setattr(packing, "_pack_sorted", unwanted)
    rng = np.random.default_rng(3)
    docs = corpus(spark, [None if i % 9 == 0 else f"s{int(rng.integers(0, 12))}" for i in range(150)])
    names = ["", *(f"=s{i}" for i in range(12))]
    values = [0.1, 1 / 3, 1e-3, 2.0, 2.0, 7.25, 1e4, 0.3, 0.1, 5.0, 1.0, 1.0, 0.7]
    weights = spark.createDataFrame([(n[1:] if n else None, v) for n, v in zip(names, values)], "source string, weight double")
    got = packing.pack(docs, window=32, weights=weights).collect()
    assert {(r.doc_id, r.start, r.length, r.sequence_id, r.offset) for r in got} == brute(docs, 32, dict(zip(names, values)))


@pytest.mark.parametrize("scale", [1, 10**9, 3 * 10**13])
def test_turns_by_weight_are_exact_at_any_size(scale):
    """Counts at a window's start are those of the exact order: no token left is due before one that was given."""
    totals, weights = np.array([7, 5, 11, 1]) * scale, [0.1, 0.3, 2.0, 0.1]
    total = int(totals.sum())
    paces = packing.Paces(totals, weights)
    starts = [0, 1, total // 7, total // 2, total // 2 + 1, total - 3, total]
    for n, row in zip(starts, paces.served(np.array(starts)).tolist()):
        assert sum(row) == n and all(0 <= g <= t for g, t in zip(row, totals))
        turn = lambda q, j: (Fraction(2 * j + 1) / Fraction(weights[q]), q)
        last = max((turn(q, g - 1) for q, g in enumerate(row) if g), default=(0, 0))
        assert all(turn(q, g) > last for q, g in enumerate(row) if g < totals[q])
