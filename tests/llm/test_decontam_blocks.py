"""A benchmark in one block and in many gives the same rows, also where rows share a doc_id."""

import numpy as np
import pytest

from sluice.llm import decontam

ITEMS = [(1, "a b c"), (2, "d e f"), (2, "g h"), (3, " ".join(f"q{i}" for i in range(30))), (4, "solo"), (5, None), (6, "a b c"), (7, " ".join(f"q{i}" for i in range(25, 45)))]
TEXTS = [
    (1, "x a b c d e f y"), (1, "x a b c d e f y"), (1, "nothing here"), (2, None), (3, ""), (4, "a b c"), (None, "u solo v w x y z"), (5, " ".join(f"q{i}" for i in range(45))),
    (6, "w " * 80 + " ".join(f"q{i}" for i in range(20, 40)) + " w" * 80), (7, "g h d e f tail tail tail tail tail"),
]


def both(spark, monkeypatch, run):
    out = []
    for chars in (1 << 21, 12):
        monkeypatch.setattr(decontam, "BLOCK_CHARS", chars)
        out.append(sorted(map(repr, run().collect())))
    return out


def test_blocks_change_nothing(spark, monkeypatch):
    docs = spark.createDataFrame([(d, t, None if t is None else len(t), 1, "x") for d, t in TEXTS], "doc_id bigint, text string, n_chars bigint, _row int, runs string").repartition(3)
    bench = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    one, many = both(spark, monkeypatch, lambda: decontam.matches(docs, bench))
    assert one == many and len(one) == len(TEXTS)
    one, many = both(spark, monkeypatch, lambda: decontam.clean(docs, bench))
    assert one == many
    assert decontam.clean(docs.where("text LIKE 'x a%'"), bench).first().text == "x  y"
    one, many = both(spark, monkeypatch, lambda: decontam.clean(docs.limit(0), bench))
    assert one == many == []


def test_random_blocks(spark, monkeypatch):
    rng = np.random.default_rng(12)
    words = list("abcdefgh")
    items = [(i, " ".join(rng.choice(words, int(n)))) for i, n in enumerate(rng.integers(1, 25, 20))]
    texts = [(i % 9, " ".join(rng.choice(words, int(n)))) for i, n in enumerate(rng.integers(0, 200, 30))]
    docs, bench = spark.createDataFrame(texts, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    for run in (lambda: decontam.matches(docs, bench), lambda: decontam.clean(docs, bench, max_coverage=0.9, min_run=12)):
        one, many = both(spark, monkeypatch, run)
        assert one == many


@pytest.mark.parametrize("runs, expected", [([], []), ([(5, 9, False), (0, 5, True)], [[0, 9, True]]), ([(0, 3, False), (4, 6, True), (1, 2, False)], [[0, 3, False], [4, 6, True]])])
def test_merged(runs, expected):
    assert decontam.merged(runs) == expected
