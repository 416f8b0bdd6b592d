"""Pages of the best documents against all matches, scored and ranked."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sluice.operators import search as T
from sluice.operators import topk as K


def corpus(spark, seed, documents, key):
    rng = np.random.default_rng(seed)
    words = [f"w{i}" for i in range(40)]
    share = 1 / np.arange(1, 41)
    text = lambda n: " ".join(rng.choice(words, n, p=share / share.sum()))
    rows = [(i, text(int(rng.integers(1, 60))) + ("\n" + text(5) if i % 3 else ""), words[i % 40]) for i in range(documents)]
    rows += [(documents + i, "w1 w2 w3", None) for i in range(40)]  # ties
    docs = spark.createDataFrame(rows, "n int, text string, kw string").select(F.expr(key).alias("doc_id"), "text", "kw", "n")
    terms = [(q, p, t, int(rng.choice([0, 1, 2, 3, 10])) if q % 3 else 0) for q in range(25) for p, t in enumerate(rng.choice([*words, "unknown"], int(rng.integers(1, 9))))]
    query = spark.createDataFrame(terms, "query_id int, pos int, term string, attr int").withColumn("idf", F.length("term") * 1.5).withColumn("query_bytes", F.lit(30))
    return docs, query


@pytest.mark.parametrize("key,block,part,page,size,boosted", [("n", 1 << 15, 128, 0, 10, False), ("n", 50, 4, 0, 3, False), ("concat('k', n)", 90, 7, 1, 5, False), ("n", 60, 5, 0, 8, True)])
def test_against_all_matches(spark, monkeypatch, key, block, part, page, size, boosted):
    monkeypatch.setattr(K, "BLOCK", block)
    monkeypatch.setattr(K, "PART", part)
    docs, query = corpus(spark, block + size, 400, key)
    postings = T.build_index(docs, "doc_id", "text", "kw")
    values = docs.where("n % 5 <> 0").selectExpr("doc_id", "nullif(n % 7, 3) AS x", "-(n % 3) AS y")
    boosts = {"x": 40.0, "y": 25.0} if boosted else None
    scored = T.score(T.retrieve(T.weigh_query(query), postings, "doc_id"), "doc_id")
    if boosted:
        scored = T.adjust_scores(scored.join(values, "doc_id", "left").na.fill(0), boosts)
    expected = T.rank_results(scored.withColumnRenamed("weight" if boosted else "score", "weight").select("query_id", "doc_id", "weight"), "doc_id", page, size)
    got = T.search(query, postings, "doc_id", page, size, values=values if boosted else None, boosts=boosts)
    columns = ["query_id", "doc_id", "weight", "rank", "total"]
    got, expected = (sorted(map(tuple, x.select(*columns).collect())) for x in (got, expected))
    assert got == expected and len(got) > 20


def test_parts_out_of_reach_are_not_scored(spark, monkeypatch):
    monkeypatch.setattr(K, "PART", 8)
    scored = []
    plain = K.Block._score
    monkeypatch.setattr(K.Block, "_score", lambda self, docs, *sums: scored.append(len(docs)) or plain(self, docs, *sums))
    import pyarrow as pa

    n = 4000
    weights = np.linspace(1, 900_000_000, n).astype(np.int64)
    rows = pa.table({"term": ["a"] * n, "key": np.arange(n), "place": np.ones(n, np.int8), "d0": weights})
    block = K.Block(rows, None, 10_000.0, [])
    total, doc, weight = block.best(0, [{"term": "a", "main": 0, "keyword": 0, "title": 800_000_000, "kind": 0, "counts": 0}], 10, -np.inf)
    assert total == n and 10 <= sum(scored) < 100
    assert block.keys.take(pa.array(doc)).to_pylist() == list(range(n - 1, n - 11, -1)) and weight[0] == 7200.0


def test_nothing_to_find(spark):
    docs, query = corpus(spark, 1, 5, "n")
    postings = T.build_index(docs, "doc_id", "text", "kw")
    assert T.search(query.where("term = 'unknown'"), postings, "doc_id").count() == 0
    assert T.search(query.limit(0), postings, "doc_id").count() == 0
    assert T.search(query, postings.limit(0), "doc_id").count() == 0


def test_rounding():
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.random(2000) * 10_000, np.arange(2000) / 16 + 0.0005, [0.0, 1.0005, 2.6745, 9999.9995]])
    from decimal import ROUND_HALF_UP, Decimal

    assert K.rounded(x).tolist() == [float(Decimal(repr(v)).quantize(Decimal("0.001"), ROUND_HALF_UP)) for v in x.tolist()]
