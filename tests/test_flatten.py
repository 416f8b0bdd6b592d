"""Leaves of JSON against a plain recursion."""

import json
import random

from sluice.operators import cleaning as C


def leaves(value, depth, path="/"):
    for k, v in value.items():
        if isinstance(v, dict) and depth > 1:
            yield from leaves(v, depth - 1, f"{path}{k}/")
        else:
            yield f"{path}{k}/", v


def same(text, value):
    if value is None or isinstance(value, str):
        return text == value
    return json.loads(text) == value


def random_value(rng, deep):
    kind = rng.randint(0, 8 if deep else 6)
    if kind >= 7:
        return {rng.choice(["a", "b", "é", "x y", "key"]): random_value(rng, deep - 1) for _ in range(rng.randint(0, 3))}
    return [None, True, rng.randint(-99, 10**12), round(rng.random() * 100, 3), rng.choice(["", "{x", '{"a":1}', "[", "null", 'q"\\\n', "日😀"]), [1, {"z": ["{"]}], rng.choice(["plain", " {"])][kind]


def test_against_recursion(spark):
    rng = random.Random(8)
    given = [{k: random_value(rng, 5) for k in "abc"[: rng.randint(0, 3)]} for _ in range(200)]
    given[0] = {"a": {"b": 1}, "c": "{x", "d": None}
    df = spark.createDataFrame([(i, json.dumps(v, ensure_ascii=i % 2 == 0), "p", "v", 1) for i, v in enumerate(given)], "id int, content string, path string, value string, key int").repartition(3)
    for depth in (1, 2, 4):
        got = {i: {} for i in range(len(given))}
        for r in C.flatten_content(df, "content", "id", depth).collect():
            assert r.path not in got[r.id]
            got[r.id][r.path] = r.value
        for i, v in enumerate(given):
            expected = dict(leaves(v, depth))
            assert got[i].keys() == expected.keys()
            assert all(same(got[i][p], x) for p, x in expected.items()), (given[i], got[i])


def test_no_objects(spark):
    texts = [None, "", "no", "[1]", '"s"', "7", "{}", '{"a":', '{"a":1,"a":2}', '{"k":' * 3000 + "1" + "}" * 3000]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    assert {r.id for r in C.flatten_content(df, "t", "id").collect()} <= {9}
    assert C.flatten_content(df.limit(0), "t", "id").count() == 0
    long = json.dumps({"t": "{" * 2_000_000, "l": list(range(100_000))})
    got = {r.path: r.value for r in C.flatten_content(spark.createDataFrame([(1, long)], "id int, t string"), "t", "id").collect()}
    assert got["/t/"] == "{" * 2_000_000 and json.loads(got["/l/"]) == list(range(100_000))
