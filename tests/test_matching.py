"""Templates and dictionary spans against plain matchers, and on texts that no recursion survives."""

import random
import re
import time

import pytest

from sluice.operators import matching as M
from sluice.operators import search as T


def expression(template, lexicon, ignore):
    """The template as one regular expression with a group for each slot: what a match and its slots are, by backtracking."""
    gap = f"(?:{'|'.join(re.escape(w) for w in sorted(ignore, key=len, reverse=True))})*" if ignore else ""
    parts = []
    for kind, what in M.parse_template(template):
        if kind == "D":
            words = sorted(lexicon.get(what, []), key=lambda w: (len(w), w))
            parts.append(f"({'|'.join(map(re.escape, words))})" if words else "((?!))")
        else:
            parts.append(re.escape(what) if kind == "text" else f"(.{{{what[0]},{what[1]}}}?)" if kind == "W" else M._FUNCTIONS[what])
    return re.compile(f"(?s){gap}{gap.join(parts)}{gap}")


def random_case(rng):
    letters = "ab1é"
    word = lambda n: "".join(rng.choice(letters) for _ in range(rng.randint(1, n)))
    lexicon = {slot: [word(3) for _ in range(rng.randint(0, 3))] for slot in "xy"}
    ignore = [word(2) for _ in range(rng.randint(0, 2))]
    low = lambda: rng.randint(0, 2)
    part = [lambda: word(2), lambda: f"[D:{rng.choice('xyz')}]", lambda: f"[W:{(a := low())}-{a + rng.randint(0, 3)}]", lambda: "[F:num]"]
    templates = ["".join(rng.choice(part)() for _ in range(rng.randint(0, 4))) for _ in range(6)]
    queries = [word(8) for _ in range(12)] + [""]
    return templates, lexicon, ignore, queries


def test_random_templates():
    rng, n = random.Random(11), 0
    for _ in range(600):
        templates, lexicon, ignore, queries = random_case(rng)
        trie = M.Templates([(M.parse_template(t), (i, "")) for i, t in enumerate(templates)], lexicon, ignore, {"num": M._FUNCTIONS["num"]})
        for q in queries:
            expected = {i: list(m.groups()) for i, t in enumerate(templates) if (m := expression(t, lexicon, ignore).fullmatch(q))}
            assert {i: [v for _, v in slots] for i, slots in trie.match(q)} == expected
            n += len(expected)
    assert n > 1000


def test_templates_on_spark(spark):
    templates = [(7, "room[F:num]by[D:side]", "room"), (8, "[W:1-3]by[D:side]", "any"), (7, "room[F:num]by[D:side]", "again")]
    rows = [(1, "room12.5byeast"), (1, "room12.5byeast"), (2, "日本ébywest"), (3, None), (4, ""), (None, "umxumbyumwestum"), (5, "fourbywest")]
    queries = spark.createDataFrame([(i, q, "z") for i, q in rows], "query_id int, query string, slots string").repartition(3)
    found = M.match_templates(queries, templates, {"side": ["east", "west"]}, ["um"])
    assert "NestedLoop" not in (plan := found._jdf.queryExecution().executedPlan().toString()) and "Join" not in plan
    got = sorted((r.query_id or 0, r.attr, [tuple(s) for s in r.slots]) for r in found.collect())
    room = [("num", "12.5"), ("side", "east")]
    assert got == [(0, "any", [("W", "x"), ("side", "west")]), (1, "again", room), (1, "again", room), (1, "room", room), (1, "room", room), (2, "any", [("W", "日本é"), ("side", "west")])]
    assert [(r.ordinal, r.slot, r.value) for r in M.extract_slots(found.where("query_id = 2")).collect()] == [(0, "W", "日本é"), (1, "side", "west")]
    assert M.match_templates(queries.limit(0), templates, {}, []).count() == 0 and M.match_templates(queries, [], {}, []).count() == 0


def test_domains(spark):
    rows = [(1, "hi bob", ["a", "b", "a", "zz"]), (1, "hi bob", ["b"]), (2, "hi bob", None), (3, None, ["a"]), (4, "hi", ["b"])]
    queries = spark.createDataFrame(rows, "query_id int, query string, domains array<string>")
    known = {"a": ([(1, "hi[W:1-9]", "greet"), (2, "hi[W:1-4]", "short"), (3, "bye", "end")], {}, []), "b": ([(1, "hi[D:who]", "name")], {"who": ["bob"]}, [" "])}
    got = {(r.query_id, r.domain): (r.intents, r.score) for r in M.match_domains(queries, known).collect()}
    assert got == {(1, "a"): (["greet", "short"], 1.0), (1, "b"): (["name"], 1.0)}


@pytest.mark.parametrize("bad", ["[open", "[]after", "[D/side]after", "a]b", "[W:x-2]", "[W:1]", "[F:nothing]", "[Q:a]"])
def test_bad_templates(bad):
    with pytest.raises(ValueError, match="template"):
        M.parse_template(bad)


def test_many_templates_and_long_queries(spark):
    """100,000 templates; queries of a million characters in which every place can begin or end a part."""
    templates = [(i, f"find {i} [D:thing] in[W:1-40]", f"a{i % 7}") for i in range(100_000)]
    trie = M.Templates([(M.parse_template(t), (i, a)) for i, t, a in templates], {"thing": ["a", "ab"]}, ["um"], {})
    begun = time.time()
    assert [(place, slots) for place, slots in trie.match("umfind 31337 umab inumthe hall")] == [(31337, [("thing", "ab"), ("W", "the hall")])]
    assert time.time() - begun < 1
    long = [(1, "um" * 500_000), (2, "a😀" * 500_000), (3, "um" * 400_000 + "x" + "aa" * 100_000)]
    queries = spark.createDataFrame(long, "query_id int, query string")
    found = M.match_templates(queries, [(1, "", "empty"), (2, "[W:999999-1000001]", "all"), (3, "[W:0-9]x[W:1-200000]", "tail"), (4, "[D:w][W:0-1000000]", "word")], {"w": ["a", "aa", "um"]}, ["um", "umum"])
    got = {(r.query_id, r.attr): [(s.slot, len(s.value)) for s in r.slots] for r in found.collect()}
    assert got == {(1, "empty"): [], (1, "all"): [("W", 1_000_000)], (1, "word"): [("w", 2), ("W", 0)], (2, "all"): [("W", 1_000_000)], (2, "word"): [("w", 1), ("W", 999_999)], (3, "all"): [("W", 999_999)], (3, "tail"): [("W", 0), ("W", 200_000)], (3, "word"): [("w", 2), ("W", 200_001)]}


def plain_spans(text, dictionary, unknown):
    out, gap, at = [], "", 0
    while at < len(text):
        word = max((w for w in dictionary if w and text.startswith(w, at)), key=len, default=None)
        if word:
            out += [(gap, unknown)] * bool(gap) + [(word, dictionary[word])]
            gap, at = "", at + len(word)
        else:
            gap, at = gap + text[at], at + 1
    return out + [(gap, unknown)] * bool(gap)


def test_spans():
    rng = random.Random(3)
    word = lambda n: "".join(rng.choice("abc😀.") for _ in range(rng.randint(0, n)))
    for _ in range(3000):
        dictionary = {word(5): i for i in range(rng.randint(0, 6))}
        text = word(20)
        assert list(M.Spans(dictionary, 0).spans(text)) == plain_spans(text, dictionary, 0)


def test_spans_on_spark(spark):
    texts = [None, "", "the man", "anderer mann", "日the日", "a😀" * 40_000, "x" * 1_200_000, "the" * 30_000, "the man"]
    words = {"the": 3, "an": 4, "ander": 5, "": 9}
    rows = [((i, 0), t, "s") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "k struct<a:int,b:int>, t string, section string").repartition(3)
    got = {}
    for r in M.tag_spans(df, "k", "t", words, 7).orderBy("k", "ordinal").collect():
        assert r.ordinal == len(got.setdefault(r.k.a, []))
        got[r.k.a].append((r.section, r.attr))
    assert got == {i: plain_spans(t, words, 7) if len(t) < 100 else [(t, 7)] if "the" not in t else [("the", 3)] * 30_000 for i, t in enumerate(texts) if t}
    many = {f"w{i}": i for i in range(200_000)}
    assert [(r.section, r.attr) for r in M.tag_spans(df.where("k.a = 2").selectExpr("k", "concat(t, 'w199999w7') AS t"), "k", "t", many).collect()] == [("the man", 0), ("w199999", 199_999), ("w7", 7)]
    assert M.tag_spans(df, "k", "t", {}, 7).count() == 7 and M.tag_spans(df.limit(0), "k", "t", words).count() == 0
    terms = T.tag_query(df.where("k.a = 3"), "k", "t", words).collect()
    assert [(r.pos, r.term, r.attr) for r in terms] == [(0, "ander", 5), (1, "er", 0), (2, "m", 0), (3, "an", 4), (4, "n", 0)]
