"""Query understanding: templates with slots, dictionary spans, and arbitration between answers.

Both matchers are automata that a task walks over a text once: no regular expression over texts, no recursion, any
characters and any length. Dictionaries and templates are hand-made tables of the driver's; they are broadcast, and a
worker builds its automaton once, for all its tasks.
"""

from __future__ import annotations

import itertools
import re
import uuid
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Rows of a result that a task holds at once.
_ROWS = 8192
#: Built automata that a worker keeps, by what they were built from.
_BUILT: dict[str, object] = {}
_KEPT = 8
#: Characters of a dictionary's or of all templates' words, at most: an executor holds the table and its automaton.
TABLE_CHARS = 64 << 20
_FUNCTIONS = {"num": r"([0-9.]*+)"}
#: A function whose value is as many characters of a class as there are: runs tell all its values at once.
_RUN = re.compile(r"\((\[[^\[\]\\^]+\])\*\+\)")
_PART = re.compile(r"\[([^\[\]]*)\]|([^\[\]]+)|(.)", re.S)


def register_template_function(name: str, pattern: str) -> None:
    """For [F:name]: what the pattern matches at a place is the function's value there; where it does not, no match."""
    re.compile(pattern)
    _FUNCTIONS[name] = pattern


@dataclass(frozen=True)
class Shared:
    """A hand-made table that every worker has; its size is checked before it is sent."""

    name: str
    table: Broadcast

    @classmethod
    def send(cls, spark: SparkSession, table: tuple, words: Iterable[str]) -> Shared:
        if (n := sum(map(len, words))) > TABLE_CHARS:
            raise ValueError(f"a table of {n} characters; at most {TABLE_CHARS} are sent to every executor")
        return cls(uuid.uuid4().hex, spark.sparkContext.broadcast(table))

    def built(self, build: Callable):
        """What `build` makes of the table, once for each worker."""
        if self.name not in _BUILT:
            while len(_BUILT) >= _KEPT:
                _BUILT.pop(next(iter(_BUILT)))
            _BUILT[self.name] = build(*self.table.value)
        return _BUILT[self.name]


def automaton(words: dict[str, object]) -> ahocorasick.Automaton | None:
    """Finds the value of every occurrence of every word; None without words."""
    out = ahocorasick.Automaton()
    for word, value in words.items():
        out.add_word(word, value)
    out.make_automaton()
    return out if words else None


@dataclass
class Node:
    """A state of the template trie. words: by the number of a literal or lexicon slot, the next state; wild and functions:
    (parameters, next state); ends: (template's place in the table) of the templates that end here."""

    words: dict[int, int] = field(default_factory=dict)
    wild: dict[tuple[int, int], int] = field(default_factory=dict)
    functions: dict[str, int] = field(default_factory=dict)
    ends: list[int] = field(default_factory=list)
    above: int = -1
    edge: tuple = ()


def parse_template(template: str) -> list[tuple[str, object]]:
    """Parts of a template: ("text", literal), ("D", slot), ("W", (low, high)) or ("F", function)."""
    parts = []
    for inner, literal, stray in _PART.findall(template):
        if literal:
            parts.append(("text", literal))
            continue
        kind, colon, name = inner.partition(":")
        if stray or not colon or kind not in ("D", "W", "F") or not name:
            raise ValueError(f"template {template!r}: {stray or inner!r} is not [D:slot], [W:a-b] or [F:function]")
        if kind == "W":
            if not (m := re.fullmatch(r"(\d+)-(\d+)", name)):
                raise ValueError(f"template {template!r}: {inner!r} is not [W:a-b]")
            parts.append(("W", (int(m[1]), int(m[2]))))
        elif kind == "F" and name not in _FUNCTIONS:
            raise ValueError(f"template {template!r}: no function {name!r} is registered")
        else:
            parts.append((kind, name))
    return parts


class Query:
    """Where the templates' words stand in a query, sorted by place, the shortest first, and what functions give there.

    words: by the number of a literal or lexicon slot, (places, length) for each of its words."""

    def __init__(self, trie: Templates, text: str):
        self.trie, self.text, self.words, self.values = trie, text, {}, {}
        found = list(trie.found.iter(text)) if trie.found else []
        end, word = np.fromiter(itertools.chain.from_iterable(found), np.int64, 2 * len(found)).reshape(-1, 2).T
        size = trie.sizes[word]
        start = end - size + 1
        for w in np.flatnonzero(np.bincount(word, minlength=1)).tolist():
            if trie.edges[w]:
                places = start[word == w]
                for e in trie.edges[w]:
                    self.words.setdefault(e, []).append((places, int(trie.sizes[w])))
        order = np.lexsort((size, start))
        self.start, self.word = start[order], word[order]
        skips = order[trie.skips[word[order]]]
        self.skipped, self.after = start[skips], start[skips] + size[skips]

    def at(self, place: int) -> list[tuple[int, tuple[int, ...], bool]]:
        """The words that begin at a place: length, edges, ignorable; the shortest first."""
        first, last = np.searchsorted(self.start, [place, place + 1])
        return [(int(self.trie.sizes[w]), self.trie.edges[w], bool(self.trie.skips[w])) for w in self.word[first:last].tolist()]

    def skip(self, here: np.ndarray) -> None:
        """Adds the places that ignorable words lead to."""
        for _ in range(4):  # most chains are short
            lead = here[self.skipped] & ~here[self.after]
            if not lead.any():
                return
            here[self.after[lead]] = True
        lead = here[self.skipped] & ~here[self.after]
        if lead.any():
            first, flags = int(np.argmax(lead)), memoryview(here.view(np.uint8))
            for x, y in zip(self.skipped[first:].tolist(), self.after[first:].tolist(), strict=True):
                if flags[x]:
                    flags[y] = 1

    def skip_back(self, good: np.ndarray, here: np.ndarray) -> None:
        """Adds the active places that ignorable words lead from to good ones."""
        fine = here[self.skipped]
        x, y = self.skipped[fine], self.after[fine]
        for _ in range(4):
            lead = good[y] & ~good[x]
            if not lead.any():
                return
            good[x[lead]] = True
        lead = good[y] & ~good[x]
        if lead.any():
            last, flags = len(lead) - int(np.argmax(lead[::-1])), memoryview(good.view(np.uint8))
            for a, b in zip(reversed(x[:last].tolist()), reversed(y[:last].tolist()), strict=True):
                if flags[b]:
                    flags[a] = 1

    def ends(self, name: str, at: np.ndarray) -> np.ndarray:
        """By place, where a function's value that begins there ends, or -1; known for the places asked for."""
        if name not in self.values:
            self.values[name] = np.full(len(self.text) + 1, -2)
            if run := self.trie.runs.get(name):
                ends = self.values[name] = np.arange(len(self.text) + 1)
                for m in run.finditer(self.text):
                    ends[m.start() : m.end()] = m.end()
        ends, match = self.values[name], self.trie.functions[name].match
        for place in at[ends[at] == -2].tolist():
            ends[place] = found.end() if (found := match(self.text, place)) else -1
        return ends


class Templates:
    """All templates as one trie with typed edges, walked over a query from left to right.

    A state has the places at which it is active as a row of flags, filled from its only parent's, so that an edge costs
    array operations over a query and not a step for each place; templates with a common beginning share
    their states, and a literal or lexicon edge is looked at only where one of its words stands, so that the work follows
    the query and what matches in it, not the number of templates. Ignorable words lead from a state to itself.
    """

    def __init__(self, templates: list[tuple[list, object]], lexicon: dict[str, list[str]], ignore: list[str], functions: dict[str, str]):
        self.nodes, self.tables = [Node()], templates
        self.functions = {name: re.compile(pattern) for name, pattern in functions.items()}
        number: dict[tuple, int] = {}
        for place, (parts, _) in enumerate(templates):
            at = 0
            for kind, what in parts:
                node = self.nodes[at]
                key = number.setdefault((kind, what), len(number)) if kind in ("text", "D") else what
                edges = {"text": node.words, "D": node.words, "W": node.wild, "F": node.functions}[kind]
                if key not in edges:
                    edges[key] = len(self.nodes)
                    self.nodes.append(Node(above=at, edge=(kind, what, key)))
                at = edges[key]
            self.nodes[at].ends.append(place)
        words: dict[str, list[int]] = {}
        for (kind, what), i in number.items():
            for word in {what} if kind == "text" else set(lexicon.get(what, [])):
                words.setdefault(word, []).append(i)
        self.ignore = {w for w in ignore if w}
        for word in self.ignore:
            words.setdefault(word, [])
        self.empty = words.pop("", [])  # an empty word of a lexicon stands everywhere
        self.edges = [tuple(i) for i in words.values()]
        self.sizes, self.skips = np.array([len(w) for w in words], np.int64), np.array([w in self.ignore for w in words], bool)
        self.found = automaton({w: i for i, w in enumerate(words)})
        self.runs = {name: re.compile(m[1] + "+") for name, p in self.functions.items() if (m := _RUN.fullmatch(p.pattern))}

    def walk(self, query: Query) -> dict[int, np.ndarray]:
        """State -> whether it is active at each place, of all states that are ever active."""
        n, active = len(query.text), {}
        start = np.zeros(n + 1, bool)
        start[0] = True
        todo = [(0, start)]
        while todo:
            state, here = todo.pop()
            query.skip(here)
            active[state], node, nexts = here, self.nodes[state], {}

            def reached(to: int) -> np.ndarray:
                return nexts[to] if to in nexts else nexts.setdefault(to, np.zeros(n + 1, bool))

            few, many = (query.words, node.words) if len(query.words) < len(node.words) else (node.words, query.words)
            for e in few:
                if e in many:
                    for starts, size in query.words[e]:
                        if (hit := starts[here[starts]]).size:
                            reached(node.words[e])[hit + size] = True
            for e in self.empty:
                if e in node.words:
                    np.logical_or(reached(node.words[e]), here, out=reached(node.words[e]))
            at = np.flatnonzero(here) if node.functions or node.wild else None
            for name, to in node.functions.items():
                if (ends := query.ends(name, at)[at])[ends >= 0].size:
                    reached(to)[ends[ends >= 0]] = True
            for (low, high), to in node.wild.items():
                if (first := at[at + low <= n]).size and low <= high:
                    if high - low >= n:
                        reached(to)[first[0] + low :] = True
                    else:
                        reached(to)[:] = np.cumsum(np.bincount(first + low, minlength=n + 2) - np.bincount(np.minimum(first + high, n) + 1, minlength=n + 2))[: n + 1] > 0
            todo.extend(nexts.items())
        return active

    def slots(self, query: Query, active: dict[int, np.ndarray], leaf: int) -> list[tuple[str, str]]:
        """The slots of a match that ends in a state. Of several ways the first is taken: at each place rather one more
        ignorable word (the longest first) than none, then the shortest word of a lexicon, the shortest wildcard."""
        n, path = len(query.text), [leaf]
        while self.nodes[path[-1]].above >= 0:
            path.append(self.nodes[path[-1]].above)
        path.reverse()
        good: list[np.ndarray] = [np.zeros(n + 1, bool) for _ in path]  # from where the rest of the template can be met
        good[-1][n] = True
        for i in reversed(range(len(path))):
            here = active[path[i]]
            if i + 1 < len(path):
                (kind, what, key), after, mine = self.nodes[path[i + 1]].edge, good[i + 1], good[i]
                at = np.flatnonzero(here)
                if kind == "W":
                    before = np.concatenate([[0], np.cumsum(after)])  # how many good ends come earlier
                    mine[at] = before[np.minimum(at + what[1], n) + 1] > before[np.minimum(at + what[0], n + 1)]
                elif kind == "F":
                    ends = query.ends(what, at)[at]
                    mine[at] = (ends >= 0) & after[ends]
                else:
                    for starts, size in query.words.get(key, ()):
                        mine[starts[here[starts] & after[starts + size]]] = True
                    if key in self.empty:
                        mine |= here & after
            query.skip_back(good[i], here)
        out, at = [], 0
        for i in range(len(path)):
            while (more := next((at + size for size, _, skip in reversed(query.at(at)) if skip and good[i][at + size]), None)) is not None:
                at = more
            if i + 1 < len(path):
                (kind, what, key), after = self.nodes[path[i + 1]].edge, good[i + 1]
                if kind == "W":
                    end = at + what[0] + int(np.argmax(after[at + what[0] : min(at + what[1], n) + 1]))
                elif kind == "F":
                    end = int(query.ends(what, np.array([at]))[at])
                else:
                    end = next(x for x in (*([at] if key in self.empty else []), *(at + size for size, edges, _ in query.at(at) if key in edges)) if after[x])
                if kind != "text":
                    out.append((what if kind != "W" else "W", query.text[at:end]))
                at = end
        return out

    def match(self, query: str | None, with_slots: bool = True) -> list[tuple[int, list]]:
        """Places in the table of the templates that match a whole query, with their slots."""
        if query is None:
            return []
        query = Query(self, query)
        active = self.walk(query)
        leaves = sorted(s for s, at in active.items() if self.nodes[s].ends and at[-1])
        return [(place, slots) for s in leaves for slots in [self.slots(query, active, s) if with_slots else []] for place in self.nodes[s].ends]


def _compiled(spark, templates: list[tuple[int, str, str]], lexicon: dict[str, list[str]], ignore: list[str]) -> Shared:
    """The tables as the driver has them, the templates parsed."""
    used = [(parse_template(t), (i, attr)) for i, t, attr in templates]
    names = {what for parts, _ in used for kind, what in parts if kind == "F"}
    words = [*(t for _, t, _ in templates), *(w for slot in lexicon.values() for w in slot), *ignore]
    return Shared.send(spark, (used, lexicon, ignore, {name: _FUNCTIONS[name] for name in names}), words)


def _kind(df: DataFrame, column: str) -> str:
    return df.schema[column].dataType.simpleString()


def match_templates(queries: DataFrame, templates: list[tuple[int, str, str]], lexicon: dict[str, list[str]], ignore: list[str], columns: tuple[str, ...] = ("query", "slots")) -> DataFrame:
    """(query_id, query, template_id, attr, slots) of each template (id, text, attr) that matches a whole query, with its
    slots (slot, value) in order; a null query matches none. Literals, [D:slot] (a word of the lexicon), [W:a-b] (a to b
    characters) and [F:function]; ignorable words may stand between any two parts, and at both ends. Queries stay where
    they are; each is walked once, whatever the number of templates. columns: what of the query and the slots is wanted;
    without them no text leaves a task, and slots are not looked for."""
    table = _compiled(queries.sparkSession, templates, lexicon, ignore)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = table.built(Templates)

        def rows(b: pa.RecordBatch, found: list) -> pa.RecordBatch:
            owner = pa.array([i for i, _, _ in found], pa.int64())
            ids = [trie.tables[place][1] for _, place, _ in found]
            out = {"query_id": b["query_id"].take(owner)}
            if "query" in columns:
                out["query"] = b["query"].take(owner)
            out |= {"template_id": pa.array([i for i, _ in ids], pa.int32()), "attr": pa.array([a for _, a in ids], pa.string())}
            if "slots" in columns:
                out["slots"] = pa.array([[{"slot": n, "value": v} for n, v in s] for _, _, s in found], pa.list_(pa.struct([("slot", pa.string()), ("value", pa.string())])))
            return pa.RecordBatch.from_arrays(list(out.values()), list(out))

        for b in batches:
            found = []
            for i, query in enumerate(b["query"]):
                for place, slots in trie.match(query.as_py(), "slots" in columns):
                    found.append((i, place, slots))
                    if len(found) == _ROWS:
                        yield rows(b, found)
                        found = []
            yield rows(b, found)

    schema = f"query_id {_kind(queries, 'query_id')}, {'query string, ' * ('query' in columns)}template_id int, attr string{', slots array<struct<slot:string,value:string>>' * ('slots' in columns)}"
    return queries.select("query_id", F.col("query").cast("string").alias("query")).mapInArrow(run, schema)


def extract_slots(matches: DataFrame) -> DataFrame:
    """(query_id, template_id, attr, ordinal, slot, value) of the slots of each match."""
    rows = matches.select("query_id", "template_id", "attr", F.posexplode("slots").alias("ordinal", "_s"))
    return rows.select("query_id", "template_id", "attr", "ordinal", "_s.slot", "_s.value")


def match_domains(queries: DataFrame, dictionaries: dict[str, tuple[list, dict, list]]) -> DataFrame:
    """Queries (query_id, query, domains) against the templates of each domain that they name; unknown domains are
    skipped. One row a query and domain with its matched attributes; the score is 1. Queries are read once."""
    spark = queries.sparkSession
    tables = {name: _compiled(spark, *dictionary) for name, dictionary in dictionaries.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tries = {name: table.built(Templates) for name, table in tables.items()}
        for b in batches:
            found = []
            for i, (query, domains) in enumerate(zip(b["query"].to_pylist(), b["domains"].to_pylist(), strict=True)):
                for name in dict.fromkeys(d for d in domains or () if d in tries):
                    intents = sorted({tries[name].tables[place][1][1] for place, _ in tries[name].match(query, False)})
                    if intents:
                        found.append((i, name, intents))
            owner = pa.array([i for i, _, _ in found], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [b["query_id"].take(owner), pa.array([d for _, d, _ in found], pa.string()), pa.array([x for _, _, x in found], pa.list_(pa.string()))], ["query_id", "domain", "intents"]
            )

    rows = queries.select("query_id", F.col("query").cast("string").alias("query"), "domains").mapInArrow(run, f"query_id {_kind(queries, 'query_id')}, domain string, intents array<string>")
    together = rows.groupBy("query_id", "domain").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("intents")))).alias("intents"))  # rows may share a query_id
    return together.withColumn("score", F.lit(1.0))


class Spans:
    """A dictionary as an automaton; spans() parts a text from the left by the longest word at each place."""

    def __init__(self, dictionary: dict[str, int], unknown: int):
        self.unknown = unknown
        self.found = automaton({w: (len(w), a) for w, a in dictionary.items() if w})

    def spans(self, text: str) -> Iterator[tuple[str, int]]:
        longest: dict[int, tuple[int, int]] = {}
        for end, (n, attr) in self.found.iter(text) if self.found else ():
            start = end - n + 1
            if n > longest.get(start, (0, 0))[0]:
                longest[start] = (n, attr)
        at = 0
        for start in sorted(longest):
            if start >= at:
                n, attr = longest[start]
                if start > at:
                    yield text[at:start], self.unknown
                yield text[start : start + n], attr
                at = start + n
        if at < len(text):
            yield text[at:], self.unknown


def tag_spans(df: DataFrame, key: str, column: str, dictionary: dict[str, int], unknown: int = 0) -> DataFrame:
    """(key, ordinal, section, attr): from the left the longest dictionary word at each place, gaps as unknown sections.
    A null or empty text has none; empty words of a dictionary are no words."""
    table = Shared.send(df.sparkSession, (dict(dictionary), unknown), dictionary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spans = table.built(Spans)

        def rows(b: pa.RecordBatch, found: list) -> pa.RecordBatch:
            owner, ordinal, section, attr = zip(*found) if found else ((), (), (), ())
            return pa.RecordBatch.from_arrays([b[0].take(pa.array(owner, pa.int64())), pa.array(ordinal, pa.int32()), pa.array(section, pa.string()), pa.array(attr, pa.int32())], [key, "ordinal", "section", "attr"])

        for b in batches:
            found = []
            for i, text in enumerate(b[1]):
                for n, (section, attr) in enumerate(spans.spans(text.as_py() or "")):
                    found.append((i, n, section, attr))
                    if len(found) == _ROWS:
                        yield rows(b, found)
                        found = []
            yield rows(b, found)

    return df.select(key, F.col(column).cast("string").alias(column)).mapInArrow(run, f"{key} {_kind(df, key)}, ordinal int, section string, attr int")


def arbitrate(results: DataFrame, lower: float, higher: float) -> DataFrame:
    """The answer of each query among systems in order (query_id, ord, system, ok, score, level, replace_level). Failed
    ones and scores under `lower` are out. The first left wins if it scores `higher`; else the first later one that
    does, and whose level is within the first's replace_level of its level; else the first."""
    left = results.where(F.col("ok") & (F.col("score") >= lower))
    q = Window.partitionBy("query_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = left.withColumn("_r0", F.first(F.struct("ord", "score", "level", "replace_level")).over(q))
    wins = (F.col("ord") == F.col("_r0.ord")) & (F.col("_r0.score") >= higher)
    later = (F.col("_r0.score") < higher) & (F.col("ord") > F.col("_r0.ord")) & (F.col("score") >= higher) & (F.abs(F.col("level") - F.col("_r0.level")) <= F.col("_r0.replace_level"))
    rank = F.when(wins, 0).when(later, 1).when(F.col("ord") == F.col("_r0.ord"), 2)
    best = rows.withColumn("_rank", rank).where("_rank IS NOT NULL").groupBy("query_id").agg(F.min_by(F.struct("system", "score"), F.struct("_rank", "ord")).alias("_b"))
    return best.select("query_id", "_b.system", "_b.score")
