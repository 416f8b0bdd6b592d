"""Partition rules: functions that make, of a key column, the column of its shard. Null means that no shard is named.

Dates are read without a zone; a rule that needs instants takes the zone's offset from UTC.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

Rule = Callable[[Column], Column]
Ranges = list[tuple[int, int, int]]
_MASK = (1 << 32) - 1
_RULES: dict[str, Callable[..., Rule]] = {}


def register_shard_rule(name: str, make: Callable[..., Rule]) -> None:
    """make(*settings) gives the rule."""
    _RULES[name] = make


def shard_rule(name: str, *settings, **named) -> Rule:
    return _RULES[name](*settings, **named)


def _rule(f):
    register_shard_rule(f.__name__, f)
    return f


def _whole(c: Column) -> Column:
    return F.abs(c.cast("decimal(38,0)"))


def _first(value: Column, ranges: Ranges, default: int | None) -> Column:
    out = F.lit(default).cast("int")
    for start, end, node in reversed(ranges):
        out = F.when(value.between(F.lit(start), F.lit(end)), F.lit(node)).otherwise(out)
    return out


def parse_number(text: str) -> int:
    """A number with K (thousands) or M (ten thousands) and what follows added: 200M1 is 2000001."""
    head, unit, tail = text.upper().partition("M" if "M" in text.upper() else "K")
    return int(head) * {"M": 10_000, "K": 1_000, "": 1}[unit] + int(tail or 0)


def parse_ranges(text: str) -> Ranges:
    """Lines start-end=node."""
    out = []
    for line in filter(None, map(str.strip, text.splitlines())):
        span, node = line.split("=")
        start, end = span.split("-")
        out.append((parse_number(start), parse_number(end), int(node)))
    return out


@_rule
def mod(n: int) -> Rule:
    return lambda c: (_whole(c) % n).cast("int")


@_rule
def ranges(rules: Ranges, default: int | None = None) -> Rule:
    return lambda c: _first(c, rules, default)


@_rule
def enum_map(nodes: dict, default: int | None = None) -> Rule:
    def rule(c):
        out = F.lit(default).cast("int")
        for value, node in nodes.items():
            out = F.when(c == F.lit(value), F.lit(node)).otherwise(out)
        return out

    return rule


@_rule
def range_mod(groups: Ranges, default: int | None = None) -> Rule:
    """Groups (start, end, size): inside a group, the key modulo its size; groups number their nodes one after another."""

    def rule(c):
        out, before = F.lit(default).cast("int"), sum(size for _, _, size in groups)
        for start, end, size in reversed(groups):
            before -= size
            out = F.when(c.between(F.lit(start), F.lit(end)), (_whole(c) % size).cast("int") + before).otherwise(out)
        return out

    return rule


def _segment_ends(counts: list[int], lengths: list[int]) -> list[int]:
    sizes = [length for count, length in zip(counts, lengths, strict=True) for _ in range(count)]
    if sum(sizes) != 1024:
        raise ValueError("counts times lengths must add up to 1024")
    return [sum(sizes[: i + 1]) for i in range(len(sizes))]


def _segment(low_bits: Column, ends: list[int]) -> Column:
    out = F.lit(len(ends) - 1)
    for i in range(len(ends) - 2, -1, -1):
        out = F.when(low_bits < ends[i], F.lit(i)).otherwise(out)
    return out


@_rule
def segments(counts: list[int], lengths: list[int]) -> Rule:
    ends = _segment_ends(counts, lengths)
    return lambda c: F.when(c.isNotNull(), _segment(c.cast("bigint").bitwiseAND(F.lit(1023)), ends))


def _units(c: Column) -> Column:
    """UTF-16 code units of a string."""
    h = F.hex(F.encode(c, "UTF-16BE"))
    n = F.length(h) / 4
    return F.when(F.length(c) == 0, F.array().cast("array<bigint>")).otherwise(
        F.transform(F.sequence(F.lit(0), (n - 1).cast("int")), lambda i: F.conv(F.substring(h, i * 4 + 1, F.lit(4)), 16, 10).cast("bigint"))
    )


def _fold(units: Column, modulo: int) -> Column:
    return F.aggregate(units, F.lit(0).cast("bigint"), lambda h, u: (h * 31 + u) % F.lit(modulo))


def java_hash(c: Column) -> Column:
    """The signed 32-bit string hash h * 31 + unit."""
    h = _fold(_units(c), 1 << 32)
    return F.when(h >= 1 << 31, h - (1 << 32)).otherwise(h)


@_rule
def string_slice(start: int, end: int, counts: list[int], lengths: list[int]) -> Rule:
    """The hash of the code units from start to end; a negative place counts from the end, an end of 0 is the length."""
    ends = _segment_ends(counts, lengths)

    def rule(c):
        units = _units(c)
        n = F.size(units)
        first = F.greatest(F.lit(0), F.lit(start) if start >= 0 else n + start)
        last = F.least(n, n + end if end <= 0 else F.lit(end))
        return F.when(c.isNotNull(), _segment(_fold(F.slice(units, first + 1, F.greatest(F.lit(0), last - first)), 1024), ends))

    return rule


@_rule
def hash_mod(n: int) -> Rule:
    """The string hash, its bits mixed in 32-bit arithmetic, then its absolute value modulo n."""
    wrap = lambda x: x.bitwiseAND(F.lit(_MASK))
    signed = lambda x: x - F.when(x >= 1 << 31, F.lit(1 << 32)).otherwise(F.lit(0))
    down = lambda x, s: wrap(F.shiftright(signed(x), s))

    def rule(c):
        k = wrap(java_hash(c))
        steps = [
            lambda k: wrap(wrap(k * (1 << 21)) - k - 1), lambda k: k.bitwiseXOR(down(k, 24)), lambda k: wrap(k * 265), lambda k: k.bitwiseXOR(down(k, 14)),
            lambda k: wrap(k * 21), lambda k: k.bitwiseXOR(down(k, 28)), lambda k: wrap(k + wrap(k * (1 << 31))),
        ]
        # one array element a step, so that no step's expression is written out more than twice in the next
        k = F.aggregate(F.array(*[F.lit(i) for i in range(len(steps))]), k, lambda acc, i: F.element_at(F.array(*[_when(i, j, s, acc) for j, s in enumerate(steps)]), i + 1))
        return (F.abs(signed(k)) % n).cast("int")

    def _when(i, j, step, acc):
        return F.when(i == j, step(acc))

    return rule


def _jump(key: Column, n: int) -> Column:
    @F.pandas_udf("int")
    def find(keys: pd.Series) -> pd.Series:
        return pd.Series(jump(keys.to_numpy(np.int64), n))

    return find(key)


def jump(keys: np.ndarray, n: int) -> np.ndarray:
    """Jump consistent hash of signed 64-bit keys into n buckets."""
    k, b, j = keys.astype(np.int64).view(np.uint64).copy(), np.full(len(keys), -1, np.int64), np.zeros(len(keys), np.int64)
    while (on := j < n).any():
        b = np.where(on, j, b)
        k = np.where(on, k * np.uint64(2862933555777941757) + np.uint64(1), k)
        j = np.where(on, ((b + 1) * (float(1 << 31) / ((k >> np.uint64(33)).astype(float) + 1.0))).astype(np.int64), j)
    return b.astype(np.int32)


@_rule
def jump_hash(n: int) -> Rule:
    return lambda c: F.when(c.isNotNull(), _jump(F.coalesce(java_hash(c.cast("string")), F.lit(0)), n))


def murmur3_all(texts: list[str], seed: int) -> np.ndarray:
    """Signed 32-bit Murmur3 of each string's UTF-16 code units; strings of one length are worked out together."""
    data = [t.encode("utf-16-le", "surrogatepass") for t in texts]
    sizes, out = np.array([len(d) for d in data], np.int64), np.zeros(len(data), np.int64)
    turn = lambda x, n: (x << np.uint32(n)) | (x >> np.uint32(32 - n))
    for size in np.unique(sizes).tolist():
        at = np.flatnonzero(sizes == size)
        units = np.frombuffer(b"".join(data[i] for i in at), "<u2").reshape(len(at), size // 2).astype(np.uint32)
        h = np.full(len(at), seed & _MASK, np.uint32)
        for i in range(0, size // 2, 2):
            whole = i + 1 < size // 2
            k = units[:, i] | (units[:, i + 1] << np.uint32(16)) if whole else units[:, i]
            h ^= turn(k * np.uint32(0xCC9E2D51), 15) * np.uint32(0x1B873593)
            if whole:
                h = turn(h, 13) * np.uint32(5) + np.uint32(0xE6546B64)
        h ^= np.uint32(size)
        h = (h ^ (h >> np.uint32(16))) * np.uint32(0x85EBCA6B)
        h = (h ^ (h >> np.uint32(13))) * np.uint32(0xC2B2AE35)
        out[at] = (h ^ (h >> np.uint32(16))).view(np.int32)
    return out


def murmur3(text: str, seed: int) -> int:
    return int(murmur3_all([text], seed)[0])


def murmur_points(n: int, seed: int = 0, vnodes: int = 160, weights: dict[int, int] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Places and shards of the ring. A virtual node's name holds the names before it, which is part of the rule."""
    ring = {}
    for shard in range(n):
        name = f"SHARD-{shard}"
        for v in range(vnodes * (weights or {}).get(shard, 1)):
            name += f"-NODE-{v}"
            ring[murmur3(name, seed)] = shard
    places = sorted(ring)
    return np.array(places, np.int64), np.array([ring[p] for p in places], np.int32)


@_rule
def murmur_ring(n: int, seed: int = 0, vnodes: int = 160, weights: dict[int, int] | None = None) -> Rule:
    places, shards = murmur_points(n, seed, vnodes, weights)

    def rule(c):
        @F.pandas_udf("int")
        def find(values: pd.Series) -> pd.Series:
            at = np.searchsorted(places, murmur3_all([v or "" for v in values], seed), "left")
            return pd.Series(shards[at % len(places)])

        return F.when(c.isNotNull(), find(c.cast("string")))

    return rule


@_rule
def pattern(modulo: int, rules: Ranges, default: int) -> Rule:
    return lambda c: F.when(c.rlike(r"^[0-9]+$"), _first(c.try_cast("bigint") % modulo, rules, None)).otherwise(F.when(c.isNotNull(), F.lit(default)))


@_rule
def prefix_pattern(length: int, modulo: int, rules: Ranges) -> Rule:
    return lambda c: _first(F.aggregate(F.slice(_units(c), 1, length), F.lit(0).cast("bigint"), lambda a, u: a + u) % modulo, rules, None)


def _seconds(c: Column) -> Column:
    """Seconds since 1970 of a date or time, as its own clock shows it."""
    return F.timestamp_diff("SECOND", F.lit(dt.datetime(1970, 1, 1)).cast("timestamp_ntz"), c.cast("timestamp_ntz"))


def _epoch(day: str) -> int:
    return int(dt.datetime.fromisoformat(day).replace(tzinfo=dt.UTC).timestamp())


@_rule
def by_day(begin: str, days: int, end: str | None = None) -> Rule:
    """Spans of days since begin, a quotient that is cut off at zero; dates after `end` start again from the first."""
    span, start = days * 86400, _epoch(begin)

    def rule(c):
        t = _seconds(c)
        part = ((t - start) / F.lit(span)).cast("int")
        if end is None:
            return part
        n = (_epoch(end) - start) // span + 1
        return F.when(t > _epoch(end), part % n).otherwise(part)

    return rule


@_rule
def by_month(begin: str, end: str | None = None) -> Rule:
    first = dt.date.fromisoformat(begin)

    def rule(c):
        part = (F.year(c) * 12 + F.month(c)) - (first.year * 12 + first.month)
        if end is None:
            return part
        last = dt.date.fromisoformat(end)
        n = (last.year - first.year) * 12 + last.month - first.month + 1
        return F.pmod(part, F.lit(n))

    return rule


@_rule
def latest_month(split: int) -> Rule:
    """Of a value that ends in day and hour: `split` nodes a day."""
    return lambda c: (F.substring(c, -4, 2).cast("int") - 1) * split + F.floor(F.substring(c, -2, 2).cast("int") / F.lit(24 // split)).cast("int")


@_rule
def range_date_hash(begin: str, days: int, group: int, utc_offset_hours: int = 0) -> Rule:
    """A group of nodes for each span of days; inside, the jump hash of the instant in milliseconds."""
    spans = by_day(begin, days)
    return lambda c: F.when(c.isNotNull(), spans(c) * group + _jump(F.coalesce((_seconds(c) - utc_offset_hours * 3600) * 1000, F.lit(0)), group))


@_rule
def substring_direct(start: int, size: int, n: int, default: int) -> Rule:
    def rule(c):
        part = F.substring(c, start + 1, size).cast("int")
        return F.when(part >= n, F.lit(default)).otherwise(part) if n > 0 else part

    return rule
