"""The capacity search of minimax sharding: it ends, and finds the smallest capacity, whatever the groups."""

import numpy as np
import pytest

from sluice.llm import shards


def counted(sizes, jobs):
    ends = np.cumsum(sizes)

    def look(spans, parts):
        jobs.append(len(spans))
        out = []
        for a, b in spans:
            step = -(-(b - a) // parts)
            own = ends[(ends > a) & (ends <= b)]
            for k in np.unique((own - a - 1) // step):
                part = own[(own - a - 1) // step == k]
                out.append((int(part.min()), int(part.max()), len(part)))
        return out

    return look


def brute(sizes, n):
    def fits(c):
        shards_, now = 1, 0
        for v in sizes:
            shards_, now = (shards_, now + v) if now + v <= c else (shards_ + 1, v)
        return shards_ <= n

    low, high = max(sizes), sum(sizes)
    while low < high:
        mid = (low + high) // 2
        low, high = (low, mid) if fits(mid) else (mid + 1, high)
    return low


def search(sizes, n):
    jobs = []
    cuts = shards.minimax_cuts(shards.Ends(counted(sizes, jobs), sum(sizes)), max(sizes), n)
    ends = set(np.cumsum(sizes).tolist())
    assert len(cuts) == n and cuts[-1] == sum(sizes) and set(cuts) <= ends | {0}
    assert max(np.diff([0, *cuts])) == brute(sizes, n)
    assert len(jobs) < 400
    return cuts


HUGE = 5_000_000
NAMED = {
    "a large group before a small one": ([2, 6, 8, 1202, 561, 453820, 453825, 12], 3),
    "one giant group first": ([HUGE, *range(1, 300)], 16),
    "one giant group in the middle": ([*range(1, 150), HUGE, *range(1, 150)], 16),
    "one giant group last": ([*range(1, 300), HUGE], 16),
    "three giant groups": ([HUGE, *[7] * 100, HUGE, *[9] * 100, HUGE, *[3] * 100], 16),
    "more shards than groups": ([5, 1, 9], 16),
    "one group": ([1], 16),
    "equal groups": ([1] * 1000, 7),
    "a hundred terabytes": ([10**12 + i * 10**10 for i in range(90)] + [1] * 500, 16),
}


@pytest.mark.parametrize("name", NAMED)
def test_named_cases(name):
    search(*NAMED[name])


def test_random_heavy_tails():
    rng = np.random.default_rng(11)
    for i in range(200):
        sizes = np.maximum(1, rng.pareto(0.6, int(rng.integers(1, 400))) * 20).clip(1, 1e9).astype(int).tolist()
        search(sizes, int(rng.integers(1, 20)))


def test_no_progress_is_an_error():
    with pytest.raises(RuntimeError, match="hide"):
        ends = shards.Ends(lambda spans, parts: [(5, 100, 7)], 100)
        ends.open({5})


def test_a_long_text_before_short_ones(spark):
    rows = [(0, "x" * HUGE), *((i, f"{i} word") for i in range(1, 1001))]
    out = shards.shard_by_bytes(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    sizes = [len(t) + 1 for _, t in rows]
    held = {}
    for r in out:
        held.setdefault(r.shard, []).append(r)
    assert len(out) == 1001 and max(sum(r.size for r in v) for v in held.values()) == brute(sizes, 16)
    assert all(sorted(r.slot for r in v) == list(range(len(v))) for v in held.values())
