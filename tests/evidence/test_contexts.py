"""View contexts and evidence packing against plain computations."""

import random
import tracemalloc

import numpy as np

from weft.operators import pack, program


def rows(seed, n, name):
    r = random.Random(seed)
    return [(i if name == "one" else i % (n - 3), r.choice(["f", "g", None]), r.choice(["c", "d", "e"]), r.choice(["x", "y"])) for i in range(n)]


def plain(states, views):
    best = {}
    for s, *own in states:
        for v, *other in views:
            level = next((i for i, (a, b) in enumerate(zip(own, other, strict=True), 1) if a is not None and a == b), None)
            if level:
                best[s, v] = min(level, best.get((s, v), 9))
    return best


def test_view_contexts(spark):
    for kind in ("one", "several"):
        states, views = rows(1, 30, kind), rows(2, 20, kind)
        found = program.view_contexts(spark.createDataFrame(states, "state long, function string, class string, file string"), spark.createDataFrame(views, "view long, function string, class string, file string"), 3)
        got = [((r["state"], r["view"]), r["level"]) for r in found.collect()]
        assert dict(got) == plain(states, views) and len(got) == len(dict(got))
        if kind == "one":
            assert "HashAggregate" not in found._jdf.queryExecution().executedPlan().toString()  # pairs aren't brought together


def joined(groups, has, weight, chars, most):
    """Groups merged two by two, all pairs looked at anew each time."""
    groups = [list(g) for g in groups]
    while True:
        best = None
        sent = [has[g].any(0) for g in groups]
        size = [chars[g].sum() + weight[s].sum() for g, s in zip(groups, sent, strict=True)]
        for i in range(len(groups)):
            for j in range(i + 1, len(groups)):
                overlap = weight[sent[i] & sent[j]].sum()
                both = size[i] + size[j] - overlap
                key = (-overlap, most - both, min(len(groups[i]), len(groups[j])), i, j)
                if both <= most and (best is None or key < best):
                    best = key
        if best is None:
            return groups
        groups[best[3]] += groups.pop(best[4])


def test_merged_groups():
    for seed in range(8):
        r = np.random.default_rng(seed)
        has, weight, chars = r.random((24, 12)) < 0.2, r.integers(1, 120, 12), r.integers(1, 300, 24)
        groups = [[int(i)] for i in r.permutation(24)]
        found = pack.merged_groups(groups, has, weight, chars, 1000)
        assert [list(map(int, g)) for g in found] == joined(groups, has, weight, chars, 1000)
    assert pack.merged_groups([], np.zeros((0, 3), bool), np.ones(3, np.int64), np.zeros(0, np.int64), 10) == []


def test_groups_from_lists_of_domains():
    """Lists of domains in place of flags give the plain result, also where groups that have nothing in common are joined; a page's memory follows its rows."""
    for seed in (76, 173, 178, 252):
        r = np.random.default_rng(seed)
        n, d = int(r.integers(1, 60)), int(r.integers(1, 25))
        has = r.random((n, d)) < r.choice([0.03, 0.1, 0.3])
        weight = r.choice([r.integers(0, 120, d), np.full(d, 60)])
        chars, most = r.integers(1, 300, n) if seed % 2 else r.integers(1, 5, n) * 60, int(r.choice([500, 1000, 300]))
        groups = [[int(i)] for i in r.permutation(n)]
        assert pack.merged_groups(groups, [np.nonzero(x)[0] for x in has], weight, chars, most) == joined(groups, has, weight, chars, most)
    r = np.random.default_rng(1)
    has, weight, chars = [np.unique(r.integers(0, 1 << 20, 4)) for _ in range(600)], np.full(1 << 20, 60), np.full(600, 300)
    tracemalloc.start()
    found = pack.merged_groups(pack.shared_groups(has, weight, chars, np.ones(600, bool), 4000, 5000), has, weight, chars, 5000)
    assert tracemalloc.get_traced_memory()[1] < 400 << 20  # flags alone would take 600 MB
    tracemalloc.stop()
    assert sorted(i for g in found for i in g) == list(range(600))
