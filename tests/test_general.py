"""Sessions, hierarchies, components, ranks: against brute force, and their edge cases."""

import random

import numpy as np
import pytest

from threadloom.operators import components, hierarchy, ranking, sessions
from threadloom.runtime import Stage


def brute_sessions(rows, gap):
    out, by = set(), {}
    for e, t in rows:
        if e is not None and t is not None:
            by.setdefault(e, []).append(t)
    for e, ts in by.items():
        ts.sort()
        start, n, last = ts[0], 0, ts[0]
        for t in ts:
            if t - last > gap:
                out.add((e, start, last, last - start, n))
                start, n = t, 0
            n, last = n + 1, t
        out.add((e, start, last, last - start, n))
    return out


@pytest.mark.parametrize("gap", [1, 7, 1800, 90_000])
def test_sessions(spark, gap):
    rng = random.Random(gap)
    rows = [(f"u{int(rng.random() ** 2 * 30)}", rng.choice([-5, 0, 86_399, 86_400, 1_000_000]) + int(rng.random() ** 3 * gap * 40)) for _ in range(3000)]
    rows += [("hot", i * gap) for i in range(500)] + [("hot2", i * (gap + 1)) for i in range(500)] + [(None, 1), ("x", None), ("one", 5), ("one", 5)]
    df = spark.createDataFrame([(*r, 0, "c") for r in rows], "user string, ts bigint, _n int, _entity string")
    got = {tuple(r) for r in sessions.sessionize(df, "user", "ts", gap).collect()}
    assert got == brute_sessions(rows, gap)


def test_sessions_edges(spark):
    df = spark.createDataFrame([], "user string, ts bigint")
    assert sessions.sessionize(df, "user", "ts", 5).count() == 0
    with pytest.raises(ValueError):
        sessions.sessionize(df, "user", "ts", 0)


def test_close_runs_in_parts(spark, monkeypatch):
    monkeypatch.setattr(sessions, "BITMAP_BITS", 1)  # as many bitmaps as there are places to cut
    rng = random.Random(1)
    rows = [(f"u{rng.randrange(9)}", rng.randrange(400_000)) for _ in range(800)]
    df = spark.createDataFrame(rows, "user string, ts bigint")
    assert {tuple(r) for r in sessions.sessionize(df, "user", "ts", 1800).collect()} == brute_sessions(rows, 1800)


def brute_tree(up):
    out = {}
    for x in up:
        seen, cur = [], x
        while True:
            if cur in seen:
                out[x] = (min(seen[seen.index(cur) :]), -1)
                break
            seen.append(cur)
            if up.get(cur) is None:
                out[x] = (cur, len(seen) - 1)
                break
            cur = up[cur]
    return out


def forest(rng, n):
    up = {}
    for i in range(n):
        r = rng.random()
        up[f"n{i:04d}"] = None if r < 0.1 else f"gone{rng.randrange(5)}" if r < 0.15 else f"n{rng.randrange(max(1, i)):04d}" if r < 0.9 else f"n{rng.randrange(n):04d}"
    for i in range(120):  # a deep chain
        up[f"d{i:03d}"] = f"d{i + 1:03d}" if i < 119 else None
    for i in range(37):  # a long tail into a cycle of seven
        up[f"t{i:02d}"] = f"t{i + 1:02d}" if i < 36 else "t30"
    up["self"] = "self"
    return up


def test_hierarchy(spark):
    up = forest(random.Random(7), 400)
    rows = [(k, v, "x", 1) for k, v in up.items()] + [("n0003", up["n0003"], "y", 2), (None, "n0001", "z", 3), ("", "n0001", "z", 3), ("n0000", "", "z", 4)]
    df = spark.createDataFrame(rows, "comment_id string, parent_id string, root string, depth int")
    want = brute_tree(up)
    got = {r.id: (r.root, r.depth) for r in hierarchy.resolve(df, "comment_id", "parent_id").collect()}
    assert got == want
    full = {r.id: r for r in hierarchy.hierarchy(df, "comment_id", "parent_id").collect()}
    kids = {x: 0 for x in up}
    for x in up:
        if want[x][1] < 0:
            assert full[x].path is None and full[x].n_descendants is None
            continue
        path, cur = [x], x
        while up.get(cur) is not None:
            cur = up[cur]
            path.append(cur)
            kids[cur] = kids.get(cur, 0) + 1
        assert full[x].path == ">".join(reversed(path))
    assert all(full[x].n_descendants == kids[x] for x in up if want[x][1] >= 0)


def test_hierarchy_empty(spark):
    df = spark.createDataFrame([], "comment_id string, parent_id string")
    assert hierarchy.hierarchy(df, "comment_id", "parent_id").count() == 0


@pytest.mark.parametrize("at_once", [200_000, 0, 30])
def test_components(spark, monkeypatch, at_once):
    monkeypatch.setattr(components, "AT_ONCE", at_once)
    rng = random.Random(9)
    ids = [f"{i:03d}" for i in range(200)]
    links = [(rng.choice(ids), rng.choice(ids)) for _ in range(120)] + [(ids[i], ids[i + 1]) for i in range(150, 199)]
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    n = spark.createDataFrame([(i,) for i in ids], "id string")
    e = spark.createDataFrame([*links, (None, "001")], "source string, target string")
    got = {r.id: r.label for r in components.connected_components(n, e).collect()}
    assert got == {i: find(i) for i in ids}
    rows = components.numbered(components.connected_components(n, e)).collect()
    sizes = {r.component_id: r.component_size for r in rows}
    assert [sizes[i] for i in range(len(sizes))] == sorted(sizes.values(), reverse=True)


def test_ranks_and_quantiles(spark):
    rng = np.random.default_rng(0)
    x = np.round(rng.normal(size=997), 1)
    df = spark.createDataFrame([(float(v), i) for i, v in enumerate(x)] + [(None, -1)], "v double, i bigint")
    qs = [0, 0.1, 0.5, 0.8, 0.9, 1]
    assert np.allclose(ranking.quantiles(df, "v", qs, Stage(spark, "t")), np.quantile(x, qs))
    assert ranking.quantiles(df.where("i < 0"), "v", qs, Stage(spark, "t")) == [None] * 6
    got = ranking.global_rank(df.where("i >= 0"), ["v", "i"], Stage(spark, "t")).orderBy("rank").collect()
    assert [r["rank"] for r in got] == list(range(997)) and [r.i for r in got] == np.lexsort((np.arange(997), x)).tolist()
