"""Groups, near duplicates and nearest vectors against brute force."""

import random

import numpy as np
import pytest

from threadloom.llm import groups, knn, neardup


def union_find(ids, links):
    root = {i: i for i in ids}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        if a != b:
            root[max(a, b)] = min(a, b)
    return {i: find(i) for i in root}


@pytest.mark.parametrize("levels", [1, 12])
def test_groups(spark, levels):
    rng = random.Random(5)
    ids = [f"u{i:03d}" for i in range(300)]
    links = [(rng.choice(ids[:120]), rng.choice(ids[:120])) for _ in range(150)] + [(rng.choice(ids[120:]), rng.choice(ids[120:])) for _ in range(60)]
    links += [(ids[200 + i], ids[201 + i]) for i in range(60)] + [("u001", "u001"), links[0], links[0][::-1]]  # a long chain
    want = union_find(ids, links)
    e = spark.createDataFrame([*links, (None, "u001"), ("u299", None)], "source string, target string")
    n = spark.createDataFrame([(i, "x") for i in [*ids, None, "u001"]], "id string, label string")
    assert {r.node_id: r.group_id for r in groups.consolidate(n, e, levels).collect()} == want


def test_groups_edges(spark):
    e = spark.createDataFrame([], "source string, target string")
    n = spark.createDataFrame([("a",), ("b",), ("a",)], "id string")
    assert sorted(map(tuple, groups.consolidate(n, e).collect())) == [("a", "a"), ("b", "b")]
    assert groups.consolidate(n.limit(0), e).count() == 0
    m = spark.createDataFrame([(1, "c"), (1, "a"), (1, "a"), (2, None), (None, "z")], "g int, n string")
    assert sorted(map(tuple, groups.star_links(m, "g", "n").collect())) == [("a", "a"), ("a", "a"), ("a", "c")]


def neighbours(sets, t):
    links, items = [], sorted(sets.items())
    for i, (a, x) in enumerate(items):
        for b, y in items[i + 1 :]:
            if len(x & y) >= t * len(x | y) - 1e-9:
                links.append((a, b))
    return links


def corpus(rng, n, words, size):
    texts = {}
    for i in range(n):
        if texts and rng.random() < 0.5:
            w = texts[rng.choice(list(texts))].split()
            for _ in range(rng.randint(0, 5)):
                w[rng.randrange(len(w))] = f"w{rng.randrange(words)}"
        else:
            w = [f"w{int(rng.random() ** 3 * words)}" for _ in range(rng.randint(*size))]
        rng.shuffle(w)
        texts[f"r{i:04d}"] = " ".join(w)
    return texts


@pytest.mark.parametrize("frequent,block,long_", [(4096, 4096, 512), (3, 6, 512), (2, 4096, 20), (4096, 8, 16)])
def test_near_duplicates(spark, monkeypatch, frequent, block, long_):
    monkeypatch.setattr(neardup, "FREQUENT", frequent)
    monkeypatch.setattr(neardup, "BLOCK", block)
    monkeypatch.setattr(neardup, "LONG", long_)
    texts = corpus(random.Random(frequent + block + long_), 250, 300, (10, 30))
    sets = {k: set(v.split()) for k, v in texts.items()}
    sets = {k: v for k, v in sets.items() if len(v) >= 8}
    want = union_find(sets, neighbours(sets, 0.6))
    sizes = {g: list(want.values()).count(g) for g in want.values()}
    rows = [("c", k, v) for k, v in texts.items()] + [("other", "r0000", texts["r0000"]), ("c", None, texts["r0001"]), ("c", "n1", None), ("c", "n2", "")]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "collection string, record_id string, text string, n int, hs int")
    got = {r.record_id: r.group_id for r in neardup.near_duplicate_groups(df, 0.6, 8, neardup.distinct_words).collect()}
    assert got == {k: g for k, g in want.items() if sizes[g] > 1}


def test_near_duplicates_edges(spark):
    df = spark.createDataFrame([("c", "a", "satu dua"), ("c", "b", "dua satu"), ("c", "d", "satu dua"), ("c", "e", "lain")], "collection string, record_id string, text string")
    assert sorted((r.record_id, r.group_id) for r in neardup.near_duplicate_groups(df, 0.8, 1, neardup.distinct_words).collect()) == [("a", "a"), ("b", "a"), ("d", "a")]
    assert sorted(r.record_id for r in neardup.near_duplicate_groups(df).collect()) == ["a", "d"]
    assert neardup.near_duplicate_groups(df.limit(0)).count() == 0


def test_gray_order_is_gray():
    codes = np.array([[i ^ (i >> 1)] for i in range(64)], np.uint64)
    rng = np.random.default_rng(0)
    mixed = rng.permutation(64)
    assert (mixed[neardup.gray_order(codes[mixed])] == np.arange(64)).all()
    wide = np.stack([np.zeros(4, np.uint64), np.array([0, 1, 2**63, 1], np.uint64)], axis=1)[:, ::-1]
    assert sorted(neardup.gray_order(wide).tolist()) == [0, 1, 2, 3]


def index_pairs(prints, sizes, similarity, **more):
    order = neardup.gray_order(prints)
    index = neardup.GrayIndex(prints[order], sizes[order], **{k: v[order] for k, v in more.items()})
    return {tuple(sorted((order[a], order[b]))) for i, j in index.search(similarity) for a, b in zip(i.tolist(), j.tolist())}, index


@pytest.mark.parametrize("noise,at_once", [(1, 500_000), (40, 500_000), (40, 1000), (1, 1000)])
def test_index_loses_nothing(monkeypatch, noise, at_once):
    monkeypatch.setattr(neardup, "AT_ONCE", at_once)
    monkeypatch.setattr(neardup, "SEARCHING", 150)
    rng = np.random.default_rng(noise)
    sets = [set(rng.integers(0, 2**62, 20).tolist()) for _ in range(20)]
    rows = []
    for _ in range(400):
        x = sorted(sets[rng.integers(20)])
        for _ in range(rng.integers(0, noise // 2 + 1)):
            x[rng.integers(len(x))] = int(rng.integers(0, 2**62))
        rows.append(np.unique(x[: rng.integers(8, 21)]))
    ends = np.concatenate(([0], np.cumsum([len(r) for r in rows])))
    got, _ = index_pairs(neardup.fingerprints(np.concatenate(rows), ends), np.diff(ends), 0.6)
    want = {(a, b) for a in range(400) for b in range(a + 1, 400) if len(np.intersect1d(rows[a], rows[b])) >= 0.6 * len(np.union1d(rows[a], rows[b])) - 1e-9}
    assert got >= want and all(a != b for a, b in got)


@pytest.mark.parametrize("rows", [50, 300, 2000])
def test_upper_levels_leave_groups_out(rows):
    rng = np.random.default_rng(rows)
    ends = np.arange(rows + 1) * 24
    hashes = rng.integers(0, 2**62, rows * 24)
    got, index = index_pairs(neardup.fingerprints(hashes, ends, neardup.width64(rows, 24)), np.full(rows, 24), 0.6)
    assert not got
    # by level from the rows up: nearly all leaves but a row's own are left out, and fewer nodes met than there are pairs
    assert index.kept[1] <= 1.1 * rows and index.met.sum() < rows * (rows - 1) / 3


def test_a_family_of_thousands_in_one_block():
    rng = np.random.default_rng(0)
    common = rng.integers(0, 2**31, 16)
    rows = [np.unique(np.append(common, rng.integers(0, 2**31, 1))) for _ in range(2500)]
    ends = np.concatenate(([0], np.cumsum([len(r) for r in rows])))
    links = neardup.matched(np.concatenate(rows), ends, np.diff(ends), 0.6)
    assert len(links) == 2499


@pytest.mark.parametrize("frequent,block", [(1, 4096), (4, 4096), (4, 16), (4096, 4096)])
@pytest.mark.parametrize("similarity", [0.3, 0.6])
def test_short_sets_under_frequent_words(spark, monkeypatch, frequent, block, similarity):
    monkeypatch.setattr(neardup, "FREQUENT", frequent)
    monkeypatch.setattr(neardup, "BLOCK", block)
    rng = random.Random(frequent)
    texts = {f"r{i:03d}": " ".join(rng.sample([f"w{k}" for k in range(40)], rng.randint(1, 8))) for i in range(300)}
    texts |= {"a0": "alpha beta", "a1": "alpha beta gamma"} | {f"b{i}": f"alpha x{i}" for i in range(40)} | {f"c{i}": f"beta y{i}" for i in range(40)}
    sets = {k: set(v.split()) for k, v in texts.items()}
    want = union_find(sets, neighbours(sets, similarity))
    groups_ = list(want.values())
    df = spark.createDataFrame([("c", k, v) for k, v in texts.items()], "collection string, record_id string, text string")
    got = {r.record_id: r.group_id for r in neardup.near_duplicate_groups(df, similarity, 1, neardup.distinct_words).collect()}
    assert got == {k: g for k, g in want.items() if groups_.count(g) > 1}


def clusters(rng, n, dim, centers, noise):
    c = rng.standard_normal((centers, dim))
    x = c[rng.integers(centers, size=n)] + noise * rng.standard_normal((n, dim))
    return x * rng.uniform(0.5, 3, (n, 1))


def exact_neighbours(x, k):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -2)
    return {(f"v{i:05d}", f"v{j:05d}") for i, row in enumerate(np.argsort(-s, axis=1)[:, :k]) for j in row}


def recall(spark, x, k=5, **more):
    df = spark.createDataFrame([(f"v{i:05d}", [float(z) for z in v]) for i, v in enumerate(x)], "user_id string, embeddings array<double>")
    got = {(r.id, r.neighbour) for r in knn.nearest(knn.usable(df, "user_id", "embeddings", x.shape[1]), x.shape[1], k, **more).collect()}
    assert len(got) == k * len(x)
    return len(got & exact_neighbours(x, k)) / len(got)


@pytest.mark.parametrize("stored,searching", [(4096, 16384), (64, 100)])
def test_nearest_recall(spark, monkeypatch, stored, searching):
    monkeypatch.setattr(knn, "STORED", stored)
    monkeypatch.setattr(knn, "SEARCHING", searching)
    monkeypatch.setattr(knn, "CELL_ROWS", 100)
    assert recall(spark, clusters(np.random.default_rng(2), 1200, 64, 12, 0.35)) > 0.97


@pytest.mark.parametrize("cell_rows", [100, 8])
def test_nearest_recall_without_structure(spark, monkeypatch, cell_rows):
    monkeypatch.setattr(knn, "CELL_ROWS", cell_rows)
    assert recall(spark, np.random.default_rng(4).standard_normal((2000, 24))) > 0.97


def test_copies_of_a_vector(spark, monkeypatch):
    monkeypatch.setattr(knn, "CELL_ROWS", 50)
    x = np.random.default_rng(5).standard_normal((40, 8)).astype(np.float32)
    rows = [(f"a{i:03d}", x[0]) for i in range(60)] + [(f"b{i:03d}", x[i % 20 + 1]) for i in range(40)] + [(f"c{i:03d}", x[i + 21]) for i in range(19)]
    m = np.stack([v for _, v in rows]).astype(float)
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    want = {}
    for i, (a, v) in enumerate(rows):
        near = sorted((-round(float(m[i] @ m[j]), 9), b) for j, (b, _) in enumerate(rows) if j != i)[:5]
        want |= {(a, b): -s for s, b in near}
    df = spark.createDataFrame([(k, [float(z) for z in v]) for k, v in rows], "user_id string, embeddings array<float>")
    got = {(r.id, r.neighbour): round(r.similarity, 9) for r in knn.nearest(knn.usable(df, "user_id", "embeddings", 8), 8, 5, margin=2.0).collect()}
    assert got.keys() == want.keys() and all(abs(got[x] - want[x]) < 1e-6 for x in want)


def test_estimates_hold_their_bounds():
    rng = np.random.default_rng(3)
    x = clusters(rng, 500, 64, 1, 0.4)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    center, turn = np.repeat(x.mean(axis=0)[None], 500, axis=0), knn.rotation(64)
    words, fine, held = knn.coded(x, center, turn)
    upper, bound = knn.estimates(*knn.planes_of(*knn.asked(x[:100], center[:100], turn)), words, held, 64)
    off = np.abs(upper - bound - x[:100] @ x.T)
    assert (off <= bound).mean() > 0.95 and off.mean() < 0.05


def test_usable_vectors(spark):
    good = [1.0] + [0.0] * 63
    rows = [("a", good), ("a", good), ("b", None), ("c", []), ("d", [1.0] * 63), ("e", [0.0] * 64), ("f", [float("nan")] * 64), ("g", [float("inf")] + good[1:]), ("h", [None, *good[:63]]), (None, good), ("i", [2 * z for z in good])]
    df = spark.createDataFrame(rows, "user_id string, embeddings array<double>")
    v = knn.usable(df, "user_id", "embeddings", 64)
    assert sorted(r.id for r in v.collect()) == ["a", "i"]
    assert sorted((r.id, r.neighbour) for r in knn.nearest(v, 64).collect()) == [("a", "i"), ("i", "a")]
    assert knn.nearest(v.where("id = 'a'"), 64).count() == 0
    assert knn.nearest(v.limit(0), 64).count() == 0
