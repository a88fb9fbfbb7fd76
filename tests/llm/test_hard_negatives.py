"""Hard negatives against brute force."""

import itertools
import math
import random

import numpy as np
import pytest

from fieldrecon.llm import hard_negatives as hn

ROWS = "vec_id long, embedding array<double>, label int, no string, v string, score long, block string, part int"


def brute(rows, anchor):
    seen, kept = set(), []
    for i, x, label, *_ in rows:
        if label is None or x is None or any(c is None or not math.isfinite(c) or abs(c) > 1e6 for c in x):
            continue
        v = tuple(math.floor(256 * c) for c in x)
        if (i, label, v) not in seen:
            seen.add((i, label, v))
            kept.append((i, label, v))
    dot = lambda a, b: sum(p * q for p, q in itertools.zip_longest(a, b, fillvalue=0))
    order = lambda r: (-r[0], r[1] is None, r[1] or 0)
    out = []
    for k, (i, label, v) in enumerate(kept):
        if not anchor(i):
            continue
        scored = [(dot(v, w), j, m) for n, (j, m, w) in enumerate(kept) if n != k]
        for s, j, _ in sorted((r for r in scored if r[2] == label), key=order)[:5]:
            window = [r for r in scored if r[2] != label and 80 * s <= 100 * r[0] <= 100 * s]
            out += [(i, j, n + 1, r[1], s, r[0]) for n, r in enumerate(sorted(window, key=order)[:5])]
    return out


def vectors(seed, n, dim=6, spread=0.1):
    rng = random.Random(seed)
    middles = [[rng.gauss(0, 0.4) for _ in range(dim)] for _ in range(4)]
    rows = [(i, [c + rng.gauss(0, spread) for c in middles[i * 7 % 4]], rng.randrange(3), "no", "v", 1, "b", 2) for i in range(n)]
    rest = rows[0][3:]
    odd = [(n, None, 1), (n + 1, [1.0] * dim, None), (n + 2, [math.nan] * dim, 1), (n + 3, [math.inf] * dim, 1), (n + 4, [None] * dim, 1), (n + 5, [], 1)]
    odd += [(n + 6, [1e30] * dim, 1), (n + 7, [0.5], 2), (None, [0.3] * dim, 1), (None, [0.3] * dim, 2), (20, [0.25] * dim, 1), (n + 8, [0.0] * dim, 0)]
    return rows + [(*r, *rest) for r in odd] + rows[:30] + [(i + 1000, *rows[40][1:]) for i in range(50)]


@pytest.mark.parametrize("sizes", [(1 << 17, 1 << 21), (30, 500)])
def test_mine_equals_brute_force(spark, sizes):
    rows = vectors(1, 300)
    frame = spark.createDataFrame(rows, ROWS).repartition(3)
    got = hn.mine(frame, lambda i: i % 10 == 0, anchors=sizes[0], candidates=sizes[1])
    expected = brute(rows, lambda i: i is not None and i % 10 == 0)
    assert len(expected) > 300
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, expected))


def test_no_rows(spark):
    frame = spark.createDataFrame(vectors(1, 60), ROWS)
    assert hn.mine(frame.limit(0), lambda i: i % 10 == 0).count() == 0
    assert hn.mine(frame, lambda i: i < 0).count() == 0


def tables(x, labels):
    n = len(x)
    t = hn.pa.table({"no": np.arange(n), "id": np.arange(n), "label": labels, "v": hn.pa.array(list(x))})
    return hn._trees(t), t


@pytest.mark.parametrize("scale", [100, 1 << 28])
def test_bounds_hold_and_spare_work(scale):
    """Bounds along the tree hold for every candidate; with close anchors most candidates are never scored again."""
    rng = np.random.default_rng(3)
    middles = rng.normal(0, scale, (5, 8))
    x = (middles[np.arange(400) % 5] + rng.normal(0, scale / 100, (400, 8))).astype(np.int64)
    trees, candidates = tables(x, np.arange(400) % 5)
    block, scored = hn.Block(trees, candidates), 0
    numbers = block.anchors["no"].to_numpy()
    for k, low, high, exact in block.walk():
        true = [int(sum(int(p) * int(q) for p, q in zip(x[numbers[k]], w, strict=True))) for w in x]
        assert all(a <= t <= b for a, t, b in zip(low.tolist(), true, high.tolist(), strict=True))
        near = np.flatnonzero(high >= np.partition(low, -5)[-5])
        scored += len(near)
        assert exact(near).tolist() == [true[i] for i in near.tolist()]
    assert scored < 0.5 * 400 * 400


def test_tree_is_minimal_and_order_holds_few():
    rng = np.random.default_rng(4)
    v = rng.integers(-50, 50, (60, 3))
    parent, distance = hn.spanning_tree(v)
    d = np.sqrt(((v[:, None].astype(float) - v[None]) ** 2).sum(axis=2))
    group, total = list(range(60)), 0.0  # Kruskal
    for i, j in sorted(itertools.combinations(range(60), 2), key=lambda e: d[e]):
        if group[i] != group[j]:
            total += d[i, j]
            group = [group[i] if g == group[j] else g for g in group]
    assert math.isclose(distance.sum(), total) and all(d[i, parent[i]] == distance[i] for i in range(1, 60))
    order = hn.depth_first(parent)
    place = {i: k for k, i in enumerate(order)}
    assert sorted(order) == list(range(60)) and all(place[parent[i]] < place[i] for i in range(1, 60))
    last = {}
    for i in order[1:]:
        last[parent[i]] = place[i]
    assert max(sum(place[p] < k < e for p, e in last.items()) for k in range(60)) <= 6
