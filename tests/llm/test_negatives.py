"""Hard negatives against all pairs."""
import random

import numpy as np
import pytest

from repolumen.llm import negatives


def made(seed, n=400, dim=6):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 40) for _ in range(dim)] for _ in range(4)]
    rows = []
    for i in range(n):
        label = rng.choice([0, 0, 0, 1, 2])
        v = [float(round(c + rng.gauss(0, 8))) for c in centres[label]] if i % 3 else [float(rng.randint(-3, 3)) for _ in range(dim)]
        rows.append((i, label, v))
    rows += [(n + k, 0, rows[5][2]) for k in range(40)]  # a crowd of equal vectors
    rows += [(n + 50, None, rows[1][2]), (n + 51, 1, None), (n + 52, 1, [1.0, float("nan")] + [0.0] * (dim - 2)), (n + 53, 1, [1.0, None] + [0.0] * (dim - 2)),
             (n + 54, 1, [2.0, 1.0]), (n + 55, 2, [3.0, 1.0]), (n + 56, 1, [3.0, 1.0]), (None, 1, rows[3][2]), rows[7], (n + 57, 2, [float("inf")] * dim)]
    return rows


def brute(rows, asks):
    ok = {(i, y, tuple(v)) for i, y, v in rows if None not in (i, y, v) and all(x is not None and np.isfinite(x) for x in v)}
    out = set()
    for i, y, v in ok:
        if not asks(i):
            continue
        scored = sorted((-sum(int(a) * int(b) for a, b in zip(v, w)), j, z) for j, z, w in ok if j != i and len(v) == len(w))
        for s, p, _ in [x for x in scored if x[2] == y][:5]:
            fits = [(t, j) for t, j, z in scored if z != y and 80 * -s <= 100 * -t <= 100 * -s]
            out |= {(i, p, rank, j, -s, -t) for rank, (t, j) in enumerate(fits[:5], 1)}
    return out


@pytest.mark.parametrize("seed,stored,anchors", [(1, 4096, 256), (2, 60, 7)])
def test_negatives_equal_brute_force(spark, monkeypatch, seed, stored, anchors):
    monkeypatch.setattr(negatives, "STORED", stored)
    monkeypatch.setattr(negatives, "ANCHORS", anchors)
    rows = made(seed)
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id bigint, label int, embedding array<double>, rank string")
    got = negatives.mine(df, df.vec_id % 3 == 0).collect()
    want = brute(rows, lambda i: i % 3 == 0)
    assert len(want) > 300 and {tuple(r) for r in got} == want and len(got) == len(want)
    assert negatives.mine(df.limit(0), df.vec_id % 3 == 0).count() == 0


def test_large_components(spark):
    big = float(2 ** 30)
    rows = [(0, 0, [big, 1.0]), (1, 0, [big, 3.0]), (2, 1, [big, 2.0]), (3, 1, [big, 3.0]), (4, 1, [big, 4.0])]
    df = spark.createDataFrame(rows, "vec_id bigint, label int, embedding array<double>")
    got = [tuple(r) for r in negatives.mine(df, df.vec_id == 0).collect()]
    assert sorted(got) == [(0, 1, 1, 3, 2 ** 60 + 3, 2 ** 60 + 3), (0, 1, 2, 2, 2 ** 60 + 3, 2 ** 60 + 2)]


def test_tree_spans_with_shortest_edges():
    x = np.random.default_rng(1).normal(size=(30, 3))
    order, parent, edge = negatives.spanning_tree(x)
    assert sorted(order) == list(range(30)) and all(order.index(parent[c]) < order.index(c) for c in order[1:])
    assert np.allclose(edge[order[1:]], [np.linalg.norm(x[c] - x[parent[c]]) for c in order[1:]])
