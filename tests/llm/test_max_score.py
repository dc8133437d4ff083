"""MaxScore against all inner products."""

import math
import random

import pytest

from docloom.llm import max_score as M

DDL = "vec_id long, vec array<double>, label int, score double, shard string, block int, rank string"


def clip(x):
    return min(max(x, -(2**63)), 2**63 - 1)


def by_hand(rows, k, scale=256):
    good = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            good[i] = min(good.get(i, v), v)
    whole = {i: [min(max(math.floor(min(max(scale * x, -1e300), 1e300)), -(2**63)), 2**63 - 1024) for x in v] for i, v in good.items()}
    out = set()
    for q in (i for i in whole if i % 50 == 0):
        scored = sorted((-clip(sum(a * b for a, b in zip(whole[q], v, strict=False))), i) for i, v in whole.items() if i != q)
        out |= {(q, r, i, -s) for r, (s, i) in enumerate(scored[:k], 1)}
    return out


def found(spark, rows, k, **how):
    frame = spark.createDataFrame([(i, v, 1, 0.5, "x", 2, "y") for i, v in rows], DDL)
    asked = frame.where("vec_id % 50 = 0").selectExpr("vec_id AS query_id", "vec AS qvec", "label AS vec_id")
    got = M.top_k(spark, asked, frame, k, **how).collect()
    assert len({(r.query_id, r["rank"]) for r in got}) == len(got)
    return {tuple(r) for r in got}


def vectors(kind, n, rng):
    if kind == "dense":
        return [[rng.gauss(0, 0.125) for _ in range(32)] for _ in range(n)]
    if kind == "sparse":
        return [[rng.random() if rng.random() < 0.1 else 0.0 for _ in range(48)] for _ in range(n)]
    if kind == "ties":
        return [[rng.choice([-1 / 256, 0.0, 1 / 256]) for _ in range(4)] for _ in range(n)]
    if kind == "negative":
        return [[-rng.random() if d < 8 else rng.random() for d in range(16)] if i % 50 else [rng.random() if d < 8 else -rng.random() for d in range(16)] for i in range(n)]
    if kind == "skewed":
        return [[rng.gauss(0, 1) / (d + 1) ** 2 for d in range(32)] for _ in range(n)]
    if kind == "wide":
        return [[rng.gauss(0, 1e5) for _ in range(8)] for _ in range(n)]
    return [[rng.choice([1e12, -3e11, 1e300, -1e300, 0.5]) for _ in range(4)] for _ in range(n)]


@pytest.mark.parametrize("kind", ["dense", "sparse", "ties", "negative", "skewed", "wide", "huge"])
def test_equals_all_inner_products(spark, monkeypatch, kind):
    rng = random.Random(kind)
    rows = list(enumerate(vectors(kind, 600, rng)))
    rng.shuffle(rows)
    assert found(spark, rows, 5) == by_hand(rows, 5)
    assert found(spark, rows, 3, shard=170, block=4) == by_hand(rows, 3)


def local(rows, first, k, probed=2):
    """One shard, with small first ranges, so that thresholds act."""
    import numpy as np
    import pyarrow as pa

    M.FIRST, M.PROBED = first, probed
    ids, vecs = pa.chunked_array([pa.array([i for i, _ in rows], pa.int64())]), pa.chunked_array([pa.array([v for _, v in rows], pa.list_(pa.float64()))])
    asked = np.flatnonzero([i % 50 == 0 for i, _ in rows])
    got = M._search(k, 256)(pa.table([ids.take(pa.array(asked)), vecs.take(pa.array(asked))], ["query_id", "qvec"]), pa.table([ids, vecs], ["vec_id", "vec"]))
    rank = {}
    out = set()
    for q, i, s in zip(*(got.column(c).to_pylist() for c in ("query_id", "vec_id", "score")), strict=True):
        rank[q] = rank.get(q, 0) + 1
        out.add((q, rank[q], i, s))
    return out


@pytest.mark.parametrize("kind", ["dense", "sparse", "ties", "negative", "skewed", "wide", "huge"])
def test_thresholds_lose_nothing(monkeypatch, kind):
    monkeypatch.setattr(M, "FIRST", M.FIRST)
    monkeypatch.setattr(M, "PROBED", M.PROBED)
    rng = random.Random(kind)
    for n in (1, 6, 900):
        rows = list(enumerate(vectors(kind, n, rng)))
        for first in (2, 16):
            assert local(rows, first, 5) == by_hand(rows, 5)


def test_non_essential_lists_are_not_traversed():
    """With a steep profile most terms are non-essential after the first range."""
    import numpy as np

    rng = np.random.default_rng(0)
    rows = np.floor(rng.normal(size=(4096, 64)) * 256 / (np.arange(64) + 1) ** 1.5)
    index, best = M.Index(np.arange(4096), rows), M.Best(5)
    M._seed(index, np.array([50]), rows[50:51], [best], np.float64)
    wide = rows[50]
    bound = np.where(wide > 0, wide * index.most, wide * index.least)
    joint = np.minimum(np.cumsum(np.sort(bound)), np.floor(np.sqrt(np.cumsum(wide[np.argsort(bound, kind="stable")] ** 2)) * index.length) + 1)
    assert np.searchsorted(joint, best.enough) > 40


def test_awkward_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (0, [1.0, 2.0]), (0, [0.5, 9.0]), (1, None), (2, [1.0, None]), (3, [nan, 1.0]), (4, [inf, 1.0]), (None, [5.0, 5.0]), (5, []), (6, [1.0]), (7, [1.0, 2.0, 3.0]), (8, [1.0, 2.0]), (9, [1.0, 2.0]), (50, [0.0, 0.0]), (100, None)]
    assert found(spark, rows, 5) == by_hand(rows, 5)
    assert found(spark, [(50, [1.0])], 5) == set() == found(spark, [], 5)


def test_one_id_repeated_often(spark):
    rows = [(1, [0.1, 0.2])] * 3000 + [(i, [0.01 * i, 1.0]) for i in range(2, 60)] + [(0, [1.0, 1.0])]
    assert found(spark, rows, 5) == by_hand(rows, 5)
