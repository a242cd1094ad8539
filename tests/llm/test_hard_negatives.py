"""Hard negatives against all pairs, and the vertical scan's bounds."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftline.llm import hard_negatives as H


def by_all_pairs(rows, is_anchor, positives=5, keep=3):
    """Rows (vec_id, vector, label) already usable, one an id."""
    q = {i: (label, [math.floor(256 * x) for x in v]) for i, v, label in rows}
    score = lambda a, b: sum(x * y for x, y in zip(q[a][1], q[b][1]))
    out = []
    for a in filter(is_anchor, q):
        ranked = sorted((-score(a, b), b) for b in q if b != a)
        for s, p in [(-s, b) for s, b in ranked if q[b][0] == q[a][0]][:positives]:
            hits = [(-n, b) for n, b in ranked if q[b][0] != q[a][0] and 50 * s <= 100 * -n <= 95 * s]
            out += [(a, p, r + 1, b, s, n) for r, (n, b) in enumerate(hits[:keep])]
    return sorted(out)


def clustered(n, dims=12, seed=3, scale=1.0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(4, dims))
    return [(i, (scale * (centres[i % 4] + 0.4 * rng.normal(size=dims))).tolist(), int(rng.integers(3))) for i in range(n)]


def frame(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    for c in ("q", "row", "n", "c", "block", "group", "ids", "labels", "numbers", "windows", "rank", "score", "anchor", "anchor_id"):
        df = df.withColumn(c, F.lit("x"))
    return df


def mined(spark, rows):
    got = H.mine(frame(spark, rows), F.col("vec_id") % 5 == 0)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(map(tuple, got.collect()))


@pytest.mark.parametrize("scale", [1.0, 20_000.0])
def test_all_pairs(spark, monkeypatch, scale):
    """In several blocks and groups; large components take the path of whole numbers."""
    monkeypatch.setattr(H, "BLOCK_ROWS", 50)
    monkeypatch.setattr(H, "GROUP_ANCHORS", 20)
    rows = clustered(300, dims=40 if scale > 1 else 12, scale=scale / 4)
    want = by_all_pairs(rows, lambda i: i % 5 == 0)
    assert want and mined(spark, rows) == want


def test_defined_cases(spark):
    v = lambda *x: [float(c) for c in x]
    good = [(0, v(1, 2), 0), (1, v(1, 2), 0), (2, v(1, 2), 0), (3, v(.5, 1), 1), (4, v(.7, 1), 2), (5, v(0, 0), 0), (6, v(-3, -4), 1),
            (10, v(-1, 0), 7), (11, v(.9, 1.7), 1), (12, v(.9, 1.7), 1), (13, v(.9, 1.7), 2), (14, v(.9, 1.7), 2)]
    bad = [(None, v(1, 1), 0), (20, None, 0), (25, v(1, 1), None), (21, [None, 1.0], 0), (22, v(math.nan, 1), 1), (23, v(math.inf, 1), 1),
           (24, v(1, 2, 3), 1), (26, [], 1), (27, v(1e9, 1), 1), (3, v(.5, 1), 1), (3, v(2, 2), 1), (4, v(.1, 1), 3)]
    want = by_all_pairs(good, lambda i: i % 5 == 0)
    assert want and mined(spark, good + bad) == want
    assert mined(spark, []) == [] and mined(spark, bad[:3]) == [] and mined(spark, good[3:4]) == []


def test_copies_of_a_third(spark, monkeypatch):
    monkeypatch.setattr(H, "BLOCK_ROWS", 64)
    rows = clustered(200) + [(1000 + i, [1.0] * 12, 1) for i in range(100)]
    assert mined(spark, rows) == by_all_pairs(rows, lambda i: i % 5 == 0)


def test_bounds_spare_reading():
    rng = np.random.default_rng(0)
    n, dims = 4000, 64
    labels = np.sort(rng.integers(0, 4, n))
    spread = 0.9 ** np.arange(dims)
    numbers = (300 * rng.normal(size=(n, dims)) * spread).astype(np.int32)
    block = H.Block(np.arange(n).tobytes(), labels.astype(np.int64).tobytes(), np.ascontiguousarray(numbers.T).tobytes())
    anchor = numbers[0].astype(np.int64)
    scan = H.Scan(block, anchor, 0, n)
    ids, scores = scan.run(lambda low, high: high >= np.partition(low, -5)[-5])
    exact = numbers.astype(np.int64) @ anchor
    assert [i for i, _ in H.best(ids, scores, 5)] == [i for i, _ in H.best(np.arange(n), exact, 5)]
    assert (exact[ids] == scores).all() and scan.read < 0.6 * n * dims


def test_vectors_are_not_broadcast(spark, monkeypatch):
    """Copies of anchor groups, one a block, once went to all through the driver, as their size was estimated without the copies."""
    monkeypatch.setattr(H, "BLOCK_ROWS", 20)
    plan = H.mine(frame(spark, clustered(300)), F.col("vec_id") % 5 == 0)._jdf.queryExecution().sparkPlan().toString().splitlines()
    depth = lambda line: len(line) - len(line.lstrip(" :+-"))
    sides = [i for i, line in enumerate(plan) if "numbers" in line and "Generate explode" in line]
    assert sides
    for i in sides:
        above, at = [], depth(plan[i])
        for line in reversed(plan[:i]):
            if depth(line) < at:
                at = depth(line)
                above.append(line)
        assert not any("Broadcast" in line and "block" in line for line in above)


def test_bounds_by_length():
    """Vectors of one length whose extremes say little: most dimensions of most rows are not needed, results stay exact."""
    rng = np.random.default_rng(1)
    n, dims = 6000, 64
    numbers = rng.normal(size=(n, dims)) * 0.9 ** rng.permuted(np.tile(np.arange(dims), (n, 1)), axis=1)
    numbers = np.floor(256 * numbers / np.linalg.norm(numbers, axis=1)[:, None]).astype(np.int32)
    block = H.Block(np.arange(n).tobytes(), np.zeros(n, np.int64).tobytes(), np.ascontiguousarray(numbers.T).tobytes())
    exact = numbers.astype(np.int64) @ numbers[:40].T.astype(np.int64)
    floor = np.sort(exact, axis=0)[-5]
    scan = H.Scan(block, H.Anchors(numbers[:40]), 0, n)
    ids, scores = scan.run(lambda low, high: high >= floor[scan.which], floor)
    assert (exact[ids, scan.which] == scores).all() and scan.read < 0.6 * n * dims * 40
    for a in range(40):
        of = scan.which == a
        assert H.best(ids[of], scores[of], 5) == H.best(np.arange(n), exact[:, a], 5)
