"""Hard negatives against plain loops over all rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliant.llm import hardneg, queries

from .test_operators import same

COLUMNS = "vec_id long, label int, q array<long>"


def brute(rows, anchor=lambda v: v % 50 == 0, positives=5, negatives=3, low=50, high=95):
    rows = [(v, y, q) for v, y, q in rows if v is not None and y is not None and q is not None and None not in q]
    out = []
    for a, (v, y, q) in enumerate(rows):
        if not anchor(v):
            continue
        scored = [
            (-sum(x * z for x, z in zip(q, p, strict=False)), w, label == y)
            for b, (w, label, p) in enumerate(rows)
            if b != a
        ]
        scored.sort()
        for s, w, _ in [s for s in scored if s[2]][:positives]:
            fits = [t for t in scored if not t[2] and low * -s <= 100 * -t[0] <= high * -s][:negatives]
            out += [(v, w, i, t[1], -s, -t[0]) for i, t in enumerate(fits, 1)]
    return out


@pytest.fixture
def small(monkeypatch):
    monkeypatch.setattr(hardneg, "PAGE", 64)
    monkeypatch.setattr(hardneg, "LEAF", 8)
    monkeypatch.setattr(hardneg, "CELL_PAGES", 2)
    monkeypatch.setattr(hardneg, "CELL_QUERIES", 5)


def clustered(n, seed, dims=6, ties=40):
    rng = np.random.default_rng(seed)
    centres = rng.normal(0, 60, (7, dims))
    rows = [(i, int(rng.integers(4)), np.rint(centres[i % 7] + rng.normal(0, 25, dims)).astype(int).tolist()) for i in range(n)]
    # many equal vectors: ties at every k-th score, and more of them than a page holds
    return rows + [(n + i, i % 4, [50, -20, 30, 0, 10, 5]) for i in range(ties)]


def test_many_pages(spark, small):
    rows = clustered(700, 5, ties=180)
    same(hardneg.mine(spark.createDataFrame(rows, COLUMNS), F.col("vec_id") % 50 == 0).collect(), brute(rows))


def test_awkward_rows(spark, small):
    rows = clustered(120, 9)
    rows += [(200, 1, None), (201, None, [1] * 6), (None, 1, [9] * 6), (250, 1, [1, None, 2]), (300, 2, [])]
    rows += [(350, 1, [40, 40]), (50, 1, [70, 1, 2, 3, 4, 5]), (50, 1, [70, 1, 2, 3, 4, 5]), (400, 3, [-50] * 6)]
    rows += [(450, 99, [1] * 6)]  # a label of one row has no positives
    df = spark.createDataFrame(rows, COLUMNS)
    clashing = df.withColumns({c: F.lit(1) for c in ("row", "page", "size", "_n", "_part", "anchor", "rows", "_t0")})
    same(hardneg.mine(clashing, F.col("vec_id") % 50 == 0).collect(), brute(rows))
    assert hardneg.mine(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_large_numbers(spark):
    rng = np.random.default_rng(1)
    rows = [(i, i % 2, [int(x) for x in rng.integers(-(1 << 29), 1 << 29, 4)]) for i in range(101)]
    rows += [(101, 0, [1 << 30, 0, 0, 0]), (102, 0, [(1 << 30) + 1, 0, 0, 0])]  # differ beyond a double's digits
    same(hardneg.mine(spark.createDataFrame(rows, COLUMNS), F.col("vec_id") % 50 == 0).collect(), brute(rows))


def test_boxes_bound_scores_and_prune():
    rng = np.random.default_rng(2)
    q = np.sort(rng.integers(-200, 200, (512, 3)), axis=0)
    low, high = np.minimum.reduceat(q, range(0, 512, 64)), np.maximum.reduceat(q, range(0, 512, 64))
    asked = rng.integers(-50, 50, (9, 3))
    lower, upper = hardneg.intervals(asked, low, high)
    scores = (asked @ q.T).reshape(9, 8, 64)
    assert (lower <= scores.min(2)).all() and (upper >= scores.max(2)).all()
    best = hardneg.Best(1, low=10, high=20)
    assert best.passes(0, 10) and best.passes(20, 99) and not best.passes(21, 99) and not best.passes(-5, 9)
    best.add(np.array([15]), np.array([3]), np.array([0]))
    assert best.passes(0, 15) and not best.passes(0, 14)  # an equal score may still win by its id


def test_components_that_are_no_numbers(spark):
    rows = [(1, [0.5, float("nan")]), (2, [float("inf"), 1.0]), (3, [None, 1.0]), (4, None), (5, [-0.001, 0.999])]
    df = spark.createDataFrame(rows, "k long, v array<float>")
    got = df.select("k", hardneg.quantised(F.col("v"), 256).alias("q")).collect()
    assert {r.k: r.q for r in got} == {1: None, 2: None, 3: None, 4: None, 5: [-1, 255]}


def test_query_against_loops(spark):
    sf = "/root/testdata/sf0.001"
    rows = []
    for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect():
        label = (r.label + 1) % 10 if r.vec_id % 7 == 0 else r.label
        rows.append((r.vec_id, label, [int(np.floor(256 * float(x))) for x in r.embedding]))
    same(queries.op12_packed_hard_negatives(spark, sf).collect(), brute(rows))
