"""Fast similarity sketches: their law, and near-duplicate groups against all pairs."""

import random
import re

import numpy as np
import pytest

from foliant.llm import queries, sketch

from .brute import lower
from .test_operators import CLASHING, DOCS, same


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", lower(text or ""))
    return {tuple(w[i : i + 4]) for i in range(len(w) - 3)} or ({tuple(w)} if w else set())


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    up = list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                up[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(least.get(root(i), d), d)
    return [(d, len(sets[i]), least.get(root(i))) for i, (d, _) in enumerate(rows)]


def test_awkward_rows(spark):
    extra = ", digest string, bands string, key long, node long, root long, row long, u long, v long"
    docs = spark.createDataFrame(
        [(d, t, "i", 1, 2, 3, "b", "n", "m", 4, "d", "b", 1, 2, 3, 4, 5, 6) for d, t in DOCS],
        f"doc_id long, text string, {CLASHING}{extra}",
    )
    same(sketch.near_duplicates(docs).collect(), brute(DOCS))
    assert sketch.near_duplicates(docs.limit(0)).count() == 0


def edited(words, n, rng):
    out = list(words)
    for _ in range(n):
        out[rng.randrange(len(out))] = f"e{rng.randrange(10**6)}"
    return out


def test_groups_of_copies(spark, monkeypatch):
    monkeypatch.setattr(sketch, "SIDE", 16)
    rng = random.Random(4)
    rows = []
    for g in range(6):
        base = [f"w{rng.randrange(3000)}" for _ in range(120)]
        rows += [" ".join(edited(base, rng.choice([0, 1, 2, 3, 4, 5]), rng)) for _ in range(40)]
    # a template in many texts, each below the threshold to most others
    base = [f"t{i}" for i in range(60)]
    rows += [" ".join(base + [f"x{rng.randrange(10**6)}" for _ in range(rng.choice([8, 12, 16, 20]))]) for _ in range(60)]
    # a chain: neighbours are linked, ends are not
    rows += [" ".join(f"c{i}" for i in range(k, k + 60)) for k in range(0, 60, 5)]
    rows = list(enumerate(rows))
    rng.shuffle(rows)
    want = brute(rows)
    assert 8 < len({c for _, _, c in want}) < 200
    same(sketch.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect(), want)


def test_short_sets(spark):
    rows = list(enumerate(["a b c d e", "a b c d e f", "a b c d", "a b c", "A  B\tc", "a b c d e f g h", "a b c d e f g h i", "x", "X"]))
    same(sketch.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect(), brute(rows))


def test_every_coordinate_fills_and_estimates():
    rng = np.random.default_rng(3)
    for n in (1, 3, 40, 5000):
        a = rng.integers(0, 2**63, n, dtype=np.uint64)
        b = np.concatenate([a[: n // 2], rng.integers(0, 2**63, n - n // 2, dtype=np.uint64)])
        rows = sketch.sketches(np.concatenate([a, b]), np.array([0, n, 2 * n]))
        assert (rows < np.uint64(2**64 - 1)).all()
        exact = (n // 2) / (2 * n - n // 2)
        assert abs((rows[0] == rows[1]).mean() - exact) < 0.13
        # a set's sketch does not depend on its neighbours in the block
        assert (sketch.sketches(b, np.array([0, n])) == rows[1]).all()


def test_pieces_of_a_round(monkeypatch):
    rng = np.random.default_rng(5)
    e = rng.integers(0, 2**63, 3000, dtype=np.uint64)
    bounds = np.array([0, 0, 10, 1000, 1001, 3000])
    whole = sketch.sketches(e, bounds)
    monkeypatch.setattr(sketch, "CHUNK", 64)
    assert (sketch.sketches(e, bounds) == whole).all()


@pytest.mark.parametrize("size", [1, 4])
def test_hashes_stand_for_shingles(size):
    texts = ["", "one", "a b c d a b c d a b", "x y z", "long " * 50 + "tail", " \n "]
    h, bounds = sketch.shingle_hashes(texts, size)
    assert np.diff(bounds).tolist() == [len(sketch.shingle_set(t, size)) for t in texts]
    assert len(set(h[bounds[0] : bounds[-1]].tolist())) == len(set().union(*[sketch.shingle_set(t, size) for t in texts]))


def test_query_against_all_pairs(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = queries.op13_fast_sketch_groups(spark, sf).collect()
    same([tuple(r)[:3] for r in got], brute(rows))
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)
