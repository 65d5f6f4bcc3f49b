"""Repeated byte strings where rows repeat."""

import time

import numpy as np

from foliant.llm import repeats

from . import brute


def test_rows_alike_are_written_once(spark, monkeypatch):
    """A text that many rows hold under one doc_id goes on as one row with their number."""
    written, materialise = {}, repeats.materialise

    def kept(df, purpose):
        written[purpose] = materialise(df, purpose)
        return written[purpose]

    monkeypatch.setattr(repeats, "materialise", kept)
    rng = np.random.default_rng(6)
    a, b, c = (" ".join(f"w{i}" for i in rng.integers(0, 1 << 30, 60)) for _ in range(3))
    rows = [(1, a)] * 9 + [(2, b), (None, b), (2, c), (2, a[100:400] + c), (3, None), (3, "short"), (3, "short"), (4, c + "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = [tuple(r) for r in repeats.remove_repeats(docs).collect()]
    order = lambda r: (r[0] is not None, r[0] or 0, r[1:])
    want = [tuple(r) for r in brute.repeats(rows)]
    assert sorted(got, key=order) == sorted(want, key=order)
    found = written["repeats"].collect()
    assert len(found) == 6 and sorted(r.copies for r in found) == [1, 1, 1, 1, 1, 9]


def test_shuffles_of_finished_steps_are_dropped(spark):
    def files():
        manager = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
        every = manager.getAllFiles().iterator()
        names = []
        while every.hasNext():
            names.append(every.next().getName())
        return {n for n in names if n.startswith("shuffle_") and n.endswith(".data")}

    text = "".join(chr(97 + i * i % 23) for i in range(300))
    rows = spark.createDataFrame([(1, text), (2, "x" + text), (3, "short"), (4, None)], "doc_id long, text string")
    before = files()
    left = repeats.remove_repeats(rows)
    for _ in range(50):
        more = files() - before
        if not more:
            break
        time.sleep(0.2)
    assert not more
    assert {r.doc_id: r.n_removed > 0 for r in left.collect()} == {1: True, 2: True, 3: False, 4: False}


def test_direct_order_by_two_or_three_ranks(monkeypatch):
    rng = np.random.default_rng(7)
    raw = rng.integers(0, 256, 300, dtype=np.uint8).tobytes()
    raw += b"\0" * 250 + b"ab" * 300 + raw[50:290] + b"a" * 220 + raw[40:299] + rng.integers(0, 2, 900, dtype=np.uint8).tobytes()
    text = np.frombuffer(raw, dtype=np.uint8)
    at, eight = np.arange(len(text)), repeats.words_at(text)
    for bits in (64, 30):
        monkeypatch.setattr(repeats, "KEY_BITS", bits)
        for depth in (8, 13, 16, 40, 200):
            order = repeats.sort_directly(at, eight, depth)
            found = [raw[i : i + depth].ljust(depth, b"\0") for i in order]
            assert found == sorted(found) and sorted(order) == at.tolist()
