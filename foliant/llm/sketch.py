"""Near-duplicate groups through fast similarity sketches, banding and exact verification.

A sketch has ``BINS`` coordinates. In round i every element of a set is hashed to a bin and a
value, which counts as i plus the value; a bin keeps its least. In the first ``BINS`` rounds the
bin is drawn by hash, in the next ``BINS`` all elements go to the one bin of that round, so after
twice ``BINS`` rounds every coordinate of a set that is not empty is filled, and large sets are
done after one or two rounds. Two coordinates are equal with the probability of the sets'
similarity, with the concentration of independent draws.

Rows with the same set are one class. ``ROWS`` coordinates in a band make a key; a pair at
similarity 0.8 misses all bands with probability 1.3e-7. A key's classes are first compared with
its least class alone, and what that exact comparison links is joined to components. Only keys
whose classes lie in different components afterwards are looked at further, in blocks of ``SIDE``
classes that meet two by two in a task: of pairs in different components those are compared, on
their whole sets, whose sizes allow the threshold and whose sketches agree in so many coordinates
that a pair at the threshold falls short with probability below 1e-6. No pair leaves a task that
is not a link between two components, so a group of copies costs rows as its size, not its square.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ordered import lookup
from ..session import materialise
from .common import bounded_batches, row_key, text_blocks
from .simhash import components

SIZE = 4
THRESHOLD = 80  # percent
BANDS = 40
ROWS = 5
BINS = BANDS * ROWS
# classes of one key whose sketches are compared in a task with those of another block
SIDE = 512
# elements of their sets
HELD = 1 << 19
# coordinates that pairs at the threshold agree in, less five and a half standard deviations
LEAST_EQUAL = int(BINS * 0.8 - 5.5 * (BINS * 0.8 * 0.2) ** 0.5)
# elements that one round hashes at once
CHUNK = 1 << 18

MULTIPLIERS = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def mixed(x: np.ndarray) -> np.ndarray:
    """64-bit numbers whose bits all depend on all bits of ``x``."""
    x = (x ^ (x >> np.uint64(30))) * MULTIPLIERS[0]
    x = (x ^ (x >> np.uint64(27))) * MULTIPLIERS[1]
    return x ^ (x >> np.uint64(31))


@cache
def round_seeds() -> np.ndarray:
    return mixed(np.arange(1, 2 * BINS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def words(text: str) -> list[bytes]:
    """A to Z lower-cased, parted at space and \\x09 to \\x0d."""
    return text.encode("utf-8", "surrogatepass").lower().split()


def shingle_set(text: str, size: int = SIZE) -> set[tuple[bytes, ...]]:
    """The distinct runs of ``size`` words; the whole sequence when there are fewer; none of no words."""
    w = words(text)
    if len(w) <= size:
        return {tuple(w)} if w else set()
    return set(zip(*(w[i:] for i in range(size))))


def similar(a: set, b: set, percent: int = THRESHOLD) -> bool:
    both = len(a & b)
    return both > 0 and 100 * both >= percent * (len(a) + len(b) - both)


def shingle_hashes(texts: list[str], size: int = SIZE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct 64-bit hashes of every text's shingles, and where each text's hashes begin (and the end).

    A text's shingle is the mix of its words' XXH64 in order; of fewer words all are mixed.
    """
    split = [words(t) for t in texts]
    counts = np.array([len(w) for w in split], dtype=np.int64)
    h = np.fromiter(
        map(xxhash.xxh64_intdigest, (w for own in split for w in own)), dtype=np.uint64, count=int(counts.sum())
    )
    first = np.cumsum(counts) - counts
    runs = np.where(counts > 0, np.maximum(counts - size + 1, 1), 0)
    owner = np.repeat(np.arange(len(texts)), runs)
    at = np.arange(int(runs.sum())) - np.repeat(np.cumsum(runs) - runs, runs) + first[owner]
    width = np.minimum(counts, size)[owner]
    out = mixed(width.astype(np.uint64))
    for i in range(size):
        inside = i < width
        out[inside] = mixed(out[inside] * np.uint64(0xD6E8FEB86659FD93) + h[at[inside] + i])
    order = np.lexsort((out, owner))
    out, owner = out[order], owner[order]
    fresh = np.ones(len(out), dtype=bool)
    fresh[1:] = (out[1:] != out[:-1]) | (owner[1:] != owner[:-1])
    out, owner = out[fresh], owner[fresh]
    return out, np.searchsorted(owner, np.arange(len(texts) + 1))


def sketches(elements: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Fast similarity sketches (sets x BINS) of the sets that ``bounds`` cuts; zeros for empty sets."""
    n = len(bounds) - 1
    sizes = np.diff(bounds)
    full = np.uint64(0xFFFFFFFFFFFFFFFF)
    out = np.full(n * BINS, full, dtype=np.uint64)
    open_sets = np.nonzero(sizes > 0)[0]
    seeds, low = round_seeds(), np.uint64(52)
    for i in range(2 * BINS):
        if not len(open_sets):
            break
        # sets of many elements go through a round in pieces
        ends = np.cumsum(sizes[open_sets])
        cut, start = [], 0
        while start < len(open_sets):
            stop = int(np.searchsorted(ends, (ends[start - 1] if start else 0) + CHUNK)) + 1
            cut.append(open_sets[start:stop])
            start = stop
        for sets in cut:
            own = sizes[sets]
            row = np.repeat(sets, own)
            index = np.arange(len(row)) - np.repeat(np.cumsum(own) - own, own) + bounds[row]
            h = mixed(elements[index] ^ seeds[i])
            if i < BINS:
                place = row * BINS + ((h >> low) * np.uint64(BINS) >> np.uint64(12)).astype(np.int64)
            else:
                place = row * BINS + (i - BINS)
            # the round in front of the value: what a bin got in an earlier round is less
            value = (np.uint64(i) << low) | (h & np.uint64((1 << 52) - 1))
            np.minimum.at(out, place, value)
        open_sets = open_sets[(out.reshape(n, BINS)[open_sets] == full).any(1)]
    out = out.reshape(n, BINS)
    out[sizes == 0] = 0
    return out


def band_keys(rows: np.ndarray) -> np.ndarray:
    """One 64-bit key per band (sets x BANDS)."""
    parts = rows.reshape(len(rows), BANDS, ROWS)
    keys = mixed(np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), parts.shape[:2]))
    for i in range(ROWS):
        keys = mixed(keys * np.uint64(0xD6E8FEB86659FD93) + parts[:, :, i])
    return keys.view(np.int64)


def sketched(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, its key, n_shingles, a digest, band keys and sketch.

    The sketch keeps one byte of every coordinate.
    """
    bounded_batches(docs.sparkSession)

    @F.pandas_udf("n long, digest string, bands array<long>, sketch binary")
    def sketch(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            parts = []
            for _, block in text_blocks(texts.tolist()):
                elements, bounds = shingle_hashes(block, size)
                rows = sketches(elements, bounds)
                own = [elements[s:e] for s, e in zip(bounds[:-1], bounds[1:], strict=True)]
                parts.append(
                    pd.DataFrame(
                        {
                            "n": np.diff(bounds),
                            "digest": [xxhash.xxh3_128_hexdigest(e.tobytes()) for e in own],
                            "bands": list(band_keys(rows)),
                            "sketch": [r.tobytes() for r in rows.astype(np.uint8)],
                        }
                    )
                )
            yield pd.concat(parts, ignore_index=True) if parts else pd.DataFrame(
                {"n": [], "digest": [], "bands": [], "sketch": []}
            )

    rows = docs.select("doc_id", *row_key(), sketch("text").alias("s"))
    return rows.select("doc_id", "_id", "_hash", "s.*")


def confirmed(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (u, v) of nodes whose whole sets reach the similarity; ``texts`` has (node, text).

    ``v`` may be a class that very many others are compared with: its text joins last.
    """
    mine = lookup(pairs, texts.select(F.col("node").alias("u"), F.col("text").alias("mine")), ["u"], "inner")
    both = lookup(mine, texts.select(F.col("node").alias("v"), F.col("text").alias("other")), ["v"], "inner")

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, theirs = None, set()
        for b in batches:
            keep = []
            for v, mine, other in zip(b["v"].tolist(), b["mine"].tolist(), b["other"].tolist(), strict=True):
                if v != last:  # rows of one class mostly follow each other
                    last, theirs = v, shingle_set(other, size)
                keep.append(similar(shingle_set(mine, size), theirs, percent))
            yield b.loc[keep, ["u", "v"]]

    return both.select("u", "v", "mine", "other").mapInPandas(compare, "u long, v long")


def runs(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """The groups of sorted rows, each whole, also where it spans batches."""
    held = None
    for b in batches:
        held = b if held is None or not len(held) else pd.concat([held, b], ignore_index=True)
        if not len(held):
            continue
        differs = np.zeros(len(held) - 1, dtype=bool)
        for k in keys:
            values = held[k].to_numpy()
            differs |= values[1:] != values[:-1]
        edges = np.nonzero(differs)[0] + 1
        for start, end in zip([0, *edges[:-1]], edges, strict=True) if len(edges) else ():
            yield held.iloc[start:end]
        held = held.iloc[edges[-1] :] if len(edges) else held
    if held is not None and len(held):
        yield held


def linked(left: np.ndarray, right: np.ndarray, b: pd.DataFrame, size: int, percent: int) -> list[tuple[int, int]]:
    """A forest of links between rows ``left`` and ``right`` of one key that different components lack.

    A pair is compared under the first band that it shares, and only if its sizes and sketches
    allow the threshold; what is left is counted on the whole sets.
    """
    node, root, n = (b[c].to_numpy() for c in ("node", "root", "n"))
    rows = np.frombuffer(b"".join(b["sketch"]), dtype=np.uint8).reshape(len(b), BINS)
    bands, band = np.stack(b["bands"].to_numpy()), int(b["band"].iloc[0])
    wanted: list[tuple[int, np.ndarray]] = []
    within = len(left) == len(right) and (left == right).all()
    for k in left:
        to = right[node[right] > node[k]] if within else right
        to = to[(root[to] != root[k]) & (100 * np.minimum(n[to], n[k]) >= percent * np.maximum(n[to], n[k]))]
        to = to[(bands[to] == bands[k]).argmax(1) == band] if len(to) else to
        to = to[(rows[to] == rows[k]).sum(1) >= LEAST_EQUAL] if len(to) else to
        if len(to):
            wanted.append((int(k), to))
    if not wanted:
        return []
    need = np.unique(np.concatenate([[k for k, _ in wanted], *[to for _, to in wanted]]))
    elements, bounds = shingle_hashes(b["text"].iloc[need].tolist(), size)
    _, elements = np.unique(elements, return_inverse=True)
    place = np.zeros(len(b), dtype=np.int64)
    place[need] = np.arange(len(need))
    mark = np.zeros(int(elements.max()) + 1, dtype=np.int64)
    up: dict[int, int] = {}

    def find(x: int) -> int:
        while up.get(x, x) != x:
            x = up[x]
        return x

    out = []
    for k, to in wanted:
        to = to[[find(int(root[t])) != find(int(root[k])) for t in to]]
        if not len(to):
            continue
        own = elements[bounds[place[k]] : bounds[place[k] + 1]]
        mark[own] = 1
        for t in to:
            both = int(mark[elements[bounds[place[t]] : bounds[place[t] + 1]]].sum())
            x, y = find(int(root[t])), find(int(root[k]))
            if x != y and 100 * both >= percent * (int(n[t]) + int(n[k]) - both):
                up[max(x, y)] = min(x, y)
                out.append((int(max(node[t], node[k])), int(min(node[t], node[k]))))
        mark[own] = 0
    return out


def crossing(members: DataFrame, size: int, percent: int) -> DataFrame:
    """Links (u, v) of one key between different components, enough to connect what is connected.

    ``members``: key, band, node, root, n, bands, sketch, text. A key's classes are dealt to
    blocks by number and by size; each pair of blocks meets in one task, which holds two blocks
    and emits at most one link a class.
    """
    sizes = members.groupBy("key").agg(F.greatest(F.count(F.lit(1)) / SIDE, F.sum("n") / HELD).alias("m"))
    dealt = lookup(members, sizes, ["key"], "inner")
    blocks = F.ceil("m")
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("node"), blocks)).withColumn(
        "other", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1))
    )
    keys = ["key", "i", "j"]
    columns = ["own", "band", "node", "root", "n", "bands", "sketch", "text"]
    dealt = dealt.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), *columns)

    def meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in runs(batches, keys):
            own, (i, j) = b["own"].to_numpy(), (int(b[c].iloc[0]) for c in ("i", "j"))
            left, right = np.nonzero(own == i)[0], np.nonzero(own == j)[0]
            if len(left) and len(right) and (i != j or len(left) > 1):
                yield pd.DataFrame(linked(left, right, b, size, percent), columns=["u", "v"], dtype=np.int64)

    return dealt.repartition(*keys).sortWithinPartitions(*keys).mapInPandas(meet, "u long, v long").distinct()


def near_duplicates(docs: DataFrame, size: int = SIZE, percent: int = THRESHOLD) -> DataFrame:
    """``doc_id``, ``n_shingles`` and ``component_id`` of every row of ``docs`` (doc_id, text).

    Rows are linked if their sets of word runs have at least ``percent`` of their union in common;
    ``component_id`` is the smallest doc_id that can be reached, the row's own included, and null
    only where no row of the component has one. A text without words (null, too) has an empty set
    and is linked with nothing. Repeated rows each appear. Other columns are ignored; no rows give
    no rows. Sets are told apart by 128-bit digests of their elements' 64-bit hashes; links between
    different sets are confirmed on the words.
    """
    numbered = sketched(docs, size).withColumn("row", F.monotonically_increasing_id())
    rows = materialise(numbered, "sketches")
    some = rows.where("n > 0")
    classes = some.groupBy("digest").agg(
        F.min(F.struct("row", "_id", "_hash")).alias("r"), F.min("doc_id").alias("first")
    )
    classes = materialise(
        classes.select("digest", "r._id", "r._hash", F.col("r.row").alias("node"), "first"), "classes"
    )
    # what is needed of each class is in the row that stands for it
    stands = lookup(some, classes.select(F.col("node").alias("row"), "node"), ["row"], "inner")
    keys = stands.select("node", "n", F.posexplode("bands").alias("band", "key"))
    spans = keys.groupBy("key").agg(F.min("node").alias("v"), F.max("node").alias("top")).where("v <> top")
    spans = spans.select("key", "v")
    keys = materialise(lookup(keys, spans, ["key"], "inner"), "keys")

    own_n = stands.select(F.col("node").alias("v"), F.col("n").alias("vn"))
    stars = keys.where("node <> v").groupBy(F.col("node").alias("u"), "v").agg(F.max("n").alias("n"))
    allowed = F.expr(f"100 * least(n, vn) >= {percent} * greatest(n, vn)")
    stars = lookup(stars, own_n, ["v"], "inner").where(allowed).select("u", "v")
    touched = materialise(keys.select("node").distinct(), "touched")
    wanted = lookup(classes, touched, ["node"], "left_semi").select("node", "_id", "_hash")
    texts = docs.select(*row_key(), "text")
    texts = texts.join(wanted, ["_id", "_hash"]).groupBy("node").agg(F.first("text").alias("text"))
    texts = materialise(texts, "texts")
    edges = materialise(confirmed(stars, texts, size, percent), "star-links")

    roots = components(edges)
    held = keys.join(roots.withColumnRenamed("root", "_root"), "node", "left")
    held = held.select("key", "band", "node", F.coalesce("_root", "node").alias("root"))
    held = materialise(held, "held")
    apart = held.groupBy("key").agg(F.min("root").alias("a"), F.max("root").alias("b")).where("a <> b").select("key")
    members = lookup(held, apart, ["key"], "left_semi")
    members = lookup(members, stands.select("node", "n", "bands", "sketch"), ["node"], "inner")
    members = lookup(members, texts, ["node"], "inner")
    more = materialise(crossing(members, size, percent), "pairs")
    edges = edges.union(confirmed(more, texts, size, percent))

    roots = materialise(components(edges), "roots")
    named = classes.join(roots, "node", "left").select("digest", "first", F.coalesce("root", "node").alias("root"))
    least = named.groupBy("root").agg(F.min("first").alias("component_id"))
    named = lookup(named, least, ["root"], "inner").select("digest", "component_id")
    linked = lookup(some.select("doc_id", "n", "digest"), named, ["digest"], "inner")
    alone = rows.where("n = 0").select("doc_id", "n", F.col("doc_id").alias("component_id"))
    return linked.select("doc_id", "n", "component_id").union(alone).withColumnRenamed("n", "n_shingles")
