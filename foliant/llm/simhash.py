"""Near-duplicate groups by 64-bit fingerprints, found through Golay-code fuzzy keys.

A fingerprint is cut into three segments, each inside one 23-bit word. Two fingerprints that
differ in at most two bits agree wholly in one segment (pigeonhole) and differ in at most two
bits in the next. The binary Golay code is perfect: decoding a word and its 23 neighbours gives
one or six codewords, and any two words at distance two share one of them, because some word
lies within one bit of both. A key is an exact segment with a codeword index of the next one, so
each fingerprint has at most 18 keys and every linked pair shares at least one.

Fingerprints that share a key with another are verified by midpoints: two are within two bits
exactly if some word is within one bit of both. Each candidate emits its 65 midpoints and is tied
to the smallest fingerprint that has the same one, so a bucket with a third of all documents is
reduced by partial aggregation and never compared pair by pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ordered import lookup
from ..session import materialise
from .common import bounded_batches, keyed, row_key, text_blocks

SEED = 42
SHINGLE = 3
SEGMENTS = ((0, 22), (22, 21), (43, 21))
# generator polynomial of the (23, 12) Golay code: x^11+x^10+x^6+x^5+x^4+x^2+1
GOLAY = 0b110001110101


def shingle_hashes(text: str, size: int = SHINGLE) -> list[int]:
    """XXH64 of every run of ``size`` words; of the whole sequence when there are fewer."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if len(words) <= size:
        return [xxhash.xxh64_intdigest(b" ".join(words), SEED)] if words else []
    runs = zip(*(words[i:] for i in range(size)))
    return [xxhash.xxh64_intdigest(b" ".join(r), SEED) for r in runs]


def simhash(hashes: list[int]) -> int:
    """Bits that are set in more than half of the hashes; zero of none."""
    if not hashes:
        return 0
    rows = np.array(hashes, dtype="<u8").view(np.uint8).reshape(-1, 8)
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(rows), 1 << 16):  # a long text has its bits counted in blocks
        ones += np.unpackbits(rows[at : at + (1 << 16)], axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(rows), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, keep: list[Column], size: int = SHINGLE) -> DataFrame:
    """The kept columns and ``fp``, the fingerprint as a signed long; zero for null or wordless text."""
    bounded_batches(docs.sparkSession)

    @F.pandas_udf("long")
    def fingerprint(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            out = np.zeros(len(texts), dtype=np.uint64)
            for first, block in text_blocks(texts.tolist()):
                for i, t in enumerate(block, first):
                    out[i] = simhash(shingle_hashes(t, size))
            yield pd.Series(out.view(np.int64))

    return docs.select(*keep, fingerprint("text").alias("fp"))


def _remainders(words: np.ndarray) -> np.ndarray:
    """Each word modulo the generator polynomial."""
    rest = words.astype(np.int64)
    for bit in range(22, 10, -1):
        rest = np.where((rest >> bit) & 1, rest ^ (GOLAY << (bit - 11)), rest)
    return rest


def golay_tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Remainders of the low 12 and the high 11 bits, and the error pattern of every remainder."""
    bits = 1 << np.arange(23)
    errors = [np.zeros(1, dtype=np.int64), bits]
    errors.append(np.array([a | b for a in bits for b in bits if a < b]))
    errors.append(np.array([a | b | c for a in bits for b in bits for c in bits if a < b < c]))
    patterns = np.concatenate(errors)
    leader = np.zeros(1 << 11, dtype=np.int64)
    leader[_remainders(patterns)] = patterns
    return _remainders(np.arange(1 << 12)), _remainders(np.arange(1 << 11) << 12), leader


def golay_keys(words: np.ndarray, tables: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
    """For every 23-bit word the indices of the codewords that it and its neighbours decode to."""
    low, high, leader = tables
    near = words[:, None] ^ np.concatenate([[0], 1 << np.arange(23)])
    return (near ^ leader[low[near & 4095] ^ high[near >> 12]]) >> 11


def fuzzy_keys(
    fps: np.ndarray, tables: tuple[np.ndarray, np.ndarray, np.ndarray]
) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (key, row) pairs: an exact segment joined with a codeword index of the next."""
    bits = fps.view(np.uint64)
    cut = [((bits >> np.uint64(s)) & np.uint64((1 << n) - 1)).astype(np.int64) for s, n in SEGMENTS]
    keys, rows = [], []
    for i in range(3):
        index = np.sort(golay_keys(cut[(i + 1) % 3], tables), axis=1)
        fresh = np.ones(index.shape, dtype=bool)
        fresh[:, 1:] = index[:, 1:] != index[:, :-1]
        row, col = np.nonzero(fresh)
        keys.append((i << 35) | (cut[i][row] << 12) | index[row, col])
        rows.append(row)
    return np.concatenate(keys), np.concatenate(rows)


def candidates(fps: DataFrame) -> DataFrame:
    """Distinct fingerprints ``fp`` that share a fuzzy key with another one."""

    def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tables = None
        for b in batches:
            tables = tables or golay_tables()
            values = b["fp"].to_numpy(np.int64)
            keys, rows = fuzzy_keys(values, tables)
            yield pd.DataFrame({"key": keys, "fp": values[rows]})

    keys = fps.mapInPandas(emit, "key long, fp long")
    shared = keys.groupBy("key").agg(F.min("fp").alias("low"), F.max("fp").alias("high"))
    shared = shared.where("low <> high").select("key")
    return lookup(keys, shared, ["key"], "inner").select("fp").distinct()


def links(fps: DataFrame) -> DataFrame:
    """Edges ``u > v`` that connect exactly the fingerprints within two bits of each other.

    Every fingerprint is tied to the smallest one it shares a midpoint with; all that share a
    midpoint are within two bits, so connectivity is that of all pairs.
    """
    flips = [F.lit(1 << b if b < 63 else -(1 << 63)).cast("long") for b in range(64)]
    around = F.array(F.col("fp"), *[F.col("fp").bitwiseXOR(m) for m in flips])
    near = candidates(fps).select("fp", F.explode(around).alias("mid"))
    least = near.groupBy("mid").agg(F.min("fp").alias("v"), F.max("fp").alias("top"))
    least = least.where("v <> top").select("mid", "v")
    return (
        lookup(near, least, ["mid"], "inner")
        .where("fp > v")
        .select(F.col("fp").alias("u"), "v")
        .distinct()
    )


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``root``, the smallest node of its component, for every node that has an edge.

    Alternates two contractions until nothing changes: larger neighbours are hung on a node's
    smallest neighbour, then smaller ones. The number of rounds grows with the logarithm of the
    longest chain. Each round ends in a written table.
    """

    def state(df: DataFrame):
        return df.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()

    edges = materialise(edges, "links")
    before = state(edges)
    while before[0]:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (
            lookup(both, low, ["u"], "inner")
            .where("v > u")
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .distinct()
        )
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        hung = lookup(large, low, ["u"], "inner")
        small = hung.select("u", F.col("m").alias("v")).union(
            hung.where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        )
        edges = materialise(small.distinct(), "links")
        after = state(edges)
        if after == before:
            break
        before = after
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
        edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )


def near_duplicates(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """``doc_id``, ``fingerprint`` and ``component_id`` of every row of ``docs`` (doc_id, text).

    ``component_id`` is the smallest doc_id that can be reached over links of two or fewer bits,
    the row's own included. Repeated rows each appear. A null text counts as empty, which has
    fingerprint zero and links like any other; a null doc_id never becomes a component_id unless
    the whole component has none. Other columns of ``docs`` are ignored. No rows give no rows.
    """
    marked = materialise(fingerprints(docs, [F.col("doc_id")], size), "fingerprints")
    return label(marked).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def label(marked: DataFrame) -> DataFrame:
    """Adds ``component_id`` and ``root`` to rows of (doc_id, fp, ...).

    ``root`` is the component's least fingerprint. It alone names a component: ``component_id``
    is null for all without doc_ids and can be shared where a doc_id repeats.
    """
    fps = marked.groupBy("fp").agg(F.min("doc_id").alias("first"))
    roots = components(links(fps.select("fp")))
    fps = fps.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "first", F.coalesce("root", "fp").alias("root")
    )
    least = fps.groupBy("root").agg(F.min("first").alias("component_id"))
    named = lookup(fps, least, ["root"], "inner").select("fp", "component_id", "root")
    return lookup(marked, named, ["fp"], "inner")


def one_of_each(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """The rows of ``docs`` without near duplicates: of each component the smallest doc_id stays.

    Of rows with that doc_id one stays (the smallest text hash); where a component has only null
    doc_ids, one of its rows stays. All columns are kept.
    """
    mark = fingerprints(docs, [F.col("doc_id"), *row_key()], size)
    mark = mark.groupBy("doc_id", "_id", "_hash", "fp").agg(F.count(F.lit(1)).alias("n"))
    return best_rows(docs, label(materialise(mark, "fingerprints")))


def best_rows(docs: DataFrame, mark: DataFrame) -> DataFrame:
    """Of each ``root`` the row of ``docs`` with the smallest doc_id, then text hash; once if it repeats.

    ``mark`` has a row per doc_id and text: doc_id, _id, _hash, n (how often it occurs), root.
    """
    best = mark.groupBy("root").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_hash", "_id", "n")).alias("k")
    )
    best = materialise(best.select("k._id", "k._hash", "k.n"), "kept")
    rows, key, own_id, own_hash = keyed(docs)

    def among(keys: DataFrame) -> DataFrame:
        return rows.join(keys, (own_id == keys["_id"]) & (own_hash == keys["_hash"]), "left_semi")

    # only rows that repeat are grouped with their texts
    once, repeated = among(best.where("n = 1")), among(best.where("n > 1")).dropDuplicates([key])
    return once.union(repeated).drop(key)
