"""Removal of long repeated byte strings with suffix arrays built by two-stage sorting.

Which strings must meet: every 200-byte window of a text is named by the least hash of the
32-byte grams in it, so equal windows have equal names and neighbouring windows mostly share one.
A text falls into runs of windows with one name, about one run per 85 bytes. Only runs whose name
occurs twice (or whose gram does, in periodic text) can repeat; their bytes (from the first window's start to the last one's end) travel
to the task of their name, equal strings once with their number.

There a suffix array of the strings is built. Suffixes smaller than their successors are sorted
directly, by ranks of ever longer stretches (8, 24, 72, 200 bytes); all others are induced by one scan
over the buckets of first bytes, each placed when its successor is passed. Neighbours with a
common prefix of 200 bytes are the repeated windows, compared as bytes and not as hashes.

A name with more distinct strings than one task should sort (a passage in a third of all texts,
with another text around it each time) is settled window by window: 128-bit digests are counted
with partial aggregation, which has no large group.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ordered import lookup
from ..session import materialise, shuffles_dropped
from .common import bounded_batches, whole

LENGTH = 200
GRAM = 32
# bytes of strings in one suffix array, and distinct strings of one name that a task sorts
CHUNK_BYTES = 1 << 21
LARGEST_GROUP = 20_000
# bits of a sort key that is made of ranks
KEY_BITS = 64
# strings that a map task holds to count equal ones
HELD = 1 << 15


def _byte_values() -> np.ndarray:
    x = np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)


BYTE_VALUES = _byte_values()


def runs_of(raw: bytes, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Names, first starts and last starts of the runs of equally named windows, and a weight.

    The weight is two where the naming gram occurs again in the text: such a run can repeat
    itself, as periodic text does.
    """
    if len(raw) < length:
        none = np.zeros(0, dtype=np.int64)
        return none, none, none, none
    h = BYTE_VALUES[np.frombuffer(raw, dtype=np.uint8)]
    step = 1
    while step < GRAM:  # the hash of 2n bytes from the hashes of its halves
        h = h[:-step] * np.uint64(0xD6E8FEB86659FD93) + h[step:]
        h ^= h >> np.uint64(29)
        step *= 2
    grams = np.sort(h)
    twice = grams[1:][grams[1:] == grams[:-1]]
    width, done = length - GRAM + 1, 1
    while done < width:
        step = min(done, width - done)
        h = np.minimum(h[:-step], h[step:])
        done += step
    edge = np.nonzero(h[1:] != h[:-1])[0] + 1
    first = np.concatenate([[0], edge])
    name = h[first]
    return name.view(np.int64), first, np.append(edge, len(h)) - 1, 1 + np.isin(name, twice)


def words_at(text: np.ndarray) -> np.ndarray:
    """The eight bytes from every position as one number that sorts like them, zeros past the end."""
    padded = np.concatenate([text, np.zeros(LENGTH + 16, dtype=np.uint8)]).astype(np.uint64)
    step, bits = 1, 8
    while step < 8:
        padded = (padded[:-step] << np.uint64(bits)) | padded[step:]
        step, bits = 2 * step, 2 * bits
    return padded


def ranks(key: np.ndarray) -> np.ndarray:
    """Equal numbers for equal keys, larger ones for larger keys."""
    order = np.argsort(key)
    key = key[order]
    out = np.zeros(len(key), dtype=np.uint64)
    out[order[1:]] = np.cumsum(key[1:] != key[:-1])
    return out


def sort_directly(at: np.ndarray, eight: np.ndarray, depth: int) -> np.ndarray:
    """The suffixes at these positions by their first ``depth`` bytes: two or three ranks of shorter
    stretches, which may overlap, are the key of a longer one."""
    key, width = eight, 8
    while width < depth:
        rank = ranks(key)
        bits = int(rank.max()).bit_length()
        parts = 3 if 3 * bits <= KEY_BITS else 2
        reach = min(depth, parts * width)
        size, key = len(rank) - (reach - width), np.uint64(0)
        for off in (0, width, reach - width) if reach > 2 * width else (0, reach - width):
            piece = rank[at + off] if reach == depth else rank[off : off + size]
            key = (key << np.uint64(bits)) | piece
        width = reach
        if reach == depth:
            return at[np.argsort(key)]
    return at[np.argsort(key[at])]


def suffix_array(text: np.ndarray, depth: int = LENGTH) -> np.ndarray:
    """Positions of all suffixes, in order of their first ``depth`` bytes."""
    n = len(text)
    # a suffix is smaller than its successor if the next different byte is larger
    change = np.zeros(n, dtype=np.int8)
    change[:-1] = np.sign(text[1:].astype(np.int16) - text[:-1])
    change[-1] = -1
    nearest = np.minimum.accumulate(np.where(change != 0, np.arange(n), n)[::-1])[::-1]
    small = change[nearest] > 0
    direct = sort_directly(np.nonzero(small)[0], words_at(text), depth)
    bounds = np.searchsorted(text[direct], np.arange(257))
    induced: list[list[np.ndarray]] = [[] for _ in range(256)]

    def place(passed: np.ndarray) -> None:
        """Predecessors that are larger than the suffixes just passed go to the ends of their buckets."""
        before = passed[passed > 0] - 1
        before = before[~small[before]]
        first = text[before]
        order = np.argsort(first, kind="stable")
        before, first = before[order], first[order]
        edge = np.nonzero(np.diff(first))[0] + 1
        for part in np.split(before, edge) if len(before) else ():
            induced[text[part[0]]].append(part)

    place(np.array([n]))
    out = []
    for c in range(256):
        at = 0
        while at < len(induced[c]):  # passing a bucket may add to its own end
            place(induced[c][at])
            at += 1
        place(direct[bounds[c] : bounds[c + 1]])
        out += [*induced[c], direct[bounds[c] : bounds[c + 1]]]
    return np.concatenate(out)


def common_prefixes(order: np.ndarray, text: np.ndarray, depth: int = LENGTH) -> np.ndarray:
    """For each suffix in order, the bytes it shares with the one before it, up to ``depth``."""
    eight = words_at(text)
    out = np.zeros(len(order), dtype=np.int64)
    live = np.arange(1, len(order))
    for off in range(0, depth, 8):
        a, b = eight[order[live] + off], eight[order[live - 1] + off]
        differ = a ^ b
        # whole equal bytes in front of the first different bit
        lead = np.zeros(len(live), dtype=np.int64)
        for shift in range(56, -1, -8):
            lead += (differ >> np.uint64(shift)) == 0
        out[live] += lead
        live = live[lead == 8]
    return np.minimum(out, depth)


def repeated_starts(strings: list[bytes], counts: np.ndarray, length: int = LENGTH) -> list[tuple[int, int, int]]:
    """(string, first, last) of all runs of starts whose window occurs twice, by the strings' counts."""
    text = np.frombuffer(b"".join(strings), dtype=np.uint8)
    sizes = np.array([len(s) for s in strings])
    owner = np.repeat(np.arange(len(strings)), sizes)
    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(text))
    order = suffix_array(text, length)
    order = order[left[order] >= length]
    run = np.cumsum(common_prefixes(order, text, length) < length) - 1
    twice = np.bincount(run, weights=counts[owner[order]]) >= 2
    hit = np.sort(order[twice[run]])
    edge = np.nonzero((np.diff(hit) > 1) | (np.diff(owner[hit]) > 0))[0] + 1
    heads = np.cumsum(sizes) - sizes
    out = []
    for part in np.split(hit, edge) if len(hit) else ():
        k = int(owner[part[0]])
        out.append((k, int(part[0] - heads[k]), int(part[-1] - heads[k])))
    return out


def _row() -> list[Column]:
    """Two numbers that tell a row by its doc_id and text."""
    return [
        F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("_doc"),
        F.xxhash64(F.col("doc_id").isNull(), F.col("text")).alias("_hash"),
    ]


def _digest(s: bytes) -> tuple[int, int]:
    d = xxhash.xxh3_128_digest(s)
    return int.from_bytes(d[:8], "big", signed=True), int.from_bytes(d[8:], "big", signed=True)


def named_runs(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """_doc, _hash, name, first, last, n (weight): all runs of all texts."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [runs_of(t.encode("utf-8", "surrogatepass"), length) for t in b["text"]]
            counts = [len(f[0]) for f in found]
            if not sum(counts):
                continue
            name, first, last, n = (np.concatenate([f[i] for f in found]) for i in range(4))
            doc, own = (np.repeat(b[c].to_numpy(), counts) for c in ("_doc", "_hash"))
            yield pd.DataFrame({"_doc": doc, "_hash": own, "name": name, "first": first, "last": last, "n": n})

    rows = docs.where(F.octet_length("text") >= length).select(*_row(), "text")
    return rows.mapInPandas(run, "_doc long, _hash long, name long, first int, last int, n int")


def _strings(found: DataFrame, length: int) -> DataFrame:
    """Strings by name, equal ones of a task added up: name, a, b (digest), s, n."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple, int] = {}

        def flush() -> pd.DataFrame:
            rows = [(name, *_digest(s), s, n) for (name, s), n in held.items()]
            held.clear()
            return pd.DataFrame(rows, columns=["name", "a", "b", "s", "n"])

        for b in batches:
            for text, runs, copies in zip(b["text"], b["runs"], b["copies"].tolist(), strict=True):
                raw = text.encode("utf-8", "surrogatepass")
                for r in runs:
                    key = (r["name"], raw[r["first"] : r["last"] + length])
                    held[key] = held.get(key, 0) + copies
                if len(held) >= HELD:
                    yield flush()
        if held:
            yield flush()

    return found.select("text", "runs", "copies").mapInPandas(run, "name long, a long, b long, s binary, n long")


def _occurrences(found: DataFrame, length: int) -> DataFrame:
    """Where each string stands: _doc, _hash, first, a, b."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for doc, h, text, runs in batch[["_doc", "_hash", "text", "runs"]].itertuples(index=False):
                raw = text.encode("utf-8", "surrogatepass")
                rows += [(doc, h, r["first"], *_digest(raw[r["first"] : r["last"] + length])) for r in runs]
            yield pd.DataFrame(rows, columns=["_doc", "_hash", "first", "a", "b"])

    return found.mapInPandas(run, "_doc long, _hash long, first int, a long, b long")


def _sorted_groups(strings: DataFrame, length: int) -> DataFrame:
    """Repeated starts of strings that come by name: a, b, low, high (starts within the string)."""

    def settle(held: dict[bytes, list]) -> pd.DataFrame:
        texts = list(held)
        found = repeated_starts(texts, np.array([held[t][2] for t in texts]), length)
        rows = [(*held[texts[k]][:2], low, high) for k, low, high in found]
        return pd.DataFrame(rows, columns=["a", "b", "low", "high"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[bytes, list] = {}
        size, last = 0, None
        for batch in batches:
            for name, a, b, s, n in batch[["name", "a", "b", "s", "n"]].itertuples(index=False):
                if size >= CHUNK_BYTES and name != last:
                    yield settle(held)
                    held, size = {}, 0
                if s in held:
                    held[s][2] += n
                else:
                    held[s] = [a, b, n]
                    size += len(s)
                last = name
        if held:
            yield settle(held)

    by_name = strings.repartition("name").sortWithinPartitions("name")
    return by_name.mapInPandas(run, "a long, b long, low int, high int")


def _counted_windows(strings: DataFrame, length: int) -> DataFrame:
    """The same for names with very many strings, by counted digests of their windows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [
                (a, b, at, *_digest(s[at : at + length]), n)
                for a, b, s, n in batch[["a", "b", "s", "n"]].itertuples(index=False)
                for at in range(len(s) - length + 1)
            ]
            yield pd.DataFrame(rows, columns=["a", "b", "at", "x", "y", "n"])

    windows = strings.mapInPandas(run, "a long, b long, at int, x long, y long, n long")
    twice = windows.groupBy("x", "y").agg(F.sum("n").alias("n")).where("n >= 2").select("x", "y")
    hit = lookup(windows.select("a", "b", "at", "x", "y"), twice, ["x", "y"], "left_semi")
    return hit.select("a", "b", F.col("at").alias("low"), F.col("at").alias("high")).distinct()


def _removed(rows: DataFrame, length: int) -> DataFrame:
    """_doc, _hash, removed, spans, sha: what goes from rows alike that hold a repeated string."""
    runs = materialise(named_runs(rows, length), "runs")
    again = materialise(runs.groupBy("name").agg(F.sum("n").alias("n")).where("n > 1"), "names")
    frequent = not again.where(F.col("n") > LARGEST_GROUP).isEmpty()
    runs = lookup(runs.drop("n"), again.select("name"), ["name"], "inner")
    runs = runs.groupBy("_doc", "_hash").agg(F.collect_set(F.struct("name", "first", "last")).alias("runs"))
    # rows alike are one from here on; the join is dealt as they are grouped, so texts travel once
    texts = rows.where(F.octet_length("text") >= length).select("text", *_row()).groupBy("_doc", "_hash")
    texts = texts.agg(F.first("text").alias("text"), F.count(F.lit(1)).alias("copies"))
    found = materialise(texts.join(runs, ["_doc", "_hash"]), "repeats")
    strings = _strings(found, length)
    if frequent:  # distinct strings are counted only where a name has that many runs
        groups = strings.select("name", "a", "b").distinct().groupBy("name").agg(F.count(F.lit(1)).alias("n"))
        large = materialise(groups.where(F.col("n") > LARGEST_GROUP).select("name"), "large-groups")
        starts = _sorted_groups(lookup(strings, large, ["name"], "left_anti"), length).union(
            _counted_windows(lookup(strings, large, ["name"], "left_semi"), length)
        )
    else:
        starts = _sorted_groups(strings, length)
    starts = materialise(starts, "starts")
    where = _occurrences(found, length)
    cuts = lookup(where, starts.groupBy("a", "b").agg(F.collect_set(F.struct("low", "high")).alias("s")), ["a", "b"], "inner")
    cuts = cuts.select("_doc", "_hash", "first", F.inline("s"))
    cut = F.struct((F.col("first") + F.col("low")).alias("start"), (F.col("first") + F.col("high") + length).alias("end"))
    cuts = cuts.groupBy("_doc", "_hash").agg(F.sort_array(F.collect_set(cut)).alias("cuts"))

    def keep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for doc, h, text, cuts in batch[["_doc", "_hash", "text", "cuts"]].itertuples(index=False):
                raw, left, at, spans, removed = text.encode("utf-8", "surrogatepass"), [], 0, 0, 0
                for c in cuts:
                    if c["start"] > at or not spans:
                        left.append(raw[at : c["start"]])
                        spans, at = spans + 1, c["start"]
                    removed += max(0, c["end"] - at)
                    at = max(at, c["end"])
                left.append(raw[at:])
                out.append((doc, h, removed, spans, hashlib.sha256(b"".join(left)).hexdigest()))
            yield pd.DataFrame(out, columns=["_doc", "_hash", "removed", "spans", "sha"])

    done = found.select("_doc", "_hash", "text").join(cuts, ["_doc", "_hash"]).mapInPandas(
        keep, "_doc long, _hash long, removed long, spans long, sha string"
    )
    return materialise(done, "removed")


def remove_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """Per row of ``docs`` (doc_id, text) what is left without repeated strings of ``length`` bytes.

    Columns doc_id, n_bytes, n_removed, n_spans, kept_sha256. A byte goes if a string of ``length``
    bytes that covers it also starts anywhere else, in the same text (also overlapping) or in any
    other row. A null text counts as empty. Repeated rows are each other's repeats. Other columns
    are ignored; no rows give no rows.
    """
    bounded_batches(docs.sparkSession)
    rows = docs.select("doc_id", whole(F.col("text")).alias("text"))
    with shuffles_dropped(docs.sparkSession):
        done = _removed(rows, length)
    text = F.col("text")
    every = rows.select("doc_id", *_row(), F.octet_length(text).cast("long").alias("n_bytes"), F.sha2(text, 256).alias("own"))
    return every.join(done, ["_doc", "_hash"], "left").select(
        "doc_id",
        "n_bytes",
        F.coalesce("removed", F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce("spans", F.lit(0)).cast("long").alias("n_spans"),
        F.coalesce("sha", "own").alias("kept_sha256"),
    )
