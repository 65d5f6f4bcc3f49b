"""Byte-level BPE over length-bucketed matrices of token ids, and back.

Every distinct piece of a block of texts is one row of a matrix whose width is the next power of
two; a second matrix holds the rank of every adjacent pair. In each round every row merges its
leftmost pair of least rank: the pair becomes one id, the row is compacted by one cell, and only
the two pairs beside the new id are looked up, in an open-addressing hash table. Rows without a
mergeable pair leave the matrix. A piece too long for a matrix takes all equal merges of a round
at once, up to the first that makes a pair to be merged before the next one.

Texts are split by arrays where the pattern is ``WORDLIKE``: the kind of every code point, then the
borders of all pieces of a block. Pieces alike are found by a hash that is checked code point by
code point, so only a block's distinct pieces become strings.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, text_blocks, worker_memory

NONE = np.int32(2**31 - 1)
# pieces beyond this many bytes are merged one by one
WIDEST = 256
# cells of one matrix
CELLS = 1 << 20
# distinct pieces whose ids a worker keeps at least; twice as many at most, and those of a block
KNOWN = 1 << 17
SPREAD = np.uint64(0x9E3779B97F4A7C15)
# the pattern whose pieces are found without the regex library
WORDLIKE = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
LETTER, NUMBER, SPACE, OTHER = 1, 2, 3, 4
# odd factors of the code points of a piece by their places, the last for all further places
PLACES = np.random.default_rng(7).integers(0, 2**63, 1 << 10, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class Ranks:
    """A rank file's vocabulary: ids of single bytes, hashed pairs, and the bytes of every id."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            raw = f.read()
        self.digest = hashlib.sha256(raw).hexdigest()
        self.whole = {base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.splitlines())}
        whole = self.whole
        self.single = np.array([whole[bytes([b])] for b in range(256)], dtype=np.int32)
        pairs = {
            (whole[t[:i]], whole[t[i:]]): r
            for t, r in whole.items()
            for i in range(1, len(t))
            if t[:i] in whole and t[i:] in whole
        }
        keys = np.array([a << 32 | b for a, b in pairs], dtype=np.uint64)
        self._hash(keys, np.fromiter(pairs.values(), dtype=np.int32, count=len(pairs)))
        self.size = max(whole.values()) + 1
        by_id = [b""] * self.size
        for t, r in whole.items():
            by_id[r] = t
        self.lengths = np.array([len(t) for t in by_id], dtype=np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)[:-1]])
        self.bytes = np.frombuffer(b"".join(by_id), dtype=np.uint8)

    def _hash(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Places all keys at their first free slot, one probe distance at a time."""
        bits = max(4, int(len(keys) * 2.5).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys = np.full(1 << bits, np.uint64(2**64 - 1))
        self.values = np.full(1 << bits, NONE, dtype=np.int32)
        slot = ((keys * SPREAD) >> self.shift).astype(np.int64)
        left = np.arange(len(keys))
        while len(left):
            free = left[self.values[slot[left]] == NONE]
            at, first = np.unique(slot[free], return_index=True)
            self.keys[at], self.values[at] = keys[free[first]], values[free[first]]
            left = np.setdiff1d(left, free[first])
            slot[left] = (slot[left] + 1) & self.mask

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of every pair of ids, ``NONE`` where it cannot be merged or either is negative."""
        key = a.astype(np.int64).view(np.uint64) << np.uint64(32) | b.astype(np.int64).view(np.uint64)
        slot = ((key * SPREAD) >> self.shift).astype(np.int64)
        out = self.values[slot]
        miss = np.nonzero((out != NONE) & (self.keys[slot] != key))[0]
        out[miss] = NONE
        while len(miss):  # another key is here: look at the next slot, until it is empty
            slot[miss] = (slot[miss] + 1) & self.mask
            there = self.values[slot[miss]]
            same = (there != NONE) & (self.keys[slot[miss]] == key[miss])
            out[miss[same]] = there[same]
            miss = miss[(there != NONE) & ~same]
        out[(a < 0) | (b < 0)] = NONE
        return out

    def merge_rows(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merges every row of a matrix padded with -1; the rows' ids end to end and their counts."""
        rows, width = ids.shape
        counts = (ids >= 0).sum(1)
        done = np.full((rows, width), -1, dtype=np.int32)
        at = np.arange(rows)
        ranks = np.full((rows, width), NONE, dtype=np.int32)
        if width > 1:
            ranks[:, :-1] = self.rank(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(rows, -1)
        while len(at):
            col = ranks.argmin(1)
            row = np.arange(len(at))
            best = ranks[row, col]
            over = best == NONE
            if over.any():
                done[at[over], : ids.shape[1]] = ids[over]
                at, ids, ranks = at[~over], ids[~over], ranks[~over]
                col, best, row = col[~over], best[~over], row[: len(at)]
                if not len(at):
                    break
            ids[row, col] = best
            # compaction: what follows the merged pair moves one cell to the left
            width = ids.shape[1] - 1
            source = np.arange(width) + (np.arange(width) > col[:, None])
            ids = np.take_along_axis(ids, source, 1)
            ranks = np.take_along_axis(ranks, source, 1)
            counts[at] -= 1
            left = np.maximum(col - 1, 0)
            has = col > 0
            ranks[row[has], left[has]] = self.rank(ids[row[has], left[has]], best[has])
            right = np.minimum(col + 1, width - 1)
            after = np.where(col + 1 < width, ids[row, right], -1)
            ranks[row, col] = self.rank(best, after)
        return done[done >= 0], counts

    def merge_long(self, ids: np.ndarray) -> np.ndarray:
        """One long row, merged as ``merge_rows`` would."""
        ranks = self.rank(ids[:-1], ids[1:])
        while len(ranks) and (least := ranks.min()) != NONE:
            at = np.nonzero(ranks == least)[0]
            # of overlapping pairs every second one is left after the leftmost is merged
            run = np.cumsum(np.diff(at, prepend=-2) > 1)
            at = at[(np.arange(len(at)) - np.searchsorted(run, run)) % 2 == 0]
            before = np.where(at > 0, ids[at - 1], -1)
            before[1:][at[1:] - at[:-1] == 2] = least
            after = np.where(at + 2 < len(ids), ids[np.minimum(at + 2, len(ids) - 1)], -1)
            merged = np.full(len(at), least)
            sooner = np.minimum(self.rank(before, merged), self.rank(merged, after)) <= least
            if sooner.any():
                at = at[: int(sooner.argmax()) + 1]
            ids[at] = least
            ids = np.delete(ids, at + 1)
            at -= np.arange(len(at))
            ranks = np.delete(ranks, np.minimum(at + np.arange(len(at)) + 1, len(ranks) - 1))
            near = np.unique(np.concatenate([at[at > 0] - 1, at[at < len(ids) - 1]]))
            ranks = ranks[: len(ids) - 1]
            ranks[near] = self.rank(ids[near], ids[near + 1])
        return ids

    def encode_pieces(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of every piece as little-endian 32-bit integers; a piece that is itself in the vocabulary is one id."""
        out: list[bytes] = [b""] * len(pieces)
        buckets: dict[int, list[int]] = {}
        for i, p in enumerate(pieces):
            if (known := self.whole.get(p)) is not None:
                out[i] = known.to_bytes(4, "little")
            elif len(p) > WIDEST:
                out[i] = self.merge_long(self.single[np.frombuffer(p, dtype=np.uint8)]).astype("<i4").tobytes()
            else:
                buckets.setdefault((len(p) - 1).bit_length(), []).append(i)
        for bits, members in buckets.items():
            width = 1 << bits
            for k in range(0, len(members), max(1, CELLS // width)):
                part = members[k : k + max(1, CELLS // width)]
                sizes = np.array([len(pieces[i]) for i in part])
                filled = np.arange(width) < sizes[:, None]
                ids = np.full((len(part), width), -1, dtype=np.int32)
                ids[filled] = self.single[np.frombuffer(b"".join(pieces[i] for i in part), dtype=np.uint8)]
                flat, counts = self.merge_rows(ids)
                flat, ends = flat.astype("<i4").tobytes(), (4 * np.cumsum(counts)).tolist()
                for i, start, end in zip(part, [0, *ends], ends):  # noqa: B905
                    out[i] = flat[start:end]
        return out

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of all ids, gathered in one go."""
        size = self.lengths[ids]
        ends = np.cumsum(size)
        total = int(ends[-1]) if len(ends) else 0
        return self.bytes[np.arange(total) + np.repeat(self.starts[ids] - ends + size, size)].tobytes()


class Splitter:
    """Cuts a block of texts into the pieces of ``WORDLIKE``, as the regex library does."""

    def __init__(self):
        self.kinds = np.zeros(0x110000, dtype=np.uint8)  # 0: not asked yet
        self.tests = [(LETTER, regex.compile(r"\p{L}")), (NUMBER, regex.compile(r"\p{N}")), (SPACE, regex.compile(r"\s"))]

    def kind(self, codes: np.ndarray) -> np.ndarray:
        found = self.kinds[codes]
        if not found.all():
            for c in np.unique(codes[found == 0]).tolist():
                self.kinds[c] = next((k for k, test in self.tests if test.match(chr(c))), OTHER)
            found = self.kinds[codes]
        return found

    def starts(self, codes: np.ndarray, begins: np.ndarray) -> np.ndarray:
        """True at the first code point of each piece. ``begins``: True where a text begins, and behind the last."""
        kind = self.kind(codes)
        first = begins[:-1].copy()
        first[1:] |= kind[1:] != kind[:-1]
        # the last of a run of one kind, with more of the text behind it
        inner = np.append(first[1:], True) & ~begins[1:]
        # the last space before something else is a piece of its own, or the first of what follows
        space = np.flatnonzero(inner & (kind == SPACE))
        first[space] = True
        first[space[codes[space] == ord(" ")] + 1] = False
        # a contraction takes one or two letters from what follows
        quote = np.flatnonzero(inner & first & (codes == ord("'")))
        one = codes[quote + 1]
        two = np.where(begins[quote + 2], 0, codes[np.minimum(quote + 2, len(codes) - 1)])
        taken = np.isin(one, [ord(c) for c in "stmd"]).astype(np.int64)
        for pair in ("re", "ve", "ll"):
            taken[(one == ord(pair[0])) & (two == ord(pair[1]))] = 2
        quote, taken = quote[taken > 0], taken[taken > 0]
        first[quote + 1] = False
        behind = quote + taken + 1
        first[behind[behind < len(codes)]] = True
        return first

    def cut(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Distinct pieces, the number of the distinct piece that each piece is, and each text's number of pieces."""
        joined = "".join(texts)
        ends = np.cumsum([len(t) for t in texts])
        codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype="<u4")
        if not len(codes):
            return [], np.zeros(0, dtype=np.int64), np.zeros(len(texts), dtype=np.int64)
        begins = np.zeros(len(codes) + 1, dtype=bool)
        begins[0] = begins[ends] = True
        at = np.flatnonzero(self.starts(codes, begins))
        sizes = np.diff(at, append=len(codes))
        place = np.arange(len(codes)) - np.repeat(at, sizes)
        hashes = (codes.astype(np.uint64) + np.uint64(1)) * PLACES[np.minimum(place, len(PLACES) - 1)]
        hashes = np.add.reduceat(hashes, at) * SPREAD
        hashes ^= hashes >> np.uint64(32)
        _, least, which = np.unique(hashes, return_index=True, return_inverse=True)
        alike = np.array_equal(sizes[least][which], sizes)
        if not alike or not np.array_equal(codes[np.repeat(at[least][which], sizes) + place], codes):
            least = which = np.arange(len(at))  # different pieces with one hash: each stands for itself
        pieces = [joined[s:e] for s, e in zip(at[least].tolist(), (at + sizes)[least].tolist(), strict=True)]
        return pieces, which, np.diff(np.searchsorted(at, ends), prepend=0)


def cut_by(pattern: str) -> Callable[[list[str]], tuple[list[str], np.ndarray, np.ndarray]]:
    """``Splitter.cut`` for any pattern."""
    if pattern == WORDLIKE:
        return Splitter().cut
    split = regex.compile(pattern).findall

    def cut(texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        pieces = [split(t) for t in texts]
        number = {p: i for i, p in enumerate(dict.fromkeys(chain.from_iterable(pieces)))}
        which = np.fromiter(map(number.__getitem__, chain.from_iterable(pieces)), dtype=np.int64)
        return list(number), which, np.array([len(p) for p in pieces], dtype=np.int64)

    return cut


class Encoder:
    """Splits texts by a pattern and encodes every distinct piece once while it is remembered."""

    def __init__(self, ranks: Ranks, pattern: str):
        self.ranks, self.cut, self.known, self.older = ranks, cut_by(pattern), {}, {}

    def ids_of(self, pieces: list[str]) -> list[bytes]:
        if len(self.known) > KNOWN:  # what is still in use comes back from the older ones
            self.known, self.older = {}, self.known
        known, older, fresh = self.known, self.older, []
        for p in pieces:
            if p not in known:
                if (ids := older.get(p)) is None:
                    fresh.append(p)
                else:
                    known[p] = ids
        encoded = self.ranks.encode_pieces([p.encode("utf-8", "surrogatepass") for p in fresh])
        known.update(zip(fresh, encoded, strict=True))
        return [known[p] for p in pieces]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        pieces, which, per_text = self.cut(texts)
        coded = self.ids_of(pieces)
        flat = np.frombuffer(b"".join(coded), dtype="<i4")
        sizes = np.array([len(c) >> 2 for c in coded], dtype=np.int64)
        starts = np.cumsum(sizes) - sizes
        count = sizes[which]
        ends = np.cumsum(count)
        ids = flat[np.arange(count.sum()) + np.repeat(starts[which] - ends + count, count)]
        return np.split(ids, np.append(0, ends)[np.cumsum(per_text)][:-1])


def encode_documents(
    docs: DataFrame, path: str, pattern: str, ids_column: bool = False
) -> DataFrame:
    """Encodes and decodes every whole text of ``docs`` (doc_id, text).

    Columns doc_id, n_tokens, ids_sha256 (ids as little-endian 32-bit integers), decoded_sha256
    (bytes decoded from the ids), and ``ids`` if asked for. A null text counts as empty and has
    no ids. Repeated rows each appear; other columns are ignored; no rows give no rows. Encoding
    is by row, so any executor can repeat it; the vocabulary is broadcast, its size is the file's.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast(Ranks(path))
    schema = "n_tokens long, ids_sha256 string, decoded_sha256 string"
    schema += ", ids array<int>" if ids_column else ""

    @F.pandas_udf(schema)
    def coded(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        ranks = shared.value
        encoder = worker_memory(f"pieces of {ranks.digest} by {pattern}", lambda: Encoder(ranks, pattern))
        for texts in batches:
            counts, codes, back, lists = [], [], [], []
            for _, block in text_blocks(texts.tolist()):
                for ids in encoder.encode(block):
                    counts.append(len(ids))
                    codes.append(hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest())
                    back.append(hashlib.sha256(ranks.decode(ids)).hexdigest())
                    if ids_column:
                        lists.append(ids)
            out = {"n_tokens": counts, "ids_sha256": codes, "decoded_sha256": back}
            yield pd.DataFrame(out | ({"ids": lists} if ids_column else {}))

    return docs.select("doc_id", coded("text").alias("c")).select("doc_id", "c.*")
