"""Token ids as directly addressable codes, written and read as segments.

An id is cut into chunks of eight bits. Level one holds the lowest chunk of every id and one bit
per id that tells whether more follows; level two the next chunk of those that continue, with
its own bits; and so on. A rank directory counts the set bits before every block of 512, so the
place of any id's next chunk is one directory entry and a few bytes of bits away, and any token
is read without decoding its neighbours.

A segment holds whole documents in ascending doc_id order; the file is a Parquet table with one
row per segment, written by Spark's committer so that a lost executor leaves no half file.
"""

from __future__ import annotations

import re
import string
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ..session import shared_dir
from .common import bounded_batches, text_blocks, worker_memory

CHUNK = 8
RANK_BLOCK = 512
# ids after which a segment is closed at the end of its document
SEGMENT = 1 << 19
# distinct words after which a worker starts a new generation of remembered ones
KNOWN = 1 << 18
ID = np.dtype("<u4")
# a character that stands between words that are encoded in one call, and words of a call
MARK = "\x01"
GROUP = 1024
# characters by which byte-level tokenizers write the bytes from 0x80 on; all others stand for themselves
BYTE_CHARS = {b: b + 0xA2 for b in range(0x80, 0xA1)} | {0xAD: 0x143}
# lower-case letters of ASCII and Latin-1, which NFC leaves as they are
WORD = re.compile("[a-z\u00df-\u00f6\u00f8-\u00ff]+")
# kinds of bytes: others, letters, punctuation, apostrophe (it may begin a piece with letters), digits
OTHER, LETTER, CLOSING, APOSTROPHE, DIGIT = range(5)
KIND = np.array(
    [
        LETTER if c.isalpha() else DIGIT if c.isdigit() else APOSTROPHE if c == "'" else CLOSING * (c in string.punctuation)
        for c in map(chr, range(128))
    ]
    + [OTHER] * 128,
    dtype=np.uint8,
)
# whether a piece ends between two neighbours of these kinds, whatever stands around them
PARTS = np.zeros(25, dtype=bool)
PARTS[[a * 5 + b for a in (LETTER, DIGIT) for b in (LETTER, CLOSING, APOSTROPHE, DIGIT) if not a == b == LETTER]] = True
PARTS[[CLOSING * 5 + LETTER, CLOSING * 5 + DIGIT, APOSTROPHE * 5 + DIGIT]] = True
# letters before such a byte bear no combining mark: ASCII and the leads of U+0080 to U+00FF
UNMARKED = np.array([b < 0x80 or b in (0xC2, 0xC3) for b in range(256)])
SCHEMA = (
    "part int, seq int, n_docs int, n_ids long, doc_ids array<long>, none array<boolean>, ends array<long>, "
    "chunks array<binary>, more array<binary>, ranks array<binary>"
)


class Codes:
    """The levels of one segment."""

    def __init__(self, chunks: list[bytes], more: list[bytes], ranks: list[bytes]):
        self.chunks = [np.frombuffer(c, dtype=np.uint8) for c in chunks]
        self.more = [np.frombuffer(m, dtype=np.uint8) for m in more]
        self.ranks = [np.frombuffer(r, dtype="<u4") for r in ranks]

    def rank(self, level: int, at: np.ndarray) -> np.ndarray:
        """Set bits of a level before each position: a directory entry and at most 64 bytes."""
        bits, block = self.more[level], at // RANK_BLOCK
        out = self.ranks[level][block].astype(np.int64)
        byte = block * (RANK_BLOCK // 8)
        for step in range(RANK_BLOCK // 8):
            here = byte + step
            whole = (here + 1) * 8 <= at
            if not whole.any():
                break
            out[whole] += np.bitwise_count(bits[here[whole]])
        part = at % 8 > 0
        mask = ((1 << (at[part] % 8)) - 1).astype(np.uint8)
        out[part] += np.bitwise_count(bits[at[part] // 8] & mask)
        return out

    def rank_one(self, level: int, at: int) -> int:
        """Set bits of a level before one position."""
        bits, first = self.more[level], at // RANK_BLOCK * (RANK_BLOCK // 8)
        n = int(self.ranks[level][at // RANK_BLOCK]) + int(np.bitwise_count(bits[first : at // 8]).sum())
        return n + (int(bits[at // 8]) & ((1 << at % 8) - 1)).bit_count() if at % 8 else n

    def get(self, at: np.ndarray) -> np.ndarray:
        """The ids at any positions."""
        at = np.asarray(at, dtype=np.int64)
        out, live = np.zeros(len(at), dtype=np.int64), np.arange(len(at))
        for level, chunks in enumerate(self.chunks):
            out[live] |= chunks[at].astype(np.int64) << (CHUNK * level)
            goes = (self.more[level][at // 8] >> (at % 8)) & 1 > 0
            if not goes.any():
                break
            at, live = self.rank(level, at[goes]), live[goes]
        return out

    def span(self, start: int, end: int) -> np.ndarray:
        """The ids from ``start`` to ``end``: on every level a continuing run of chunks."""
        out, live = np.zeros(end - start, dtype=np.int64), np.arange(end - start)
        for level, chunks in enumerate(self.chunks):
            out[live] |= chunks[start:end].astype(np.int64) << (CHUNK * level)
            bits = np.unpackbits(self.more[level][start // 8 : -(-end // 8)], bitorder="little")
            goes = bits[start % 8 :][: end - start] > 0
            live = live[goes]
            if not len(live):
                break
            start = self.rank_one(level, start)
            end = start + len(live)
        return out


def encode(ids: np.ndarray) -> tuple[list[bytes], list[bytes], list[bytes]]:
    """Chunks, continuation bits and rank directory of every level."""
    chunks, more, ranks = [], [], []
    rest = ids.astype(np.uint64)
    while True:
        chunks.append((rest & np.uint64((1 << CHUNK) - 1)).astype(np.uint8).tobytes())
        rest = rest >> np.uint64(CHUNK)
        goes = rest > 0
        more.append(np.packbits(goes, bitorder="little").tobytes())
        blocks = np.add.reduceat(goes, np.arange(0, len(goes), RANK_BLOCK), dtype=np.int64)
        ranks.append((np.cumsum(blocks) - blocks).astype("<u4").tobytes())
        if not goes.any():
            return chunks, more, ranks
        rest = rest[goes]


def parted(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 with unmarked letters in lower case and a space wherever a piece is sure to end, and before which
    bytes these spaces came."""
    old = np.frombuffer(data, dtype=np.uint8)
    after = np.append(old[1:], np.uint8(0x20))
    kind, new = KIND[old], old.copy()
    lead = np.nonzero((old == 0xC3) & (after >= 0x80) & (after != 0x97) & (after != 0xB7))[0]
    kind[lead] = kind[lead + 1] = LETTER
    capital = (old >= 0x41) & (old <= 0x5A)
    capital[lead + 1] = old[lead + 1] <= 0x9E
    new[capital & UNMARKED[after]] |= 0x20
    at = np.nonzero(PARTS[kind[:-1] * np.uint8(5) + kind[1:]])[0] + 1
    return np.insert(new, at, 0x20), at


class WordEncoder:
    """Encodes texts with a tokenizer that lower-cases, and never joins across white space, between letters
    and punctuation (but for what an apostrophe begins) or digits.

    Texts are taken apart there first. Each distinct part is encoded by the library once while it is
    remembered, as the bytes of its ids. Parts are remembered in two generations: those that come up
    again move to the newer one, and the older one goes when the newer is full. A text with a literal
    of a special token is encoded whole, and these become tokens, as the library does by default.

    A part that is a word of letters goes straight to the library's model, as the byte characters that
    the library's own steps would make of it; nothing is left for those steps to do.
    """

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.model = Tokenizer.from_file(path).model
        self.model._resize_cache(0)  # words that come again are not asked for again
        self.bytes_of = [i.to_bytes(ID.itemsize, "little") for i in range(self.tokenizer.get_vocab_size())]
        self.known: dict[str, bytes] = {"": b""}
        self.older: dict[str, bytes] = {}
        (self.mark,) = self.ids(MARK)
        self.special = [t.content.lower() for t in self.tokenizer.get_added_tokens_decoder().values()]

    def ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype=ID)

    def learn(self, parts: list[str]) -> None:
        """Encodes words of letters, and many others in one call with a control character between them, whose
        id parts them."""
        words = [p for p in parts if WORD.fullmatch(p)]
        others = set(parts).difference(words)
        spelt = " ".join(words).encode().decode("latin-1").translate(BYTE_CHARS).split(" ") if words else []
        tokenize, bytes_of = self.model.tokenize, self.bytes_of
        self.known.update(zip(words, [b"".join([bytes_of[t.id] for t in tokenize(w)]) for w in spelt], strict=True))
        plain = [p for p in others if MARK not in p]
        for k in range(0, len(plain), GROUP):
            group = plain[k : k + GROUP]
            ids = self.ids(f" {MARK} ".join([*group, ""]))
            ends = np.nonzero(ids == self.mark)[0] * ID.itemsize
            starts = np.concatenate([[0], ends[:-1] + ID.itemsize])
            data = ids.tobytes()
            own = [data[s:e] for s, e in zip(starts.tolist(), ends.tolist(), strict=True)]
            self.known.update(zip(group, own, strict=True))
        self.known.update((p, self.ids(p).tobytes()) for p in others if MARK in p)

    def ids_of(self, parts: list[str]) -> list[bytes]:
        """The ids of each of these distinct parts."""
        if len(self.known) > KNOWN:
            self.known, self.older = {"": b""}, self.known
        fresh = set(parts).difference(self.known)
        again = fresh.intersection(self.older)
        self.known.update((p, self.older[p]) for p in again)
        self.learn(list(fresh.difference(again)))
        return list(map(self.known.__getitem__, parts))

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        low = [t.lower() for t in texts]
        whole = {i for i, t in enumerate(low) if any(s in t for s in self.special)}
        raw = [b" " if i in whole else t.encode().replace(b"\n", b" ") + b" " for i, t in enumerate(texts)]
        ends = np.cumsum([len(r) for r in raw])
        data, spaces = parted(b"".join(raw))
        offsets = np.concatenate([[0], ends + np.searchsorted(spaces, ends)])
        rows = pa.LargeStringArray.from_buffers(len(raw), pa.py_buffer(offsets), pa.py_buffer(data))
        lists = pc.split_pattern(rows, " ")
        coded = lists.flatten().dictionary_encode()
        own = self.ids_of(coded.dictionary.to_numpy(zero_copy_only=False).tolist())
        # ids of the distinct parts behind each other, taken in the order of the texts
        ids, sizes = np.frombuffer(b"".join(own), dtype=ID), np.array([len(i) for i in own]) // ID.itemsize
        which = coded.indices.to_numpy()
        counts = sizes[which]
        ends = np.concatenate([[0], np.cumsum(counts)])
        at = np.repeat((np.cumsum(sizes) - sizes)[which] - ends[:-1], counts) + np.arange(ends[-1])
        data, cuts = ids[at].tobytes(), (ends[lists.offsets.to_numpy()] * ID.itemsize).tolist()
        out = [data[s:e] for s, e in zip(cuts[:-1], cuts[1:], strict=True)]
        for i in whole:
            out[i] = self.ids(texts[i]).tobytes()
        return out


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int) -> None:
    """Encodes every whole text of ``docs`` (doc_id, text), appends ``end_id``, writes segments.

    Rows are dealt by ranges of doc_id (and text, so that one repeated id does not stay in one
    task) and sorted there; ``part`` and ``seq`` put the segments in order.
    """
    bounded_batches(docs.sparkSession)
    order = ["doc_id", "tie"]
    rows = docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("tie"))
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    none = F.col("doc_id").isNull()
    rows = rows.select(
        F.coalesce("doc_id", F.lit(0)).alias("doc_id"), none.alias("none"), "text", F.spark_partition_id().alias("part")
    )

    def segment(part: int, seq: int, ids: list[bytes], docs: list[tuple[int, bool]]) -> pd.DataFrame:
        chunks, more, ranks = encode(np.frombuffer(b"".join(ids), dtype=ID))
        ends = (np.cumsum([len(i) for i in ids]) // ID.itemsize).tolist()
        doc_ids, none = map(list, zip(*docs, strict=True))
        row = [part, seq, len(ids), ends[-1], doc_ids, none, ends, chunks, more, ranks]
        return pd.DataFrame([row], columns=[c.split()[0] for c in SCHEMA.split(", ")])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # known words outlast the task; their number is bounded
        encoder = worker_memory(f"words of {tokenizer}", lambda: WordEncoder(tokenizer))
        seq, size, ids, doc_ids, part = 0, 0, [], [], 0
        end = np.array([end_id], dtype=ID).tobytes()
        for b in batches:
            part = int(b["part"].iloc[0]) if len(b) else part
            numbers = list(zip(b["doc_id"].tolist(), b["none"].tolist(), strict=True))
            for first, block in text_blocks(b["text"].tolist()):
                for i, own in enumerate(encoder.encode(block), first):
                    ids.append(own + end)
                    doc_ids.append(numbers[i])
                    size += len(ids[-1])
                    if size >= SEGMENT * ID.itemsize:
                        yield segment(part, seq, ids, doc_ids)
                        seq, size, ids, doc_ids = seq + 1, 0, [], []
        if ids:
            yield segment(part, seq, ids, doc_ids)

    rows.mapInPandas(run, SCHEMA).write.parquet(path)


def read_documents(spark, path: str) -> DataFrame:
    """Per document of the segments at ``path``: doc_id, start, n_tokens, ids_crc32."""
    bounded_batches(spark)
    files = spark.read.schema(SCHEMA).parquet(path)
    # segments are many, ranges few: the running sum over ranges is one small window
    parts = files.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    starts = files.select("part", "seq", F.coalesce(F.sum("n_ids").over(within), F.lit(0)).alias("own"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for s in b.itertuples():
                codes, ends = Codes(s.chunks, s.more, s.ranks), np.asarray(s.ends)
                heads = np.concatenate([[0], ends[:-1]])
                # every document is asked for, so the segment is read as one span
                ids = memoryview(codes.span(0, int(ends[-1])).astype(ID)).cast("B")
                cuts = (np.concatenate([[0], ends]) * ID.itemsize).tolist()
                crc = [zlib.crc32(ids[h:e]) for h, e in zip(cuts[:-1], cuts[1:], strict=True)]
                doc_ids = pd.arrays.IntegerArray(np.array(s.doc_ids, dtype=np.int64), np.array(s.none, dtype=bool))
                yield pd.DataFrame(
                    {"doc_id": doc_ids, "part": s.part, "seq": s.seq, "at": heads, "n_tokens": ends - heads, "ids_crc32": crc}
                )

    docs = files.mapInPandas(run, "doc_id long, part int, seq int, at long, n_tokens long, ids_crc32 long")
    place = starts.join(parts, "part").select("part", "seq", (F.col("own") + F.col("base")).alias("place"))
    return docs.join(place, ["part", "seq"]).select(
        "doc_id", (F.col("place") + F.col("at")).alias("start"), "n_tokens", "ids_crc32"
    )


def round_trip(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """Writes the tokens of ``docs`` to the shared folder and reads them back, one row per row of docs.

    A null text has only the end id. Repeated rows each appear; rows with one doc_id follow each
    other by text hash; null doc_ids come first. Other columns are ignored; no rows give no rows.
    """
    path = shared_dir(docs.sparkSession, "tokens")
    write_tokens(docs, path, tokenizer, end_id)
    return read_documents(docs.sparkSession, path)
