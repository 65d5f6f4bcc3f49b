"""Structure-aware chunking: blocks, sentence packing, character splitting.

Splitting text into blocks, sentences and words and putting chunks together are Spark
expressions. Only the choice of chunk borders is sequential; it runs in Arrow batches over
arrays of token counts, so no text travels to Python for it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions import text as X

CHUNK_SIZE, OVERLAP = 320, 50
LIST_SLACK = 1.5
SPLIT_CHARS = 1 << 20  # pieces that a worker holds before it hands them on

# line starts and whole blocks; possessive loops keep long blocks off the regex stack
_TABLE = rf"[{X.WS_SET}&&[^\n]]*+\|"
_FENCE = rf"[{X.WS_SET}&&[^\n]]*+```"
_ITEM = rf"[{X.WS_SET}&&[^\n]]*+(?:[-*•]|\d++\.)[{X.WS_SET}&&[^\n]]"
BLOCKS = (
    rf"(?<![^\n])(?:"
    rf"{_TABLE}[^\n]*+(?:\n[^\n|]*+\|[^\n]*+)*+"
    rf"|{_FENCE}[^\n]*+(?:\n(?!{_FENCE})[^\n]*+)*+(?:\n{_FENCE}[^\n]*+)?+"
    rf"|{_ITEM}[^\n]*+(?:\n(?:[{X.WS_SET}&&[^\n]]*+\n)?+{_ITEM}[^\n]*+)*+"
    rf"|[^\n]*+(?:\n(?!{_TABLE}|{_FENCE}|{_ITEM})[^\n]*+)*+"
    rf")(?![^\n])"
)


def blocks(text: Column) -> Column:
    """Array of (type, content): tables, fenced code, lists and the text between them."""
    raw = F.regexp_extract_all(text, F.lit(f"({BLOCKS})"), 1)

    def typed(b: Column) -> Column:
        kind = (
            F.when(b.rlike(f"^{_TABLE}"), "table")
            .when(b.rlike(f"^{_FENCE}"), "code")
            .when(b.rlike(f"^{_ITEM}"), "list")
            .otherwise("text")
        )
        return F.struct(
            kind.alias("type"), F.when(kind == "text", X.strip(b)).otherwise(b).alias("content")
        )

    return F.filter(F.transform(raw, typed), lambda b: b["content"] != "")


def segment_blocks(docs: DataFrame) -> DataFrame:
    """One row per block: (doc_id, block, type, content)."""
    return docs.select("doc_id", F.posexplode(blocks(F.col("text"))).alias("block", "b")).select(
        "doc_id", "block", "b.type", "b.content"
    )


def chunk_borders(counts: list[int], size: int, overlap: int) -> list[tuple[int, int]]:
    """Sentence ranges [from, to) of the chunks of one text, given its sentences' token counts.

    A sentence over ``size`` is a range of its own. Otherwise sentences are added until the
    next one does not fit; the following chunk starts with the last sentences whose tokens sum
    to at most ``overlap``.
    """
    out, start, held = [], 0, 0
    for i, n in enumerate(counts):
        if n > size:
            if start < i:
                out.append((start, i))
            out.append((i, i + 1))
            start, held = i + 1, 0
            continue
        if held + n > size and start < i:
            out.append((start, i))
            carry, kept = i, 0
            while carry > start and kept + counts[carry - 1] <= overlap:
                carry -= 1
                kept += counts[carry]
            start, held = carry, kept
        held += n
    if start < len(counts):
        out.append((start, len(counts)))
    return out


def _borders_udf(size: int, overlap: int):
    @F.pandas_udf("array<struct<a:int,b:int>>")
    def borders(counts: pd.Series) -> pd.Series:
        return counts.map(
            lambda c: [{"a": a, "b": b} for a, b in chunk_borders(list(c), size, overlap)]
        )

    return borders


def pack_sentences(
    texts: DataFrame, keys: list[str], column: str = "text", size: int = CHUNK_SIZE, overlap: int = OVERLAP
) -> DataFrame:
    """(keys…, text) to (keys…, piece, text): chunks of whole sentences, in order.

    A chunk may reach ``size + overlap`` tokens, as the carried sentences are not counted
    against the sentence that starts the new chunk.
    """
    if not 0 <= overlap < size:
        raise ValueError("need 0 <= overlap < size")
    s = texts.select(*keys, X.split_sentences(F.col(column)).alias("s"))
    counted = s.select("*", F.transform("s", X.count_tokens).alias("n"))
    bordered = counted.select("*", _borders_udf(size, overlap)("n").alias("borders"))

    def pieces(r: Column) -> Column:
        sentence = F.col("s")[r["a"]]
        return F.when(
            F.col("n")[r["a"]] > size, X.word_windows(sentence, size, overlap)
        ).otherwise(F.array(F.array_join(F.slice("s", r["a"] + 1, r["b"] - r["a"]), " ")))

    whole = F.flatten(F.transform("borders", pieces))
    return bordered.select(*keys, F.posexplode(whole).alias("piece", "text"))


def chunk_documents(docs: DataFrame, size: int = CHUNK_SIZE, overlap: int = OVERLAP) -> DataFrame:
    """(doc_id, text) to chunks: tables and code whole, lists whole up to 1.5 x size, text packed.

    Everything, the numbering included, happens within a document's own row: no shuffle.
    """
    if not 0 <= overlap < size:
        raise ValueError("need 0 <= overlap < size")
    b = docs.select("doc_id", blocks(F.col("text")).alias("blocks"))
    whole = lambda x: (x["type"].isin("table", "code")) | (
        (x["type"] == "list") & (X.count_tokens(x["content"]) <= size * LIST_SLACK)
    )
    parts = b.select(
        "doc_id",
        F.transform(
            "blocks",
            lambda x: F.struct(
                x["type"].alias("type"),
                F.when(whole(x), F.array(x["content"]))
                .otherwise(X.split_sentences(x["content"])).alias("s"),
                whole(x).alias("whole"),
            ),
        ).alias("parts"),
    )
    counted = parts.select(
        "doc_id",
        "parts",
        F.transform(
            "parts",
            lambda p: F.when(p["whole"], F.array(F.lit(0))).otherwise(
                F.transform(p["s"], X.count_tokens)
            ),
        ).alias("counts"),
    )

    @F.pandas_udf("array<array<struct<a:int,b:int>>>")
    def borders(counts: pd.Series) -> pd.Series:
        return counts.map(
            lambda doc: [
                [{"a": a, "b": e} for a, e in chunk_borders(list(c), size, overlap)] for c in doc
            ]
        )

    def pieces(p: Column, ranges: Column) -> Column:
        def piece(r: Column) -> Column:
            sentence = p["s"][r["a"]]
            texts = F.when(
                ~p["whole"] & (X.count_tokens(sentence) > size),
                X.word_windows(sentence, size, overlap),
            ).otherwise(F.array(F.array_join(F.slice(p["s"], r["a"] + 1, r["b"] - r["a"]), " ")))
            return F.transform(
                texts, lambda t: F.struct(p["type"].alias("structure_type"), t.alias("text"))
            )

        return F.flatten(F.transform(ranges, piece))

    chunks = (
        counted.select("doc_id", "parts", borders("counts").alias("borders"))
        .select(
            "doc_id",
            F.posexplode(F.flatten(F.zip_with("parts", "borders", pieces))).alias("position", "c"),
        )
        .select("doc_id", "position", "c.structure_type", "c.text")
    )
    kind = F.col("structure_type")
    return chunks.select(
        F.concat(F.col("doc_id").cast("string"), F.lit("_chunk_"), "position").alias("chunk_id"),
        "doc_id", "position", "structure_type", "text",
        X.count_tokens(F.col("text")).alias("tokens"),
        F.when(kind == "text", F.size(X.split_sentences(F.col("text")))).alias("sentence_count"),
        (kind == "table").alias("has_table"),
        (kind == "list").alias("has_list"),
        (kind == "code").alias("has_code"),
    )


def split_recursively(
    text: str, size: int, overlap: int, separators: tuple[str, ...] = ("\n\n", "\n", " ", "")
) -> list[str]:
    """Pieces of at most ``size`` characters, cut at the coarsest separator that works."""
    at = next(i for i, s in enumerate(separators) if s == "" or s in text)
    sep, finer = separators[at], separators[at + 1 :]
    out: list[str] = []
    fitting: list[str] = []
    # a separator stays at the head of the part it introduces
    for part in [p for p in (re.split(f"(?={re.escape(sep)})", text) if sep else text) if p]:
        if len(part) < size:
            fitting.append(part)
            continue
        out += _merge(fitting, size, overlap)
        fitting = []
        out += split_recursively(part, size, overlap, finer) if finer else [part]
    return out + _merge(fitting, size, overlap)


def _merge(parts: list[str], size: int, overlap: int) -> list[str]:
    """Joins neighbouring parts up to ``size``, repeating up to ``overlap`` characters."""
    out, first, total = [], 0, 0
    for i, part in enumerate(parts):
        if first < i and total + len(part) > size:
            out.append("".join(parts[first:i]).strip())
            while first < i and (total > overlap or total + len(part) > size):
                total -= len(parts[first])
                first += 1
        total += len(part)
    if first < len(parts):
        out.append("".join(parts[first:]).strip())
    return [t for t in out if t]


def recursive_char_split(docs: DataFrame, size: int = 500, overlap: int = 50) -> DataFrame:
    """(doc_id, text) to (doc_id, piece, text) by characters."""
    if not 0 <= overlap < size:
        raise ValueError("need 0 <= overlap < size")

    schema = T.StructType([docs.schema["doc_id"], T.StructField("piece", T.IntegerType(), False), T.StructField("text", T.StringType())])
    out = to_arrow_schema(schema)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            rows, numbers, pieces, held = [], [], [], 0
            for i in range(len(texts)):
                found = split_recursively(texts[i].as_py() or "", size, overlap)
                rows += [i] * len(found)
                numbers += range(len(found))
                pieces += found
                held += sum(map(len, found))
                # the pieces of few documents at once, whatever the batch holds
                if held >= SPLIT_CHARS or (i + 1 == len(texts) and rows):
                    own = ids.take(pa.array(rows)).cast(out.field(0).type)
                    yield pa.RecordBatch.from_arrays([own, pa.array(numbers, pa.int32()), pa.array(pieces, out.field(2).type)], schema=out)
                    rows, numbers, pieces, held = [], [], [], 0

    return docs.select("doc_id", "text").mapInArrow(split, schema)


SCOPE_FIELDS = ["documentTitle", "courseId", "chatId", "docType"]


def chunk_metadata(chunks: DataFrame) -> DataFrame:
    """Adds ``metadata``: required fields, known optional ones, then the document's other fields.

    Input has the chunk columns and ``doc_metadata MAP<STRING,STRING>``; the chunk's own fields
    win over equally named document fields.
    """
    given = F.coalesce(F.col("doc_metadata"), F.create_map().cast("map<string,string>"))

    def entry(name: str, value: Column) -> Column:
        return F.struct(F.lit(name).alias("k"), value.cast("string").alias("v"))

    own = F.filter(
        F.array(
            entry("doc_id", F.col("doc_id")),
            entry("filename", F.coalesce(given["filename"], F.lit("unknown"))),
            entry("position", F.col("position")),
            entry("tokens", F.col("tokens")),
            entry("chunk_type", F.coalesce(given["chunk_type"], F.lit("generic"))),
            entry("page", given["page"]),
            entry("heading", given["heading"]),
            entry("sentence_count", F.nullif("sentence_count", F.lit(0))),
            entry("has_table", F.col("has_table")),
            entry("has_list", F.col("has_list")),
            entry("has_code", F.col("has_code")),
        ),
        lambda e: e["v"].isNotNull(),
    )
    first = F.map_from_entries(own)
    rest = F.map_filter(given, lambda k, v: v.isNotNull() & ~F.map_contains_key(first, k))
    return chunks.withColumn(
        "metadata",
        F.map_concat(
            first, rest, F.create_map(F.lit("structure_type"), F.col("structure_type"))
        ),
    )
