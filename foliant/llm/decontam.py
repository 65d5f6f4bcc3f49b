"""Benchmark decontamination by winnowed word k-grams, in DataFrame operations only.

Of every ``w`` consecutive k-grams of a text the one with the smallest hash is kept. Two texts
that share ``k + w - 1`` consecutive words share all ``w`` k-grams of that span, hence its
minimum: with k = 5 and w = 6 every shared span of ten words is found. Items of fewer words get a
second, denser selection sized by the shortest of them. Documents with a fingerprint of some item
are candidates; there the hits are extended: every window of the items is looked up at every word
position and compared as text, so no hash decides a result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ordered import lookup
from ..session import materialise
from .common import bind, keyed, lower_ascii, row_key, whole

# fixed values: characters that end a word, words of a window
BREAKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW = 10
GRAM = 5


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(lower_ascii(whole(text)), BREAKS, -1), "")


def gram_hashes(words: Column, k: int) -> Column:
    """The hash of every run of ``k`` words."""

    def one(i: Column) -> Column:
        return F.xxhash64(*[F.get(words, i + j) for j in range(k)])

    return F.when(
        F.size(words) >= k, F.transform(F.sequence(F.lit(0), F.size(words) - k), one)
    ).otherwise(F.array().cast("array<bigint>"))


def sliding_least(values: Column, width: int) -> Column:
    """The least of every ``width`` consecutive values, by joining ever longer overlapping windows."""
    out, done = values, 1
    while done < width:
        step = min(done, width - done)

        def pair(a: Column, step: int = step) -> Column:
            left = F.slice(a, F.lit(1), F.greatest(F.size(a) - step, F.lit(0)))
            right = F.slice(a, F.lit(1 + step), F.greatest(F.size(a) - step, F.lit(0)))
            return F.zip_with(left, right, lambda x, y: F.least(x, y))

        out, done = bind(out, pair), done + step
    return out


def winnowed(words: Column, spans: list[int]) -> Column:
    """Distinct fingerprints that contain one of every shared run of ``n`` words, for each n in spans."""
    sets = []
    for n in spans:
        k = min(GRAM, n)
        sets.append(sliding_least(gram_hashes(words, k), n - k + 1))
    return F.array_distinct(F.concat(*sets) if len(sets) > 1 else sets[0])


def item_windows(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """``item_id``, ``len`` and ``win``: the distinct windows of every item, as space-joined words."""

    def cut(w: Column) -> Column:
        n = F.least(F.size(w), F.lit(window))
        return F.when(
            n > 0,
            F.transform(
                F.sequence(F.lit(0), F.size(w) - n),
                lambda i: F.struct(n.alias("len"), F.array_join(F.slice(w, i + 1, n), " ").alias("win")),
            ),
        )

    cells = F.explode(F.array_distinct(bind(words_of(F.col("text")), cut)))
    return items.select("item_id", cells.alias("c")).select("item_id", "c.len", "c.win").distinct()


def find_contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): which words lie in a window of ``items`` (item_id, text).

    Columns doc_id, n_words, n_hit, n_items, items_sha256, contaminated. A word is hit if any
    occurrence of any window covers it; overlaps count once. Items with equal windows all count;
    an item without words has no window, an item without item_id hits words but is not listed.
    Null texts have no words. Repeated rows each get their row. Other columns are ignored; empty
    inputs give no hits or no rows.
    """
    windows = materialise(item_windows(items, window), "item-windows")
    lengths = sorted(r.len for r in windows.select("len").distinct().collect())  # window values at most
    counted = docs.select("doc_id", *row_key(), F.size(words_of(F.col("text"))).cast("long").alias("n_words"))
    found = _found(docs, windows, lengths, window) if lengths else None
    if found is None:
        found = docs.sparkSession.createDataFrame(
            [], "_id string, _hash long, n_hit long, n_items long, ids string"
        )
    out = counted.join(materialise(found, "contaminated"), ["_id", "_hash"], "left")
    return out.select(
        "doc_id",
        "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
        F.sha2(F.coalesce("ids", F.lit("")), 256).alias("items_sha256"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
    )


def _found(docs: DataFrame, windows: DataFrame, lengths: list[int], window: int) -> DataFrame:
    spans = [window] if window in lengths else []
    if lengths[0] < window:
        spans.append(lengths[0])
    words = words_of(F.col("text"))
    prints = docs.select(*row_key(), F.explode(bind(words, lambda w: winnowed(w, spans))).alias("h"))
    # an item's fingerprints: those of its windows, which are all its own
    known = windows.select(
        F.explode(bind(F.split("win", " "), lambda w: winnowed(w, spans))).alias("h")
    ).distinct()
    docs_hit = lookup(prints, known, ["h"], "left_semi").select("_id", "_hash").distinct()
    docs_hit = materialise(docs_hit, "candidates")

    def cut(w: Column) -> Column:
        def at(n: int) -> Column:
            return F.when(
                F.size(w) >= n,
                F.transform(
                    F.sequence(F.lit(0), F.size(w) - n),
                    lambda i: F.struct(
                        i.alias("pos"),
                        F.lit(n).alias("len"),
                        F.array_join(F.slice(w, i + 1, F.lit(n)), " ").alias("win"),
                    ),
                ),
            ).otherwise(F.array().cast("array<struct<pos:int,len:int,win:string>>"))

        return F.concat(*[at(n) for n in lengths]) if len(lengths) > 1 else at(lengths[0])

    rows = docs.select("text", *row_key()).join(docs_hit, ["_id", "_hash"], "left_semi")
    rows = rows.select("_id", "_hash", F.explode(bind(words, cut)).alias("c"))
    rows = rows.select("_id", "_hash", "c.pos", "c.len", "c.win")
    hits = lookup(rows, windows.select("len", "win").distinct(), ["len", "win"], "left_semi").distinct()
    hits = materialise(hits, "hits")
    # running end of all earlier hits: only what lies beyond it is newly covered
    before = Window.partitionBy("_id", "_hash").orderBy("pos", "len").rowsBetween(Window.unboundedPreceding, -1)
    end = F.col("pos") + F.col("len")
    fresh = end - F.greatest(F.col("pos"), F.coalesce(F.max(end).over(before), F.lit(0)))
    covered = (
        hits.select("_id", "_hash", "pos", "len")
        .distinct()
        .select("_id", "_hash", F.greatest(fresh, F.lit(0)).alias("fresh"))
        .groupBy("_id", "_hash")
        .agg(F.sum("fresh").alias("n_hit"))
    )
    # all items of a window set are listed per document: bounded by the items, not by the documents
    of_items = (
        _items_of(hits.select("_id", "_hash", "len", "win").distinct(), windows)
        .groupBy("_id", "_hash")
        .agg(F.sort_array(F.collect_set(F.col("item_id").cast("string"))).alias("ids"))
        .select("_id", "_hash", F.size("ids").alias("n_items"), F.array_join("ids", ",").alias("ids"))
    )
    return covered.join(of_items, ["_id", "_hash"], "left")


def _items_of(hits: DataFrame, windows: DataFrame) -> DataFrame:
    return hits.join(windows, ["len", "win"]).select("_id", "_hash", "item_id").distinct()


def clean(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of ``docs`` in which no benchmark window occurs, with all their columns."""
    windows = materialise(item_windows(items, window), "item-windows")
    lengths = sorted(r.len for r in windows.select("len").distinct().collect())
    if not lengths:
        return docs
    bad = materialise(_found(docs, windows, lengths, window).select("_id", "_hash"), "contaminated")
    rows, key, own_id, own_hash = keyed(docs)
    return rows.join(bad, (own_id == bad["_id"]) & (own_hash == bad["_hash"]), "left_anti").drop(key)
