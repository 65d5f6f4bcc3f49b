"""Which needles occur in which texts, as an equi-join on character grams."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BROADCAST_BYTES = 16 << 20
GRAM_SIZES = [8, 3, 2, 1]  # the longest that fits a needle is used


def _gram_size(needle: Column) -> Column:
    n = F.length(needle)
    out = F.lit(1)
    for size in sorted(GRAM_SIZES):
        out = F.when(n >= size, size).otherwise(out)
    return out


def _grams(text: Column, size: int) -> Column:
    """Distinct character grams; a lookahead finds the overlapping ones in one pass."""
    pattern = rf"(?s)(?!\p{{Cs}})(?=(.{{{size}}}))"
    return F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), 1))


def _found_grams(spark: SparkSession, grams: list[str]):
    """A function from texts to those of the grams that occur in them, in one scan for all grams.

    At most ``max(GRAM_SIZES)`` states of the automaton stand for one gram, however long its needle.
    """
    shared = spark.sparkContext.broadcast(grams)

    @F.pandas_udf("array<string>")
    def scan(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for g in shared.value:
            automaton.add_word(g, g)
        automaton.make_automaton()
        for texts in batches:
            yield pd.Series([None if t is None else list({g for _, g in automaton.iter(t)}) for t in texts], dtype=object)

    return scan


def find_substrings(
    needles: DataFrame, texts: DataFrame, id_cols: list[str], broadcast_bytes: int = BROADCAST_BYTES
) -> DataFrame:
    """Pairs where ``needles.needle`` occurs in ``texts.haystack``.

    A needle is looked up by one of its grams, so only texts with that gram are compared.
    Needles whose total size is within the bound travel to the texts, which are scanned once and
    give a row only for a gram that some needle is looked up by; otherwise only (gram, id) pairs
    are shuffled and the matching texts are joined by id afterwards.
    """
    sized = needles.where(F.col("needle") != "").withColumn("_size", _gram_size(F.col("needle")))
    stats = sized.groupBy("_size").agg(F.sum(F.octet_length("needle") + 64).alias("b")).collect()
    if not stats:
        return needles.limit(0).join(texts.limit(0).withColumn("needle", F.lit("")), "needle")
    # the gram with the largest hash: as good as random, and the same on every run
    keyed = []
    for row in stats:
        size = row["_size"]
        picked = F.array_max(
            F.transform(_grams(F.col("needle"), size), lambda g: F.struct(F.xxhash64(g).alias("h"), g.alias("g")))
        )
        keyed.append(sized.where(F.col("_size") == size).withColumn("_gram", picked["g"]))
    keys = reduce(DataFrame.unionByName, keyed).drop("_size")
    if sum(r["b"] for r in stats) <= broadcast_bytes:
        scan = _found_grams(texts.sparkSession, [r[0] for r in keys.select("_gram").distinct().collect()])
        exploded = texts.select("*", F.explode(scan("haystack")).alias("_gram"))
        found = exploded.join(F.broadcast(keys), "_gram")
    else:
        grams = F.concat(*[_grams(F.col("haystack"), r["_size"]) for r in stats])
        exploded = texts.select(*id_cols, F.explode(grams).alias("_gram"))
        found = exploded.join(keys, "_gram").join(texts, id_cols)
    return found.where(F.contains("haystack", "needle")).drop("_gram")
