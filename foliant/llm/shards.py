"""Sharding by a weighted hash tree of regions, racks and shards, in DataFrame operations only.

A row descends the tree: at each level every child draws ``-ln(u) / weight`` with ``u`` hashed
from the doc_id and the child's name, and the smallest draw wins, so children are taken in
proportion to their weights. When a child's weight grows, only its own draw shrinks: rows move
into that child and between no others. A shard that joins as a region of its own therefore takes
rows only into itself.

Slots number a shard's rows by doc_id. Rows are range-partitioned once; a row's slot is its rank
within (shard, range) plus the rows of the shard in earlier ranges, so no shard is sorted in one
task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ordered import lookup
from ..session import materialise
from .common import whole

# name -> weight of a shard, or name -> subtree
Tree = dict[str, "float | Tree"]
BASE = 8


def default_tree(shards: int) -> Tree:
    """Eight shards in two regions of two racks of two; each further shard is a region of its own."""
    if shards < BASE:
        return {f"r{s}": {"k0": {str(s): 1.0}} for s in range(shards)}
    tree: Tree = {
        f"r{r}": {f"k{k}": {str(4 * r + 2 * k + s): 1.0 for s in range(2)} for k in range(2)}
        for r in range(2)
    }
    return tree | {f"r{s}": {"k0": {str(s): 1.0}} for s in range(BASE, shards)}


def weight(node: float | Tree) -> float:
    return sum(map(weight, node.values())) if isinstance(node, dict) else float(node)


def draw(key: Column, path: str, share: float) -> Column:
    """A child's draw: exponential with rate ``share``, fixed by the key and the child's path."""
    digits = F.substring(F.md5(F.concat_ws(":", key, F.lit(path))), 1, 13)
    u = (F.conv(digits, 16, 10).cast("double") + 1) / float(2**52)
    return -F.log(u) / share


def descend(key: Column, tree: Tree, path: str = "") -> Column:
    """The shard (as a number) that the key reaches."""
    live = [(name, child) for name, child in tree.items() if weight(child) > 0]
    below = [
        descend(key, child, f"{path}/{name}") if isinstance(child, dict) else F.lit(int(name))
        for name, child in live
    ]
    if len(live) == 1:
        return below[0]
    draws = F.array(*[draw(key, f"{path}/{name}", weight(child)) for name, child in live])
    best = F.array_position(draws, F.array_min(draws))
    return reduce(lambda out, i: out.when(best == i + 1, below[i]), range(1, len(live)), F.when(best == 1, below[0]))


def shard(docs: DataFrame, tree: Tree, grown: Tree) -> DataFrame:
    """Per row of ``docs`` (doc_id, text) its shard in both trees and its slot in the first.

    Columns doc_id, size (UTF-8 bytes plus one), text_crc32, law, shard, slot, grown_shard. The
    doc_id alone decides the shard; a null doc_id is hashed as the empty string and sorts first.
    Slots are gapless from 0 in every shard, by doc_id, then text checksum and size; among rows
    that are equal in all three the order is arbitrary. A null text has size 1 and checksum 0.
    Other columns are ignored; no rows give no rows.
    """
    text, key = whole(F.col("text")), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    rows = docs.select(
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        descend(key, tree).alias("shard"),
        descend(key, grown).alias("grown_shard"),
    )
    # both written: range bounds come from a sample, and counts and ranks must see the same ranges
    order = ["doc_id", "text_crc32", "size"]
    ranged = materialise(rows, "sharded").repartitionByRange(*order)
    ranged = materialise(ranged.withColumn("range", F.spark_partition_id()), "ranges")
    counts = ranged.groupBy("shard", "range").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("shard", "range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    rank = F.row_number().over(Window.partitionBy("shard", "range").orderBy(*order))
    return lookup(ranged.withColumn("rank", rank), counts, ["shard", "range"], "inner").select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("key").alias("law"),
        "shard",
        (F.col("before") + F.col("rank") - 1).cast("long").alias("slot"),
        "grown_shard",
    )
