"""A Merkle manifest of a data set: one tree per group, one tree over the groups' roots.

Leaves of a group stand in a fixed order and have gapless positions. ``FAN`` consecutive nodes
become one until a single node is left. A block of ``FAN ** DEPTH`` consecutive leaves climbs
``DEPTH`` levels inside one window, sorted once: on level k the nodes are the rows whose position
divides by ``FAN ** k``, their siblings are lag and lead columns at that fixed offset, masked by
the slot in the run (and empty past the end of the group), and the first child's row hashes the
parent. Only the rows that head a block go on to the next tier, so each tier shuffles a
``FAN ** DEPTH`` th of the rows before it, no window holds more than one block, and a group with
a third of all rows is as many blocks as it needs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ordered import lookup
from ..session import materialise

FAN = 3
DEPTH = 6
BLOCK = FAN**DEPTH
SIBLINGS = "struct<left:string,right:string>"


def counted(value: Column) -> Column:
    """A value as its UTF-8 size, a colon and its text; null as a dash."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_hash(*values: Column) -> Column:
    """Hexadecimal SHA-256 of the counted values."""
    return F.sha2(F.concat(*[counted(v) for v in values]), 256)


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf gives with the siblings of its path, level by level."""
    return F.aggregate(path, leaf, lambda h, s: F.sha2(F.concat(s["left"], h, s["right"]), 256))


def proof_hash(path: Column) -> Column:
    """SHA-256 of all siblings of a path, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), ""), 256)


def numbered(nodes: DataFrame, order: list[str]) -> DataFrame:
    """Adds ``pos``, the place of each row within its ``group`` from 0, and ``n``, the group's rows.

    Rows are dealt by ranges, so a large group spans many tasks; a last tie column lets even
    identical rows be split. Only one count per group and range is ordered.
    """
    keys = ["group", *order, "_tie"]
    rows = nodes.withColumn("_tie", F.monotonically_increasing_id())
    rows = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("_tie")
    rows = materialise(rows.withColumn("_at", F.monotonically_increasing_id()), "leaves")
    rows = rows.withColumn("_range", F.shiftright("_at", 33))
    runs = rows.groupBy("group", "_range").agg(F.count(F.lit(1)).alias("c"), F.min("_at").alias("first"))
    whole = Window.partitionBy("group")
    before = whole.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select(
        "group",
        "_range",
        (F.coalesce(F.sum("c").over(before), F.lit(0)) - F.col("first")).alias("_shift"),
        F.sum("c").over(whole).alias("n"),
    )
    rows = lookup(rows, runs, ["group", "_range"], "inner")
    return rows.withColumn("pos", F.col("_at") + F.col("_shift")).drop("_at", "_range", "_shift")


def climbed(nodes: DataFrame) -> DataFrame:
    """Rows of (group, pos, n, h, ...) with ``block``, ``path`` within it, and ``top``, its node.

    A group that is down to one node inside the block keeps it up to the top.
    """
    pos, n = F.col("pos"), F.col("n")
    rows = nodes.withColumn("block", F.expr(f"pos div {BLOCK}")).withColumn("_h0", F.col("h"))
    w = Window.partitionBy("group", "block").orderBy("pos")
    for k in range(DEPTH):
        step = FAN**k
        own, slot, goes_on = F.col(f"_h{k}"), F.expr(f"(pos div {step}) % {FAN}"), n > step
        lags = [F.lag(own, i * step).over(w).alias(f"_back{i}") for i in range(1, FAN)]
        leads = [F.lead(own, i * step).over(w).alias(f"_next{i}") for i in range(1, FAN)]
        rows = rows.select("*", *lags, *leads)

        def among(name: str, i: int, there: Column) -> Column:
            return F.when(there, F.coalesce(F.col(f"{name}{i}"), F.lit(""))).otherwise("")

        left = F.concat(*[among("_back", i, slot >= i) for i in range(FAN - 1, 0, -1)])
        right = F.concat(*[among("_next", i, slot + i < FAN) for i in range(1, FAN)])
        node, head = pos % step == 0, pos % (step * FAN) == 0
        parent = F.when(goes_on, F.sha2(F.concat(own, right), 256)).otherwise(own)
        siblings = F.when(node & goes_on, F.struct(left.alias("left"), right.alias("right")))
        rows = rows.withColumns({f"_s{k}": siblings, f"_h{k + 1}": F.when(head, parent)})
        rows = rows.drop(*[f"_back{i}" for i in range(1, FAN)], *[f"_next{i}" for i in range(1, FAN)])
    # the nearest node row at or above a row is its ancestor's
    so_far = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.select(
        *nodes.columns,
        "block",
        *[F.last(f"_s{k}", ignorenulls=True).over(so_far).alias(f"_s{k}") for k in range(DEPTH)],
        F.last(f"_h{DEPTH}", ignorenulls=True).over(so_far).alias("top"),
    )
    path = F.filter(F.array(*[F.col(f"_s{k}") for k in range(DEPTH)]), lambda s: s.isNotNull())
    return rows.withColumn("path", path).drop(*[f"_s{k}" for k in range(DEPTH)])


def trees(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of (group, pos, n, h, ...) with ``path`` and ``root``; and (group, root) per group."""
    own = climbed(nodes)
    tops = own.where(F.col("pos") % BLOCK == 0).select(
        "group", F.col("block").alias("pos"), F.expr(f"(n + {BLOCK - 1}) div {BLOCK}").alias("n"), F.col("top").alias("h")
    )
    tops = materialise(tops, "blocks")
    roots = tops.where("n = 1").select("group", F.col("h").alias("root"))
    rows, left = own.withColumnRenamed("top", "root"), tops.where("n > 1")
    if left.limit(1).count():
        above, more = trees(left)
        above = above.select("group", F.col("pos").alias("block"), F.col("path").alias("_path"), F.col("root").alias("_root"))
        rows = rows.join(above, ["group", "block"], "left")
        none = F.array().cast(f"array<{SIBLINGS}>")
        rows = rows.withColumn("path", F.concat("path", F.coalesce("_path", none)))
        rows = rows.withColumn("root", F.coalesce("_root", "root")).drop("_path", "_root")
        roots = roots.union(more)
    return rows.drop("block"), roots


def group_key(value: Column) -> Column:
    """A text that is never null and sorts like the value's UTF-8 bytes, null first."""
    return F.coalesce(F.concat(F.lit("1"), value.cast("string")), F.lit("0"))


def manifest(docs: DataFrame, changed: Column | None = None) -> DataFrame:
    """Leaf, path and roots of every row of ``docs`` (doc_id, source, lang, n_chars, text).

    Columns doc_id, leaf, changed_leaf (of the text ``changed`` instead, the same without it),
    subroot (of the row's source), root (of all) and path, an array of the siblings to the left
    and right on every level from the leaf to the root. Within a source leaves ascend by doc_id
    (null first), rows with one doc_id by their leaf; repeated rows are leaves of their own. A
    null source is a group like any other. A level on which a node is alone in its run has empty
    siblings and hashes that node; a single leaf is its own root with an empty path. Other
    columns are ignored; no rows give no rows.
    """
    fields = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    text = F.col("text")
    leaves = docs.select(
        "doc_id",
        group_key(F.col("source")).alias("group"),
        leaf_hash(*fields, text).alias("h"),
        leaf_hash(*fields, text if changed is None else changed).alias("changed_leaf"),
    )
    rows, roots = trees(numbered(leaves, ["doc_id", "h"]))
    # the groups' roots are the leaves of the upper tree
    upper = roots.select(F.lit("").alias("group"), F.col("group").alias("source"), F.col("root").alias("h"))
    upper, _ = trees(numbered(upper, ["source"]))
    upper = upper.select(
        F.col("source").alias("group"), F.col("h").alias("subroot"), F.col("path").alias("_path"), F.col("root").alias("_root")
    )
    upper = materialise(upper, "groups")
    return lookup(rows, upper, ["group"], "inner").select(
        "doc_id",
        F.col("h").alias("leaf"),
        "changed_leaf",
        "subroot",
        F.col("_root").alias("root"),
        F.concat("path", "_path").alias("path"),
    )


def verify(rows: DataFrame) -> DataFrame:
    """Rows of ``manifest`` with ``proof_sha256``, ``folded_root`` (of the changed leaf) and ``verified``."""
    rows = rows.withColumn("proof_sha256", proof_hash(F.col("path")))
    rows = rows.withColumn("folded_root", fold(F.col("changed_leaf"), F.col("path")))
    return rows.withColumn("verified", F.col("folded_root") == F.col("root"))
