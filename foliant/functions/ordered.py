"""Ordered and keyed work that stays balanced when one key holds a large share of the rows.

* ``top_n`` prunes before the shuffle (partial group limit), so a hot key reaches the final
  task with at most ``n`` rows per map task.
* ``row_positions`` / ``running_total`` number or sum a key's rows block by block: only one
  small row per block is ordered per key, the rows themselves are windowed per (key, block).
* ``lookup`` joins a big table to one row per key and lets AQE split skewed partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Spark plans a partial group limit up to this rank (spark.sql.optimizer.windowGroupLimitThreshold)
GROUP_LIMIT = 1000
SALTS = 64
BLOCK = 1 << 16


def top_n(df: DataFrame, keys: list[str], order: list[Column], n: int, rank: str = "rank") -> DataFrame:
    """The first ``n`` rows of every key, with their 1-based rank."""
    if n > GROUP_LIMIT:
        salt = F.pmod(F.xxhash64(*[F.col(c) for c in df.columns if c not in keys]), F.lit(SALTS))
        part = Window.partitionBy(*keys, "_salt").orderBy(*order)
        df = (
            df.withColumn("_salt", salt)
            .withColumn("_local", F.row_number().over(part))
            .where(F.col("_local") <= n)
            .drop("_salt", "_local")
        )
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= n)


def _blocks(df: DataFrame, keys: list[str], pos: str, value: Column, block: int) -> DataFrame:
    """Per (key, block): how much lies before the block and in the key as a whole."""
    sums = df.groupBy(*keys, F.floor(F.col(pos) / block).alias("_block")).agg(
        F.sum(value).alias("_in_block")
    )
    whole = Window.partitionBy(*keys)
    before = whole.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    return sums.select(
        *keys,
        "_block",
        F.coalesce(F.sum("_in_block").over(before), F.lit(0)).alias("_before"),
        F.sum("_in_block").over(whole).alias("_total"),
    )


def row_positions(
    df: DataFrame, keys: list[str], pos: str, tie: list[str] = (), block: int = BLOCK
) -> DataFrame:
    """Adds ``position`` (1-based, ascending by the integer column ``pos``) and ``total`` per key."""
    blocks = _blocks(df, keys, pos, F.lit(1), block)
    w = Window.partitionBy(*keys, "_block").orderBy(pos, *tie)
    return (
        df.withColumn("_block", F.floor(F.col(pos) / block))
        .join(blocks, [*keys, "_block"])
        .withColumn("position", F.col("_before") + F.row_number().over(w))
        .withColumnRenamed("_total", "total")
        .drop("_block", "_before")
    )


def running_total(
    df: DataFrame, keys: list[str], pos: str, value: Column, out: str, block: int = BLOCK
) -> DataFrame:
    """Adds the inclusive running sum of ``value`` by the integer column ``pos`` per key."""
    blocks = _blocks(df, keys, pos, value, block)
    w = (
        Window.partitionBy(*keys, "_block")
        .orderBy(pos)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return (
        df.withColumn("_block", F.floor(F.col(pos) / block))
        .join(blocks, [*keys, "_block"])
        .withColumn(out, F.col("_before") + F.sum(value).over(w))
        .drop("_block", "_before", "_total")
    )


def lookup(facts: DataFrame, dim: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """Join ``facts`` to a table with one row per key, safe for a key that holds many facts.

    ``dim`` is usually an aggregate and thus already hash-partitioned by the key; Spark would
    then skip its shuffle, and AQE splits a skewed join only between two fresh shuffles. The
    second, derived join column makes both sides shuffle, so a hot partition of ``facts`` is
    split and the matching partition of ``dim`` is read once per split. A ``dim`` that turns
    out small is still broadcast by AQE.
    """
    probe = F.crc32(F.concat_ws("\x1f", *[F.col(k).cast("string") for k in keys]))
    return facts.withColumn("_probe", probe).join(
        dim.withColumn("_probe", probe), [*keys, "_probe"], how
    ).drop("_probe")
