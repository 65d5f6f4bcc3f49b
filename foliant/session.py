"""Session settings and the shared working folder."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def build_session(cores: int | str = "*", app: str = "foliant", **conf) -> SparkSession:
    """A local session with the settings the operators are tested under.

    On a cluster the caller brings its own session; only the UTC time zone and AQE matter
    to the results and plans, every other value below is for one machine.
    """
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.shuffle.partitions", "8")
        # as many shuffle partitions as cores already: merging them would only idle cores
        .config("spark.sql.adaptive.coalescePartitions.enabled", "false")
        .config("spark.driver.memory", os.environ.get("BENCH_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def spread(df: DataFrame) -> DataFrame:
    """Deals the rows of a table that comes in fewer splits than there are cores to all cores.

    For work that is much heavier than its input. A table of many files is left as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


_LOCAL_ROOTS: dict[str, str] = {}


def shared_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh folder below ``spark.checkpoint.dir`` for tables, sinks and stream checkpoints.

    The cluster names that folder. Where it is unset a local session gets a temporary one;
    any other master is refused, because a machine-local folder would not survive an executor.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")
        app = spark.sparkContext.applicationId
        root = _LOCAL_ROOTS.setdefault(app, "") or tempfile.mkdtemp(prefix="foliant-")
        _LOCAL_ROOTS[app] = root
    return f"{root.rstrip('/')}/foliant/{purpose}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, purpose: str) -> DataFrame:
    """Writes a table to the shared folder and reads it back.

    For a result that is read more than once and costly to make (chunks, vectors): its lineage
    ends here, so neither reuse nor a lost executor computes it again.
    """
    path = shared_dir(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Removes what a job within has shuffled as soon as it is done, not when the driver next collects garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)
