"""Running streams over what is available, with sinks that a replayed batch cannot double."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialise, shared_dir

ROWS_PER_TASK = 200


def replay(df: DataFrame, order: str, parts: int = 3) -> DataFrame:
    """A stored table as a stream of about ``parts`` micro-batches, in the order of a number.

    The parts are ranges of equal size, written one after the other with equally many files, so
    that the file source, which takes older files first, makes each part one micro-batch. Live
    streams are read directly.
    """
    spark = df.sparkSession
    df = materialise(df, "replay-source")  # read once per part
    path = shared_dir(spark, "replay")
    cuts = [i / parts for i in range(1, parts)]
    rows, quantiles = df.agg(
        F.count(order), F.percentile_approx(order, F.array(*map(F.lit, cuts)), 10000)
    ).first()
    bounds = sorted(set(quantiles or []))
    cores = spark.sparkContext.defaultParallelism
    files = cores if rows >= parts * cores * ROWS_PER_TASK else 1
    for i, (low, high) in enumerate(zip([None, *bounds], [*bounds, None])):
        part = df if low is None else df.where(F.col(order) > low)
        part = part if high is None else part.where(F.col(order) <= high)
        part.repartition(files).write.parquet(f"{path}/{i:04d}")
    return (
        spark.readStream.schema(df.schema)
        .option("maxFilesPerTrigger", files)
        .parquet(f"{path}/*")
    )


def run_batches(
    stream: DataFrame, write: Callable[[DataFrame, int], None], mode: str = "append"
) -> None:
    """Runs ``write(batch, batch_id)`` until the available input is used up."""
    spark = stream.sparkSession
    q = (
        stream.writeStream.outputMode(mode)
        .option("checkpointLocation", shared_dir(spark, "stream"))
        .foreachBatch(write)
        .trigger(availableNow=True)
        .start()
    )
    try:
        q.awaitTermination()
    finally:
        q.stop()


def run_to_table(stream: DataFrame, mode: str = "append") -> DataFrame:
    """The rows a stream emits, with ``batch_id``. A batch that runs again replaces itself."""
    spark = stream.sparkSession
    path = shared_dir(spark, "sink")

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    run_batches(stream, write, mode)
    return read_sink(spark, path, stream)


def read_sink(spark: SparkSession, path: str, stream: DataFrame) -> DataFrame:
    schema = stream.schema.add("batch_id", "long")
    return spark.read.schema(schema).option("basePath", path).parquet(f"{path}/batch_id=*")


def latest_per_key(sink: DataFrame, keys: list[str]) -> DataFrame:
    """The last emitted row of every key of an update-mode sink."""
    rest = [c for c in sink.columns if c not in (*keys, "batch_id")]
    return (
        sink.groupBy(*keys)
        .agg(F.max_by(F.struct(*rest), "batch_id").alias("_r"))
        .select(*keys, "_r.*")
    )
