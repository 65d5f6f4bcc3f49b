"""Keyed state: spaced events (throttle, memo with time limit) and growing answers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions import lexicon as L
from ..functions.ordered import lookup
from ..operators.spacing import spaced
from ..session import materialise, shared_dir
from .runner import latest_per_key, run_batches, run_to_table

DAY = 86_400_000_000


def spaced_to_table(
    events: DataFrame, key: str, id_col: str, at: str, gap: int, late: int = 7 * DAY, idle: str = "7 days"
) -> DataFrame:
    """Runs a stream to verdicts (key, id, kept, version): is an event at least ``gap`` microseconds after the last kept one?

    Events may come in any order. Held between micro-batches are the keys' events of the last
    ``late`` microseconds before their newest one, with their verdicts, and the last kept time
    before them. A micro-batch judges the held and new events of its keys by ``spaced``, which
    cuts a key into time blocks, so a key with very many events is many tasks. An event that
    comes late is put in its place, and every event whose verdict changed comes out once more
    with a higher ``version``: an event's verdict is that of its highest version, the same as if
    all had come in order (``final_verdicts``). An event older than what is held is judged by the
    last kept time alone, one without a time is not kept. Equal times count as one event.

    A key of which nothing has come for ``idle`` is forgotten. Each micro-batch writes folders of
    its own number, so one that runs again replaces what it wrote.
    """
    spark = events.sparkSession
    root = shared_dir(spark, "spaced")
    rows_schema = T.StructType(
        [
            T.StructField("_k", T.StringType()),
            events.schema[key],
            events.schema[id_col],
            T.StructField("_at", T.LongType()),
            T.StructField("_old", T.BooleanType()),
        ]
    )
    ends_schema = "_k string, base long, seen timestamp"
    # joins leave out null keys, which are a key here
    joined = F.coalesce(F.concat(F.lit("k"), F.col(key).cast("string")), F.lit("null")).alias("_k")

    def before(name: str, schema: T.StructType | str, batch_id: int) -> DataFrame:
        if batch_id == 0:
            return spark.createDataFrame([], schema)
        return spark.read.schema(schema).parquet(f"{root}/{name}/{batch_id - 1}")

    def step(batch: DataFrame, batch_id: int) -> None:
        new = batch.select(
            joined, key, id_col, F.unix_micros(at).alias("_at"), F.lit(None).cast("boolean").alias("_old")
        )
        new = materialise(new, "spaced-new")
        held, ends = before("held", rows_schema, batch_id), before("ends", ends_schema, batch_id)
        came = new.select("_k").distinct()
        rows = held.join(came, "_k", "left_semi").unionByName(new)
        tops = rows.groupBy("_k").agg(F.max("_at").alias("_newest")).join(ends.drop("seen"), "_k", "left")
        rows = lookup(rows, tops, ["_k"])
        free = F.col("_at").isNotNull() & F.coalesce(F.col("_at") >= F.col("base") + gap, F.lit(True))
        judged = spaced(rows.where(free), ["_k"], "_at", gap, block_gaps=48).unionByName(
            rows.where(~free).withColumn("kept", F.lit(False))
        )
        judged = materialise(judged, "spaced-judged")
        said = judged.where(F.col("_old").isNull() | (F.col("_old") != F.col("kept")))
        said.select(key, id_col, "kept", F.lit(batch_id + 1).cast("long").alias("version")).write.mode(
            "overwrite"
        ).parquet(f"{root}/verdicts/{batch_id}")
        stays = F.coalesce(F.col("_at") > F.col("_newest") - late, F.lit(False))
        now = F.current_timestamp()
        quiet = ends.join(came, "_k", "left_anti").where(F.col("seen") >= now - F.expr(f"interval {idle}"))
        judged.groupBy("_k").agg(
            F.coalesce(F.max(F.when(~stays & F.col("kept"), F.col("_at"))), F.max("base")).alias("base"),
            now.alias("seen"),
        ).unionByName(quiet).write.mode("overwrite").parquet(f"{root}/ends/{batch_id}")
        kept_on = judged.where(stays).withColumn("_old", F.col("kept")).select(rows_schema.names)
        kept_on.unionByName(held.join(quiet, "_k", "left_semi").select(rows_schema.names)).write.mode(
            "overwrite"
        ).parquet(f"{root}/held/{batch_id}")

    run_batches(events, step)
    out = T.StructType([events.schema[key], events.schema[id_col]]).add("kept", "boolean").add("version", "long")
    return spark.read.schema(out).parquet(f"{root}/verdicts/*")


def final_verdicts(sink: DataFrame, key: str, id_col: str) -> DataFrame:
    """The verdict of every event's highest version."""
    return sink.groupBy(key, id_col).agg(F.max_by("kept", "version").alias("kept"))


def stream_throttle(
    events: DataFrame, key: str, id_col: str, at: str, gap: int, late: int = 7 * DAY
) -> DataFrame:
    """Progress events with whether they are forwarded."""
    out = final_verdicts(spaced_to_table(events, key, id_col, at, gap, late), key, id_col)
    return out.withColumnRenamed("kept", "forwarded")


def stream_memo(queries: DataFrame, ttl: int = L.MEMO_TTL_SECONDS, late: int = 7 * DAY) -> DataFrame:
    """Questions (memo_key, query_id, asked_at) with whether a result of the last ``ttl`` s exists."""
    rows = spaced_to_table(queries, "memo_key", "query_id", "asked_at", ttl * 1_000_000 + 1, late)
    verdicts = final_verdicts(rows, "memo_key", "query_id")
    return verdicts.select("memo_key", "query_id", (~F.col("kept")).alias("hit"))


def partial_answer_stream(
    tokens: DataFrame, key: str, limit: int | None = None, idle: str = "7 days"
) -> DataFrame:
    """(key, seq, token) to the answer so far, in the order of ``seq`` however tokens arrive.

    An empty token clears the answer: what has a smaller ``seq`` no longer counts, also if it
    arrives later. State is the tokens after the last clearing; it ends when nothing has come for
    ``idle``. With a ``limit`` an answer stops growing at that many characters, and what lies
    beyond leaves the state.
    """
    schema = T.StructType([tokens.schema[key], T.StructField("answer", T.StringType())])

    def grow(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        seqs, parts, cleared = state.get if state.exists else ([], [], None)
        rows, seen = list(zip(seqs, parts, strict=True)), 0
        for f in frames:
            rows += zip(f["seq"].tolist(), f["token"].tolist(), strict=True)
            seen = max(seen, int(f["_ms"].max()))
        ends = [s for s, t in rows if not t] + ([] if cleared is None else [cleared])
        cleared = max(ends, default=None)
        rows = sorted((r for r in rows if r[1] and (cleared is None or r[0] > cleared)), key=lambda r: r[0])
        if limit is not None:
            ahead = np.cumsum([0, *[len(t) for _, t in rows]])
            rows = rows[: int(np.searchsorted(ahead[:-1], limit, side="right"))]
        state.update(([s for s, _ in rows], [t for _, t in rows], cleared))
        state.setTimeoutTimestamp(max(seen, state.getCurrentWatermarkMs()) + 1)
        yield pd.DataFrame({key: [k[0]], "answer": ["".join(t for _, t in rows)]})

    return (
        tokens.withColumn("_seen", F.current_timestamp())
        .withWatermark("_seen", idle)
        .select(key, F.col("seq").cast("long"), "token", "_seen", F.unix_millis("_seen").alias("_ms"))
        .groupBy(key)
        .applyInPandasWithState(
            grow,
            schema,
            "seqs array<long>, parts array<string>, cleared long",
            "update",
            GroupStateTimeout.EventTimeTimeout,
        )
    )


def stream_partial_message(tokens: DataFrame, key: str) -> DataFrame:
    """The answers as they stand; cleared ones are gone."""
    last = latest_per_key(run_to_table(partial_answer_stream(tokens, key), "update"), [key])
    return last.where("answer <> ''")
