"""JSON inputs: chat files, the chat catalog, log lines, token streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import strip

# citations stay JSON text, so that no field of theirs is lost
CHAT_FILE = (
    "messages array<struct<content:string, sender:string, timestamp:string, "
    "citations:string, documentIds:array<string>>>"
)
CATALOG_FILE = (
    "chats array<struct<id:string, title:string, latestActivity:string, chatType:string, "
    "documentIds:array<string>>>"
)
LOG_FIELDS = ["timestamp", "level", "logger", "message", "module", "function", "line", "exception"]


def _read_whole(spark: SparkSession, path: str) -> DataFrame:
    return (
        spark.read.option("recursiveFileLookup", "true")
        .text(path, wholetext=True)
        .select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("json"))
    )


def parse_chat_files(files: DataFrame) -> DataFrame:
    """(path, json) with path ``…/courses/<course>/chats/<chat>.json`` to one row per message."""
    return files.select(
        F.regexp_extract("path", r"courses/([^/]+)/", 1).alias("course_id"),
        F.regexp_extract("path", r"chats/([^/]+)\.json$", 1).alias("chat_id"),
        F.posexplode(F.from_json("json", CHAT_FILE)["messages"]).alias("seq", "m"),
    ).select(
        "course_id",
        "chat_id",
        "seq",
        "m.sender",
        "m.content",
        "m.citations",
        F.col("m.documentIds").alias("document_ids"),
        "m.timestamp",
    )


def read_chats(spark: SparkSession, path: str) -> DataFrame:
    return parse_chat_files(_read_whole(spark, path))


def parse_chat_catalog(files: DataFrame) -> DataFrame:
    """(path, json) catalogs to one row per chat, with the defaults of older files."""
    return files.select(
        F.regexp_extract("path", r"courses/([^/]+)/", 1).alias("course_id"),
        F.explode(F.from_json("json", CATALOG_FILE)["chats"]).alias("c"),
    ).select(
        "course_id",
        F.col("c.id").alias("chat_id"),
        "c.title",
        F.to_timestamp("c.latestActivity").alias("latest_activity"),
        F.coalesce(
            F.when(F.col("c.chatType") != "", F.col("c.chatType")), F.lit("document-based")
        ).alias("chat_type"),
        F.coalesce("c.documentIds", F.array().cast("array<string>")).alias("document_ids"),
    )


def read_chat_catalog(spark: SparkSession, path: str) -> DataFrame:
    return parse_chat_catalog(_read_whole(spark, path))


def parse_json_logs(lines: DataFrame) -> DataFrame:
    """Log lines (column ``value``) to the fixed fields and a map of all others."""
    fields = F.from_json("value", "map<string,string>")
    return (
        lines.where(strip(F.col("value")) != "")
        .withColumn("_f", fields)
        .where("_f IS NOT NULL")
        .select(
            *[F.col("_f")[name].alias(name) for name in LOG_FIELDS if name != "line"],
            F.col("_f")["line"].cast("int").alias("line"),
            F.map_filter("_f", lambda k, _: ~k.isin(LOG_FIELDS)).alias("extras"),
        )
    )


def read_json_logs(spark: SparkSession, path: str) -> DataFrame:
    return parse_json_logs(spark.read.text(path))


def parse_token_stream(lines: DataFrame) -> DataFrame:
    """Adds ``token`` and ``done``; blank and invalid lines and lines with neither are dropped.

    The chat shape's content comes first, else the generate shape's response.
    """
    j = F.from_json("line", "message struct<content:string>, response string, done boolean")
    chat, plain = F.col("_j.message.content"), F.col("_j.response")
    return (
        lines.where(strip(F.col("line")) != "")
        .withColumn("_j", j)
        .withColumn("token", F.coalesce(F.when(chat != "", chat), F.when(plain != "", plain)))
        .withColumn("done", F.coalesce("_j.done", F.lit(False)))
        .drop("_j")
        .where(F.col("token").isNotNull() | F.col("done"))
    )
