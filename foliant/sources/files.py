"""Files as rows: raw bytes and text documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators.validate import extension


def scan_files(spark: SparkSession, path: str, **options) -> DataFrame:
    """(path, name, ext, size, modified, content); content is read only where it is used."""
    name = F.url_decode(F.element_at(F.split("path", "/"), -1))
    return (
        spark.read.format("binaryFile")
        .options(recursiveFileLookup="true", **options)
        .load(path)
        .select(
            "path",
            name.alias("name"),
            extension(name).alias("ext"),
            F.col("length").alias("size"),
            F.col("modificationTime").alias("modified"),
            "content",
        )
    )


def text_measures(text: Column) -> list[Column]:
    return [
        (F.regexp_count(text, F.lit("\n")) + 1).alias("line_count"),
        X.count_tokens(text).alias("word_count"),
        F.length(text).alias("char_count"),
    ]


def text_docs(files: DataFrame) -> DataFrame:
    """Bytes to text, bad bytes as replacement characters, with line, word and char counts."""
    return files.withColumn("text", F.col("content").cast("string")).select(
        "*", *text_measures(F.col("text"))
    )


def read_text_docs(spark: SparkSession, path: str) -> DataFrame:
    files = scan_files(spark, path).where(F.col("ext").isin(".txt", ".text", ".md"))
    return text_docs(files).drop("content")
