"""Document catalog and chunk table maintenance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ordered import lookup
from ..functions.text import format_size


def delete_documents(chunks: DataFrame, doc_ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(chunks left, per requested document: chunks deleted and whether it was there)."""
    asked = doc_ids.select("doc_id").distinct()
    left = lookup(chunks, asked, ["doc_id"], "left_anti")
    gone = lookup(chunks, asked, ["doc_id"], "left_semi").groupBy("doc_id").agg(
        F.count("*").alias("chunks_deleted")
    )
    report = asked.join(gone, "doc_id", "left").select(
        "doc_id",
        F.coalesce("chunks_deleted", F.lit(0)).alias("chunks_deleted"),
        F.col("chunks_deleted").isNotNull().alias("found"),
    )
    return left, report


def delete_chunks(chunks: DataFrame, chunk_ids: DataFrame) -> DataFrame:
    return chunks.join(chunk_ids.select("chunk_id"), "chunk_id", "left_anti")


def chunks_of(chunks: DataFrame, doc_ids: DataFrame) -> DataFrame:
    return chunks.join(doc_ids.select("doc_id"), "doc_id", "left_semi")


def count_chunks(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("doc_id").agg(F.count("*").alias("chunk_count"))


def verify_documents(doc_ids: DataFrame, chunks: DataFrame) -> DataFrame:
    """Per requested document: its chunk count and whether it has any."""
    n = F.coalesce("chunk_count", F.lit(0))
    return doc_ids.join(count_chunks(chunks), "doc_id", "left").select(
        "doc_id", n.alias("chunk_count"), (n > 0).alias("present")
    )


def upsert_catalog(catalog: DataFrame, updates: DataFrame, insert: bool = True) -> DataFrame:
    """Applies updates ``(id, version, fields…)``; the last non-null value of a field wins.

    Fields an update leaves null keep their value. Unknown ids are added unless ``insert`` is
    false. Several updates of one id are folded by a partial aggregation.
    """
    fields = [c for c in catalog.columns if c != "id"]
    given = [c for c in fields if c in updates.columns]
    last = updates.groupBy("id").agg(
        *[F.max_by(c, F.when(F.col(c).isNotNull(), F.col("version"))).alias(f"_{c}") for c in given]
    )
    merged = catalog.join(last, "id", "full" if insert else "left")
    return merged.select(
        "id", *[F.coalesce(f"_{c}", c).alias(c) if c in given else F.col(c) for c in fields]
    )


def catalog_lookup(catalog: DataFrame, title_contains: str | None = None, **equal) -> DataFrame:
    """Rows with all the given values; ``title_contains`` ignores case."""
    for name, value in equal.items():
        catalog = catalog.where(F.col(name) == value)
    if title_contains is not None:
        catalog = catalog.where(F.lower("title").contains(title_contains.lower()))
    return catalog


def check_duplicates(incoming: DataFrame, catalog: DataFrame, within_course: bool = False) -> DataFrame:
    """For each incoming file the first catalogued document with the same content.

    The catalog is reduced to one document per hash before the join, so copies do not multiply.
    """
    keys = ["contentHash", "courseId"] if within_course else ["contentHash"]
    first = catalog.groupBy(*keys).agg(
        F.min_by(F.struct("id", "filename"), F.struct("uploadDate", "id")).alias("_first")
    )
    where = " in this course" if within_course else ""
    message = F.concat(
        F.lit(f"This document already exists{where} as \""), F.col("_first.filename"), F.lit('"')
    )
    return lookup(incoming, first, keys).select(
        *incoming.columns,
        F.col("_first").isNotNull().alias("is_duplicate"),
        F.col("_first.id").alias("existing_id"),
        F.coalesce(message, F.lit("Document is unique")).alias("message"),
    )


def duplicate_groups(catalog: DataFrame) -> DataFrame:
    """Members of groups with the same content, one row per document.

    Rows are not gathered per group: a group of copies may be most of the catalog.
    """
    groups = (
        catalog.groupBy("contentHash")
        .agg(F.count("*").alias("group_size"), F.min("id").alias("first_id"))
        .where("group_size > 1")
    )
    return lookup(catalog, groups, ["contentHash"], "inner")


def duplicate_stats(catalog: DataFrame) -> DataFrame:
    """Documents, distinct contents, groups, surplus copies and the space they take."""
    groups = catalog.groupBy("contentHash").agg(
        F.count("*").alias("n"), F.min_by("fileSize", "id").alias("size")
    )
    extra = F.col("n") - 1
    return groups.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_documents"),
        F.count("*").alias("unique_documents"),
        F.count_if(F.col("n") > 1).alias("duplicate_groups"),
        F.coalesce(F.sum(extra), F.lit(0)).alias("total_duplicates"),
        F.coalesce(F.sum(extra * F.col("size")), F.lit(0)).alias("wasted_space"),
    )


def storage_stats(catalog: DataFrame, by: list[str] = ()) -> DataFrame:
    total = F.coalesce(F.sum("fileSize"), F.lit(0))
    return catalog.groupBy(*by).agg(
        F.count("*").alias("documents"),
        total.alias("total_size"),
        format_size(total).alias("total_size_text"),
    )


def orphan_files(files: DataFrame, catalog: DataFrame) -> DataFrame:
    """Stored files (column ``name``) whose stem is not a catalogued id."""
    known = catalog.select(F.col("id").cast("string").alias("_stem"))
    return (
        files.withColumn("_stem", F.split_part("name", F.lit("."), F.lit(1)))
        .join(known, "_stem", "left_anti")
        .drop("_stem")
    )


def purge_failed(catalog: DataFrame, chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(chunks left, per failed document: chunks deleted)."""
    failed = catalog.where("status = 'failed'").select(F.col("id").alias("doc_id"))
    return delete_documents(chunks, failed)


def cascade_delete(catalog: DataFrame, chunks: DataFrame, scope: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Deletes all documents in scope: (catalog left, chunks left, per-document result)."""
    doomed = catalog.where(scope).select(F.col("id").alias("doc_id"))
    left, report = delete_documents(chunks, doomed)
    return catalog.where(~F.coalesce(scope, F.lit(False))), left, report
