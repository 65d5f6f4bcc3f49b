"""File checks as columns over a table of files (path, name, ext, size, content)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lexicon as L
from ..functions import text as X


def extension(name: Column) -> Column:
    """Lower-case suffix with its dot; empty for none and for names like ``.profile``."""
    return F.lower(F.regexp_extract(name, r"[^/](\.[^./]+)$", 1))


def ext_allowed(ext: Column) -> Column:
    return ext.isin(L.ALLOWED_EXTENSIONS)


def size_allowed(size: Column, max_size: int = L.MAX_FILE_SIZE) -> Column:
    return size <= max_size


def expected_mimes(spark) -> DataFrame:
    rows = [(e, m) for e, m in L.EXPECTED_MIME.items()]
    return spark.createDataFrame(rows, "ext string, expected array<string>")


def mime_consistent(files: DataFrame) -> DataFrame:
    """Adds ``mime_ok``: the guessed type is one expected for the extension, or none is known."""
    dim = F.broadcast(expected_mimes(files.sparkSession))
    mime = F.coalesce("mime", F.lit(L.DEFAULT_MIME))
    return (
        files.join(dim, "ext", "left")
        .withColumn("mime_ok", F.coalesce(F.array_contains("expected", mime), F.lit(True)))
        .drop("expected")
    )


def suspicious_content(content: Column) -> Column:
    """Any suspicious pattern anywhere in the content (case-sensitive)."""
    return reduce(
        lambda a, b: a | b,
        [F.contains(content, F.lit(p.encode())) for p in L.SUSPICIOUS_PATTERNS],
    )


def validate_files(files: DataFrame, max_size: int = L.MAX_FILE_SIZE) -> DataFrame:
    """Adds ``errors``, ``warnings``, ``is_valid`` and ``content_hash``.

    ``files`` has name, ext, size, mime and content; the extension rule does not read content.
    """
    checked = mime_consistent(files)
    allowed = ", ".join(sorted(L.ALLOWED_EXTENSIONS))
    mime = F.coalesce("mime", F.lit(L.DEFAULT_MIME))
    errors = F.array_compact(
        F.array(
            F.when(
                ~ext_allowed(F.col("ext")),
                F.concat(F.lit("Unsupported file type: "), "ext", F.lit(f". Allowed types: {allowed}")),
            ),
            F.when(
                ~size_allowed(F.col("size"), max_size),
                F.concat(
                    F.lit("File size ("), X.format_size(F.col("size")),
                    F.lit(") exceeds maximum allowed size ("),
                    X.format_size(F.lit(max_size)), F.lit(")"),
                ),
            ),
            F.when(
                suspicious_content(F.col("content")),
                F.lit(
                    "File contains suspicious content patterns. "
                    "This file may be malicious and cannot be processed."
                ),
            ),
        )
    )
    warnings = F.array_compact(
        F.array(
            F.when(
                ~F.col("mime_ok"),
                F.concat(
                    F.lit("MIME type ("), mime, F.lit(") does not match file extension ("),
                    "ext", F.lit(")"),
                ),
            )
        )
    )
    return (
        checked.withColumn("errors", errors)
        .withColumn("warnings", warnings)
        .withColumn("is_valid", F.size("errors") == 0)
        .withColumn("content_hash", F.sha2("content", 256))
        .drop("mime_ok")
    )


def doc_type(ext: Column) -> Column:
    return (
        F.when(ext.isin(".pdf", ".docx", ".pptx", ".epub", ".txt"), F.substring(ext, 2, 10))
        .otherwise("other")
    )


def library_doc_type(ext: Column) -> Column:
    """The library's shorter list of types."""
    return F.when(ext.isin(".pdf", ".docx", ".pptx"), F.substring(ext, 2, 10)).otherwise("other")


def title_of(path: Column) -> Column:
    """File name without folder and without its lower-case extension."""
    base = F.element_at(F.split(path, "/"), -1)
    ext = extension(base)
    return F.when(
        (ext != "") & base.endswith(ext), F.left(base, F.length(base) - F.length(ext))
    ).otherwise(base)


def ocr_admissible(size_mb: Column, pages: Column) -> Column:
    """Null when a scan may be read, else the reason why not."""
    max_mb = L.OCR_MAX_BYTES / (1024 * 1024)
    return F.when(
        size_mb > max_mb,
        F.format_string(
            f"File is too large for OCR processing (%.1fMB). Maximum supported size is {max_mb}MB. "
            "Please use a smaller file or split the PDF into smaller parts.",
            F.bround(size_mb, 1),
        ),
    ).when(
        pages > L.OCR_MAX_PAGES,
        F.format_string(
            "PDF has too many pages for OCR processing (%d pages). "
            f"Maximum supported is {L.OCR_MAX_PAGES} pages. "
            "Please split the PDF into smaller parts.",
            pages,
        ),
    )


def route(ext: Column) -> Column:
    """Which extractor a file goes to."""
    return (
        F.when(ext == ".pdf", "pdf")
        .when(ext.isin(".doc", ".docx"), "docx")
        .when(ext.isin(".ppt", ".pptx"), "pptx")
        .when(ext == ".epub", "epub")
        .when(ext.isin(".txt", ".text", ".md"), "text")
        .otherwise("unsupported")
    )
