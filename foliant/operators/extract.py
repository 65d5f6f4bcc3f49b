"""Decoded records of documents (words, cells, shapes, runs, pages) to structured text.

Every group here is the content of one page, table, slide or document, and its result is one
text value, so a group is bounded by what a single row can hold.
"""

from __future__ import annotations

from html.entities import html5

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lexicon as L
from ..functions.ordered import lookup
from ..functions.running import running_min, running_sum
from ..functions.text import let, strip


def joined(value: str, sep: str, order: str) -> Column:
    """Ordered concatenation as an aggregate; nulls are left out."""
    escaped = sep.replace("\\", "\\\\").replace("\n", "\\n")
    return F.expr(f"listagg({value}, '{escaped}') within group (order by {order})")


# comments, declarations, scripts and styles with their text, end tags, start tags
_ATTRIBUTES = r"""(?:[^'">]++|"[^"]*+"|'[^']*+')*+"""
MARKUP = (
    r"<!--(?s:.*?)(?:-->|\z)"
    rf"|(?i:<(script|style)(?=[\s/>]){_ATTRIBUTES}(?<!/)>(?s:.*?)(?:</\1\s*+>|\z))"
    rf"|<[!?][^>]*+>|</[^>]*+>|<[A-Za-z]{_ATTRIBUTES}>"
)
TITLE_TAG = r"(?i)^<(h1|h2|h3|title)(?=[\s/>])(?s:.*)(?<!/)>$"
TEMPLATE_START, TEMPLATE_END = r"(?i)^<template(?=[\s/>])(?s:.*)(?<!/)>$", r"(?i)^</template(?=[\s/>])"
REFERENCE = r"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[A-Za-z][A-Za-z0-9]*;?)"
# names of character references, each between a start and an equals mark, as one text to look up in
_START, _EQUALS = "\x02", "\x03"
_NAMES = "".join(f"{_START}{k}{_EQUALS}{v}" for k, v in html5.items()) + _START
# names that need no semicolon, longest first
_BARE_NAMES = sorted((k for k in html5 if not k.endswith(";")), key=lambda k: (-len(k), k))
# numbers of the control range stand for the characters of Windows-1252
_C1 = "".join(map(chr, range(0x80, 0xA0)))
_C1_MEANT = "".join(bytes([i]).decode("cp1252", "replace").replace("\ufffd", chr(i)) for i in range(0x80, 0xA0))


def _numbered(digits: Column, base: int) -> Column:
    """The character of a number; nothing for numbers that name none."""
    short = F.regexp_replace(digits, "^0+", "")
    code = F.conv(F.when(F.length(short) <= 7, short).otherwise(F.lit("0")), base, 10).cast("int")

    def character(c: Column) -> Column:
        wide = F.concat(F.lit("0000FEFF"), F.lpad(F.hex(c), 8, "0"))
        bad = (c <= 0) | c.between(0xD800, 0xDFFF) | (c > 0x10FFFF)
        none = (
            c.between(1, 8) | (c == 0xB) | c.between(0xE, 0x1F) | (c == 0x7F)
            | c.between(0xFDD0, 0xFDEF) | (c.bitwiseAND(F.lit(0xFFFE)) == 0xFFFE)
        )
        one = F.translate(F.decode(F.unhex(wide), "UTF-32"), _C1, _C1_MEANT)
        return F.when(bad, "\ufffd").when(none, "").otherwise(one)

    return let(F.coalesce(code, F.lit(0)), character)


def _named(name: Column) -> Column:
    """The characters of a name; of a name that begins with one that needs no semicolon, those and the rest."""

    def value(key: Column) -> Column:
        at = F.instr(F.lit(_NAMES), F.concat(F.lit(_START), key, F.lit(_EQUALS)))
        two = F.substring(F.lit(_NAMES), at + F.length(key) + 2, F.lit(2))
        return F.split_part(two, F.lit(_START), F.lit(1))

    known = F.lit(_NAMES).contains(F.concat(F.lit(_START), name, F.lit(_EQUALS)))
    begins = F.get(F.filter(F.array(*map(F.lit, _BARE_NAMES)), lambda k: F.startswith(name, k)), F.lit(0))
    part = let(begins, lambda k: F.concat(value(k), F.substring(name, F.length(k) + 1, F.length(name))))
    return F.when(known, value(name)).otherwise(F.coalesce(part, F.concat(F.lit("&"), name)))


def unescape(text: Column) -> Column:
    """Character references, named and numbered, as the characters they stand for."""

    def meant(r: Column) -> Column:
        digits = F.regexp_extract(r, "^&#[xX]?([0-9a-fA-F]+)", 1)
        return (
            F.when(r.rlike("^&#[xX]"), _numbered(digits, 16))
            .when(r.startswith("&#"), _numbered(digits, 10))
            .otherwise(_named(F.substring(r, 2, F.length(r))))
        )

    found = F.transform(F.regexp_extract_all(text, F.lit(REFERENCE), F.lit(0)), meant)
    parts = F.zip_with(F.split(text, REFERENCE, -1), found, lambda a, b: F.concat(a, F.coalesce(b, F.lit(""))))
    return F.when(text.contains("&"), F.array_join(parts, "")).otherwise(text)


def html_to_text(pages: DataFrame, html: str = "html") -> DataFrame:
    """Adds ``title``, ``text`` and ``char_count`` of an HTML column.

    Markup cuts a page into text nodes, whose lines are stripped and kept unless empty. Scripts,
    styles, comments and declarations have no text, and what stands inside templates, however
    deep, is hidden. The title is the text of the first h1, h2, h3 or title element up to its end
    tag. A ``<`` that begins no complete tag is text; a null page is an empty one.
    """

    def shown(tags: Column, nodes: Column) -> Column:
        """The nodes, empty where a template is open; an end tag without a start tag closes nothing."""
        steps = F.transform(
            F.concat(tags, F.array(F.lit(""))),
            lambda t: F.when(t.rlike(TEMPLATE_START), 1).when(t.rlike(TEMPLATE_END), -1).otherwise(0),
        )
        depth = let(
            running_sum(steps),
            lambda d: F.zip_with(d, running_min(d), lambda x, least: x - F.least(x, least, F.lit(0))),
        )
        masked = F.zip_with(nodes, depth, lambda n, d: F.when(d == 0, n).otherwise(""))
        return F.when(F.exists(tags, lambda t: t.rlike(TEMPLATE_START)), masked).otherwise(nodes)

    def title(tags: Column, nodes: Column) -> Column:
        def of(first: Column) -> Column:
            end = F.concat(F.lit("(?i)^</"), F.regexp_extract(F.get(tags, first - 1), TITLE_TAG, 1), F.lit(r"(?=[\s/>])"))
            after = F.slice(tags, first + 1, F.size(tags))
            stop = let(end, lambda e: F.array_position(F.transform(after, lambda t: F.rlike(t, e)), True))
            own = let(stop, lambda n: F.slice(nodes, first + 1, F.when(n > 0, n).otherwise(F.size(nodes)).cast("int")))
            return F.when(first > 0, strip(F.array_join(F.transform(own, unescape), ""))).otherwise("")

        where = F.array_position(F.transform(tags, lambda t: t.rlike(TITLE_TAG)), True).cast("int")
        return let(where, of)

    def body(nodes: Column) -> Column:
        lines = F.transform(F.split(unescape(F.array_join(nodes, "\n")), "\n", -1), strip)
        return F.array_join(F.filter(lines, lambda x: x != ""), "\n")

    def read(page: Column) -> Column:
        tags = F.regexp_extract_all(page, F.lit(MARKUP), F.lit(0))
        nodes = F.split(page, MARKUP, -1)
        return let(
            tags,
            lambda t: let(
                shown(t, nodes), lambda n: F.struct(title(t, n).alias("title"), body(n).alias("text"))
            ),
        )

    page = let(F.coalesce(F.col(html), F.lit("")), read)
    return (
        pages.withColumn("_page", page)
        .select("*", "_page.title", "_page.text")
        .drop("_page")
        .withColumn("char_count", F.length("text"))
    )


def assemble_chapters(chapters: DataFrame) -> DataFrame:
    """(book, seq, title, text) to one text per book; empty chapters are not numbered."""
    number = F.row_number().over(Window.partitionBy("book").orderBy("seq"))
    part = F.concat_ws(
        "\n",
        F.concat(F.lit("[Chapter "), "number", F.lit("]")),
        F.when(F.col("title") != "", F.concat(F.lit("Title: "), "title")),
        "text",
    )
    return (
        chapters.where(F.col("text") != "")
        .withColumn("number", number)
        .withColumn("part", part)
        .groupBy("book")
        .agg(joined("part", "\n\n", "number").alias("text"), F.count("*").alias("chapters"))
    )


def assemble_slides(shapes: DataFrame) -> DataFrame:
    """(doc, slide, seq, is_title, text, notes) to one row per slide with its text layout."""
    text = strip(F.col("text"))
    notes = strip(F.coalesce("notes", F.lit("")))
    s = shapes.withColumn("text", F.when(text != "", text)).withColumn("notes", notes)
    title = F.max_by(
        F.col("text"), F.when(F.col("is_title") & F.col("text").isNotNull(), F.col("seq"))
    )
    slides = (
        s.withColumn("item", F.when(~F.col("is_title"), F.concat(F.lit("  "), "text")))
        .groupBy("doc", "slide")
        .agg(
            F.coalesce(title, F.lit("")).alias("title"),
            joined("item", "\n", "seq").alias("content"),
            F.max("notes").alias("notes"),
            F.count("*").alias("shape_count"),
        )
    )
    layout = F.concat_ws(
        "\n",
        F.concat(F.lit("[Slide "), "slide", F.lit("]")),
        F.when(F.col("title") != "", F.concat(F.lit("Title: "), "title")),
        F.when(F.col("content").isNotNull(), F.concat(F.lit("Content:\n"), "content")),
        F.when(F.col("notes") != "", F.concat(F.lit("Notes: "), "notes")),
    )
    return slides.withColumn("has_notes", F.col("notes") != "").withColumn("text", layout)


def group_words_into_blocks(words: DataFrame, gap: float = 5.0) -> DataFrame:
    """Words of a page to text blocks: a vertical jump of ``gap`` or more starts a block."""
    page = Window.partitionBy("doc", "page").orderBy("seq")
    jump = F.abs(F.col("top") - F.lag("bottom").over(page)) >= gap
    block = F.sum(F.coalesce(jump.cast("int"), F.lit(0))).over(page)
    return (
        words.withColumn("block", block)
        .groupBy("doc", "page", "block")
        .agg(
            joined("text", " ", "seq").alias("text"),
            F.min_by("top", "seq").alias("y_start"),
            F.max_by("bottom", "seq").alias("y_end"),
        )
    )


def looks_like_heading(text: Column) -> Column:
    """Short and in upper or title case."""
    upper = text.rlike(r"\p{Lu}") & ~text.rlike(r"[\p{Ll}\p{Lt}]")
    title = (
        text.rlike(r"[\p{Lu}\p{Lt}]")
        & ~text.rlike(r"[\p{Lu}\p{Ll}\p{Lt}][\p{Lu}\p{Lt}]")
        & ~text.rlike(r"(^|[^\p{Lu}\p{Ll}\p{Lt}])\p{Ll}")
    )
    return (F.length(text) < 100) & (upper | title)


def blocks_to_text(blocks: DataFrame) -> DataFrame:
    """Blocks of a page to its text; headings get a line of their own."""
    t = strip(F.col("text"))
    part = F.when(looks_like_heading(t), F.concat(F.lit("\n"), t, F.lit("\n"))).otherwise(t)
    return (
        blocks.withColumn("part", F.when(t != "", part))
        .groupBy("doc", "page")
        .agg(joined("part", "\n\n", "block").alias("text"))
    )


def detect_columns(words: DataFrame) -> DataFrame:
    """Multi-column pages: at least 20 words, over 30 % of them on each side."""
    n = F.count("*")
    left = F.count_if(F.col("x0") < F.col("page_width") * 0.4)
    right = F.count_if(F.col("x0") > F.col("page_width") * 0.6)
    return words.groupBy("doc", "page").agg(
        n.alias("words"), ((n >= 20) & (left > n * 0.3) & (right > n * 0.3)).alias("has_columns")
    )


def table_to_markdown(cells: DataFrame, keys: list[str], ignore_marks: bool = False) -> DataFrame:
    """(keys…, row, col, cell) to one aligned markdown table per key.

    Rows without any text go away, short rows are padded; of a repeated cell the text that sorts
    last stands. ``ignore_marks`` leaves ``*`` and
    backticks out of the widths.
    """
    cell = F.coalesce("cell", F.lit(""))
    shown = F.regexp_replace(cell, "[*`]", "") if ignore_marks else cell
    c = cells.select(*keys, "row", "col", cell.alias("cell"), F.length(shown).alias("width"))

    def one_per_column(s: Column) -> Column:
        last = F.filter(s, lambda x, i: F.coalesce(F.get(s, i + 1)["col"] != x["col"], F.lit(True)))
        return F.map_from_entries(last)

    rows = (
        c.groupBy(*keys, "row")
        .agg(
            F.sort_array(F.collect_list(F.struct("col", F.struct("cell", "width")))).alias("m"),
            F.max("width").alias("widest"),
        )
        .where("widest > 0")
        .withColumn("m", one_per_column(F.col("m")))
    )
    by_col = c.groupBy(*keys, "col").agg(F.max("width").alias("w"))
    shape = rows.groupBy(*keys).agg(
        F.min("row").alias("first_row"),
        F.count("*").alias("row_count"),
        F.max(F.array_max(F.map_keys("m"))).alias("last_col"),
    )
    widths = by_col.groupBy(*keys).agg(
        F.map_from_entries(F.collect_list(F.struct("col", "w"))).alias("w")
    )
    cols = F.sequence(F.lit(0), F.col("last_col"))

    def padded(i: Column) -> Column:
        there = F.col("m")[i]
        width = F.coalesce(there["width"], F.lit(0))
        text = F.coalesce(there["cell"], F.lit(""))
        return F.concat(text, F.repeat(F.lit(" "), F.coalesce(F.col("w")[i], F.lit(0)) - width))

    line = F.concat(F.lit("| "), F.array_join(F.transform(cols, padded), " | "), F.lit(" |"))
    dashes = F.transform(cols, lambda i: F.repeat(F.lit("-"), F.coalesce(F.col("w")[i], F.lit(0)) + 2))
    rule = F.concat(F.lit("\n|"), F.array_join(dashes, "|"), F.lit("|"))
    header = (F.col("row") == F.col("first_row")) & (F.col("row_count") > 1)
    return (
        rows.join(shape, keys)
        .join(widths, keys)
        .withColumn("line", F.concat(line, F.when(header, rule).otherwise("")))
        .groupBy(*keys)
        .agg(
            joined("line", "\n", "row").alias("markdown"),
            F.count("*").alias("row_count"),
            (F.max("last_col") + 1).alias("col_count"),
            (F.count("*") > 1).alias("has_header"),
        )
    )


def assemble_pages(texts: DataFrame, tables: DataFrame, images: DataFrame) -> DataFrame:
    """(doc, page, text), (doc, page, table, markdown), (doc, page, image) to one text per doc."""
    parts = (
        texts.where(F.col("text") != "")
        .select("doc", "page", F.lit(0).alias("kind"), F.lit(0).alias("n"), F.col("text").alias("part"))
        .unionByName(
            tables.select(
                "doc", "page", F.lit(1).alias("kind"), F.col("table").cast("int").alias("n"),
                F.format_string("\n[Table %d]\n%s\n", F.col("table") + 1, "markdown").alias("part"),
            )
        )
        .unionByName(
            images.select(
                "doc", "page", F.lit(2).alias("kind"), F.col("image").cast("int").alias("n"),
                F.format_string("\n[Figure: %s]\n", F.col("image").cast("string")).alias("part"),
            )
        )
    )
    pages = parts.groupBy("doc", "page").agg(joined("part", "\n", "kind, n").alias("text"))
    return page_texts_to_document(pages)


def page_texts_to_document(pages: DataFrame) -> DataFrame:
    """Non-empty pages joined under ``[Page n]`` headers."""
    part = F.format_string("\n[Page %d]\n%s", "page", "text")
    return (
        pages.where(F.col("text") != "")
        .withColumn("part", part)
        .groupBy("doc")
        .agg(joined("part", "\n", "page").alias("text"))
    )


def detect_scanned(pages: DataFrame) -> DataFrame:
    """(doc, page, chars, n_tables, n_images): too little text per page means a scan."""
    return pages.groupBy("doc").agg(
        F.count("*").alias("page_count"),
        (F.sum("chars") / F.count("*") < L.SCANNED_CHARS_PER_PAGE).alias("is_scanned"),
        (F.sum("n_tables") > 0).alias("has_tables"),
        (F.sum("n_images") > 0).alias("has_images"),
    )


def ocr_words_to_pages(words: DataFrame) -> DataFrame:
    """(doc, page, seq, text, conf): readable words in order, mean confidence."""
    w = words.withColumn("text", strip(F.col("text"))).withColumn(
        "ok", (F.col("text") != "") & (F.col("conf") >= 0)
    )
    conf = F.coalesce(F.avg(F.when(F.col("ok"), F.col("conf"))), F.lit(0.0))
    return (
        w.withColumn("word", F.when(F.col("ok"), F.col("text")))
        .groupBy("doc", "page")
        .agg(
            F.coalesce(joined("word", " ", "seq"), F.lit("")).alias("text"),
            conf.alias("confidence"),
            F.count_if("ok").alias("word_count"),
            (conf < L.OCR_LOW_CONFIDENCE).alias("low_confidence"),
        )
    )


def ocr_doc_summary(pages: DataFrame) -> DataFrame:
    """Unweighted mean of page confidence, words and low-confidence pages per document."""
    return pages.groupBy("doc").agg(
        F.avg("confidence").alias("ocr_confidence"),
        F.sum("word_count").alias("total_words"),
        F.count_if("low_confidence").alias("low_confidence_pages"),
        F.count("*").alias("page_count"),
    )


def seconds_per_page(dpi: Column) -> Column:
    return (
        F.when(dpi <= 150, 1.5).when(dpi <= 200, 2.0).when(dpi <= 250, 3.0).otherwise(4.5)
    )


def plan_ocr(files: DataFrame) -> DataFrame:
    """(size_mb, pages) to the scan resolution and the time estimate it was chosen by."""
    size, pages = F.col("size_mb"), F.col("pages")
    by_size = (
        F.when(size < 5, 300)
        .when(size < 20, F.when(pages < 20, 300).otherwise(250))
        .when(size < 40, F.when(pages > 100, 200).otherwise(250))
        .otherwise(200)
    )
    planned = F.when(pages > 100, 200).otherwise(by_size)
    return (
        files.withColumn("_dpi", planned)
        .withColumn("estimated_seconds", seconds_per_page(F.col("_dpi")) * pages)
        .withColumn("dpi", F.when(F.col("estimated_seconds") > 480, 200).otherwise(F.col("_dpi")))
        .drop("_dpi")
    )


def choose_text_layer(docs: DataFrame, ocr: DataFrame) -> DataFrame:
    """(doc, text, is_scanned, page_count) and (doc, ocr_text): which text is used, and how read."""
    n, m = F.length("text"), F.length("ocr_text")
    use = (
        F.col("is_scanned")
        & F.col("ocr_text").isNotNull()
        & ((m > n * 1.5) | (n < F.col("page_count") * 100))
    )
    return (
        docs.join(ocr.select("doc", "ocr_text"), "doc", "left")
        .withColumn("extraction_method", F.when(use, "ocr").otherwise("standard"))
        .withColumn("text", F.when(use, F.col("ocr_text")).otherwise(F.col("text")))
        .drop("ocr_text")
    )


def apply_corrections(pages: DataFrame, corrections: DataFrame) -> DataFrame:
    """Poorly read pages of poorly read documents take a supplied correction.

    Every page that qualifies gains confidence, whether its correction was accepted or not.
    """
    poor = (
        pages.groupBy("doc")
        .agg(F.avg("confidence").alias("_mean"))
        .where(F.col("_mean") < L.OCR_CORRECT_BELOW)
        .select("doc", F.lit(True).alias("_poor"))
    )
    offered = corrections.select("doc", "page", F.col("text").alias("_offer"))
    routed = (
        F.coalesce("_poor", F.lit(False))
        & (F.col("confidence") < L.OCR_CORRECT_BELOW)
        & (F.col("text") != "")
    )
    accept = (
        routed
        & (F.length(strip(F.col("text"))) >= 10)
        & (F.length("_offer") > 10)
        & (F.col("_offer") != F.col("text"))
    )
    return (
        lookup(pages, poor, ["doc"])
        .join(offered, ["doc", "page"], "left")
        .select(
            "doc", "page",
            F.when(accept, F.col("_offer")).otherwise(F.col("text")).alias("text"),
            F.when(routed, F.least(F.col("confidence") + 20, F.lit(90.0)))
            .otherwise(F.col("confidence")).alias("confidence"),
            routed.alias("corrected"),
        )
    )


def split_for_correction(text: Column, max_length: int = 2000) -> Column:
    """Pieces of ``'. '``-sentences, each packed while it stays under ``max_length``."""
    start = F.struct(
        F.array().cast("array<string>").alias("done"), F.lit("").alias("open")
    )

    def add(acc: Column, s: Column) -> Column:
        piece = F.concat(s, F.lit(". "))
        fits = F.length(acc["open"]) + F.length(s) < max_length
        closed = F.when(
            fits | (acc["open"] == ""), acc["done"]
        ).otherwise(F.array_append(acc["done"], strip(acc["open"])))
        return F.struct(
            closed.alias("done"),
            F.when(fits, F.concat(acc["open"], piece)).otherwise(piece).alias("open"),
        )

    return F.aggregate(
        F.split(text, r"\. ", -1),
        start,
        add,
        lambda acc: F.when(acc["open"] == "", acc["done"]).otherwise(
            F.array_append(acc["done"], strip(acc["open"]))
        ),
    )


def run_markdown(text: Column, bold: Column, italic: Column, font: Column) -> Column:
    """One run with its marks; null for an empty run."""
    styled = (
        F.when(bold & italic, F.concat(F.lit("***"), text, F.lit("***")))
        .when(bold, F.concat(F.lit("**"), text, F.lit("**")))
        .when(italic, F.concat(F.lit("*"), text, F.lit("*")))
        .otherwise(text)
    )
    mono = F.coalesce(F.lower(font).contains("mono"), F.lit(False))
    return F.when(
        text != "", F.when(mono, F.concat(F.lit("`"), styled, F.lit("`"))).otherwise(styled)
    )


def runs_to_markdown(runs: DataFrame) -> DataFrame:
    """(doc, para, run, text, bold, italic, font, style) to one row per paragraph."""
    mark = run_markdown(F.col("text"), F.col("bold"), F.col("italic"), F.col("font"))
    return (
        runs.withColumn("mark", mark)
        .groupBy("doc", "para")
        .agg(
            strip(F.coalesce(joined("mark", "", "run"), F.lit(""))).alias("text"),
            strip(F.coalesce(joined("text", "", "run"), F.lit(""))).alias("plain"),
            F.min_by("style", "run").alias("style"),
        )
    )


def heading_number(style: Column) -> Column:
    """The number a heading style ends with; null when it has none."""
    return F.regexp_extract(style, r"(?:^|\s)(\d+)\s*$", 1).try_cast("int")


def classify_paragraphs(paragraphs: DataFrame) -> DataFrame:
    """Adds ``kind`` (heading, list, paragraph) and the finished ``part``."""
    style, plain, text = F.coalesce("style", F.lit("")), F.col("plain"), F.col("text")
    heading = style.startswith("Heading")
    marked = plain.rlike(r"^[•\-*○]")
    first = F.regexp_extract(plain, r"^(\S+)", 1)
    numbered = first.rlike(r"^\d+\.*$")
    marker = F.when(~marked & numbered, first).otherwise("-")
    hashes = F.repeat(F.lit("#"), F.coalesce(heading_number(style), F.lit(1)))
    kind = (
        F.when(heading, "heading").when(style.startswith("List") | marked, "list")
        .otherwise("paragraph")
    )
    part = (
        F.when(heading, F.concat(F.lit("\n"), hashes, F.lit(" "), text, F.lit("\n")))
        .when(kind == "list", F.concat_ws(" ", marker, text))
        .otherwise(text)
    )
    return paragraphs.where((text != "") & (plain != "")).withColumn("kind", kind).withColumn("part", part)


def assemble_styled_doc(paragraphs: DataFrame, tables: DataFrame) -> DataFrame:
    """(doc, para, text, plain, style) and (doc, para, markdown) in order to one text per doc."""
    number = F.row_number().over(Window.partitionBy("doc").orderBy("para"))
    tabs = (
        tables.where(F.col("markdown") != "")
        .withColumn("part", F.format_string("\n[Table %d]\n%s\n", number, "markdown"))
        .select("doc", "para", F.lit("table").alias("kind"), "part")
    )
    parts = classify_paragraphs(paragraphs).select("doc", "para", "kind", "part").unionByName(tabs)
    return parts.groupBy("doc").agg(
        joined("part", "\n", "para, kind").alias("text"),
        *[
            F.count_if(F.col("kind") == k).alias(f"{k}_count")
            for k in ("paragraph", "heading", "table", "list")
        ],
    )


def heading_outline(paragraphs: DataFrame) -> DataFrame:
    """Headings with a numeric level, in order."""
    level = heading_number(F.col("style"))
    return paragraphs.where(
        F.col("style").startswith("Heading") & level.isNotNull() & (F.col("plain") != "")
    ).select("doc", "para", level.alias("level"), F.col("plain").alias("text"))


def slide_titles(shapes: DataFrame) -> DataFrame:
    """The first title placeholder of each slide."""
    first = strip(F.min_by("text", F.when(F.col("is_title"), F.col("seq"))))
    return shapes.groupBy("doc", "slide").agg(
        F.coalesce(F.nullif(first, F.lit("")), F.lit("[Untitled Slide]")).alias("title")
    )


def chapter_titles(chapters: DataFrame) -> DataFrame:
    title = F.nullif(strip(F.col("title")), F.lit(""))
    return chapters.select(
        "book", "seq", F.coalesce(title, F.lit("[Untitled Chapter]")).alias("title")
    )
