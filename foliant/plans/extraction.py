"""Extraction queries; words, cells, shapes and runs are derived from the driver's texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import extract as E
from . import files as PF
from . import inputs as I
from .registry import query

LINES = """lines AS (
  SELECT conv_id, turn, role, generate_subscripts(l, 1) - 1 AS seq, unnest(l) AS line
  FROM (SELECT conv_id, turn, role, string_split(text, chr(10)) AS l FROM conversations))"""
WORDS = f"""words AS (
  SELECT conv_id AS doc, turn + 1 AS page, role, generate_subscripts(w, 1) - 1 AS seq, unnest(w) AS text
  FROM (SELECT conv_id, turn, role, {I.words_sql("text")} AS w FROM conversations))"""
PAGE_WORDS = f"""{WORDS}, page_words AS (
  SELECT *, ((seq // 10) * 6 + (seq // 40) * 10)::DOUBLE AS top,
         ((seq // 10) * 6 + (seq // 40) * 10 + 4)::DOUBLE AS bottom, (seq % 10) * 50.0::DOUBLE AS x0
  FROM words)"""
BLOCKS = f"""{PAGE_WORDS}, blocks AS (
  SELECT doc, page, block, string_agg(text, ' ' ORDER BY seq) AS text, arg_min(top, seq) AS y_start,
         arg_max(bottom, seq) AS y_end
  FROM (SELECT *, sum(jump) OVER (PARTITION BY doc, page ORDER BY seq) AS block FROM (
    SELECT *, coalesce((abs(top - lag(bottom) OVER (PARTITION BY doc, page ORDER BY seq)) >= 5)::INT, 0) AS jump
    FROM page_words)) GROUP BY doc, page, block)"""
HEADING_SQL = r"""(len(t) < 100 AND ((regexp_matches(t, '\p{Lu}') AND NOT regexp_matches(t, '[\p{Ll}\p{Lt}]'))
  OR (regexp_matches(t, '[\p{Lu}\p{Lt}]') AND NOT regexp_matches(t, '[\p{Lu}\p{Ll}\p{Lt}][\p{Lu}\p{Lt}]')
      AND NOT regexp_matches(t, '(^|[^\p{Lu}\p{Ll}\p{Lt}])\p{Ll}'))))"""
SHAPES = f"""{LINES}, shapes AS (
  SELECT conv_id AS doc, turn + 1 AS slide, seq, seq % 4 = 0 AS is_title, {I.strip_sql("line")} AS text,
         CASE WHEN turn % 2 = 1 THEN role END AS notes FROM lines)"""
OCR_PAGES = f"""{WORDS}, ocr_words AS (
  SELECT doc, page, seq, text,
         (CASE WHEN seq % 13 = 5 THEN -1 ELSE (seq * 7 + doc * 11) % 60 + (doc % 4) * 12 END)::DOUBLE AS conf
  FROM words),
ocr_pages AS (
  SELECT doc, page, coalesce(string_agg(text, ' ' ORDER BY seq) FILTER (conf >= 0), '') AS text,
         coalesce(avg(conf) FILTER (conf >= 0), 0) AS confidence, count(*) FILTER (conf >= 0) AS word_count
  FROM ocr_words GROUP BY doc, page)"""
RUNS = f"""{LINES}, runs AS (
  SELECT conv_id AS doc, para, run, text || ' ' AS text, run % 5 = 0 AS bold, run % 7 = 0 AS italic,
         CASE WHEN run % 11 = 0 THEN 'DejaVu Mono' END AS font, style
  FROM (SELECT conv_id, turn * 1000 + seq AS para, generate_subscripts(w, 1) - 1 AS run, unnest(w) AS text,
               CASE seq % 6 WHEN 0 THEN 'Heading 2' WHEN 1 THEN 'Heading' WHEN 2 THEN 'List Bullet'
                 WHEN 3 THEN 'List Number' ELSE 'Normal' END AS style
        FROM (SELECT conv_id, turn, seq, {I.words_sql("CASE WHEN seq % 6 = 3 THEN seq || '. ' || line ELSE line END")} AS w FROM lines))),
marked AS (SELECT *, CASE WHEN bold AND italic THEN '***' || text || '***' WHEN bold THEN '**' || text || '**'
  WHEN italic THEN '*' || text || '*' ELSE text END AS styled FROM runs),
paragraphs AS (
  SELECT doc, para, any_value(style) AS style, trim(string_agg(text, '' ORDER BY run)) AS plain,
         trim(string_agg(CASE WHEN font IS NOT NULL THEN '`' || styled || '`' ELSE styled END, '' ORDER BY run)) AS text
  FROM marked GROUP BY doc, para)"""
CELLS = """cells AS (
  SELECT o_custkey AS tbl, o_orderkey AS row, unnest([0, 1, 2]) AS col,
         unnest([o_orderstatus, CASE WHEN o_totalprice > 90000 THEN floor(o_totalprice)::INT::VARCHAR END,
                 strftime(o_orderdate, '%Y-%m-%d')]) AS cell FROM orders
  UNION ALL SELECT o_custkey, o_orderkey, 3, '**' || o_orderpriority || '**' FROM orders WHERE o_orderkey % 2 = 0
  UNION ALL SELECT o_custkey, -o_orderkey - 1, 0, '' FROM orders WHERE o_orderstatus = 'O')"""


def markdown_sql(width: str) -> str:
    """Aligned markdown of ``cells``; ``width`` measures a cell."""
    return f"""rows AS (SELECT tbl, row FROM cells GROUP BY ALL HAVING max(len(coalesce(cell, ''))) > 0),
    used AS (SELECT c.tbl, c.row, c.col, coalesce(c.cell, '') AS cell FROM cells c JOIN rows USING (tbl, row)),
    widths AS (SELECT tbl, col, max({width}) AS w FROM used GROUP BY ALL),
    full_grid AS (SELECT r.tbl, r.row, w.col, w.w, coalesce(u.cell, '') AS cell
                  FROM rows r JOIN widths w ON w.tbl = r.tbl
                  LEFT JOIN used u ON u.tbl = r.tbl AND u.row = r.row AND u.col = w.col),
    lines AS (SELECT tbl, row, '| ' || string_agg(cell || repeat(' ', w - {width}), ' | ' ORDER BY col) || ' |' AS line,
                     '|' || string_agg(repeat('-', w + 2), '|' ORDER BY col) || '|' AS rule
              FROM full_grid GROUP BY ALL),
    tables AS (SELECT tbl, string_agg(CASE WHEN n = 1 AND total > 1 THEN line || chr(10) || rule ELSE line END,
                                      chr(10) ORDER BY row) AS markdown, count(*) AS row_count
      FROM (SELECT *, row_number() OVER (PARTITION BY tbl ORDER BY row) AS n, count(*) OVER (PARTITION BY tbl) AS total
            FROM lines) GROUP BY tbl)"""


def lines(spark, sf):
    return I.table(spark, sf, "conversations").select(
        "conv_id", "turn", "role", F.posexplode(F.split("text", "\n")).alias("seq", "line")
    )


def words(spark, sf):
    return I.table(spark, sf, "conversations").select(
        F.col("conv_id").alias("doc"),
        (F.col("turn") + 1).alias("page"),
        "role",
        F.posexplode(X.words(F.col("text"))).alias("seq", "text"),
    )


def page_words(spark, sf):
    """Words laid out ten to a line, with a wider gap after every fourth line."""
    seq = F.col("seq")
    top = (F.floor(seq / 10) * 6 + F.floor(seq / 40) * 10).cast("double")
    return words(spark, sf).select(
        "*", top.alias("top"), (top + 4).alias("bottom"),
        ((seq % 10) * 50.0).alias("x0"), F.lit(500.0).alias("page_width"),
    )


def shapes(spark, sf):
    return lines(spark, sf).select(
        F.col("conv_id").alias("doc"),
        (F.col("turn") + 1).alias("slide"),
        "seq",
        (F.col("seq") % 4 == 0).alias("is_title"),
        F.col("line").alias("text"),
        F.when(F.col("turn") % 2 == 1, F.col("role")).alias("notes"),
    )


def ocr_words(spark, sf):
    seq, doc = F.col("seq"), F.col("doc")
    conf = F.when(seq % 13 == 5, -1).otherwise((seq * 7 + doc * 11) % 60 + (doc % 4) * 12)
    return words(spark, sf).withColumn("conf", conf.cast("double"))


def runs(spark, sf):
    kind = F.col("seq") % 6
    style = (
        F.when(kind == 0, "Heading 2").when(kind == 1, "Heading").when(kind == 2, "List Bullet")
        .when(kind == 3, "List Number").otherwise("Normal")
    )
    text = F.when(kind == 3, F.concat("seq", F.lit(". "), "line")).otherwise(F.col("line"))
    run = F.col("run")
    return (
        lines(spark, sf)
        .select(
            F.col("conv_id").alias("doc"), (F.col("turn") * 1000 + F.col("seq")).alias("para"),
            style.alias("style"), F.posexplode(X.words(text)).alias("run", "word"),
        )
        .select(
            "doc", "para", "run", "style", F.concat("word", F.lit(" ")).alias("text"),
            (run % 5 == 0).alias("bold"), (run % 7 == 0).alias("italic"),
            F.when(run % 11 == 0, "DejaVu Mono").alias("font"),
        )
    )


def cells(spark, sf):
    """A customer's orders as a table: a ragged fourth column, missing cells, empty rows."""
    o = I.table(spark, sf, "orders")
    price = F.floor("o_totalprice").cast("int").cast("string")
    values = F.array(
        F.col("o_orderstatus"),
        F.when(F.col("o_totalprice") > 90000, price),
        F.date_format("o_orderdate", "yyyy-MM-dd"),
        F.concat(F.lit("**"), "o_orderpriority", F.lit("**")),
    )
    ragged = F.when(F.col("o_orderkey") % 2 == 0, values).otherwise(F.slice(values, 1, 3))
    body = o.select(
        F.col("o_custkey").alias("tbl"), F.col("o_orderkey").alias("row"),
        F.posexplode(ragged).alias("col", "cell"),
    )
    empty = o.where("o_orderstatus = 'O'").select(
        F.col("o_custkey").alias("tbl"), (-F.col("o_orderkey") - 1).alias("row"),
        F.lit(0).alias("col"), F.lit("").alias("cell"),
    )
    return body.unionByName(empty)


def unescape_sql(c: str) -> str:
    """The character references that occur in the pages."""
    for name, char in [("quot", '"'), ("copy", "©"), ("middot", "·"), ("amp", "&")]:
        c = f"replace({c}, '&{name};', '{char}')"
    return c


@query(
    f"""WITH t AS (SELECT page_id, {I.strip_sql(unescape_sql("regexp_extract(html, '(?s)<title>(.*?)</title>', 1)"))} AS title,
      list_filter(list_transform(string_split(regexp_replace(regexp_replace(html,
          '(?s)<script.*?</script>|<style.*?</style>|<!--.*?-->', chr(10), 'g'), '(?s)<[^>]*>', chr(10), 'g'), chr(10)),
        lambda x: {I.strip_sql(unescape_sql("x"))}), lambda x: x <> '') AS l FROM pages)
    SELECT page_id, title, len(array_to_string(l, chr(10))) AS char_count, md5(array_to_string(l, chr(10))) AS text_md5 FROM t"""
)
def html_pages(spark, sf):
    """HTML to title, visible text and length."""
    return E.html_to_text(I.texts(spark, sf, "pages")).select(
        "page_id", "title", "char_count", F.md5("text").alias("text_md5")
    )


@query(
    f"""WITH {LINES}, kept AS (
      SELECT conv_id, turn * 1000 + seq AS seq, line, CASE WHEN seq % 2 = 0 THEN left(line, 8) ELSE '' END AS title,
        row_number() OVER (PARTITION BY conv_id ORDER BY turn * 1000 + seq) AS n FROM lines WHERE line <> '')
    SELECT conv_id AS book, count(*) AS chapters, string_agg('[Chapter ' || n || ']' || chr(10) ||
      (CASE WHEN title <> '' THEN 'Title: ' || title || chr(10) ELSE '' END) || line, chr(10) || chr(10) ORDER BY n) AS text
    FROM kept GROUP BY conv_id"""
)
def assembled_chapters(spark, sf):
    """Chapters numbered and joined per book."""
    return E.assemble_chapters(_chapters(spark, sf))


def _chapters(spark, sf):
    return lines(spark, sf).select(
        F.col("conv_id").alias("book"),
        (F.col("turn") * 1000 + F.col("seq")).alias("seq"),
        F.when(F.col("seq") % 2 == 0, F.left("line", F.lit(8))).otherwise("").alias("title"),
        F.col("line").alias("text"),
    )


@query(
    f"""WITH {SHAPES}, s AS (
      SELECT doc, slide, coalesce(arg_max(text, seq) FILTER (is_title AND text <> ''), '') AS title,
        string_agg('  ' || text, chr(10) ORDER BY seq) FILTER (NOT is_title AND text <> '') AS content,
        coalesce(any_value(notes), '') AS notes, count(*) AS shape_count FROM shapes GROUP BY doc, slide)
    SELECT doc, slide, title, shape_count, notes <> '' AS has_notes,
      concat_ws(chr(10), '[Slide ' || slide || ']', CASE WHEN title <> '' THEN 'Title: ' || title END,
        'Content:' || chr(10) || content, CASE WHEN notes <> '' THEN 'Notes: ' || notes END) AS text FROM s"""
)
def assembled_slides(spark, sf):
    """Shapes to slides."""
    return E.assemble_slides(shapes(spark, sf)).select(
        "doc", "slide", "title", "shape_count", "has_notes", "text"
    )


@query(f"WITH {BLOCKS} SELECT doc, page, block::BIGINT AS block, text, y_start, y_end FROM blocks")
def word_blocks(spark, sf):
    """Words to text blocks by vertical distance."""
    return E.group_words_into_blocks(page_words(spark, sf))


@query(
    f"""WITH {BLOCKS} SELECT doc, page, string_agg(CASE WHEN {HEADING_SQL} THEN chr(10) || t || chr(10) ELSE t END,
      chr(10) || chr(10) ORDER BY block) AS text FROM (SELECT *, {I.strip_sql("text")} AS t FROM blocks)
    WHERE t <> '' GROUP BY doc, page"""
)
def page_text(spark, sf):
    """Blocks to page text, headings set apart."""
    return E.blocks_to_text(E.group_words_into_blocks(page_words(spark, sf)))


@query(
    f"""WITH {PAGE_WORDS} SELECT doc, page, count(*) AS words, count(*) >= 20
      AND count(*) FILTER (x0 < 200) > count(*) * 0.3 AND count(*) FILTER (x0 > 300) > count(*) * 0.3 AS has_columns
    FROM page_words GROUP BY doc, page"""
)
def page_columns(spark, sf):
    """Multi-column pages."""
    return E.detect_columns(page_words(spark, sf))


@query(
    f"WITH {CELLS}, {markdown_sql('len(cell)')} SELECT tbl, markdown, row_count FROM tables"
)
def markdown_tables(spark, sf):
    """Cells to aligned markdown tables."""
    return E.table_to_markdown(cells(spark, sf), ["tbl"]).select("tbl", "markdown", "row_count")


STYLED_WIDTH = "len(replace(replace(cell, '*', ''), '`', ''))"


@query(
    f"WITH {CELLS}, {markdown_sql(STYLED_WIDTH)} SELECT tbl, markdown, row_count FROM tables"
)
def markdown_styled_tables(spark, sf):
    """The variant that leaves formatting marks out of the widths."""
    out = E.table_to_markdown(cells(spark, sf), ["tbl"], ignore_marks=True)
    return out.select("tbl", "markdown", "row_count")


@query(
    f"""WITH {LINES}, parts AS (
      SELECT conv_id AS doc, turn + 1 AS page, 0 AS kind, 0 AS n, text AS part FROM conversations WHERE turn % 3 <> 2
      UNION ALL SELECT conv_id, turn + 1, 1, seq, chr(10) || '[Table ' || seq + 1 || ']' || chr(10) || line || chr(10) || '' FROM lines
        WHERE seq % 5 = 1
      UNION ALL SELECT conv_id, turn + 1, 2, seq, chr(10) || '[Figure: ' || seq || ']' || chr(10) FROM lines WHERE seq % 7 = 2),
    pages AS (SELECT doc, page, string_agg(part, chr(10) ORDER BY kind, n) AS text FROM parts GROUP BY ALL)
    SELECT doc, string_agg(chr(10) || '[Page ' || page || ']' || chr(10) || text, chr(10) ORDER BY page) AS text
    FROM pages WHERE text <> '' GROUP BY doc"""
)
def assembled_pages(spark, sf):
    """Page texts, tables and figures to one text per document."""
    page = (F.col("turn") + 1).alias("page")
    doc = F.col("conv_id").alias("doc")
    line = lines(spark, sf)
    return E.assemble_pages(
        I.table(spark, sf, "conversations").where("turn % 3 <> 2").select(doc, page, "text"),
        line.where("seq % 5 = 1").select(
            doc, page, F.col("seq").alias("table"), F.col("line").alias("markdown")
        ),
        line.where("seq % 7 = 2").select(doc, page, F.col("seq").alias("image")),
    )


@query(
    """SELECT conv_id AS doc, count(*) AS page_count, sum(len(text)) / count(*) < 50 AS is_scanned,
       sum(turn % 2) > 0 AS has_tables, sum((role = 'system')::INT) > 0 AS has_images
       FROM conversations GROUP BY conv_id"""
)
def scanned_documents(spark, sf):
    """Documents with too little text per page."""
    return E.detect_scanned(
        I.table(spark, sf, "conversations").select(
            F.col("conv_id").alias("doc"), (F.col("turn") + 1).alias("page"),
            F.length("text").alias("chars"), (F.col("turn") % 2).alias("n_tables"),
            (F.col("role") == "system").cast("int").alias("n_images"),
        )
    )


@query(
    f"""WITH {OCR_PAGES} SELECT doc, page, text, round(confidence, 6) AS confidence, word_count,
    confidence < 70 AS low_confidence FROM ocr_pages"""
)
def ocr_pages(spark, sf):
    """Scanned words to page text and confidence."""
    return E.ocr_words_to_pages(ocr_words(spark, sf)).withColumn(
        "confidence", F.round("confidence", 6)
    )


@query(
    f"""WITH {OCR_PAGES} SELECT doc, round(avg(confidence), 6) AS ocr_confidence,
    sum(word_count)::BIGINT AS total_words, count(*) FILTER (confidence < 70) AS low_confidence_pages,
    count(*) AS page_count FROM ocr_pages GROUP BY doc"""
)
def ocr_documents(spark, sf):
    """X11: page results to document results."""
    out = E.ocr_doc_summary(E.ocr_words_to_pages(ocr_words(spark, sf)))
    return out.withColumn("ocr_confidence", F.round("ocr_confidence", 6))


@query(
    f"""WITH {PF.OCR_FILES}, d AS (SELECT *, CASE WHEN pages > 100 THEN 200 WHEN size_mb < 5 THEN 300
      WHEN size_mb < 20 THEN CASE WHEN pages < 20 THEN 300 ELSE 250 END
      WHEN size_mb < 40 THEN 250 ELSE 200 END AS d FROM ocr_files),
    t AS (SELECT *, pages * CASE WHEN d <= 150 THEN 1.5 WHEN d <= 200 THEN 2.0 WHEN d <= 250 THEN 3.0 ELSE 4.5 END::DOUBLE
      AS estimated_seconds FROM d)
    SELECT file_id, CASE WHEN estimated_seconds > 480 THEN 200 ELSE d END AS dpi, estimated_seconds FROM t"""
)
def ocr_plan(spark, sf):
    """Scan resolution and time estimate."""
    return E.plan_ocr(PF.ocr_files(spark, sf)).select("file_id", "dpi", "estimated_seconds")


@query(
    f"""WITH {OCR_PAGES}, o AS (
      SELECT doc, string_agg(text, ' ' ORDER BY page) AS ocr_text FROM ocr_pages WHERE doc % 5 <> 0 GROUP BY doc),
    d AS (SELECT conv_id AS doc, string_agg(left(text, 60 + (turn * 10)::INT), ' ' ORDER BY turn) AS text,
      conv_id % 3 <> 0 AS is_scanned, count(*) AS page_count FROM conversations GROUP BY conv_id),
    j AS (SELECT d.*, ocr_text, is_scanned AND ocr_text IS NOT NULL
      AND (len(ocr_text) > len(text) * 1.5 OR len(text) < 100 * page_count) AS use FROM d LEFT JOIN o ON o.doc = d.doc)
    SELECT doc, CASE WHEN use THEN ocr_text ELSE text END AS text, CASE WHEN use THEN 'ocr' ELSE 'standard' END
      AS extraction_method FROM j"""
)
def chosen_text(spark, sf):
    """Text layer or OCR text."""
    t = I.table(spark, sf, "conversations").withColumn(
        "part", F.left("text", (F.col("turn") * 10 + 60).cast("int"))
    )
    docs = t.groupBy(F.col("conv_id").alias("doc")).agg(
        E.joined("part", " ", "turn").alias("text"), F.count("*").alias("page_count")
    )
    ocr = E.ocr_words_to_pages(ocr_words(spark, sf)).where("doc % 5 <> 0")
    return E.choose_text_layer(
        docs.withColumn("is_scanned", F.col("doc") % 3 != 0),
        ocr.groupBy("doc").agg(E.joined("text", " ", "page").alias("ocr_text")),
    ).select("doc", "text", "extraction_method")


@query(
    f"""WITH {OCR_PAGES}, poor AS (SELECT doc FROM ocr_pages GROUP BY doc HAVING avg(confidence) < 50),
    c AS (SELECT doc, page, CASE page % 3 WHEN 0 THEN 'short' WHEN 1 THEN text ELSE 'Corrected ' || text END AS offer
          FROM ocr_pages WHERE page % 5 <> 4),
    r AS (SELECT p.doc, p.page, p.text, p.confidence, c.offer,
      poor.doc IS NOT NULL AND p.confidence < 50 AND p.text <> '' AS corrected
      FROM ocr_pages p LEFT JOIN poor ON poor.doc = p.doc LEFT JOIN c ON c.doc = p.doc AND c.page = p.page)
    SELECT doc, page, corrected, CASE WHEN corrected AND len(trim(text)) >= 10 AND len(offer) > 10 AND offer <> text
      THEN offer ELSE text END AS text,
      round(CASE WHEN corrected THEN least(confidence + 20, 90) ELSE confidence END, 6) AS confidence FROM r"""
)
def corrected_pages(spark, sf):
    """Supplied corrections for poorly read pages."""
    pages = E.ocr_words_to_pages(ocr_words(spark, sf))
    kind = F.col("page") % 3
    offers = pages.where("page % 5 <> 4").select(
        "doc", "page",
        F.when(kind == 0, "short").when(kind == 1, F.col("text"))
        .otherwise(F.concat(F.lit("Corrected "), "text")).alias("text"),
    )
    return E.apply_corrections(pages, offers).withColumn("confidence", F.round("confidence", 6))


@query(
    f"""WITH RECURSIVE s AS MATERIALIZED (
      SELECT doc_id, generate_subscripts(p, 1) AS i, unnest(p) AS s FROM (
        SELECT doc_id, string_split(text, '. ') AS p FROM documents)),
    walk AS (
      SELECT doc_id, 0::BIGINT AS i, 0::BIGINT AS piece, 0::BIGINT AS open FROM documents
      UNION ALL
      SELECT s.doc_id, s.i, CASE WHEN w.open + len(s.s) < 500 OR w.open = 0 THEN w.piece ELSE w.piece + 1 END,
        CASE WHEN w.open + len(s.s) < 500 THEN w.open + len(s.s) + 2 ELSE len(s.s) + 2 END
      FROM walk w JOIN s ON s.doc_id = w.doc_id AND s.i = w.i + 1)
    SELECT w.doc_id, w.piece AS pos, {I.strip_sql("string_agg(s.s || '. ', '' ORDER BY w.i)")} AS piece
    FROM walk w JOIN s ON s.doc_id = w.doc_id AND s.i = w.i GROUP BY w.doc_id, w.piece"""
)
def correction_pieces(spark, sf):
    """Sentence pieces for correction (500 characters here)."""
    return I.texts(spark, sf, "documents").select(
        "doc_id", F.posexplode(E.split_for_correction(F.col("text"), 500)).alias("pos", "piece")
    )


@query(f"WITH {RUNS} SELECT doc, para, text, plain, style FROM paragraphs")
def run_markdown(spark, sf):
    """Formatted runs to paragraph markdown."""
    return E.runs_to_markdown(runs(spark, sf))


@query(
    f"""WITH {RUNS}, t AS (SELECT conv_id AS doc, turn * 1000 + 999 AS para, 'role | ' || role AS markdown,
        row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations),
    k AS (SELECT *, regexp_matches(plain, '^[•\\-*○]') AS marked, regexp_extract(plain, '^(\\S+)', 1) AS first,
      CASE WHEN starts_with(style, 'Heading') THEN 'heading' WHEN starts_with(style, 'List')
        OR regexp_matches(plain, '^[•\\-*○]') THEN 'list' ELSE 'paragraph' END AS kind
      FROM paragraphs WHERE text <> '' AND plain <> ''),
    parts AS (
      SELECT doc, para, kind, CASE kind
        WHEN 'heading' THEN chr(10) || (CASE WHEN style = 'Heading 2' THEN '##' ELSE '#' END) || ' ' || text || chr(10)
        WHEN 'list' THEN (CASE WHEN NOT marked AND regexp_matches(first, '^\\d+\\.*$') THEN first ELSE '-' END) || ' ' || text
        ELSE text END AS part FROM k
      UNION ALL SELECT doc, para, 'table', chr(10) || '[Table ' || n || ']' || chr(10) || markdown || chr(10) FROM t)
    SELECT doc, string_agg(part, chr(10) ORDER BY para, kind) AS text,
      count(*) FILTER (kind = 'paragraph') AS paragraph_count, count(*) FILTER (kind = 'heading') AS heading_count,
      count(*) FILTER (kind = 'table') AS table_count, count(*) FILTER (kind = 'list') AS list_count
    FROM parts GROUP BY doc"""
)
def styled_documents(spark, sf):
    """Styled paragraphs and tables to one text per document."""
    tables = I.table(spark, sf, "conversations").select(
        F.col("conv_id").alias("doc"), (F.col("turn") * 1000 + 999).alias("para"),
        F.concat(F.lit("role | "), "role").alias("markdown"),
    )
    return E.assemble_styled_doc(E.runs_to_markdown(runs(spark, sf)), tables)


@query(f"WITH {RUNS} SELECT doc, para, 2 AS level, plain AS text FROM paragraphs WHERE style = 'Heading 2' AND plain <> ''")
def heading_outline(spark, sf):
    """Headings with a numeric level."""
    return E.heading_outline(E.runs_to_markdown(runs(spark, sf)))


@query(
    f"""WITH {SHAPES} SELECT doc, slide, coalesce(nullif(arg_min(text, seq) FILTER (is_title), ''), '[Untitled Slide]')
    AS title FROM shapes GROUP BY doc, slide"""
)
def slide_titles(spark, sf):
    """First title of each slide."""
    return E.slide_titles(shapes(spark, sf))


@query(
    f"""WITH {LINES} SELECT conv_id AS book, turn * 1000 + seq AS seq,
    CASE WHEN seq % 2 = 0 AND {I.strip_sql("left(line, 8)")} <> '' THEN {I.strip_sql("left(line, 8)")}
      ELSE '[Untitled Chapter]' END AS title FROM lines"""
)
def chapter_titles(spark, sf):
    """Chapter titles with a stand-in for missing ones."""
    return E.chapter_titles(_chapters(spark, sf))
