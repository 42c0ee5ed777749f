"""Queries that write documents as packages, read them back, translate them step by step and export them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import checks
from ..functions import text as X
from ..functions.words import count_words, count_words_sql
from ..operators import activity, prompts, sections, tables
from ..sources import build, packages
from ..tables import table, unique_rows
from . import catalog, translate
from .catalog import BLOCKS_SQL, ENTRIES_SQL, JOBS_SQL, PARAGRAPHS_SQL, STATUS_SQL, add

_CELLS = f"""list_transform(list_filter(string_split(text, chr(10)), lambda x: {X.strip_sql("x")} <> ''),
    lambda l: list_transform(string_split(l, '|'), lambda c: {X.strip_sql("c")}))"""
_SCENE = f"regexp_full_match({X.strip_sql('text')}, '(?:[*\\-_=#]\\s*){{3,}}')"
READ_BACK_SQL = f"""CASE WHEN block_type = 'table'
    THEN array_to_string(list_transform({_CELLS}, lambda r: array_to_string(r, chr(9))), chr(10))
    ELSE {X.inline_text_sql("text")} END"""


EXPORTED_SQL = f"""CASE WHEN block_type = 'table'
    THEN array_to_string(list_transform({_CELLS}, lambda r: array_to_string(list_transform(r, lambda c: 'X ' || c), chr(9))), chr(10))
    WHEN block_type IN ('code', 'page_break', 'image') THEN {X.inline_text_sql("text")}
    ELSE 'X ' || {X.inline_text_sql("text")} END"""


def _read(spark: SparkSession, folder: str, fmt: str) -> DataFrame:
    rows = packages.read_blocks(build.packages(catalog._blocks(spark, folder), fmt))
    return rows.where("error is null").select("document_id", "block_index", "block_type", "text", "translatable")


@add(f"""WITH {BLOCKS_SQL},
    q AS (SELECT document_id, block_index AS i, block_id,
                 CASE WHEN block_type IN ('heading', 'list_item', 'quote', 'caption', 'code', 'table', 'page_break', 'image', 'footnote', 'endnote')
                      THEN block_type WHEN {_SCENE} THEN 'special' ELSE 'paragraph' END AS block_type,
                 CASE WHEN block_type = 'image' THEN '' ELSE {READ_BACK_SQL} END AS text FROM b)
    SELECT document_id, row_number() OVER (PARTITION BY document_id ORDER BY i, block_id)::INTEGER AS block_index, block_type, text,
           block_type NOT IN ('code', 'page_break', 'image') AS translatable
    FROM q WHERE text <> '' OR block_type IN ('table', 'page_break', 'image')""")
def html_blocks(spark: SparkSession, folder: str) -> DataFrame:
    """Every document written as a page of HTML and read back."""
    return _read(spark, folder, "html")


@add(f"""WITH {BLOCKS_SQL},
    q AS (SELECT document_id, block_index AS i, block_id,
                 CASE WHEN block_type IN ('heading', 'list_item', 'quote', 'caption', 'code', 'table', 'page_break', 'image', 'footnote', 'endnote')
                      THEN block_type WHEN {_SCENE} THEN 'special' ELSE 'paragraph' END AS block_type,
                 CASE WHEN block_type = 'image' THEN '' ELSE {READ_BACK_SQL} END AS text FROM b)
    SELECT document_id, (1 + row_number() OVER (PARTITION BY document_id ORDER BY i, block_id))::INTEGER AS block_index, block_type, text,
           block_type NOT IN ('code', 'page_break', 'image') AS translatable
    FROM q WHERE text <> '' OR block_type IN ('table', 'page_break', 'image')
    UNION ALL
    SELECT DISTINCT document_id, 1, 'metadata_title', document_id, true FROM b""")
def epub_blocks(spark: SparkSession, folder: str) -> DataFrame:
    """Every document written as an EPUB and read back; the title is its first block."""
    return _read(spark, folder, "epub")


@add(f"""WITH {BLOCKS_SQL},
    q AS (SELECT document_id, CASE WHEN block_type IN ('footnote', 'endnote') THEN 1 ELSE 0 END AS part, block_index AS i, block_id,
                 CASE WHEN block_type = 'endnote' THEN 'footnote' WHEN block_type IN ('table', 'page_break', 'footnote') THEN block_type
                      WHEN {_SCENE} THEN 'special'
                      WHEN block_type IN ('heading', 'list_item', 'quote', 'caption') THEN block_type ELSE 'paragraph' END AS block_type,
                 {READ_BACK_SQL} AS text FROM b WHERE block_type <> 'image')
    SELECT document_id, row_number() OVER (PARTITION BY document_id ORDER BY part, i, block_id)::INTEGER AS block_index, block_type, text,
           block_type <> 'page_break' AS translatable
    FROM q WHERE text <> '' OR block_type IN ('table', 'page_break')""")
def docx_blocks(spark: SparkSession, folder: str) -> DataFrame:
    """Every document written as a DOCX and read back; notes come after the body."""
    return _read(spark, folder, "docx")


@add(f"""WITH {BLOCKS_SQL},
    k AS (SELECT *, {READ_BACK_SQL} AS t, {_SCENE} AS scene,
                 CASE WHEN block_type IN ('footnote', 'endnote', 'image') THEN NULL WHEN block_type = 'table' THEN 'tbl'
                      WHEN block_type = 'list_item' THEN 'sdt' ELSE 'p' END AS tag FROM b),
    n AS (SELECT *, row_number() OVER (PARTITION BY document_id, tag ORDER BY block_index, block_id) AS r,
                 row_number() OVER (PARTITION BY document_id, block_type ORDER BY block_index, block_id) AS note FROM k),
    y AS (SELECT *, 'body/' || tag || '[' || r || ']' || CASE WHEN tag = 'sdt' THEN '/sdtContent/p[1]' ELSE '' END AS place,
                 CASE WHEN scene THEN 'special' WHEN block_type IN ('heading', 'list_item', 'quote', 'caption') THEN block_type ELSE 'paragraph' END AS kind
          FROM n),
    z AS (SELECT document_id, 0 AS part, block_index AS i, block_id, 0 AS sub, kind AS block_type, t AS text, true AS translatable,
                 place || CASE WHEN block_type = 'caption' AND t <> '' THEN '/block[1]' ELSE '' END AS tree_path,
                 CASE block_type WHEN 'heading' THEN 'here' WHEN 'list_item' THEN 'item' WHEN 'quote' THEN 'https://example.org/quoted'
                      WHEN 'caption' THEN 'media/one.png' WHEN 'code' THEN note::VARCHAR ELSE '' END AS mark
          FROM y WHERE tag IN ('p', 'sdt') AND block_type <> 'page_break' AND t <> ''
          UNION ALL
          SELECT document_id, 0, block_index, block_id, 1, 'image', '', false, place || CASE WHEN t <> '' THEN '/block[2]' ELSE '' END, 'media/one.png'
          FROM y WHERE block_type = 'caption'
          UNION ALL
          SELECT document_id, 0, block_index, block_id, 1, 'page_break', '', false, place, '' FROM y WHERE block_type = 'page_break'
          UNION ALL
          SELECT document_id, 0, block_index, block_id, 0, 'table', CASE WHEN t = '' THEN 'outer' ELSE t || chr(10) || 'outer' END, true, place,
                 'header ' || 'merged ' || '1' FROM y WHERE tag = 'tbl'
          UNION ALL
          SELECT document_id, 0, block_index, block_id, 1, 'table', 'inner', true, place || '/nestedTbl[1]', '0' FROM y WHERE tag = 'tbl'
          UNION ALL
          SELECT document_id, CASE block_type WHEN 'footnote' THEN 1 ELSE 2 END, block_index, block_id, 0, block_type, t, true, '', note::VARCHAR
          FROM y WHERE block_type IN ('footnote', 'endnote') AND t <> ''
          UNION ALL
          SELECT document_id, 3, block_index, block_id, 0, 'comment', t, true, '', note::VARCHAR FROM y WHERE block_type = 'code' AND t <> ''
          UNION ALL
          SELECT DISTINCT document_id, 4, 0, '', 0, 'header', document_id, true, '', 'word/header1.xml' FROM b
          UNION ALL
          SELECT DISTINCT document_id, 5, 0, '', 0, 'footer', 'End of ' || document_id, true, '', 'word/footer1.xml' FROM b)
    SELECT document_id, row_number() OVER (PARTITION BY document_id ORDER BY part, i, block_id, sub)::INTEGER AS block_index, block_type, text,
           translatable, tree_path, mark FROM z""")
def docx_parts(spark: SparkSession, folder: str) -> DataFrame:
    """Every document as a DOCX with links, pictures, content controls, comments, notes, nested tables, header and
    footer, read back with the places of its blocks and a mark out of what is known of each."""
    rows = packages.read_blocks(build.packages(catalog._blocks(spark, folder), "docx", parts=True)).where("error is null")

    def at(path: str) -> Column:
        return F.get_json_object("metadata_json", path)

    def word(path: str, name: str) -> Column:
        return F.when(at(path) == "true", f"{name} ").otherwise("")

    kind = F.col("block_type")
    table_mark = F.concat(word("$.has_header_rows", "header"), word("$.has_merged_cells", "merged"), at("$.nested_table_count"))
    mark = (
        F.when(kind == "table", table_mark).when(kind == "image", at("$.target"))
        .when(kind.isin("footnote", "endnote"), at("$.note_id")).when(kind == "comment", at("$.comment_id"))
        .when(kind.isin("header", "footer"), at("$.source_part"))
        .otherwise(F.coalesce(
            at("$.hyperlinks[0].target"), at("$.image_targets[0]"), at("$.content_control.alias"), at("$.comment_ids[0]"), at("$.bookmarks[0].name"), F.lit(""),
        ))
    )
    return rows.select(
        "document_id", "block_index", "block_type", "text", "translatable", F.coalesce("tree_path", F.lit("")).alias("tree_path"), mark.alias("mark")
    )


@add(f"""WITH {BLOCKS_SQL},
    n AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY block_index, block_id) AS r, count(*) OVER (PARTITION BY document_id) AS total FROM b),
    q AS (SELECT document_id, 5 AS part, r AS i,
                 CASE WHEN block_type IN ('heading', 'list_item', 'quote', 'caption', 'code', 'table', 'page_break', 'image', 'footnote', 'endnote')
                      THEN block_type WHEN {_SCENE} THEN 'special' ELSE 'paragraph' END AS block_type,
                 CASE WHEN block_type = 'image' THEN '' ELSE {READ_BACK_SQL} END AS text,
                 CASE WHEN r <= (total + 1) // 2 THEN 'book/p1.xhtml' ELSE 'book/p2.xhtml' END AS source_part,
                 CASE WHEN block_type = 'list_item' THEN 'ol 1' WHEN block_type = 'table' AND {X.strip_sql("text")} <> '' THEN 'header merged ' ELSE '' END AS mark FROM n),
    z AS (SELECT document_id, part, i, block_type, text, block_type NOT IN ('code', 'page_break', 'image') AS translatable, source_part, mark
          FROM q WHERE text <> '' OR block_type IN ('table', 'page_break', 'image')
          UNION ALL SELECT DISTINCT document_id, 0, 1, 'metadata_title', document_id, true, 'book/book.opf', 'title' FROM b
          UNION ALL SELECT DISTINCT document_id, 1, 1, 'metadata_creator', 'Someone', false, 'book/book.opf', 'creator' FROM b
          UNION ALL SELECT DISTINCT document_id, 1, 2, 'metadata_language', 'en', false, 'book/book.opf', 'language' FROM b
          UNION ALL SELECT DISTINCT document_id, 2, 1, 'metadata_description', 'About ' || document_id, true, 'book/book.opf', 'description' FROM b
          UNION ALL SELECT DISTINCT document_id, 3, 1, 'image', '', false, 'book/book.opf', 'cover c1' FROM b
          UNION ALL SELECT DISTINCT document_id, 4, 1, 'toc', 'Contents', false, 'book/nav.xhtml', '' FROM b)
    SELECT document_id, row_number() OVER (PARTITION BY document_id ORDER BY part, i)::INTEGER AS block_index, block_type, text, translatable, source_part, mark
    FROM z""")
def epub_parts(spark: SparkSession, folder: str) -> DataFrame:
    """Every document as a book of two pages with metadata, cover, navigation and hidden text, read back."""
    rows = packages.read_blocks(build.packages(catalog._blocks(spark, folder), "epub", parts=True)).where("error is null")

    def at(path: str) -> Column:
        return F.get_json_object("metadata_json", path)

    def word(path: str, name: str) -> Column:
        return F.when(at(path) == "true", f"{name} ").otherwise("")

    kind = F.col("block_type")
    mark = (
        F.when(kind == "list_item", F.concat_ws(" ", at("$.list_type"), at("$.list_level")))
        .when(kind == "table", F.concat(word("$.has_header_cells", "header"), word("$.has_merged_cells", "merged")))
        .when(at("$.is_cover") == "true", F.concat(F.lit("cover "), at("$.manifest_id")))
        .otherwise(F.coalesce(at("$.metadata_field"), F.lit("")))
    )
    return rows.select("document_id", "block_index", "block_type", "text", "translatable", "source_part", mark.alias("mark"))


_PLAIN_SQL = f"""
    d AS (SELECT DISTINCT document_id, text FROM documents),
    r AS (SELECT document_id, list_filter(list_transform(string_split({X.strip_sql("text")}, chr(10) || chr(10)), lambda x: {X.strip_sql("x")}), lambda x: x <> '') AS ps FROM d),
    q AS (SELECT document_id, unnest(ps) AS text, generate_subscripts(ps, 1) AS i FROM r)"""


def _text_files(spark: SparkSession, folder: str) -> DataFrame:
    rows = unique_rows(table(spark, folder, "documents").select("document_id", "text"), "document_id")
    return rows.select(
        "document_id", F.col("document_id").alias("path"), F.lit("txt").alias("source_format"),
        F.encode(F.coalesce("text", F.lit("")), "utf-8").alias("content"), F.lit(None).cast("string").alias("error"),
    )


@add(f"""WITH {_PLAIN_SQL} SELECT document_id, i::INTEGER AS block_index, {X.numbered_sql("b", "i")} AS block_id, text FROM q""")
def txt_blocks(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's text as a file of plain text, read into blocks."""
    return packages.read_blocks(_text_files(spark, folder)).select("document_id", "block_index", "block_id", "text")


@add(f"""WITH {_PLAIN_SQL}
    SELECT document_id, string_agg(CASE WHEN length(text) > 80 THEN 'X ' || text ELSE text END, chr(10) || chr(10) ORDER BY i) AS text,
           count(*)::INTEGER AS translatable_block_count, count(*) FILTER (WHERE length(text) > 80)::INTEGER AS applied_unit_count FROM q GROUP BY document_id""")
def txt_exports(spark: SparkSession, folder: str) -> DataFrame:
    """Files of plain text whose longer blocks are translated; what has no translation stays."""
    files = _text_files(spark, folder)
    read = packages.read_blocks(files).where("length(text) > 80")
    given = read.select("document_id", "block_id", F.concat(F.lit("X "), "text").alias("translated_text"), F.lit(None).cast("array<array<string>>").alias("table_rows"))
    out = packages.exported(files, given).where("error is null and translatable_block_count > 0")
    return out.select("document_id", F.decode("content", "utf-8").alias("text"), "translatable_block_count", "applied_unit_count")


@add(f"""WITH RECURSIVE {_PLAIN_SQL},
    w AS (SELECT document_id, i, {count_words_sql("text")} AS words FROM q),
    s AS (SELECT document_id, i, words AS filled, 1 AS section FROM w WHERE i = 1
          UNION ALL
          SELECT w.document_id, w.i, CASE WHEN s.filled + w.words > {sections.DEFAULT_TARGET} THEN w.words ELSE s.filled + w.words END,
                 s.section + CASE WHEN s.filled + w.words > {sections.DEFAULT_TARGET} THEN 1 ELSE 0 END
          FROM s JOIN w ON w.document_id = s.document_id AND w.i = s.i + 1),
    n AS (SELECT document_id, max(section) AS section_count FROM s GROUP BY document_id)
    SELECT document_id, count(*) AS block_count, sum(words)::BIGINT AS word_count, any_value(section_count)::INTEGER AS section_count
    FROM w JOIN n USING (document_id) GROUP BY document_id""")
def created_documents(spark: SparkSession, folder: str) -> DataFrame:
    """What becomes of a file that comes in: its blocks, words and sections of the usual size."""
    read = packages.read_blocks(_text_files(spark, folder)).where("translatable")
    units = read.select("document_id", F.col("block_index").alias("n"), count_words(F.col("text")).alias("words"))
    targets = units.select("document_id").distinct().withColumn("target", F.lit(sections.DEFAULT_TARGET))
    planned = sections.sectioned(units, targets).groupBy("document_id").agg(F.max("section").alias("section_count"))
    counts = units.groupBy("document_id").agg(F.count("*").alias("block_count"), F.sum("words").alias("word_count"))
    return counts.join(planned, "document_id")


@add(f"""WITH {BLOCKS_SQL}, t AS (SELECT document_id, block_id, unnest(regexp_split_to_array(text, '[;\\n]')) AS entry FROM b WHERE block_type = 'table'),
    e AS (SELECT document_id, block_id, {X.strip_sql("regexp_extract(entry, '^(.*?)[\\s,.|]*(\\d{1,4}[A-Za-z]?)\\s*$', 1)")} AS title,
                 regexp_extract(entry, '^(.*?)[\\s,.|]*(\\d{{1,4}}[A-Za-z]?)\\s*$', 2) AS page FROM t)
    SELECT * FROM e WHERE page <> '' AND title <> ''""")
def contents_entries(spark: SparkSession, folder: str) -> DataFrame:
    """The entries (title and page) that tables would have as lists of contents."""
    return tables.contents_entries(catalog._blocks(spark, folder).where("block_type = 'table'"))


def _translated(spark: SparkSession, folder: str, fmt: str) -> DataFrame:
    files = build.packages(catalog._blocks(spark, folder), fmt)
    read = packages.read_blocks(files).where("translatable and text <> ''")
    rows = tables.rows_of(F.replace("text", F.lit("\t"), F.lit("|")))
    given = read.select(
        "document_id", "block_id",
        F.when(F.col("block_type") != "table", F.concat(F.lit("X "), "text")).alias("translated_text"),
        F.when(F.col("block_type") == "table", F.transform(rows, lambda r: F.transform(r, lambda c: F.concat(F.lit("X "), c)))).alias("table_rows"),
    )
    out = packages.exported(files, given)
    back = packages.read_blocks(out.select("document_id", "path", "source_format", "content", "error"))
    return back.where("error is null").select("document_id", "block_index", "block_type", "text")


@add(f"""WITH {BLOCKS_SQL},
    q AS (SELECT document_id, block_index AS i, block_id, {READ_BACK_SQL} AS old,
                 CASE WHEN block_type IN ('heading', 'list_item', 'quote', 'caption', 'code', 'table', 'page_break', 'image', 'footnote', 'endnote')
                      THEN block_type ELSE 'paragraph' END AS block_type,
                 CASE WHEN block_type = 'image' THEN '' ELSE {EXPORTED_SQL} END AS text FROM b)
    SELECT document_id, (1 + row_number() OVER (PARTITION BY document_id ORDER BY i, block_id))::INTEGER AS block_index, block_type, text
    FROM q WHERE old <> '' OR block_type IN ('table', 'page_break', 'image')
    UNION ALL
    SELECT DISTINCT document_id, 1, 'metadata_title', 'X ' || document_id FROM b""")
def epub_exports(spark: SparkSession, folder: str) -> DataFrame:
    """EPUBs with every block replaced by its text under a mark, read back."""
    return _translated(spark, folder, "epub")


@add(f"""WITH {BLOCKS_SQL},
    q AS (SELECT document_id, CASE WHEN block_type IN ('footnote', 'endnote') THEN 1 ELSE 0 END AS part, block_index AS i, block_id,
                 {READ_BACK_SQL} AS old,
                 CASE WHEN block_type = 'endnote' THEN 'footnote'
                      WHEN block_type IN ('table', 'page_break', 'footnote', 'heading', 'list_item', 'quote', 'caption') THEN block_type
                      ELSE 'paragraph' END AS block_type,
                 CASE WHEN block_type = 'code' THEN 'X ' || {X.inline_text_sql("text")} ELSE {EXPORTED_SQL} END AS text
          FROM b WHERE block_type <> 'image')
    SELECT document_id, row_number() OVER (PARTITION BY document_id ORDER BY part, i, block_id)::INTEGER AS block_index, block_type, text
    FROM q WHERE old <> '' OR block_type IN ('table', 'page_break')""")
def docx_exports(spark: SparkSession, folder: str) -> DataFrame:
    """DOCX packages with every block replaced by its text under a mark, read back."""
    return _translated(spark, folder, "docx")


def _part_exports(spark: SparkSession, folder: str, fmt: str, tokens: bool = True) -> DataFrame:
    """Packages with parts, every translatable block replaced by its text under a mark, with or without its inline
    tokens, read back."""
    files = build.packages(catalog._blocks(spark, folder), fmt, parts=True)
    read = packages.read_blocks(files).where("translatable and text <> ''")
    cells = F.from_json(F.get_json_object("metadata_json", "$.rows"), "array<array<string>>")
    is_table = F.col("block_type") == "table"
    given = read.select(
        "document_id", "block_id",
        F.when(~is_table, F.concat(F.lit("X "), F.coalesce("inline_source_text", "text") if tokens else F.col("text"))).alias("translated_text"),
        F.when(is_table, F.transform(cells, lambda r: F.transform(r, lambda c: F.concat(F.lit("X "), c)))).alias("table_rows"),
    )
    out = packages.exported(files, given)
    back = packages.read_blocks(out.select("document_id", "path", "source_format", "content", "error"))
    counts = out.select("document_id", (F.col("applied_unit_count") == F.col("translatable_block_count")).alias("all_applied"))
    return back.where("error is null").select("document_id", "block_index", "block_type", "text").join(counts, "document_id")


_X_CELLS = f"array_to_string(list_transform({_CELLS}, lambda r: array_to_string(list_transform(r, lambda c: 'X ' || c), chr(9))), chr(10))"


_PART_EXPORTS_SQL = f"""WITH {BLOCKS_SQL},
    y AS (SELECT *, {READ_BACK_SQL} AS t,
                 CASE WHEN {_SCENE} THEN 'scene' WHEN block_type IN ('heading', 'list_item', 'quote', 'caption') THEN block_type ELSE 'paragraph' END AS kind,
                 {_X_CELLS} AS xs FROM b),
    z AS (SELECT document_id, 0 AS part, block_index AS i, block_id, 0 AS sub,
                 CASE WHEN kind = 'scene' THEN CASE WHEN block_type IN ('heading', 'list_item', 'quote', 'caption') THEN block_type ELSE 'paragraph' END ELSE kind END AS block_type,
                 'X ' || t AS text
          FROM y WHERE block_type NOT IN ('footnote', 'endnote', 'image', 'table', 'page_break') AND t <> ''
          UNION ALL SELECT document_id, 0, block_index, block_id, 1, 'image', '' FROM y WHERE block_type = 'caption'
          UNION ALL SELECT document_id, 0, block_index, block_id, 1, 'page_break', '' FROM y WHERE block_type = 'page_break'
          UNION ALL SELECT document_id, 0, block_index, block_id, 0, 'table', CASE WHEN xs = '' THEN 'X outer' ELSE xs || chr(10) || 'X outer' END FROM y WHERE block_type = 'table'
          UNION ALL SELECT document_id, 0, block_index, block_id, 1, 'table', 'X inner' FROM y WHERE block_type = 'table'
          UNION ALL SELECT document_id, CASE block_type WHEN 'footnote' THEN 1 ELSE 2 END, block_index, block_id, 0, block_type, 'X ' || t
                    FROM y WHERE block_type IN ('footnote', 'endnote') AND t <> ''
          UNION ALL SELECT document_id, 3, block_index, block_id, 0, 'comment', 'X ' || t FROM y WHERE block_type = 'code' AND t <> ''
          UNION ALL SELECT DISTINCT document_id, 4, 0, '', 0, 'header', 'X ' || document_id FROM b
          UNION ALL SELECT DISTINCT document_id, 5, 0, '', 0, 'footer', 'X End of ' || document_id FROM b)
    SELECT document_id, row_number() OVER (PARTITION BY document_id ORDER BY part, i, block_id, sub)::INTEGER AS block_index, block_type, text,
           true AS all_applied FROM z"""


@add(_PART_EXPORTS_SQL)
def docx_part_exports(spark: SparkSession, folder: str) -> DataFrame:
    """DOCX packages with links, pictures, controls, comments, notes and nested tables, written back and read again."""
    return _part_exports(spark, folder, "docx")


@add(_PART_EXPORTS_SQL)
def docx_repaired_exports(spark: SparkSession, folder: str) -> DataFrame:
    """The same with translations that have lost all inline tokens: what these stand for isn't lost with them."""
    return _part_exports(spark, folder, "docx", tokens=False)


# ---- translation ----


def _languages(spark: SparkSession, folder: str) -> DataFrame:
    return unique_rows(table(spark, folder, "documents").select("document_id", "target_lang"), "document_id")


_ECHO_SQL = f"""CASE WHEN block_type = 'table'
    THEN {X.strip_sql("array_to_string(list_transform(" + _CELLS + ", lambda r: array_to_string(list_transform(r, lambda c: CASE WHEN c = '' THEN c ELSE '[' || coalesce(target_lang, '?') || '] ' || c END), chr(9))), chr(10))")}
    ELSE {X.strip_sql("'[' || coalesce(target_lang, '?') || '] ' || text")} END"""


@add(f"""WITH RECURSIVE {STATUS_SQL},
    l AS (SELECT DISTINCT document_id, target_lang FROM documents)
    SELECT p.document_id, p.block_id, {_ECHO_SQL} AS translated_text
    FROM status JOIN cur USING (document_id) JOIN s ON s.document_id = status.document_id AND s.section = status.section
    JOIN p ON p.document_id = s.document_id AND p.n = s.n JOIN l ON l.document_id = p.document_id
    WHERE status.section = cursor + 1 AND status = 'not_translated'""")
def translated_next(spark: SparkSession, folder: str) -> DataFrame:
    """One step for every document: its next section goes to the deterministic answerer."""
    out = translate.step(
        catalog._paragraphs(spark, folder), catalog._entries(spark, folder), catalog._targets(spark, folder), _languages(spark, folder)
    )
    return out.select("document_id", "block_id", "translated_text")


@add(f"""WITH {PARAGRAPHS_SQL}, {ENTRIES_SQL},
    k AS (SELECT DISTINCT document_id, block_id FROM e), l AS (SELECT DISTINCT document_id, target_lang FROM documents),
    q AS (SELECT p.* FROM p ANTI JOIN k USING (document_id, block_id))
    SELECT document_id, string_agg({_ECHO_SQL}, chr(10) || chr(10) ORDER BY n) AS text
    FROM q JOIN l USING (document_id) GROUP BY document_id""")
def translated_rest(spark: SparkSession, folder: str) -> DataFrame:
    """All that is left of every document, chunk after chunk within it."""
    asked = translate.rest_requests(catalog._paragraphs(spark, folder), catalog._entries(spark, folder), _languages(spark, folder))
    done = translate.in_order(asked)
    item = F.struct("chunk_index", "chunk_id", F.col("translated_text").alias("t"))
    rows = done.groupBy("document_id").agg(F.array_sort(F.collect_list(item)).alias("cs"))
    return rows.select("document_id", F.array_join(F.transform("cs", lambda c: c["t"]), "\n\n").alias("text"))


@add(f"""WITH RECURSIVE {PARAGRAPHS_SQL}, {ENTRIES_SQL},
    k AS (SELECT DISTINCT document_id, block_id FROM e),
    q AS (SELECT p.document_id, words, p.block_id, text, block_type, row_number() OVER (PARTITION BY p.document_id ORDER BY n) AS m
          FROM p ANTI JOIN k USING (document_id, block_id)),
    s AS (SELECT document_id, m, words AS filled, 1 AS section FROM q WHERE m = 1
          UNION ALL
          SELECT q.document_id, q.m, CASE WHEN s.filled + q.words > {catalog.CHUNK_WORDS} THEN q.words ELSE s.filled + q.words END,
                 s.section + CASE WHEN s.filled + q.words > {catalog.CHUNK_WORDS} THEN 1 ELSE 0 END
          FROM s JOIN q ON q.document_id = s.document_id AND q.m = s.m + 1),
    c AS (SELECT document_id, section, string_agg(block_id, ',' ORDER BY m) AS block_ids, string_agg(text, chr(10) || chr(10) ORDER BY m) AS body,
                 bool_or(block_type = 'table') AS tables, bool_or(contains(text, '[[INLINE_')) AS tokens
          FROM s JOIN q USING (document_id, m) GROUP BY document_id, section),
    l AS (SELECT DISTINCT document_id, target_lang FROM documents)
    SELECT c.document_id, {X.numbered_sql("sec_", "section")} AS chunk_id,
           'Translate the blocks below into ' || coalesce(target_lang, 'the target language') || '. {prompts.FORMS["general"]}'
           || ' Answer with JSON: block_translations, an array of block_id and translated_text.'
           || CASE WHEN tables THEN ' Give tables as table_rows of the same shape.' ELSE '' END
           || CASE WHEN tokens THEN ' Keep every inline token once.' ELSE '' END AS opening, block_ids,
           coalesce(array_to_string(list(section) OVER w, ','), '') AS context_sections,
           coalesce(array_to_string(list(md5(body)) OVER w, ','), '') AS context_md5
    FROM c JOIN l USING (document_id)
    WINDOW w AS (PARTITION BY c.document_id ORDER BY section ROWS BETWEEN {translate.CONTEXT} PRECEDING AND 1 PRECEDING)""")
def section_prompts(spark: SparkSession, folder: str) -> DataFrame:
    """What is asked for everything left, taken apart again: the opening, the blocks and the context in each prompt."""
    asked = translate.rest_requests(
        catalog._paragraphs(spark, folder), catalog._entries(spark, folder), _languages(spark, folder), catalog.CHUNK_WORDS
    )
    rows = translate.prompted(asked, catalog._glossary(spark, folder), prompts.guidance(spark))
    before = F.from_json(F.regexp_extract("prompt", r"\nBefore:\n(\[\{.*?\}\])\n\n(?:Terms|Blocks):\n", 1), "array<struct<chunk_id string, source_text string>>")
    items = F.from_json(F.regexp_extract("prompt", r"\nBlocks:\n(.*)$", 1), "array<struct<block_id string>>")
    number = F.transform(before, lambda c: F.substring(c["chunk_id"], 5, 9).cast("int").cast("string"))
    return rows.select(
        "document_id", "chunk_id", F.split_part("prompt", F.lit("\n\n"), F.lit(1)).alias("opening"),
        F.array_join(F.transform(items, lambda b: b["block_id"]), ",").alias("block_ids"),
        F.coalesce(F.array_join(number, ","), F.lit("")).alias("context_sections"),
        F.coalesce(F.array_join(F.transform(before, lambda c: F.md5(c["source_text"])), ","), F.lit("")).alias("context_md5"),
    )


@add(f"""WITH RECURSIVE {PARAGRAPHS_SQL}, {ENTRIES_SQL},
    k AS (SELECT DISTINCT document_id, block_id FROM e),
    q AS (SELECT p.*, row_number() OVER (PARTITION BY p.document_id ORDER BY n) AS m FROM p ANTI JOIN k USING (document_id, block_id))
    SELECT document_id, block_id, paragraph_id, block_type, source_text, shape FROM (
        SELECT document_id, block_id, {X.numbered_sql("p", "n")} AS paragraph_id, block_type, text AS source_text,
               CASE WHEN block_type = 'table' THEN array_to_string(list_transform({_CELLS}, lambda r: len(r)::VARCHAR), ',') END AS shape FROM q)""")
def request_blocks(spark: SparkSession, folder: str) -> DataFrame:
    """The blocks of all requests as a model sees them, out of their JSON."""
    asked = translate.rest_requests(
        catalog._paragraphs(spark, folder), catalog._entries(spark, folder), _languages(spark, folder), catalog.CHUNK_WORDS
    )
    item = "array<struct<block_id string, paragraph_id string, block_type string, source_text string, table_shape array<int>>>"
    rows = asked.select("document_id", F.explode(F.from_json("expected_json", item)).alias("b"))
    return rows.select(
        "document_id", "b.block_id", "b.paragraph_id", "b.block_type", "b.source_text",
        F.array_join(F.transform("b.table_shape", lambda n: n.cast("string")), ",").alias("shape"),
    )


# ---- comparisons and checks ----


@add(f"""WITH {PARAGRAPHS_SQL},
    u AS (SELECT document_id, unnest(string_split(text, chr(10) || chr(10))) AS unit, generate_subscripts(string_split(text, chr(10) || chr(10)), 1) AS n FROM (SELECT DISTINCT document_id, text FROM documents)),
    v AS (SELECT document_id, {X.strip_sql("unit")} AS unit, row_number() OVER (PARTITION BY document_id ORDER BY n) AS n FROM u WHERE {X.strip_sql("unit")} <> '')
    SELECT p.document_id, p.block_id, p.n, p.text = v.unit AS same FROM p JOIN v ON v.document_id = p.document_id AND v.n = p.n""")
def aligned_units(spark: SparkSession, folder: str) -> DataFrame:
    """The parts of documents' texts against their blocks by place; what is over on one side is left out."""
    texts = unique_rows(table(spark, folder, "documents").select("document_id", "text"), "document_id")
    units = F.filter(F.transform(F.split("text", "\n\n"), X.strip), lambda u: u != "")
    units = texts.select("document_id", F.posexplode(units).alias("at", "unit")).select("document_id", (F.col("at") + 1).alias("n"), "unit")
    rows = catalog._paragraphs(spark, folder).join(units, ["document_id", "n"])
    return rows.select("document_id", "block_id", F.col("n").cast("bigint").alias("n"), (F.col("text") == F.col("unit")).alias("same"))


_LINE = X.strip_sql("regexp_replace(error_text, '\\s+', ' ', 'g')")


@add(f"""WITH {JOBS_SQL}
    SELECT job_id, CASE WHEN length({_LINE}) <= 20 THEN {_LINE} ELSE rtrim(substr({_LINE}, 1, 17)) || '...' END AS message,
           {checks.retryable_sql("error_text")} AS retryable, {checks.retryable_sql("error_text", checks.BATCH)} AS retryable_in_batch
    FROM j WHERE status = 'failed'""")
def job_errors(spark: SparkSession, folder: str) -> DataFrame:
    """Failed jobs with a short message, and whether trying again may help."""
    jobs = activity.current_jobs(table(spark, folder, "jobs")).where("status = 'failed'")
    return jobs.select(
        "job_id", checks.short_message(F.col("error_text"), 20).alias("message"), checks.retryable(F.col("error_text")).alias("retryable"),
        checks.retryable(F.col("error_text"), checks.BATCH).alias("retryable_in_batch"),
    )


@add("""SELECT document_id, lower(trim(lang)) = lower(trim(target_lang)) AS same_language,
        coalesce(nullif(trim(lang), ''), 'English') AS named FROM (SELECT DISTINCT document_id, lang, target_lang FROM documents)""")
def language_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Whether a document's languages are named alike, and the label with its default."""
    rows = unique_rows(table(spark, folder, "documents").select("document_id", "lang", "target_lang"), "document_id")
    return rows.select("document_id", checks.same_language(F.col("lang"), F.col("target_lang")).alias("same_language"),
                       checks.named_or(F.col("lang"), "English").alias("named"))
