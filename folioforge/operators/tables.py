"""Tables as ragged arrays of cells: shapes, and the score that tells layout tables from data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X


def rows_of(text: Column, separator: str = "|") -> Column:
    """Cells of a table that is stored as lines of separated cells."""
    lines = F.filter(F.split(text, "\n"), lambda x: X.strip(x) != "")
    quoted = "\\" + separator if separator in "|." else separator
    return F.transform(lines, lambda x: F.transform(F.split(x, quoted), X.strip))


def shape(rows: Column) -> Column:
    return F.transform(rows, F.size)


def numeric_ratio(rows: Column) -> Column:
    """Share of numeric cells among those that aren't blank, 0 without any."""
    cells = F.filter(F.flatten(rows), lambda c: ~X.blank(c))
    some = F.size(F.filter(cells, X.is_numeric))
    return F.when(F.size(cells) > 0, some / F.size(cells)).otherwise(F.lit(0.0))


# The signals that tell a list of contents from data, with their weights.
ROLE_WEIGHTS = {
    "toc_field": 7, "toc_paragraph_style": 6, "toc_hyperlinks": 3, "toc_title_hint": 3, "near_document_start": 2,
    "compact_layout_table": 2, "page_reference_entries": 3, "dense_page_reference_entries": 2, "semicolon_separated_entries": 2,
    "dense_page_reference_cells": 2, "numeric_data_grid": -4, "regular_data_grid_shape": -3,
}


def role(rows: Column, position: Column, fields: Column, styles: Column, links: Column) -> dict[str, Column]:
    """Whether a table is a list of contents: score, signals, role and confidence.

    ``position`` is the number of blocks before it; ``fields``, ``styles`` and ``links`` count
    contents fields, contents styles and contents links in it.
    """
    flat = X.strip(F.array_join(F.flatten(rows), " "))
    references, numbers = X.page_references(flat), numeric_ratio(rows)
    height, width = F.size(rows), F.coalesce(F.array_max(shape(rows)), F.lit(0))
    dense = F.exists(F.flatten(rows), lambda c: X.page_references(c) >= 3)
    title = X.has_contents_title(F.coalesce(F.get(F.get(rows, 0), 0), F.lit(""))) | X.has_contents_title(flat)
    holds = {
        "toc_field": fields > 0,
        "toc_paragraph_style": styles > 0,
        "toc_hyperlinks": links >= 3,
        "toc_title_hint": title,
        "near_document_start": position <= 10,
        "compact_layout_table": (height <= 4) & (width <= 3),
        "page_reference_entries": references >= 3,
        "dense_page_reference_entries": references >= 8,
        "semicolon_separated_entries": F.regexp_count(flat, F.lit("[;；؛]")) >= 3,
        "dense_page_reference_cells": dense,
        "numeric_data_grid": (numbers >= 0.6) & (references < 3),
        "regular_data_grid_shape": (height >= 5) & (width >= 3) & (references < 3),
    }
    weighed = [(name, weight, holds[name]) for name, weight in ROLE_WEIGHTS.items()]
    score = F.lit(0)
    for _, weight, holds in weighed:
        score = score + F.when(holds, weight).otherwise(0)
    layout = (fields > 0) | (styles > 0) | (score >= 10)
    possible = (score >= 7) & (references >= 3)
    return {
        "table_role": F.when(layout, "toc_layout").when(possible, "possible_toc_layout").otherwise("data"),
        "table_role_confidence": F.when(layout, "high").when(possible, "medium").when(score <= 2, "high").otherwise("low"),
        "table_role_score": score,
        "table_role_signals": F.array_compact(F.array(*[F.when(holds, name) for name, _, holds in weighed])),
        "is_layout_table": layout,
    }


def is_layout(role: Column, flag: Column) -> Column:
    return F.coalesce(F.lower(role).isin("toc_layout", "layout", "contents"), F.lit(False)) | F.coalesce(flag, F.lit(False))


def contents_entries(tables: DataFrame, text: str = "text") -> DataFrame:
    """Entries (title, page) of lists of contents: parts between semicolons or lines that end in a page."""
    parts = F.explode(F.split(F.col(text), r"[;\n]"))
    rows = tables.select("document_id", "block_id", parts.alias("entry"))
    title = X.strip(F.regexp_extract("entry", r"^(.*?)[\s,.|]*(\d{1,4}[A-Za-z]?)\s*$", 1))
    page = F.regexp_extract("entry", r"^(.*?)[\s,.|]*(\d{1,4}[A-Za-z]?)\s*$", 2)
    return rows.select("document_id", "block_id", title.alias("title"), page.alias("page")).where("page <> '' and title <> ''")


def style_counts(rows: DataFrame, styles: str) -> DataFrame:
    """A histogram of the values of an array column."""
    return rows.select(F.explode(styles).alias("style")).groupBy("style").count()


def block_histogram(blocks: DataFrame) -> DataFrame:
    """Blocks, words and translatable blocks by type."""
    return blocks.groupBy("block_type").agg(
        F.count("*").alias("block_count"),
        F.count(F.when(F.col("translatable"), 1)).alias("translatable_count"),
        F.sum(F.coalesce(F.char_length("text"), F.lit(0))).alias("char_count"),
    )


def type_deltas(left: DataFrame, right: DataFrame) -> DataFrame:
    """How two parses of the same documents differ: blocks by document and type on either side."""
    a = left.groupBy("document_id", "block_type").agg(F.count("*").alias("left_count"))
    b = right.groupBy("document_id", "block_type").agg(F.count("*").alias("right_count"))
    both = a.join(b, ["document_id", "block_type"], "full")
    both = both.fillna(0, ["left_count", "right_count"])
    return both.withColumn("delta", F.col("right_count") - F.col("left_count")).where("delta <> 0")


def samples(blocks: DataFrame, most: int = 5, chars: int = 120) -> DataFrame:
    """(document_id, body_blocks, samples): the beginnings of the first blocks of each document, in order.
    """
    first = F.array_sort(F.collect_list(F.struct("block_index", "block_id", F.substring("text", 1, chars).alias("t"))))
    counts = blocks.groupBy("document_id").agg(F.count("*").alias("body_blocks"))
    rank = F.row_number().over(Window.partitionBy("document_id").orderBy("block_index", "block_id"))
    some = blocks.withColumn("__rank", rank).where(F.col("__rank") <= most).groupBy("document_id").agg(first.alias("bs"))
    return counts.join(some, "document_id").select("document_id", "body_blocks", F.transform("bs", lambda b: b["t"]).alias("samples"))


def enriched(blocks: DataFrame, units: DataFrame) -> DataFrame:
    """Blocks with what a second parse knows of them, and what is over on either side.

    ``blocks``(document_id, n, block_id, block_type) and ``units``(document_id, n, kind, about) are numbered from 1
    within documents; ``kind`` is table or text. A block and the unit at its place match if both are tables or
    neither is; then ``about`` is the block's, else null. ``status`` is matched, mismatched, missing (no unit is
    left) or unused (no block is left).
    """
    left = blocks.select("document_id", "n", "block_id", "block_type", F.lit(True).alias("__block"))
    right = units.select("document_id", "n", F.col("kind").alias("unit_kind"), "about", F.lit(True).alias("__unit"))
    rows = left.join(right, ["document_id", "n"], "full")
    same = F.col("block_type").eqNullSafe("table") == F.col("unit_kind").eqNullSafe("table")
    status = (
        F.when(F.col("__unit").isNull(), "missing").when(F.col("__block").isNull(), "unused")
        .when(same, "matched").otherwise("mismatched")
    )
    rows = rows.withColumn("status", status)
    return rows.withColumn("about", F.when(F.col("status") == "matched", F.col("about"))).drop("__block", "__unit")


def enrichment_reports(rows: DataFrame) -> DataFrame:
    """One row a document out of ``enriched``: units, matches, units left over, blocks without a match, and ok or partial."""

    def number(*names: str) -> Column:
        return F.count(F.when(F.col("status").isin(*names), 1))

    out = rows.groupBy("document_id").agg(
        number("matched", "mismatched", "unused").alias("units"), number("matched").alias("matched_units"),
        number("unused").alias("unused_units"), number("mismatched", "missing").alias("mismatches"),
    )
    whole = (F.col("mismatches") == 0) & (F.col("unused_units") == 0)
    return out.withColumn("status", F.when(whole, "ok").otherwise("partial"))
