"""Translations by block: reading both shapes of an entry, joining, updating, rendering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X

ROWS = "array<array<string>>"


def entries(documents: DataFrame) -> DataFrame:
    """translations_json as rows: (document_id, block_id, translated_text, table_rows).

    An entry is a string or an object with translated_text and table_rows; null, ``{}`` and broken
    JSON give no rows, a null entry gives one with an empty text.
    """
    rows = documents.select(
        "document_id", F.explode(F.from_json("translations_json", "map<string,string>")).alias("block_id", "entry")
    )
    nested = F.col("entry").startswith("{") & F.get_json_object("entry", "$").isNotNull()
    body = F.from_json("entry", f"translated_text string, table_rows {ROWS}")
    text = F.when(nested, body["translated_text"]).otherwise(F.col("entry"))
    return rows.select(
        "document_id", "block_id", F.coalesce(X.strip(text), F.lit("")).alias("translated_text"),
        F.when(nested, body["table_rows"]).alias("table_rows"),
    )


def shown(blocks: DataFrame, translations: DataFrame) -> DataFrame:
    """Every block with its translation, or with its source text where there is none."""
    some = translations.where("translated_text <> ''").select("document_id", "block_id", "translated_text")
    rows = blocks.join(some, ["document_id", "block_id"], "left")
    done = F.col("translated_text").isNotNull()
    return rows.withColumns(
        {
            "status": F.when(done, "translated").otherwise("source"),
            "source_text": X.without_tokens(F.col("text")),
            "display_text": X.without_tokens(F.coalesce("translated_text", "text")),
        }
    ).drop("translated_text")


def updated(old: DataFrame, new: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Rows of ``new`` take the place of rows of ``old`` with their key; of several the last by ``order``."""
    rows = old.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("__new"), F.desc(order)))
    return rows.withColumn("__rank", rank).where("__rank = 1").drop("__rank", "__new")


def rendered(rows: DataFrame, text: str = "display_text") -> DataFrame:
    """(document_id, text): the texts of a document's blocks in order, an empty line between."""
    parts = rows.where(~X.blank(F.col(text))).groupBy("document_id").agg(
        F.array_sort(F.collect_list(F.struct("block_index", "block_id", F.col(text).alias("t")))).alias("bs")
    )
    return parts.select("document_id", F.array_join(F.transform("bs", lambda b: b["t"]), "\n\n").alias("text"))


def table_text(rows: Column) -> Column:
    """Cells of a row between tabs, rows on lines."""
    return X.strip(F.array_join(F.transform(rows, lambda r: F.array_join(r, "\t", "")), "\n"))


def matches_shape(text: Column, shape: Column) -> Column:
    """Whether a text has as many filled lines, with as many tab-separated cells, as the shape says."""
    lines = F.split(F.replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n")), "\n")
    cells = F.transform(F.filter(lines, lambda x: X.strip(x) != ""), lambda x: F.size(F.split(x, "\t")))
    return ~X.blank(text) & (F.size(shape) > 0) & (cells == shape)


def inline_tokens(*texts: Column) -> Column:
    """The distinct inline tokens of some texts, in order of their first occurrence."""
    found = [F.coalesce(F.regexp_extract_all(t, F.lit(X.TOKEN), 0), F.array().cast("array<string>")) for t in texts]
    return F.array_distinct(F.concat(*found))


def unexpected(expected: Column, present: Column) -> Column:
    return F.array_except(present, expected)


def collected(parts: DataFrame) -> DataFrame:
    """One text a block from parts(document_id, block_id, chunk_index, part, translated_text, table_rows).

    Parts are joined by a blank in order. A part with table rows replaces what came before it, and a
    text after it drops the rows again.
    """
    items = parts.where(~X.blank(F.col("translated_text")))
    item = F.struct("chunk_index", "part", X.strip(F.col("translated_text")).alias("t"), F.col("table_rows").alias("rows"))
    grouped = items.groupBy("document_id", "block_id").agg(F.array_sort(F.collect_list(item)).alias("ps"))
    zero = F.struct(F.lit("").alias("t"), F.lit(None).cast(ROWS).alias("rows"))

    def step(acc: Column, p: Column) -> Column:
        joined = F.when(acc["t"] == "", p["t"]).otherwise(F.concat_ws(" ", acc["t"], p["t"]))
        return F.struct(F.when(p["rows"].isNotNull(), p["t"]).otherwise(joined).alias("t"), p["rows"].alias("rows"))

    out = F.aggregate("ps", zero, step)
    return grouped.select("document_id", "block_id", out["t"].alias("translated_text"), out["rows"].alias("table_rows"))


def reconstructed(chunks: DataFrame, text: str = "translated_text") -> DataFrame:
    """(document_id, text) from chunks in order: a chunk that continues a paragraph follows a blank,
    any other an empty line; blank chunks are left out."""
    rows = chunks.where(~X.blank(F.col(text)))
    continues = F.coalesce("continues_paragraph", F.lit(False)) & ~F.coalesce("starts_paragraph", F.lit(False))
    item = F.struct("chunk_index", "chunk_id", X.strip(F.col(text)).alias("t"), continues.alias("more"))
    grouped = rows.groupBy("document_id").agg(F.array_sort(F.collect_list(item)).alias("cs"))
    pieces = F.transform(
        "cs", lambda c, i: F.concat(F.when(i == 0, "").when(c["more"], " ").otherwise("\n\n"), c["t"])
    )
    return grouped.select("document_id", F.array_join(pieces, "").alias("text"))


def block_sections(planned: DataFrame) -> DataFrame:
    """(document_id, block_id, section_id) of sections with their block_ids."""
    return planned.select("document_id", F.explode("block_ids").alias("block_id"), "section_id")


LEAST_PAGE, MOST_PAGE, PAGE = 1, 100, 40


def page(rows: DataFrame, offset: int = 0, limit: int = PAGE) -> DataFrame:
    """A page of each document's blocks, in order, with total_blocks, page, page_count, has_previous and has_next.

    The offset is held at 0 or above, the limit between 1 and 100. Counting comes before the cut.
    """
    offset, limit = max(0, int(offset)), min(MOST_PAGE, max(LEAST_PAGE, int(limit)))
    document = Window.partitionBy("document_id")
    rows = rows.withColumns(
        {"__at": F.row_number().over(document.orderBy("block_index", "block_id")), "total_blocks": F.count("*").over(document)}
    )
    return (
        rows.where((F.col("__at") > offset) & (F.col("__at") <= offset + limit))
        .withColumns(
            {
                "page": F.lit(offset // limit + 1),
                "page_count": (F.floor((F.col("total_blocks") - 1) / limit) + 1).cast("int"),
                "has_previous": F.lit(offset > 0),
                "has_next": F.col("total_blocks") > offset + limit,
            }
        )
        .drop("__at")
    )


def application_counts(blocks: DataFrame, given: DataFrame) -> DataFrame:
    """(document_id, translatable_block_count, applied_unit_count): blocks, and those with a translation."""
    done = given.where("translated_text <> ''").select("document_id", "block_id", F.lit(1).alias("done"))
    return blocks.select("document_id", "block_id").join(done, ["document_id", "block_id"], "left").groupBy("document_id").agg(
        F.count("*").alias("translatable_block_count"), F.count("done").alias("applied_unit_count")
    )


def use(blocks: DataFrame, given: DataFrame) -> DataFrame:
    """(document_id, used, unused, missing): entries of known blocks, entries of others, blocks without an entry."""
    both = blocks.select("document_id", "block_id", F.lit(1).alias("block")).join(
        given.select("document_id", "block_id", F.lit(1).alias("entry")), ["document_id", "block_id"], "full"
    )
    known, entry = F.col("block").isNotNull(), F.col("entry").isNotNull()
    return both.groupBy("document_id").agg(
        F.count(F.when(known & entry, 1)).alias("used"), F.count(F.when(~known, 1)).alias("unused"),
        F.count(F.when(~entry, 1)).alias("missing"),
    )
