"""Blocks: the ordered units of a document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X
from ..functions.words import count_words
from ..tables import latest_rows

#: Types that are never translated, used where a block's own flag is missing.
FIXED_TYPES = ("code", "page_break", "section_break", "image", "equation")

BLOCK = T.StructType(
    [
        T.StructField("block_id", T.StringType()),
        T.StructField("type", T.StringType()),
        T.StructField("text", T.StringType()),
        T.StructField("translate", T.BooleanType()),
        T.StructField("level", T.IntegerType()),
        T.StructField("metadata", T.StructType([T.StructField("tree_path", T.StringType())])),
    ]
)
PARSED = T.StructType(
    [
        T.StructField("source_path", T.StringType()),
        T.StructField("source_format", T.StringType()),
        T.StructField("blocks", T.ArrayType(BLOCK)),
    ]
)


def current_blocks(blocks: DataFrame, by_document: bool = False) -> DataFrame:
    """One row a block: the last extraction; a missing flag follows the type.

    The window's key is (document, block), so no document or owner gathers in one task. With
    ``by_document`` the rows are laid out by document at once, which the window accepts too: what
    follows within documents then needs no shuffle of its own.
    """
    rows = latest_rows(
        blocks.repartition("document_id") if by_document else blocks, ["document_id", "block_id"],
        F.desc_nulls_last("extracted_at"), F.desc_nulls_last("translatable"), F.asc_nulls_last("block_index"),
    )
    flag = F.coalesce("translatable", ~F.coalesce("block_type", F.lit("paragraph")).isin(*FIXED_TYPES))
    return rows.withColumn("translatable", flag)


def translatable(blocks: DataFrame) -> DataFrame:
    """Blocks with text to translate, with their words."""
    rows = blocks.where(F.col("translatable") & ~X.blank(F.col("text")))
    return rows.withColumn("words", count_words(F.col("text")))


def numbered_paragraphs(blocks: DataFrame) -> DataFrame:
    """Translatable blocks with their number n from 1 within the document, and a paragraph id."""
    order = Window.partitionBy("document_id").orderBy("block_index", "block_id")
    rows = translatable(blocks).withColumn("n", F.row_number().over(order))
    return rows.withColumn("paragraph_id", X.numbered("p", F.col("n")))


def from_json(json: Column) -> Column:
    """A parsed document with every field present: defaults stand for what is missing."""
    parsed = F.from_json(json, PARSED)
    fixed = F.transform(
        F.coalesce(parsed["blocks"], F.array().cast(T.ArrayType(BLOCK))),
        lambda b: F.struct(
            F.coalesce(b["block_id"], F.lit("")).alias("block_id"),
            F.coalesce(b["type"], F.lit("paragraph")).alias("type"),
            F.coalesce(b["text"], F.lit("")).alias("text"),
            F.coalesce(b["translate"], F.lit(True)).alias("translate"),
            b["level"].alias("level"),
            b["metadata"]["tree_path"].alias("tree_path"),
        ),
    )
    return F.struct(
        F.coalesce(parsed["source_path"], F.lit("")).alias("source_path"),
        F.coalesce(parsed["source_format"], F.lit("txt")).alias("source_format"),
        fixed.alias("blocks"),
    )


def parsed_blocks(documents: DataFrame) -> DataFrame:
    """The blocks in parsed_document_json, numbered from 1; a null or broken document has none."""
    rows = documents.select("document_id", from_json(F.col("parsed_document_json")).alias("d"))
    return rows.select(
        "document_id", F.col("d.source_format").alias("source_format"), F.posexplode("d.blocks").alias("at", "b")
    ).select("document_id", "source_format", (F.col("at") + 1).alias("block_index"), "b.*")


def to_json(blocks: DataFrame) -> DataFrame:
    """A document's blocks, in order, as the JSON of a parsed document."""
    block = F.struct(
        "block_id", F.col("block_type").alias("type"), "text", F.col("translatable").alias("translate"),
        F.col("block_level").alias("level"),
    )
    rows = blocks.groupBy("document_id").agg(
        F.array_sort(F.collect_list(F.struct("block_index", "block_id", block.alias("b")))).alias("bs")
    )
    body = F.to_json(F.struct(F.transform("bs", lambda x: x["b"]).alias("blocks")), {"ignoreNullFields": "false"})
    return rows.select("document_id", body.alias("parsed_json"))
