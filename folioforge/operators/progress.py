"""How far a document's translation has come, section by section."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.estimates import estimate

REST_CHUNK_WORDS = 1500


def section_status(sections: DataFrame, translations: DataFrame) -> DataFrame:
    """Sections with their translated blocks and status.

    Block ids are exploded, joined to the translated keys and counted back; the sections' other columns
    ride along, so their plan runs once.
    """
    keys = translations.select("document_id", "block_id").distinct().withColumn("done", F.lit(1))
    others = [c for c in sections.columns if c not in ("document_id", "section_index")]
    rows = sections.withColumn("block_id", F.explode_outer("block_ids")).join(keys, ["document_id", "block_id"], "left")
    rows = rows.groupBy("document_id", "section_index").agg(
        *[F.first(c).alias(c) for c in others], F.count("done").alias("translated_blocks")
    )
    n, done = F.size("block_ids"), F.col("translated_blocks")
    status = (
        F.when(n == 0, "empty").when(done == n, "translated").when(done > 0, "partial").otherwise("not_translated")
    )
    return rows.withColumn("status", status)


#: The last section of the translated beginning, 0 for none, as an aggregate over a document's sections.
CURSOR = "cast(coalesce(min(if(status <> 'translated', section_index, null)) - 1, max(section_index)) as int)"


def cursors(status: DataFrame) -> DataFrame:
    """(document_id, cursor)."""
    return status.groupBy("document_id").agg(F.expr(CURSOR).alias("cursor"))


def with_actions(status: DataFrame) -> DataFrame:
    """What can be done with a section: the one after the cursor is next, those beyond are locked."""
    document = Window.partitionBy("document_id")
    first_open = F.min(F.when(F.col("status") != "translated", F.col("section_index"))).over(document)
    rows = status.withColumn("cursor", F.coalesce(first_open - 1, F.max("section_index").over(document)).cast("int"))
    at, cursor = F.col("section_index"), F.col("cursor")
    action = (
        F.when((F.col("status") == "translated") & (at == cursor), "retranslate_last")
        .when((F.col("status") != "translated") & (at == cursor + 1), "translate_next")
    )
    locked = (at > cursor + 1) & (F.col("status") == "not_translated")
    return rows.withColumns(
        {"shown_status": F.when(locked, "locked").otherwise(F.col("status")), "action": action}
        | estimate(F.col("word_count"), F.lit(1))
    )


def step_estimates(status: DataFrame) -> DataFrame:
    """For each document the section that comes next and the one done last (``step``) with their estimates."""
    from ..functions.text import numbered
    from .sections import DEFAULT_TARGET

    rows = with_actions(status)
    at, cursor, words = F.col("section_index"), F.col("cursor"), F.col("word_count")
    step = F.when(at == cursor + 1, "next").when((at == cursor) & (cursor >= 1), "last")
    rows = rows.withColumn("step", step).where("step is not null")
    size = F.when(words > 0, words).otherwise(DEFAULT_TARGET)
    return rows.withColumns({"section_id": numbered("sec_", at), "chunk_size_words": size})


def remaining(status: DataFrame) -> DataFrame:
    """What is left of each document, packed in large chunks in section order."""
    from .sections import bulk_chunk_count

    left = status.where("status <> 'translated'").groupBy("document_id").agg(
        F.count("*").alias("sections_left"),
        F.sum(F.size("block_ids") - F.col("translated_blocks")).alias("blocks_left"),
        F.sum("word_count").alias("words_left"),
        F.transform(
            F.array_sort(F.collect_list(F.struct("section_index", "word_count"))), lambda s: s["word_count"]
        ).alias("ws"),
    )
    chunks = bulk_chunk_count(F.col("ws"), F.lit(REST_CHUNK_WORDS))
    rows = left.withColumn("chunks_left", chunks).drop("ws")
    return rows.withColumns(estimate(F.col("words_left"), F.col("chunks_left")))


def summaries(status: DataFrame) -> DataFrame:
    """One row a document: sections by status, words, blocks and cursor."""

    def number(name: str) -> Column:
        return F.count(F.when(F.col("status") == name, 1)).alias(f"{name}_sections")

    return status.groupBy("document_id").agg(
        F.count("*").alias("section_count"), number("translated"), number("partial"), number("not_translated"),
        F.sum("word_count").alias("word_count"), F.sum(F.size("block_ids")).alias("block_count"),
        F.sum("translated_blocks").alias("translated_block_count"), F.expr(CURSOR).alias("cursor"),
    )


def preceding(rows: DataFrame, k: int, by: str, item: str) -> DataFrame:
    """Rows with ``previous``: the values of ``item`` of the k rows before, in order of ``by``."""
    window = Window.partitionBy("document_id").orderBy(by, "chunk_id").rowsBetween(-k, -1)
    return rows.withColumn("previous", F.collect_list(item).over(window))
