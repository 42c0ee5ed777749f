"""What is asked of a model: translations, glossaries, reviews and revisions of a chunk.

A request has a brief by language, form and kind of the document, the context, the terms, and the blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import tables

#: Advice by the form of the content; another form gets the general one. Data that callers may replace.
FORMS = {
    "general": "Keep the meaning, order and tone of the source.",
    "article": "Keep headings short and the argument easy to follow.",
    "book": "Keep the narrator's voice and the names the same throughout.",
    "contract": "Keep defined terms, numbering and obligations exactly.",
    "letter": "Keep forms of address as they are usual in the target language.",
    "manual": "Keep steps in order and use one word for one thing.",
}


def guidance(spark: SparkSession, forms: dict[str, str] | None = None) -> DataFrame:
    """The advice as a table (content_form, advice): a handful of rows."""
    return spark.createDataFrame(list((forms or FORMS).items()), "content_form string, advice string")


def with_advice(rows: DataFrame, advice: DataFrame, form: str = "content_form") -> DataFrame:
    """``rows`` with the advice for their form, or the general one."""
    table = F.broadcast(advice.select(F.col("content_form").alias("__form"), F.col("advice")))
    general = advice.where("content_form = 'general'").agg(F.max("advice")).scalar()
    joined = rows.join(table, F.lower(F.col(form)) == F.col("__form"), "left").drop("__form")
    return joined.withColumn("advice", F.coalesce("advice", general))


def block_item() -> Column:
    """A block as a model sees it: tables with rows, shape and role, others with their text."""
    rows = tables.rows_of(F.col("text"))
    is_table = F.col("block_type") == "table"
    return F.struct(
        "block_id",
        "paragraph_id",
        "block_type",
        F.col("block_level").alias("level"),
        F.col("text").alias("source_text"),
        F.when(is_table, rows).alias("table_rows"),
        F.when(is_table, tables.shape(rows)).alias("table_shape"),
    )


def compact_entry() -> Column:
    """A glossary entry without its history."""
    return F.struct("source_terms", "target_terms", "preferred_target", "category", "priority", "reason")


#: Advice by the kind of the document, and what a review looks at besides. Data that callers may replace.
KINDS = {
    "general": "No special rules apply.",
    "fiction": "Dialogue must sound spoken.",
    "legal": "Terms of law keep their usual counterparts.",
    "scientific": "Units, symbols and citations stay as they are.",
}
REVIEW = "Name untranslated parts, changes of meaning, broken names and numbers, and terms that differ from the list."


def brief(source: Column, target: Column, form: Column, kind: Column, advice: Column, kind_advice: Column) -> Column:
    """The lines that open a request: languages, form and kind with their advice."""
    lines = [
        ("Source language", source, "English"), ("Target language", target, "the target language"),
        ("Content form", form, "general"), ("Document type", kind, "general"),
    ]
    shown = [F.concat(F.lit(f"{name}: "), F.coalesce(value, F.lit(default))) for name, value, default in lines]
    return F.concat_ws("\n", *shown, advice, kind_advice)


def _part(title: str, body: Column) -> Column:
    return F.when(body.isNotNull() & ~body.isin("[]", ""), F.concat(F.lit(f"\n\n{title}\n"), body)).otherwise("")


def rules(items: Column) -> Column:
    """What holds besides, where a chunk has data tables, layout tables or inline tokens."""
    has_data = items.contains('"block_type":"table"')
    layout = items.contains('"is_layout_table":true')
    return F.concat(
        F.when(has_data & ~layout, " Give tables as table_rows of the same shape.").otherwise(""),
        F.when(layout, " Give lists of contents as text, without table_rows.").otherwise(""),
        F.when(items.contains("[[INLINE_"), " Keep every inline token once.").otherwise(""),
    )


def prompt(target: Column, advice: Column, context: Column, entries: Column, items: Column) -> Column:
    """The text of a request. ``context``, ``entries`` and ``items`` are JSON or null for none."""
    return F.concat(
        F.lit("Translate the blocks below into "), F.coalesce(target, F.lit("the target language")), F.lit(". "), advice,
        F.lit(" Answer with JSON: block_translations, an array of block_id and translated_text."), rules(items),
        _part("Before:", context), _part("Terms:", entries), _part("Blocks:", items),
    )


def glossary_prompt(target: Column, text: Column, translated: Column, entries: Column) -> Column:
    """Asks for the terms of a chunk that must stay the same throughout."""
    return F.concat(
        F.lit("List the names and terms of this text that must be the same throughout its translation into "),
        F.coalesce(target, F.lit("the target language")),
        F.lit(". Answer with JSON: glossary, an array of source_terms, target_terms, preferred_target, category, priority and reason."),
        _part("Known terms:", entries), _part("Text:", text), _part("Translation:", translated),
    )


def review_prompt(target: Column, checklist: Column, text: Column, translated: Column) -> Column:
    """Asks what is wrong with a translation."""
    return F.concat(
        F.lit("Review this translation into "), F.coalesce(target, F.lit("the target language")), F.lit(". "),
        F.coalesce(checklist, F.lit(REVIEW)), _part("Text:", text), _part("Translation:", translated),
    )


def revision_prompt(
    target: Column, advice: Column, feedback: Column, context: Column, entries: Column, items: Column, first: Column
) -> Column:
    """Asks for a second pass over a chunk: only what the feedback and the source support is to change."""
    return F.concat(
        F.lit("Revise this translation into "), F.coalesce(target, F.lit("the target language")), F.lit(". "), advice,
        F.lit(" Change only what the remarks and the source support. Answer in the form of the first translation."), rules(items),
        _part("Remarks:", feedback), _part("Before:", context), _part("Terms:", entries), _part("Blocks:", items),
        _part("First translation:", first),
    )
