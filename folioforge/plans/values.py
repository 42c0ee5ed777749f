"""Queries that hold single functions against SQL: styles, units, terms, tokens, ids, dates, sizes, samples, answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import checks
from ..functions import text as X
from ..functions.estimates import estimate, estimate_sql
from ..operators import activity, glossary, progress, reconcile, sections, tables, translations
from ..sources import build, packages
from ..tables import table, unique_rows
from . import catalog
from .catalog import BLOCKS_SQL, JOBS_SQL, PARAGRAPHS_SQL, STATUS_SQL, TARGETS_SQL, USAGE_SQL, add

_STYLES = {
    "heading": "Heading ", "caption": "Image Caption", "quote": "Block-Quote", "list_item": "List Paragraph", "code": "Code",
    "footnote": "footnote text", "endnote": "Epigraph_2", "table": "TOC_1", "page_break": "Bibliography", "image": "Index 1",
}
_STYLE_SQL = "CASE block_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _STYLES.items()) + " ELSE 'Normal' END || CASE WHEN block_type = 'heading' THEN coalesce(block_level, 1)::VARCHAR ELSE '' END"


def _style() -> Column:
    out = F.lit("Normal")
    for kind, style in _STYLES.items():
        out = F.when(F.col("block_type") == kind, style).otherwise(out)
    return F.concat(out, F.when(F.col("block_type") == "heading", F.coalesce("block_level", F.lit(1)).cast("string")).otherwise(""))


@add(f"""WITH {BLOCKS_SQL}, s AS (SELECT document_id, block_id, block_type, {_STYLE_SQL} AS style FROM b),
    n AS (SELECT *, lower(regexp_replace(style, '[ _-]', '', 'g')) AS name, lower(block_type || ' ' || style) AS about FROM s)
    SELECT document_id, block_id, nullif(regexp_extract(style, '(?i)heading\\s*(\\d+)$', 1), '')::INTEGER AS level,
           CASE WHEN contains(name, 'caption') THEN 'caption' WHEN contains(name, 'quote') OR contains(name, 'epigraph') THEN 'quote'
                WHEN contains(name, 'toc') THEN 'toc_entry' WHEN contains(name, 'bibliography') OR contains(name, 'reference') THEN 'reference'
                WHEN contains(name, 'index') THEN 'index_entry' END AS style_type,
           CASE WHEN contains(about, 'footnote') THEN 'footnote' WHEN contains(about, 'endnote') OR contains(about, 'rearnote') THEN 'endnote'
                WHEN contains(about, 'toc') THEN 'toc' WHEN contains(about, 'sidebar') OR contains(about, 'note') THEN 'special' ELSE 'aside' END AS semantic_type
    FROM n""")
def style_types(spark: SparkSession, folder: str) -> DataFrame:
    """What a style stands for: heading level, block type, and the type of an element by what it says about itself."""
    rows = catalog._blocks(spark, folder).select("document_id", "block_id", "block_type", _style().alias("style"))
    return rows.select(
        "document_id", "block_id", X.heading_level(F.col("style")).alias("level"), X.style_block_type(F.col("style")).alias("style_type"),
        X.semantic_block_type(F.concat_ws(" ", "block_type", "style"), "aside").alias("semantic_type"),
    )


@add(f"""WITH {BLOCKS_SQL}, s AS (SELECT document_id, block_id, (block_index % 11)::VARCHAR || '10³ / l; ' || coalesce(text, '') AS text FROM b)
    SELECT document_id, block_id, regexp_replace(text, '\\b([1-9])10([{X.RAISED[:10]}]+)(\\s*/)', '\\1×10\\2\\3', 'g') AS units,
           translate(text, '{X.PLAIN}', '{X.LOWERED}') AS lowered FROM s""")
def unit_texts(spark: SparkSession, folder: str) -> DataFrame:
    """Scanned powers of ten before units, and lowered digits."""
    text = F.concat((F.col("block_index") % 11).cast("string"), F.lit("10³ / l; "), F.coalesce("text", F.lit("")))
    rows = catalog._blocks(spark, folder).select("document_id", "block_id", text.alias("text"))
    return rows.select("document_id", "block_id", X.scientific_units(F.col("text")).alias("units"), X.lowered(F.col("text")).alias("lowered"))


_TITLES_SQL = " OR ".join(f"contains(low, '{t}') OR contains(compact, '{''.join(t.replace('-', ' ').split())}')" for t in X.CONTENTS_TITLES)


@add(f"""WITH {BLOCKS_SQL},
    s AS (SELECT document_id, block_id, text, lower({X.inline_text_sql("text")}) AS low FROM b WHERE text IS NOT NULL),
    n AS (SELECT *, regexp_replace(low, '[\\s\\-_]+', '', 'g') AS compact FROM s)
    SELECT document_id, block_id, {X.strip_sql("text")} <> '' AND NOT regexp_matches(text, '[\\p{{L}}\\p{{N}}]') AS symbol_marker,
           {_TITLES_SQL} AS contents_title, {X.strip_sql("text")} = '' AS is_blank FROM n""")
def text_predicates(spark: SparkSession, folder: str) -> DataFrame:
    """Marks of signs only, titles of lists of contents, blank texts."""
    text = F.col("text")
    return catalog._blocks(spark, folder).where(text.isNotNull()).select(
        "document_id", "block_id", X.is_symbol_marker(text).alias("symbol_marker"), X.has_contents_title(text).alias("contents_title"),
        X.blank(text).alias("is_blank"),
    )


@add(f"""WITH g AS (SELECT DISTINCT ON (document_id, entry_id) * FROM glossary)
    SELECT document_id, entry_id, array_to_string(coalesce({catalog._unique_sql("source_terms")}, []), '|') AS sources,
           array_to_string(coalesce({catalog._unique_sql("target_terms")}, []), '|') AS targets FROM g""")
def glossary_lists(spark: SparkSession, folder: str) -> DataFrame:
    """Terms without blank ones and those that equal an earlier one."""
    rows = unique_rows(table(spark, folder, "glossary"), "document_id", "entry_id")

    def joined(name: str) -> Column:
        return F.array_join(F.coalesce(glossary.unique_terms(F.col(name)), F.array().cast("array<string>")), "|")

    return rows.select("document_id", "entry_id", joined("source_terms").alias("sources"), joined("target_terms").alias("targets"))


@add(f"""WITH g AS (SELECT DISTINCT ON (document_id, entry_id) * FROM glossary),
    q AS (SELECT document_id, coalesce(first_seen_chunk_id, '?') AS chunk_id, entry_id, {catalog._unique_sql("source_terms")} AS ss,
                 {catalog._unique_sql("target_terms")} AS ts, nullif({X.strip_sql("preferred_target")}, '') AS wanted,
                 lower({X.strip_sql("priority")}) AS prio, coalesce(nullif(lower({X.strip_sql("category")}), ''), 'other') AS category FROM g),
    w AS (SELECT *, coalesce(wanted, ts[1]) AS pref FROM q WHERE len(ss) > 0 AND len(ts) > 0)
    SELECT document_id, chunk_id, row_number() OVER (PARTITION BY document_id, chunk_id ORDER BY entry_id)::INTEGER AS place,
           array_to_string(ss, '|') AS sources,
           array_to_string(CASE WHEN list_contains({catalog._keys_sql("ts")}, {X.term_key_sql("pref")}) THEN ts ELSE list_concat([pref], ts) END, '|') AS targets,
           pref AS preferred_target, CASE WHEN prio IN ('low', 'medium', 'high') THEN prio ELSE 'medium' END AS priority, category FROM w""")
def extracted_terms(spark: SparkSession, folder: str) -> DataFrame:
    """The glossary entries in answers of a model, which here are the stored entries in JSON between words and a fence."""
    rows = unique_rows(table(spark, folder, "glossary"), "document_id", "entry_id")
    entry = F.struct("source_terms", "target_terms", "preferred_target", "priority", "category")
    rows = rows.groupBy("document_id", F.coalesce("first_seen_chunk_id", F.lit("?")).alias("chunk_id")).agg(
        F.array_sort(F.collect_list(F.struct("entry_id", entry.alias("e")))).alias("es")
    )
    body = F.to_json(F.struct(F.transform("es", lambda x: x["e"]).alias("glossary")))
    answers = rows.select("document_id", "chunk_id", F.concat(F.lit("Here they are:\n```json\n"), body, F.lit("\n```\nDone.")).alias("output"))
    found = glossary.extracted(answers)
    return found.select(
        "document_id", "chunk_id", "place", F.array_join("source_terms", "|").alias("sources"), F.array_join("target_terms", "|").alias("targets"),
        "preferred_target", "priority", "category",
    )


@add("""WITH d AS (SELECT DISTINCT document_id, translations_json FROM documents)
    SELECT document_id, len(json_keys(translations_json)) AS entries FROM d WHERE translations_json IS NOT NULL""")
def embedded_objects(spark: SparkSession, folder: str) -> DataFrame:
    """JSON objects found in answers with words around them: here the translations, and how many entries they have."""
    rows = unique_rows(table(spark, folder, "documents").select("document_id", "translations_json"), "document_id").where("translations_json is not null")
    found = reconcile.objects_in(F.concat(F.lit("So: "), F.col("translations_json"), F.lit(" That is all {so far}.")))
    return rows.select("document_id", F.size(F.map_keys(F.from_json(found, "map<string,string>"))).cast("bigint").alias("entries"))


@add("""WITH d AS (SELECT DISTINCT document_id, translations_json, parsed_document_json FROM documents)
    SELECT document_id, coalesce(len(json_keys(translations_json)), 0) AS entries,
           coalesce(json_extract_string(parsed_document_json, '$.source_format'), 'txt') AS source_format FROM d""")
def json_columns(spark: SparkSession, folder: str) -> DataFrame:
    """JSON columns under a schema, with defaults for null and blank ones."""
    rows = unique_rows(table(spark, folder, "documents").select("document_id", "translations_json", "parsed_document_json"), "document_id")
    none = F.create_map().cast("map<string,string>")
    given = checks.json_or(F.col("translations_json"), "map<string,string>", none)
    parsed = checks.json_or(F.col("parsed_document_json"), "source_format string", F.lit(None).cast("struct<source_format:string>"))
    return rows.select("document_id", F.size(given).cast("bigint").alias("entries"), F.coalesce(parsed["source_format"], F.lit("txt")).alias("source_format"))


@add("""WITH d AS (SELECT DISTINCT document_id, original_filename, n_chars FROM documents)
    SELECT document_id, regexp_full_match(document_id, 'doc_[a-f0-9]{12}') AS valid,
           'doc_' || substr(sha256(coalesce(original_filename, '')), 1, 12) AS name_id,
           CASE WHEN n_chars >= 1048576 THEN round(n_chars / 1048576, 2)::VARCHAR || ' MB' WHEN n_chars >= 1024 THEN round(n_chars / 1024, 2)::VARCHAR || ' KB'
                ELSE n_chars::VARCHAR || ' bytes' END AS size FROM d""")
def document_ids(spark: SparkSession, folder: str) -> DataFrame:
    """Whether ids have their form, ids made from names, and sizes for display."""
    rows = unique_rows(table(spark, folder, "documents").select("document_id", "original_filename", "n_chars"), "document_id")
    return rows.select(
        "document_id", X.valid_id("doc_", F.col("document_id")).alias("valid"), X.stable_id("doc_", F.col("original_filename")).alias("name_id"),
        X.shown_size(F.col("n_chars")).alias("size"),
    )


@add(f"""WITH {USAGE_SQL}
    SELECT usage_id, date_trunc('day', created_at) AS day_start, strftime(created_at AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%SZ') AS iso,
           date_trunc('second', created_at) AS parsed FROM u""")
def usage_times(spark: SparkSession, folder: str) -> DataFrame:
    """Times as texts in UTC, read back, and the beginning of their day."""
    rows = activity.single_usage(table(spark, folder, "usage_records"))
    iso = X.utc_text(F.col("created_at"))
    return rows.select("usage_id", F.date_trunc("day", "created_at").alias("day_start"), iso.alias("iso"), X.utc_time(iso).alias("parsed"))


@add(f"""WITH {TARGETS_SQL}, l AS (SELECT DISTINCT document_id, lang FROM documents)
    SELECT d.document_id, target, coalesce(nullif({X.strip_sql("lang")}, ''), 'English') AS language FROM d JOIN l ON l.document_id = d.document_id""")
def request_defaults(spark: SparkSession, folder: str) -> DataFrame:
    """Section targets within their limits, and languages with their default."""
    rows = unique_rows(table(spark, folder, "documents").select("document_id", "lang"), "document_id")
    return catalog._targets(spark, folder).join(rows, "document_id").select(
        "document_id", "target", checks.named_or(F.col("lang"), "English").alias("language")
    )


@add(f"""WITH RECURSIVE {STATUS_SQL},
    n AS (SELECT status.document_id, section, word_count, cursor, 'next' AS step FROM status JOIN cur USING (document_id) WHERE section = cursor + 1
          UNION ALL SELECT status.document_id, section, word_count, cursor, 'last' FROM status JOIN cur USING (document_id) WHERE section = cursor AND cursor >= 1)
    SELECT document_id, step, {X.numbered_sql("sec_", "section")} AS section_id, CASE WHEN word_count > 0 THEN word_count ELSE {sections.DEFAULT_TARGET} END AS chunk_size_words,
           {estimate_sql("word_count", "1")} FROM n""")
def step_estimates(spark: SparkSession, folder: str) -> DataFrame:
    """What the next section of each document takes, and what doing the last one again would."""
    rows = progress.step_estimates(catalog._status(spark, folder))
    return rows.select("document_id", "step", "section_id", "chunk_size_words", "input_tokens", "output_tokens", "prompt_tokens", "total_tokens")


@add(f"""WITH {USAGE_SQL} SELECT usage_id, {estimate_sql("coalesce(word_count, 0)", "greatest(coalesce(chunk_count, 0), 0)")},
    greatest(coalesce(translated_block_count, 0), 0)::BIGINT AS blocks FROM u""")
def usage_estimates(spark: SparkSession, folder: str) -> DataFrame:
    """The estimate anew for every record, missing counts as zero."""
    rows = activity.single_usage(table(spark, folder, "usage_records"))
    words, chunks = F.coalesce("word_count", F.lit(0)), F.greatest(F.coalesce("chunk_count", F.lit(0)), F.lit(0))
    blocks = F.greatest(F.coalesce("translated_block_count", F.lit(0)), F.lit(0)).cast("bigint").alias("blocks")
    return rows.select("usage_id", *[c.alias(k) for k, c in estimate(words, chunks).items()], blocks)


@add(f"""WITH {PARAGRAPHS_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY n) AS m FROM p WHERE block_type IN ('paragraph', 'heading', 'list_item', 'quote'))
    SELECT document_id, count(*) AS body_blocks, array_to_string(list(substr(text, 1, 120) ORDER BY m) FILTER (WHERE m <= 5), '|') AS samples
    FROM r GROUP BY document_id""")
def document_samples(spark: SparkSession, folder: str) -> DataFrame:
    """The first five texts of every document, 120 characters of each."""
    body = catalog._paragraphs(spark, folder).where(F.col("block_type").isin("paragraph", "heading", "list_item", "quote"))
    return tables.samples(body, 5, 120).withColumn("samples", F.array_join("samples", "|"))


_WORD_STYLES_SQL = (
    "CASE block_type WHEN 'heading' THEN 'Heading' || coalesce(block_level, 1)::VARCHAR WHEN 'quote' THEN 'Quote' WHEN 'caption' THEN 'Caption' END"
)


@add(f"""WITH {BLOCKS_SQL}, s AS (SELECT {_WORD_STYLES_SQL} AS style FROM b WHERE block_type IN ('heading', 'quote', 'caption') AND {X.inline_text_sql("text")} <> '')
    SELECT style, count(*) AS count FROM s GROUP BY style""")
def docx_styles(spark: SparkSession, folder: str) -> DataFrame:
    """A histogram of paragraph styles, out of packages."""
    read = packages.read_blocks(build.packages(catalog._blocks(spark, folder), "docx"))
    styles = F.array_compact(F.array(F.get_json_object("metadata_json", "$.style")))
    rows = read.where("block_type not in ('image', 'page_break')").select(styles.alias("styles"))
    return tables.style_counts(rows, "styles").where("style in ('Quote', 'Caption') or style like 'Heading%'")


@add(f"""WITH {BLOCKS_SQL}, t AS (SELECT document_id, block_type, {X.inline_text_sql("text")} AS t FROM b WHERE block_type IN ('quote', 'caption', 'code'))
    SELECT document_id, CASE block_type WHEN 'code' THEN 'paragraph' ELSE block_type END AS block_type,
           CASE block_type WHEN 'quote' THEN '[[INLINE_0001]]' || t || '[[INLINE_0002]]' ELSE t || '[[INLINE_0001]]' END AS marked,
           CASE block_type WHEN 'quote' THEN 2 ELSE 1 END AS tokens, CASE block_type WHEN 'quote' THEN 1 ELSE 0 END AS missing FROM t
    WHERE t <> '' AND NOT regexp_full_match({X.strip_sql('t')}, '(?:[*\\-_=#]\\s*){{3,}}')""")
def inline_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """Inline objects and containers of DOCX paragraphs as tokens: the text with them, how many, and how many a text
    without its last token lacks."""
    read = packages.read_blocks(build.packages(catalog._blocks(spark, folder), "docx", parts=True))
    marked = F.col("inline_source_text")
    rows = read.where(marked.contains("[[INLINE_") & (F.col("block_type").isin("quote", "caption", "paragraph")))
    tokens = translations.inline_tokens(marked)
    lost = translations.inline_tokens(F.regexp_replace(marked, r"\[\[INLINE_0002\]\]", ""))
    return rows.select(
        "document_id", "block_type", marked.alias("marked"), F.size(tokens).alias("tokens"),
        F.size(translations.unexpected(lost, tokens)).alias("missing"),
    )


@add(f"""WITH {JOBS_SQL} SELECT job_id, created_at, status FROM j ORDER BY created_at DESC, job_id DESC LIMIT 100""")
def latest_jobs(spark: SparkSession, folder: str) -> DataFrame:
    """The first page of jobs, newest first; a page has 100 rows at most."""
    rows = activity.current_jobs(table(spark, folder, "jobs")).select("job_id", "created_at", "status")
    return activity.page(rows, [F.desc("created_at"), F.desc("job_id")], 0, 500)


@add(f"""WITH {USAGE_SQL} SELECT usage_id, owner_user_id, created_at FROM u ORDER BY created_at DESC, usage_id LIMIT 20 OFFSET 20""")
def usage_page(spark: SparkSession, folder: str) -> DataFrame:
    """The second page of usage records, newest first."""
    rows = activity.single_usage(table(spark, folder, "usage_records")).select("usage_id", "owner_user_id", "created_at")
    return activity.page(rows, [F.desc("created_at"), F.asc("usage_id")], 20, 20)
