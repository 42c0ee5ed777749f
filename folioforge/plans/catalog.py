"""All queries of the core, over the tables of a data folder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.estimates import estimate, estimate_sql
from ..functions.words import PYTHON_SPACE, count_words, count_words_sql, re2
from ..operators import activity, blocks, chunks, glossary, progress, reconcile, sections, tables, translations
from ..tables import table, unique_rows
from .registry import Registry

REGISTRY = Registry()
add = REGISTRY.add

CHUNK_WORDS = 300
CONTEXT = 3

# ---- parts of the SQL ----

PYTHON_SPACE_RE2 = re2(PYTHON_SPACE)

FIXED = ", ".join(f"'{t}'" for t in blocks.FIXED_TYPES)
BLOCKS_SQL = f"""
    b AS (SELECT * EXCLUDE (translatable, rk),
                 coalesce(translatable, coalesce(block_type, 'paragraph') NOT IN ({FIXED})) AS translatable
          FROM (SELECT *, row_number() OVER (PARTITION BY document_id, block_id
                ORDER BY extracted_at DESC NULLS LAST, translatable DESC NULLS LAST, block_index NULLS LAST) AS rk
                FROM blocks) WHERE rk = 1)"""
PARAGRAPHS_SQL = f"""{BLOCKS_SQL},
    p AS (SELECT *, {count_words_sql("text")} AS words,
                 row_number() OVER (PARTITION BY document_id ORDER BY block_index, block_id)::INTEGER AS n
          FROM b WHERE translatable AND text IS NOT NULL AND {X.strip_sql("text")} <> '')"""
TARGETS_SQL = f"""
    d AS (SELECT document_id, min(least({sections.MOST_TARGET}, greatest({sections.LEAST_TARGET},
                 coalesce(target_words_per_section, {sections.DEFAULT_TARGET})))) AS target
          FROM documents GROUP BY document_id)"""
SECTIONED_SQL = f"""{PARAGRAPHS_SQL}, {TARGETS_SQL},
    s AS (SELECT p.document_id, n, words, words AS filled, 1 AS section FROM p WHERE n = 1
          UNION ALL
          SELECT p.document_id, p.n, p.words,
                 CASE WHEN s.filled + p.words > d.target THEN p.words ELSE s.filled + p.words END,
                 s.section + CASE WHEN s.filled + p.words > d.target THEN 1 ELSE 0 END
          FROM s JOIN p ON p.document_id = s.document_id AND p.n = s.n + 1 JOIN d ON d.document_id = p.document_id),
    sec AS (SELECT document_id, section, count(*) AS block_count, sum(p.words)::BIGINT AS word_count,
                   list(block_id ORDER BY n) AS block_ids,
                   string_agg({X.strip_sql("regexp_replace(text, '" + X.TOKEN + "', '', 'g')")}, chr(10) || chr(10) ORDER BY n) AS body
            FROM s JOIN p USING (document_id, n) GROUP BY document_id, section)"""
ENTRIES_SQL = """
    e0 AS (SELECT DISTINCT document_id, unnest(json_keys(translations_json)) AS block_id, translations_json::JSON AS j
           FROM documents WHERE translations_json IS NOT NULL),
    e AS (SELECT document_id, block_id,
                 coalesce(CASE WHEN json_type(j, '$."' || block_id || '"') = 'OBJECT'
                               THEN json_extract_string(j, '$."' || block_id || '".translated_text')
                               ELSE json_extract_string(j, '$."' || block_id || '"') END, '') AS raw_text
          FROM e0)"""
STATUS_SQL = f"""{SECTIONED_SQL}, {ENTRIES_SQL},
    k AS (SELECT DISTINCT document_id, block_id FROM e),
    st AS (SELECT sec.document_id, section, word_count, block_count,
                  len(list_filter(block_ids, lambda x: list_contains(coalesce(ks, []), x))) AS translated_blocks
           FROM sec LEFT JOIN (SELECT document_id, list(block_id) AS ks FROM k GROUP BY document_id) USING (document_id)),
    status AS (SELECT *, CASE WHEN translated_blocks = block_count THEN 'translated'
                              WHEN translated_blocks > 0 THEN 'partial' ELSE 'not_translated' END AS status FROM st),
    cur AS (SELECT document_id, coalesce(min(section) FILTER (WHERE status <> 'translated') - 1, max(section))::INTEGER AS cursor
            FROM status GROUP BY document_id)"""
JOBS_SQL = """
    j AS (SELECT * EXCLUDE (rk) FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY updated_at DESC NULLS LAST,
            coalesce(list_position(['queued', 'running', 'failed', 'succeeded'], status), 0) DESC,
            progress DESC NULLS LAST, message NULLS LAST) AS rk FROM jobs) WHERE rk = 1)"""
USAGE_SQL = """
    u AS (SELECT * EXCLUDE (rk) FROM (SELECT *, row_number() OVER (PARTITION BY usage_id ORDER BY loaded_at NULLS LAST) AS rk
          FROM usage_records) WHERE rk = 1)"""
SUMS_SQL = ", ".join(f"sum(coalesce({c}, 0))::BIGINT AS {c}" for c in activity.SUMS)
USAGE_COLUMNS_SQL = f"""count(*) AS record_count, {SUMS_SQL},
    sum(coalesce(estimated_cost_usd, 0)::DECIMAL(12,6))::DOUBLE AS estimated_cost_usd"""


# ---- blocks ----


def _blocks(spark: SparkSession, folder: str) -> DataFrame:
    return blocks.current_blocks(table(spark, folder, "blocks"))


def _paragraphs(spark: SparkSession, folder: str) -> DataFrame:
    return blocks.numbered_paragraphs(blocks.current_blocks(table(spark, folder, "blocks"), by_document=True))


@add(f"""WITH {BLOCKS_SQL} SELECT document_id, block_id, block_index, block_type, translatable, block_level FROM b""")
def current_blocks(spark: SparkSession, folder: str) -> DataFrame:
    """Each block once, as last extracted, with its flag filled in."""
    return _blocks(spark, folder).select(
        "document_id", "block_id", "block_index", "block_type", "translatable", "block_level"
    )


@add(f"""WITH {PARAGRAPHS_SQL}
    SELECT document_id, block_id, {X.numbered_sql("p", "n")} AS paragraph_id, words FROM p""")
def paragraph_ids(spark: SparkSession, folder: str) -> DataFrame:
    """Translatable blocks numbered within their document."""
    return _paragraphs(spark, folder).select("document_id", "block_id", "paragraph_id", "words")


@add("""
    WITH r AS (SELECT document_id, parsed_document_json::JSON AS j FROM documents WHERE parsed_document_json IS NOT NULL),
    x AS (SELECT document_id, coalesce(json_extract_string(j, '$.source_format'), 'txt') AS source_format,
                 unnest(json_extract(j, '$.blocks[*]')) AS b, generate_subscripts(json_extract(j, '$.blocks[*]'), 1) AS i FROM r)
    SELECT document_id, source_format, i::INTEGER AS block_index, coalesce(json_extract_string(b, '$.block_id'), '') AS block_id,
           coalesce(json_extract_string(b, '$.type'), 'paragraph') AS type, coalesce(json_extract_string(b, '$.text'), '') AS text,
           coalesce(json_extract_string(b, '$.translate')::BOOLEAN, true) AS translate,
           json_extract_string(b, '$.level')::INTEGER AS level, json_extract_string(b, '$.metadata.tree_path') AS tree_path
    FROM x""")
def parsed_blocks(spark: SparkSession, folder: str) -> DataFrame:
    """Blocks out of the JSON of parsed documents."""
    rows = unique_rows(table(spark, folder, "documents").select("document_id", "parsed_document_json"), "document_id")
    return blocks.parsed_blocks(rows)


@add(f"""WITH {BLOCKS_SQL},
    r AS (SELECT DISTINCT document_id, parsed_document_json::JSON AS j FROM documents WHERE parsed_document_json IS NOT NULL),
    x AS (SELECT document_id, unnest(json_extract(j, '$.blocks[*]')) AS v FROM r),
    y AS (SELECT document_id, json_extract_string(v, '$.block_id') AS block_id, json_extract_string(v, '$.text') AS text,
                 coalesce(json_extract_string(v, '$.type'), 'paragraph') AS type FROM x)
    SELECT b.document_id, b.block_id, y.block_id IS NOT NULL AS in_json, b.text IS NOT DISTINCT FROM y.text AS same_text,
           b.block_type IS NOT DISTINCT FROM y.type AS same_type
    FROM b LEFT JOIN y ON y.document_id = b.document_id AND y.block_id = b.block_id""")
def blocks_against_json(spark: SparkSession, folder: str) -> DataFrame:
    """Every block against the one in its document's JSON; a comparison of two parses."""
    left = parsed_blocks(spark, folder).select("document_id", "block_id", F.col("text").alias("json_text"), "type", F.lit(True).alias("there"))
    rows = _blocks(spark, folder).join(left, ["document_id", "block_id"], "left")
    return rows.select(
        "document_id", "block_id", F.col("there").isNotNull().alias("in_json"), F.col("text").eqNullSafe(F.col("json_text")).alias("same_text"),
        F.col("block_type").eqNullSafe(F.col("type")).alias("same_type"),
    )


@add(f"""WITH {BLOCKS_SQL}
    SELECT document_id, to_json({{'blocks': list({{'block_id': block_id, 'type': block_type, 'text': text, 'translate': translatable,
           'level': block_level}} ORDER BY block_index, block_id)}})::VARCHAR AS parsed_json FROM b GROUP BY document_id""")
def block_json(spark: SparkSession, folder: str) -> DataFrame:
    """Documents' blocks written as JSON."""
    return blocks.to_json(_blocks(spark, folder))


@add(f"""WITH {BLOCKS_SQL}
    SELECT block_type, count(*) AS block_count, count(*) FILTER (WHERE translatable) AS translatable_count,
           sum(coalesce(length(text), 0))::BIGINT AS char_count FROM b GROUP BY block_type""")
def block_histogram(spark: SparkSession, folder: str) -> DataFrame:
    """Blocks by type."""
    return tables.block_histogram(_blocks(spark, folder))


@add(f"""WITH {BLOCKS_SQL},
    r AS (SELECT DISTINCT document_id, parsed_document_json::JSON AS j FROM documents WHERE parsed_document_json IS NOT NULL),
    x AS (SELECT document_id, json_extract_string(unnest(json_extract(j, '$.blocks[*]')), '$.type') AS block_type FROM r),
    l AS (SELECT document_id, block_type, count(*) AS n FROM b GROUP BY ALL),
    q AS (SELECT document_id, block_type, count(*) AS n FROM x GROUP BY ALL)
    SELECT document_id, block_type, coalesce(l.n, 0) AS left_count, coalesce(q.n, 0) AS right_count,
           coalesce(q.n, 0) - coalesce(l.n, 0) AS delta
    FROM l FULL JOIN q USING (document_id, block_type) WHERE coalesce(l.n, 0) <> coalesce(q.n, 0)""")
def parse_deltas(spark: SparkSession, folder: str) -> DataFrame:
    """Where the block table and the parsed JSON differ in the number of blocks of a type."""
    other = parsed_blocks(spark, folder).withColumnRenamed("type", "block_type")
    return tables.type_deltas(_blocks(spark, folder), other)


@add(f"""WITH {BLOCKS_SQL}
    SELECT document_id, block_id, {X.inline_text_sql("text")} AS inline_text,
           {X.preview_sql("text", 60)} AS preview, {X.cell_text_sql("text")} AS cell_text,
           translate(text, '{X.PLAIN}', '{X.RAISED}') AS raised
    FROM b WHERE text IS NOT NULL""")
def normalized_texts(spark: SparkSession, folder: str) -> DataFrame:
    """The clean-up functions over every block."""
    text = F.col("text")
    return _blocks(spark, folder).where(text.isNotNull()).select(
        "document_id", "block_id", X.inline_text(text).alias("inline_text"), X.preview(text, 60).alias("preview"),
        X.cell_text(text).alias("cell_text"), X.raised(text).alias("raised"),
    )


@add(f"""WITH {BLOCKS_SQL}
    SELECT document_id, block_id, regexp_full_match({X.strip_sql("text")}, '(?:[*\\-_=#]\\s*){{3,}}') AS scene_break,
           regexp_full_match({X.strip_sql("text")}, '[\\s\\d.,%$€£¥+\\-()/:]+') AS numeric_only,
           regexp_matches(text, '[=∑∫√±×÷≤≥]|\\\\frac|\\\\sum|\\\\int') AS formula_like,
           len(regexp_extract_all(text, '[,;，；،؛]\\s*\\d{{1,4}}[A-Za-z]?\\b')) AS page_references
    FROM b WHERE text IS NOT NULL""")
def block_features(spark: SparkSession, folder: str) -> DataFrame:
    """The predicates that type a block by its text."""
    text = F.col("text")
    return _blocks(spark, folder).where(text.isNotNull()).select(
        "document_id", "block_id", X.is_scene_break(text).alias("scene_break"), X.is_numeric(text).alias("numeric_only"),
        X.is_formula(text).alias("formula_like"), X.page_references(text).cast("bigint").alias("page_references"),
    )


# ---- sections and progress ----


def _targets(spark: SparkSession, folder: str) -> DataFrame:
    target = sections.clamped_target(F.col("target_words_per_section"))
    return table(spark, folder, "documents").groupBy("document_id").agg(F.min(target).alias("target"))


def _sections(spark: SparkSession, folder: str) -> DataFrame:
    return sections.sections(_paragraphs(spark, folder), _targets(spark, folder))


@add(f"""WITH RECURSIVE {SECTIONED_SQL}
    SELECT document_id, {X.numbered_sql("sec_", "section")} AS section_id, section AS section_index, word_count,
           block_count, array_to_string(block_ids, ',') AS block_ids, {X.preview_sql("body")} AS preview,
           {estimate_sql("word_count", "1")}
    FROM sec""")
def section_plan(spark: SparkSession, folder: str) -> DataFrame:
    """The sections of every document with their estimates."""
    return (
        _sections(spark, folder)
        .withColumn("block_ids", F.array_join("block_ids", ","))
        .withColumns(estimate(F.col("word_count"), F.lit(1)))
    )


def _status(spark: SparkSession, folder: str) -> DataFrame:
    return progress.section_status(_sections(spark, folder), _entries(spark, folder))


@add(f"""WITH RECURSIVE {STATUS_SQL}
    SELECT document_id, section AS section_index, translated_blocks, status, cursor,
           CASE WHEN section > cursor + 1 AND status = 'not_translated' THEN 'locked' ELSE status END AS shown_status,
           CASE WHEN status = 'translated' AND section = cursor THEN 'retranslate_last'
                WHEN status <> 'translated' AND section = cursor + 1 THEN 'translate_next' END AS action
    FROM status JOIN cur USING (document_id)""")
def section_progress(spark: SparkSession, folder: str) -> DataFrame:
    """Status and possible action of every section."""
    return progress.with_actions(_status(spark, folder)).select(
        "document_id", "section_index", "translated_blocks", "status", "cursor", "shown_status", "action"
    )


@add(f"""WITH RECURSIVE {STATUS_SQL},
    l AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY section) AS m FROM status WHERE status <> 'translated'),
    c AS (SELECT document_id, m, word_count AS filled, 1 AS chunks FROM l WHERE m = 1
          UNION ALL
          SELECT l.document_id, l.m, CASE WHEN c.filled + l.word_count > {progress.REST_CHUNK_WORDS} THEN l.word_count
                                          ELSE c.filled + l.word_count END,
                 c.chunks + CASE WHEN c.filled + l.word_count > {progress.REST_CHUNK_WORDS} THEN 1 ELSE 0 END
          FROM c JOIN l ON l.document_id = c.document_id AND l.m = c.m + 1),
    t AS (SELECT document_id, count(*) AS sections_left, sum(block_count - translated_blocks)::BIGINT AS blocks_left,
                 sum(word_count)::BIGINT AS words_left FROM l GROUP BY document_id),
    n AS (SELECT document_id, max(chunks) AS chunks_left FROM c GROUP BY document_id)
    SELECT document_id, sections_left, blocks_left, words_left, chunks_left, {estimate_sql("words_left", "chunks_left")}
    FROM t JOIN n USING (document_id)""")
def remaining_estimate(spark: SparkSession, folder: str) -> DataFrame:
    """What is left to translate of each document, in large chunks."""
    return progress.remaining(_status(spark, folder))


@add(f"""WITH RECURSIVE {STATUS_SQL}
    SELECT document_id, count(*) AS section_count, count(*) FILTER (WHERE status = 'translated') AS translated_sections,
           count(*) FILTER (WHERE status = 'partial') AS partial_sections,
           count(*) FILTER (WHERE status = 'not_translated') AS not_translated_sections,
           sum(word_count)::BIGINT AS word_count, sum(block_count)::BIGINT AS block_count,
           sum(translated_blocks)::BIGINT AS translated_block_count, any_value(cursor) AS cursor
    FROM status JOIN cur USING (document_id) GROUP BY document_id""")
def document_summary(spark: SparkSession, folder: str) -> DataFrame:
    """One row a document: sections by status, words, blocks, cursor."""
    return progress.summaries(_status(spark, folder))


@add(f"""WITH RECURSIVE {STATUS_SQL}
    SELECT document_id, cursor, {X.numbered_sql("sec_", "n.section")} AS next_section_id,
           CASE WHEN cursor >= 1 THEN {X.numbered_sql("sec_", "cursor")} END AS last_section_id
    FROM cur LEFT JOIN (SELECT document_id, section FROM status) n USING (document_id)
    WHERE n.section = cursor + 1
    UNION ALL
    SELECT document_id, cursor, NULL, CASE WHEN cursor >= 1 THEN {X.numbered_sql("sec_", "cursor")} END
    FROM cur WHERE NOT EXISTS (SELECT 1 FROM status s WHERE s.document_id = cur.document_id AND s.section = cur.cursor + 1)""")
def next_sections(spark: SparkSession, folder: str) -> DataFrame:
    """The section to translate next and the one translated last."""
    ends = F.max("section_index").alias("last_index")
    rows = _status(spark, folder).groupBy("document_id").agg(F.expr(progress.CURSOR).alias("cursor"), ends)
    return rows.select(
        "document_id", "cursor",
        F.when(F.col("cursor") < F.col("last_index"), X.numbered("sec_", F.col("cursor") + 1)).alias("next_section_id"),
        F.when(F.col("cursor") >= 1, X.numbered("sec_", F.col("cursor"))).alias("last_section_id"),
    )


@add(f"""WITH RECURSIVE {PARAGRAPHS_SQL}, {TARGETS_SQL}, {ENTRIES_SQL},
    k AS (SELECT DISTINCT document_id, block_id FROM e),
    q AS (SELECT document_id, words, block_id, row_number() OVER (PARTITION BY document_id ORDER BY n) AS m
          FROM p ANTI JOIN k USING (document_id, block_id)),
    s AS (SELECT document_id, m, words AS filled, 1 AS section FROM q WHERE m = 1
          UNION ALL
          SELECT q.document_id, q.m, CASE WHEN s.filled + q.words > {progress.REST_CHUNK_WORDS} THEN q.words ELSE s.filled + q.words END,
                 s.section + CASE WHEN s.filled + q.words > {progress.REST_CHUNK_WORDS} THEN 1 ELSE 0 END
          FROM s JOIN q ON q.document_id = s.document_id AND q.m = s.m + 1)
    SELECT document_id, {X.numbered_sql("rest_", "section")} AS section_id, 10000 + section AS section_index,
           sum(words)::BIGINT AS word_count, count(*) AS block_count, string_agg(block_id, ',' ORDER BY m) AS block_ids
    FROM s JOIN q USING (document_id, m) GROUP BY document_id, section""")
def rest_sections(spark: SparkSession, folder: str) -> DataFrame:
    """The blocks without a translation, packed for translation at one go."""
    done = _entries(spark, folder).select("document_id", "block_id").distinct()
    left = _paragraphs(spark, folder).select("document_id", "block_id", "block_index", "text", "words", F.col("n").alias("at"))
    left = left.join(done, ["document_id", "block_id"], "left_anti")
    left = left.withColumn("n", F.row_number().over(Window.partitionBy("document_id").orderBy("at"))).drop("at")
    target = left.select("document_id").distinct().withColumn("target", F.lit(progress.REST_CHUNK_WORDS))
    rows = left.join(sections.sectioned(left, target), ["document_id", "n"]).groupBy("document_id", "section").agg(
        F.sum("words").alias("word_count"), F.count("*").alias("block_count"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "block_id"))), lambda b: b["block_id"]), ",").alias("block_ids"),
    )
    return rows.select(
        "document_id", X.numbered("rest_", F.col("section")).alias("section_id"),
        (F.col("section") + 10000).alias("section_index"), "word_count", "block_count", "block_ids",
    )


# ---- translations ----


def _entries(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents").select("document_id", "translations_json")
    return translations.entries(documents).dropDuplicates(["document_id", "block_id"])


@add(f"""WITH {ENTRIES_SQL} SELECT document_id, block_id, {X.strip_sql("raw_text")} AS translated_text FROM e""")
def translation_entries(spark: SparkSession, folder: str) -> DataFrame:
    """Translations as rows, of both shapes that an entry may have."""
    return _entries(spark, folder).drop("table_rows")


@add(f"""WITH {PARAGRAPHS_SQL}, {ENTRIES_SQL},
    t AS (SELECT document_id, block_id, {X.strip_sql("raw_text")} AS tt FROM e WHERE {X.strip_sql("raw_text")} <> '')
    SELECT p.document_id, p.block_id, CASE WHEN tt IS NULL THEN 'source' ELSE 'translated' END AS status,
           regexp_replace(text, '{X.TOKEN}', '', 'g') AS source_text,
           regexp_replace(coalesce(tt, text), '{X.TOKEN}', '', 'g') AS display_text
    FROM p LEFT JOIN t ON t.document_id = p.document_id AND t.block_id = p.block_id""")
def translation_preview(spark: SparkSession, folder: str) -> DataFrame:
    """Every translatable block as it is shown: its translation, or its source."""
    rows = translations.shown(_paragraphs(spark, folder), _entries(spark, folder))
    return rows.select("document_id", "block_id", "status", "source_text", "display_text")


@add(f"""WITH {PARAGRAPHS_SQL},
    t AS (SELECT *, count(*) OVER (PARTITION BY document_id) AS total FROM p)
    SELECT document_id, block_id, ((n - 1) // 5 + 1)::INTEGER AS page, ((total - 1) // 5 + 1)::INTEGER AS page_count,
           n > 5 AS has_previous, ((n - 1) // 5 + 1) * 5 < total AS has_next
    FROM t""")
def preview_pages(spark: SparkSession, folder: str) -> DataFrame:
    """All blocks with their page of five, and whether pages lie before and after it."""
    total = F.count("*").over(Window.partitionBy("document_id"))
    rows = _paragraphs(spark, folder).withColumn("total", total)
    page = (F.floor((F.col("n") - 1) / 5) + 1).cast("int")
    return rows.select(
        "document_id", "block_id", page.alias("page"), (F.floor((F.col("total") - 1) / 5) + 1).cast("int").alias("page_count"),
        (F.col("n") > 5).alias("has_previous"), (page * 5 < F.col("total")).alias("has_next"),
    )


@add(f"""WITH {PARAGRAPHS_SQL}, {ENTRIES_SQL},
    t AS (SELECT document_id, block_id, {X.strip_sql("raw_text")} AS tt FROM e WHERE {X.strip_sql("raw_text")} <> ''),
    r AS (SELECT p.document_id, block_index, p.block_id, regexp_replace(coalesce(tt, text), '{X.TOKEN}', '', 'g') AS x
          FROM p LEFT JOIN t ON t.document_id = p.document_id AND t.block_id = p.block_id)
    SELECT document_id, string_agg(x, chr(10) || chr(10) ORDER BY block_index, block_id) AS text
    FROM r WHERE {X.strip_sql("x")} <> '' GROUP BY document_id""")
def exported_texts(spark: SparkSession, folder: str) -> DataFrame:
    """Documents written as plain text: translations where there are some, else the source."""
    return translations.rendered(translations.shown(_paragraphs(spark, folder), _entries(spark, folder)))


@add(f"""WITH {PARAGRAPHS_SQL}, {ENTRIES_SQL}
    SELECT coalesce(p.document_id, e.document_id) AS document_id, count(*) FILTER (WHERE p.block_id IS NOT NULL AND e.block_id IS NOT NULL) AS used,
           count(*) FILTER (WHERE p.block_id IS NULL) AS unused, count(*) FILTER (WHERE e.block_id IS NULL) AS missing
    FROM p FULL JOIN e ON p.document_id = e.document_id AND p.block_id = e.block_id GROUP BY 1""")
def translation_use(spark: SparkSession, folder: str) -> DataFrame:
    """By document: translations of its blocks, translations of blocks that don't exist or aren't translated, and blocks without any."""
    return translations.use(_paragraphs(spark, folder), _entries(spark, folder))


@add(f"""WITH {PARAGRAPHS_SQL}, {ENTRIES_SQL}
    SELECT document_id, block_id,
           coalesce('[' || target_lang || '] ' || text, text) AS translated_text, 1::INTEGER AS version
    FROM p JOIN (SELECT DISTINCT document_id, target_lang FROM documents) USING (document_id)
    WHERE EXISTS (SELECT 1 FROM e WHERE e.document_id = p.document_id AND e.block_id = p.block_id) OR n = 1
    UNION ALL
    SELECT document_id, block_id, {X.strip_sql("raw_text")}, 0 FROM e
    WHERE NOT EXISTS (SELECT 1 FROM p WHERE e.document_id = p.document_id AND e.block_id = p.block_id)""")
def updated_translations(spark: SparkSession, folder: str) -> DataFrame:
    """Translations after a second pass by the deterministic answerer over known and first blocks."""
    old = _entries(spark, folder).select("document_id", "block_id", "translated_text", F.lit(0).alias("version"))
    targets = unique_rows(table(spark, folder, "documents").select("document_id", "target_lang"), "document_id")
    rows = _paragraphs(spark, folder).join(targets, "document_id")
    known = old.select("document_id", "block_id", F.lit(True).alias("known"))
    rows = rows.join(known, ["document_id", "block_id"], "left").where("known or n = 1")
    new = rows.select("document_id", "block_id", _echo(F.col("target_lang"), F.col("text")).alias("translated_text"), F.lit(1).alias("version"))
    return translations.updated(old, new, ["document_id", "block_id"], "version")


def _echo(lang: Column, text: Column) -> Column:
    """The deterministic stand-in for a model."""
    return F.coalesce(F.concat(F.lit("["), lang, F.lit("] "), text), text)


@add(f"""WITH {BLOCKS_SQL},
    r AS (SELECT document_id, block_id, text, list_transform(list_filter(string_split(text, chr(10)), lambda x: {X.strip_sql("x")} <> ''),
                 lambda l: list_transform(string_split(l, '|'), lambda c: {X.strip_sql("c")})) AS rows FROM b WHERE block_type = 'table')
    SELECT document_id, block_id, len(rows) AS row_count, array_to_string(list_transform(rows, lambda r: len(r)::VARCHAR), ',') AS shape,
           array_to_string(list_transform(rows, lambda r: array_to_string(r, chr(9))), chr(10)) AS table_text
    FROM r""")
def table_shapes(spark: SparkSession, folder: str) -> DataFrame:
    """Tables taken apart: rows, shape and tab-separated text."""
    rows = tables.rows_of(F.col("text"))
    found = _blocks(spark, folder).where("block_type = 'table'").withColumn("rows", rows)
    return found.select(
        "document_id", "block_id", F.size("rows").cast("bigint").alias("row_count"),
        F.array_join(F.transform(tables.shape(F.col("rows")), lambda n: n.cast("string")), ",").alias("shape"),
        translations.table_text(F.col("rows")).alias("table_text"),
    )


def _texts(names: tuple[str, ...]) -> str:
    return "(" + " OR ".join(names) + ")"


_TITLE_SQL = _texts(tuple(
    f"contains(low, '{t}') OR contains(regexp_replace(low, '[\\s\\-_]+', '', 'g'), '{''.join(t.replace('-', ' ').replace('_', ' ').split())}')"
    for t in X.CONTENTS_TITLES
))
_REFS = "'[,;，；،؛]\\s*\\d{1,4}[A-Za-z]?\\b'"
_SIGNALS_SQL = {
    "toc_title_hint": "title", "near_document_start": "block_index - 1 <= 10", "compact_layout_table": "h <= 4 AND w <= 3",
    "page_reference_entries": "refs >= 3", "dense_page_reference_entries": "refs >= 8", "semicolon_separated_entries": "semicolons >= 3",
    "dense_page_reference_cells": "dense", "numeric_data_grid": "num >= 0.6 AND refs < 3",
    "regular_data_grid_shape": "h >= 5 AND w >= 3 AND refs < 3",
}


@add(f"""WITH {BLOCKS_SQL},
    r AS (SELECT document_id, block_id, block_index, list_transform(list_filter(string_split(text, chr(10)), lambda x: {X.strip_sql("x")} <> ''),
                 lambda l: list_transform(string_split(l, '|'), lambda c: {X.strip_sql("c")})) AS rows FROM b WHERE block_type = 'table'),
    f AS (SELECT *, flatten(rows) AS cells, {X.strip_sql("array_to_string(flatten(rows), ' ')")} AS flat FROM r),
    g AS (SELECT *, len(rows) AS h, coalesce(list_max(list_transform(rows, lambda r: len(r))), 0) AS w, len(regexp_extract_all(flat, {_REFS})) AS refs,
                 len(regexp_extract_all(flat, '[;；؛]')) AS semicolons, lower({X.inline_text_sql("flat")}) AS low,
                 len(list_filter(cells, lambda c: len(regexp_extract_all(c, {_REFS})) >= 3)) > 0 AS dense,
                 list_filter(cells, lambda c: c <> '') AS filled FROM f),
    s AS (SELECT *, {_TITLE_SQL} AS title, CASE WHEN len(filled) = 0 THEN 0.0
                 ELSE len(list_filter(filled, lambda c: regexp_full_match(c, '[\\s\\d.,%$€£¥+\\-()/:]+'))) / len(filled) END AS num FROM g),
    t AS (SELECT *, {" + ".join(f"CASE WHEN {sql} THEN {tables.ROLE_WEIGHTS[name]} ELSE 0 END" for name, sql in _SIGNALS_SQL.items())} AS score,
                 array_to_string([{", ".join(f"CASE WHEN {sql} THEN '{name}' END" for name, sql in _SIGNALS_SQL.items())}], ',') AS signals FROM s)
    SELECT document_id, block_id,
           CASE WHEN score >= 10 THEN 'toc_layout' WHEN score >= 7 AND refs >= 3 THEN 'possible_toc_layout' ELSE 'data' END AS table_role,
           CASE WHEN score >= 10 THEN 'high' WHEN score >= 7 AND refs >= 3 THEN 'medium' WHEN score <= 2 THEN 'high' ELSE 'low' END AS table_role_confidence,
           score::INTEGER AS table_role_score, signals, score >= 10 AS is_layout_table FROM t""")
def table_roles(spark: SparkSession, folder: str) -> DataFrame:
    """The score that tells lists of contents from data, for every table."""
    zero = F.lit(0)
    found = _blocks(spark, folder).where("block_type = 'table'").withColumn("rows", tables.rows_of(F.col("text")))
    found = found.withColumns(tables.role(F.col("rows"), F.col("block_index") - 1, zero, zero, zero))
    return found.select(
        "document_id", "block_id", "table_role", "table_role_confidence", "table_role_score",
        F.array_join("table_role_signals", ",").alias("signals"), "is_layout_table",
    )


@add(f"""WITH {ENTRIES_SQL},
    r AS (SELECT document_id, block_id, list_transform(json_extract(json_extract(j, '$."' || block_id || '".table_rows'), '$[*]'),
                 lambda x: json_array_length(x)) AS given
          FROM e0 WHERE json_type(j, '$."' || block_id || '".table_rows') = 'ARRAY'), {BLOCKS_SQL},
    s AS (SELECT document_id, block_id, list_transform(list_filter(string_split(text, chr(10)), lambda x: {X.strip_sql("x")} <> ''),
                 lambda l: len(string_split(l, '|'))) AS wanted FROM b WHERE block_type = 'table')
    SELECT document_id, block_id, list_transform(given, lambda x: x::BIGINT) = list_transform(wanted, lambda x: x::BIGINT) AS same_shape
    FROM r JOIN s USING (document_id, block_id)""")
def table_translations(spark: SparkSession, folder: str) -> DataFrame:
    """Whether translated tables kept their shape."""
    given = _entries(spark, folder).where("table_rows is not null")
    wanted = _blocks(spark, folder).where("block_type = 'table'").select("document_id", "block_id", tables.shape(tables.rows_of(F.col("text"))).alias("wanted"))
    return given.join(wanted, ["document_id", "block_id"]).select(
        "document_id", "block_id", (tables.shape(F.col("table_rows")) == F.col("wanted")).alias("same_shape")
    )


# ---- chunks ----


_W = "[^" + PYTHON_SPACE_RE2 + "]+"
_S = "[" + PYTHON_SPACE_RE2 + "]+"


@add(f"""WITH RECURSIVE
    raw AS (SELECT DISTINCT document_id, {X.strip_sql("replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10))")} AS t FROM documents),
    para AS (SELECT document_id, ps[i] AS t, i AS n FROM (SELECT document_id, ps, unnest(range(1, len(ps) + 1)) AS i FROM (
                   SELECT document_id, list_filter(list_transform(regexp_split_to_array(t, '\\n\\s*\\n'),
                     lambda x: regexp_replace({X.strip_sql("x")}, '[ \\t]*\\n[ \\t]*', ' ', 'g')), lambda x: x <> '') AS ps FROM raw))),
    piece AS (SELECT document_id, n, 0 AS part, NULL::VARCHAR AS text, t AS rest FROM para
              UNION ALL
              SELECT document_id, n, part + 1,
                     CASE WHEN {count_words_sql("rest")} <= {CHUNK_WORDS} THEN {X.strip_sql("rest")} ELSE coalesce(nullif(done, ''), head) END,
                     CASE WHEN {count_words_sql("rest")} <= {CHUNK_WORDS} THEN ''
                          ELSE {X.strip_sql("substr(rest, length(coalesce(nullif(done, ''), head)) + 1)")} END
              FROM (SELECT *, regexp_extract(head, '(?s)^(.*[.!?…]+["''”’»)\\]]*)(?:' || '{_S}' || '|$)', 1) AS done
                    FROM (SELECT *, regexp_extract(rest, '^(?:{_W}{_S}){{0,{CHUNK_WORDS - 1}}}{_W}') AS head FROM piece WHERE rest <> ''))),
    unit AS (SELECT document_id, n, part, text, {count_words_sql("text")} AS w, count(*) OVER (PARTITION BY document_id, n) AS parts
             FROM piece WHERE part > 0),
    u AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY n, part) AS m FROM unit),
    pk AS (SELECT document_id, m, w AS filled, 1 AS chunk, parts > 1 AS shut FROM u WHERE m = 1
           UNION ALL
           SELECT u.document_id, u.m, CASE WHEN pk.shut OR u.parts > 1 OR pk.filled + u.w > {CHUNK_WORDS} THEN u.w ELSE pk.filled + u.w END,
                  pk.chunk + CASE WHEN pk.shut OR u.parts > 1 OR pk.filled + u.w > {CHUNK_WORDS} THEN 1 ELSE 0 END, u.parts > 1
           FROM pk JOIN u ON u.document_id = pk.document_id AND u.m = pk.m + 1)
    SELECT document_id, chunk AS chunk_index, {X.numbered_sql("chunk_", "chunk")} AS chunk_id,
           string_agg({X.numbered_sql("p", "n")}, ',' ORDER BY m) AS paragraph_ids, string_agg(text, chr(10) || chr(10) ORDER BY m) AS text,
           sum(w)::BIGINT AS source_word_count, max(parts) > 1 AS contains_partial_paragraph, min(part) = 1 AS starts_paragraph,
           min(part) > 1 AS continues_paragraph, max(parts) = 1 OR min(part) = max(parts) AS ends_paragraph,
           CASE WHEN max(parts) > 1 THEN 'paragraph_too_long' END AS split_reason
    FROM pk JOIN u USING (document_id, m) GROUP BY document_id, chunk""")
def manuscript_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's text in chunks; tested against a plain loop."""
    rows = unique_rows(table(spark, folder, "documents").select("document_id", "text"), "document_id")
    return chunks.chunked(rows, most=CHUNK_WORDS).withColumn("paragraph_ids", F.array_join("paragraph_ids", ","))


def _stored_chunks(spark: SparkSession, folder: str) -> DataFrame:
    return unique_rows(table(spark, folder, "chunks"), "document_id", "chunk_id")


@add(f"""WITH {PARAGRAPHS_SQL},
    c AS (SELECT DISTINCT ON (document_id, chunk_id) document_id, chunk_id, paragraph_ids FROM chunks),
    i AS (SELECT document_id, chunk_id, unnest(paragraph_ids) AS paragraph_id,
                 generate_subscripts(paragraph_ids, 1) - 1 AS position FROM c)
    SELECT i.document_id, chunk_id, position::INTEGER AS position, paragraph_id, block_id, block_type, words
    FROM i JOIN p ON p.document_id = i.document_id AND {X.numbered_sql("p", "n")} = paragraph_id""")
def chunk_blocks(spark: SparkSession, folder: str) -> DataFrame:
    """The blocks of the stored chunks, in order."""
    rows = chunks.chunk_blocks(_stored_chunks(spark, folder), _paragraphs(spark, folder).drop("text"))
    return rows.select("document_id", "chunk_id", "position", "paragraph_id", "block_id", "block_type", "words")


@add(f"""WITH c AS (SELECT DISTINCT ON (document_id, chunk_id) * FROM chunks)
    SELECT document_id, chunk_id, chunk_index, source_word_count AS stored_words, {count_words_sql("text")} AS counted_words
    FROM c WHERE source_word_count IS DISTINCT FROM {count_words_sql("text")}""")
def chunk_word_errors(spark: SparkSession, folder: str) -> DataFrame:
    """Chunks whose stored number of words is missing or wrong."""
    rows = _stored_chunks(spark, folder).withColumn("counted_words", count_words(F.col("text")))
    return rows.where(~F.col("source_word_count").eqNullSafe(F.col("counted_words"))).select(
        "document_id", "chunk_id", "chunk_index", F.col("source_word_count").alias("stored_words"), "counted_words"
    )


@add(f"""WITH c AS (SELECT DISTINCT ON (document_id, chunk_id) * FROM chunks)
    SELECT document_id, chunk_id, array_to_string(list(chunk_id) OVER (PARTITION BY document_id ORDER BY chunk_index, chunk_id
           ROWS BETWEEN {CONTEXT} PRECEDING AND 1 PRECEDING), ',') AS previous FROM c""")
def context_windows(spark: SparkSession, folder: str) -> DataFrame:
    """The chunks before each chunk that give its context."""
    rows = progress.preceding(_stored_chunks(spark, folder), CONTEXT, "chunk_index", "chunk_id")
    return rows.select("document_id", "chunk_id", F.nullif(F.array_join("previous", ","), F.lit("")).alias("previous"))


@add(f"""WITH c AS (SELECT DISTINCT ON (document_id, chunk_id) * FROM chunks),
    r AS (SELECT *, coalesce(continues_paragraph, false) AND NOT coalesce(starts_paragraph, false) AS more,
                 {X.strip_sql("text")} AS t, row_number() OVER (PARTITION BY document_id ORDER BY chunk_index, chunk_id) AS i
          FROM c WHERE {X.strip_sql("text")} <> '')
    SELECT document_id, string_agg(CASE WHEN i = 1 THEN '' WHEN more THEN ' ' ELSE chr(10) || chr(10) END || t, '' ORDER BY i) AS text
    FROM r GROUP BY document_id""")
def reconstructed_texts(spark: SparkSession, folder: str) -> DataFrame:
    """Documents put together from their stored chunks."""
    return translations.reconstructed(_stored_chunks(spark, folder), "text")


@add(f"""WITH RECURSIVE {SECTIONED_SQL}
    SELECT document_id, {X.numbered_sql("sec_", "section")} AS section_id, string_agg(text, chr(10) || chr(10) ORDER BY n) AS text
    FROM s JOIN p USING (document_id, n) GROUP BY document_id, section""")
def section_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """One chunk a section."""
    return chunks.section_chunks(_sections(spark, folder), _paragraphs(spark, folder)).select("document_id", "section_id", "text")


@add(f"""WITH c AS (SELECT DISTINCT ON (document_id, chunk_id) * FROM chunks), {PARAGRAPHS_SQL},
    i AS (SELECT document_id, chunk_index, unnest(paragraph_ids) AS pid FROM c),
    m AS (SELECT i.document_id, block_id, chunk_index, {X.strip_sql("text")} AS t
          FROM i JOIN p ON p.document_id = i.document_id AND {X.numbered_sql("p", "n")} = pid)
    SELECT document_id, block_id, string_agg(t, ' ' ORDER BY chunk_index) AS translated_text FROM m GROUP BY document_id, block_id""")
def collected_parts(spark: SparkSession, folder: str) -> DataFrame:
    """Per block the parts it got in all chunks, joined in their order."""
    rows = chunks.chunk_blocks(_stored_chunks(spark, folder).drop("text"), _paragraphs(spark, folder))
    parts = rows.select(
        "document_id", "block_id", "chunk_index", F.lit(0).alias("part"), F.col("text").alias("translated_text"),
        F.lit(None).cast(translations.ROWS).alias("table_rows"),
    )
    return translations.collected(parts).drop("table_rows")


# ---- glossary ----


def _glossary(spark: SparkSession, folder: str) -> DataFrame:
    rows = unique_rows(table(spark, folder, "glossary"), "document_id", "entry_id")
    return glossary.sanitized(rows)


@add(f"""WITH g AS (SELECT DISTINCT ON (document_id, entry_id) * FROM glossary),
    t AS (SELECT document_id, entry_id, unnest(source_terms) AS term FROM g)
    SELECT DISTINCT document_id, entry_id, {X.term_key_sql("term")} AS term_key FROM t WHERE {X.term_key_sql("term")} <> ''""")
def glossary_keys(spark: SparkSession, folder: str) -> DataFrame:
    """The keys by which entries are compared."""
    rows = unique_rows(table(spark, folder, "glossary"), "document_id", "entry_id")
    rows = rows.select("document_id", "entry_id", F.explode("source_terms").alias("term"))
    return rows.select("document_id", "entry_id", X.term_key(F.col("term")).alias("term_key")).where("term_key <> ''").distinct()


@add(f"""WITH g AS (SELECT DISTINCT ON (document_id, entry_id) * FROM glossary),
    q AS (SELECT *, list_filter(list_transform(source_terms, lambda t: {X.strip_sql("t")}), lambda t: {X.term_key_sql("t")} <> '') AS ss,
                 list_filter(list_transform(target_terms, lambda t: {X.strip_sql("t")}), lambda t: {X.term_key_sql("t")} <> '') AS ts FROM g)
    SELECT document_id, entry_id, coalesce(nullif({X.strip_sql("preferred_target")}, ''), ts[1]) AS preferred_target,
           CASE WHEN lower({X.strip_sql("priority")}) IN ('low', 'medium', 'high') THEN lower({X.strip_sql("priority")}) ELSE 'medium' END AS priority,
           coalesce(nullif(lower({X.strip_sql("category")}), ''), 'other') AS category, coalesce({X.strip_sql("reason")}, '') AS reason
    FROM q WHERE len(ss) > 0 AND len(ts) > 0""")
def glossary_entries(spark: SparkSession, folder: str) -> DataFrame:
    """Entries with clean values."""
    return _glossary(spark, folder).select("document_id", "entry_id", "preferred_target", "priority", "category", "reason")


_CLEAN_TERM = X.strip_sql("replace(replace(t, chr(173), ''), chr(160), ' ')")
_BESIDE = "[^\\p{L}\\p{M}\\p{N}\\p{Pc}]"


@add(f"""WITH g AS (SELECT DISTINCT ON (document_id, entry_id) * FROM glossary),
    q AS (SELECT document_id, entry_id, lower({X.strip_sql("priority")}) AS priority,
                 list_filter(source_terms, lambda t: {X.term_key_sql("t")} <> '') AS ss, list_filter(target_terms, lambda t: {X.term_key_sql("t")} <> '') AS ts FROM g),
    c AS (SELECT DISTINCT ON (document_id, chunk_id) document_id, chunk_id, replace(replace(text, chr(173), ''), chr(160), ' ') AS text FROM chunks),
    t AS (SELECT DISTINCT document_id, entry_id, {_CLEAN_TERM} AS term FROM (SELECT document_id, entry_id, unnest(ss) AS t FROM q WHERE len(ss) > 0 AND len(ts) > 0)),
    m AS (SELECT document_id, entry_id, '(?i)' || CASE WHEN regexp_matches(term, '^[\\p{{L}}\\p{{N}}]') THEN '(?:^|{_BESIDE})' ELSE '' END
                 || array_to_string(list_transform(regexp_split_to_array(term, '\\s+'), lambda x: regexp_escape(x)), '\\s+')
                 || CASE WHEN regexp_matches(term, '[\\p{{L}}\\p{{N}}]$') THEN '(?:$|{_BESIDE})' ELSE '' END AS pattern FROM t WHERE term <> '')
    SELECT document_id, chunk_id, entry_id FROM c JOIN q USING (document_id) WHERE priority = 'high' AND len(ss) > 0 AND len(ts) > 0
    UNION
    SELECT c.document_id, chunk_id, entry_id FROM c JOIN m ON m.document_id = c.document_id WHERE regexp_matches(text, pattern)""")
def glossary_relevant(spark: SparkSession, folder: str) -> DataFrame:
    """The entries that matter for each stored chunk."""
    entries = _glossary(spark, folder).select("document_id", "entry_id", "priority", "source_terms")
    rows = glossary.relevant(entries, _stored_chunks(spark, folder).select("document_id", "chunk_id", "text"))
    return rows.select("document_id", "chunk_id", "entry_id")


def _unique_sql(terms: str) -> str:
    """Trimmed terms, without blank ones and those that equal an earlier one by key."""
    kept = f"list_filter(list_transform({terms}, lambda t: {X.strip_sql('t')}), lambda t: {X.term_key_sql('t')} <> '')"
    keys = f"list_transform({kept}, lambda t: {X.term_key_sql('t')})"
    return f"list_filter({kept}, lambda t, i: list_position({keys}, {X.term_key_sql('t')}) = i)"


def _keys_sql(terms: str) -> str:
    return f"list_transform({terms}, lambda t: {X.term_key_sql('t')})"


_NEW = """{'ss': n.ss, 'sk': n.sk, 'ts': n.ts, 'tk': n.tk, 'pref': n.pref, 'cat': n.cat, 'prio': n.prio, 'n': 1, 'reason': n.reason,
    'first': n.chunk, 'last': n.chunk}"""


def _joined(a: str, ak: str, b: str, bk: str) -> str:
    return f"list_concat({a}, list_filter({b}, lambda t, i: NOT list_contains({ak}, {bk}[i])))"


_OLD = f"""{{'ss': {_joined("o.ss", "o.sk", "n.ss", "n.sk")}, 'sk': list_concat(o.sk, list_filter(n.sk, lambda k: NOT list_contains(o.sk, k))),
    'ts': {_joined("o.ts", "o.tk", "n.ts", "n.tk")}, 'tk': list_concat(o.tk, list_filter(n.tk, lambda k: NOT list_contains(o.tk, k))),
    'pref': o.pref, 'cat': CASE WHEN o.cat = 'other' THEN n.cat ELSE o.cat END,
    'prio': CASE WHEN n.prio > o.prio THEN n.prio ELSE o.prio END, 'n': o.n + 1,
    'reason': CASE WHEN o.reason = '' THEN n.reason ELSE o.reason END, 'first': o.first, 'last': n.chunk}}"""


@add(f"""WITH RECURSIVE g AS (SELECT DISTINCT ON (document_id, entry_id) * FROM glossary),
    q AS (SELECT document_id, entry_id, coalesce(first_seen_chunk_id, '') AS chunk, {_unique_sql("source_terms")} AS ss, {_unique_sql("target_terms")} AS ts0,
                 nullif({X.strip_sql("preferred_target")}, '') AS wanted, coalesce({X.strip_sql("reason")}, '') AS reason,
                 coalesce(nullif(lower({X.strip_sql("category")}), ''), 'other') AS cat,
                 coalesce(list_position(['low', 'medium', 'high'], lower({X.strip_sql("priority")})), 2) AS prio FROM g),
    w AS (SELECT *, coalesce(wanted, ts0[1]) AS pref FROM q WHERE len(ss) > 0 AND len(ts0) > 0),
    v AS (SELECT *, CASE WHEN list_contains({_keys_sql("ts0")}, {X.term_key_sql("pref")}) THEN ts0 ELSE list_concat([pref], ts0) END AS ts FROM w),
    n AS (SELECT *, {_keys_sql("ss")} AS sk, {_keys_sql("ts")} AS tk, row_number() OVER (PARTITION BY document_id ORDER BY chunk, entry_id) AS m FROM v),
    f AS (SELECT document_id, m, [{_NEW}] AS state FROM n WHERE m = 1
          UNION ALL
          SELECT n.document_id, n.m, CASE WHEN coalesce(spot, 0) = 0 THEN list_append(state, {_NEW})
                     ELSE list_transform(state, lambda o, i: CASE WHEN i = spot THEN {_OLD} ELSE o END) END
          FROM (SELECT f.document_id, f.m, f.state, list_position(list_transform(f.state, lambda o: len(list_intersect(o.sk, x.sk)) > 0), true) AS spot
                FROM f JOIN n x ON x.document_id = f.document_id AND x.m = f.m + 1) f
               JOIN n ON n.document_id = f.document_id AND n.m = f.m + 1),
    z AS (SELECT document_id, arg_max(state, m) AS state FROM f GROUP BY document_id),
    e AS (SELECT document_id, unnest(state) AS o, generate_subscripts(state, 1) AS i FROM z)
    SELECT document_id, {X.numbered_sql("g", "i")} AS entry_id, array_to_string(o.ss, '|') AS source_terms, array_to_string(o.ts, '|') AS target_terms,
           o.pref AS preferred_target, o.cat AS category, ['low', 'medium', 'high'][o.prio] AS priority, o.n::INTEGER AS usage_count, o.reason AS reason,
           nullif(o.first, '') AS first_seen_chunk_id, nullif(o.last, '') AS last_seen_chunk_id FROM e""")
def glossary_merged(spark: SparkSession, folder: str) -> DataFrame:
    """Glossaries folded anew from their entries, in the order in which they were first seen."""
    entries = _glossary(spark, folder).select(
        "document_id", F.col("first_seen_chunk_id").alias("chunk_id"), F.col("entry_id").alias("entry_ordinal"),
        "source_terms", "target_terms", "preferred_target", "category", "priority", "reason",
    )
    rows = glossary.merged(entries)
    return rows.withColumns({c: F.array_join(c, "|") for c in ("source_terms", "target_terms")})


# ---- answers of a model ----


def _tokens_sql(text: str) -> str:
    return f"regexp_extract_all({text}, '{X.TOKEN}')"


@add(f"""WITH {PARAGRAPHS_SQL}, c AS (SELECT DISTINCT ON (document_id, chunk_id) * FROM chunks),
    d AS (SELECT DISTINCT document_id, target_lang FROM documents),
    i AS (SELECT document_id, chunk_id, chunk_index, unnest(paragraph_ids) AS pid, generate_subscripts(paragraph_ids, 1) AS place FROM c),
    r AS (SELECT i.document_id, chunk_id, chunk_index, block_type = 'table' AS is_table, {X.strip_sql("text")} AS source, text,
                 coalesce('[' || target_lang || '] ' || text, text) AS echo,
                 row_number() OVER (PARTITION BY i.document_id, chunk_id ORDER BY place) AS k, count(*) OVER (PARTITION BY i.document_id, chunk_id) AS n,
                 list_transform(list_filter(string_split(text, chr(10)), lambda x: {X.strip_sql("x")} <> ''),
                   lambda l: list_transform(string_split(l, '|'), lambda c: {X.strip_sql("c")})) AS rows
          FROM i JOIN p ON p.document_id = i.document_id AND {X.numbered_sql("p", "n")} = pid JOIN d ON d.document_id = i.document_id),
    t AS (SELECT document_id, chunk_id, {X.strip_sql("string_agg(echo, chr(10) || chr(10) ORDER BY k)")} AS plain FROM r GROUP BY ALL),
    q AS (SELECT r.*, plain, CASE WHEN chunk_index % 5 <> 0 THEN {X.strip_sql("echo")} WHEN n = 1 THEN plain
                 ELSE coalesce(list_filter(list_transform(regexp_split_to_array(plain, '\\n\\s*\\n'), lambda x: {X.strip_sql("x")}), lambda x: x <> '')[k], '') END AS given,
                 {X.strip_sql("array_to_string(list_transform(rows, lambda r: array_to_string(r, chr(9))), chr(10))")} AS lines
          FROM r JOIN t ON t.document_id = r.document_id AND t.chunk_id = r.chunk_id),
    s AS (SELECT *, given <> '' AND list_sort(list_distinct({_tokens_sql("given")})) = list_sort(list_distinct({_tokens_sql("text")}))
                 AND (NOT is_table OR list_transform(list_filter(string_split(given, chr(10)), lambda l: {X.strip_sql("l")} <> ''),
                        lambda l: len(string_split(l, chr(9)))) = list_transform(rows, lambda r: len(r))) AS safe FROM q),
    o AS (SELECT *, CASE WHEN safe THEN given WHEN given = '' THEN '' WHEN is_table AND lines <> '' THEN lines ELSE source END AS final FROM s)
    SELECT document_id, chunk_id, count(*) FILTER (WHERE final <> '')::INTEGER AS block_count,
           (max(CASE WHEN chunk_index % 5 = 0 THEN 1 ELSE 0 END) + sum(CASE WHEN safe THEN 0 WHEN given = '' THEN 1 ELSE 2 END))::INTEGER AS note_count,
           count(*) FILTER (WHERE final <> '' AND safe AND chunk_index % 5 <> 0)::INTEGER AS answered,
           coalesce(nullif(string_agg(final, chr(10) || chr(10) ORDER BY k) FILTER (WHERE final <> ''), ''),
                    CASE WHEN max(chunk_index % 5) = 0 THEN any_value(plain) ELSE '' END) AS translated_text
    FROM o GROUP BY document_id, chunk_id""")
def reconciled_answers(spark: SparkSession, folder: str) -> DataFrame:
    """The deterministic answerer's answers to the stored chunks, against the blocks asked for.

    The answer to every fifth chunk of a document is no JSON, as models will have it.
    """
    targets = unique_rows(table(spark, folder, "documents").select("document_id", "target_lang"), "document_id")
    rows = chunks.chunk_blocks(_stored_chunks(spark, folder).drop("text"), _paragraphs(spark, folder))
    rows = rows.join(targets, "document_id")
    spec = F.struct(
        "block_id", "paragraph_id", "block_type", F.col("text").alias("source_text"),
        F.when(F.col("block_type") == "table", tables.rows_of(F.col("text"))).alias("table_rows"),
    )
    answer = F.struct("block_id", "paragraph_id", _echo(F.col("target_lang"), F.col("text")).alias("translated_text"))
    asked = rows.groupBy("document_id", "chunk_id", "chunk_index").agg(
        F.array_sort(F.collect_list(F.struct("position", spec.alias("spec")))).alias("asked"),
        F.array_sort(F.collect_list(F.struct("position", answer.alias("answer")))).alias("given"),
    )
    given = F.transform("given", lambda x: x["answer"])
    plain = F.array_join(F.transform(given, lambda x: x["translated_text"]), "\n\n")
    broken = F.col("chunk_index") % 5 == 0
    asked = asked.select(
        "document_id", "chunk_id", F.to_json(F.transform("asked", lambda x: x["spec"])).alias("expected_json"),
        F.when(broken, plain).otherwise(F.to_json(F.struct(given.alias("block_translations")))).alias("output"),
        F.lit("{}").alias("earlier_json"),
    )
    found = reconcile.reconciled(asked)
    return found.select(
        "document_id", "chunk_id", F.size("block_translations").alias("block_count"), F.size("notes").alias("note_count"),
        F.size(F.filter("block_translations", lambda b: b["origin"] == "answer")).alias("answered"), "translated_text",
    )


# ---- jobs and usage ----


@add(f"""WITH {JOBS_SQL} SELECT job_id, document_id, job_type, status, progress, updated_at FROM j""")
def current_jobs(spark: SparkSession, folder: str) -> DataFrame:
    """Each job once, in its latest state."""
    return activity.current_jobs(table(spark, folder, "jobs")).select(
        "job_id", "document_id", "job_type", "status", "progress", "updated_at"
    )


@add(f"""WITH {JOBS_SQL}
    SELECT owner_user_id, count(*) AS open_jobs, min(created_at) AS oldest FROM j
    WHERE status IN ('queued', 'running') AND job_type LIKE '%translate%' GROUP BY owner_user_id""")
def open_jobs_by_owner(spark: SparkSession, folder: str) -> DataFrame:
    """Translation jobs that wait or run, by owner."""
    jobs = activity.current_jobs(table(spark, folder, "jobs"))
    some = jobs.where(F.col("status").isin("queued", "running") & F.col("job_type").contains("translate"))
    return some.groupBy("owner_user_id").agg(F.count("*").alias("open_jobs"), F.min("created_at").alias("oldest"))


@add(f"""WITH {JOBS_SQL}
    SELECT job_id, json_extract_string(payload_json, '$.target_language') AS target_language,
           json_extract_string(payload_json, '$.mode') AS mode,
           json_extract_string(result_json, '$.translated_blocks')::INTEGER AS translated_blocks FROM j""")
def job_payloads(spark: SparkSession, folder: str) -> DataFrame:
    """Values by path out of the jobs' JSON columns; broken JSON gives nulls."""
    jobs = activity.current_jobs(table(spark, folder, "jobs"))
    return jobs.select(
        "job_id", F.get_json_object("payload_json", "$.target_language").alias("target_language"),
        F.get_json_object("payload_json", "$.mode").alias("mode"),
        F.get_json_object("result_json", "$.translated_blocks").cast("int").alias("translated_blocks"),
    )


@add(f"""WITH {JOBS_SQL},
    r AS (SELECT *, row_number() OVER (PARTITION BY document_id, job_type ORDER BY created_at DESC, job_id DESC) AS rk FROM j)
    SELECT document_id, job_type, job_id, status FROM r WHERE rk = 1""")
def latest_job_by_document(spark: SparkSession, folder: str) -> DataFrame:
    """The last job of each kind of each document."""
    jobs = activity.current_jobs(table(spark, folder, "jobs"))
    last = F.max_by(F.struct("job_id", "status"), F.struct("created_at", "job_id")).alias("j")
    return jobs.groupBy("document_id", "job_type").agg(last).select("document_id", "job_type", "j.job_id", "j.status")


@add(f"""WITH {USAGE_SQL} SELECT owner_user_id, document_id, {USAGE_COLUMNS_SQL} FROM u GROUP BY owner_user_id, document_id""")
def usage_by_document(spark: SparkSession, folder: str) -> DataFrame:
    """Sums of usage by owner and document."""
    return activity.usage_summary(activity.single_usage(table(spark, folder, "usage_records")), "owner_user_id", "document_id")


@add(f"""WITH {USAGE_SQL} SELECT owner_user_id, {USAGE_COLUMNS_SQL} FROM u GROUP BY owner_user_id""")
def usage_by_owner(spark: SparkSession, folder: str) -> DataFrame:
    """Sums of usage by owner."""
    return activity.usage_summary(activity.single_usage(table(spark, folder, "usage_records")), "owner_user_id")


@add(f"""WITH {USAGE_SQL},
    d AS (SELECT owner_user_id, created_at::DATE AS day, sum(coalesce(word_count, 0))::BIGINT AS day_sum FROM u GROUP BY ALL)
    SELECT owner_user_id, day, day_sum, sum(day_sum) OVER (PARTITION BY owner_user_id ORDER BY day)::BIGINT AS sum_so_far FROM d""")
def usage_running_totals(spark: SparkSession, folder: str) -> DataFrame:
    """Words by owner and day, with the sum so far."""
    return activity.running_totals(activity.single_usage(table(spark, folder, "usage_records")), "owner_user_id", "word_count")


@add(f"""WITH {USAGE_SQL} SELECT usage_id, document_id FROM u WHERE loaded_at > created_at + INTERVAL 7 DAY""")
def late_usage(spark: SparkSession, folder: str) -> DataFrame:
    """Records that came more than a week late."""
    return activity.late(activity.single_usage(table(spark, folder, "usage_records")), 7).select("usage_id", "document_id")


@add(f"""WITH {USAGE_SQL}, {JOBS_SQL},
    o AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY created_at NULLS LAST, usage_id) AS r2 FROM u) WHERE r2 = 1)
    SELECT coalesce(o.job_id, j.job_id) AS job_id, usage_id, j.job_id IS NOT NULL AS job_known, j.status
    FROM o FULL JOIN (SELECT job_id, status FROM j) j ON j.job_id = o.job_id""")
def usage_of_jobs(spark: SparkSession, folder: str) -> DataFrame:
    """The one record of each job; jobs without a record and records without a job stand alone."""
    once = activity.once_a_job(table(spark, folder, "usage_records")).select("job_id", "usage_id")
    known = activity.current_jobs(table(spark, folder, "jobs")).select("job_id", "status", F.lit(True).alias("job_known"))
    return once.join(known, "job_id", "full").withColumn("job_known", F.coalesce("job_known", F.lit(False)))


@add(f"""WITH {USAGE_SQL}, {JOBS_SQL},
    o AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY created_at NULLS LAST, usage_id) AS r2 FROM u) WHERE r2 = 1)
    SELECT o.job_id, usage_id FROM o ANTI JOIN (SELECT job_id FROM j WHERE job_type = 'translate_next') k ON k.job_id = o.job_id
    WHERE o.job_id IS NOT NULL""")
def usage_recorded(spark: SparkSession, folder: str) -> DataFrame:
    """Records that are added to a ledger which has the jobs of one kind: one a job, none that it has already."""
    once = activity.once_a_job(table(spark, folder, "usage_records")).where("job_id is not null").select("job_id", "usage_id")
    ledger = activity.current_jobs(table(spark, folder, "jobs")).where("job_type = 'translate_next'").select("job_id")
    return activity.appended(ledger, once, "job_id")


@add("""SELECT owner_user_id, count(DISTINCT document_id) AS uploads, max(created_at) AS latest FROM documents
    WHERE created_at >= TIMESTAMPTZ '2025-01-01 00:00:00+00' GROUP BY owner_user_id""")
def uploads_since(spark: SparkSession, folder: str) -> DataFrame:
    """Uploads of each owner since the beginning of 2025."""
    rows = table(spark, folder, "documents").where(F.col("created_at") >= F.lit("2025-01-01").cast("timestamp"))
    rows = unique_rows(rows.select("owner_user_id", "document_id", "created_at"), "document_id")
    return rows.groupBy("owner_user_id").agg(F.count("*").alias("uploads"), F.max("created_at").alias("latest"))


@add("""SELECT DISTINCT document_id, original_filename, source_format, created_at FROM documents
    ORDER BY created_at DESC, document_id LIMIT 40""")
def latest_documents(spark: SparkSession, folder: str) -> DataFrame:
    """The first page of the list of documents, newest first."""
    rows = unique_rows(table(spark, folder, "documents").select("document_id", "original_filename", "source_format", "created_at"), "document_id")
    return activity.page(rows, [F.desc("created_at"), F.asc("document_id")], 0, 40)


@add("""SELECT source_format, CASE WHEN lower(regexp_extract(original_filename, '(\\.[^.]+)$', 1)) IN ('.txt', '.docx', '.epub')
            THEN substr(lower(regexp_extract(original_filename, '(\\.[^.]+)$', 1)), 2) ELSE 'unsupported' END AS routed, count(*) AS documents
    FROM (SELECT DISTINCT document_id, source_format, original_filename FROM documents) GROUP BY ALL""")
def routed_formats(spark: SparkSession, folder: str) -> DataFrame:
    """To which reader a document's file name leads."""
    from ..sources.packages import route

    rows = unique_rows(table(spark, folder, "documents").select("document_id", "source_format", "original_filename"), "document_id")
    return rows.groupBy("source_format", route(F.col("original_filename")).alias("routed")).agg(F.count("*").alias("documents"))
