"""Queries of a workspace: jobs by key, interrupted jobs, exports, owners, pages, context, requests, the whole workflow."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import activity, prompts, tables, translations
from ..session import kept_until_end, shared_dir
from ..sources import packages, store
from ..tables import table, unique_rows
from . import catalog, translate
from .catalog import CONTEXT, ENTRIES_SQL, JOBS_SQL, PARAGRAPHS_SQL, SECTIONED_SQL, add

# ---- jobs ----

KEY = "fast"


@add(f"""WITH {JOBS_SQL},
    q AS (SELECT DISTINCT d.document_id, t.job_type, 'German' AS target_language
          FROM documents d CROSS JOIN (VALUES ('translate_next'), ('translate_rest')) t(job_type)),
    k AS (SELECT *, row_number() OVER (PARTITION BY document_id, job_type ORDER BY created_at DESC, job_id DESC) AS r2
          FROM j WHERE json_extract_string(payload_json, '$.mode') = '{KEY}')
    SELECT q.document_id, q.job_type, k.job_id,
           CASE WHEN k.job_id IS NULL THEN 'new'
                WHEN json_extract_string(payload_json, '$.target_language') = q.target_language AND len(json_keys(payload_json)) = 2
                THEN 'replay' ELSE 'conflict' END AS answer
    FROM q LEFT JOIN k ON k.document_id = q.document_id AND k.job_type = q.job_type AND r2 = 1""")
def job_replays(spark: SparkSession, folder: str) -> DataFrame:
    """What a request under a key gets: a new job, the last one with that key again, or a conflict.

    Jobs of these tables carry no key of their own, so their mode stands for it.
    """
    jobs = activity.current_jobs(table(spark, folder, "jobs"))
    asked = table(spark, folder, "documents").select("document_id").distinct()
    asked = asked.select("document_id", F.explode(F.array(F.lit("translate_next"), F.lit("translate_rest"))).alias("job_type"))
    payload = F.to_json(F.create_map(F.lit("target_language"), F.lit("German"), F.lit("mode"), F.lit(KEY)))
    asked = asked.withColumns({"key": F.lit(KEY), "payload_json": payload})
    return activity.replayed(jobs, asked, F.get_json_object("payload_json", "$.mode")).select(
        "document_id", "job_type", "job_id", "answer"
    )


@add(f"""WITH {JOBS_SQL},
    i AS (SELECT *, status IN ('queued', 'running') AND job_type IN ('translate_next', 'retranslate_last', 'translate_rest') AS hit FROM j)
    SELECT job_id, document_id, job_type, CASE WHEN hit THEN 'failed' ELSE status END AS status,
           CASE WHEN hit THEN 100 ELSE progress END AS progress, coalesce(hit, false) AS interrupted FROM i""")
def swept_jobs(spark: SparkSession, folder: str) -> DataFrame:
    """All jobs after a restart: those that waited or ran have failed."""
    jobs = activity.interrupted(activity.current_jobs(table(spark, folder, "jobs")))
    return jobs.select("job_id", "document_id", "job_type", "status", "progress", "interrupted")


@add(f"""WITH {JOBS_SQL},
    h AS (SELECT job_id, max_by(word_count, loaded_at) AS w, max(loaded_at) AS t FROM (SELECT DISTINCT job_id, word_count, loaded_at FROM usage_records) GROUP BY job_id)
    SELECT job_id, document_id, status, CASE WHEN h.t IS NULL THEN progress ELSE 100 END AS progress,
           CASE WHEN h.t IS NULL OR h.w IS NULL THEN message ELSE h.w::VARCHAR || ' words' END AS message, greatest(updated_at, h.t) AS updated_at
    FROM j LEFT JOIN h USING (job_id)""")
def changed_jobs(spark: SparkSession, folder: str) -> DataFrame:
    """Jobs after what their usage records say of them: done, with the words that were translated."""
    usage = table(spark, folder, "usage_records").select(
        "job_id", F.col("loaded_at").alias("changed_at"), F.concat(F.col("word_count").cast("string"), F.lit(" words")).alias("message"), F.lit(100).alias("progress")
    )
    jobs = activity.changed(activity.current_jobs(table(spark, folder, "jobs")), usage)
    return jobs.select("job_id", "document_id", "status", "progress", "message", "updated_at")


@add("""SELECT DISTINCT * FROM jobs""")
def stored_jobs(spark: SparkSession, folder: str) -> DataFrame:
    """The table of jobs written by day, read back, written as lines of JSON and read back again."""
    base = f"{shared_dir(spark).rstrip('/')}/store-{uuid.uuid4().hex}"
    jobs = table(spark, folder, "jobs").distinct()
    store.save(jobs, base, "jobs")
    kept_until_end(spark, base)
    rows = store.load(spark, base, "jobs", jobs.schema).drop("created_day")
    store.export_json(rows, f"{base}/lines")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    return store.import_json(spark, f"{base}/lines", schema).where("broken is null").drop("broken").select(*rows.columns)


@add(f"""WITH {PARAGRAPHS_SQL}, {ENTRIES_SQL}, {JOBS_SQL},
    n AS (SELECT p.document_id, count(*) AS translatable_block_count,
                 count(*) FILTER (WHERE {X.strip_sql("raw_text")} <> '') AS applied_unit_count
          FROM p LEFT JOIN e ON e.document_id = p.document_id AND e.block_id = p.block_id GROUP BY p.document_id),
    x AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY updated_at DESC, job_id DESC) AS r2
          FROM j WHERE job_type = 'export' AND status = 'succeeded')
    SELECT x.document_id, x.job_id AS export_id, x.updated_at AS exported_at,
           'translated_document' || CASE d.source_format WHEN 'docx' THEN '.docx' WHEN 'epub' THEN '.epub' ELSE '.txt' END AS output_name,
           coalesce(n.translatable_block_count, 0) AS translatable_block_count, coalesce(n.applied_unit_count, 0) AS applied_unit_count
    FROM x JOIN (SELECT DISTINCT document_id, source_format FROM documents) d USING (document_id)
         LEFT JOIN n ON n.document_id = x.document_id WHERE r2 = 1""")
def latest_exports(spark: SparkSession, folder: str) -> DataFrame:
    """The last export of each document with what it applied; earlier ones are kept but not shown."""
    jobs = activity.current_jobs(table(spark, folder, "jobs")).where("job_type = 'export' and status = 'succeeded'")
    formats = unique_rows(table(spark, folder, "documents").select("document_id", "source_format"), "document_id")
    counts = translations.application_counts(catalog._paragraphs(spark, folder), catalog._entries(spark, folder))
    records = jobs.select("document_id", F.col("job_id").alias("export_id"), F.col("updated_at").alias("exported_at"))
    rows = activity.latest_exports(records).join(formats, "document_id").join(counts, "document_id", "left")
    return rows.select(
        "document_id", "export_id", "exported_at", packages.exported_name(F.col("source_format")).alias("output_name"),
        F.coalesce("translatable_block_count", F.lit(0)).alias("translatable_block_count"),
        F.coalesce("applied_unit_count", F.lit(0)).alias("applied_unit_count"),
    )


# ---- owners and pages ----

OWNER, PROVIDER = "usr_atelier_nord", "google"


@add(f"""SELECT document_id, original_filename, created_at, owner_auth_provider IS NOT DISTINCT FROM '{PROVIDER}' AS same_provider
    FROM (SELECT DISTINCT ON (document_id) * FROM documents) WHERE owner_user_id = '{OWNER}'""")
def documents_of_owner(spark: SparkSession, folder: str) -> DataFrame:
    """All documents of one owner; the filter reaches the scan."""
    rows = activity.owned(table(spark, folder, "documents"), OWNER)
    rows = rows.select("document_id", "original_filename", "created_at", F.col("owner_auth_provider").eqNullSafe(PROVIDER).alias("same_provider"))
    return unique_rows(rows, "document_id")


@add(f"""WITH {JOBS_SQL}, d AS (SELECT DISTINCT document_id, owner_user_id FROM documents)
    SELECT job_id, j.document_id, coalesce(j.owner_user_id = d.owner_user_id, false) AS allowed
    FROM j LEFT JOIN d ON d.document_id = j.document_id""")
def job_access(spark: SparkSession, folder: str) -> DataFrame:
    """For every job, whether its owner may see the document it is about."""
    owners = unique_rows(table(spark, folder, "documents").select("document_id", "owner_user_id"), "document_id")
    jobs = activity.current_jobs(table(spark, folder, "jobs")).select("job_id", "document_id", "owner_user_id")
    return activity.authorized(jobs, owners).select("job_id", "document_id", "allowed")


PAGE_OFFSET, PAGE_LIMIT = 3, 4


@add(f"""WITH RECURSIVE {SECTIONED_SQL}, {ENTRIES_SQL},
    t AS (SELECT document_id, block_id, {X.strip_sql("raw_text")} AS tt FROM e WHERE {X.strip_sql("raw_text")} <> ''),
    q AS (SELECT p.document_id, p.block_id, p.n, s.section, tt, text, count(*) OVER (PARTITION BY p.document_id) AS total_blocks
          FROM p JOIN s ON s.document_id = p.document_id AND s.n = p.n
               LEFT JOIN t ON t.document_id = p.document_id AND t.block_id = p.block_id)
    SELECT document_id, block_id, {X.numbered_sql("sec_", "section")} AS section_id,
           CASE WHEN tt IS NULL THEN 'source' ELSE 'translated' END AS status, total_blocks,
           ({PAGE_OFFSET} // {PAGE_LIMIT} + 1)::INTEGER AS page, ((total_blocks - 1) // {PAGE_LIMIT} + 1)::INTEGER AS page_count,
           true AS has_previous, {PAGE_OFFSET + PAGE_LIMIT} < total_blocks AS has_next,
           regexp_replace(coalesce(tt, text), '{X.TOKEN}', '', 'g') AS display_text
    FROM q WHERE n > {PAGE_OFFSET} AND n <= {PAGE_OFFSET + PAGE_LIMIT}""")
def preview_page(spark: SparkSession, folder: str) -> DataFrame:
    """One page of every document's preview, each block with its section and what lies before and after."""
    paragraphs = catalog._paragraphs(spark, folder)
    rows = translations.shown(paragraphs, catalog._entries(spark, folder))
    planned = catalog._sections(spark, folder)
    rows = translations.page(rows, PAGE_OFFSET, PAGE_LIMIT).join(translations.block_sections(planned), ["document_id", "block_id"], "left")
    return rows.select(
        "document_id", "block_id", "section_id", "status", "total_blocks", "page", "page_count", "has_previous", "has_next", "display_text"
    )


# ---- a second parse ----

_UNITS_SQL = f"""{PARAGRAPHS_SQL},
    r AS (SELECT document_id, list_filter(list_transform(string_split(text, chr(10) || chr(10)), lambda x: {X.strip_sql("x")}), lambda x: x <> '') AS us
          FROM (SELECT DISTINCT document_id, text FROM documents)),
    v AS (SELECT document_id, unnest(us) AS unit, generate_subscripts(us, 1) AS n FROM r),
    w AS (SELECT document_id, n, CASE WHEN contains(unit, ' | ') THEN 'table' ELSE 'text' END AS kind, length(unit) AS about FROM v),
    x AS (SELECT coalesce(p.document_id, w.document_id) AS document_id, coalesce(p.n, w.n) AS n, block_id, kind, about,
                 CASE WHEN w.n IS NULL THEN 'missing' WHEN p.n IS NULL THEN 'unused'
                      WHEN coalesce(block_type = 'table', false) = (kind = 'table') THEN 'matched' ELSE 'mismatched' END AS status
          FROM p FULL JOIN w ON w.document_id = p.document_id AND w.n = p.n)"""


def _enriched(spark: SparkSession, folder: str) -> DataFrame:
    texts = unique_rows(table(spark, folder, "documents").select("document_id", "text"), "document_id")
    units = F.filter(F.transform(F.split("text", "\n\n"), X.strip), lambda u: u != "")
    units = texts.select("document_id", F.posexplode(units).alias("at", "unit")).select(
        "document_id", (F.col("at") + 1).alias("n"), F.when(F.col("unit").contains(" | "), "table").otherwise("text").alias("kind"),
        F.length("unit").cast("bigint").alias("about"),
    )
    return tables.enriched(catalog._paragraphs(spark, folder), units)


@add(f"""WITH {_UNITS_SQL}
    SELECT document_id, n::BIGINT AS n, block_id, kind AS unit_kind, CASE WHEN status = 'matched' THEN about END AS about, status FROM x""")
def enriched_blocks(spark: SparkSession, folder: str) -> DataFrame:
    """Blocks beside the parts of their document's text, which stand for a second parse: kind and length of each."""
    rows = _enriched(spark, folder)
    return rows.select("document_id", F.col("n").cast("bigint").alias("n"), "block_id", "unit_kind", "about", "status")


@add(f"""WITH {_UNITS_SQL},
    c AS (SELECT document_id, count(*) FILTER (WHERE status <> 'missing') AS units, count(*) FILTER (WHERE status = 'matched') AS matched_units,
                 count(*) FILTER (WHERE status = 'unused') AS unused_units, count(*) FILTER (WHERE status IN ('mismatched', 'missing')) AS mismatches
          FROM x GROUP BY document_id)
    SELECT *, CASE WHEN mismatches = 0 AND unused_units = 0 THEN 'ok' ELSE 'partial' END AS status FROM c""")
def enrichment_reports(spark: SparkSession, folder: str) -> DataFrame:
    """How well the two parses of each document agree."""
    return tables.enrichment_reports(_enriched(spark, folder))


# ---- context and requests ----

_CHUNKS_SQL = "c AS (SELECT DISTINCT ON (document_id, chunk_id) * FROM chunks)"
_TRANSLATED_SQL = f"""{PARAGRAPHS_SQL}, {ENTRIES_SQL}, {_CHUNKS_SQL},
    ids AS (SELECT document_id, chunk_id, unnest(paragraph_ids) AS pid, generate_subscripts(paragraph_ids, 1) AS place FROM c),
    got AS (SELECT ids.document_id, chunk_id, place, {X.strip_sql("raw_text")} AS t
            FROM ids JOIN p ON p.document_id = ids.document_id AND {X.numbered_sql("p", "n")} = pid
                 JOIN e ON e.document_id = p.document_id AND e.block_id = p.block_id),
    ct AS (SELECT document_id, chunk_id, string_agg(t, chr(10) || chr(10) ORDER BY place) AS translated_text
           FROM got WHERE t <> '' GROUP BY ALL),
    w AS (SELECT c.*, ct.translated_text FROM c LEFT JOIN ct ON ct.document_id = c.document_id AND ct.chunk_id = c.chunk_id)"""


def _chunks_with_translations(spark: SparkSession, folder: str) -> DataFrame:
    """The stored chunks, each with the translations of its blocks that there are."""
    chunks = catalog._stored_chunks(spark, folder)
    ids = chunks.select("document_id", "chunk_id", F.posexplode("paragraph_ids").alias("place", "paragraph_id"))
    known = catalog._paragraphs(spark, folder).select("document_id", "paragraph_id", "block_id")
    rows = ids.join(known, ["document_id", "paragraph_id"])
    rows = rows.join(catalog._entries(spark, folder).where("translated_text <> ''"), ["document_id", "block_id"])
    rows = rows.groupBy("document_id", "chunk_id").agg(F.array_sort(F.collect_list(F.struct("place", F.col("translated_text").alias("t")))).alias("ts"))
    done = rows.select("document_id", "chunk_id", F.array_join(F.transform("ts", lambda t: t["t"]), "\n\n").alias("translated_text"))
    return chunks.join(done, ["document_id", "chunk_id"], "left")


@add(f"""WITH {_TRANSLATED_SQL},
    z AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY chunk_index, chunk_id) AS m FROM w)
    SELECT a.document_id, a.chunk_id, (b.m - greatest(a.m - {CONTEXT}, 1))::INTEGER AS position, b.chunk_id AS previous_id,
           array_to_string(b.paragraph_ids, ',') AS paragraph_ids, b.continues_paragraph, b.ends_paragraph, b.text AS source_text, b.translated_text
    FROM z a JOIN z b ON b.document_id = a.document_id AND b.m < a.m AND b.m >= a.m - {CONTEXT}""")
def chunk_context(spark: SparkSession, folder: str) -> DataFrame:
    """All that a request tells of the chunks before each stored chunk: six fields of each."""
    rows = translate.with_context(_chunks_with_translations(spark, folder), CONTEXT)
    rows = rows.select("document_id", "chunk_id", F.posexplode("previous").alias("position", "p"))
    return rows.select(
        "document_id", "chunk_id", "position", F.col("p.chunk_id").alias("previous_id"),
        F.array_join("p.paragraph_ids", ",").alias("paragraph_ids"), "p.continues_paragraph", "p.ends_paragraph", "p.source_text", "p.translated_text",
    )


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_OPEN = "coalesce(target_lang, 'the target language')"


def _part_sql(title: str, body: str) -> str:
    return f"CASE WHEN {body} IS NOT NULL AND {body} NOT IN ('', '[]') THEN chr(10) || chr(10) || '{title}' || chr(10) || {body} ELSE '' END"


@add(f"""WITH {_TRANSLATED_SQL}, d AS (SELECT DISTINCT document_id, target_lang FROM documents)
    SELECT w.document_id, chunk_id,
           'List the names and terms of this text that must be the same throughout its translation into ' || {_OPEN}
           || '. Answer with JSON: glossary, an array of source_terms, target_terms, preferred_target, category, priority and reason.'
           || {_part_sql("Text:", "text")} || {_part_sql("Translation:", "translated_text")} AS glossary_prompt,
           'Review this translation into ' || {_OPEN} || '. ' || {_quoted(prompts.REVIEW)}
           || {_part_sql("Text:", "text")} || {_part_sql("Translation:", "translated_text")} AS review_prompt,
           'Revise this translation into ' || {_OPEN} || '. ' || {_quoted(prompts.FORMS["general"])}
           || ' Change only what the remarks and the source support. Answer in the form of the first translation.'
           || CASE WHEN contains(text, '[[INLINE_') THEN ' Keep every inline token once.' ELSE '' END
           || {_part_sql("Remarks:", "'Mind the names.'")} || {_part_sql("Blocks:", "text")}
           || {_part_sql("First translation:", "translated_text")} AS revision_prompt
    FROM w JOIN d ON d.document_id = w.document_id""")
def pass_prompts(spark: SparkSession, folder: str) -> DataFrame:
    """What is asked for the terms, the review and the second pass of every stored chunk (blocks as plain text)."""
    languages = unique_rows(table(spark, folder, "documents").select("document_id", "target_lang"), "document_id")
    rows = _chunks_with_translations(spark, folder).join(languages, "document_id")
    lang, text, done, none = F.col("target_lang"), F.col("text"), F.col("translated_text"), F.lit(None).cast("string")
    advice, remarks = F.lit(prompts.FORMS["general"]), F.lit("Mind the names.")
    return rows.select(
        "document_id", "chunk_id", prompts.glossary_prompt(lang, text, done, none).alias("glossary_prompt"),
        prompts.review_prompt(lang, none, text, done).alias("review_prompt"),
        prompts.revision_prompt(lang, advice, remarks, none, none, text, done).alias("revision_prompt"),
    )


_KIND_SQL = " ".join(f"WHEN {_quoted(k)} THEN {_quoted(v)}" for k, v in prompts.KINDS.items())
_FORM_SQL = " ".join(f"WHEN {_quoted(k)} THEN {_quoted(v)}" for k, v in prompts.FORMS.items())


@add(f"""SELECT DISTINCT source_language, target_language, document_type, content_form,
        'Source language: ' || coalesce(source_language, 'English') || chr(10) || 'Target language: ' || coalesce(target_language, 'the target language')
        || chr(10) || 'Content form: ' || coalesce(content_form, 'general') || chr(10) || 'Document type: ' || coalesce(document_type, 'general')
        || chr(10) || CASE lower(content_form) {_FORM_SQL} ELSE {_quoted(prompts.FORMS["general"])} END
        || chr(10) || CASE lower(document_type) {_KIND_SQL} ELSE {_quoted(prompts.KINDS["general"])} END AS brief
    FROM usage_records""")
def briefs(spark: SparkSession, folder: str) -> DataFrame:
    """The opening lines for every combination of languages, form and kind in use."""
    names = ["source_language", "target_language", "document_type", "content_form"]
    rows = table(spark, folder, "usage_records").select(*names).distinct()
    rows = prompts.with_advice(rows, prompts.guidance(spark)).withColumnRenamed("advice", "form_advice")
    rows = prompts.with_advice(rows, prompts.guidance(spark, prompts.KINDS), "document_type")
    made = prompts.brief(*(F.col(c) for c in ("source_language", "target_language", "content_form", "document_type", "form_advice", "advice")))
    return rows.select(*names, made.alias("brief"))


# ---- the whole workflow ----


def critic(request: dict) -> str:
    """A deterministic reviewer: it has remarks on German translations only."""
    return "Mind the names." if request.get("target_language") == "de" else ""


_MARK_SQL = "'[' || coalesce(target_lang, '?') || CASE WHEN target_lang = 'de' THEN '+' ELSE '' END || '] '"
_CELLS = f"""list_transform(list_filter(string_split(text, chr(10)), lambda x: {X.strip_sql("x")} <> ''),
    lambda l: list_transform(string_split(l, '|'), lambda c: {X.strip_sql("c")}))"""


@add(f"""WITH {PARAGRAPHS_SQL}, l AS (SELECT DISTINCT document_id, target_lang FROM documents)
    SELECT p.document_id, p.block_id, CASE WHEN block_type = 'table'
        THEN {X.strip_sql("array_to_string(list_transform(" + _CELLS + f", lambda r: array_to_string(list_transform(r, lambda c: CASE WHEN c = '' THEN c ELSE {_MARK_SQL} || c END), chr(9))), chr(10))")}
        ELSE {X.strip_sql(f"{_MARK_SQL} || text")} END AS translated_text
    FROM p JOIN l ON l.document_id = p.document_id""")
def workflow_blocks(spark: SparkSession, folder: str) -> DataFrame:
    """Every block after a first pass, a review and, where there are remarks, a second pass, in chunks of 300 words."""
    languages = unique_rows(table(spark, folder, "documents").select("document_id", "target_lang"), "document_id")
    out = translate.workflow(
        catalog._paragraphs(spark, folder), languages, translate.with_retries(translate.echo, timeout=0), critic, words=catalog.CHUNK_WORDS
    )
    return out.select("document_id", "block_id", "translated_text")
