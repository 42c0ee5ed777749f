"""Translation as a plan over tables: which section, what is asked, what comes of the answer, and a second pass.

What answers is a function from a request (a dict) to a text, an *answerer*; ``echo`` is a deterministic
one. ``with_retries`` wraps one so that errors which pass by themselves are tried again. Documents don't
depend on each other and are the unit of parallel work; within one, ``in_order`` and ``revised`` run chunk
after chunk, since each sees the context and glossary the earlier ones left. A failing call never ends a
job: the chunk keeps what it had, with the error beside it.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from functools import wraps
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import checks
from ..operators import glossary, progress, prompts, reconcile, sections, translations
from ..session import written

Answerer = Callable[[dict[str, Any]], str]
CONTEXT = 3
#: Of a batch run: repeats of a call, seconds before the first of them, and seconds that a call may take.
RETRIES, BASE_DELAY, TIMEOUT = 2, 2.0, 180.0


def with_retries(
    answerer: Answerer, retries: int = RETRIES, base_delay: float = BASE_DELAY, timeout: float = TIMEOUT,
    rules: tuple = checks.BATCH, sleep: Callable[[float], None] = time.sleep,
) -> Answerer:
    """An answerer that repeats calls whose error may pass, each time after twice the delay.

    A call that takes longer than ``timeout`` seconds (0: any time is allowed) is given up and counts as an
    error that passes. The last error is raised.
    """

    @wraps(answerer)
    def call(request: dict[str, Any]) -> str:
        delay = max(0.0, base_delay)
        for left in range(max(0, retries), -1, -1):
            try:
                if timeout <= 0:
                    return answerer(request)
                pool = ThreadPoolExecutor(1)
                try:
                    return pool.submit(answerer, request).result(timeout)
                finally:
                    pool.shutdown(wait=False)
            except Exception as error:
                if not left or not checks.passes(error, rules):
                    raise
                if delay:
                    sleep(delay)
                delay *= 2
        raise AssertionError("unreachable")

    return call


def _error(error: Exception) -> str:
    return f"{type(error).__name__}: {error}"


def echo(request: dict[str, Any]) -> str:
    """Answers with the source texts under a mark of the language; tables cell by cell. A second pass has a plus."""
    mark = f"[{request.get('target_language') or '?'}{'+' * bool(request.get('feedback'))}] "
    out = []
    for item in request["blocks"]:
        answer: dict[str, Any] = {"block_id": item["block_id"], "paragraph_id": item.get("paragraph_id")}
        if item.get("table_rows"):
            answer["table_rows"] = [[mark + c if c else c for c in row] for row in item["table_rows"]]
        answer["translated_text"] = mark + (item.get("source_text") or "")
        out.append(answer)
    return json.dumps({"block_translations": out}, ensure_ascii=False)


def selected_sections(status: DataFrame, again: bool = False) -> DataFrame:
    """The section of each document that comes next or, with ``again``, the one done last.

    A section with some blocks translated isn't taken up as the next one.
    """
    rows = progress.with_actions(status)
    if again:
        return rows.where("action = 'retranslate_last'")
    return rows.where("action = 'translate_next' and status = 'not_translated'")


def requests(selected: DataFrame, paragraphs: DataFrame, languages: DataFrame) -> DataFrame:
    """(document_id, chunk_id, chunk_index, target_language, expected_json, text) for selected sections."""
    ids = selected.select("document_id", "section_id", "section_index", F.posexplode("block_ids").alias("at", "block_id"))
    rows = ids.join(paragraphs, ["document_id", "block_id"])
    item = F.struct("at", prompts.block_item().alias("item"), "text")
    rows = rows.groupBy("document_id", "section_id", "section_index").agg(F.array_sort(F.collect_list(item)).alias("bs"))
    rows = rows.join(languages, "document_id", "left")
    return rows.select(
        "document_id", F.col("section_id").alias("chunk_id"), F.col("section_index").alias("chunk_index"),
        F.col("target_lang").alias("target_language"),
        F.to_json(F.transform("bs", lambda b: b["item"])).alias("expected_json"),
        F.array_join(F.transform("bs", lambda b: b["text"]), "\n\n").alias("text"),
    )


def context_struct(translated: Column) -> Column:
    """What a request tells of an earlier chunk; rows have chunk_id, text and, if they know, how paragraphs run."""
    return F.struct("chunk_id", "paragraph_ids", "continues_paragraph", "ends_paragraph", F.col("text").alias("source_text"),
                    translated.alias("translated_text"))


def with_context(chunks: DataFrame, context: int = CONTEXT) -> DataFrame:
    """``chunks`` with ``previous``, what is told of the chunks before each one, nearest last.

    Rows have document_id, chunk_id, chunk_index, text and translated_text; paragraph_ids,
    continues_paragraph and ends_paragraph where they are known.
    """
    kinds = {"paragraph_ids": "array<string>", "continues_paragraph": "boolean", "ends_paragraph": "boolean"}
    rows = chunks.withColumns({c: F.lit(None).cast(kind) for c, kind in kinds.items() if c not in chunks.columns})
    window = Window.partitionBy("document_id").orderBy("chunk_index", "chunk_id").rowsBetween(-context, -1)
    return rows.withColumn("previous", F.collect_list(context_struct(F.col("translated_text"))).over(window))


def prompted(asked: DataFrame, entries: DataFrame, advice: DataFrame, context: int = CONTEXT) -> DataFrame:
    """``asked`` with the text of each request: the chunks before it and the terms that matter in it."""
    rows = asked if "translated_text" in asked.columns else asked.withColumn("translated_text", F.lit(None).cast("string"))
    rows = with_context(rows, context).withColumn("context_json", F.to_json("previous")).drop("previous")
    terms = glossary.relevant(entries, asked.select("document_id", "chunk_id", "text"))
    terms = terms.groupBy("document_id", "chunk_id").agg(
        F.to_json(
            F.transform(
                F.array_sort(F.collect_list(F.struct("entry_id", prompts.compact_entry().alias("entry")))), lambda x: x["entry"]
            )
        ).alias("terms_json")
    )
    rows = rows.join(terms, ["document_id", "chunk_id"], "left")
    rows = prompts.with_advice(rows.withColumn("content_form", F.lit("general")), advice)
    text = prompts.prompt(F.col("target_language"), F.col("advice"), F.col("context_json"), F.col("terms_json"), F.col("expected_json"))
    return rows.withColumn("prompt", text)


def answered(asked: DataFrame, answerer: Answerer = echo) -> DataFrame:
    """The answers, reconciled with what was asked, and the ``error`` of a call that failed (it answers nothing).

    All chunks are independent of each other.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            outputs, errors = [], []
            for target, expected in zip(batch["target_language"], batch["expected_json"]):
                try:
                    outputs.append(answerer({"target_language": target, "blocks": json.loads(expected or "[]")}))
                    errors.append(None)
                except Exception as error:
                    outputs.append(None)
                    errors.append(_error(error))
            yield batch[["document_id", "chunk_id", "expected_json"]].assign(output=outputs, error=errors)

    rows = asked.select("document_id", "chunk_id", "target_language", "expected_json")
    out = rows.mapInPandas(run, "document_id string, chunk_id string, expected_json string, output string, error string")
    return reconcile.reconciled(out.withColumn("earlier_json", F.lit("{}")), kept=("error",))


def entries_of(found: DataFrame) -> DataFrame:
    """Translations by block out of reconciled chunks."""
    rows = found.select("document_id", "chunk_id", F.posexplode("block_translations").alias("part", "b"))
    rows = rows.select(
        "document_id", "b.block_id", F.col("chunk_id").alias("chunk_index"), "part", "b.translated_text", "b.table_rows"
    )
    return translations.collected(rows)


def _told(row: Any, translated: str) -> dict[str, Any]:
    ids = getattr(row, "paragraph_ids", None)
    return {
        "chunk_id": row.chunk_id, "paragraph_ids": None if ids is None else list(ids),
        "continues_paragraph": getattr(row, "continues_paragraph", None), "ends_paragraph": getattr(row, "ends_paragraph", None),
        "source_text": row.text, "translated_text": translated,
    }


IN_ORDER = (
    "document_id string, chunk_id string, chunk_index int, translated_text string, block_translations_json string, "
    "glossary_size int, context_size int, error string"
)
_TOLD = ("paragraph_ids", "continues_paragraph", "ends_paragraph")


def in_order(asked: DataFrame, answerer: Answerer = echo, context: int = CONTEXT) -> DataFrame:
    """Chunks of a document one after the other, with the context and glossary that the earlier ones left.

    A chunk whose answerer fails keeps its source text, with the error, and the rest goes on. Terms in an
    answer are cleaned before they join the glossary, whatever shape a model gives them.
    """

    def run(batch: pd.DataFrame) -> pd.DataFrame:
        done: list[dict[str, Any]] = []
        terms = glossary.Glossary()
        out = []
        for row in batch.sort_values(["chunk_index", "chunk_id"]).itertuples(index=False):
            blocks, error, size = json.loads(row.expected_json or "[]"), None, len(terms.entries)
            request = {
                "target_language": row.target_language, "blocks": blocks, "context": done[-context:] if context else [],
                "glossary": [glossary.compact(e) for e in terms.for_text(row.text or "")],
            }
            try:
                output = answerer(request)
            except Exception as e:  # one failed chunk doesn't end a document
                output, error = _source_answer(blocks), _error(e)
            found = reconcile.reconcile(output, blocks)
            given = (reconcile.embedded_object(output) or {}).get("glossary")
            for i, raw in enumerate(given if isinstance(given, list) else []):
                if (entry := glossary.clean_entry(raw, row.chunk_id, i)) is not None:
                    terms.add(entry)
            blocks_json = json.dumps(found["block_translations"], ensure_ascii=False)
            out.append((row.document_id, row.chunk_id, row.chunk_index, found["translated_text"], blocks_json, size, len(request["context"]), error))
            done.append(_told(row, found["translated_text"]))
        return pd.DataFrame(out, columns=[c.split()[0] for c in IN_ORDER.split(", ")])

    wanted = ["document_id", "chunk_id", "chunk_index", "target_language", "expected_json", "text"]
    wanted += [c for c in _TOLD if c in asked.columns]
    return asked.select(*wanted).groupBy("document_id").applyInPandas(run, IN_ORDER)


def _source_answer(blocks: list[dict]) -> str:
    kept = [{"block_id": b.get("block_id"), "translated_text": b.get("source_text") or ""} for b in blocks if isinstance(b, dict)]
    return json.dumps({"block_translations": kept}, ensure_ascii=False)


def reviewed(first: DataFrame, asked: DataFrame, reviewer: Answerer) -> DataFrame:
    """(document_id, feedback, error) of each document: remarks on its whole translation, in chunk order.

    ``first`` has document_id, chunk_id, chunk_index and translated_text. A failed review gives no remarks.
    """
    rows = first.select("document_id", "chunk_id", "chunk_index", "translated_text").join(
        asked.select("document_id", "chunk_id", "text", "target_language"), ["document_id", "chunk_id"]
    )
    part = F.struct("chunk_index", "chunk_id", "text", "translated_text")
    rows = rows.groupBy("document_id").agg(F.array_sort(F.collect_list(part)).alias("cs"), F.max("target_language").alias("target_language"))
    rows = rows.select(
        "document_id", "target_language",
        F.array_join(F.transform("cs", lambda c: F.coalesce(c["text"], F.lit(""))), "\n\n").alias("text"),
        F.array_join(F.transform("cs", lambda c: F.coalesce(c["translated_text"], F.lit(""))), "\n\n").alias("translated"),
    )
    prompt = prompts.review_prompt(F.col("target_language"), F.lit(None).cast("string"), F.col("text"), F.col("translated"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for key, target, text in zip(batch["document_id"], batch["target_language"], batch["prompt"]):
                try:
                    out.append((key, str(reviewer({"target_language": target, "prompt": text}) or ""), None))
                except Exception as error:
                    out.append((key, "", _error(error)))
            yield pd.DataFrame(out, columns=["document_id", "feedback", "error"])

    return rows.select("document_id", "target_language", prompt.alias("prompt")).mapInPandas(
        run, "document_id string, feedback string, error string"
    )


REVISED = (
    "document_id string, chunk_id string, chunk_index int, translated_text string, first_text string, "
    "block_translations_json string, revision_error string"
)


def revised(
    asked: DataFrame, first: DataFrame, feedback: DataFrame, answerer: Answerer = echo, entries: DataFrame | None = None, context: int = CONTEXT
) -> DataFrame:
    """A second pass over the chunks of every document, in order, led by the remarks on the first.

    ``first`` has what ``in_order`` gives, ``feedback`` one row a document; ``entries`` the glossary, or none.
    A block that the second pass loses or breaks keeps its first translation; a chunk whose call fails keeps
    all of it, with the error. A document without remarks is left as it is.
    """
    rows = asked.join(
        first.select("document_id", "chunk_id", F.col("translated_text").alias("first_text"), F.col("block_translations_json").alias("first_json")),
        ["document_id", "chunk_id"],
    ).join(feedback.select("document_id", "feedback"), "document_id", "left")
    names = ["document_id", "chunk_id", "chunk_index", "target_language", "expected_json", "text", "first_text", "first_json", "feedback"]
    rows = rows.select(*names, *[c for c in _TOLD if c in asked.columns])
    if entries is not None:
        terms = entries.groupBy("document_id").agg(F.to_json(F.collect_list(prompts.compact_entry())).alias("terms_json"))
        rows = rows.join(terms, "document_id", "left")

    def run(batch: pd.DataFrame) -> pd.DataFrame:
        done: list[dict[str, Any]] = []
        out = []
        given = json.loads(batch["terms_json"].iloc[0] or "[]") if "terms_json" in batch.columns else []
        clean = [c for i, e in enumerate(given) if (c := glossary.clean_entry(e, None, i)) is not None]
        terms = glossary.Glossary(clean)
        for row in batch.sort_values(["chunk_index", "chunk_id"]).itertuples(index=False):
            blocks, old, error = json.loads(row.expected_json or "[]"), json.loads(row.first_json or "[]"), None
            text, kept = row.first_text, row.first_json
            if row.feedback:
                request = {
                    "target_language": row.target_language, "blocks": blocks, "first": old, "feedback": row.feedback,
                    "context": done[-context:] if context else [],
                    "glossary": [glossary.compact(e) for e in terms.for_text(row.text or "")],
                }
                try:
                    found = reconcile.reconcile(answerer(request), blocks, {b["block_id"]: b for b in old})
                    text, kept = found["translated_text"], json.dumps(found["block_translations"], ensure_ascii=False)
                except Exception as e:
                    error = _error(e)
            out.append((row.document_id, row.chunk_id, row.chunk_index, text, row.first_text, kept, error))
            done.append(_told(row, text))
        return pd.DataFrame(out, columns=[c.split()[0] for c in REVISED.split(", ")])

    return rows.groupBy("document_id").applyInPandas(run, REVISED)


def revision_status(rows: DataFrame) -> DataFrame:
    """One row a document: how its second pass ended, and how many chunks kept their first translation."""
    failed = F.count("revision_error").alias("failed_chunks")
    status = F.when(F.col("failed_chunks") > 0, "completed_with_errors").otherwise("completed").alias("status")
    return rows.groupBy("document_id").agg(failed, F.count("*").alias("chunk_count")).select("*", status)


def workflow(
    paragraphs: DataFrame, languages: DataFrame, answerer: Answerer = echo, reviewer: Answerer | None = None,
    entries: DataFrame | None = None, words: int = progress.REST_CHUNK_WORDS, context: int = CONTEXT,
) -> DataFrame:
    """From blocks to (document_id, block_id, translated_text, table_rows): chunks, a first pass in order, and, with
    a reviewer, remarks and a second pass. Reading and writing packages stand before and after it.
    """
    nothing = paragraphs.select("document_id", "block_id").where("false")
    asked = written(rest_requests(paragraphs, nothing, languages, words), "requests")
    done = in_order(asked, answerer, context)
    if reviewer is not None:
        done = written(done, "first-pass")
        done = revised(asked, done, reviewed(done, asked, reviewer), answerer, entries, context)
    listed = F.from_json("block_translations_json", reconcile.BLOCKS)
    rows = done.select("document_id", "chunk_index", "chunk_id", F.posexplode(listed).alias("part", "b"))
    return translations.collected(
        rows.select("document_id", "b.block_id", "chunk_index", "part", "b.translated_text", "b.table_rows")
    )


def step(
    paragraphs: DataFrame, entries: DataFrame, targets: DataFrame, languages: DataFrame, answerer: Answerer = echo, again: bool = False
) -> DataFrame:
    """The new entries that one step of translation gives for every document."""
    planned = sections.sections(paragraphs, targets)
    selected = selected_sections(progress.section_status(planned, entries), again)
    return entries_of(answered(requests(selected, paragraphs, languages), answerer))


def rest_requests(paragraphs: DataFrame, entries: DataFrame, languages: DataFrame, words: int = progress.REST_CHUNK_WORDS) -> DataFrame:
    """Requests for all that isn't translated yet, in large chunks."""
    left = paragraphs.join(entries.select("document_id", "block_id").distinct(), ["document_id", "block_id"], "left_anti")
    left = left.withColumn("n", F.row_number().over(Window.partitionBy("document_id").orderBy("block_index", "block_id")))
    target = left.select("document_id").distinct().withColumn("target", F.lit(words))
    planned = sections.sections(left, target)
    return requests(planned, left, languages)


def echoed(lang: Column, text: Column) -> Column:
    """What ``echo`` makes of a text."""
    return F.concat(F.lit("["), F.coalesce(lang, F.lit("?")), F.lit("] "), text)
