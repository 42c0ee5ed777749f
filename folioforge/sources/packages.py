"""Documents as files: reading them into blocks and writing translated ones, with Spark.

Files are read by the ``binaryFile`` source; a file is the unit of work and of failure. What can't be
read becomes a row with an error instead of ending the job. Plain text is taken apart by expressions;
DOCX, EPUB and HTML are trees and go through Arrow-fed Python.
"""

from __future__ import annotations

import io
import json
import posixpath
import zipfile
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from . import markup, wordxml

FORMATS = ("txt", "docx", "epub", "html")
MOST_BYTES = 15_728_640
#: What a worker gathers before it hands results on.
ROWS_AT_ONCE = 5_000
BYTES_AT_ONCE = 16 << 20
SUFFIXES = {"docx": ".docx", "epub": ".epub", "html": ".html"}

BLOCKS = (
    "document_id string, path string, block_index int, block_id string, block_type string, text string, "
    "translatable boolean, block_level int, source_part string, tree_path string, inline_source_text string, "
    "metadata_json string, error string"
)


def route(name: Column, formats: tuple[str, ...] = ("txt", "docx", "epub")) -> Column:
    """The reader for a file name by its suffix, whatever its case."""
    suffix = F.lower(F.regexp_extract(name, r"(\.[^.]+)$", 1))
    return F.when(suffix.isin(*[f".{f}" for f in formats]), F.substring(suffix, 2, 10)).otherwise("unsupported")


def files(spark: SparkSession, folder: str, most_bytes: int = MOST_BYTES) -> DataFrame:
    """The files of a folder with their format; too large and unknown ones have an error.

    The content of rejected files isn't read. Files without a byte have no row: Spark's file sources
    pass over them.
    """
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    fmt = route(F.col("path"), FORMATS)
    error = (
        F.when(fmt == "unsupported", "unsupported format").when(F.col("length") > most_bytes, "file too large")
    )
    return rows.select(
        X.stable_id("doc_", F.col("path")).alias("document_id"), "path", fmt.alias("source_format"), "length",
        error.alias("error"), F.when(error.isNull(), F.col("content")).alias("content"),
    )


def text_blocks(rows: DataFrame) -> DataFrame:
    """Blocks of plain text files: parts between empty lines (exactly two line ends), trimmed."""
    text = F.decode(F.col("content"), "UTF-8")
    parts = F.filter(F.transform(F.split(X.strip(text), "\n\n"), X.strip), lambda p: p != "")
    cut = rows.select("document_id", "path", F.posexplode(parts).alias("at", "text"))
    return cut.select(
        "document_id", "path", (F.col("at") + 1).alias("block_index"), X.numbered("b", F.col("at") + 1).alias("block_id"),
        F.lit("paragraph").alias("block_type"), "text", F.lit(True).alias("translatable"),
        F.lit(None).cast("int").alias("block_level"), F.lit(None).cast("string").alias("source_part"),
        F.lit(None).cast("string").alias("tree_path"), F.lit(None).cast("string").alias("inline_source_text"),
        F.lit("{}").alias("metadata_json"), F.lit(None).cast("string").alias("error"),
    )


def file_sites(content: bytes, fmt: str) -> list[wordxml.Site]:
    if fmt == "html":
        return markup.html_sites(markup.decoded(content))
    with zipfile.ZipFile(io.BytesIO(content)) as package:
        if fmt == "docx":
            return list(wordxml.sites(package, {}))
        return [site for site, _ in markup.epub_spots(package, {})]


def _rows(document_id: str, path: str, content: bytes, fmt: str) -> list[tuple]:
    try:
        found = file_sites(bytes(content), fmt)
    except Exception as e:  # a broken file is data here
        return [(document_id, path, None, None, None, None, None, None, None, None, None, None, f"{type(e).__name__}: {e}")]
    return [
        (document_id, path, i, s.block_id, s.type, s.text, s.translate, s.level, s.part, s.metadata.get("tree_path"),
         s.metadata.get("inline_source_text"), json.dumps(s.metadata, ensure_ascii=False), None)
        for i, s in enumerate(found, 1)
    ]


def read_blocks(rows: DataFrame) -> DataFrame:
    """The blocks of all files, in the columns of ``BLOCKS``; files with an error have one row with it."""
    names = [c.split()[0] for c in BLOCKS.split(", ")]

    def frame(found: list[tuple]) -> pd.DataFrame:
        kinds = {"block_index": "Int32", "block_level": "Int32", "translatable": "boolean"}
        return pd.DataFrame(found, columns=names).astype(kinds)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found: list[tuple] = []
            for row in batch.itertuples(index=False):
                found += _rows(row.document_id, row.path, row.content, row.source_format)
                if len(found) > ROWS_AT_ONCE:
                    yield frame(found)
                    found = []
            yield frame(found)

    good = rows.where("error is null")
    trees = good.where("source_format <> 'txt'").select("document_id", "path", "source_format", "content")
    failed = rows.where("error is not null").select(
        "document_id", "path", *[F.lit(None).cast(c.split()[1]).alias(c.split()[0]) for c in BLOCKS.split(", ")[2:-1]], "error"
    )
    return (
        trees.mapInPandas(run, BLOCKS)
        .unionByName(text_blocks(good.where("source_format = 'txt'")))
        .unionByName(failed)
    )


EXPORTED = (
    "document_id string, path string, source_format string, content binary, translatable_block_count int, "
    "applied_unit_count int, files_modified array<string>, warnings array<string>, error string"
)


def write_back(content: bytes, fmt: str, translations: dict[str, Any]) -> tuple[bytes, dict[str, Any]]:
    if fmt == "docx":
        return wordxml.write(content, translations)
    if fmt == "epub":
        return markup.write_epub(content, translations)
    if fmt == "txt":
        parts = [p.strip() for p in content.decode("utf-8").strip().split("\n\n") if p.strip()]
        ids = [f"b{i:04d}" for i in range(1, len(parts) + 1)]
        texts = {k: v.get("translated_text") if isinstance(v, dict) else v for k, v in translations.items()}
        out = [str(texts.get(k) or p).strip() for k, p in zip(ids, parts)]
        warnings = [f"{k}: no translation; source text kept" for k in ids if not texts.get(k)]
        unused = sorted(set(translations) - set(ids))
        report = {"translatable_block_count": len(ids), "applied_unit_count": sum(bool(texts.get(k)) for k in ids),
                  "files_modified": ["text"], "warnings": warnings + [f"not applied: {', '.join(unused)}"] * bool(unused)}
        return "\n\n".join(out).encode("utf-8"), report
    raise ValueError(f"{fmt} can't be written")


def exported(rows: DataFrame, translations: DataFrame) -> DataFrame:
    """Every file with its translations(document_id, block_id, translated_text, table_rows) applied.

    The translations of a document travel as one map beside its file; failures are rows with an error.
    """
    entry = F.to_json(F.struct("translated_text", "table_rows"))
    given = translations.groupBy("document_id").agg(
        F.map_from_entries(F.collect_list(F.struct("block_id", entry.alias("entry")))).alias("given")
    )
    names = [c.split()[0] for c in EXPORTED.split(", ")]

    def frame(done: list[list]) -> pd.DataFrame:
        out = pd.DataFrame(done, columns=names)
        return out.astype({"translatable_block_count": "Int32", "applied_unit_count": "Int32"})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            done: list[list] = []
            size = 0
            for row in batch.itertuples(index=False):
                given = {k: json.loads(v) for k, v in (row.given or {}).items()}
                try:
                    content, report = write_back(bytes(row.content), row.source_format, given)
                    error = None
                except Exception as e:  # a broken file is data here
                    content, report, error = None, {}, f"{type(e).__name__}: {e}"
                values = [report.get(n) for n in names[4:8]]
                done.append([row.document_id, row.path, row.source_format, content, *values, error])
                size += len(content or b"")
                if size > BYTES_AT_ONCE:
                    yield frame(done)
                    done, size = [], 0
            yield frame(done)

    good = rows.where("error is null").select("document_id", "path", "source_format", "content")
    joined = good.join(given, "document_id", "left")
    return joined.select("document_id", "path", "source_format", "content", "given").mapInPandas(run, EXPORTED)


def exported_name(fmt: Column) -> Column:
    """The suffix that a translated document gets."""
    out = F.lit(".txt")
    for name, suffix in SUFFIXES.items():
        out = F.when(fmt == name, suffix).otherwise(out)
    return F.concat(F.lit("translated_document"), out)


def save(rows: DataFrame, folder: str) -> None:
    """Writes exported documents under ``folder``/document_id, a path or address that all executors reach
    (a local or shared folder, or what Arrow's file systems know: hdfs, s3, gs).

    A file is written beside its place and then moved there, so a repeated task does no harm.
    """

    def put(part: Iterator[Any]) -> None:
        import uuid

        from pyarrow import fs

        system, base = fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder)
        for row in part:
            if row.content is not None:
                target = posixpath.join(base, row.document_id, row.name)
                beside = f"{target}.{uuid.uuid4().hex}.part"
                system.create_dir(posixpath.dirname(target), recursive=True)
                with system.open_output_stream(beside) as file:
                    file.write(row.content)
                system.move(beside, target)

    rows.select("document_id", exported_name(F.col("source_format")).alias("name"), "content").foreachPartition(put)
