"""Manuscripts cut into chunks of whole paragraphs; only a paragraph above the limit is split.

The split of a long paragraph is a loop over its sentence ends, which built-in functions can't say:
long paragraphs, and no others, go through an Arrow-fed function. Packing looks at numbers only.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.words import count_words
from .sections import section_numbers

DEFAULT_WORDS = 1500
_WORD = re.compile(r"\S+")
_SENTENCE_END = re.compile(r"[.!?…]+[\"'”’»)\]]*(?=\s|$)")


def split_paragraph(text: str, most: int) -> list[str]:
    """Parts of at most ``most`` words: up to the last sentence end that fits, else up to the last word.

    Words and sentence ends are found once; a part is a step in both lists, so the whole is linear.
    """
    starts = np.array([m.start() for m in _WORD.finditer(text)])
    stops = np.array([m.end() for m in _WORD.finditer(text)])
    ends = np.array([m.end() for m in _SENTENCE_END.finditer(text)], int)
    words_before = np.searchsorted(starts, ends, side="left")
    out, at = [], 0
    while len(starts) - at > most:
        fits = np.flatnonzero((words_before > at) & (words_before <= at + most))
        if len(fits):
            end, at_next = int(ends[fits[-1]]), int(words_before[fits[-1]])
        else:
            end, at_next = int(stops[at + most - 1]), at + most
        out.append(text[int(starts[at]) : end])
        at = at_next
    if at < len(starts):
        out.append(text[int(starts[at]) :].rstrip())
    return out


def parts(text: Column, most: int) -> Column:
    @F.pandas_udf("array<string>")
    def cut(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: split_paragraph(t, most))

    return cut.asNondeterministic()(text)


def chunked(documents: DataFrame, text: str = "text", most: int = DEFAULT_WORDS) -> DataFrame:
    """Chunks of documents(document_id, text): ids, paragraph ids, words and how they cut paragraphs.

    Null and blank texts have no chunks.
    """
    if most < 1:
        raise ValueError("a chunk needs room for one word")
    paragraphs = documents.select("document_id", F.posexplode(X.paragraphs(F.col(text))).alias("at", "p"))
    paragraphs = paragraphs.select("document_id", (F.col("at") + 1).alias("n"), "p", count_words(F.col("p")).alias("w"))
    whole = paragraphs.where(F.col("w") <= most).select(
        "document_id", "n", F.lit(1).alias("part"), F.lit(1).alias("part_count"), F.col("p").alias("text"), "w"
    )
    long = paragraphs.where(F.col("w") > most).select("document_id", "n", parts(F.col("p"), most).alias("ps"))
    long = long.select("document_id", "n", F.size("ps").alias("part_count"), F.posexplode("ps").alias("part", "text"))
    long = long.select(
        "document_id", "n", (F.col("part") + 1).alias("part"), "part_count", "text", count_words(F.col("text")).alias("w")
    )
    units = whole.unionByName(long)
    rows = units.groupBy("document_id").agg(
        F.array_sort(F.collect_list(F.struct("n", "part", "part_count", "w", "text"))).alias("us")
    )
    placed = F.arrays_zip(F.col("us").alias("u"), _packed(F.col("us"), most).alias("chunk"))
    rows = rows.select("document_id", F.explode(placed).alias("z")).select("document_id", "z.u.*", "z.chunk")
    ordered = F.array_sort(F.collect_list(F.struct("n", "part", "text")))
    out = rows.groupBy("document_id", F.col("chunk").alias("chunk_index")).agg(
        ordered.alias("us"), F.sum("w").alias("source_word_count"), F.max("part_count").alias("parts"),
        F.min("part").alias("part"),
    )
    split = F.col("parts") > 1
    return out.select(
        "document_id",
        "chunk_index",
        X.numbered("chunk_", F.col("chunk_index")).alias("chunk_id"),
        F.transform("us", lambda u: X.numbered("p", u["n"])).alias("paragraph_ids"),
        F.array_join(F.transform("us", lambda u: u["text"]), "\n\n").alias("text"),
        "source_word_count",
        split.alias("contains_partial_paragraph"),
        (F.col("part") == 1).alias("starts_paragraph"),
        (F.col("part") > 1).alias("continues_paragraph"),
        (~split | (F.col("part") == F.col("parts"))).alias("ends_paragraph"),
        F.when(split, "paragraph_too_long").alias("split_reason"),
    )


def chunk_numbers(sizes: np.ndarray, alone: np.ndarray, most: int) -> np.ndarray:
    """The chunk of each unit; the part of a split paragraph has a chunk to itself."""
    at = np.flatnonzero(alone)
    edges = np.unique(np.concatenate([[0], at, at + 1, [len(sizes)]]))
    out, last = np.empty(len(sizes), np.int32), 0
    for a, b in zip(edges, edges[1:]):
        out[a:b] = section_numbers(sizes[a:b], most) + last
        last = out[b - 1]
    return out


def _packed(units: Column, most: int) -> Column:
    @F.pandas_udf("array<int>")
    def numbers(sizes: pd.Series, parts: pd.Series) -> pd.Series:
        return pd.Series([chunk_numbers(np.asarray(s), np.asarray(p) > 1, most) for s, p in zip(sizes, parts)])

    return numbers(F.transform(units, lambda u: u["w"]), F.transform(units, lambda u: u["part_count"]))


def section_chunks(sections: DataFrame, blocks: DataFrame) -> DataFrame:
    """One chunk a section, of its blocks' texts as they are."""
    ids = sections.select("document_id", "section_id", "section_index", "word_count", F.posexplode("block_ids").alias("at", "block_id"))
    rows = ids.join(blocks.select("document_id", "block_id", "text"), ["document_id", "block_id"])
    ordered = F.array_sort(F.collect_list(F.struct("at", "block_id", "text")))
    return rows.groupBy("document_id", "section_id", "section_index", "word_count").agg(ordered.alias("bs")).select(
        "document_id", "section_id", "section_index", F.transform("bs", lambda b: b["block_id"]).alias("paragraph_ids"),
        F.array_join(F.transform("bs", lambda b: b["text"]), "\n\n").alias("text"), "word_count",
    )


def chunk_blocks(chunks: DataFrame, paragraphs: DataFrame) -> DataFrame:
    """The blocks of each chunk in order; ids without a block are left out."""
    ids = chunks.select(
        "document_id", "chunk_id", "chunk_index", F.posexplode("paragraph_ids").alias("position", "paragraph_id")
    )
    return ids.join(paragraphs, ["document_id", "paragraph_id"])
