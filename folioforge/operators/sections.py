"""Sections: neighbouring blocks packed up to a number of words."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X

DEFAULT_TARGET, LEAST_TARGET, MOST_TARGET = 600, 100, 1500


def clamped_target(target: Column) -> Column:
    return F.least(F.lit(MOST_TARGET), F.greatest(F.lit(LEAST_TARGET), F.coalesce(target, F.lit(DEFAULT_TARGET))))


def section_numbers(sizes: np.ndarray, target: int) -> np.ndarray:
    """The section of each unit: a unit that would lead beyond the target opens the next one.

    A section's end is looked up in the running sum of sizes, so a document takes as many steps as it has
    sections. Units without words never open a section by themselves.
    """
    so_far = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
    out, at, section = np.empty(len(sizes), np.int32), 0, 0
    while at < len(sizes):
        stop = int(np.searchsorted(so_far, so_far[at] + target, side="right")) - 1
        if so_far[stop] == so_far[at]:  # a first unit above the target has the section to itself
            stop += 1
        section += 1
        out[at:stop] = section
        at = stop
    return out


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def _packed(sizes: pd.Series, targets: pd.Series) -> pd.Series:
    return pd.Series([section_numbers(s, DEFAULT_TARGET if pd.isna(t) else int(t)) for s, t in zip(sizes, targets)])


def packed(sizes: Column, target: Column) -> Column:
    """The section numbers of the units of an array; a null target is the usual one.

    Only numbers go to Python, a document at a time: appending to an array within a fold in the JVM copies
    it at every step, which is quadratic in the units of a document.
    """
    return _packed(sizes, target)


def sectioned(paragraphs: DataFrame, targets: DataFrame) -> DataFrame:
    """(document_id, n, section) for paragraphs(document_id, n, words) and targets(document_id, target)."""
    units = paragraphs.groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct("n", "words"))).alias("us"))
    units = units.join(targets, "document_id")
    packing = packed(F.transform("us", lambda u: u["words"]), F.col("target"))
    zipped = F.arrays_zip(F.transform("us", lambda u: u["n"]).alias("n"), packing.alias("section"))
    return units.select("document_id", F.explode(zipped).alias("u")).select("document_id", "u.n", "u.section")


def sections(paragraphs: DataFrame, targets: DataFrame) -> DataFrame:
    """One row a section: its blocks in order, words, and a preview of its text.

    Everything happens within documents: where paragraphs are laid out by document already, only the
    targets are shuffled.
    """
    shown = X.strip(X.without_tokens(F.col("text"))).alias("t")
    units = paragraphs.groupBy("document_id").agg(
        F.array_sort(F.collect_list(F.struct("n", "words", "block_id", shown))).alias("us")
    )
    units = units.join(targets, "document_id")
    packing = packed(F.transform("us", lambda u: u["words"]), F.col("target"))
    rows = units.select("document_id", F.explode(F.arrays_zip(F.col("us").alias("u"), packing.alias("section"))).alias("z"))
    rows = rows.select("document_id", "z.section", "z.u.*").groupBy("document_id", "section").agg(
        F.array_sort(F.collect_list(F.struct("n", "block_id", "t"))).alias("bs"),
        F.sum("words").alias("word_count"), F.count("*").alias("block_count"),
    )
    return rows.select(
        "document_id",
        X.numbered("sec_", F.col("section")).alias("section_id"),
        F.col("section").alias("section_index"),
        F.transform("bs", lambda b: b["block_id"]).alias("block_ids"),
        "word_count",
        "block_count",
        X.preview(F.array_join(F.transform("bs", lambda b: b["t"]), "\n\n")).alias("preview"),
    )


def bulk_chunk_count(sizes: Column, target: Column) -> Column:
    """How many chunks the units of an array fill, in order; empty units don't count."""
    zero = F.struct(F.lit(0).cast("bigint").alias("words"), F.lit(0).alias("chunks"))

    def step(acc: Column, size: Column) -> Column:
        full = (acc["words"] > 0) & (acc["words"] + size > target)
        return F.struct(
            (F.when(full, F.lit(0).cast("bigint")).otherwise(acc["words"]) + size.cast("bigint")).alias("words"),
            (acc["chunks"] + F.when(full, 1).otherwise(0)).alias("chunks"),
        )

    some = F.filter(sizes, lambda s: s > 0)
    return F.aggregate(some, zero, step, lambda acc: acc["chunks"] + F.when(acc["words"] > 0, 1).otherwise(0))
