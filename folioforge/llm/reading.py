"""Problem 8: the reading level of documents, by a latent difficulty model.

Every document has a level and every word a difficulty. In the manner of Rasch's Poisson model the
occurrences of word w in document d have the rate

    n_d * exp(easiness_w + slope_w * (level_d - 2)) / Z(level_d)

where n_d is the number of words of d and Z makes the rates of a level add up to 1. A word whose
slope is high occurs in demanding texts, one with a low slope in easy ones. Words and Z are taken by
language: with one Z for all, differences between languages pass for differences in level and grow
from round to round. Levels and words are estimated in turn. Labelled documents keep the mean of
their labels and fix the scale. The levels of the others follow from their words, document by
document; the words follow from sums over all documents, which each partition adds up itself before
anything is shuffled.

Texts are read and cut into words once; the rounds read the numbers of the words from a table in the
shared folder. Words are hashed to ``ITEMS`` items, so the parameters take 5 MB whatever the corpus.
Labels of about ``LABELLED`` documents a language at most (drawn by a hash of their keys) are used;
levels and words cover every document. Where nothing is known of a document's words, as in a language
without labels, it has the mean of the prior, level 2, and its words take part from the second round on.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute  # noqa: F401  (pa.compute)
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import written
from ..tables import spread, unique_in_place
from .arrays import Words, folded, groups
from .langid import LANGUAGES, Model

BITS = 17
ITEMS = (1 << BITS) * len(LANGUAGES)
LABELLED = 20_000
PRIOR_LEVEL = 2.0
ROUNDS = 3
#: Levels at which occurrences are added up, and those among which a document's level is sought.
GRID = np.linspace(1.0, 3.0, 5)
LEVELS = np.linspace(0.5, 3.5, 121)
LEAST_COUNT = 4.0
SLOPE_SPREAD = 1.5
ITEMS_AT_ONCE = 8192
LEVEL_SPREAD = 1.0
#: Sums over all documents are added up in so many tasks a core at most before they are shuffled.
TASKS_A_CORE = 4


@dataclass
class Items:
    """Slopes of the items (0 for those too rare to tell) and log Z by language and level."""

    slope: np.ndarray
    known: np.ndarray
    log_z: np.ndarray

    def levels(self, item: np.ndarray, row: np.ndarray, n_rows: int) -> np.ndarray:
        """The most probable level of each row, given its items; NaN without a known one."""
        n = np.bincount(row, self.known[item].astype(float), n_rows)
        pull = np.bincount(row, self.slope[item], n_rows)
        lang = np.zeros(n_rows, np.int64)
        lang[row] = item % len(LANGUAGES)
        score = pull[:, None] * (LEVELS - 2) - n[:, None] * self.log_z[lang] - ((LEVELS - 2) / LEVEL_SPREAD) ** 2 / 2
        return np.where(n > 0, LEVELS[np.argmax(score, axis=1)], np.nan)


def items_of(texts: list[str], model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(item, row) of every word; an item is a hashed word of the text's language. And the languages."""
    words = Words([folded(t) for t in texts])
    lang = np.argmax(model.probabilities(texts), axis=1)
    bucket = (words.hash >> np.uint64(64 - BITS)).astype(np.int64)
    return bucket * len(LANGUAGES) + lang[words.row], words.row, lang


def item_table(documents: DataFrame, key: str, model: Model) -> DataFrame:
    """(key, words, lang, items) of each row of documents(key, text); a null text has no words."""
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = [t or "" for t in batch["text"]]
            for a, b in groups(texts):
                item, row, lang = items_of(texts[a:b], shared.value)
                cut = np.searchsorted(row, np.arange(1, b - a))
                yield pd.DataFrame(
                    {
                        key: batch[key].iloc[a:b],
                        "words": np.array([len(t.split()) for t in texts[a:b]], np.int32),
                        "lang": lang.astype(np.int32),
                        "items": np.split(item.astype(np.int32), cut),
                    }
                )

    kind = documents.schema[key].dataType.simpleString()
    return spread(documents.select(key, "text")).mapInPandas(run, f"{key} {kind}, words int, lang int, items array<int>")


def _flat(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Items and their rows from an array column, without a Python object for each."""
    n = pa.compute.list_value_length(column).fill_null(0).to_numpy(zero_copy_only=False)
    flat = pa.compute.list_flatten(column).to_numpy(zero_copy_only=False)
    return flat.astype(np.int64), np.repeat(np.arange(len(n)), n)


def fit_items(counts: np.ndarray) -> Items:
    """Word parameters from occurrences by item and grid level.

    Items don't depend on each other, so Newton steps run for some thousands at once: what is held
    besides the counts doesn't grow with the vocabulary.
    """
    langs = len(LANGUAGES)
    rates = np.stack([counts[g::langs].sum(axis=0) for g in range(langs)]) + 1e-9
    known = counts.sum(axis=1) >= LEAST_COUNT
    slopes, z = np.zeros(len(counts)), np.zeros((langs, len(LEVELS)))
    at = np.flatnonzero(known)
    for start in range(0, len(at), ITEMS_AT_ONCE):
        some = at[start : start + ITEMS_AT_ONCE]
        lang = some % langs
        easy, slopes[some] = _newton(counts[some], rates[lang])
        shares = np.exp(easy[:, None] + slopes[some][:, None] * (LEVELS - 2))
        np.add.at(z, lang, shares)
    return Items(slopes, known, np.log(np.where(z > 0, z, 1.0)))


def _newton(c: np.ndarray, rate: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Easiness and slope of items from counts and expected rates, items x grid levels."""
    x = GRID - 2
    easy, slope = np.log(c.sum(axis=1) / rate.sum(axis=1)), np.zeros(len(c))
    for _ in range(25):
        mu = np.exp(np.clip(easy[:, None] + slope[:, None] * x, -40, 3)) * rate
        g0, g1 = (c - mu).sum(axis=1), ((c - mu) * x).sum(axis=1) - slope / SLOPE_SPREAD**2
        h00, h01, h11 = mu.sum(axis=1) + 1e-6, (mu * x).sum(axis=1), (mu * x * x).sum(axis=1) + 1 / SLOPE_SPREAD**2
        det = np.maximum(h00 * h11 - h01**2, 1e-12)
        easy = easy + np.clip((h11 * g0 - h01 * g1) / det, -1, 1)
        slope = slope + np.clip((h00 * g1 - h01 * g0) / det, -1, 1)
    return easy, slope


def _spread(level: np.ndarray) -> np.ndarray:
    """Levels x grid: the two nearest grid levels share a document linearly."""
    at = np.clip((level - GRID[0]) / (GRID[1] - GRID[0]), 0, len(GRID) - 1)
    low = np.minimum(at.astype(int), len(GRID) - 2)
    out = np.zeros((len(level), len(GRID)))
    rows = np.arange(len(level))
    out[rows, low] = 1 - (at - low)
    out[rows, low + 1] = at - low
    return out


def occurrence_sums(rows: DataFrame, items: Items | None) -> np.ndarray:
    """Occurrences by item and grid level, over all rows(items, known_level).

    Without ``items`` only rows with a known level count; with them every row does, by the prior level
    where none of its words is known. A task sends one row for each item that occurs in it, however often,
    and there are no more tasks than ``TASKS_A_CORE`` for each core: what is shuffled is bounded by the
    size of the cluster, not of the corpus.
    """
    shared = rows.sparkSession.sparkContext.broadcast(items)
    names = [f"g{i}" for i in range(len(GRID))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(ITEMS * len(GRID))
        for batch in batches:
            level = batch.column("known_level").to_numpy(zero_copy_only=False).astype(float)
            item, row = _flat(batch.column("items"))
            if shared.value is not None:
                level = np.where(np.isnan(level), shared.value.levels(item, row, len(level)), level)
                level = np.nan_to_num(level, nan=PRIOR_LEVEL)
            share = np.where(np.isnan(level)[:, None], 0.0, _spread(np.nan_to_num(level, nan=2.0)))
            for g in range(len(GRID)):
                weight = share[row, g]
                at = np.flatnonzero(weight)
                sums += np.bincount(item[at] * len(GRID) + g, weight[at], len(sums))
        table = sums.reshape(-1, len(GRID))
        some = np.flatnonzero(table.any(axis=1))
        columns = [pa.array(some.astype(np.int32)), *(pa.array(table[some, g]) for g in range(len(GRID)))]
        yield pa.RecordBatch.from_arrays(columns, ["item", *names])

    schema = "item int, " + ", ".join(f"{n} double" for n in names)
    some = rows.select("items", "known_level")
    parts = some.coalesce(TASKS_A_CORE * rows.sparkSession.sparkContext.defaultParallelism).mapInArrow(run, schema)
    total = F.lit(0.0)
    for n in names:
        total = total + F.col(n)
    # ITEMS rows at most; those too rare to tell anything stay behind
    kept = parts.groupBy("item").agg(*[F.sum(n).alias(n) for n in names]).where(total >= LEAST_COUNT)
    found = kept.toArrow()
    counts = np.zeros((ITEMS, len(GRID)))
    at = found.column("item").to_numpy()
    for g, n in enumerate(names):
        counts[at, g] = found.column(n).to_numpy()
    return counts


def drawn_labels(table: DataFrame, labels: DataFrame, key: str, most: int = LABELLED) -> DataFrame:
    """(key, known_level) of about ``most`` labelled documents of each language of table(key, lang)."""
    some = labels.select(key, F.col("level").alias("known_level"))
    some = table.select(key, "lang").join(some, key)
    share = F.lit(0.0)
    for r in some.groupBy("lang").count().collect():
        share = F.when(F.col("lang") == r["lang"], min(1.0, most / r["count"])).otherwise(share)
    place = F.pmod(F.xxhash64(key), F.lit(1 << 30)) / float(1 << 30)
    return some.where(place < share).select(key, "known_level")


def fit(table: DataFrame, labels: DataFrame, key: str) -> tuple[Items, tuple[float, float]]:
    """Items and the two cuts between the bands, from table(key, lang, items) and labels(key, level)."""
    some = F.broadcast(written(drawn_labels(table, labels, key), "reading-labels"))
    rows = table.join(some, key, "left")
    items = fit_items(occurrence_sums(table.join(some, key), None))
    for _ in range(ROUNDS - 1):
        items = fit_items(occurrence_sums(rows, items))
    seen = with_levels(table.join(some, key), items, [key, "known_level"]).toPandas()
    seen = seen.drop_duplicates(key).dropna()
    return items, _cuts(seen["level"].to_numpy(), seen["known_level"].to_numpy())


def _cuts(level: np.ndarray, known: np.ndarray) -> tuple[float, float]:
    """Cuts that agree with most labels; between equally good ones the middle."""
    out = []
    for below in (1.5, 2.5):
        low, high = np.sort(level[known < below]), np.sort(level[known > below])
        if not len(low) or not len(high):
            out.append(below)
            continue
        wrong = len(low) - np.searchsorted(low, LEVELS, side="right") + np.searchsorted(high, LEVELS, side="right")
        best = LEVELS[wrong == wrong.min()]
        out.append(float(best.mean()))
    return out[0], max(out[0], out[1])


def with_levels(table: DataFrame, items: Items, kept: list[str]) -> DataFrame:
    """The kept columns with ``level``, NaN without a known word."""
    shared = table.sparkSession.sparkContext.broadcast(items)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            level = shared.value.levels(*_flat(batch.column("items")), batch.num_rows)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(level)], [*kept, "level"])

    schema = ", ".join(f"`{c}` {table.schema[c].dataType.simpleString()}" for c in kept)
    return table.select(*kept, "items").mapInArrow(run, schema + ", level double")


def bands(documents: DataFrame, labels: DataFrame, model: Model, key: str = "doc_id") -> DataFrame:
    """(key, words, level, band) of each document; without a word level and band are null.

    ``labels`` has (key, level), one row a document. Without any label the scale is that of the
    prior: every level is 2. Repeated keys count once, in the sums of words too.
    """
    table = written(item_table(unique_in_place(documents, key), key, model), "reading-items")
    items, (easy, hard) = fit(table, labels, key)
    level = F.when(F.col("words") == 0, None).when(F.isnan("level"), PRIOR_LEVEL).otherwise(F.col("level"))
    band = F.when(level <= easy, 1).when(level <= hard, 2).when(level > hard, 3)
    rows = with_levels(table, items, [key, "words"])
    return rows.select(key, "words", level.alias("level"), band.cast("int").alias("band"))
