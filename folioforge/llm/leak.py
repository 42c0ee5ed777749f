"""Problem 7: passages of test items inside a training corpus, by winnowing.

Words are runs of letters and digits, compared without regard to case, punctuation, layout,
invisible characters and accent encoding. Of each text the k-word hashes are formed and in every
window of w consecutive hashes the smallest is kept. With k + w - 1 = ``least`` any shared run of
``least`` words shares a kept hash. Corpus and test fingerprints are joined, and each pair of texts
that meets is extended to its longest shared run; runs of at least ``least`` words are reported.

Test sets of at most ``TEST_BYTES`` of text, a size that is counted first, are broadcast with their
fingerprints: the corpus is read once, a text meets the fingerprints and is extended where it lies, and
only results are shuffled. Beyond that fingerprints (20 bytes a row, hot ones split by salt) are joined
by a shuffle, and of the corpus only the texts that met something are moved.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import written
from ..tables import spread
from .arrays import Words, folded, groups, span_hashes

#: Text of test items that is broadcast, with at most 4 M words: some 100 MB of hashes at the very worst.
TEST_BYTES = 8 << 20
#: Keys of the corpus that are broadcast, as text, to leave out what met nothing.
KEY_BYTES = 32 << 20
SALTS = 32


def run_hashes(hashes: np.ndarray, k: int) -> np.ndarray:
    """The hash of each k consecutive word hashes (positions of runs, across texts)."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    first = np.arange(n)
    return span_hashes(hashes, first, first + k)


def winnowed(words: Words, k: int, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, position in words, hash) of the kept k-grams; the rightmost smallest of each window.

    A text with fewer than k + window - 1 words has no full window and keeps nothing: it can't share
    a run of that length.
    """
    least = k + window - 1
    row = words.row
    n = len(row) - least + 1
    if n <= 0:
        return (np.empty(0, np.int64),) * 2 + (np.empty(0, np.uint64),)
    h = run_hashes(words.hash, k)
    best, at = h[:n].copy(), np.arange(n)
    for i in range(1, window):
        other = h[i : i + n]
        smaller = other <= best
        best = np.where(smaller, other, best)
        at = np.where(smaller, np.arange(i, i + n), at)
    at = np.unique(at[row[:n] == row[least - 1 :]])
    return row[at], at, h[at]


def fingerprints(df: DataFrame, key: str, text: str, k: int, window: int) -> DataFrame:
    """(key, fp) of each kept fingerprint; null and short texts keep none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = [folded(t) for t in batch[text]]
            keys = batch[key].to_numpy()
            for a, b in groups(texts):
                words = Words(texts[a:b])
                row, _, h = winnowed(words, k, window)
                yield pd.DataFrame({key: keys[a:b][row], "fp": h.view(np.int64)}).drop_duplicates()

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, text).where(F.col(text).isNotNull()).mapInPandas(run, f"`{key}` {kind}, fp bigint")


def _among(values: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    """Which values occur in an ordered array."""
    if not len(ordered):
        return np.zeros(len(values), bool)
    return ordered[np.minimum(np.searchsorted(ordered, values), len(ordered) - 1)] == values


def shared_run(
    a: np.ndarray, b: np.ndarray, least: int, a_runs: np.ndarray | None = None, b_runs: np.ndarray | None = None
) -> int:
    """Words in the longest run that two texts (as word hashes) share, 0 if below ``least``.

    A shared run of some length implies shorter ones, so the length is found by halving, by the hashes
    of all runs of a length at a time: repetitive texts take no longer than others. ``a_runs`` and the
    ordered ``b_runs`` are the hashes of runs of ``least`` words, if they are known already.
    """
    x = run_hashes(a, least) if a_runs is None else a_runs
    y = np.sort(run_hashes(b, least)) if b_runs is None else b_runs
    at = np.flatnonzero(_among(x, y))
    if not len(at):
        return 0
    # a shared run lies inside the words that neighbouring hits cover
    gap = np.flatnonzero(np.diff(at) > 1)
    covered = [a[i : j + least] for i, j in zip(at[[0, *(gap + 1)]], at[[*gap, len(at) - 1]])]
    low, high = least, min(len(b), max(map(len, covered)))
    while low < high:
        middle = (low + high + 1) // 2
        runs = np.sort(run_hashes(b, middle))
        if any(_among(run_hashes(c, middle), runs).any() for c in covered if len(c) >= middle):
            low = middle
        else:
            high = middle - 1
    return low


class Index:
    """Test items as word hashes, with their ordered fingerprints."""

    def __init__(self, keys: list, texts: list[str], k: int, least: int):
        self.keys = np.array(keys, object)
        words = Words([folded(t) for t in texts])
        bounds = words.bounds()
        self.words = [words.hash[x:y] for x, y in zip(bounds, bounds[1:])]
        self.runs = [np.sort(run_hashes(w, least)) for w in self.words]
        item, _, h = winnowed(words, k, least - k + 1)
        order = np.argsort(h, kind="stable")
        self.fp, self.item = h[order], item[order]

    def met(self, row: np.ndarray, h: np.ndarray) -> np.ndarray:
        """Distinct (row, item) of the fingerprints h of rows."""
        low, high = np.searchsorted(self.fp, h, "left"), np.searchsorted(self.fp, h, "right")
        n = high - low
        at = np.repeat(low - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        return np.unique(np.stack([np.repeat(row, n), self.item[at]], axis=1), axis=0)


def _schema(doc: str, item: str, corpus: DataFrame, tests: DataFrame) -> str:
    return f"`{doc}` {corpus.schema[doc].dataType.simpleString()}, `{item}` {tests.schema[item].dataType.simpleString()}, shared_words int"


def contained(
    corpus: DataFrame, tests: DataFrame, doc: str = "doc_id", item: str = "item_id", text: str = "text",
    least: int = 20, k: int = 13, test_bytes: int = TEST_BYTES,
) -> DataFrame:
    """(doc, item, shared_words) for each corpus text that shares a run of ``least`` words with an item.

    Null texts hold nothing. Rows repeated under one key count once. ``k`` is the length of a
    fingerprint in words, at most ``least``. ``test_bytes`` bounds the test text that is broadcast; the
    rows are the same either way.
    """
    corpus = corpus.select(doc, text).where(F.col(text).isNotNull())
    tests = tests.select(item, F.col(text).alias("__item_text")).where("__item_text is not null").dropDuplicates([item])
    size = tests.agg(F.sum(F.octet_length("__item_text"))).first()[0] or 0
    find = _met_in_place if size <= test_bytes else _met_by_shuffle
    found = find(corpus, tests, doc, item, text, least, k)
    return found.groupBy(doc, item).agg(F.max("shared_words").alias("shared_words"))


def _met_in_place(corpus: DataFrame, tests: DataFrame, doc: str, item: str, text: str, least: int, k: int) -> DataFrame:
    listed = tests.orderBy(item).toPandas()
    index = Index(list(listed[item]), list(listed["__item_text"]), k, least)
    shared = corpus.sparkSession.sparkContext.broadcast(index)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index = shared.value
        for batch in batches:
            texts = [folded(t) for t in batch[text]]
            keys = batch[doc].to_numpy()
            for a, b in groups(texts):
                words = Words(texts[a:b])
                row, _, h = winnowed(words, k, least - k + 1)
                met = index.met(row, h)
                if not len(met):
                    continue
                at, runs = words.bounds(), run_hashes(words.hash, least)
                found = [
                    shared_run(
                        words.hash[at[r] : at[r + 1]], index.words[i], least, runs[at[r] : max(at[r], at[r + 1] - least + 1)], index.runs[i]
                    )
                    for r, i in met
                ]
                out = pd.DataFrame({doc: keys[a:b][met[:, 0]], item: index.keys[met[:, 1]], "shared_words": np.array(found, np.int32)})
                yield out[out["shared_words"] > 0]

    return spread(corpus).mapInPandas(run, _schema(doc, item, corpus, tests))


def _met_by_shuffle(corpus: DataFrame, tests: DataFrame, doc: str, item: str, text: str, least: int, k: int) -> DataFrame:
    window = least - k + 1
    test_fp = fingerprints(tests, item, "__item_text", k, window).distinct()
    salted = test_fp.withColumn("__salt", F.explode(F.array([F.lit(i) for i in range(SALTS)])))
    corpus_fp = fingerprints(corpus, doc, text, k, window).withColumn("__salt", F.pmod(F.hash(doc), F.lit(SALTS)))
    met = written(corpus_fp.join(salted, ["fp", "__salt"]).select(doc, item).distinct(), "leak-candidates")
    keys = met.select(doc).distinct()
    if (keys.agg(F.sum(F.octet_length(F.col(doc).cast("string")))).first()[0] or 0) <= KEY_BYTES:
        corpus = corpus.join(F.broadcast(keys), doc, "left_semi")
    pairs = corpus.join(met, doc).join(tests, item)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = [folded(t) for t in batch[text]]
            items = [folded(t) for t in batch["__item_text"]]
            for a, b in groups([x + y for x, y in zip(texts, items)]):
                docs_w, items_w = Words(texts[a:b]), Words(items[a:b])
                x, y = docs_w.bounds(), items_w.bounds()
                found = [
                    shared_run(docs_w.hash[x[i] : x[i + 1]], items_w.hash[y[i] : y[i + 1]], least) for i in range(b - a)
                ]
                out = batch.iloc[a:b][[doc, item]].assign(shared_words=np.array(found, np.int32))
                yield out[out["shared_words"] > 0]

    return pairs.select(doc, item, text, "__item_text").mapInPandas(run, _schema(doc, item, corpus, tests))
