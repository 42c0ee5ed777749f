"""Problem 4: the language of documents, of their segments and of single blocks.

String-kernel classification. A text is the set of its n-grams for n = 2, 3, 4 (blended spectrum,
presence); the kernel of two texts is the number of n-grams they share, divided by the geometric
mean of their numbers. Nyström: a few training texts are landmarks and stand for the whole kernel
matrix; on their features one-versus-rest ridge regression gives a score for each language.

The score is linear in the set of n-grams, so after training landmarks and coefficients are
multiplied into one matrix of n-gram weights, and a batch of texts is scored by one product of its
(sparse, 0/1) n-gram matrix with it. N-grams are hashed to ``2**BITS`` rows: the matrix is 5 MB,
whatever the corpus.

Training uses the translations, whose language is known for certain, of at most ``TRAIN_DOCS``
documents a language, drawn by a hash of the document's key; everything else covers all rows.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..tables import spread
from .arrays import folded, groups, mixed

LANGUAGES = ("de", "en", "es", "fr", "pt")
ORDERS = (2, 3, 4)
BITS = 18
TRAIN_DOCS = 400
TRAIN_TEXTS = 2000
#: Of each such document so many translated blocks at most, each of so many characters at most.
TRAIN_BLOCKS = 60
TRAIN_CHARS = 20_000
LANDMARKS = 80
RIDGE = 0.05
#: Longer ones, of texts without sentence ends, are scored in pieces, which bounds the memory.
LONGEST_SENTENCE = 20_000
#: Four words in a row are running text. In lines of less (cells, bare nouns, which neighbouring languages spell alike)
#: the best language of a line tells little by itself: there the probability must be clear.
RUNNING = re.compile(r"(?:[^\W\d_][^\s|]*[^\S\n]+){3}[^\W\d_]")
CLEAR = 0.75
_STEP = np.uint64(0x100000001B3)
_LAST_SPACE = re.compile(r".*\s", re.S)
_LETTERED = re.compile(r"\S*[^\W\d_]\S*")
SENTENCE_END = re.compile(r"(?<=[.!?…])[\"'»”’)\]]*\s+|\n+")

# Names and codes of the five languages, lower case.
NAMES = {
    "de": "de deu ger german deutsch allemand alemán aleman alemão tedesco",
    "en": "en eng english englisch anglais inglés ingles inglês",
    "es": "es spa spanish spanisch español espanol espagnol espanhol castellano castilian",
    "fr": "fr fra fre french französisch français francais francés francês",
    "pt": "pt por portuguese portugiesisch português portugues portugais portugués",
}


def label_language(label: Column) -> Column:
    """The language a label names: its code, name or regional variant; null if none of the five."""
    head = F.regexp_extract(F.lower(F.trim(label)), r"^([^-_\s(]+)", 1)
    found = F.lit(None).cast("string")
    for code, names in NAMES.items():
        found = F.when(head.isin(names.split()), code).otherwise(found)
    return found


@lru_cache(1)
def _letters() -> np.ndarray:
    """Code points by themselves if letters (or marks), 1 for others, 0 for zero."""
    table = np.ones(sys.maxunicode + 1, np.uint32)
    for c in range(0x30000):
        if chr(c).isalpha() or c > 0x2FF and unicodedata.category(chr(c))[0] == "M":
            table[c] = c
    table[0] = 0
    return table


def gram_sets(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct hashed n-grams of each text: (row, bucket) sorted by row, and how many a row has.

    Letters count, lower case; runs of anything else are one blank, as is the end of the text.
    """
    joined = folded("\x00".join(t.replace("\x00", " ") for t in texts) + "\x00") if texts else ""
    points = _letters()[np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)]
    blank = points <= 1  # 1: not a letter; 0: the end of a text
    keep = ~(blank[1:] & blank[:-1] & (points[1:] == 1))
    points = points[np.concatenate([[True], keep])] if len(points) else points
    row = np.cumsum(points == 0)
    row = np.concatenate([[0], row[:-1]]) if len(row) else row
    values = np.where(points == 0, 1, points).astype(np.uint64)
    h, keys = values, []
    for n in range(2, max(ORDERS) + 1):
        h = h[:-1] * _STEP + values[n - 1 :]
        if n in ORDERS:
            inside = row[: len(h)] == row[n - 1 :]
            bucket = mixed(h[inside] + np.uint64(n)) >> np.uint64(64 - BITS)
            keys.append((row[: len(h)][inside] << BITS) | bucket.astype(np.int64))
    key = np.concatenate(keys)
    key.sort()
    key = key[np.concatenate([[True], key[1:] != key[:-1]])] if len(key) else key
    row = key >> BITS
    return row, key & ((1 << BITS) - 1), np.bincount(row, minlength=len(texts))


@dataclass
class Model:
    weights: np.ndarray  # 2**BITS x languages
    bias: np.ndarray
    sharpness: float
    #: False for a model that nothing was there to learn from: it tells no language.
    learned: bool = True

    def scores(self, texts: list[str]) -> np.ndarray:
        """Texts x languages; the batched product of presence and weight matrix.

        However many texts there are, groups of a bounded size are worked on one by one.
        """
        parts = [self._group_scores(texts[a:b]) for a, b in groups(texts)]
        return np.concatenate(parts) if parts else np.zeros((0, len(LANGUAGES)))

    def _group_scores(self, texts: list[str]) -> np.ndarray:
        row, bucket, n = gram_sets(texts)
        out = np.zeros((len(texts), len(LANGUAGES)))
        if len(row):
            some = np.flatnonzero(n)
            starts = np.searchsorted(row, some)
            out[some] = np.add.reduceat(self.weights[bucket], starts, axis=0, dtype=np.float64)
        return out / np.sqrt(np.maximum(n, 1))[:, None] + self.bias

    def probabilities(self, texts: list[str]) -> np.ndarray:
        s = self.scores(texts) * self.sharpness
        e = np.exp(s - s.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)


def fit(texts: list[str], labels: list[str], seed: int = 7) -> Model:
    """Nyström kernel ridge regression on a bounded list of labelled texts."""
    order = np.random.default_rng(seed).permutation(len(texts))
    texts, y = [texts[i] for i in order], np.array([LANGUAGES.index(labels[i]) for i in order])
    row, bucket, n = gram_sets(texts)
    starts = np.searchsorted(row, np.arange(len(texts) + 1))
    root = np.sqrt(np.maximum(n, 1))
    marks = np.concatenate([np.flatnonzero(y == c)[:LANDMARKS] for c in range(len(LANGUAGES))])
    vocabulary = np.unique(np.concatenate([bucket[starts[m] : starts[m + 1]] for m in marks]))
    where = np.full(1 << BITS, -1)
    where[vocabulary] = np.arange(len(vocabulary))
    sets = np.zeros((len(vocabulary), len(marks)), np.float32)
    for j, m in enumerate(marks):
        sets[where[bucket[starts[m] : starts[m + 1]]], j] = 1 / root[m]
    kernel = np.empty((len(texts), len(marks)), np.float32)
    for i in range(len(texts)):
        at = where[bucket[starts[i] : starts[i + 1]]]
        kernel[i] = sets[at[at >= 0]].sum(axis=0) / root[i]
    del row, bucket
    value, vector = np.linalg.eigh(kernel[marks].astype(float) + 1e-6 * np.eye(len(marks)))
    half = vector / np.sqrt(np.maximum(value, 1e-6)) @ vector.T
    target = np.where(np.arange(len(LANGUAGES)) == y[:, None], 1.0, -1.0).astype(np.float32)

    def solve(n: int) -> tuple[np.ndarray, np.ndarray]:
        """Coefficients from the first n texts; only products of kernel columns are formed."""
        k, t = kernel[:n], target[:n]
        mean, bias = k.mean(axis=0, dtype=float), t.mean(axis=0, dtype=float)
        inner = half @ ((k.T @ k).astype(float) - n * np.outer(mean, mean)) @ half
        outer = half @ ((k.T @ t).astype(float) - n * np.outer(mean, bias))
        beta = np.linalg.solve(inner + RIDGE * n * np.eye(len(marks)) / 100, outer)
        return half @ beta, bias - mean @ half @ beta

    cut = max(1, len(texts) * 4 // 5)
    alpha, bias = solve(cut)
    held = kernel[cut:] @ alpha + bias if cut < len(texts) else kernel @ alpha + bias
    truth = y[cut:] if cut < len(texts) else y

    def loss(sharpness: float) -> float:
        s = held * sharpness
        s = s - s.max(axis=1, keepdims=True)
        return float(np.mean(np.log(np.exp(s).sum(axis=1)) - s[np.arange(len(s)), truth]))

    sharpness = min((1.0, 1.5, 2.0, 3.0, 4.0, 6.0, 8.0), key=loss)
    alpha, bias = solve(len(texts))
    weights = np.zeros((1 << BITS, len(LANGUAGES)), np.float32)
    weights[vocabulary] = sets @ alpha.astype(np.float32)
    return Model(weights, bias, sharpness)


def translated_texts(translations: DataFrame, key: str, target: str, json: str) -> pd.DataFrame:
    """The bounded training sample: translated strings with their language.

    At most ``TRAIN_DOCS`` documents a language in order of a hash of their key, of those at most
    ``TRAIN_TEXTS`` sentences or blocks a language.
    """
    rows = translations.where((F.length(json) > 2) & F.col(target).isin(*LANGUAGES)).select(key, target, json)
    counts = {r[target]: r["count"] for r in rows.groupBy(target).count().collect()}
    place = F.pmod(F.xxhash64(key, F.lit("language sample")), F.lit(1 << 30)) / float(1 << 30)
    share = F.lit(0.0)
    for code, n in counts.items():
        share = F.when(F.col(target) == code, min(1.0, 2.0 * TRAIN_DOCS / n)).otherwise(share)
    drawn = rows.withColumn("place", place).where(F.col("place") < share).dropDuplicates([key])
    sample = (
        drawn.withColumn("map", F.from_json(json, "map<string,string>"))
        .select(
            key, target, "place",
            F.slice(F.filter(F.map_values("map"), lambda t: F.length(t) <= TRAIN_CHARS), 1, TRAIN_BLOCKS).alias("texts"),
        )
        .toPandas()
        .sort_values(["place", key])
    )
    return sample.groupby(target).head(TRAIN_DOCS)


def save(model: Model, spark: SparkSession, path: str) -> None:
    """A model as a Parquet table of one row (5 MB), for other sessions."""
    row = (bytearray(model.weights.tobytes()), [float(b) for b in model.bias], float(model.sharpness), model.learned)
    frame = spark.createDataFrame([row], "weights binary, bias array<double>, sharpness double, learned boolean")
    frame.coalesce(1).write.mode("overwrite").parquet(path)


def load(spark: SparkSession, path: str) -> Model:
    row = spark.read.parquet(path).first()
    weights = np.frombuffer(bytes(row.weights), np.float32).reshape(-1, len(LANGUAGES))
    return Model(weights, np.array(row.bias), row.sharpness, row.learned)


def train(documents: DataFrame) -> Model:
    """A model from documents(document_id, target_lang, translations_json); without any translation one that tells
    no language."""
    sample = translated_texts(documents, "document_id", "target_lang", "translations_json")
    texts: dict[str, list[str]] = {c: [] for c in LANGUAGES}
    for lang, values in zip(sample["target_lang"], sample["texts"]):
        for value in values if values is not None else ():
            if not value:
                continue
            if value.startswith("{"):
                m = re.search(r'"translated_text"\s*:\s*"((?:[^"\\]|\\.)*)"', value)
                value = m.group(1) if m else ""
            if len(value.split()) >= 3:
                parts = SENTENCE_END.split(value)
                texts[lang] += [value, *(p for p in parts if len(parts) > 1 and len(p.split()) >= 3)]
    del sample
    pairs = []
    rng = np.random.default_rng(11)
    for lang, all_of in texts.items():
        keep = rng.permutation(len(all_of))[:TRAIN_TEXTS]
        pairs += [(all_of[i], lang) for i in keep]
    if not pairs:
        return Model(np.zeros((1 << BITS, len(LANGUAGES)), np.float32), np.zeros(len(LANGUAGES)), 1.0, False)
    return fit([t for t, _ in pairs], [c for _, c in pairs])


def _pieces(text: str) -> Iterator[str]:
    """A sentence as it is, or a longer text in pieces that end with a word where one ends."""
    at = 0
    while len(text) - at > LONGEST_SENTENCE:
        found = _LAST_SPACE.match(text, at, at + LONGEST_SENTENCE)
        end = found.end() if found else at + LONGEST_SENTENCE
        yield text[at:end]
        at = end
    if at < len(text):
        yield text[at:]


def _sentence_shares(texts: list[str], model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Texts x languages, twice: words by the probabilities of their sentences, and words with a letter by
    the best language of each sentence."""
    sentences, owner = [], []
    for i, text in enumerate(texts):
        for part in SENTENCE_END.split(text):
            some = list(_pieces(part))
            sentences += some
            owner += [i] * len(some)
    soft, hard = (np.zeros((len(texts), len(LANGUAGES))) for _ in range(2))
    for a, b in groups(sentences):
        words = np.fromiter((len(s.split()) for s in sentences[a:b]), float, b - a)
        lettered = np.fromiter((len(_LETTERED.findall(s)) for s in sentences[a:b]), float, b - a)
        p = model.probabilities(sentences[a:b])
        np.add.at(soft, owner[a:b], p * words[:, None])
        np.add.at(hard, (owner[a:b], np.argmax(p, axis=1)), lettered)
    return soft, hard


def language_shares(texts: list[str], model: Model) -> np.ndarray:
    """Texts x languages: the words of each text by language, from the probabilities of its sentences."""
    return _sentence_shares(texts, model)[0]


def majorities(texts: list[str], soft: np.ndarray, hard: np.ndarray) -> np.ndarray:
    """The language of more than half of each text's words, -1 where there is none or it can't be told."""
    best, sure = np.argmax(hard, axis=1), np.argmax(soft, axis=1)
    most = hard.max(axis=1, initial=0) > 0.5 * hard.sum(axis=1)
    clear = soft.max(axis=1, initial=0) > CLEAR * np.maximum(soft.sum(axis=1), 1e-9)
    running = np.fromiter((bool(RUNNING.search(t)) for t in texts), bool, len(texts))
    return np.where(running, np.where(most, best, -1), np.where(clear, sure, -1))


def languages(df: DataFrame, text: str, model: Model, by_paragraph: bool = False) -> DataFrame:
    """``df`` without its text, with words, lang, confidence, second, the language next to it, and mainly.

    ``lang`` has the most words; ``confidence`` is its share of them. A text without letters (null,
    empty, numbers) gets a null language and confidence 0, as does any text if the model has learned nothing. ``mainly`` has more than half of the words,
    each sentence counted for its best language; null if none has. With ``by_paragraph`` one row for each
    paragraph, numbered by segment_no from 1.
    """
    spark = df.sparkSession
    shared = spark.sparkContext.broadcast(model)
    kept = [c for c in df.columns if c not in (text, "words", "lang", "confidence", "second", "mainly", "segment_no")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = shared.value
        for batch in batches:
            all_texts = [t or "" for t in batch[text]]
            for a, b in groups(all_texts):
                part, texts = batch.iloc[a:b][kept], all_texts[a:b]
                if by_paragraph:
                    cut = [[p for p in re.split(r"\n\s*\n", t) if p.strip()] for t in texts]
                    part = part.iloc[np.repeat(np.arange(b - a), [len(c) for c in cut])]
                    part = part.assign(segment_no=np.array([i + 1 for c in cut for i in range(len(c))], np.int32))
                    texts = [p for c in cut for p in c]
                if not texts:
                    continue
                shares, by_best = _sentence_shares(texts, model)
                mainly = majorities(texts, shares, by_best)
                total, order = shares.sum(axis=1), np.argsort(-shares, axis=1, kind="stable")
                names = np.array(LANGUAGES, object)
                lettered = np.array([model.learned and any(map(str.isalpha, t)) for t in texts], bool)
                best = shares[np.arange(len(texts)), order[:, 0]] / np.maximum(total, 1e-9)
                yield part.assign(
                    words=np.array([len(t.split()) for t in texts], np.int32),
                    lang=np.where(lettered, names[order[:, 0]], None),
                    confidence=np.where(lettered, np.round(best, 6), 0.0),
                    second=np.where(lettered, names[order[:, 1]], None),
                    mainly=np.where(lettered & (mainly >= 0), names[mainly], None),
                )

    schema = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in kept)
    schema += ", segment_no int" * by_paragraph + ", words int, lang string, confidence double, second string, mainly string"
    return spread(df.select(*kept, text)).mapInPandas(run, schema)
