"""Problem 2: defective pairs of a text and its answer (here: its translation).

Ordered rules, each for one defect; a pair gets every defect that applies, in this order:

``empty``           nothing visible in the answer, or null.
``refusal``         a phrase of refusal in one of five languages, while the answer keeps next to none of
                    the names and numbers of the text (so a translated text about a refusal isn't one).
``copy``            the answer's words are the text's own, in order, or nearly so.
``truncated``       a mark of breaking off or an unclosed delimiter at the end, or no end of sentence
                    where the text has one, or much shorter than pairs of these languages are.
``other_language``  most letters are of a script in which the language asked for isn't written, or, within
                    its script, the string kernels tell another language.

All but ``empty`` need a text of at least ``MIN_WORDS`` words. A text that is in the language asked
for already may rightly come back as it is. Texts are looked at once, batch by batch in Arrow-fed Python,
which leaves a row of flags and a length ratio for each pair. Usual ratios are medians over all of these
rows; what depends on them is an expression over the rows, so texts are read and joined once.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import written
from .arrays import folded, groups, visible
from .langid import LANGUAGES, Model

DEFECTS = ("empty", "refusal", "copy", "truncated", "other_language")
MIN_WORDS = 6
COPY_SHARE = 0.78
#: An answer below this part of the usual length, without an end of sentence, breaks off.
SHORT = 0.75
NEARLY_WHOLE = 0.93
OTHER_LANGUAGE_SHARE = 0.75
#: Length ratios are counted in steps of this width, the last of which takes all above 20.
RATIO_STEP = 0.005
RATIO_STEPS = 4000
#: Of fewer pairs of two languages in the whole table there is no usual length.
LEAST_RATIOS = 5
#: Texts and answers of fewer characters say nothing about usual lengths, answers of fewer letters nothing about scripts.
LEAST_CHARS = 10
LEAST_LETTERS = 6

# The script that each language is written in, as Unicode's character names begin.
SCRIPTS = {"de": "LATIN", "en": "LATIN", "es": "LATIN", "fr": "LATIN", "pt": "LATIN"}

# Phrases of inability or refusal, folded, apostrophes straight.
INABILITY = {
    "en": r"\b(?:can(?:'t|not| not)|(?:am|'m|are|'re|is) (?:not able|unable)|won't be able|not possible|must decline|unable to)\b",
    "de": r"\b(?:kann|können|darf|könnte)\b(?:\W+\w+){0,6}?\W+nicht\b|\bnicht (?:möglich|in der lage|erlaubt)\b|\bnicht (?:helfen|übersetzen)\b|\bausserstande\b",
    "es": r"\bno (?:me )?(?:puedo|podemos|es posible|será posible|soy capaz|estoy en condiciones)\b|\bme es imposible\b",
    "fr": r"\bne (?:peux|peut|pouvons|puis|pourrai|suis|serai)\b(?:\W+\w+){0,2}?\W+pas\b|\bpas (?:possible|en mesure)\b|\bm'est impossible\b|\bne saurais\b",
    "pt": r"\bnão (?:me )?(?:posso|podemos|consigo|é possível|será possível|sou capaz|estou em condições)\b|\bé-me impossível\b",
}
REQUEST = re.compile(
    r"\b(?:translat\w*|übersetz\w*|traduc\w*|tradui\w*|tradut?z\w*|tradução|help|assist|process|render\w*|provide|comply|helfen|"
    r"anfrage|bearbeit\w*|verarbeit\w*|ayudar|solicitud|procesar|aider|demande|répondre|fournir|traiter|ajudar|pedido|"
    r"processar|fornecer|request|passage|passag\w*|pasaje|trecho|content|inhalt\w*|contenido|contenu|conteúdo)\b"
)
_REFUSAL = re.compile("|".join(INABILITY.values()))
_APOSTROPHES = str.maketrans("’‘ʼ＇", "''''")
_WORD = re.compile(r"[^\W_]+")
_NUMBER = re.compile(r"\d[\d.,\u00a0\u202f]*")
_STOPS = re.compile(r"[.!?…。！？][\"'»”’)\]]*\s*$")
_BROKEN_OFF = re.compile(r"(?:\.\.\.|…|\[|\(|\[…\]|\[\.\.\.\]|[-–—,;])\s*$")
_CLOSERS = {"(": ")", "[": "]", "{": "}", "«": "»", "“": "”"}


def _unclosed(text: str) -> int:
    return sum(max(0, text.count(a) - text.count(b)) for a, b in _CLOSERS.items())


def _anchors(text: str) -> Counter:
    """What a translation keeps: numbers without their separators and capitalised words of a text."""
    out = Counter(re.sub(r"\D", "", n) for n in _NUMBER.findall(text))
    out.update(w.casefold() for w in _WORD.findall(text) if len(w) > 3 and w[0].isupper() and w[1:].islower())
    return out


def copied_share(a: list[str], b: list[str]) -> float:
    """Words of the longer list that the two have in common, as a share of it."""
    common = sum((Counter(a) & Counter(b)).values())
    return common / max(len(a), len(b), 1)


@lru_cache(1 << 14)
def _script(c: str) -> str:
    """The script of a letter, by the name of its compatible form; "" for what isn't a letter."""
    plain = unicodedata.normalize("NFKC", c)[:1] or c
    return unicodedata.name(plain, "").split(" ")[0].split("-")[0] if plain.isalpha() else ""


def foreign_share(text: str, target: str | None) -> float:
    """The share of a text's letters that aren't of the script of a language; 0 for a language not known."""
    script = SCRIPTS.get(target or "")
    if script is None or text.isascii() and script == "LATIN":
        return 0.0
    scripts: Counter = Counter()
    for c, n in Counter(text).items():
        scripts[_script(c)] += n
    del scripts[""]
    total = scripts.total()
    return 1 - scripts[script] / total if total >= LEAST_LETTERS else 0.0


#: What the rules leave of a pair. ``truncated`` is certain; ``least`` is the part of the usual length below which it is.
FLAGS = {
    "empty": "boolean", "refusal": "boolean", "copy": "boolean", "truncated": "boolean", "other_language": "boolean",
    "least": "double", "source": "string", "ratio": "double",
}
_NONE = {k: False if kind == "boolean" else None for k, kind in FLAGS.items()}


class Rules:
    """The rules that look at one pair; the model tells languages within a script."""

    def __init__(self, model: Model):
        self.model = model

    def flags(self, texts: list[str | None], answers: list[str | None], targets: list[str | None]) -> pd.DataFrame:
        asked = [visible(t or "") for t in texts]
        given = [visible(a or "") for a in answers]
        from_lang = self.model.probabilities(asked)
        to_lang = self.model.probabilities(given)
        rows = [self._one(asked[i], given[i], targets[i], from_lang[i], to_lang[i]) for i in range(len(asked))]
        return pd.DataFrame(rows, columns=list(FLAGS))

    def _one(self, text: str, answer: str, target: str | None, source: np.ndarray, result: np.ndarray) -> dict:
        out = dict(_NONE)
        if not text.strip():
            return out
        if not answer.strip():
            return out | {"empty": True}
        size, length = len(" ".join(text.split())), len(" ".join(answer.split()))
        if size > LEAST_CHARS and length > LEAST_CHARS:
            out |= {"source": LANGUAGES[int(np.argmax(source))], "ratio": length / size}
        if len(text.split()) < MIN_WORDS:
            return out
        out |= {"source": LANGUAGES[int(np.argmax(source))], "ratio": length / size}
        low = folded(answer).translate(_APOSTROPHES)
        if _REFUSAL.search(low) and REQUEST.search(low):
            kept, there = _anchors(text), _anchors(answer)
            shared = sum((kept & there).values())
            out["refusal"] = shared <= 0.34 * sum(kept.values()) and bool(
                sum(kept.values()) or copied_share([low], [folded(text)]) < 1
            )
        same = out["source"] == target and foreign_share(text, target) <= 0.5
        share = copied_share(_WORD.findall(folded(text)), _WORD.findall(low))
        out["copy"] = share >= COPY_SHARE and not same
        out["truncated"], out["least"] = self._breaks_off(text, answer)
        best = int(np.argmax(result))
        if foreign_share(answer, target) > 0.5:
            out["other_language"] = True
        elif target in LANGUAGES and not (same and share >= COPY_SHARE):
            out["other_language"] = bool(
                LANGUAGES[best] != target and result[best] >= OTHER_LANGUAGE_SHARE and result[LANGUAGES.index(target)] < 0.2
            )
        return out

    def _breaks_off(self, text: str, answer: str) -> tuple[bool, float | None]:
        """Whether an answer breaks off for certain, and else the part of the usual length below which it does."""
        if _BROKEN_OFF.search(answer.rstrip()) and not _BROKEN_OFF.search(text.rstrip()):
            return True, None
        if _STOPS.search(answer):
            return False, None
        if _STOPS.search(text):
            whole = not _anchors(text[int(len(text) * 0.7) :]) - _anchors(answer)
            return not whole or _unclosed(answer) > _unclosed(text), NEARLY_WHOLE
        kept = _anchors(text[1:])
        return False, SHORT if not kept or kept - _anchors(answer) else None


def usual_lengths(rows: DataFrame) -> DataFrame:
    """(source, target, usual): the median of ``ratio`` for each two languages over all rows.

    Counts by step of the ratio are added up before the shuffle, so what a median is taken of is bounded
    by the number of steps; the result has a row for each two languages with ``LEAST_RATIOS`` pairs or more.
    """
    step = F.least(F.floor(F.col("ratio") / RATIO_STEP), F.lit(RATIO_STEPS)).cast("int")
    some = rows.where(F.col("target").isin(*LANGUAGES) & F.col("source").isNotNull())
    counts = some.groupBy("source", "target", step.alias("step")).count()
    pair = Window.partitionBy("source", "target")
    counts = counts.withColumn("total", F.sum("count").over(pair))
    counts = counts.withColumn("so_far", F.sum("count").over(pair.orderBy("step")))
    middle = counts.where((F.col("total") >= LEAST_RATIOS) & (F.col("so_far") * 2 >= F.col("total")))
    return middle.groupBy("source", "target").agg(((F.min("step") + 0.5) * RATIO_STEP).alias("usual"))


def flagged(df: DataFrame, text: str, answer: str, target: str, model: Model) -> DataFrame:
    """``df`` without text and answer, with the flags of each pair."""
    shared = df.sparkSession.sparkContext.broadcast(Rules(model))
    kept = [c for c in df.columns if c not in (text, answer, *FLAGS)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rules = shared.value
        for batch in batches:
            texts, answers, targets = (list(batch[c].where(batch[c].notna(), None)) for c in (text, answer, target))
            for a, b in groups([f"{t}{x}" for t, x in zip(texts, answers)]):
                found = rules.flags(texts[a:b], answers[a:b], targets[a:b])
                yield pd.concat([batch.iloc[a:b][kept].reset_index(drop=True), found], axis=1)

    schema = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in kept)
    schema += ", " * bool(kept) + ", ".join(f"{c} {kind}" for c, kind in FLAGS.items())
    return df.select(*dict.fromkeys([*kept, text, answer, target])).mapInPandas(run, schema)


def defects(df: DataFrame, text: str, answer: str, target: str, model: Model) -> DataFrame:
    """``df`` without text and answer, with ``defects``, the array of all defects of the pair.

    Null and empty texts have no defect; a null target can't give ``other_language``. Columns of ``df``
    that are named like a flag are replaced and don't come back.
    """
    kept = [F.col(f"`{c}`") for c in df.columns if c not in (text, answer, "defects", *FLAGS)]
    named = df.withColumn("__target", F.col(f"`{target}`"))
    rows = written(flagged(named, text, answer, "__target", model), "pair-flags")
    usual = usual_lengths(rows.select("source", F.col("__target").alias("target"), "ratio"))
    usual = usual.withColumnsRenamed({"source": "__source", "target": "__asked"})
    # at most one row for each two of the languages
    rows = rows.join(F.broadcast(usual), (F.col("source") == F.col("__source")) & (F.col("__target") == F.col("__asked")), "left")
    short = F.coalesce(F.col("ratio") < F.col("least") * F.coalesce("usual", F.lit(1.0)), F.lit(False))
    found = {d: F.col(d) for d in DEFECTS} | {"truncated": F.col("truncated") | short}
    listed = F.array_compact(F.array(*[F.when(found[d], d) for d in DEFECTS]))
    return rows.select(*kept, listed.alias("defects"))
