"""Problem 1: items above a size limit, cut into pieces at natural boundaries.

Recursive separators: a text is divided at section breaks; parts that are still too long at
paragraph breaks, then at line ends, sentence ends, words and at last (with ``unit="chars"``) single characters. The atoms
so found are packed greedily, in order, into pieces of at most the limit; every piece after the
first begins with the last ``overlap`` units of the piece before it.

Only rows above the limit are sent to Python: the count of units is a built-in expression. A row is
the unit of work, so no key, source or bucket gathers in one task.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.words import WORD, count_words

#: From the coarsest to the finest; a match is the separator, which stays with the part before it.
SEPARATORS = (
    ("section", re.compile(r"\n[ \t]*(?:\n[ \t]*){2,}|\f|\n(?=#{1,6} )|\n[ \t]*(?:[-*_=][ \t]*){3,}\n")),
    ("paragraph", re.compile(r"\n[ \t]*\n\s*")),
    ("line", re.compile(r"[\n\r]+")),
    ("sentence", re.compile(r"(?<=[.!?…])[\"'»”’)\]]*\s+|(?<=[。！？])")),
)
#: Where units are characters, words are a level above them; where they are words, the units themselves.
CHAR_SEPARATORS = (*SEPARATORS, ("word", re.compile(r"\s+")))
#: These separate paragraphs.
_PARAGRAPH_BREAKS = [pattern for name, pattern in SEPARATORS if name in ("section", "paragraph")]
_WORD = re.compile(WORD)
_CHARS = re.compile(r"(?s).")

PIECES = T.ArrayType(
    T.StructType(
        [
            T.StructField("piece_no", T.IntegerType()),
            T.StructField("start", T.IntegerType()),
            T.StructField("end", T.IntegerType()),
            T.StructField("overlap_units", T.IntegerType()),
            T.StructField("units", T.IntegerType()),
            T.StructField("cut_at", T.StringType()),
            T.StructField("piece_text", T.StringType()),
            T.StructField("starts_paragraph", T.BooleanType()),
            T.StructField("ends_paragraph", T.BooleanType()),
        ]
    )
)


def _boundaries(
    text: str, starts: list[int], lo: int, hi: int, level: int, most: int, separators: tuple = SEPARATORS
) -> Iterator[tuple[int, str]]:
    """Ends (as unit numbers) of the atoms of units[lo:hi], each of at most ``most`` units, with the
    level of the separator there. The last end, ``hi``, is left to the caller."""
    if hi - lo <= most:
        return
    if level == len(separators):
        for at in range(lo + 1, hi):
            yield at, "unit"
        return
    name, pattern = separators[level]
    cuts, unit = [], lo
    end = starts[hi] if hi < len(starts) else len(text)
    for m in pattern.finditer(text, starts[lo], end):
        while unit < hi and starts[unit] < m.end():
            unit += 1
        if lo < unit < hi and (not cuts or cuts[-1] != unit):
            cuts.append(unit)
    at = lo
    for cut in [*cuts, hi]:
        yield from _boundaries(text, starts, at, cut, level + 1, most, separators)
        if cut < hi:
            yield cut, name
        at = cut


def split_text(text: str | None, limit: int, overlap: int = 0, unit: str = "words") -> list[tuple]:
    """The pieces of one text as (number, start, end, overlap, units, cut_at, text, starts, ends).

    ``start`` and ``end`` are offsets in the text; the pieces without their overlaps, joined,
    give the text again, white space included. A text within the limit is one piece, null gives
    none. ``overlap`` is held below the limit, so that every piece brings something new. ``starts`` and
    ``ends`` say whether the piece, its overlap included, begins and ends where a paragraph does.
    """
    if text is None:
        return []
    limit = max(1, limit)
    overlap = max(0, min(overlap, limit - 1))
    starts = [m.start() for m in (_WORD if unit == "words" else _CHARS).finditer(text)]
    n = len(starts)
    if n <= limit:
        return [(1, 0, len(text), 0, n, "end", text, True, True)]
    after = sorted({0, len(text), *(m.end() for pattern in _PARAGRAPH_BREAKS for m in pattern.finditer(text))})
    paragraphs = {bisect_left(starts, at) for at in after}
    separators = SEPARATORS if unit == "words" else CHAR_SEPARATORS
    ends = [*_boundaries(text, starts, 0, n, 0, limit - overlap, separators), (n, "end")]
    out, fresh, back, at = [], 0, 0, 0
    while fresh < n:
        end, cut = fresh, ""
        k = len(out)
        while at < len(ends) and ends[at][0] - (fresh - back) <= limit:
            end, cut = ends[at]
            at += 1
        begin = starts[fresh - back] if k or back else 0
        stop = starts[end] if end < n else len(text)
        edges = fresh - back in paragraphs, end in paragraphs
        out.append((k + 1, begin, stop, back, end - fresh + back, cut, text[begin:stop], *edges))
        fresh, back = end, min(overlap, end)
    return out


def split_oversized(df: DataFrame, text: str, limit: Column, overlap: Column, unit: str = "words") -> DataFrame:
    """The rows of ``df`` whose ``text`` has more units than ``limit``, one row for each piece, without the text
    itself (which would stand beside each of its pieces).

    Adds piece_no, piece_count, start, end, overlap_units, units, cut_at, piece_text, starts_paragraph and
    ends_paragraph; an own column of such a name is replaced. Null and empty texts are within every limit and give no
    rows; a null limit holds nothing back either. Units are words (runs of characters that aren't
    white space) or, with ``unit="chars"``, characters.
    """
    size = count_words(F.col(text), WORD) if unit == "words" else F.char_length(text)

    @F.pandas_udf(PIECES)
    def cut(texts: pd.Series, limits: pd.Series, overlaps: pd.Series) -> pd.Series:
        return pd.Series([split_text(t, int(m), int(o), unit) for t, m, o in zip(texts, limits, overlaps)])

    cut = cut.asNondeterministic()  # else the optimizer repeats it in a filter on the result's size
    added = ["piece_no", "piece_count", *PIECES.elementType.fieldNames()[1:]]
    kept = [F.col(f"`{c}`") for c in df.columns if c not in (text, *added)]
    # n words need 2n - 1 characters at least: most rows are decided without splitting them into words
    least = 2 * limit + 1 if unit == "words" else limit + 1
    big = df.where(F.char_length(text) >= least).where(size > limit).select(
        *kept, cut(F.col(text), limit.cast("int"), F.coalesce(overlap, F.lit(0)).cast("int")).alias("__pieces")
    )
    return big.select(
        *kept, F.size("__pieces").alias("piece_count"), F.explode("__pieces").alias("__piece")
    ).select(*kept, "piece_count", "__piece.*")
