"""Whole batches of texts as arrays of code points: words, n-grams and their hashes without loops.

Hashes are polynomials modulo 2**64 over code points, so the value depends on nothing but the text:
not on the process, the batch or the position.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np

#: Texts are worked on in groups of about so many characters, which bounds the memory of a worker.
GROUP_CHARS = 500_000
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_BASE_INV = np.uint64(pow(int(_BASE), -1, 2**64))
_SEP = "\x00"


def groups(texts: list[str], most: int = GROUP_CHARS) -> Iterator[tuple[int, int]]:
    """Bounds of consecutive runs of texts with about ``most`` characters together."""
    start = size = 0
    for i, text in enumerate(texts):
        if size and size + len(text) > most:
            yield start, i
            start, size = i, 0
        size += len(text) + 1
    if start < len(texts):
        yield start, len(texts)


@lru_cache(1)
def _invisible() -> frozenset[str]:
    """Characters without a shape of their own: format characters and variation selectors."""
    points = [c for c in range(0x20000) if unicodedata.category(chr(c)) == "Cf"]
    return frozenset(map(chr, [*points, 0x034F, 0x115F, 0x1160, 0x3164, *range(0xFE00, 0xFE10), *range(0xE0000, 0xE0080)]))


def visible(text: str) -> str:
    if not text.isascii():
        for c in _invisible().intersection(set(text)):
            text = text.replace(c, "")
    return text


def folded(text: str) -> str:
    """The text without invisible characters, in composed form and without regard to case."""
    if text.isascii():
        return text.lower()
    return unicodedata.normalize("NFC", visible(text)).casefold()


@lru_cache(1)
def _in_word() -> np.ndarray:
    flags = np.zeros(sys.maxunicode + 1, np.bool_)
    for c in range(0x30000):
        flags[c] = chr(c).isalnum() or (c > 0x2FF and unicodedata.category(chr(c)) in ("Mn", "Mc"))
    return flags


@lru_cache(1)
def _is_letter() -> np.ndarray:
    """Word characters but decimal digits and marks."""
    flags = np.zeros(sys.maxunicode + 1, np.bool_)
    for c in range(0x30000):
        flags[c] = chr(c).isalnum() and not chr(c).isdecimal()
    return flags


@lru_cache(1)
def _is_upper() -> np.ndarray:
    flags = np.zeros(sys.maxunicode + 1, np.bool_)
    for c in range(0x30000):
        flags[c] = chr(c).isupper()
    return flags


@lru_cache(1)
def _is_space() -> np.ndarray:
    flags = np.zeros(sys.maxunicode + 1, np.bool_)
    for c in (*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000):
        flags[c] = True
    flags[0] = True
    return flags


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The texts with a zero after each, as one array, and where each text begins (and the end)."""
    joined = _SEP.join([*texts, ""])
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    begins = np.zeros(len(texts) + 1, np.int64)
    np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts)), out=begins[1:])
    return points, begins


def mixed(h: np.ndarray) -> np.ndarray:
    """Scrambles 64-bit values so that any of their bits can serve as a hash."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x7FB5D329728EA185)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


@lru_cache(2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(n, _BASE), np.full(n, _BASE_INV)
    up[0] = down[0] = 1
    return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = _powers(1 << max(16, int(n - 1).bit_length()))
    return up[:n], down[:n]


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash for each values[start:end]; equal runs of values have equal hashes."""
    up, down = powers(len(values) + 1)
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum((values.astype(np.uint64) + np.uint64(1)) * up[: len(values)], out=sums[1:])
    return mixed((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


class Words:
    """The words of a group of texts: ``row`` (which text), ``hash``, ``start`` and ``end``.

    Words are runs of letters, digits and marks or, with another ``kind``, of anything but ``spaces``, or of
    ``letters`` only.
    """

    def __init__(self, texts: list[str], kind: str = "words"):
        self.points, self.begins = code_points(texts)
        # tables are built once a process; code points beyond them are never part of a word
        table = {"words": _in_word, "letters": _is_letter}.get(kind)
        inside = ~_is_space()[self.points] if table is None else table()[self.points]
        edge = np.flatnonzero(np.diff(inside.astype(np.int8), prepend=np.int8(0), append=np.int8(0)))
        self.start, self.end = edge[0::2], edge[1::2]
        self.row = np.searchsorted(self.begins, self.start, side="right") - 1
        self.hash = span_hashes(self.points, self.start, self.end)
        self.n_texts = len(texts)

    def bounds(self) -> np.ndarray:
        """Where each text's words begin (and the end)."""
        return np.searchsorted(self.row, np.arange(self.n_texts + 1))

    def capitalised(self, least: int) -> np.ndarray:
        """The words of at least so many letters whose first is upper case."""
        return np.flatnonzero((self.end - self.start >= least) & _is_upper()[self.points[self.start]])

    def text(self, i: int) -> str:
        return self.points[self.start[i] : self.end[i]].astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")


def distinct_rows(row: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, key), in order of row."""
    order = np.lexsort((key, row))
    row, key = row[order], key[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (key[1:] != key[:-1])
    return row[new], key[new]
