"""Words as maximal runs of characters that aren't white space, for Spark and for DuckDB."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The ranges of code points with the Unicode property White_Space.
SPACES = [(0x09, 0x0D), (0x20, 0x20), (0x85, 0x85), (0xA0, 0xA0), (0x1680, 0x1680), (0x2000, 0x200A),
          (0x2028, 0x2029), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000)]


def _char_class(ranges: list[tuple[int, int]]) -> str:
    return "".join(f"\\u{a:04x}-\\u{b:04x}" for a, b in ranges)


WHITE_SPACE = _char_class(SPACES)
#: What Python's str.isspace counts: the separators U+001C to U+001F besides.
PYTHON_SPACES = [*SPACES, (0x1C, 0x1F)]
PYTHON_SPACE = _char_class(PYTHON_SPACES)
WHITE_SPACE_CHARS = "".join(chr(c) for a, b in SPACES for c in range(a, b + 1))
PYTHON_SPACE_CHARS = "".join(chr(c) for a, b in PYTHON_SPACES for c in range(a, b + 1))

WORD = f"[^{WHITE_SPACE}]+"
PYTHON_WORD = f"[^{PYTHON_SPACE}]+"


def re2(pattern: str) -> str:
    """The same pattern with the escapes that DuckDB's regular expressions know."""
    out, at = [], 0
    while (i := pattern.find(r"\u", at)) >= 0:
        out += [pattern[at:i], r"\x{", pattern[i + 2 : i + 6], "}"]
        at = i + 6
    return "".join(out) + pattern[at:]


def count_words(text: Column, pattern: str = PYTHON_WORD) -> Column:
    """Number of words; null counts as no text.

    Splitting at white space takes a quarter of the time that matching words does.
    """
    spaces, chars = (WHITE_SPACE, WHITE_SPACE_CHARS) if pattern == WORD else (PYTHON_SPACE, PYTHON_SPACE_CHARS)
    trimmed = F.btrim(text, F.lit(chars))
    return F.when(trimmed != "", F.size(F.split(trimmed, f"[{spaces}]+"))).otherwise(0)


def count_words_sql(text: str, pattern: str = PYTHON_WORD) -> str:
    return f"coalesce(len(regexp_extract_all({text}, '{re2(pattern)}')), 0)::INTEGER"
