"""Text clean-up as Spark expressions, each with the DuckDB expression that gives the same value."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .words import PYTHON_SPACE, PYTHON_SPACE_CHARS, re2

_SPACE = f"[{PYTHON_SPACE}]"
TOKEN = r"\[\[INLINE_\d{4}\]\]"

# Raised and lowered forms of digits and signs, in the order of PLAIN.
PLAIN = "0123456789+-=()"
RAISED = "⁰¹²³⁴⁵⁶⁷⁸⁹⁺⁻⁼⁽⁾"
LOWERED = "₀₁₂₃₄₅₆₇₈₉₊₋₌₍₎"

# Characters that a term sheds at both ends.
TERM_EDGES = " \t\r\n\"'.,;:!?()[]{}"

# Titles of tables of contents.
CONTENTS_TITLES = (
    "contents", "table of contents", "chapter contents", "índice", "indice", "tabla de contenido", "sommaire",
    "table des matières", "inhaltsverzeichnis", "sommario", "inhoudsopgave", "विषय-सूची", "विषय सूची", "अनुक्रमणिका",
    "सामग्री", "目录", "目錄", "目次", "목차", "فهرست", "المحتويات",
)


def sub(text: Column, pattern: str, to: str) -> Column:
    return F.regexp_replace(text, F.lit(pattern), F.lit(to))


def sub_sql(text: str, pattern: str, to: str) -> str:
    quoted = re2(pattern).replace("'", "''")
    return f"regexp_replace({text}, '{quoted}', '{to}', 'g')"


def strip(text: Column) -> Column:
    """Without white space at both ends, of all kinds that Python's str.strip knows."""
    return F.btrim(text, F.lit(PYTHON_SPACE_CHARS))


def strip_sql(text: str) -> str:
    return sub_sql(sub_sql(text, f"^{_SPACE}+", ""), f"{_SPACE}+$", "")


def blank(text: Column) -> Column:
    """True for null and for white space only."""
    return text.isNull() | ~text.rlike(f"[^{PYTHON_SPACE}]")


def inline_text(text: Column) -> Column:
    """Runs of blanks and tabs become one blank; none stays beside a line end or at the ends."""
    return strip(sub(sub(text, r"[ \t]+", " "), " *\n *", "\n"))


def inline_text_sql(text: str) -> str:
    return strip_sql(sub_sql(sub_sql(text, r"[ \t]+", " "), r" *\n *", "\n"))


def scientific_units(text: Column) -> Column:
    """``510³/l`` as scanned becomes ``5×10³/l``."""
    return F.regexp_replace(text, F.lit(f"\\b([1-9])10([{RAISED[:10]}]+)(?=\\s*/)"), F.lit("$1×10$2"))


def cell_text(text: Column) -> Column:
    """A table cell on one line: line ends and loose semicolons become ``; ``."""
    one_line = sub(sub(inline_text(text), r"\s*\n+\s*", "; "), r"\s*;\s*", "; ")
    return F.btrim(scientific_units(one_line), F.lit(" ;"))


def cell_text_sql(text: str) -> str:
    one_line = sub_sql(sub_sql(inline_text_sql(text), r"\s*\n+\s*", "; "), r"\s*;\s*", "; ")
    units = f"regexp_replace({one_line}, '\\b([1-9])10([{RAISED[:10]}]+)(\\s*/)', '\\1×10\\2\\3', 'g')"
    return f"trim({units}, ' ;')"


def raised(text: Column) -> Column:
    return F.translate(text, PLAIN, RAISED)


def lowered(text: Column) -> Column:
    return F.translate(text, PLAIN, LOWERED)


def paragraph_text(text: Column) -> Column:
    """A paragraph on one line."""
    return sub(strip(text), r"[ \t]*\n[ \t]*", " ")


def paragraphs(text: Column) -> Column:
    """The paragraphs of a manuscript: parts between empty lines, each on one line, blank ones left out."""
    lines = strip(F.replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n")))
    parts = F.transform(F.split(lines, r"\n\s*\n"), paragraph_text)
    return F.filter(F.coalesce(parts, F.array().cast("array<string>")), lambda p: p != "")


def casefold(text: Column) -> Column:
    """Python's str.casefold: upper case brings ß and ligatures apart, lower case meets in one sigma; the
    dotless i, which has no other case of its own, stays as it is. (The optimizer takes lower(upper(x)) for
    lower(x); a translation in between prevents that.)"""
    up = F.translate(F.upper(F.translate(F.lower(text), "ı", "\ue000")), "ς", "σ")
    ascii_only = F.octet_length(text) == F.char_length(text)
    return F.when(ascii_only, F.lower(text)).otherwise(F.translate(F.lower(up), "ς\ue000", "σı"))


def casefold_sql(text: str) -> str:
    out = f"lower({text})"
    for form, folded in (("ß", "ss"), ("ς", "σ"), ("ſ", "s"), ("ﬁ", "fi"), ("ﬂ", "fl")):
        out = f"replace({out}, '{form}', '{folded}')"
    return out


def term_key(term: Column) -> Column:
    """The form in which glossary terms are compared."""
    plain = F.replace(F.replace(term, F.lit("\u00ad"), F.lit("")), F.lit("\u00a0"), F.lit(" "))
    return F.btrim(casefold(sub(strip(plain), f"{_SPACE}+", " ")), F.lit(TERM_EDGES))


def term_key_sql(term: str) -> str:
    plain = f"replace(replace({term}, chr(173), ''), chr(160), ' ')"
    edges = TERM_EDGES.replace("'", "''")
    lines = casefold_sql(sub_sql(strip_sql(plain), f"{_SPACE}+", " "))
    return f"trim({lines}, '{edges}')"


def without_tokens(text: Column) -> Column:
    """For display: inline tokens don't show."""
    return sub(text, TOKEN, "")


def preview(text: Column, most: int = 220) -> Column:
    """One line of at most ``most`` characters, with three dots where it is cut."""
    line = strip(sub(text, f"{_SPACE}+", " "))
    cut = F.concat(F.rtrim(F.substring(line, 1, most - 3)), F.lit("..."))
    return F.when(F.char_length(line) <= most, line).otherwise(cut)


def preview_sql(text: str, most: int = 220) -> str:
    line = strip_sql(sub_sql(text, f"{_SPACE}+", " "))
    return f"CASE WHEN length({line}) <= {most} THEN {line} ELSE rtrim(substr({line}, 1, {most - 3})) || '...' END"


def is_scene_break(text: Column) -> Column:
    return strip(text).rlike(r"^(?:[*\-_=#]\s*){3,}$")


def is_numeric(text: Column) -> Column:
    """Only digits and what stands between and around them."""
    return strip(text).rlike(r"^[\s\d.,%$€£¥+\-()/:]+$")


def is_formula(text: Column) -> Column:
    return text.rlike(r"[=∑∫√±×÷≤≥]|\\frac|\\sum|\\int")


def is_symbol_marker(text: Column) -> Column:
    """Not blank, and without a letter or digit."""
    return ~blank(text) & ~text.rlike(r"(?U)[\p{L}\p{N}]")


def style_name(style: Column) -> Column:
    return F.lower(F.regexp_replace(style, "[ _-]", ""))


def style_block_type(style: Column) -> Column:
    """The block type a paragraph style stands for, null for none."""
    name = style_name(style)
    kinds = [("caption", "caption"), ("quote", "quote"), ("epigraph", "quote"), ("toc", "toc_entry"),
             ("bibliography", "reference"), ("reference", "reference"), ("index", "index_entry")]
    out = F.lit(None).cast("string")
    for part, kind in reversed(kinds):
        out = F.when(name.contains(part), kind).otherwise(out)
    return out


def heading_level(style: Column) -> Column:
    return F.nullif(F.regexp_extract(style, r"(?i)heading\s*(\d+)$", 1), F.lit("")).cast("int")


def semantic_block_type(values: Column, default: str) -> Column:
    """The type that an EPUB element's type, role, class and id stand for."""
    low = F.lower(values)
    return (
        F.when(low.contains("footnote"), "footnote")
        .when(low.contains("endnote") | low.contains("rearnote"), "endnote")
        .when(low.contains("toc") | F.lit(default == "nav"), "toc")
        .when(low.contains("sidebar") | low.contains("note"), "special")
        .otherwise(default)
    )


def has_contents_title(text: Column) -> Column:
    low = F.lower(inline_text(text))
    compact = sub(low, r"[\s\-_]+", "")
    found = F.lit(False)
    for title in CONTENTS_TITLES:
        joined = "".join(title.replace("-", " ").replace("_", " ").split())
        found = found | low.contains(title) | compact.contains(joined)
    return found


def page_references(text: Column) -> Column:
    """Entries of a list of contents: a separator and a page number."""
    return F.regexp_count(text, F.lit(r"[,;，；،؛]\s*\d{1,4}[A-Za-z]?\b"))


def string_list(value: Column) -> Column:
    """Trimmed strings that aren't blank."""
    return F.filter(F.transform(value, strip), lambda x: x.isNotNull() & (x != ""))


def numbered(prefix: str, number: Column) -> Column:
    """``b0001`` and the like; four digits are the least, not the most."""
    return F.concat(F.lit(prefix), F.when(number < 10000, F.lpad(number.cast("string"), 4, "0")).otherwise(number.cast("string")))


def numbered_sql(prefix: str, number: str) -> str:
    return f"'{prefix}' || CASE WHEN {number} < 10000 THEN lpad(({number})::VARCHAR, 4, '0') ELSE ({number})::VARCHAR END"


def stable_id(prefix: str, *parts: Column) -> Column:
    """An id of 12 hexadecimal digits that depends on the parts only."""
    return F.concat(F.lit(prefix), F.substring(F.sha2(F.concat_ws("\u0001", *parts), 256), 1, 12))


def valid_id(prefix: str, value: Column) -> Column:
    return value.rlike(f"^{prefix}[a-f0-9]{{12}}$")


def shown_size(count: Column) -> Column:
    """A number of bytes for display, in the largest unit that it fills, with two decimals at most."""

    def unit(size: int, name: str) -> Column:
        return F.concat(F.round(count / size, 2).cast("string"), F.lit(f" {name}"))

    return (
        F.when(count >= 1 << 20, unit(1 << 20, "MB")).when(count >= 1 << 10, unit(1 << 10, "KB"))
        .otherwise(F.concat(count.cast("string"), F.lit(" bytes")))
    )


UTC_FORMAT = "yyyy-MM-dd'T'HH:mm:ss'Z'"


def utc_text(time: Column) -> Column:
    """A time in whole seconds; the session's time zone is UTC."""
    return F.date_format(time, UTC_FORMAT)


def utc_time(text: Column) -> Column:
    """The time that a text names, null for what is none; an offset other than Z is taken into account."""
    return F.coalesce(F.try_to_timestamp(text, F.lit(UTC_FORMAT)), F.try_to_timestamp(text, F.lit("yyyy-MM-dd'T'HH:mm:ssXXX")))
