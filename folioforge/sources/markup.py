"""HTML and EPUB: blocks out of markup, and translations back into it.

The parser keeps, for each element, where its content lies in the source. Writing back replaces just
those ranges: whatever isn't translated stays as it was, byte for byte. Missing end tags of p, li, td
and the like are supplied as HTML does.
"""

from __future__ import annotations

import html
import io
import posixpath
import re
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser
from typing import Any
from xml.etree import ElementTree as ET

from .wordxml import Site, numeric, padded, scene_break, tidy

# Elements without content, and those that an opening tag of the named kinds closes.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
CLOSED_BY = {
    "p": {"p", "h1", "h2", "h3", "h4", "h5", "h6", "ul", "ol", "table", "blockquote", "pre", "div", "aside", "nav",
          "section", "article", "header", "footer", "figure", "figcaption", "hr", "dl", "form"},
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"},
    "tr": {"tr", "tbody", "thead", "tfoot"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"},
}
SCOPES = {"table", "ul", "ol", "dl", "td", "th", "body", "html", "div", "section", "article", "blockquote"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
BLOCKS = HEADINGS | {"p", "li", "blockquote", "figcaption", "table", "img", "aside", "pre", "code", "nav", "span"}
SIMPLE = {"p": "paragraph", "li": "list_item", "blockquote": "quote", "figcaption": "caption"}
UNSEEN = {"script", "style", "head", "template"}


@dataclass(eq=False)
class Node:
    tag: str
    attrs: dict[str, str]
    parent: Node | None
    inner_start: int = 0
    inner_end: int = 0
    children: list[Node | str] = field(default_factory=list)

    def walk(self) -> Iterator[Node]:
        for child in self.children:
            if isinstance(child, Node):
                yield child
                yield from child.walk()

    def ancestors(self) -> Iterator[Node]:
        node = self.parent
        while node is not None:
            yield node
            node = node.parent

    def find(self, *tags: str) -> list[Node]:
        return [n for n in self.walk() if n.tag in tags]

    def strings(self) -> Iterator[str]:
        for child in self.children:
            if isinstance(child, str):
                yield child
            elif child.tag not in UNSEEN:
                yield from child.strings()

    @property
    def text(self) -> str:
        return tidy(" ".join(filter(None, (s.strip() for s in self.strings()))))

    @property
    def classes(self) -> list[str]:
        return self.attrs.get("class", "").split()


class _Builder(HTMLParser):
    def __init__(self, source: str):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("", {}, None, 0, len(source))
        self.lines = [0, *(m.end() for m in re.finditer("\n", source))]
        self.feed(source)
        self.close()
        while self.at is not self.root:
            self._leave(len(source))

    def _place(self) -> int:
        line, column = self.getpos()
        return self.lines[line - 1] + column

    def _leave(self, end: int) -> None:
        self.at.inner_end = end
        self.at = self.at.parent or self.root

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        here = self._place()
        node = self.at
        while node is not self.root:
            if tag in CLOSED_BY.get(node.tag, ()):
                while self.at is not node:
                    self._leave(here)
                self._leave(here)
                node = self.at
                continue
            if node.tag in SCOPES:
                break
            node = node.parent or self.root
        child = Node(tag, {k: v or "" for k, v in attrs}, self.at)
        child.inner_start = child.inner_end = here + len(self.get_starttag_text() or "")
        self.at.children.append(child)
        if tag not in VOID:
            self.at = child

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self._leave(self.at.inner_start)

    def handle_endtag(self, tag: str) -> None:
        here, node = self._place(), self.at
        while node is not self.root and node.tag != tag:
            node = node.parent or self.root
        if node is not self.root:
            while self.at is not node:
                self._leave(here)
            self._leave(here)

    def handle_data(self, data: str) -> None:
        self.at.children.append(data)


def parse(source: str) -> Node:
    return _Builder(source).root


def decoded(content: bytes) -> str:
    """Text of a document: by its byte order mark or declaration, else UTF-8."""
    found = re.search(rb"(?:encoding|charset)\s*=\s*[\"']?([\w.:-]+)", content[:1024])
    for name in (found.group(1).decode("ascii") if found else "utf-8", "utf-8-sig", "latin-1"):
        try:
            return content.decode("utf-8-sig" if name.lower() in ("utf-8", "utf8") else name)
        except (LookupError, UnicodeDecodeError):
            continue
    return content.decode("utf-8", "replace")


# ---- predicates ----


def hidden(node: Node) -> bool:
    style = re.sub(r"\s+", "", node.attrs.get("style", "").casefold())
    return (
        "hidden" in node.attrs or node.attrs.get("aria-hidden") == "true"
        or "display:none" in style or "visibility:hidden" in style
    )


def _about(node: Node) -> str:
    return " ".join(node.attrs.get(k, "") for k in ("epub:type", "role", "class", "id")).casefold()


def page_break(node: Node) -> bool:
    return "pagebreak" in _about(node) or "page-break" in _about(node)


def semantic_type(node: Node) -> str:
    """The type of an aside or nav by what it says about itself."""
    about = _about(node)
    for parts, kind in ((("footnote",), "footnote"), (("endnote", "rearnote"), "endnote"), (("toc",), "toc")):
        if any(p in about for p in parts):
            return kind
    if node.tag == "nav":
        return "toc"
    return "special" if "sidebar" in about or "note" in about else node.tag


def formula(text: str) -> bool:
    return bool(re.search(r"[=∑∫√±×÷≤≥]|\\frac|\\sum|\\int", text))


def metadata(node: Node, item: str) -> dict[str, Any]:
    style, classes = node.attrs.get("style", "").casefold(), node.attrs.get("class", "").casefold()
    tags = {node.tag} | {n.tag for n in node.walk()}
    inside = {n.tag for n in node.walk()}
    return {
        "source_item": item, "html_tag": node.tag, "id": node.attrs.get("id", ""), "class": node.classes,
        "epub_type": node.attrs.get("epub:type", ""), "role": node.attrs.get("role", ""),
        "lang": node.attrs.get("lang") or node.attrs.get("xml:lang") or "",
        "hrefs": [a.attrs["href"] for a in node.find("a") if a.attrs.get("href")],
        "formatting": {
            "bold": bool(tags & {"b", "strong"}), "italic": bool(tags & {"i", "em"}),
            "underline": "underline" in style or "u" in inside,
            "small_caps": "small-caps" in style or "smallcaps" in classes,
            "superscript": "sup" in tags, "subscript": "sub" in tags,
        },
        "contains_code": "code" in tags, "contains_math": "math" in inside,
        "contains_form_control": bool(inside & {"input", "select", "textarea", "button"}),
        "contains_checkbox": any(n.attrs.get("type") == "checkbox" for n in node.find("input")),
        "contains_page_break": page_break(node) or any(map(page_break, node.walk())),
        "contains_hidden_text": any(map(hidden, node.walk())),
    }


# ---- blocks ----


@dataclass
class Spot:
    """A block of markup and its element."""

    site: Site
    node: Node


def spots(root: Node, item: str) -> Iterator[Spot]:
    """The blocks of a page in order; what lies within another block belongs to that one."""
    body = next(iter(root.find("body")), root)
    for node in body.walk():
        if node.tag not in BLOCKS or hidden(node) or node.tag == "span" and not page_break(node):
            continue
        if node.tag not in ("img", "span"):
            around = iter(node.ancestors())
            if any(a.tag in BLOCKS for a in iter(lambda around=around: next(around, body), body)):
                continue
        site = _site(node, item)
        if site is not None:
            yield Spot(site, node)


def _site(node: Node, item: str) -> Site | None:
    text, about = node.text, metadata(node, item)
    if node.tag == "img":
        return Site("image", "", item, translate=False, metadata=about | {k: node.attrs.get(k, "") for k in ("src", "alt", "title")})
    if node.tag == "table":
        return _table(node, item, about)
    if node.tag == "span":
        return Site("page_break", text, item, translate=False, metadata=about)
    if not text:
        return None
    if node.tag in HEADINGS:
        return Site("heading", text, item, level=int(node.tag[1]), metadata=about)
    if node.tag in ("pre", "code"):
        return Site("code", text, item, translate=False, metadata=about)
    if node.tag in ("aside", "nav"):
        kind = semantic_type(node)
        return Site(kind, text, item, translate=kind != "toc", metadata=about)
    if node.tag == "p":
        exact = scene_break(text)
        return Site("special" if exact else "paragraph", text, item, metadata=about | {"preserve_exact": exact})
    if node.tag == "li":
        lists = [a.tag for a in node.ancestors() if a.tag in ("ol", "ul")]
        about |= {"list_type": lists[0] if lists else None, "list_level": len(lists)}
    return Site(SIMPLE[node.tag], text, item, metadata=about)


def cells(table: Node) -> list[list[Node]]:
    return [line for row in table.find("tr") if (line := row.find("th", "td"))]


def _table(node: Node, item: str, about: dict[str, Any]) -> Site:
    lines = cells(node)
    rows = [[c.text for c in line] for line in lines]
    described = [
        {"cells": [
            {"tag": c.tag, "colspan": c.attrs.get("colspan"), "rowspan": c.attrs.get("rowspan"), "scope": c.attrs.get("scope"),
             "is_header": c.tag == "th", "looks_formula_like": formula(c.text), "looks_numeric": numeric(c.text)}
            for c in line]}
        for line in lines
    ]
    flat = [c for line in described for c in line["cells"]]
    about |= {
        "rows": rows, "row_metadata": described, "has_header_cells": any(c["is_header"] for c in flat),
        "has_merged_cells": any(c["colspan"] or c["rowspan"] for c in flat),
    }
    return Site("table", "\n".join("\t".join(r) for r in rows).strip(), item, metadata=about)


def html_sites(source: str, item: str = "") -> list[Site]:
    """The blocks of a single page, numbered."""
    found = [spot.site for spot in spots(parse(source), item)]
    for i, site in enumerate(found, 1):
        site.block_id = f"b{i:04d}"
    return found


# ---- EPUB packages ----

OPF = {"opf": "http://www.idpf.org/2007/opf", "dc": "http://purl.org/dc/elements/1.1/"}
CONTAINER = "{urn:oasis:names:tc:opendocument:xmlns:container}rootfile"
FIELDS = ("title", "creator", "language", "publisher", "description")
TRANSLATED_FIELDS = ("title", "description")


class Book:
    """The package document of an EPUB: metadata, manifest and reading order."""

    def __init__(self, package: zipfile.ZipFile):
        root = next(ET.fromstring(package.read("META-INF/container.xml")).iter(CONTAINER), None)
        self.path = root.get("full-path") if root is not None else None
        if not self.path:
            raise ValueError("the container names no package document")
        self.opf = package.read(self.path)
        tree = ET.fromstring(self.opf)
        base = posixpath.dirname(self.path)
        self.items = [
            {"id": i.get("id", ""), "path": posixpath.normpath(posixpath.join(base, i.get("href", ""))),
             "media_type": i.get("media-type", ""), "properties": i.get("properties", "").split()}
            for i in tree.findall(".//opf:manifest/opf:item", OPF) if i.get("href")
        ]
        pages = {i["id"]: i["path"] for i in self.items if "html" in i["media_type"]}
        order = [r.get("idref", "") for r in tree.findall(".//opf:spine/opf:itemref", OPF)]
        self.spine = [pages[i] for i in order if i in pages]
        self.extra = [
            i["path"] for i in self.items
            if "nav" in i["properties"] and i["path"] not in self.spine and "html" in i["media_type"]
        ]
        covers = {m.get("content") for m in tree.findall(".//opf:metadata/opf:meta", OPF) if m.get("name") == "cover"}
        self.covers = [
            i for i in self.items
            if i["media_type"].startswith("image/") and ("cover-image" in i["properties"] or i["id"] in covers)
        ]
        self.fields = [
            (name, (node.text or "").strip())
            for name in FIELDS for node in tree.findall(f".//opf:metadata/dc:{name}", OPF) if (node.text or "").strip()
        ]


def epub_spots(package: zipfile.ZipFile, sources: dict[str, str]) -> Iterator[tuple[Site, Node | None]]:
    """Every block of a book, numbered; ``sources`` receives the text of the pages."""
    book = Book(package)
    names, found = set(package.namelist()), []
    for name, text in book.fields:
        found.append((Site(f"metadata_{name}", text, book.path, translate=name in TRANSLATED_FIELDS, metadata={"metadata_field": name}), None))
    for item in book.covers:
        about = {"src": item["path"], "manifest_id": item["id"], "media_type": item["media_type"], "is_cover": True}
        found.append((Site("image", "", book.path, translate=False, metadata=about), None))
    for path in [*book.extra, *book.spine]:
        if path in names:
            sources[path] = decoded(package.read(path))
            found += [(spot.site, spot.node) for spot in spots(parse(sources[path]), path)]
    for i, (site, node) in enumerate(found, 1):
        site.block_id = f"b{i:04d}"
        yield site, node


def write_epub(content: bytes, translations: dict[str, Any]) -> tuple[bytes, dict[str, Any]]:
    """The book with translations by block id in their places; the rest is copied as it is."""
    warnings: list[str] = []
    edits: dict[str, list[tuple[int, int, str]]] = {}
    fields: dict[str, list[str | None]] = {}
    used: set[str] = set()
    blocks = 0
    with zipfile.ZipFile(io.BytesIO(content)) as package:
        sources: dict[str, str] = {}
        book = Book(package)
        for site, node in epub_spots(package, sources):
            if not site.translate or not site.text.strip():
                continue
            blocks += 1
            given = translations.get(site.block_id)
            rows = given.get("table_rows") if isinstance(given, dict) else None
            text = str((given.get("translated_text") if isinstance(given, dict) else given) or "").strip()
            if not text and rows:
                text = "\n".join("\t".join(map(str, r)) for r in rows)
            if text:
                used.add(site.block_id)
            else:
                warnings.append(f"{site.block_id}: no translation; source text kept")
            if node is None:
                fields.setdefault(site.metadata["metadata_field"], []).append(text or None)
            elif text:
                source, into = sources[site.part], edits.setdefault(site.part, [])
                if site.type == "table":
                    warnings += _table_edits(site, node, text, rows, source, into)
                else:
                    warnings += _edit(node, text, source, into)
        if unused := sorted(set(translations) - used):
            warnings.append("not applied: " + ", ".join(unused))
        replaced = {path: _spliced(sources[path], spans) for path, spans in edits.items()}
        if any(v for values in fields.values() for v in values):
            replaced[book.path] = _with_fields(decoded(book.opf), fields)
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as result:
            for item in package.infolist():
                data = replaced.get(item.filename)
                result.writestr(item, package.read(item.filename) if data is None else data.encode("utf-8"))
    report = {"translatable_block_count": blocks, "applied_unit_count": len(used), "files_modified": sorted(replaced),
              "warnings": list(dict.fromkeys(warnings))}
    return out.getvalue(), report


def _spliced(source: str, spans: list[tuple[int, int, str]]) -> str:
    out, at = [], 0
    for start, end, text in sorted(spans):
        out += [source[at:start], text]
        at = end
    return "".join(out) + source[at:]


def _edit(node: Node, text: str, source: str, into: list[tuple[int, int, str]]) -> list[str]:
    """Puts a text into an element; formulas inside it stay, after the text."""
    formulas = node.find("math")
    kept = [source[source.rfind("<", 0, m.inner_start) : source.find(">", m.inner_end) + 1] for m in formulas]
    if formulas and not any(s.strip() for s in _outside(node)):
        return ["formulas were kept in place of their translation"]
    into.append((node.inner_start, node.inner_end, " ".join([html.escape(text, quote=False), *kept])))
    out = ["formulas were kept beside translated text"] if kept else []
    return out + (["inline markup may be lost inside translated text"] if any(True for _ in node.walk()) else [])


def _outside(node: Node) -> Iterator[str]:
    """The strings of an element that aren't part of a formula."""
    for child in node.children:
        if isinstance(child, str):
            yield child
        elif child.tag != "math":
            yield from _outside(child)


def _table_edits(
    site: Site, node: Node, text: str, rows: list[list[str]] | None, source: str, into: list[tuple[int, int, str]]
) -> list[str]:
    lines = cells(node)
    wanted = [[str(c) for c in r] for r in rows] if rows else [
        [c.strip() for c in line.split("\t")] for line in text.splitlines() if line.strip()
    ]
    wanted = padded(wanted, site.metadata["rows"])
    warnings: list[str] = []
    if [len(r) for r in wanted] != [len(r) for r in lines]:
        if lines:
            warnings += _edit(lines[0][0], text, source, into)
        return [*warnings, f"{site.block_id}: table shape not kept; the whole text stands in the first cell"]
    for line, texts in zip(lines, wanted):
        for cell, new in zip(line, texts):
            warnings += _edit(cell, new, source, into)
    return warnings


def _with_fields(opf: str, fields: dict[str, list[str | None]]) -> str:
    """The package document with new titles and descriptions, the n-th in the place of the n-th."""
    for name, values in fields.items():
        left = iter(values)

        def put(m: re.Match, left: Iterator[str | None] = left) -> str:
            if not m.group(2).strip():
                return m.group()
            new = next(left, None)
            return m.group() if new is None else m.group(1) + html.escape(new, quote=False) + m.group(3)

        opf = re.sub(rf"(<dc:{name}\b[^>]*>)(.*?)(</dc:{name}>)", put, opf, flags=re.S)
    return opf
