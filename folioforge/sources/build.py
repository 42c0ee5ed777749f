"""Documents made from tables of blocks: HTML by expressions, EPUB and DOCX packages around it.

The counterpart of the readers: what is written here reads back as the same blocks.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators.tables import rows_of
from .wordxml import NS

#: Elements by block type; other types are paragraphs.
TAGS = {"list_item": "li", "quote": "blockquote", "caption": "figcaption", "code": "pre"}
WORD_STYLES = {"caption": "Caption", "quote": "Quote", "toc_entry": "TOC1", "reference": "Bibliography", "index_entry": "Index1"}


def escaped(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def block_html() -> Column:
    """A block (block_type, block_level, text) as markup; a null text is an empty one."""
    kind, text = F.col("block_type"), F.coalesce("text", F.lit(""))
    body = escaped(text)

    def wrapped(tag: Column | str, attributes: str = "") -> Column:
        name = tag if isinstance(tag, Column) else F.lit(tag)
        return F.concat(F.lit("<"), name, F.lit(attributes + ">"), body, F.lit("</"), name, F.lit(">"))

    cells = F.transform(
        rows_of(text), lambda r: F.concat(F.lit("<tr>"), F.array_join(F.transform(r, lambda c: F.concat(F.lit("<td>"), escaped(c), F.lit("</td>"))), ""), F.lit("</tr>"))
    )
    level = F.least(F.lit(6), F.greatest(F.lit(1), F.coalesce("block_level", F.lit(1))))
    out = F.when(kind == "heading", wrapped(F.concat(F.lit("h"), level.cast("string"))))
    for name, tag in TAGS.items():
        out = out.when(kind == name, wrapped(tag))
    return (
        out.when(kind.isin("footnote", "endnote"), F.concat(F.lit('<aside class="'), kind, F.lit('">'), body, F.lit("</aside>")))
        .when(kind == "table", F.concat(F.lit("<table>"), F.array_join(cells, ""), F.lit("</table>")))
        .when(kind == "page_break", F.concat(F.lit('<span epub:type="pagebreak">'), body, F.lit("</span>")))
        .when(kind == "image", F.concat(F.lit('<img alt="'), F.replace(body, F.lit('"'), F.lit("&quot;")), F.lit('"/>')))
        .otherwise(wrapped("p"))
    )


def html_pages(blocks: DataFrame) -> DataFrame:
    """(document_id, html): one page a document, its blocks in order."""
    item = F.struct("block_index", "block_id", block_html().alias("h"))
    rows = blocks.groupBy("document_id").agg(F.array_sort(F.collect_list(item)).alias("bs"))
    body = F.array_join(F.transform("bs", lambda b: b["h"]), "\n")
    return rows.select("document_id", F.concat(F.lit("<html><body>"), body, F.lit("</body></html>")).alias("html"))


def epub_package(page: str, title: str) -> bytes:
    """A book of one page."""
    opf = (
        '<?xml version="1.0" encoding="utf-8"?><package xmlns="http://www.idpf.org/2007/opf" version="3.0"><metadata '
        f'xmlns:dc="http://purl.org/dc/elements/1.1/"><dc:title>{escape(title)}</dc:title></metadata><manifest>'
        '<item id="p1" href="p1.xhtml" media-type="application/xhtml+xml"/></manifest><spine><itemref idref="p1"/></spine></package>'
    )
    container = (
        '<container xmlns="urn:oasis:names:tc:opendocument:xmlns:container" version="1.0"><rootfiles><rootfile '
        'full-path="book/book.opf" media-type="application/oebps-package+xml"/></rootfiles></container>'
    )
    return _zipped({"mimetype": "application/epub+zip", "META-INF/container.xml": container, "book/book.opf": opf, "book/p1.xhtml": page})


def _zipped(parts: dict[str, str]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as package:
        for name, text in parts.items():
            package.writestr(zipfile.ZipInfo(name, (2000, 1, 1, 0, 0, 0)), text)
    return out.getvalue()


def docx_package(blocks: list[tuple[str, int | None, str]]) -> bytes:
    """A word-processing package from (type, level, text) of blocks in order."""
    body, notes = [], []
    for kind, level, text in blocks:
        if kind in ("footnote", "endnote"):
            notes.append(f'<w:footnote w:id="{len(notes) + 1}">{_paragraph(text)}</w:footnote>')
        elif kind == "table":
            lines = [line.split("|") for line in text.split("\n") if line.strip()]
            rows = ("".join(f"<w:tc>{_paragraph(c.strip())}</w:tc>" for c in line) for line in lines)
            body.append(f"<w:tbl>{''.join(f'<w:tr>{r}</w:tr>' for r in rows)}</w:tbl>")
        elif kind == "page_break":
            body.append('<w:p><w:r><w:br w:type="page"/></w:r></w:p>')
        elif kind == "heading":
            body.append(_paragraph(text, f'<w:pStyle w:val="Heading{level or 1}"/>'))
        elif kind == "list_item":
            body.append(_paragraph(text, '<w:numPr><w:ilvl w:val="0"/><w:numId w:val="1"/></w:numPr>'))
        elif kind != "image":
            style = WORD_STYLES.get(kind)
            body.append(_paragraph(text, f'<w:pStyle w:val="{style}"/>' if style else ""))
    space = f'xmlns:w="{NS["w"]}"'
    parts = {
        "[Content_Types].xml": '<?xml version="1.0"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types">'
        '<Default Extension="xml" ContentType="application/xml"/></Types>',
        "word/document.xml": f'<?xml version="1.0" encoding="utf-8"?><w:document {space}><w:body>{"".join(body)}</w:body></w:document>',
    }
    if notes:
        parts["word/footnotes.xml"] = f'<?xml version="1.0" encoding="utf-8"?><w:footnotes {space}>{"".join(notes)}</w:footnotes>'
    return _zipped(parts)


def _paragraph(text: str, properties: str = "", before: str = "", after: str = "", around: str = "") -> str:
    runs = "<w:br/>".join(f'<w:t xml:space="preserve">{escape(line)}</w:t>' for line in text.split("\n"))
    run = f"<w:r>{runs}</w:r>"
    run = f"<{around}>{run}</{around.split()[0]}>" if around else run
    return f"<w:p>{f'<w:pPr>{properties}</w:pPr>' if properties else ''}{before}{run}{after}</w:p>"


_RELATED = (
    '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">'
    '<Relationship Id="rId1" Target="https://example.org/quoted" TargetMode="External"/><Relationship Id="rId2" Target="media/one.png"/>'
    '<Relationship Id="rId3" Target="header1.xml"/><Relationship Id="rId4" Target="footer1.xml"/></Relationships>'
)
_DRAWING = (
    '<w:r><w:drawing><wp:inline><wp:docPr id="1" name="one" title="One" descr="A picture"/><a:graphic><a:graphicData><pic:pic>'
    '<pic:blipFill><a:blip r:embed="rId2"/></pic:blipFill></pic:pic></a:graphicData></a:graphic></wp:inline></w:drawing></w:r>'
)


def docx_with_parts(title: str, blocks: list[tuple[str, int | None, str]]) -> bytes:
    """A word-processing package with all that a package may have beside plain paragraphs.

    List items stand in content controls, quotes are links, captions have a picture, headings a bookmark, code a
    comment with its text; tables have a header row, a merged cell and a table inside their last row. A header
    and a footer name the title.
    """
    body: list[str] = []
    notes: dict[str, list[str]] = {"footnote": [], "endnote": [], "comment": []}

    def noted(kind: str, text: str) -> int:
        notes[kind].append(f'<w:{kind} w:id="{len(notes[kind]) + 1}">{_paragraph(text)}</w:{kind}>')
        return len(notes[kind])

    for kind, level, text in blocks:
        if kind in ("footnote", "endnote"):
            noted(kind, text)
        elif kind == "table":
            lines = [[c.strip() for c in line.split("|")] for line in text.split("\n") if line.strip()]
            rows = ["".join(f"<w:tc>{'<w:tcPr><w:gridSpan w:val="2"/></w:tcPr>' * (j == 0)}{_paragraph(c)}</w:tc>" for j, c in enumerate(line)) for line in lines]
            inner = f"<w:tbl><w:tr><w:tc>{_paragraph('inner')}</w:tc></w:tr></w:tbl>"
            rows.append(f"<w:tc>{_paragraph('outer')}{inner}</w:tc>")
            header = "<w:trPr><w:tblHeader/></w:trPr>"
            body.append(f"<w:tbl>{''.join(f'<w:tr>{header * (i == 0)}{r}</w:tr>' for i, r in enumerate(rows))}</w:tbl>")
        elif kind == "page_break":
            body.append('<w:p><w:r><w:br w:type="page"/></w:r></w:p>')
        elif kind == "heading":
            mark = '<w:bookmarkStart w:id="1" w:name="here"/><w:bookmarkEnd w:id="1"/>'
            body.append(_paragraph(text, f'<w:pStyle w:val="Heading{level or 1}"/>', before=mark))
        elif kind == "list_item":
            item = _paragraph(text, '<w:numPr><w:ilvl w:val="0"/><w:numId w:val="1"/></w:numPr>')
            body.append(f'<w:sdt><w:sdtPr><w:alias w:val="item"/><w:tag w:val="t1"/></w:sdtPr><w:sdtContent>{item}</w:sdtContent></w:sdt>')
        elif kind == "quote":
            body.append(_paragraph(text, '<w:pStyle w:val="Quote"/>', around='w:hyperlink r:id="rId1"'))
        elif kind == "caption":
            body.append(_paragraph(text, '<w:pStyle w:val="Caption"/>', after=_DRAWING))
        elif kind == "code":
            body.append(_paragraph(text, after=f'<w:r><w:commentReference w:id="{noted("comment", text)}"/></w:r>'))
        elif kind != "image":
            style = WORD_STYLES.get(kind)
            body.append(_paragraph(text, f'<w:pStyle w:val="{style}"/>' if style else ""))
    space = " ".join(f'xmlns:{p}="{NS[p]}"' for p in ("w", "r", "a", "wp", "pic"))
    parts = {
        "[Content_Types].xml": '<?xml version="1.0"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types">'
        '<Default Extension="xml" ContentType="application/xml"/><Default Extension="png" ContentType="image/png"/></Types>',
        "word/_rels/document.xml.rels": _RELATED,
        "word/media/one.png": "a picture",
        "word/header1.xml": f"<w:hdr {space}>{_paragraph(title)}</w:hdr>",
        "word/footer1.xml": f"<w:ftr {space}>{_paragraph('End of ' + title)}</w:ftr>",
        "word/document.xml": f'<?xml version="1.0" encoding="utf-8"?><w:document {space}><w:body>{"".join(body)}</w:body></w:document>',
    }
    for kind, found in notes.items():
        if found:
            parts[f"word/{kind}s.xml"] = f"<w:{kind}s {space}>{''.join(found)}</w:{kind}s>"
    return _zipped(parts)


def epub_with_parts(title: str, items: list[str]) -> bytes:
    """A book of two pages in the reading order, with metadata, a cover, a navigation page outside of the order,
    an item that nobody refers to, and hidden text, out of the markup of its blocks."""
    half = (len(items) + 1) // 2
    pages = {
        f"p{n}.xhtml": '<html xmlns:epub="http://www.idpf.org/2007/ops"><body><p style="display: none">hidden</p>' + "\n".join(part) + "</body></html>"
        for n, part in ((1, items[:half]), (2, items[half:]))
    }
    opf = (
        '<?xml version="1.0" encoding="utf-8"?><package xmlns="http://www.idpf.org/2007/opf" version="3.0"><metadata '
        f'xmlns:dc="http://purl.org/dc/elements/1.1/"><dc:description>About {escape(title)}</dc:description><dc:title>{escape(title)}</dc:title>'
        '<dc:creator>Someone</dc:creator><dc:language>en</dc:language><meta name="cover" content="c1"/></metadata><manifest>'
        '<item id="p1" href="p1.xhtml" media-type="application/xhtml+xml"/><item id="p2" href="p2.xhtml" media-type="application/xhtml+xml"/>'
        '<item id="n1" href="nav.xhtml" media-type="application/xhtml+xml" properties="nav"/><item id="c1" href="cover.jpg" media-type="image/jpeg"/>'
        '<item id="x1" href="unused.xhtml" media-type="application/xhtml+xml"/></manifest>'
        '<spine><itemref idref="p1"/><itemref idref="p2"/><itemref idref="gone"/></spine></package>'
    )
    container = (
        '<container xmlns="urn:oasis:names:tc:opendocument:xmlns:container" version="1.0"><rootfiles><rootfile '
        'full-path="book/book.opf" media-type="application/oebps-package+xml"/></rootfiles></container>'
    )
    nav = '<html xmlns:epub="http://www.idpf.org/2007/ops"><body><nav epub:type="toc">Contents</nav></body></html>'
    more = {"nav.xhtml": nav, "cover.jpg": "a picture", "unused.xhtml": "<html><body><p>unused</p></body></html>"}
    book = {f"book/{name}": text for name, text in (pages | more).items()}
    return _zipped({"mimetype": "application/epub+zip", "META-INF/container.xml": container, "book/book.opf": opf, **book})


PACKAGES = "document_id string, path string, source_format string, content binary, error string"


def packages(blocks: DataFrame, fmt: str, parts: bool = False) -> DataFrame:
    """One package a document, in the columns that the readers take; with ``parts`` it has all that a package may have."""
    if fmt == "html" or fmt == "epub" and not parts:
        rows = html_pages(blocks)
        if fmt == "html":
            return rows.select("document_id", F.col("document_id").alias("path"), F.lit(fmt).alias("source_format"),
                               F.encode("html", "utf-8").alias("content"), F.lit(None).cast("string").alias("error"))
    else:
        item = F.struct(
            "block_index", "block_id", "block_type", "block_level", F.coalesce("text", F.lit("")).alias("text"), block_html().alias("html")
        )
        rows = blocks.groupBy("document_id").agg(F.array_sort(F.collect_list(item)).alias("bs"))

    def plain(b: dict) -> tuple[str, int | None, str]:
        return b["block_type"], None if pd.isna(b["block_level"]) else int(b["block_level"]), b["text"]

    def marked(b: dict) -> str:
        if b["block_type"] == "list_item":
            return f"<ol>{b['html']}</ol>"
        if b["block_type"] == "table":
            return b["html"].replace("<td>", '<th colspan="2">', 1).replace("</td>", "</th>", 1)
        return b["html"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            keys = batch["document_id"]
            if fmt == "epub" and not parts:
                content = [epub_package(h, d) for d, h in zip(keys, batch["html"])]
            elif fmt == "epub":
                content = [epub_with_parts(d, [marked(b) for b in bs]) for d, bs in zip(keys, batch["bs"])]
            elif parts:
                content = [docx_with_parts(d, [plain(b) for b in bs]) for d, bs in zip(keys, batch["bs"])]
            else:
                content = [docx_package([plain(b) for b in bs]) for bs in batch["bs"]]
            yield pd.DataFrame({"document_id": keys, "path": keys, "source_format": fmt, "content": content, "error": None})

    return rows.mapInPandas(run, PACKAGES)


def read_back_text(kind: Column, text: Column) -> Column:
    """What a reader gives back of a block's text."""
    table = F.array_join(F.transform(rows_of(text), lambda r: F.array_join(r, "\t")), "\n")
    return F.when(kind == "table", table).otherwise(X.inline_text(text))
