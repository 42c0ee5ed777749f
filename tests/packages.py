"""Small packages made in code."""

from __future__ import annotations

import io
import zipfile

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
MORE = (
    'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships" '
    'xmlns:m="http://schemas.openxmlformats.org/officeDocument/2006/math" '
    'xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main" '
    'xmlns:wp="http://schemas.openxmlformats.org/drawingml/2006/wordprocessingDrawing"'
)


def zipped(parts: dict[str, str | bytes]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as package:
        for name, data in parts.items():
            package.writestr(name, data)
    return out.getvalue()


def parts(content: bytes) -> dict[str, str]:
    with zipfile.ZipFile(io.BytesIO(content)) as package:
        return {n: package.read(n).decode("utf-8", "replace") for n in package.namelist()}


def run(text: str, look: str = "") -> str:
    return f'<w:r>{f"<w:rPr>{look}</w:rPr>" if look else ""}<w:t xml:space="preserve">{text}</w:t></w:r>'


def par(*runs: str, style: str = "", properties: str = "") -> str:
    inner = (f'<w:pStyle w:val="{style}"/>' if style else "") + properties
    return f"<w:p>{f'<w:pPr>{inner}</w:pPr>' if inner else ''}{''.join(runs)}</w:p>"


def cell(*paragraphs: str, properties: str = "") -> str:
    return f"<w:tc>{f'<w:tcPr>{properties}</w:tcPr>' if properties else ''}{''.join(paragraphs)}</w:tc>"


def table(*rows: list[str]) -> str:
    return f"<w:tbl>{''.join('<w:tr>' + ''.join(r) + '</w:tr>' for r in rows)}</w:tbl>"


def docx(body: str, **more: str) -> bytes:
    out: dict[str, str | bytes] = {
        "[Content_Types].xml": "<Types/>",
        "word/document.xml": f"<?xml version='1.0'?><w:document {W} {MORE}><w:body>{body}</w:body></w:document>",
        "word/_rels/document.xml.rels": '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">'
        '<Relationship Id="r1" Target="header1.xml"/><Relationship Id="r2" Target="footer1.xml"/>'
        '<Relationship Id="r3" Target="media/image1.png"/><Relationship Id="r4" Target="https://example.org/"/></Relationships>',
        "word/media/image1.png": b"\x89PNG",
    }
    for name in ("footnotes", "endnotes", "comments", "header1", "footer1"):
        if name in more:
            root = {"header1": "hdr", "footer1": "ftr"}.get(name, name)
            out[f"word/{name}.xml"] = f"<w:{root} {W}>{more[name]}</w:{root}>"
    return zipped(out)


def epub(pages: dict[str, str], nav: str | None = None, title: str = "A title", extra: str = "") -> bytes:
    items = "".join(f'<item id="i{i}" href="{n}" media-type="application/xhtml+xml"/>' for i, n in enumerate(pages))
    if nav is not None:
        items += '<item id="nav" href="nav.xhtml" media-type="application/xhtml+xml" properties="nav"/>'
    order = "".join(f'<itemref idref="i{i}"/>' for i in range(len(pages)))
    opf = (
        '<?xml version="1.0"?><package xmlns="http://www.idpf.org/2007/opf"><metadata xmlns:dc="http://purl.org/dc/elements/1.1/">'
        f"<dc:title>{title}</dc:title><dc:creator>Someone</dc:creator><dc:language>en</dc:language>"
        f'<meta name="cover" content="c1"/></metadata><manifest>{items}{extra}'
        f'<item id="c1" href="img/c.jpg" media-type="image/jpeg"/></manifest><spine>{order}<itemref idref="gone"/></spine></package>'
    )
    out: dict[str, str | bytes] = {
        "mimetype": "application/epub+zip",
        "META-INF/container.xml": '<container xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles>'
        '<rootfile full-path="OEBPS/p.opf"/></rootfiles></container>',
        "OEBPS/p.opf": opf,
        "OEBPS/img/c.jpg": b"\xff\xd8",
    }
    out |= {f"OEBPS/{n}": t for n, t in pages.items()}
    if nav is not None:
        out["OEBPS/nav.xhtml"] = nav
    return zipped(out)
