"""Reading packages into blocks and writing translations back."""

import json
import os

import pytest
from packages import cell, docx, epub, par, parts, run, table, zipped

from folioforge.sources import markup, packages, wordxml

NOTE = '<w:footnote w:id="2">{}</w:footnote>'


def blocks(content, fmt="docx"):
    return packages.file_sites(content, fmt)


def kinds(found):
    return [(b.block_id, b.type, b.text) for b in found]


def test_docx_blocks_in_order():
    body = (
        par(run("One"), style="Heading1") + par(run("plain "), run("text"))
        + par(run("item"), properties='<w:numPr><w:ilvl w:val="1"/><w:numId w:val="3"/></w:numPr>')
        + par(run("* * *")) + par("<m:oMath/>") + par('<w:r><w:br w:type="page"/></w:r>')
        + par(run("said"), style="Block Quote") + par(run("fig"), style="caption")
        + '<w:sdt><w:sdtPr><w:alias w:val="A"/></w:sdtPr><w:sdtContent>' + par(run("inside")) + "</w:sdtContent></w:sdt>"
        + table([cell(par(run("a"))), cell(par(run("b")), par(run("c")))])
    )
    content = docx(
        body, footnotes=NOTE.format(par(run("note"))) + '<w:footnote w:id="3">' + par() + "</w:footnote>",
        comments='<w:comment w:id="0">' + par(run("remark")) + "</w:comment>",
        header1=par(run("head")), footer1=par(run("foot")),
    )
    found = blocks(content)
    assert kinds(found) == [
        ("b0001", "heading", "One"), ("b0002", "paragraph", "plain text"), ("b0003", "list_item", "item"),
        ("b0004", "special", "* * *"), ("b0005", "equation", ""), ("b0006", "page_break", ""), ("b0007", "quote", "said"),
        ("b0008", "caption", "fig"), ("b0009", "paragraph", "inside"), ("b0010", "table", "a\tb; c"),
        ("b0011", "footnote", "note"), ("b0012", "comment", "remark"), ("b0013", "header", "head"), ("b0014", "footer", "foot"),
    ]
    assert found[0].level == 1 and found[2].metadata["list"] == {"num_id": "3", "level": "1"}
    assert found[8].metadata["tree_path"] == "body/sdt[1]/sdtContent/p[1]" and found[8].metadata["content_control"]["alias"] == "A"
    assert [b.translate for b in found[4:6]] == [False, False]
    json.dumps([b.metadata for b in found])


def test_docx_inline_tokens():
    link = '<w:hyperlink r:id="r4">' + run("there") + "</w:hyperlink>"
    raised = run("2", '<w:vertAlign w:val="superscript"/>')
    found = blocks(docx(par(run("go "), link, run(" x"), raised, run("bold", "<w:b/>"))))[0]
    assert found.text == "go there x²bold"
    marks = found.metadata["inline_source_text"]
    assert marks == "go [[INLINE_0001]]there[[INLINE_0002]] x[[INLINE_0003]][[INLINE_0004]]bold[[INLINE_0005]]"
    assert [p["kind"] for p in found.metadata["inline_placeholders"]] == [
        "container_start", "container_end", "superscript", "container_start", "container_end"]
    assert found.metadata["hyperlinks"][0]["target"] == "https://example.org/"


def test_docx_images_and_tables():
    picture = '<w:r><w:drawing><wp:inline><wp:docPr descr="a cat" title="t"/><a:blip r:embed="r3"/></wp:inline></w:drawing></w:r>'
    nested = table([cell(par(run("in")))])
    content = docx(par(picture) + table([cell(par(run("x")), nested, properties='<w:gridSpan w:val="2"/>'), cell(par())]))
    found = blocks(content)
    assert [b.type for b in found] == ["image", "table", "table"]
    assert found[0].metadata["target"] == "media/image1.png" and found[0].metadata["description"] == "a cat"
    assert found[1].metadata["has_merged_cells"] and found[1].metadata["nested_table_count"] == 1
    assert found[2].metadata["tree_path"] == "body/tbl[1]/nestedTbl[1]" and found[2].metadata["nesting_level"] == 1


@pytest.mark.parametrize("rows, role, confidence", [
    ([["Inhaltsverzeichnis", ""], ["One, 3; Two, 5; Three, 9; Four, 12", "x"]], "toc_layout", "high"),
    ([["1", "2"], ["3", "4"]], "data", "high"),
    ([["a", "b", "c"]] * 6, "data", "high"),
])
def test_table_roles(rows, role, confidence):
    found = blocks(docx(table(*[[cell(par(run(c))) for c in r] for r in rows])))[0]
    assert (found.metadata["table_role"], found.metadata["table_role_confidence"]) == (role, confidence)


def test_docx_round_trip_keeps_the_rest():
    body = par(run("One")) + par(run("hidden", "<w:vanish/>"), run("shown")) + table([cell(par(run("a"))), cell(par(run("b")))])
    content = docx(body, footnotes=NOTE.format(par(run("note"))), header1=par(run("head")))
    out, report = wordxml.write(content, {"b0001": "Eins", "b0002": "sichtbar", "b0003": {"translated_text": "", "table_rows": [["A", "B"]]}})
    assert [b.text for b in blocks(out)] == ["Eins", "hiddensichtbar", "A\tB", "note", "head"]
    before, after = parts(content), parts(out)
    assert list(before) == list(after) and {n for n in before if before[n] != after[n]} == {"word/document.xml"}
    assert report["applied_unit_count"] == 3 and report["translatable_block_count"] == 5
    assert any("b0004" in w for w in report["warnings"])
    same, report = wordxml.write(content, {})
    assert parts(same) == before and report["files_modified"] == []


def test_docx_tokens_survive():
    link = '<w:hyperlink r:id="r4">' + run("there") + "</w:hyperlink>"
    raised = run("*", '<w:vertAlign w:val="superscript"/>')
    content = docx(par(run("go "), link, run(" now"), raised))
    text = "jetzt [[INLINE_0003]] geh [[INLINE_0001]]dorthin[[INLINE_0002]]"
    out, _ = wordxml.write(content, {"b0001": text})
    xml = parts(out)["word/document.xml"]
    assert xml.index("jetzt") < xml.index("superscript") < xml.index("hyperlink") and "dorthin" in xml and "there" not in xml
    assert blocks(out)[0].metadata["hyperlinks"][0]["text"] == "dorthin"
    out, _ = wordxml.write(content, {"b0001": "[[INLINE_0002]] falsch [[INLINE_0009]]"})
    assert blocks(out)[0].text.strip() == "falsch"


def test_docx_single_container_and_styles():
    link = '<w:hyperlink r:id="r4">' + run("there") + "</w:hyperlink>"
    out, _ = wordxml.write(docx(par(link)), {"b0001": "dort"})
    assert blocks(out)[0].metadata["hyperlinks"][0]["text"] == "dort"
    out, _ = wordxml.write(docx(par(run("a", "<w:b/>"), run(" "), run("c d", "<w:i/>"))), {"b0001": "eins zwei drei"})
    assert blocks(out)[0].text == "eins zwei drei" and "<w:b" in parts(out)["word/document.xml"]
    assert wordxml.shares("a b c d e".split(), 2) == ["a b", "c d e"]


def test_docx_table_shapes():
    content = docx(table([cell(par()), cell(par(run("b")))], [cell(par()), cell(par())]))
    out, report = wordxml.write(content, {"b0001": "B"})
    assert blocks(out)[0].metadata["rows"] == [["", "B"], ["", ""]]
    out, report = wordxml.write(content, {"b0001": "x\ty\tz\nq"})
    assert any("shape" in w for w in report["warnings"])
    contents = docx(table([cell(par(run("Contents"))), cell(par(run("One, 3; Two, 5; Three, 9; Four, 12")))]))
    out, _ = wordxml.write(contents, {"b0001": "Eins, 3; Zwei, 5"})
    assert blocks(out)[0].metadata["rows"] == [["Eins", "3"], ["Zwei", "5"]]


PAGE = """<html><head><title>x</title></head><body><h1>One &amp; two</h1><p>Text <b>bold</b>.<p>Second
<ul><li>a<li>b <ol><li>c</li></ol></ul><div hidden><p>seen</p></div><p hidden>no</p><p style="display: none">no</p>
<span epub:type="pagebreak" id="p1">7</span><aside class="footnote">note</aside><nav>skip</nav><pre>code</pre>
<table><tr><th>h</th><td colspan="2">1</td></tr></table><img src="i.png" alt="pic"/><blockquote><p>said</p></blockquote>
<p>* * *</p><h2></h2></body></html>"""


def test_html_blocks():
    found = markup.html_sites(PAGE)
    assert [(b.type, b.text) for b in found] == [
        ("heading", "One & two"), ("paragraph", "Text bold ."), ("paragraph", "Second"), ("list_item", "a"),
        ("list_item", "b c"), ("paragraph", "seen"), ("page_break", "7"), ("footnote", "note"), ("toc", "skip"), ("code", "code"),
        ("table", "h\t1"), ("image", ""), ("quote", "said"), ("special", "* * *"),
    ]
    assert found[3].metadata["list_type"] == "ul" and found[10].metadata["has_merged_cells"]
    assert [b.translate for b in found if b.type in ("toc", "code", "page_break", "image")] == [False] * 4
    assert markup.html_sites("") == [] and markup.html_sites("just text") == []


def test_epub_blocks_and_round_trip():
    content = epub({"a.xhtml": PAGE, "b.xhtml": "<p>Last <math><mi>x</mi></math></p><p><math><mi>y</mi></math></p>"}, nav="<nav epub:type='toc'>n</nav>")
    found = blocks(content, "epub")
    assert kinds(found)[:6] == [
        ("b0001", "metadata_title", "A title"), ("b0002", "metadata_creator", "Someone"), ("b0003", "metadata_language", "en"),
        ("b0004", "image", ""), ("b0005", "toc", "n"), ("b0006", "heading", "One & two"),
    ]
    ids = {b.text: b.block_id for b in found}
    out, report = markup.write_epub(
        content,
        {ids["A title"]: "Ein <Titel>", ids["One & two"]: "Eins & zwei", ids["Second"]: "Zweiter", ids["h\t1"]: {"table_rows": [["H", "2"]]},
         ids["Last x"]: "Letzter", "b9999": "nirgends"},
    )
    again = {b.block_id: b.text for b in blocks(out, "epub")}
    assert again[ids["A title"]] == "Ein <Titel>" and again[ids["One & two"]] == "Eins & zwei"
    assert again[ids["Second"]] == "Zweiter" and again[ids["h\t1"]] == "H\t2" and again[ids["Last x"]] == "Letzter x"
    assert "<b>bold</b>" in parts(out)["OEBPS/a.xhtml"] and "<math><mi>x</mi></math>" in parts(out)["OEBPS/b.xhtml"]
    assert any("b9999" in w for w in report["warnings"])
    same, _ = markup.write_epub(content, {})
    assert parts(same) == parts(content)


def test_files_with_spark(spark, tmp_path):
    stuff = {
        "a.txt": b"\xef\xbb\xbfOne.\n\nTwo\nlines.\n\n\n\nThree", "b.docx": docx(par(run("Hello"))),
        "c.EPUB": epub({"a.xhtml": "<p>Hi</p>"}), "d.html": b"<p>Page</p>", "e.pdf": b"%PDF", "f.docx": b"no zip",
        "g.txt": b"", "h.docx": zipped({"x": "y"}),
    }
    for name, data in stuff.items():
        (tmp_path / name).write_bytes(data)
    files = packages.files(spark, str(tmp_path)).cache()
    rows = packages.read_blocks(files).cache()
    texts = {(os.path.basename(r.path), r.block_id): r.text for r in rows.where("error is null").collect()}
    assert texts[("a.txt", "b0002")] == "Two\nlines." and texts[("a.txt", "b0003")] == "Three"
    assert texts[("b.docx", "b0001")] == "Hello" and texts[("d.html", "b0001")] == "Page"
    errors = {os.path.basename(r.path): r.error for r in rows.where("error is not null").collect()}
    assert set(errors) == {"e.pdf", "f.docx", "h.docx"} and errors["e.pdf"] == "unsupported format"
    given = rows.where("error is null and translatable").selectExpr(
        "document_id", "block_id", "concat('X ', text) as translated_text", "cast(null as array<array<string>>) as table_rows"
    )
    out = packages.exported(files.where("source_format <> 'html'"), given).cache()
    assert {os.path.basename(r.path) for r in out.where("error is not null").collect()} == {"f.docx", "h.docx"}
    target = str(tmp_path / "out")
    packages.save(out, target)
    written = packages.files(spark, target)
    texts = {r.text for r in packages.read_blocks(written).collect()}
    assert {"X Hello", "X Hi", "X Two\nlines.", "X Three"} <= texts
    assert packages.read_blocks(files.where("false")).count() == 0


def test_tables_of_a_database(spark):
    """Written and read over JDBC, in ranges of a key; appending adds."""
    from folioforge.sources import store

    url = "jdbc:derby:memory:folio;create=true"
    df = spark.createDataFrame([(i, f"d{i}", None if i == 3 else i * 2) for i in range(10)], "id int, document_id string, words int")
    store.to_database(df, url, "units", "app", "app", mode="overwrite")
    store.to_database(df.where("id < 2"), url, "units", "app", "app")
    rows = store.database(spark, url, "units", "app", "app", key="id", parts=3, low=0, high=10)
    assert rows.count() == 12 and rows.where("words is null").count() == 1
    assert rows.selectExpr("lower(document_id) d").distinct().count() == 10


def test_lines_of_json(spark, tmp_path):
    from folioforge.sources import store

    (tmp_path / "x.json").write_text('{"a": 1, "t": "2024-01-02T03:04:05.123456+00:00"}\n{broken\n\n{"a": null}\n')
    rows = store.import_json(spark, str(tmp_path / "x.json"), "a int, t timestamp")
    assert rows.count() == 3 and rows.where("broken is not null").count() == 1 and [r.a for r in rows.where("a is not null").collect()] == [1]
    assert rows.where("a = 1").first().t.microsecond == 123456 and rows.where("broken is null").count() == 2
