"""Operators on small tables, against plain loops where there is an order to keep."""

import json
import random
import time

import numpy as np
from pyspark.sql import functions as F

from folioforge.functions import text as X
from folioforge.functions.estimates import tokens
from folioforge.functions.words import WORD, count_words
from folioforge.operators import activity, chunks, glossary, progress, reconcile, sections, tables, translations


def one(spark, expression, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)) if values else spark.range(1)
    return df.select(expression.alias("x")).first().x


def test_words(spark):
    spaces = "".join(c for c in map(chr, range(1, 0x3001)) if c.isspace())
    text = "".join(f"a{c}" for c in spaces)
    assert one(spark, count_words(F.col("t")), t=text) == len(text.split())
    assert one(spark, count_words(F.col("t"), WORD), t="a" + chr(0x200B) + "b" + chr(0x1C) + "c" + chr(0xA0) + "d") == 2
    assert one(spark, count_words(F.lit(None))) == 0


def test_text_functions(spark):
    assert one(spark, X.inline_text(F.col("t")), t="  a \t b \n c  ") == "a b\nc"
    assert one(spark, X.cell_text(F.col("t")), t=" a\n\nb;c ; 510³/l;") == "a; b; c; 5×10³/l"
    assert one(spark, X.preview(F.col("t"), 10), t="aaaa  bbbb cccc") == "aaaa bb..."
    assert one(spark, X.term_key(F.col("t")), t=" (The" + chr(0xA0) + "Te" + chr(0xAD) + "rm). ") == "the term"
    assert one(spark, X.raised(F.col("t")), t="m2+") == "m²⁺"
    assert one(spark, X.paragraphs(F.col("t")), t="a\r\nb\r\n\r\n  \n c \n") == ["a b", "c"]
    assert one(spark, X.paragraphs(F.lit(None).cast("string"))) == []
    assert one(spark, X.heading_level(F.col("t")), t="heading 3") == 3 and one(spark, X.heading_level(F.col("t")), t="x") is None
    assert one(spark, X.style_block_type(F.col("t")), t="TOC_1") == "toc_entry"
    assert one(spark, X.semantic_block_type(F.col("t"), "aside"), t="Rearnote") == "endnote"
    assert one(spark, X.has_contents_title(F.col("t")), t="INHALTS-VERZEICHNIS")
    assert [one(spark, X.is_scene_break(F.col("t")), t=t) for t in ("* * *", "--", "a*")] == [True, False, False]
    assert [one(spark, X.is_numeric(F.col("t")), t=t) for t in ("1,5 %", "1a")] == [True, False]
    assert one(spark, X.is_symbol_marker(F.col("t")), t=" † ") and not one(spark, X.is_symbol_marker(F.col("t")), t="é")
    assert one(spark, X.numbered("b", F.lit(12))) == "b0012" and one(spark, X.numbered("b", F.lit(12345))) == "b12345"
    assert one(spark, X.valid_id("doc_", X.stable_id("doc_", F.lit("x"))))


def test_tokens_round_half_to_even(spark):
    rows = spark.range(1, 3000).select("id", tokens(F.col("id")).alias("t")).collect()
    assert all(r.t == max(1, round(r.id * 1.35)) for r in rows)


def packed(sizes, target):
    out, words = [], 0
    for size in sizes:
        if not out or words and words + size > target:
            out.append(out[-1] + 1 if out else 1)
            words = size
        else:
            out.append(out[-1])
            words += size
    return out


def test_packing(spark):
    rng = random.Random(2)
    cases = [[rng.randrange(0, 90) for _ in range(rng.randrange(1, 30))] for _ in range(60)]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, sizes array<int>")
    got = {r.i: r for r in df.select("i", sections.packed(F.col("sizes"), F.lit(100)).alias("p"), sections.bulk_chunk_count(F.col("sizes"), F.lit(100)).alias("n")).collect()}
    assert all(got[i].p == packed(c, 100) for i, c in enumerate(cases))
    assert all(got[i].n == (max(packed([s for s in c if s], 100), default=0)) for i, c in enumerate(cases))


def test_packing_takes_time_in_proportion(spark):
    """Documents of 50,000 and 200,000 blocks; a fold that copies its array takes sixteen times as long."""

    def seconds(n):
        rows = spark.range(n).select(F.lit("d").alias("document_id"), (F.col("id") + 1).cast("int").alias("n"), F.lit(40).alias("words"))
        targets = spark.createDataFrame([("d", 600)], "document_id string, target int")
        began = time.perf_counter()
        assert sections.sectioned(rows, targets).agg(F.max("section")).first()[0] == -(-n // 15)
        return time.perf_counter() - began

    seconds(1000)
    assert seconds(200_000) < 8 * seconds(50_000) + 2
    began = time.perf_counter()
    assert chunks.chunk_numbers(np.full(400_000, 3), np.arange(400_000) % 50 == 7, 30).max() > 40_000
    assert time.perf_counter() - began < 5


def test_chunk_numbers():
    rng = random.Random(4)
    for _ in range(300):
        sizes = [rng.randrange(1, 30) for _ in range(rng.randrange(1, 25))]
        alone = [rng.random() < 0.2 for _ in sizes]
        want, words, shut = [], 0, True
        for size, single in zip(sizes, alone):
            opens = shut or single or words + size > 60
            want.append((want[-1] if want else 0) + opens)
            words, shut = (0 if opens else words) + size, single
        assert chunks.chunk_numbers(np.array(sizes), np.array(alone), 60).tolist() == want


def test_section_progress(spark):
    """Three sections of a block each: locked beyond the next, last one to be done again."""
    secs = spark.createDataFrame([("d", i, [f"b{i}"], 80) for i in (1, 2, 3)], "document_id string, section_index int, block_ids array<string>, word_count int")
    def actions(done):
        given = spark.createDataFrame([("d", f"b{i}") for i in done], "document_id string, block_id string")
        rows = progress.with_actions(progress.section_status(secs, given)).orderBy("section_index").collect()
        return [(r.shown_status, r.action) for r in rows]
    assert actions([1]) == [("translated", "retranslate_last"), ("not_translated", "translate_next"), ("locked", None)]
    assert actions([1, 2]) == [("translated", None), ("translated", "retranslate_last"), ("not_translated", "translate_next")]
    assert actions([]) == [("not_translated", "translate_next"), ("locked", None), ("locked", None)]
    assert actions([1, 2, 3])[2] == ("translated", "retranslate_last")
    left = progress.remaining(progress.section_status(secs, spark.createDataFrame([("d", "b2")], "document_id string, block_id string"))).first()
    assert (left.sections_left, left.words_left, left.chunks_left, left.blocks_left) == (2, 160, 1, 2)


def test_chunks(spark):
    docs = [
        ("a", "one two three\n\nfour five six seven"), ("b", "a b c. d e f. g h i."), ("c", "v w x y z"),
        ("d", None), ("e", " \n "), ("f", "a b\n\n" + "c d e f g h i j\n\nk"),
    ]
    df = spark.createDataFrame(docs, "document_id string, text string")

    def got(most):
        rows = chunks.chunked(df, most=most).orderBy("document_id", "chunk_index").collect()
        return [(r.document_id, r.chunk_id, r.text, ",".join(r.paragraph_ids), r.starts_paragraph, r.continues_paragraph, r.ends_paragraph, r.split_reason) for r in rows]

    assert got(7)[0] == ("a", "chunk_0001", "one two three\n\nfour five six seven", "p0001,p0002", True, False, True, None)
    assert [r[2] for r in got(6) if r[0] == "b"] == ["a b c. d e f.", "g h i."]
    assert [r[4:] for r in got(6) if r[0] == "b"] == [(True, False, False, "paragraph_too_long"), (False, True, True, "paragraph_too_long")]
    assert [r[2] for r in got(3) if r[0] == "c"] == ["v w x", "y z"]
    assert [r[2] for r in got(6) if r[0] == "f"] == ["a b", "c d e f g h", "i j", "k"]
    assert not [r for r in got(6) if r[0] in "de"]


def test_glossary(spark):
    raw = [
        ("d", "c1", "1", ["Big Box", "big  box."], ["Kiste"], " ", "TERM", "low", None),
        ("d", "c1", "2", ["cat"], ["Katze"], "Kater", None, "weird", "r"),
        ("d", "c2", "1", ["BIG BOX", "crate"], ["Kasten"], "Kasten", "x", "high", "why"),
        ("d", "c2", "2", [], ["leer"], None, None, None, None),
        ("d", "c3", "1", ["crate", "cat"], ["kiste"], None, None, None, None),
    ]
    df = spark.createDataFrame(raw, "document_id string, chunk_id string, entry_ordinal string, source_terms array<string>, target_terms array<string>, preferred_target string, category string, priority string, reason string")
    clean = glossary.sanitized(df)
    got = {(r.chunk_id, r.entry_ordinal): r for r in clean.collect()}
    assert len(got) == 4 and got["c1", "1"].source_terms == ["Big Box"] and got["c1", "1"].preferred_target == "Kiste"
    assert got["c1", "2"].target_terms == ["Kater", "Katze"] and got["c1", "2"].priority == "medium"
    rows = glossary.merged(clean).orderBy("entry_id").collect()
    assert [(r.entry_id, r.usage_count, r.priority, r.last_seen_chunk_id) for r in rows] == [("g0001", 3, "high", "c3"), ("g0002", 1, "medium", "c1")]
    assert rows[0].source_terms == ["Big Box", "crate", "cat"] and rows[0].category == "term" and rows[0].reason == "why"
    texts = spark.createDataFrame([("d", "c9", "A bigger cats' big\nbox" + chr(0xAD) + " here."), ("d", "c8", "nothing")], "document_id string, chunk_id string, text string")
    entries = clean.where("chunk_id = 'c1'").withColumn("entry_id", F.col("entry_ordinal")).select("document_id", "entry_id", "priority", "source_terms")
    assert [(r.chunk_id, r.entry_id) for r in glossary.relevant(entries, texts).collect()] == [("c9", "1")]
    assert one(spark, glossary.appears(F.lit("C++ (x)"), F.lit("see c++ (X)!"))) and not one(spark, glossary.appears(F.lit("caf"), F.lit("Café")))


BLOCKS = [{"block_id": "b1", "paragraph_id": "p1", "block_type": "paragraph", "source_text": "Hi [[INLINE_0001]]x"},
          {"block_id": "b2", "paragraph_id": "p2", "block_type": "table", "table_rows": [["a", "b"], ["c", "d"]]}]


def answer(*items):
    return json.dumps({"block_translations": list(items)})


def texts(found):
    return [(b["block_id"], b["translated_text"], b["origin"]) for b in found["block_translations"]]


def test_reconcile():
    good = [{"block_id": "b1", "translated_text": "Ja [[INLINE_0001]]x"}, {"block_id": "b2", "table_rows": [["A", "B"], ["C", "D"]]}]
    found = reconcile.reconcile("```json\n" + answer(*good) + "\n```", BLOCKS)
    assert texts(found) == [("b1", "Ja [[INLINE_0001]]x", "answer"), ("b2", "A\tB\nC\tD", "answer")]
    assert found["translated_text"] == "Ja [[INLINE_0001]]x\n\nA\tB\nC\tD" and found["notes"] == []
    bad = [{"block_id": "b1", "translated_text": "Ja"}, {"block_id": "b2", "table_rows": [["A"]]}, {"block_id": "zz", "translated_text": "?"}]
    found = reconcile.reconcile(answer(*bad), BLOCKS)
    assert texts(found) == [("b1", "Hi [[INLINE_0001]]x", "source")] and any("zz" in n for n in found["notes"])
    earlier = {"b1": "Alt [[INLINE_0001]]", "b2": {"table_rows": [["1", "2"], ["3", "4"]]}}
    assert texts(reconcile.reconcile(answer(*bad), BLOCKS, earlier)) == [("b1", "Alt [[INLINE_0001]]", "earlier"), ("b2", "1\t2\n3\t4", "earlier")]
    found = reconcile.reconcile("Eins [[INLINE_0001]]\n\na\tb\nc\td", BLOCKS)
    assert texts(found) == [("b1", "Eins [[INLINE_0001]]", "place"), ("b2", "a\tb\nc\td", "place")]
    assert texts(reconcile.reconcile("", BLOCKS)) == [] and reconcile.reconcile(None, [])["block_translations"] == []
    layout = [{"block_id": "b1", "block_type": "table", "table_role": "toc_layout", "table_rows": [["x"]]}]
    assert texts(reconcile.reconcile(answer({"block_id": "b1", "table_rows": [["One", "2"], ["Two"]]}), layout)) == [("b1", "One\t2\nTwo", "answer")]
    assert reconcile.embedded_object('so: {"a": {"b": 1}} end') == {"a": {"b": 1}} and reconcile.embedded_object("none") is None


def test_reconcile_with_spark(spark):
    df = spark.createDataFrame([("d", "c", answer({"block_id": "b1", "translated_text": "Ja [[INLINE_0001]]x"}), json.dumps(BLOCKS), None), ("d", "e", None, None, None)],
                               "document_id string, chunk_id string, output string, expected_json string, earlier_json string")
    rows = {r.chunk_id: r for r in reconcile.reconciled(df).collect()}
    assert rows["c"].block_translations[0].origin == "answer" and rows["e"].block_translations == []
    assert reconcile.reconciled(df.where("false")).count() == 0


def test_translations(spark):
    docs = spark.createDataFrame([("d", '{"b1": " x ", "b2": {"translated_text": "t", "table_rows": [["1"]]}, "b3": null}'), ("e", None), ("f", "{}"), ("g", "oops")], "document_id string, translations_json string")
    rows = {r.block_id: r for r in translations.entries(docs).collect() if r.block_id}
    assert rows["b1"].translated_text == "x" and rows["b2"].table_rows == [["1"]] and rows["b3"].translated_text == ""
    parts = spark.createDataFrame(
        [("d", "b", 1, 0, "one ", None), ("d", "b", 2, 0, " two", None), ("d", "t", 1, 0, "x", None), ("d", "t", 2, 0, "a\tb", [["a", "b"]]), ("d", "u", 1, 0, "r", [["r"]]), ("d", "u", 2, 0, "more", None), ("d", "v", 1, 0, " ", None)],
        f"document_id string, block_id string, chunk_index int, part int, translated_text string, table_rows {translations.ROWS}")
    got = {r.block_id: (r.translated_text, r.table_rows) for r in translations.collected(parts).collect()}
    assert got == {"b": ("one two", None), "t": ("a\tb", [["a", "b"]]), "u": ("r more", None)}
    pieces = spark.createDataFrame([("d", 1, "c1", "A", True, False), ("d", 2, "c2", "b", False, True), ("d", 3, "c3", "C", True, False), ("d", 4, "c4", " ", True, False)],
                                   "document_id string, chunk_index int, chunk_id string, translated_text string, starts_paragraph boolean, continues_paragraph boolean")
    assert translations.reconstructed(pieces).first().text == "A b\n\nC"
    assert one(spark, translations.matches_shape(F.lit("a\tb\r\n\r\nc"), F.array(F.lit(2), F.lit(1))))
    assert one(spark, translations.inline_tokens(F.lit("x [[INLINE_0002]] [[INLINE_0001]] [[INLINE_0002]]"))) == ["[[INLINE_0002]]", "[[INLINE_0001]]"]


def test_table_functions(spark):
    rows = tables.rows_of(F.col("t"))
    assert one(spark, rows, t="a | 1\n\n b|2 ") == [["a", "1"], ["b", "2"]]
    assert one(spark, tables.numeric_ratio(rows), t="a | 1\n\n b|2 ") == 0.5
    zero = F.lit(0)
    role = tables.role(rows, zero, zero, zero, zero)
    assert one(spark, role["table_role"], t="Contents | One, 3; Two, 5; Three, 9; Four, 12") == "toc_layout"
    assert one(spark, role["table_role"], t="a | 1\nb | 2") == "data"


def test_activity(spark):
    jobs = spark.createDataFrame([("j", "running", 10, "2024-01-01 00:00:01"), ("j", "succeeded", 100, "2024-01-01 00:00:01"), ("j", "queued", 0, None), ("k", None, None, None)],
                                 "job_id string, status string, progress int, updated_at string").withColumn("message", F.lit(None))
    jobs = jobs.withColumn("updated_at", F.to_timestamp("updated_at"))
    assert {r.job_id: r.status for r in activity.current_jobs(jobs).collect()} == {"j": "succeeded", "k": None}
    ledger = spark.createDataFrame([("a", 1)], "key string, n int")
    new = spark.createDataFrame([("a", 2), ("b", 3), ("b", 4)], "key string, n int")
    assert [r.key for r in activity.appended(ledger, new, "key").collect()] == ["b"]
    page = activity.page(spark.range(10), [F.desc("id")], 2, 3).collect()
    assert [r.id for r in page] == [7, 6, 5]


def test_checks(spark):
    from folioforge.functions import checks

    messages = {"Request timed out": True, "503 unavailable": True, "429: quota exceeded": False, "bad": False, None: False,
                "503 upstream: 401 authentication": False, "getaddrinfo failed": True, "Please try again": True, "overloaded": False,
                "model not found, try again": False}
    df = spark.createDataFrame([(k, v) for k, v in messages.items()], "m string, want boolean")
    assert df.where(checks.retryable(F.col("m")) != F.col("want")).count() == 0
    assert df.where(checks.retryable(F.lit("temporarily gone, not found"), checks.BATCH)).count() == 0
    assert checks.passes(TimeoutError()) and checks.passes(ValueError("Server disconnected")) and not checks.passes(ValueError("503 Not found"))
    assert not checks.passes(ValueError("Server disconnected"), checks.SERVICE)
    assert one(spark, checks.same_language(F.lit(" STRASSE"), F.lit("Straße ")))
    assert one(spark, checks.short_message(F.col("t"), 8), t="a  b\nc def g") == "a b c..."
    assert one(spark, checks.json_or(F.col("t"), "array<int>", F.array(F.lit(7))), t="[1]") == [1]
    assert one(spark, checks.json_or(F.col("t"), "array<int>", F.array(F.lit(7))), t=" ") == [7]


def test_translation_in_order(spark):
    from folioforge.plans import translate

    seen = spark.createDataFrame(
        [("d", f"c{i}", i, "de", json.dumps([{"block_id": f"b{i}", "source_text": f"text {i}"}]), f"text {i}") for i in range(5)],
        "document_id string, chunk_id string, chunk_index int, target_language string, expected_json string, text string",
    )

    def answerer(request):
        block = request["blocks"][0]
        if block["block_id"] == "b3":
            raise RuntimeError("down")
        before = "|".join(c["translated_text"] for c in request["context"])
        return json.dumps({"block_translations": [{"block_id": block["block_id"], "translated_text": f"{block['source_text']} ({before})"}],
                           "glossary": [{"source_terms": [block["source_text"]], "target_terms": ["x"]}]})

    rows = translate.in_order(seen, answerer, context=1).orderBy("chunk_index").collect()
    assert [r.translated_text for r in rows] == ["text 0 ()", "text 1 (text 0 ())", "text 2 (text 1 (text 0 ()))", "text 3", "text 4 (text 3)"]
    assert [r.glossary_size for r in rows] == [0, 1, 2, 3, 3]


def test_case_folding(spark):
    texts = ["Straße", "STRASSE", "ẞ", "ΟΔΟΣ οδος", "ﬁ ﬂ ſ", "İ ı I", "µ K Å", "ŉ ǰ", "Ǆ ǅ ǆ", None, ""]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r.x for r in df.select(X.casefold(F.col("t")).alias("x")).collect()] == [t and t.casefold() if t is not None else None for t in texts]
    assert one(spark, X.term_key(F.lit("Große STRASSE."))) == glossary._key("grosse straße")


def test_glossary_of_a_model_as_it_comes():
    raw = [{"source_terms": "harbour", "target_terms": ["Hafen"], "priority": "urgent"}, {"source_term": " Harbour ", "target_term": "Port", "priority": "HIGH"},
           {"source_terms": [1, "  ", "quay"], "target_terms": ["Kai", "KAI"], "preferred_target": "Mole", "category": None}, {"source_terms": ["x"]}, "no", None,
           {"source_terms": ["y"], "target_terms": "!!"}]
    clean = [glossary.clean_entry(e, "c1", i) for i, e in enumerate(raw)]
    assert [c and (c["source_terms"], c["target_terms"], c["preferred_target"], c["priority"], c["category"]) for c in clean] == [
        (["harbour"], ["Hafen"], "Hafen", "medium", "other"), (["Harbour"], ["Port"], "Port", "high", "other"),
        (["quay"], ["Mole", "Kai"], "Mole", "medium", "other"), None, None, None, None,
    ]
    merged = glossary.merge_entries([c for c in clean if c])
    assert [(m["entry_id"], m["source_terms"], m["target_terms"], m["priority"], m["usage_count"]) for m in merged] == [
        ("g0001", ["harbour"], ["Hafen", "Port"], "high", 2), ("g0002", ["quay"], ["Mole", "Kai"], "medium", 1),
    ]


def test_terms_for_a_text_are_those_that_stand_in_it(spark):
    rng = random.Random(7)
    words = ["ab", "Ab", "a-b", "b", "(b)", "c++", "+", "é", "ß", "x_y", "_y", "İz"]
    entries = [glossary.clean_entry({"source_terms": [" ".join(rng.choices(words, k=rng.randint(1, 2))) + f" {i}" * (i % 3 == 0)], "target_terms": ["t"], "priority": "high" if i == 5 else "low"}, "c", i) for i in range(40)]
    terms = glossary.Glossary(e for e in entries if e)
    texts = [rng.choice([" ", "\n", ", "]).join(rng.choices(words, k=12)) + " 3 6" for _ in range(20)] + ["", "+"]
    rows = [("d", e["entry_id"], e["priority"], e["source_terms"]) for e in terms.entries]
    df = spark.createDataFrame(rows, "document_id string, entry_id string, priority string, source_terms array<string>")
    chunks_df = spark.createDataFrame([("d", str(i), t) for i, t in enumerate(texts)] + [("d", "none", None), ("e", "0", "ab")], "document_id string, chunk_id string, text string")
    got = {(r.chunk_id, r.entry_id) for r in glossary.relevant(df, chunks_df).collect()}
    plain = {(str(i), e["entry_id"]) for i, t in enumerate(texts) for e in terms.entries if e["priority"] == "high" or any(glossary._stands_in(x, glossary._plain(t)) for x in e["source_terms"])}
    assert {g for g in got if g[0] != "none"} == plain and ("none", next(e["entry_id"] for e in terms.entries if e["priority"] == "high")) in got
    assert {(str(i), e["entry_id"]) for i, t in enumerate(texts) for e in terms.for_text(t)} == plain
    assert glossary.relevant(df.where("false"), chunks_df).count() == 0


def test_retries():
    from folioforge.plans import translate

    waits, calls = [], []

    def failing(request):
        calls.append(request)
        if len(calls) < 3:
            raise ConnectionError("Connection reset by peer")
        return "done"

    assert translate.with_retries(failing, 2, 0.5, 0, sleep=waits.append)({}) == "done" and waits == [0.5, 1.0]
    for message, tries in (("401 unauthorized", 1), ("rate limit", 3)):
        calls.clear()

        def broken(request):
            calls.append(request)
            raise ValueError(message)

        try:
            translate.with_retries(broken, 2, 0, 5)({})
        except ValueError as error:
            assert str(error) == message and len(calls) == tries
    slow = translate.with_retries(lambda r: time.sleep(2) or "late", 0, 0, 0.05)
    try:
        slow({})
        raise AssertionError("no timeout")
    except TimeoutError:
        pass


def test_first_pass_review_and_revision(spark):
    from folioforge.plans import translate

    seen = spark.createDataFrame(
        [(d, f"c{i}", i, "de", json.dumps([{"block_id": f"b{i}", "source_text": f"text {i} [[INLINE_0001]]"}]), f"text {i}", [f"p{i}"]) for d in "de" for i in range(3)],
        "document_id string, chunk_id string, chunk_index int, target_language string, expected_json string, text string, paragraph_ids array<string>",
    )

    def answerer(request):
        block = request["blocks"][0]
        told = request["context"][-1]["paragraph_ids"] if request["context"] else None
        if "feedback" not in request:
            out = "first " + block["source_text"] + f" after {told}"
        elif block["block_id"] == "b1":
            raise RuntimeError("model gone")
        else:
            out = "better " + (block["source_text"] if block["block_id"] == "b0" else "without its token")
        return json.dumps({"block_translations": [{"block_id": block["block_id"], "translated_text": out}]})

    first = translate.in_order(seen, answerer).cache()
    assert first.where("chunk_id = 'c1'").first().translated_text == "first text 1 [[INLINE_0001]] after ['p0']"

    def reviewer(request):
        if "text 0" not in request["prompt"]:
            raise RuntimeError("nothing to review")
        return "Use better words."

    remarks = translate.reviewed(first, seen, reviewer)
    assert [(r.feedback, r.error) for r in remarks.collect()] == [("Use better words.", None)] * 2
    only_d = remarks.where("document_id = 'd'")
    rows = {(r.document_id, r.chunk_id): r for r in translate.revised(seen, first, only_d, answerer).collect()}
    assert rows["d", "c0"].translated_text == "better text 0 [[INLINE_0001]]" and rows["d", "c0"].revision_error is None
    assert rows["d", "c1"].translated_text == rows["d", "c1"].first_text and rows["d", "c1"].revision_error == "RuntimeError: model gone"
    assert rows["d", "c2"].translated_text == rows["d", "c2"].first_text  # it lost its token
    assert all(rows["e", f"c{i}"].translated_text == rows["e", f"c{i}"].first_text for i in range(3))
    status = {r.document_id: (r.status, r.failed_chunks) for r in translate.revision_status(translate.revised(seen, first, only_d, answerer)).collect()}
    assert status == {"d": ("completed_with_errors", 1), "e": ("completed", 0)}
    answers = translate.answered(seen.where("document_id = 'd'"), lambda r: 1 / 0).collect()
    assert [(a.error, a.block_translations) for a in answers] == [("ZeroDivisionError: division by zero", [])] * 3


def test_order_survives_what_models_give(spark):
    from folioforge.plans import translate

    seen = spark.createDataFrame([("d", f"c{i}", i, "de", '[{"block_id": "b", "source_text": "The harbour"}]', "The harbour") for i in range(3)],
                                 "document_id string, chunk_id string, chunk_index int, target_language string, expected_json string, text string")
    given = {"glossary": [{"source_terms": ["Harbour"], "target_terms": ["Hafen"], "priority": "urgent"}, {"source_term": "harbour", "target_terms": "Port", "priority": 3}, 5]}
    sizes = [r.glossary_size for r in translate.in_order(seen, lambda r: json.dumps(given)).orderBy("chunk_index").collect()]
    assert sizes == [0, 1, 1]
    for bad in ("[]", "null", "no", '{"glossary": "x"}', '{"glossary": {"a": 1}}'):
        assert translate.in_order(seen, lambda r: bad).count() == 3


def test_repeated_rows_count_once_wherever_they_lie(spark):
    from folioforge import tables as T

    df = spark.createDataFrame([(i % 50 if i < 60 else 7, f"t{i % 50 if i < 60 else 7}") for i in range(200)] + [(None, "n"), (None, "n")], "k long, t string")
    want = sorted((r.k if r.k is not None else -1, r.t) for r in T.unique_rows(df, "k").collect())
    once = df.where("k between 20 and 30")
    assert T.unique_in_place(once, "k") is once
    for size in (1 << 20, 0):
        T.KEY_BYTES, before = size, T.KEY_BYTES
        got = sorted((r.k if r.k is not None else -1, r.t) for r in T.unique_in_place(df, "k").collect())
        T.KEY_BYTES = before
        assert got == want and len(got) == 51


def test_settings():
    import pytest

    from folioforge.functions import settings as S

    env = {"A": " 7 ", "B": "x", "C": "2.5", "D": "Yes", "E": " ", "F": "-3"}
    assert (S.whole(env, "A", 1), S.whole(env, "B", 1), S.whole(env, "Z", 4), S.whole(env, "F", 1, 1)) == (7, 1, 4, 1)
    assert (S.number(env, "C", 1.0), S.number(env, "B", 1.5)) == (2.5, 1.5)
    assert (S.flag(env, "D"), S.flag(env, "E", True), S.flag(env, "B"), S.flag(env, "Z")) == (True, True, False, False)
    both = {"GOOGLE_API_KEY": "g", "NVIDIA_API_KEY": "n", "NVIDIA_BASE_URL": "https://example.org", "GEMINI_MODEL": "gemini/some"}
    assert S.model(both) == S.Model("gemini", "gemini/some", "g", None)
    assert S.model(both, "nvidia/other") == S.Model("nvidia", "nvidia/other", "n", "https://example.org")
    assert S.model(both | {"MODEL_PROVIDER": "NIM"}, usual={"nvidia": "nvidia/usual"}).name == "nvidia/usual"
    for bad in ({}, {"MODEL_PROVIDER": "other", "GOOGLE_API_KEY": "g"}):
        with pytest.raises(ValueError):
            S.model(bad)


def test_pages_are_held_within_bounds(spark):
    rows = spark.createDataFrame([("d", i, f"b{i}") for i in range(250)] + [("e", 0, "x")], "document_id string, block_index int, block_id string")
    page = {r.document_id: r for r in translations.page(rows, -5, 1000).groupBy("document_id").agg(
        F.count("*").alias("n"), F.max("page_count").alias("pages"), F.max("has_next").alias("more"), F.max("has_previous").alias("before")).collect()}
    assert (page["d"].n, page["d"].pages, page["d"].more, page["d"].before) == (100, 3, True, False) and page["e"].n == 1
    assert translations.page(rows, 240, 0).count() == 1 and translations.page(rows, 300).count() == 0
    assert translations.page(rows).where("document_id = 'd'").count() == 40


def test_only_scans_are_spread(spark, data):
    from folioforge import tables as T

    scan = T.table(spark, data, "documents").select("doc_id")
    many = T.spread(scan)
    assert many.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism and many.count() == scan.count()
    shuffled = scan.groupBy("doc_id").count()
    wide = spark.range(0, 100, 1, 64)
    assert T.spread(shuffled) is shuffled and T.spread(wide) is wide


def test_tables_of_the_shared_folder_are_removed(spark):
    import os

    from folioforge import session

    df = session.written(spark.range(5), "some")
    path = df.inputFiles()[0].removeprefix("file://")
    assert df.count() == 5 and os.path.exists(path)
    assert session.remove_written(spark) >= 1 and not os.path.exists(path) and session.remove_written(spark) == 0
    first = session.file_state(spark, os.path.dirname(os.path.abspath(__file__)))
    assert first[0] > 0 and first == session.file_state(spark, os.path.dirname(os.path.abspath(__file__)))


def test_jobs_by_key_and_changes(spark):
    jobs = spark.createDataFrame(
        [("j1", "d", "t", '{"a": "1", "b": "2"}', "k", 1, "x", 5), ("j2", "d", "t", '{"a": "9"}', "k", 2, "y", 6), ("j3", "d", "t", None, " ", 3, None, 7)],
        "job_id string, document_id string, job_type string, payload_json string, k string, created int, message string, progress int",
    ).withColumn("created_at", F.timestamp_seconds("created")).withColumn("updated_at", F.timestamp_seconds("created"))
    asked = spark.createDataFrame(
        [("d", "t", "k", '{"a":"9"}'), ("d", "t", "k ", '{"a":"8"}'), ("d", "t", " ", '{"a":"9"}'), ("d", "t", None, None), ("e", "t", "k", "{}"), ("d", "t", "zz", "oops")],
        "document_id string, job_type string, key string, payload_json string",
    )
    got = [(r.key, r.document_id, r.job_id, r.answer) for r in activity.replayed(jobs, asked, F.col("k")).collect()]
    assert sorted(got, key=str) == sorted([("k", "d", "j2", "replay"), ("k ", "d", "j2", "conflict"), (" ", "d", None, "new"), (None, "d", None, "new"), ("k", "e", None, "new"), ("zz", "d", None, "new")], key=str)
    changes = spark.createDataFrame([("j1", 9, "late", None), ("j1", 4, "early", 50), ("j3", 1, None, 90), ("gone", 1, "x", 1)], "job_id string, t int, message string, progress int")
    changes = changes.select("job_id", F.timestamp_seconds("t").alias("changed_at"), "message", "progress")
    rows = {r.job_id: (r.message, r.progress, r.updated_at.second) for r in activity.changed(jobs, changes).collect()}
    assert rows == {"j1": ("late", 5, 9), "j2": ("y", 6, 2), "j3": (None, 90, 3)}
    swept = activity.interrupted(spark.createDataFrame([("queued", "translate_rest"), ("running", "export"), (None, None)], "status string, job_type string").withColumns({"progress": F.lit(3), "message": F.lit("m"), "error_text": F.lit(None).cast("string")}))
    assert [(r.status, r.progress, r.interrupted) for r in swept.collect()] == [("failed", 100, True), ("running", 3, False), (None, 3, False)]


def test_owners_exports_and_second_parses(spark):
    rows = spark.createDataFrame([("d1", "u", "g"), ("d2", "v", "g"), ("d3", None, None)], "document_id string, owner_user_id string, owner_auth_provider string")
    assert [r.document_id for r in activity.owned(rows, "u").collect()] == ["d1"] and activity.owned(rows, "u", "h").count() == 0
    asked = spark.createDataFrame([("d1", "u"), ("d2", "u"), ("d3", None), ("gone", "u")], "document_id string, owner_user_id string")
    assert {r.document_id: r.allowed for r in activity.authorized(asked, rows).collect()} == {"d1": True, "d2": False, "d3": False, "gone": False}
    records = spark.createDataFrame([("d", "e1", 5), ("d", "e3", 9), ("d", "e2", 9), ("x", "e0", None)], "document_id string, export_id string, exported_at int")
    assert {r.document_id: r.export_id for r in activity.latest_exports(records).collect()} == {"d": "e3", "x": "e0"}
    blocks = spark.createDataFrame([("d", 1, "b1", "table"), ("d", 2, "b2", "paragraph"), ("d", 3, "b3", "table"), ("e", 1, "b1", None)], "document_id string, n int, block_id string, block_type string")
    units = spark.createDataFrame([("d", 1, "table", "m"), ("d", 2, "table", "m"), ("f", 1, "text", "m"), ("e", 1, "text", "k")], "document_id string, n int, kind string, about string")
    found = tables.enriched(blocks, units)
    assert {(r.document_id, r.n): (r.status, r.about) for r in found.collect()} == {
        ("d", 1): ("matched", "m"), ("d", 2): ("mismatched", None), ("d", 3): ("missing", None), ("e", 1): ("matched", "k"), ("f", 1): ("unused", None),
    }
    reports = {r.document_id: (r.units, r.matched_units, r.unused_units, r.mismatches, r.status) for r in tables.enrichment_reports(found).collect()}
    assert reports == {"d": (2, 1, 0, 2, "partial"), "e": (1, 1, 0, 0, "ok"), "f": (1, 0, 1, 0, "partial")}
