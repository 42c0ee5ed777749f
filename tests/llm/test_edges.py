"""Every operator with nulls in any column, empty and very long texts, ties, repeated rows, empty tables and clashing names."""

import random

import pytest
from pyspark.sql import functions as F
from test_langid import TEXTS, model

from folioforge.llm import align, forms, langid, leak, packing, pairs, reading, split

LONG_WORDS = 200_000
CLASHING = ["piece_no", "words", "lang", "defects", "form", "tokens", "level", "shared_words", "spec_name", "n", "k", "__target"]


def long_text(seed=1):
    rng = random.Random(seed)
    words = TEXTS["en"].split()
    return " ".join(rng.choice(words) + "." * (i % 17 == 0) for i in range(LONG_WORDS))


@pytest.fixture(scope="module")
def rows(spark):
    """Documents by key: sound, null, empty, blank, long and repeated ones; a third of all rows is one copy."""
    texts = {1: TEXTS["en"], 2: None, 3: "", 4: " \n\t ", 5: long_text(), 6: TEXTS["de"], 7: TEXTS["de"], 8: "​", 9: "12 34 !"}
    some = [(k, t) for k, t in texts.items()] + [(1, TEXTS["en"])] * 5 + [(None, TEXTS["fr"])]
    df = spark.createDataFrame(some, "doc_id long, text string")
    for name in CLASHING:
        df = df.withColumn(name, F.lit(None).cast("string"))
    return df.cache()


def test_pieces(rows):
    got = split.split_oversized(rows.withColumn("m", F.when(F.col("doc_id") == 6, None).otherwise(F.lit(15))), "text", F.col("m"), F.lit(5)).collect()
    assert {r.doc_id for r in got} == {1, 5, 7, None} and all(r.units <= 15 for r in got)
    assert sum(r.units - r.overlap_units for r in got if r.doc_id == 5) == LONG_WORDS
    assert split.split_oversized(rows.where("false"), "text", F.lit(3), F.lit(1)).count() == 0


def test_pairs(rows):
    df = rows.withColumns({"answer": F.when(F.col("doc_id") != 7, F.col("text")), "target": F.when(F.col("doc_id") != 6, F.lit("fr"))})
    got = {r.doc_id: r.defects for r in pairs.defects(df, "text", "answer", "target", model()).collect()}
    assert got[1] == ["copy", "other_language"] == got[5] and got[7] == ["empty"] and got[2] == got[3] == got[4] == got[8] == []
    # the source language alone decides what copied text is, where no target is named
    assert "copy" in got[6] and "other_language" not in got[6] and got[None] == ["empty"]
    assert pairs.defects(df.where("false"), "text", "answer", "target", model()).count() == 0


def test_forms(rows):
    got = {r.text: r.form for r in forms.visual_forms(rows.select("text", "form", "k", "n")).collect()}
    assert None not in got and got[""] == got["​"] == "" and got[" \n\t "] == forms.visual_form(" \n\t ") and len(got) == 8
    assert got[TEXTS["de"]] == forms.visual_form(TEXTS["de"])
    assert forms.visual_forms(rows.where("false").select("text")).count() == 0


def test_languages(rows):
    got = {r.doc_id: r for r in langid.languages(rows.select("doc_id", "text", "n", "k", "lang"), "text", model()).collect()}
    assert got[1].lang == got[5].lang == "en" and got[6].lang == "de" and got[None].lang == "fr"
    assert all(got[k].lang is None and got[k].confidence == 0 for k in (2, 3, 4, 8, 9)) and got[5].words == LONG_WORDS
    assert langid.languages(rows.where("false").select("doc_id", "text"), "text", model()).count() == 0
    parts = langid.languages(rows.select("doc_id", "text"), "text", model(), by_paragraph=True)
    assert parts.where("doc_id in (2, 3, 4)").count() == 0 and parts.where("doc_id = 5").count() == 1


def test_alignment_of_a_long_block():
    space = align.Space.of_pairs([], model())
    lines = [f"Nr. {i} {chr(65 + i % 26)}erolin{i % 1000} 4{i:05}." for i in range(900)]
    text = {"b": " ".join(lines) + " " + "word " * 20_000}
    got = {(r[1], r[3]) for r in align.align(text, text, "de", space)}
    assert len(got) > 890 and all(a == b for a, b in got)


def test_containers(spark, rows):
    counts = packing.token_counts(rows, "doc_id", "text", packing.vocabulary_path()).where("doc_id is not null").dropDuplicates(["doc_id"])
    specs = spark.createDataFrame([("s", 64), ("none", None), ("zero", 0), ("s", 64)], "spec_name string, capacity int")
    got = packing.pack(counts, specs, "doc_id").collect()
    used = {}
    for r in got:
        used[r.container_id] = used.get(r.container_id, 0) + r.tokens
    n = {r.doc_id: r.tokens for r in counts.collect()}
    assert max(used.values()) <= 64 and n[2] == n[3] == 0 and {r.doc_id for r in got} == {k for k, v in n.items() if v}
    assert sum(r.tokens for r in got if r.doc_id == 5) == n[5] > LONG_WORDS / 2
    assert packing.pack(counts.where("false"), specs, "doc_id").count() == 0


def test_leaks(spark, rows):
    passage = " ".join(long_text().split()[1000:1040])
    tests = spark.createDataFrame([(1, passage), (2, None), (3, ""), (4, long_text()), (1, passage)], "item_id long, text string").withColumn("doc", F.lit("x"))
    for size in (leak.TEST_BYTES, 0):
        got = {(r.doc_id, r.item_id): r.shared_words for r in leak.contained(rows, tests, test_bytes=size).collect()}
        assert got == {(5, 1): 40, (5, 4): LONG_WORDS}


def test_levels(spark, rows):
    labels = spark.createDataFrame([(1, 1.0), (6, 3.0), (99, 2.0)], "doc_id long, level double")
    got = {r.doc_id: r for r in reading.bands(rows, labels, model()).collect()}
    assert len(got) == 10 and all(got[k].band is None and got[k].level is None for k in (2, 3, 4))
    assert all(got[k].band in (1, 2, 3) for k in (1, 5, 6, 7)) and got[5].words == LONG_WORDS
    assert reading.bands(rows.where("false"), labels, model()).count() == 0
    alone = reading.bands(rows, labels.where("false"), model()).where("words > 0").select("band").distinct().collect()
    assert [r.band for r in alone] == [2]
