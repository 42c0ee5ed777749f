import unicodedata

from folioforge.llm.forms import look_table, visual_form, visual_forms

TEXTS = ["plain", "", " edge ", "​", "ＡＢ　c", "café", "café", "á̧", "á̧",
         "рау", "x y", "a­b", "ﬁn", "1‑40", "ộ", "ộ", "ộ", "가",
         "q̣́", "café́", "tab\tx"]


def test_spark_equals_plain(spark):
    df = spark.createDataFrame([(t,) for t in TEXTS] + [(None,)] + [(TEXTS[5],)], "text string")
    got = {r.text: r.form for r in visual_forms(df).collect()}
    assert got == {t: visual_form(t) for t in TEXTS}


def test_forms_meet_and_differ():
    assert visual_form("рау") == "pay" == visual_form("ｐａｙ")
    assert visual_form("café") == visual_form("café") == "café" != visual_form("cafe")
    assert visual_form("A") != visual_form("a")
    assert visual_form("á̧") == visual_form("á̧")
    assert visual_form("​x­ y") == "x y"
    assert visual_form("x²") != "x2"


def test_composed_like_unicode():
    for c in "Åéçñüộǖ":
        assert visual_form(unicodedata.normalize("NFD", c)) == c
    assert all(visual_form(v) == v.strip(" ") for v in list(look_table().values())[:3000] if v.isascii())


def test_texts_of_own_forms_are_fixed_points(spark):
    import random
    import re

    from folioforge.llm.forms import own_forms, plain

    allowed = re.compile("[" + re.sub(r"\\x\{([0-9a-f]+)\}", lambda m: re.escape(chr(int(m.group(1), 16))), own_forms()) + "]")
    chars = [chr(p) for p in range(0x20, 0x250) if allowed.fullmatch(chr(p))]
    assert {"a", "é", "ß", "ñ", "«", "Ł"} <= set(chars) and not {"\xa0", "\xad", "ı", "\u0301"} & set(chars)
    rng = random.Random(3)
    texts = ["".join(rng.choices(chars, k=rng.randint(1, 12))).strip(" ") for _ in range(500)]
    assert all(visual_form(t) == t for t in texts)
    df = spark.createDataFrame([(t,) for t in [*texts, "e\u0301", " a", "a\xa0b", ""]], "t string")
    assert [r.p for r in df.select(plain(df.t).alias("p")).collect()] == [True] * 500 + [False] * 3 + [True]
