import pytest
from test_langid import TEXTS, model

from folioforge.llm.pairs import Rules, defects, foreign_share, usual_lengths

EN = "On Monday Norbert bought 45 lamps for the library in Quarnheim. The dog waits under the table."
DE = "Am Montag kaufte Norbert 45 Lampen für die Bibliothek in Quarnheim. Der Hund wartet unter dem Tisch."


CASES = [
    (EN, DE, []),
    (EN, "", ["empty"]),
    (EN, " ​\n", ["empty"]),
    (EN, None, ["empty"]),
    ("Yes.", None, ["empty"]),
    ("", "", []),
    (None, None, []),
    (EN, "Es tut mir leid, ich kann diesen Text leider nicht übersetzen.", ["refusal"]),
    (EN, "I'm sorry, but I can’t translate this passage.", ["refusal"]),
    (EN, EN.upper(), ["copy"]),
    (EN, "  " + EN.replace("lamps", "chairs"), ["copy"]),
    (EN, DE[:70], ["truncated"]),
    (EN, DE[:80] + "...", ["truncated"]),
    (EN, TEXTS["fr"], ["other_language"]),
    ("Norbert, Quarnheim", "Norbert, Quarnheim", []),
    # the same in other scripts: Cyrillic, Han, Arabic, Greek, Devanagari
    (EN, "В понедельник Норберт купил 45 ламп для библиотеки. Собака ждёт под столом.", ["other_language"]),
    (EN, "星期一诺伯特为图书馆买了四十五盏灯。狗在桌子下面等着。", ["other_language"]),
    (EN, "اشترى نوربرت يوم الاثنين 45 مصباحا للمكتبة. الكلب ينتظر تحت الطاولة.", ["other_language"]),
    (EN, "Τη Δευτέρα ο Νόρμπερτ αγόρασε 45 λάμπες για τη βιβλιοθήκη. Ο σκύλος περιμένει.", ["other_language"]),
    (EN, "सोमवार को नॉर्बर्ट ने पुस्तकालय के लिए 45 दीपक खरीदे।", ["truncated", "other_language"]),
    # two and three defects at once
    (EN, EN[:88], ["copy", "truncated", "other_language"]),
    (EN, "I'm sorry, but I can't translate this passage for you because the dog waits under the", ["refusal", "truncated", "other_language"]),
    (EN, "В понедельник Норберт купил 45 ламп для...", ["truncated", "other_language"]),
]
EXACT = CASES[-9:]


def found_in(spark, rows):
    df = spark.createDataFrame(rows, "id int, text string, answer string, target string, extra string, empty string, defects string")
    return defects(df, "text", "answer", "target", model())


def test_rules(spark):
    rows = [(i, t, a, "de", "x", "y", "z") for i, (t, a, _) in enumerate(CASES)]
    rows += [(99, EN, DE, None, "x", "y", "z"), (98, EN, DE, None, "x", "y", "z"), (98, EN, DE, None, "x", "y", "z")]
    rows += [(100 + i, EN, DE, "de", "x", "y", "z") for i in range(60)]  # what is usual
    df = found_in(spark, rows)
    assert df.columns == ["id", "target", "extra", "defects"]
    got = {r.id: list(r.defects) for r in df.collect()}
    assert got[99] == got[98] == []
    for i, (text, answer, want) in enumerate(CASES):
        assert got[i] == want if (text, answer, want) in EXACT or not want else got[i][: len(want)] == want, (answer, got[i])
    assert found_in(spark, []).count() == 0 and df.count() == len(rows)


def test_text_about_a_refusal_and_text_in_the_wanted_language(spark):
    text = "Norbert answered Mathilda: I am sorry, I cannot translate this letter from Quarnheim."
    answer = "Norbert antwortete Mathilda: Es tut mir leid, ich kann diesen Brief aus Quarnheim nicht übersetzen."
    rows = [(1, text, answer, "de", "", "", ""), (2, TEXTS["de"], TEXTS["de"], "de", "", "", "")]
    assert [r.defects for r in found_in(spark, rows).collect()] == [[], []]


def test_answer_in_another_language_than_a_text_in_the_wanted_one(spark):
    rows = [(1, TEXTS["de"], TEXTS["fr"], "de", "", "", "")]
    assert "other_language" in found_in(spark, rows).first().defects


def test_scripts():
    assert foreign_share("Grüße, ½ ﬁn", "de") == 0 and foreign_share("Ａｌｌｅｓ ｇｕｔ", "de") == 0
    assert foreign_share("Привет мир", "de") == 1 and foreign_share("Привет мир", None) == foreign_share("12.3", "de") == 0


def test_usual_lengths_of_a_rare_direction_among_many(spark):
    rows = [("en", "de", 0.9)] * 12_000 + [("en", "pt", r) for r in (1.1, 1.3, 1.3, 1.3, 1.3, 1.6)]
    rows += [("en", "fr", 0.1)] * 4 + [(None, "pt", None), ("en", None, 1.0)]
    schema = "source string, target string, ratio double"
    ratio = {(r.source, r.target): r.usual for r in usual_lengths(spark.createDataFrame(rows, schema)).collect()}
    assert abs(ratio["en", "de"] - 0.9) < 0.01 and abs(ratio["en", "pt"] - 1.3) < 0.01 and len(ratio) == 2
    assert usual_lengths(spark.createDataFrame([], schema)).count() == 0


def test_flags_are_the_same_in_any_batch():
    rules, targets = Rules(model()), ["de"] * len(CASES)
    texts, answers = [t for t, _, _ in CASES], [a for _, a, _ in CASES]
    whole = rules.flags(texts, answers, targets)
    for i in range(len(CASES)):
        one = rules.flags(texts[i : i + 1], answers[i : i + 1], targets[i : i + 1])
        assert one.iloc[0].fillna(-1).tolist() == whole.iloc[i].fillna(-1).tolist()
