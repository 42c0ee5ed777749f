import numpy as np

from folioforge.llm.langid import LANGUAGES, fit, gram_sets, label_language, languages

TEXTS = {
    "de": "Der Hund schläft unter dem Tisch und wartet auf seine Freunde. Heute scheint die Sonne, und wir gehen in den Garten.",
    "en": "The dog sleeps under the table and waits for its friends. Today the sun shines, and we are going into the garden.",
    "es": "El perro duerme debajo de la mesa y espera a sus amigos. Hoy brilla el sol y nosotros vamos al jardín con los niños.",
    "fr": "Le chien dort sous la table et attend ses amis. Aujourd'hui le soleil brille et nous allons dans le jardin avec eux.",
    "pt": "O cão dorme debaixo da mesa e espera pelos seus amigos. Hoje o sol brilha e nós vamos para o jardim com as crianças.",
}


def model():
    pairs = [(s + ".", k) for k, t in TEXTS.items() for s in t.split(". ")]
    return fit([t for t, _ in pairs] * 4, [k for _, k in pairs] * 4)


def test_gram_sets_are_sets():
    row, bucket, n = gram_sets(["abab", "", "1 2", "Ab"])
    assert n[1] == n[2] == 0
    assert len(set(zip(row, bucket))) == len(row) == n.sum()


def test_held_out_sentences():
    m = model()
    asked = {"de": "Wir warten auf den Sommer", "en": "We are waiting for the summer", "es": "Esperamos el verano con los amigos",
             "fr": "Nous attendons les amis avec le soleil", "pt": "Esperamos pelo sol com os seus amigos"}
    got = np.argmax(m.probabilities(list(asked.values())), axis=1)
    assert [LANGUAGES[i] for i in got] == list(asked)


def test_rows(spark):
    rows = [(1, TEXTS["de"], "x"), (2, None, None), (3, "", "y"), (4, "1234 56", "z"), (5, TEXTS["fr"] + "\n\n" + TEXTS["en"] * 3, "w")]
    df = spark.createDataFrame(rows, "id int, text string, words string")
    got = {r.id: r for r in languages(df, "text", model()).collect()}
    assert (got[1].lang, got[5].lang) == ("de", "en")
    assert all(got[i].lang is None and got[i].confidence == 0 for i in (2, 3, 4))
    parts = languages(df.where("id = 5"), "text", model(), by_paragraph=True).orderBy("segment_no").collect()
    assert [p.lang for p in parts] == ["fr", "en"]
    assert languages(df.where("false"), "text", model()).count() == 0


def test_labels(spark):
    labels = {"EN": "en", "en-GB": "en", " Deutsch": "de", "fr_CA": "fr", "português": "pt", "spa": "es", "": None, "??": None,
              "nl": None, "und": None, None: None}
    df = spark.createDataFrame([(k, v) for k, v in labels.items()], "label string, want string")
    assert df.where(~label_language(df.label).eqNullSafe(df.want)).count() == 0


def test_very_long_text():
    from folioforge.llm.langid import language_shares

    text = TEXTS["fr"].replace(".", "") * 20_000
    shares = language_shares([text, "", "a"], model())
    assert LANGUAGES[int(np.argmax(shares[0]))] == "fr" and abs(shares[0].sum() - len(text.split())) < 300
    assert shares[1].sum() == 0


def test_language_of_more_than_half_of_the_words(spark):
    first = {k: t.split(". ")[0] + "." for k, t in TEXTS.items()}
    rows = [
        (1, f"{TEXTS['fr']} {first['de']}", "fr"),  # about two thirds
        (2, f"{first['fr']} {TEXTS['de']}", "de"),
        (3, f"{first['fr']} {first['de']} {first['en']}", None),  # a third each
        (4, "mesa | 466\ncabo | 410\nporta | 41\nnota | 5", None),  # bare nouns of several languages
        (5, None, None),
        (6, "12 | 13\n14 | 15", None),
    ]
    df = spark.createDataFrame(rows, "id int, text string, want string")
    got = {r.id: r for r in languages(df, "text", model()).collect()}
    assert all(got[i].mainly == want for i, _, want in rows)
    assert got[1].confidence < 0.75 and got[2].confidence < 0.75


def test_long_sentences_are_cut_between_words():
    from folioforge.llm import langid

    text = "word " * 30_000 + "x" * 50_000 + " end"
    parts = list(langid._pieces(text))
    assert "".join(parts) == text and max(map(len, parts)) <= langid.LONGEST_SENTENCE
    assert sum(len(p.split()) for p in parts) == 30_002 + 2  # the one word above the length is cut
    assert list(langid._pieces("a b")) == ["a b"] and list(langid._pieces("")) == []


def test_models_are_saved_and_loaded(spark, tmp_path):
    from folioforge.llm import langid

    m = model()
    langid.save(m, spark, str(tmp_path / "model"))
    again = langid.load(spark, str(tmp_path / "model"))
    assert np.allclose(m.scores(list(TEXTS.values())), again.scores(list(TEXTS.values()))) and again.sharpness == m.sharpness
