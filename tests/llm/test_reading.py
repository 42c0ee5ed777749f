import random

import numpy as np
from test_langid import TEXTS, model

from folioforge.llm.reading import ITEMS, bands, drawn_labels, fit_items

WORDS = {1: "cat dog sun run big red".split(), 2: "market ticket report manager".split(), 3: "jurisprudence epistemic notwithstanding".split()}


def text(band, n, rng):
    kinds = [band] * 6 + [1, 2, 3]
    return " ".join("the and of to".split()[rng.randrange(4)] if rng.random() < 0.3 else rng.choice(WORDS[rng.choice(kinds)]) for _ in range(n))


def test_held_out_bands(spark):
    rng = random.Random(4)
    docs = [(i, text(i % 3 + 1, 80, rng)) for i in range(300)] + [(900, None), (901, ""), (902, "zzz")]
    documents = spark.createDataFrame(docs, "doc_id long, text string")
    labels = spark.createDataFrame([(i, float(i % 3 + 1)) for i in range(60)] + [(5000, 1.0)], "doc_id long, level double")
    got = {r.doc_id: r for r in bands(documents, labels, model()).collect()}
    assert len(got) == 303
    assert np.mean([got[i].band == i % 3 + 1 for i in range(60, 300)]) > 0.95
    assert got[900].band is None and got[901].level is None


def test_slopes_follow_levels():
    counts = np.zeros((ITEMS, 5))
    counts[0], counts[5], counts[10] = [50, 40, 30, 20, 10], [10, 20, 30, 40, 50], [30] * 5
    items = fit_items(counts)
    assert items.slope[0] < -0.3 < 0.3 < items.slope[5] and abs(items.slope[10]) < 0.05
    assert not items.known[1]


def test_language_without_labels_and_no_labels_at_all(spark):
    rng = random.Random(6)
    docs = [(i, text(i % 3 + 1, 80, rng)) for i in range(60)] + [(100 + i, TEXTS["pt"] * 3) for i in range(5)] + [(200, "- " * 60)]
    documents = spark.createDataFrame(docs, "doc_id long, text string")
    labels = spark.createDataFrame([(i, float(i % 3 + 1)) for i in range(60)], "doc_id long, level double")
    got = {r.doc_id: r for r in bands(documents, labels, model()).collect()}
    assert len(got) == 66 and all(r.band is not None for r in got.values())
    assert all(got[100 + i].level == 2.0 for i in range(5)) and got[200].level == 2.0
    none = bands(documents, labels.where("false"), model()).collect()
    assert len(none) == 66 and all((r.level, r.band) == (2.0, 2) for r in none)


def test_labels_are_drawn_by_language(spark):
    table = spark.createDataFrame([(i, int(i >= 3000)) for i in range(3010)], "doc_id long, lang int")
    labels = spark.createDataFrame([(i, 1.0) for i in range(3010)], "doc_id long, level double")
    got = [r.doc_id for r in drawn_labels(table, labels, "doc_id", 100).collect()]
    assert set(range(3000, 3010)) <= set(got) and 60 < len(got) < 160


def test_repeated_rows_weigh_once(spark):
    rng = random.Random(8)
    docs = [(i, text(i % 3 + 1, 60, rng)) for i in range(90)]
    labels = spark.createDataFrame([(i, float(i % 3 + 1)) for i in range(40)], "doc_id long, level double")
    once, often = (spark.createDataFrame(d, "doc_id long, text string") for d in (docs, docs + [docs[50]] * 60 + [docs[3]] * 30))
    a, b = ({r.doc_id: (r.words, r.level, r.band) for r in bands(d, labels, model()).collect()} for d in (once, often))
    assert a == b and len(a) == 90
