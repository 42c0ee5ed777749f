import random

import numpy as np

from folioforge.llm.arrays import Words, folded
from folioforge.llm.leak import contained, shared_run, winnowed


def brute(a, b, least):
    best = 0
    for i in range(len(a)):
        for j in range(len(b)):
            n = 0
            while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n]:
                n += 1
            best = max(best, n)
    return best if best >= least else 0


def test_longest_shared_run():
    rng = random.Random(3)
    for _ in range(200):
        a = [rng.choice("abc") for _ in range(rng.randint(0, 30))]
        b = [rng.choice("abc") for _ in range(rng.randint(0, 30))]
        x, y = (np.array([ord(c) for c in t], np.uint64) for t in (a, b))
        assert shared_run(x, y, 4) == brute(a, b, 4)


def test_winnowing_guarantee():
    rng = random.Random(5)
    for _ in range(50):
        run = [f"w{rng.randrange(1000)}" for _ in range(12)]
        texts = [" ".join([*(f"x{rng.randrange(99)}" for _ in range(rng.randrange(20))), *run, "end", "of", str(i)]) for i in range(2)]
        words = Words(texts)
        row, _, h = winnowed(words, 7, 6)
        assert set(h[row == 0]) & set(h[row == 1])


def test_rows(spark):
    item = " ".join(f"word{i}" for i in range(30))
    docs = [
        (1, "before " + item.upper().replace(" ", ", ") + " after"),
        (2, " ".join(item.split()[:19])),
        (3, " ".join(item.split()[5:25]).replace("o", "o­")),
        (4, None),
        (5, ""),
        (1, "before " + item.upper().replace(" ", ", ") + " after"),
    ]
    corpus = spark.createDataFrame(docs, "doc_id long, text string")
    tests = spark.createDataFrame([(7, item), (8, None), (9, "short"), (7, item)], "item_id long, text string")
    for size in (1 << 20, 0):  # test texts broadcast, and joined by a shuffle
        got = {(r.doc_id, r.item_id, r.shared_words) for r in contained(corpus, tests, test_bytes=size).collect()}
        assert got == {(1, 7, 30), (3, 7, 20)}
        assert contained(corpus.where("false"), tests, test_bytes=size).count() == 0
        assert contained(corpus, tests.where("false"), test_bytes=size).count() == 0


def test_no_text_is_shuffled(spark):
    item = " ".join(f"word{i}" for i in range(30))
    corpus = spark.createDataFrame([(1, item)], "doc_id long, text string")
    tests = spark.createDataFrame([(7, item), (8, item)], "item_id long, text string")
    found = contained(corpus, tests)
    assert {(r.doc_id, r.item_id) for r in found.collect()} == {(1, 7), (1, 8)}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and plan.count("Aggregate") == 1


def test_repetitive_texts_take_no_longer():
    a, b = np.zeros(200_000, np.uint64), np.zeros(20_000, np.uint64)
    assert shared_run(a, b, 20) == 20_000


def test_folding():
    assert folded("ÉtÉ​") == "été"
