import random
import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from folioforge.llm.split import split_oversized, split_text

WORDS = st.lists(st.sampled_from(["a", "bb.", "ccc!", "\n", "\n\n", "\n\n\n", "é?", " ", "# t", " "]), max_size=60).map(" ".join)


def fresh(pieces, text):
    """The pieces without their overlaps."""
    out = ""
    for _, start, end, *_ in pieces:
        out += text[max(start, len(out)) : end]
    return out


@settings(max_examples=300, deadline=None)
@given(WORDS, st.integers(1, 9), st.integers(0, 12))
def test_pieces_fit_and_join(text, limit, overlap):
    pieces = split_text(text, limit, overlap)
    assert all(p[4] <= limit and len(p[6].split()) == p[4] for p in pieces) or len(pieces) == 1
    assert all(text[p[1] : p[2]] == p[6] for p in pieces)
    if len(pieces) > 1:
        head = text[: pieces[0][1]]
        assert head.strip() == "" or pieces[0][1] == 0
        assert fresh(pieces, text) == text
        want = min(overlap, limit - 1)
        for before, after in zip(pieces, pieces[1:]):
            assert after[3] == min(want, len(text[: before[2]].split()))
            assert before[6].split()[-after[3] :] == after[6].split()[: after[3]] or after[3] == 0
    starts, ends = paragraph_edges(text)
    for p in pieces if len(pieces) > 1 else []:
        first, last = len(text[: p[1]].split()), len(text[: p[2]].split())
        assert p[7] == (first in starts) and p[8] == (last in ends)


def paragraph_edges(text):
    """Numbers of the words that open a paragraph, and of words up to the end of one, by a plain way."""
    at, starts, ends = 0, {0}, set()
    for part in re.split(r"\n[ \t]*\n\s*|\f|\n(?=#{1,6} )", text):
        starts.add(at)
        at += len(part.split())
        ends.add(at)
    return starts, ends


def test_no_word_is_cut_that_fits():
    rng = random.Random(2)
    for _ in range(200):
        words = ["".join(rng.choice("abc.") for _ in range(rng.randint(1, 9))) for _ in range(rng.randint(1, 30))]
        text = rng.choice([" ", "\n", "  "]).join(words)
        limit = rng.randint(14, 25)  # room for the longest word beside the overlap
        for p in split_text(text, limit, rng.choice([0, 0, 3]), "chars"):
            assert p[4] <= limit
            if p[5] != "end":
                assert text[p[2] - 1].isspace() or p[5] == "sentence"


def test_natural_boundaries_first():
    text = "one two three. four five six.\n\nseven eight nine. ten"
    assert [p[5] for p in split_text(text, 6)] == ["paragraph", "end"]
    assert [p[6] for p in split_text("a b. c d e f", 4)] == ["a b. c d ", "e f"] or split_text("a b. c d e f", 4)[0][5] == "sentence"
    assert [p[7:] for p in split_text(text, 6)] == [(True, True), (True, True)]
    assert [p[7:] for p in split_text(text, 4)] == [(True, False), (False, True), (True, True)]
    assert [p[6] for p in split_text("abcdef", 2, 1, "chars")] == ["ab", "bc", "cd", "de", "ef"]


def test_long_text_is_linear():
    rng = random.Random(1)
    text = " ".join(rng.choice(["w", "w.", "w\n"]) for _ in range(200_000))
    assert sum(p[4] - p[3] for p in split_text(text, 100, 20)) == 200_000


def test_rows(spark):
    df = spark.createDataFrame(
        [(1, "a b c d e", "x"), (2, None, "x"), (3, "", "x"), (4, "a b", None), (1, "a b c d e", "x")],
        "id int, text string, piece_no string",
    )
    rows = split_oversized(df, "text", F.lit(2), F.lit(None)).orderBy("id", "piece_no").collect()
    assert [(r.id, r.piece_no, r.piece_text.strip(), r.piece_count) for r in rows] == [
        (1, 1, "a b", 3), (1, 1, "a b", 3), (1, 2, "c d", 3), (1, 2, "c d", 3), (1, 3, "e", 3), (1, 3, "e", 3),
    ]
    assert split_oversized(df.where("false"), "text", F.lit(2), F.lit(1)).count() == 0


def test_characters_are_cut_between_words_first():
    from folioforge.llm.split import split_text

    text = "alpha beta gamma delta epsilon " + "x" * 25
    pieces = split_text(text, 12, 0, "chars")
    assert [p[6] for p in pieces] == ["alpha beta ", "gamma delta ", "epsilon xxxx", "x" * 12, "x" * 9]
    assert "".join(p[6] for p in pieces) == text
    assert [p[5] for p in pieces[:2]] == ["word", "word"]
