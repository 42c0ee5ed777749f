"""Problem 3: one form for texts that look the same but differ in their characters.

Text is exploded to positioned code points. A broadcast join with the decomposition and look-alike
tables replaces each by what it looks like; combining marks are ordered by their class within their
cluster, clusters are recomposed by a second broadcast join, and the string is put together again.

The decompositions come from Unicode's own data by rule, the look-alike letters are a fixed list; both
have a fixed size. All steps after the explode share one hash partitioning by text, so code points are
shuffled once; a text is the largest unit that meets in a task. A text of nothing but characters that
are their own form (found by the same rules, a character at a time) is a fixed point of all this, as no
mark stands in it that could join another, and isn't exploded.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Letters of other scripts and the Latin letters they look like.
LOOK_ALIKES = {
    "cyrillic": "аa еe оo рp сc уy хx іi јj ѕs һh ԁd ԛq ԝw ѵv ӏl АA ВB ЕE КK МM НH ОO РP СC ТT ХX УY ІI ЈJ ЅS ԚQ ԜW ҮY ӀI",
    "greek": "οo αa νv ρp ιi ϲc ϳj υu ΑA ΒB ΕE ΖZ ΗH ΙI ΚK ΜM ΝN ΟO ΡP ΤT ΥY ΧX ϹC ͿJ",
    "armenian": "օo սu հh ցg ոn",
    "latin": "ıi ɡg ɑa ꞌ' ʼ' ’'",
}
#: Compatibility forms that look like what they stand for; superscripts, circled and squared forms and
#: fractions don't.
SAME_LOOK = ("<wide>", "<narrow>", "<noBreak>", "<font>", "<compat>", "<isolated>", "<initial>", "<medial>", "<final>")
HYPHENS = "‐‑‒−﹣－"


@lru_cache(1)
def look_table() -> dict[str, str]:
    """What each code point looks like, fully decomposed, where that isn't the code point itself."""
    alike = {pair[0]: pair[1] for pairs in LOOK_ALIKES.values() for pair in pairs.split()}
    table: dict[str, str] = {}

    def seen_as(c: str) -> str:
        if c in alike:
            return alike[c]
        point, kind = ord(c), unicodedata.category(c)
        if kind == "Cf" or point == 0x34F or 0xFE00 <= point < 0xFE10 or 0xE0100 <= point < 0xE01F0:
            return ""
        if kind == "Zs" or c in "\t\n\x0b\x0c\r\x85  ":
            return " "
        if c in HYPHENS:
            return "-"
        if 0xAC00 <= point < 0xD7A4:
            return c  # syllable blocks stay whole
        parts = unicodedata.decomposition(c).split()
        if not parts or parts[0][0] == "<" and parts[0] not in SAME_LOOK:
            return c
        points = [chr(int(p, 16)) for p in parts if p[0] != "<"]
        if parts[0][0] == "<" and points[0] == " ":
            return c  # a spacing accent
        return "".join(map(seen_as, points))

    for point in range(0x20000):
        if 0xD800 <= point < 0xE000 or point < 32 and chr(point) not in "\t\n\x0b\x0c\r":
            continue
        if (looks := seen_as(chr(point))) != chr(point):
            table[chr(point)] = looks
    for point in (*range(0xE0020, 0xE0080), *range(0xE0100, 0xE01F0)):
        table[chr(point)] = ""
    return table


@lru_cache(1)
def mark_classes() -> dict[str, int]:
    return {chr(p): c for p in range(0x20000) if (c := unicodedata.combining(chr(p)))}


@lru_cache(1)
def compositions() -> dict[str, str]:
    """Base and ordered marks -> the one character that stands for them."""
    out = {}
    for point in range(0x20000):
        c = chr(point)
        parts = unicodedata.normalize("NFD", c) if not 0xD800 <= point < 0xE000 else c
        if len(parts) > 1 and not 0xAC00 <= point < 0xD7A4 and unicodedata.normalize("NFC", c) == c:
            out[parts] = c
    return out


def visual_form(text: str) -> str:
    """The same form for one string, without Spark: the reference for tests."""
    looks, classes, composed = look_table(), mark_classes(), compositions()
    clusters: list[list[str]] = []
    for c in "".join(looks.get(c, c) for c in text):
        if clusters and classes.get(c, 0):
            clusters[-1].append(c)
        else:
            clusters.append([c])
    out = []
    for base, *marks in clusters:
        marks.sort(key=lambda m: classes[m])
        whole = "".join([base, *marks])
        pair = "".join([base, *marks[:1]])
        out.append(composed.get(whole) or (composed[pair] + "".join(marks[1:]) if pair in composed else whole))
    return "".join(out).strip(" ")


def _pairs(spark: SparkSession, pairs: dict, key: str, value: str, kind: str = "string") -> DataFrame:
    """A fixed table of a few thousand rows, for broadcast."""
    return F.broadcast(spark.createDataFrame(list(pairs.items()), f"{key} string, {value} {kind}"))


@lru_cache(1)
def own_forms() -> str:
    """Characters of the Latin blocks that are their own form and no marks, as the inside of a character class."""
    good = [p for p in range(0x20, 0x250) if not unicodedata.combining(chr(p)) and (p == 0x20 or visual_form(chr(p)) == chr(p))]
    runs: list[list[int]] = []
    for p in good:
        if runs and p == runs[-1][1] + 1:
            runs[-1][1] = p
        else:
            runs.append([p, p])
    return "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in runs)


def plain(text: Column) -> Column:
    return text.rlike(f"^(?! )[{own_forms()}]*(?<! )$")


def visual_forms(texts: DataFrame, text: str = "text") -> DataFrame:
    """Each distinct non-null text of the column with its ``form``.

    Empty texts and texts of invisible characters only have the empty form. Case and accents stay.
    """
    spark = texts.sparkSession
    distinct = texts.select(F.col(text).alias("text")).where("text is not null").distinct()
    ascii_only = distinct.where(plain(F.col("text"))).select("text", F.col("text").alias("form"))
    odd = distinct.where(~plain(F.col("text"))).select(
        "text", F.xxhash64("text").alias("k1"), F.xxhash64(F.reverse("text")).alias("k2")
    )
    keys = ["k1", "k2"]
    points = odd.select(*keys, F.posexplode(F.split("text", "")).alias("pos", "c"))
    points = points.join(_pairs(spark, look_table(), "c", "looks"), "c", "left")
    points = points.select(*keys, "pos", F.posexplode(F.split(F.coalesce("looks", "c"), "")).alias("sub", "c"))
    points = points.join(_pairs(spark, mark_classes(), "c", "class", "int"), "c", "left")
    order = Window.partitionBy(*keys).orderBy("pos", "sub")
    points = points.where("c <> ''").repartition(*keys).withColumn(
        "cluster", F.sum(F.when(F.col("class").isNull(), 1).otherwise(0)).over(order)
    )
    clusters = points.groupBy(*keys, "cluster").agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct(F.coalesce("class", F.lit(0)).alias("class"), "pos", "sub", "c"))),
            lambda x: x["c"],
        ).alias("cs")
    )
    clusters = clusters.select(
        *keys, "cluster", F.array_join("cs", "").alias("whole"), F.array_join(F.slice("cs", 1, 2), "").alias("pair"),
        F.array_join(F.slice("cs", 3, F.greatest(F.size("cs"), F.lit(2))), "").alias("rest"),
    )
    clusters = clusters.join(_pairs(spark, compositions(), "whole", "one"), "whole", "left")
    clusters = clusters.join(_pairs(spark, compositions(), "pair", "two"), "pair", "left")
    shown = F.coalesce("one", F.concat("two", "rest"), "whole")
    forms = clusters.groupBy(*keys).agg(
        F.trim(
            F.array_join(
                F.transform(F.array_sort(F.collect_list(F.struct("cluster", shown.alias("c")))), lambda x: x["c"]), ""
            )
        ).alias("form")
    )
    return ascii_only.unionByName(
        odd.join(forms, keys, "left").select("text", F.coalesce("form", F.lit("")).alias("form"))
    )
