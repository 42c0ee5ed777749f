"""The queries of the training-data problems, over the tables of a data folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.registry import shipped
from ..session import file_state, written
from ..tables import table, unique_rows
from . import align, forms, langid, leak, packing, pairs, reading, split

DEFAULT_TARGET_WORDS = 600


def p1_pieces(spark: SparkSession, folder: str) -> DataFrame:
    """Every block and chunk above its document's target_words_per_section, cut into pieces.

    The filter on the number of words comes before the removal of repeated rows, so only the
    oversized texts are shuffled.
    """
    limits = unique_rows(
        table(spark, folder, "documents").select(
            "document_id", F.coalesce("target_words_per_section", F.lit(DEFAULT_TARGET_WORDS)).alias("limit_words")
        ),
        "document_id",
    )
    spec = table(spark, folder, "size_specs").where("spec_name = 'section_cut'").agg(F.max("overlap"))
    least = limits.agg(F.min("limit_words")).scalar()
    words = split.count_words(F.col("text"), split.WORD)
    records = []
    for kind, name, key in (("block", "blocks", "block_id"), ("chunk", "chunks", "chunk_id")):
        rows = table(spark, folder, name).select("document_id", F.col(key).alias("record_id"), "text")
        rows = rows.where(F.char_length("text") > 2 * least).where(words > least)
        records.append(unique_rows(rows, "document_id", "record_id").withColumn("record_kind", F.lit(kind)))
    rows = records[0].unionByName(records[1]).join(limits, "document_id").withColumn("overlap", spec.scalar())
    pieces = split.split_oversized(rows, "text", F.col("limit_words"), F.col("overlap"))
    starts, ends = F.col("starts_paragraph"), F.col("ends_paragraph")
    return pieces.select(
        "record_kind", "document_id", "record_id", "limit_words", "piece_no", "piece_count", "start", "end",
        F.col("units").alias("word_count"), F.col("overlap_units").alias("overlap_words"), "cut_at",
        (~(starts & ends)).alias("contains_partial_paragraph"), starts.alias("starts_paragraph"),
        (~starts).alias("continues_paragraph"), ends.alias("ends_paragraph"), "piece_text",
    )


def p1_rebuilt(spark: SparkSession, folder: str) -> DataFrame:
    """Every oversized record put together again from its pieces, each without its overlap.

    ``faults`` counts pieces above the limit, pieces that don't begin with the last words of the one before
    and flags that contradict each other.
    """
    pieces = p1_pieces(spark, folder)
    keys = ["record_kind", "document_id", "record_id"]
    before = Window.partitionBy(*keys).orderBy("piece_no")
    new = F.greatest(F.coalesce(F.lag("end").over(before), F.lit(0)) - F.col("start"), F.lit(0))
    words, n = F.regexp_extract_all("piece_text", F.lit(split.WORD), F.lit(0)), F.col("overlap_words")
    rows = pieces.withColumns({"new": F.substring("piece_text", new + 1, F.length("piece_text")), "ws": words})
    rows = rows.withColumn("ws_before", F.lag("ws").over(before))
    fault = (
        (F.col("word_count") > F.col("limit_words")) | (F.size("ws") != F.col("word_count"))
        | ((n > 0) & (F.slice("ws", F.lit(1), n) != F.slice("ws_before", F.greatest(F.size("ws_before") - n, F.lit(0)) + 1, n)))
        | (F.col("starts_paragraph") == F.col("continues_paragraph"))
        | (F.col("contains_partial_paragraph") == (F.col("starts_paragraph") & F.col("ends_paragraph")))
    )
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("piece_no", "new"))), lambda p: p["new"]), "")
    return rows.groupBy(*keys).agg(
        F.sum(F.col("word_count") - F.col("overlap_words")).alias("words"),
        F.sum(F.coalesce(fault, F.lit(False)).cast("int")).alias("faults"), F.md5(whole).alias("text_md5"),
    )


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """The records that the splitter had to cut."""
    return p1_pieces(spark, folder).where("piece_no = 1").select("record_kind", "document_id", "record_id")


def _translation_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """(document_id, block_id, target_lang, text, answer) of every block with an entry in translations_json.

    Bilingual deposits and tables are left out. The entries are taken apart where they lie; keys and
    texts of both sides are shuffled once, by document and block, so a large document is spread.
    """
    documents = table(spark, folder, "documents").where("translations_json is not null")
    documents = documents.where(~F.col("source").eqNullSafe("bilingual_deposit") & (F.length("translations_json") > 2))
    entries = unique_rows(
        documents.select(
            "document_id", "target_lang",
            F.explode(F.from_json("translations_json", "map<string,string>")).alias("block_id", "entry"),
        ),
        "document_id", "block_id",
    )
    nested = F.col("entry").startswith("{") & F.get_json_object("entry", "$").isNotNull()
    answer = F.when(nested, F.get_json_object("entry", "$.translated_text")).otherwise(F.col("entry"))
    blocks = unique_rows(
        table(spark, folder, "blocks")
        .where(~F.col("block_type").eqNullSafe("table"))
        .select("document_id", "block_id", "text"),
        "document_id", "block_id",
    )
    return entries.select("document_id", "block_id", "target_lang", answer.alias("answer")).join(
        blocks, ["document_id", "block_id"]
    )


def p2_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Every pair with all its defects (an empty array for a sound pair)."""
    rows = _translation_pairs(spark, folder)
    return pairs.defects(rows, "text", "answer", "target_lang", language_model(spark, folder))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """The defective pairs with the first of their defects, in the order of the rules."""
    return p2_pairs(spark, folder).where("size(defects) > 0").select(
        "document_id", "block_id", F.element_at("defects", 1).alias("defect")
    )


def p2_answers(spark: SparkSession, folder: str) -> DataFrame:
    """Every pair, whether its answer is empty, whether its text is long enough for the other rules, and the
    number of defects it should not have: unknown ones, repeated ones, any beside ``empty``."""
    d = F.col("defects")
    known = F.array(*map(F.lit, pairs.DEFECTS))
    words = _translation_pairs(spark, folder).select("document_id", "block_id", split.count_words(F.col("text")).alias("n"), "text")
    seen = F.length(F.regexp_replace(F.coalesce("text", F.lit("")), r"(?U)[\s\p{Cf}]", "")) > 0
    words = words.select("document_id", "block_id", ((F.col("n") >= pairs.MIN_WORDS) & seen).alias("long_enough"))
    empty = F.array_contains(d, "empty")
    unknown = F.size(F.array_except(d, known)) + F.size(d) - F.size(F.array_distinct(d)) + F.when(empty, F.size(d) - 1).otherwise(0)
    short = F.when(~F.col("long_enough") & ~empty, F.size(d)).otherwise(0)
    rows = p2_pairs(spark, folder).join(words, ["document_id", "block_id"])
    return rows.select("document_id", "block_id", empty.alias("empty"), "long_enough", (unknown + short).alias("unknown"))


def p3_forms(spark: SparkSession, folder: str) -> DataFrame:
    """Every term in source_terms and preferred_target with its visual form."""
    entries = unique_rows(
        table(spark, folder, "glossary").select("document_id", "entry_id", "source_terms", "preferred_target"),
        "document_id", "entry_id",
    )
    named = F.array(
        F.struct(F.lit("source_terms").alias("field_name"), F.col("source_terms").alias("terms")),
        F.struct(F.lit("preferred_target").alias("field_name"), F.array("preferred_target").alias("terms")),
    )
    terms = (
        entries.select("document_id", "entry_id", F.explode(named).alias("f"))
        .select("document_id", "entry_id", "f.field_name", F.explode("f.terms").alias("term"))
        .where("term is not null")
        .distinct()
    )
    return terms.join(forms.visual_forms(terms, "term").withColumnRenamed("text", "term"), "term").select(
        "document_id", "entry_id", "field_name", "term", "form"
    )


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """Entries of a document with terms of one form but different characters.

    Forms are made once and read from a table in the shared folder. Groups of exact copies are left
    out by an aggregate (partial before the shuffle) first; what is left joins on document, field and
    form.
    """
    terms = written(p3_forms(spark, folder).where("form <> ''"), "forms")
    keys = ["document_id", "field_name", "form"]
    differing = terms.groupBy(*keys).agg(F.min("term").alias("lo"), F.max("term").alias("hi")).where("lo <> hi")
    some = terms.join(differing.select(*keys), keys, "left_semi")
    a = some.select(*keys, F.col("entry_id").alias("entry_id_a"), F.col("term").alias("term_a"))
    b = some.select(*keys, F.col("entry_id").alias("entry_id_b"), F.col("term").alias("term_b"))
    return (
        a.join(b, keys)
        .where("entry_id_a < entry_id_b and term_a <> term_b")
        .select("document_id", "field_name", "entry_id_a", "entry_id_b")
        .distinct()
    )


BLOCK_WORDS = 8


def p3_classes(spark: SparkSession, folder: str) -> DataFrame:
    """The terms of a document and field that look alike, one row a form: spellings, entries and a representative.

    With p3_forms as membership this says all that pairs say, and a hot form stays one row.
    """
    rows = p3_forms(spark, folder).where("form <> ''").groupBy("document_id", "field_name", "form")
    return rows.agg(
        F.countDistinct("term").alias("spellings"), F.countDistinct("entry_id").alias("entries"), F.min("term").alias("representative")
    )


#: Where a session finds a model that ``langid.save`` wrote; else one is learned from the tables at hand.
MODEL_PATH = "spark.folioforge.language.model"
_MODELS: dict[tuple, langid.Model] = {}


def language_model(spark: SparkSession, folder: str) -> langid.Model:
    """The model of a session and folder: loaded if the session names one, else learned once from documents.

    It is learned again when the files of the table have changed.
    """
    if named := spark.conf.get(MODEL_PATH, None):
        return langid.load(spark, named)
    key = (spark.sparkContext.applicationId, folder, *file_state(spark, f"{folder}/documents.parquet"))
    if key not in _MODELS:
        _MODELS.clear()
        documents = table(spark, folder, "documents").select("document_id", "target_lang", "translations_json")
        _MODELS[key] = langid.train(documents)
    return _MODELS[key]


def _languages(spark: SparkSession, folder: str) -> DataFrame:
    """What p4_languages has, and for blocks ``mainly``, the language of more than half of their words.

    Texts are scored once and where they lie; what is shuffled afterwards are keys and codes. Documents'
    languages, which three parts need, go to a table in the shared folder. ``main_lang`` is the language of
    the document. A usage record takes it and its confidence over.
    """
    model = language_model(spark, folder)
    documents = table(spark, folder, "documents").select("document_id", F.col("lang").alias("label"), "text")
    documents = written(unique_rows(langid.languages(documents, "text", model), "document_id"), "languages")
    main = documents.select("document_id", F.col("lang").alias("main_lang"), F.col("confidence").alias("main_confidence"))
    usage = unique_rows(
        table(spark, folder, "usage_records").select("usage_id", "document_id", F.col("source_language").alias("label")),
        "usage_id",
    )
    blocks = table(spark, folder, "blocks").select("document_id", F.col("block_id").alias("record_id"), "text")
    blocks = blocks.where(F.char_length("text") >= 2 * BLOCK_WORDS - 1)
    blocks = blocks.where(split.count_words(F.col("text"), split.WORD) >= BLOCK_WORDS)
    blocks = unique_rows(langid.languages(blocks, "text", model), "document_id", "record_id")
    columns = ["record_kind", "document_id", "record_id", "label", "lang", "confidence", "main_lang", "mainly"]
    return (
        documents.select(
            F.lit("document").alias("record_kind"), "document_id", F.col("document_id").alias("record_id"), "label",
            "lang", "confidence", F.col("lang").alias("main_lang"), F.lit(None).cast("string").alias("mainly"),
        )
        .unionByName(
            usage.join(main, "document_id").select(
                F.lit("usage").alias("record_kind"), "document_id", F.col("usage_id").alias("record_id"), "label",
                F.col("main_lang").alias("lang"), F.col("main_confidence").alias("confidence"), "main_lang",
                F.lit(None).cast("string").alias("mainly"),
            )
        )
        .unionByName(
            blocks.join(main, "document_id").select(
                F.lit("block").alias("record_kind"), "document_id", "record_id",
                F.lit(None).cast("string").alias("label"), "lang", "confidence", "main_lang", "mainly",
            )
        )
        .select(*columns, langid.label_language(F.col("label")).alias("labelled"))
    )


def p4_languages(spark: SparkSession, folder: str) -> DataFrame:
    """The language of every document, usage record and block of eight words or more, with its label."""
    return _languages(spark, folder).drop("mainly")


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """Labels that are missing, void or wrong, and blocks mainly in another language than their document."""
    rows = _languages(spark, folder).where("lang is not null")
    is_block = F.col("record_kind") == "block"
    block = is_block & (F.col("mainly") != F.col("main_lang"))
    label = ~is_block & ~F.col("labelled").eqNullSafe(F.col("lang"))
    lang = F.when(is_block, F.col("mainly")).otherwise(F.col("lang")).alias("lang")
    return rows.where(block | label).select("record_kind", "document_id", "record_id", lang)


def p4_segments(spark: SparkSession, folder: str) -> DataFrame:
    """Each paragraph of each document with its language and confidence."""
    texts = table(spark, folder, "documents").select("document_id", "text")
    model = language_model(spark, folder)
    rows = langid.languages(texts, "text", model, by_paragraph=True)
    return unique_rows(rows.drop("second", "mainly"), "document_id", "segment_no")


def p4_labels(spark: SparkSession, folder: str) -> DataFrame:
    """What the label of every document and usage record names, and whether a language was told."""
    return p4_languages(spark, folder).select(
        "record_kind", "document_id", "record_id", "labelled", F.col("lang").isNotNull().alias("told")
    )


def p4_paragraphs(spark: SparkSession, folder: str) -> DataFrame:
    """The segments of every document with their words, and whether a language was told."""
    return p4_segments(spark, folder).select("document_id", "segment_no", "words", F.col("lang").isNotNull().alias("told"))


def p5_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of sentences of bilingual deposits that translate each other, with their cosine.

    A document is the unit of work; the filter on its source reaches the scan.
    """
    documents = table(spark, folder, "documents").select(
        "document_id", "source", "target_lang", "parsed_document_json", "translations_json"
    )
    deposits = documents.where("source = 'bilingual_deposit'")
    space = align.learned(documents, language_model(spark, folder), used=deposits)
    rows = align.aligned(deposits, space)
    return rows.groupBy(*[c for c in rows.columns if c != "cosine"]).agg(F.max("cosine").alias("cosine"))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return p5_pairs(spark, folder).drop("cosine")


def p5_sentences(spark: SparkSession, folder: str) -> DataFrame:
    """The sentences of every block on either side, and how many pairs name a sentence that isn't there."""
    documents = table(spark, folder, "documents").where("source = 'bilingual_deposit'")
    documents = unique_rows(documents.select("document_id", "parsed_document_json", "translations_json"), "document_id")
    counted = align.sentence_counts(documents)
    found = p5_found(spark, folder)
    ends = [
        found.groupBy("document_id", F.lit(side).alias("side"), F.col(f"{side}_block_id").alias("block_id")).agg(
            F.collect_list(f"{side}_sentence").alias("ns")
        )
        for side in ("source", "target")
    ]
    rows = counted.join(ends[0].unionByName(ends[1]), ["document_id", "side", "block_id"], "full")
    beyond = F.size(F.filter(F.coalesce("ns", F.array().cast("array<int>")), lambda n: (n > F.coalesce("sentences", F.lit(0))) | (n < 1)))
    return rows.select("document_id", "side", "block_id", "sentences", beyond.cast("bigint").alias("beyond"))


def p6_containers(spark: SparkSession, folder: str, vocabulary: str | None = None) -> DataFrame:
    """Where every document's text lies in the containers of each token capacity of size_specs.

    Texts are cut into tokens once; key and length go to a table in the shared folder, from which the
    histogram and the placement read.
    """
    return _containers(spark, folder, vocabulary, mix=True)


def p6_inside(spark: SparkSession, folder: str, vocabulary: str | None = None) -> DataFrame:
    """As p6_containers, but every batch is of one bucket alone; more space stays unused."""
    return _containers(spark, folder, vocabulary, mix=False)


def _containers(spark: SparkSession, folder: str, vocabulary: str | None, mix: bool) -> DataFrame:
    documents = table(spark, folder, "documents").select("doc_id", "text")
    counts = packing.token_counts(documents, "doc_id", "text", vocabulary or packing.vocabulary_path())
    counts = unique_rows(counts, "doc_id")
    specs = table(spark, folder, "size_specs").where("unit = 'tokens'").select("spec_name", "capacity")
    return packing.pack(written(counts, "token-counts"), specs, "doc_id", mix=mix)


def p6_checks(spark: SparkSession, folder: str) -> DataFrame:
    """For each capacity: documents placed, containers above it, pieces that don't follow each other, needless cuts."""
    rows = p6_containers(spark, folder)
    one = rows.groupBy("spec_name", "capacity", "container_id").agg(F.sum("tokens").alias("n"))
    one = one.groupBy("spec_name", "capacity").agg(F.count(F.when(F.col("n") > F.col("capacity"), 1)).alias("overfull"))
    by_document = rows.groupBy("spec_name", "capacity", "doc_id").agg(
        F.sum("tokens").alias("n"), F.max(F.col("token_start") + F.col("tokens")).alias("end"),
        F.count("*").alias("pieces"), F.max("piece_no").alias("last"),
    )
    gap = (F.col("n") != F.col("end")) | (F.col("pieces") != F.col("last"))
    needless = F.col("pieces") > F.ceil(F.col("n") / F.col("capacity"))
    checked = by_document.groupBy("spec_name", "capacity").agg(
        F.count("*").alias("documents"), F.count(F.when(gap, 1)).alias("gaps"), F.count(F.when(needless, 1)).alias("needless_cuts")
    )
    return checked.join(one, ["spec_name", "capacity"])


def p6_usage(spark: SparkSession, folder: str) -> DataFrame:
    """For each capacity the containers, their tokens, and the share of their space that is used."""
    rows = p6_containers(spark, folder).groupBy("spec_name", "capacity", "container_id").agg(F.sum("tokens").alias("n"))
    return rows.groupBy("spec_name", "capacity").agg(
        F.count("*").alias("containers"),
        F.sum("n").alias("tokens"),
        F.max("n").alias("fullest"),
        (F.sum("n") / (F.count("*") * F.first("capacity"))).alias("used_share"),
    )


def p7_leaks(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that hold 20 words or more in a row of a benchmark item, with the longest such run."""
    return leak.contained(
        table(spark, folder, "documents").select("doc_id", "text"),
        table(spark, folder, "benchmark").select("item_id", "text"),
    )


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    return p7_leaks(spark, folder).select("doc_id", "item_id")


BAND_WORDS = 50


def p8_levels(spark: SparkSession, folder: str) -> DataFrame:
    """The reading level and band of every document."""
    labels = table(spark, folder, "reading_labels").where("band is not null")
    labels = labels.select("doc_id", "labeller", "band").distinct()
    return reading.bands(
        table(spark, folder, "documents").select("doc_id", "text"),
        labels.groupBy("doc_id").agg(F.avg("band").alias("level")),
        language_model(spark, folder),
    )


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    """The band of each document of 50 words or more."""
    return p8_levels(spark, folder).where(F.col("words") >= BAND_WORDS).select("doc_id", "band")


def p8_due(spark: SparkSession, folder: str) -> DataFrame:
    """Every document with its words, whether it has a level and a band, and whether it is due a row of p8_found."""
    band = F.col("band").isin(1, 2, 3) & F.col("level").between(0, 4)
    due = (F.col("words") >= BAND_WORDS).alias("due")
    return p8_levels(spark, folder).select("doc_id", "words", F.coalesce(band, F.lit(False)).alias("levelled"), due)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    listed = [
        p1_found, p1_pieces, p1_rebuilt, p2_found, p2_pairs, p2_answers, p3_found, p3_forms, p3_classes, p4_found, p4_languages,
        p4_labels, p4_segments, p4_paragraphs, p5_found, p5_pairs, p5_sentences, p6_containers, p6_usage, p6_inside, p6_checks,
        p7_found, p7_leaks, p8_found, p8_levels, p8_due,
    ]
    return {f.__name__: shipped(f) for f in listed}
