"""Glossary entries: cleaning, relevance for a text, and the fold that merges them."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from . import reconcile

PRIORITIES = ("low", "medium", "high")
_EDGES = X.TERM_EDGES


def unique_terms(terms: Column) -> Column:
    """Terms without those that equal an earlier one by key; blank ones are left out. Each key is made once."""
    keyed = F.transform(X.string_list(terms), lambda t: F.struct(X.term_key(t).alias("k"), t.alias("t")))
    none = F.array().cast("array<struct<k:string,t:string>>")

    def step(acc: Column, x: Column) -> Column:
        skip = (x["k"] == "") | F.exists(acc, lambda y: y["k"] == x["k"])
        return F.when(skip, acc).otherwise(F.array_append(acc, x))

    return F.aggregate(keyed, none, step, lambda acc: F.transform(acc, lambda x: x["t"]))


def sanitized(entries: DataFrame) -> DataFrame:
    """Entries with clean terms, a preferred target among the targets, and known values.

    Entries without a source or target term are left out.
    """
    priority = F.lower(X.strip(F.col("priority")))
    clean = F.struct(unique_terms(F.col("source_terms")).alias("s"), unique_terms(F.col("target_terms")).alias("t"))
    # a generator of one row: filters and later columns read its result, instead of making the lists once each
    rows = entries.select("*", F.explode(F.array(clean)).alias("__clean")).where("size(__clean.s) > 0 and size(__clean.t) > 0")
    rows = rows.withColumns({"source_terms": F.col("__clean.s"), "target_terms": F.col("__clean.t")}).drop("__clean")
    wanted = F.coalesce(F.nullif(X.strip(F.col("preferred_target")), F.lit("")), F.element_at("target_terms", 1))
    known = F.exists("target_terms", lambda t: X.term_key(t) == X.term_key(F.col("preferred_target")))
    return (
        rows.withColumn("preferred_target", wanted)
        .withColumn(
            "target_terms",
            F.when(known, F.col("target_terms")).otherwise(F.concat(F.array("preferred_target"), "target_terms")),
        )
        .withColumns(
            {
                "priority": F.when(priority.isin(*PRIORITIES), priority).otherwise("medium"),
                "category": F.coalesce(F.nullif(F.lower(X.strip(F.col("category"))), F.lit("")), F.lit("other")),
                "reason": F.coalesce(X.strip(F.col("reason")), F.lit("")),
            }
        )
    )


def appears(term: Column, text: Column) -> Column:
    """Whether a term stands in a text: any white space between its words, no regard to case, and no
    letter or digit beside an end of the term that is one itself."""

    def plain(x: Column) -> Column:
        return F.replace(F.replace(x, F.lit("\u00ad"), F.lit("")), F.lit("\u00a0"), F.lit(" "))

    clean = X.strip(plain(term))
    quoted = F.regexp_replace(clean, r"([\\\[\](){}.*+?^$|])", r"\\$1")
    body = F.regexp_replace(quoted, r"\s+", r"\\s+")
    before = F.when(clean.rlike(r"^(?U)[\p{L}\p{N}]"), r"(?<!\w)").otherwise("")
    after = F.when(clean.rlike(r"(?U)[\p{L}\p{N}]$"), r"(?!\w)").otherwise("")
    return (clean != "") & F.regexp_like(plain(text), F.concat(F.lit("(?iuU)"), before, body, after))


def token_keys(text: Column) -> Column:
    """Runs of letters and digits, each as all its spellings in either case have it."""
    plain = F.translate(F.replace(text, F.lit("\u00ad"), F.lit("")), "İı", "ii")
    return F.transform(F.regexp_extract_all(plain, F.lit(r"[\p{L}\p{N}]+"), F.lit(0)), X.casefold)


def relevant(entries: DataFrame, chunks: DataFrame) -> DataFrame:
    """Entries that matter for a chunk: of high priority, or with a source term in its text.

    A document's entries go to each of its chunks as one array; texts are shuffled once. A run of letters
    inside a term is a whole run of the text wherever the term appears, so only terms whose first run is
    among the text's, which an intersection of both tells, and those of signs only are searched for.
    """
    names = [c for c in entries.columns if c != "document_id"]
    terms = F.transform("source_terms", lambda t: F.struct(t.alias("term"), F.get(token_keys(t), 0).alias("run")))
    of_document = entries.select("document_id", F.struct(F.struct(*names).alias("entry"), terms.alias("terms")).alias("e"))
    of_document = of_document.groupBy("document_id").agg(F.collect_list("e").alias("es"))
    rows = chunks.select("document_id", "chunk_id", "text").join(of_document, "document_id")
    runs = F.flatten(F.transform("es", lambda e: F.transform(e["terms"], lambda t: t["run"])))
    rows = rows.withColumn("met", F.array_intersect(token_keys(F.col("text")), runs))
    rows = rows.select("document_id", "chunk_id", "text", "met", F.explode("es").alias("e"))

    def stands(t: Column) -> Column:
        near = t["run"].isNull() | F.array_contains("met", t["run"])
        return near & F.coalesce(appears(t["term"], F.col("text")), F.lit(False))

    rows = rows.where(F.coalesce(F.col("e.entry.priority") == "high", F.lit(False)) | F.exists("e.terms", stands))
    return rows.select("document_id", "chunk_id", "e.entry.*")


_RUN = re.compile(r"[^\W_]+")


def _plain(text: str) -> str:
    return text.replace("\u00ad", "").replace("\u00a0", " ")


def _key(term: str) -> str:
    return " ".join(_plain(term).split()).casefold().strip(_EDGES)


def term_list(value: object) -> list[str]:
    """A list's strings, or a string by itself, trimmed; terms that equal an earlier one by key are left out."""
    given = [value] if isinstance(value, str) else value if isinstance(value, list) else []
    unique: dict[str, str] = {}
    for term in given:
        if isinstance(term, str) and (key := _key(term)):
            unique.setdefault(key, term.strip())
    return list(unique.values())


def clean_entry(raw: object, chunk_id: str | None, ordinal: int = 0) -> dict | None:
    """An entry as a model gives it, with clean values; None without a source or a target term.

    Terms may stand as a list, as a string or under a name in the singular; unknown priorities are medium.
    """
    if not isinstance(raw, dict):
        return None
    found = {}
    for side in ("source", "target"):
        found[side] = term_list(raw.get(f"{side}_terms"))
        if not found[side] and isinstance(raw.get(f"{side}_term"), str):
            found[side] = term_list(raw[f"{side}_term"])
        if not found[side]:
            return None
    wanted = str(raw.get("preferred_target") or "").strip() or found["target"][0]
    if _key(wanted) not in map(_key, found["target"]):
        found["target"].insert(0, wanted)
    priority = str(raw.get("priority") or "").strip().lower()
    return {
        "chunk_id": chunk_id, "entry_ordinal": ordinal, "source_terms": found["source"], "target_terms": found["target"],
        "preferred_target": wanted, "category": str(raw.get("category") or "").strip().lower() or "other",
        "priority": priority if priority in PRIORITIES else "medium", "reason": str(raw.get("reason") or "").strip(),
    }


class Glossary:
    """A glossary that entries are folded into one after the other, each in time of its own terms.

    An entry joins the first one that shares a source term with it, else it is added. An index from term
    to the earliest entry that has it stands for the search.
    """

    def __init__(self, entries: Iterable[dict] = ()):
        self.entries: list[dict] = []
        self._first: dict[str, int] = {}
        self._have: list[dict[str, set[str]]] = []
        self._by_run: dict[str, list[tuple[int, str]]] = {}
        for entry in entries:
            self.add(entry)

    def add(self, entry: dict) -> None:
        keys = [_key(t) for t in entry["source_terms"]]
        at = min((self._first[k] for k in keys if k in self._first), default=None)
        if at is None:
            at = len(self.entries)
            self.entries.append(
                entry | {"entry_id": f"g{at + 1:04d}", "usage_count": 1, "first_seen_chunk_id": entry["chunk_id"],
                         "source_terms": [], "target_terms": []}
            )
            self._have.append({"source_terms": set(), "target_terms": set()})
        else:
            old = self.entries[at]
            old["priority"] = max(old["priority"], entry["priority"], key=PRIORITIES.index)
            if old["category"] == "other":
                old["category"] = entry["category"]
            old["reason"] = old["reason"] or entry["reason"]
            old["usage_count"] += 1
        for name, have in self._have[at].items():
            for term in entry[name]:
                if (key := _key(term)) not in have:
                    have.add(key)
                    self.entries[at][name].append(term)
                    if name == "source_terms":
                        runs = _RUN.findall(_plain(term))
                        self._by_run.setdefault(runs[0].lower() if runs else "", []).append((at, term))
        self.entries[at]["last_seen_chunk_id"] = entry["chunk_id"]
        for k in keys:
            self._first[k] = min(self._first.get(k, at), at)

    def for_text(self, text: str) -> list[dict]:
        """The entries that matter for a text, in order."""
        plain = _plain(text)
        runs = {"", *(r.lower() for r in _RUN.findall(plain))}
        near = {x for r in runs & self._by_run.keys() for x in self._by_run[r]}
        found = {at for at, term in near if _stands_in(term, plain)}
        found |= {at for at, e in enumerate(self.entries) if e["priority"] == "high"}
        return [self.entries[at] for at in sorted(found)]


def _stands_in(term: str, plain: str) -> bool:
    words = _plain(term).split()
    if not words:
        return False
    body = r"\s+".join(map(re.escape, words))
    before, after = (r"(?<!\w)" if words[0][0].isalnum() else ""), (r"(?!\w)" if words[-1][-1].isalnum() else "")
    return re.search(f"{before}{body}{after}", plain, re.I) is not None


def compact(entry: dict) -> dict:
    """An entry without its history, as a request has it."""
    return {k: entry[k] for k in ("source_terms", "target_terms", "preferred_target", "category", "priority", "reason")}


def merge_entries(entries: list[dict]) -> list[dict]:
    """Clean entries, in order, folded into a glossary; linear in their terms."""
    return Glossary(entries).entries


EXTRACTED = (
    "document_id string, chunk_id string, place int, source_terms array<string>, target_terms array<string>, "
    "preferred_target string, category string, priority string, reason string"
)


def extracted(answers: DataFrame) -> DataFrame:
    """The clean entries in answers(document_id, chunk_id, output), numbered by answer; texts without an object have none."""
    names = [part.split()[0] for part in EXTRACTED.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for document, chunk, output in zip(batch["document_id"], batch["chunk_id"], batch["output"]):
                given = (reconcile.embedded_object(output) or {}).get("glossary")
                clean = [e for raw in (given if isinstance(given, list) else []) if (e := clean_entry(raw, chunk)) is not None]
                out += [{**e, "document_id": document, "place": i} for i, e in enumerate(clean, 1)]
            yield pd.DataFrame(out, columns=names)

    return answers.select("document_id", "chunk_id", "output").mapInPandas(run, EXTRACTED)


MERGED = (
    "document_id string, entry_id string, source_terms array<string>, target_terms array<string>, "
    "preferred_target string, category string, priority string, usage_count int, reason string, "
    "first_seen_chunk_id string, last_seen_chunk_id string"
)


def merged(entries: DataFrame) -> DataFrame:
    """The glossary of each document from sanitized entries(document_id, chunk_id, entry_ordinal, ...).

    The fold depends on order within a document; documents are independent. A document's entries come
    as one sorted array, and many documents in one batch.
    """
    names = [part.split()[0] for part in MERGED.split(", ")]
    wanted = ["chunk_id", "entry_ordinal", "source_terms", "target_terms", "preferred_target", "category", "priority", "reason"]
    lists = ("source_terms", "target_terms")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for key, found in zip(batch["document_id"], batch["entries"]):
                rows = [{**dict(e), **{n: list(e[n]) for n in lists}} for e in found]
                out += [{**m, "document_id": key} for m in merge_entries(rows)]
            yield pd.DataFrame(out, columns=names)

    ordered = F.array_sort(F.collect_list(F.struct(*wanted))).alias("entries")
    return entries.groupBy("document_id").agg(ordered).mapInPandas(run, MERGED)
