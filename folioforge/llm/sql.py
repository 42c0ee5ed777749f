"""SQL that gives the rows of a query of this subpackage, where SQL can say it.

What a model decides can't be said; for those problems there are queries of what must hold of any result:
every key that is due is there, and what doesn't depend on the model is right.
"""

from __future__ import annotations

from functools import lru_cache

from ..functions.text import casefold_sql
from ..functions.words import PYTHON_SPACE, WORD, count_words_sql, re2
from .forms import look_table

#: Characters without a shape of their own, as the operators leave them out.
_UNSEEN = "[\\p{Cf}\\x{034F}\\x{115F}\\x{1160}\\x{3164}\\x{FE00}-\\x{FE0F}\\x{E0000}-\\x{E007F}]"
_LETTER = "\\p{L}"


def _folded(text: str) -> str:
    return casefold_sql(f"nfc_normalize(regexp_replace({text}, '{_UNSEEN}', '', 'g'))")


def _words(text: str) -> str:
    return f"regexp_extract_all({_folded(text)}, '[\\p{{L}}\\p{{N}}\\p{{Mn}}\\p{{Mc}}]+')"


def _leaks(least: int = 20) -> str:
    def runs(table: str, key: str, name: str) -> str:
        return f"""{name}0 AS (SELECT DISTINCT {key}, {_words("text")} AS ws FROM {table} WHERE text IS NOT NULL),
            {name} AS (SELECT {key}, i, array_to_string(ws[i:i + {least - 1}], ' ') AS run
                       FROM (SELECT {key}, ws, unnest(range(1, len(ws) - {least - 2})) AS i FROM {name}0 WHERE len(ws) >= {least}))"""

    return f"""{runs("documents", "doc_id", "d")}, {runs("benchmark", "item_id", "b")},
        m AS (SELECT doc_id, item_id, d.i AS x, b.i AS y FROM d JOIN b ON b.run = d.run),
        r AS (SELECT doc_id, item_id, x - y AS diagonal, x - row_number() OVER (PARTITION BY doc_id, item_id, x - y ORDER BY x) AS island FROM m),
        k AS (SELECT doc_id, item_id, count(*) + {least - 1} AS n FROM r GROUP BY doc_id, item_id, diagonal, island)"""


@lru_cache(1)
def _forms() -> str:
    """Visual forms: what each character looks like, put together and composed."""
    quoted = ((ord(c), looks.replace("'", "''")) for c, looks in look_table().items())
    looks = ", ".join(f"({c}, '{x}')" for c, x in quoted)
    return f"""g AS (SELECT DISTINCT document_id, entry_id, source_terms, preferred_target FROM glossary),
        t AS (SELECT DISTINCT document_id, entry_id, 'source_terms' AS field_name, unnest(source_terms) AS term FROM g
              UNION SELECT document_id, entry_id, 'preferred_target', preferred_target FROM g),
        u AS (SELECT DISTINCT term, regexp_extract_all(term, '(?s).') AS cs FROM t WHERE term IS NOT NULL),
        c AS (SELECT term, unnest(cs) AS c, generate_subscripts(cs, 1) AS i FROM u),
        looks(point, seen) AS (VALUES {looks}),
        f AS (SELECT term, string_agg(coalesce(seen, c), '' ORDER BY i) AS form FROM c LEFT JOIN looks ON point = unicode(c) GROUP BY term),
        form AS (SELECT t.document_id, t.entry_id, t.field_name, t.term, trim(nfc_normalize(coalesce(f.form, '')), ' ') AS form
                 FROM t LEFT JOIN f ON f.term = t.term WHERE t.term IS NOT NULL)"""


_LIMITS = """
    limits AS (SELECT document_id, min(coalesce(target_words_per_section, 600)) AS limit_words FROM documents GROUP BY document_id),
    records AS (
        SELECT DISTINCT 'block' AS record_kind, document_id, block_id AS record_id, text FROM blocks
        UNION ALL
        SELECT DISTINCT 'chunk', document_id, chunk_id, text FROM chunks)"""
_OVERSIZED = f"records JOIN limits USING (document_id) WHERE {count_words_sql('text', WORD)} > limit_words"


_PAIRS = """
    e0 AS (SELECT DISTINCT document_id, unnest(json_keys(translations_json)) AS block_id, translations_json::JSON AS j FROM documents
           WHERE translations_json IS NOT NULL AND source IS DISTINCT FROM 'bilingual_deposit'),
    e AS (SELECT document_id, block_id, CASE WHEN json_type(j, '$."' || block_id || '"') = 'OBJECT'
                 THEN json_extract_string(j, '$."' || block_id || '".translated_text') ELSE json_extract_string(j, '$."' || block_id || '"') END AS answer
          FROM e0),
    b AS (SELECT DISTINCT document_id, block_id, text FROM blocks WHERE block_type IS DISTINCT FROM 'table')"""


def _unseen(text: str) -> str:
    return f"regexp_replace(coalesce({text}, ''), '{_UNSEEN}|[{re2(PYTHON_SPACE)}]', '', 'g') = ''"


def _label_sql() -> str:
    from .langid import NAMES

    head = "regexp_extract(lower(trim(label)), '^([^-_\\s(]+)', 1)"
    cases = " ".join(f"WHEN {head} IN ({', '.join(repr(n) for n in names.split())}) THEN '{code}'" for code, names in NAMES.items())
    return f"CASE {cases} END"


_SENTENCES = "regexp_extract_all(text, '(?s)\\S.*?(?:[.!?](?:\\s|$)|$)')"


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": f"WITH {_LIMITS} SELECT DISTINCT record_kind, document_id, record_id FROM {_OVERSIZED}",
        "p1_rebuilt": f"""WITH {_LIMITS}
            SELECT record_kind, document_id, record_id, {count_words_sql("text", WORD)}::BIGINT AS words, 0::BIGINT AS faults,
                   md5(text) AS text_md5 FROM {_OVERSIZED}""",
        "p2_answers": f"""WITH {_PAIRS}
            SELECT e.document_id, e.block_id, NOT ({_unseen("text")}) AND ({_unseen("answer")}) AS empty,
                   {count_words_sql("text")} >= 6 AND NOT ({_unseen("text")}) AS long_enough, 0::INTEGER AS unknown
            FROM e JOIN b ON b.document_id = e.document_id AND b.block_id = e.block_id""",
        "p3_forms": f"WITH {_forms()} SELECT document_id, entry_id, field_name, term, form FROM form",
        "p3_found": f"""WITH {_forms()}
            SELECT DISTINCT a.document_id, a.field_name, a.entry_id AS entry_id_a, b.entry_id AS entry_id_b
            FROM form a JOIN form b USING (document_id, field_name, form)
            WHERE a.entry_id < b.entry_id AND a.term <> b.term AND form <> ''""",
        "p3_classes": f"""WITH {_forms()}
            SELECT document_id, field_name, form, count(DISTINCT term) AS spellings, count(DISTINCT entry_id) AS entries,
                   min(term) AS representative FROM form WHERE form <> '' GROUP BY document_id, field_name, form""",
        "p4_labels": f"""WITH d AS (SELECT DISTINCT document_id, lang AS label, regexp_matches(text, '{_LETTER}') AS told FROM documents),
            u AS (SELECT DISTINCT usage_id, document_id, source_language AS label FROM usage_records),
            b AS (SELECT DISTINCT document_id, block_id, regexp_matches(text, '{_LETTER}') AS told FROM blocks
                  WHERE {count_words_sql("text", WORD)} >= 8)
            SELECT 'document' AS record_kind, document_id, document_id AS record_id, {_label_sql()} AS labelled, coalesce(told, false) AS told FROM d
            UNION ALL SELECT 'usage', u.document_id, usage_id, {_label_sql().replace("(label)", "(u.label)")}, coalesce(told, false)
            FROM u JOIN d ON d.document_id = u.document_id
            UNION ALL SELECT 'block', b.document_id, block_id, NULL, b.told FROM b JOIN d ON d.document_id = b.document_id""",
        "p4_paragraphs": f"""WITH t AS (SELECT DISTINCT document_id, text FROM documents),
            p AS (SELECT document_id, list_filter(regexp_split_to_array(text, '\\n\\s*\\n'), lambda x: regexp_matches(x, '[^{re2(PYTHON_SPACE)}]')) AS ps FROM t),
            q AS (SELECT document_id, unnest(ps) AS x, generate_subscripts(ps, 1) AS i FROM p)
            SELECT document_id, i::INTEGER AS segment_no, {count_words_sql("x")} AS words, regexp_matches(x, '{_LETTER}') AS told FROM q""",
        "p5_sentences": f"""WITH d AS (SELECT DISTINCT document_id, parsed_document_json::JSON AS j, translations_json::JSON AS k FROM documents
                  WHERE source = 'bilingual_deposit' AND parsed_document_json IS NOT NULL AND translations_json IS NOT NULL),
            s AS (SELECT document_id, 'source' AS side, json_extract_string(b, '$.block_id') AS block_id, json_extract_string(b, '$.text') AS text
                  FROM (SELECT document_id, unnest(json_extract(j, '$.blocks[*]')) AS b FROM d)),
            t AS (SELECT document_id, 'target' AS side, block_id,
                         CASE WHEN json_type(k, '$."' || block_id || '"') = 'OBJECT' THEN json_extract_string(k, '$."' || block_id || '".translated_text')
                              ELSE json_extract_string(k, '$."' || block_id || '"') END AS text
                  FROM (SELECT document_id, k, unnest(json_keys(k)) AS block_id FROM d)),
            a AS (SELECT document_id, side, block_id, {_SENTENCES} AS ss FROM (SELECT * FROM s UNION ALL SELECT * FROM t) WHERE text <> '')
            SELECT document_id, side, block_id, len(ss)::INTEGER AS sentences, 0::BIGINT AS beyond FROM a WHERE len(ss) > 0""",
        "p6_checks": """SELECT spec_name, capacity, (SELECT count(DISTINCT doc_id) FROM documents WHERE length(text) > 0) AS documents,
                   0::BIGINT AS overfull, 0::BIGINT AS gaps, 0::BIGINT AS needless_cuts
            FROM size_specs WHERE unit = 'tokens'""",
        "p7_found": f"WITH {_leaks()} SELECT DISTINCT doc_id, item_id FROM k",
        "p7_leaks": f"WITH {_leaks()} SELECT doc_id, item_id, max(n)::INTEGER AS shared_words FROM k GROUP BY doc_id, item_id",
        "p8_due": f"""SELECT doc_id, words, words > 0 AS levelled, words >= 50 AS due FROM (
            SELECT DISTINCT doc_id, {count_words_sql("text")} AS words FROM documents)""",
    }
