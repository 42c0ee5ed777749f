"""The queries of the problems over the smallest tables, and against SQL where there is some."""

import pytest
from compare import compare, connection

from folioforge.llm import queries, sql

KEYS = {
    "p1_found": ["record_kind", "document_id", "record_id"],
    "p2_found": ["document_id", "block_id", "defect"],
    "p3_found": ["document_id", "field_name", "entry_id_a", "entry_id_b"],
    "p4_found": ["record_kind", "document_id", "record_id", "lang"],
    "p5_found": ["document_id", "source_block_id", "source_sentence", "target_block_id", "target_sentence"],
    "p7_found": ["doc_id", "item_id"],
    "p8_found": ["doc_id", "band"],
}


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_rows_are_distinct(spark, data, name):
    df = queries.queries()[name](spark, data)
    if name in KEYS:
        assert df.columns == KEYS[name]
        rows = [tuple(r) for r in df.collect()]
        assert len(rows) == len(set(rows)) > 0
    else:
        assert df.count() > 0


@pytest.mark.parametrize("name", sorted(sql.oracle_sql()))
def test_sql(spark, data, name):
    assert compare(queries.queries()[name](spark, data), connection(data), sql.oracle_sql()[name]) == ""
