"""Every query over tables without rows, and over tables whose rows are all null but for their keys."""

import pytest
from pyspark.sql import functions as F

from folioforge.llm import queries

KEYS = {
    "documents": ["doc_id", "document_id"], "blocks": ["document_id", "block_id"], "chunks": ["document_id", "chunk_id"],
    "glossary": ["document_id", "entry_id"], "jobs": ["job_id"], "usage_records": ["usage_id"], "reading_labels": ["doc_id"],
    "benchmark": ["item_id"], "size_specs": ["spec_name"],
}


def made(spark, data, folder, nulls):
    for name, keys in KEYS.items():
        df = spark.read.parquet(f"{data}/{name}.parquet")
        rows = df.limit(20).select(*[F.col(c) if c in keys else F.lit(None).cast(df.schema[c].dataType).alias(c) for c in df.columns])
        (rows if nulls else df.where("false")).coalesce(1).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


@pytest.fixture(scope="module")
def empty(spark, data, tmp_path_factory):
    return made(spark, data, tmp_path_factory.mktemp("empty"), False)


@pytest.fixture(scope="module")
def nulls(spark, data, tmp_path_factory):
    return made(spark, data, tmp_path_factory.mktemp("nulls"), True)


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_tables_without_rows(spark, empty, name):
    assert queries.queries()[name](spark, empty).count() == 0


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_rows_of_nulls(spark, nulls, name):
    queries.queries()[name](spark, nulls).collect()
