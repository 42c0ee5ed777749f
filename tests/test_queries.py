"""Every query of the core: against SQL where there is some, else that it runs and has rows."""

import pytest
from compare import compare, connection

import folioforge.plans.documents  # noqa: F401  (adds its queries)
import folioforge.plans.values  # noqa: F401  (adds its queries)
import folioforge.plans.workspace  # noqa: F401  (adds its queries)
from folioforge.plans.catalog import REGISTRY

FEW = {"blocks_differing_from_json", "parse_deltas", "unused_translations", "late_usage", "usage_without_job", "table_translations",
       "uploads_since"}


@pytest.fixture(scope="module")
def con(data):
    return connection(data)


@pytest.mark.parametrize("name", sorted(REGISTRY.queries))
def test_query(spark, data, con, name):
    df = REGISTRY.queries[name](spark, data)
    assert len(set(df.columns)) == len(df.columns)
    if name in REGISTRY.sql:
        assert compare(df, con, REGISTRY.sql[name]) == ""
    elif name not in FEW:
        assert df.count() > 0
