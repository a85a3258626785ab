"""Every registered query outside llm against its DuckDB counterpart, or for rows where SQL has none."""

from __future__ import annotations

import harness
import pytest

from quern.plans import catalog

SF_DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_matches_sql(spark, name):
    assert harness.differences(spark, name, catalog.QUERIES[name], catalog.ORACLE_SQL[name], SF_DIR) == []


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE_SQL) - {"train_gbt", "train_rf", "train_oof"}))
def test_has_rows(spark, name):
    assert catalog.QUERIES[name](spark, SF_DIR).count() > 0


def test_entry_has_rows(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
