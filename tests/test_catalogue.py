"""Every registered query against its SQL, or against what it must give where SQL doesn't express it."""

from __future__ import annotations

import pytest

from codequarry.plans import catalogue
from tests.compare import compare, database


@pytest.mark.parametrize("name", list(catalogue.ORACLE_SQL))
def test_query_is_its_sql(spark, small, name):
    assert compare(catalogue.QUERIES[name](spark, small), catalogue.ORACLE_SQL[name], database(small)) is None


def test_every_query_has_sql():
    assert set(catalogue.QUERIES) == set(catalogue.ORACLE_SQL)


def test_quality_totals(spark, small):
    """The summary and the counts of issues agree with each other and with the pairs that are broken by rule."""
    summary = catalogue.QUERIES["quality_summary"](spark, small).first()
    issues = {(r.severity, r.rule): r.n for r in catalogue.QUERIES["quality_issues"](spark, small).collect()}
    parts = spark.read.parquet(f"{small}/part.parquet").count()
    assert summary.total == parts == summary.clean + summary.warn + summary.fail
    assert issues["fail", "no_change"] == issues["fail", "after_unparseable"] == issues["fail", "smell_invalid"] == parts // 10
    assert summary.fail >= 3 * (parts // 10)

