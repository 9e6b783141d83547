"""Registered queries against their SQL, and the shape of their plans."""

from __future__ import annotations

import re

import pytest
from compare import connect, difference

import __spark_entry__ as contract
from arborlake.plans.catalog import QUERIES as REGISTERED
from oracle_queries import STATEMENTS

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


def test_every_query_has_a_statement():
    assert set(STATEMENTS) == set(REGISTERED)


def test_all_are_registered():
    assert set(REGISTERED) <= set(contract.queries())
    assert set(STATEMENTS) <= set(contract.oracle_sql()) <= set(contract.queries())


def test_entry(spark):
    frame = contract.entry(spark)
    assert frame.columns == ["corpus_id", "rank", "file_type", "type_name", "n_files", "share"]
    assert frame.count() > 0


def plan_of(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(REGISTERED))
def test_query_matches_sql(spark, con, name):
    """Same rows as the statement, and no unkeyed join, global window or Python."""
    frame = REGISTERED[name](spark, SF_DIR)
    plan = plan_of(frame)
    for node in ("CartesianProduct", "BroadcastNestedLoopJoin", "SinglePartition", "EvalPython"):
        assert node not in plan, node
    assert difference(frame, con, STATEMENTS[name]) is None


@pytest.mark.parametrize(
    "name", ["type_breakdown", "ext_top5", "lang_hint", "include_exclude", "safety_filter", "path_columns"]
)
def test_content_is_not_read_when_unused(spark, name):
    schemas = re.findall(r"ReadSchema: struct<([^>]*)>", plan_of(REGISTERED[name](spark, SF_DIR)))
    assert schemas and not any("text:" in s for s in schemas)


def test_top_rows_are_limited_before_the_exchange(spark):
    plan = plan_of(REGISTERED["ext_top5"](spark, SF_DIR))
    assert "Partial" in plan and "WindowGroupLimit" in plan
