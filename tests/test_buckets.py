"""Contents stored in buckets are not shuffled beyond the broadcast bounds."""

from __future__ import annotations

import uuid

import pytest

from arborlake.operators import scratch
from arborlake.operators.packing import pack
from arborlake.operators.selection import SelectionRules, kept_files, select_entries
from arborlake.plans.jobs import Options, plain_listing
from arborlake.sources.buckets import store_entries

FILES = {f"d{i % 4}/f{i}.rs": f"fn f{i}() {{\n    a\n}}\n" for i in range(40)} | {"d1/.git": "", "d2/x.log": "", "é.md": "é\n"}
WIDE = {"content", "text", "kept", "section", "fold"}


@pytest.fixture
def stored(spark, tree, tmp_path):
    entries = tree(FILES).unionByName(tree({"a.py": "x\ny\n", "b.py": "z\n"}, "other"))
    name = f"entries_{uuid.uuid4().hex}"
    yield entries, store_entries(entries, name, 5, str(tmp_path / "entries"))
    spark.sql(f"DROP TABLE {name}")


def moved(frame):
    """Columns that cross an exchange."""
    found = set()

    def walk(node):
        if "Exchange" in node.nodeName():
            output = node.output()
            found.update(output.apply(i).name() for i in range(output.size()))
        children = node.children()
        for i in range(children.size()):
            walk(children.apply(i))

    walk(frame._jdf.queryExecution().executedPlan())
    return found


@pytest.mark.parametrize("mode, budget", [("head", 200), ("nest", 500), ("head", None)])
def test_contents_do_not_move(spark, stored, monkeypatch, mode, budget):
    entries, table = stored
    want = pack(kept_files(entries, select_entries(entries, SelectionRules()), SelectionRules()), budget, mode)
    rows = {tuple(r) for r in want.collect()}
    monkeypatch.setattr(scratch, "BROADCAST_ROWS", -1)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        selected = scratch.materialize(select_entries(table, SelectionRules()), "selection")
        got = pack(kept_files(table, selected, SelectionRules()), budget, mode)
        crossed = moved(got)
        assert "path" in crossed and not crossed & WIDE
        assert {tuple(r) for r in got.collect()} == rows
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_jobs_on_stored_entries(stored):
    entries, table = stored
    options = Options(contents=True, max_bytes=200, stats="min")
    assert sorted(plain_listing(table, options).collect()) == sorted(plain_listing(entries, options).collect())
