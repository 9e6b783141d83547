"""Whole jobs: ignore files at and above the roots, corpora without kept entries, numbers, narrow manifests."""

from __future__ import annotations

from pyspark.sql import functions as F
from test_listing import PROJECT, document

from arborlake.operators.containment import ancestor_rules, corpora_in_repositories
from arborlake.operators.numbering import numbered
from arborlake.operators.selection import SelectionRules
from arborlake.plans.jobs import Options, annotated_listing, numbered_document, plain_listing

BARE = Options(stats="off", loc="off", rules=SelectionRules(safety=False))


def places(spark, **roots):
    return spark.createDataFrame(list(roots.items()), "corpus_id string, root string")


def mode(name):
    return Options(stats="off", loc="off", ignore_mode=name)


def test_ignore_files_count_without_layers_from_the_caller(tree):
    files = {".gitignore": "*.tmp\n", "k.tmp": "", "a": ""}
    assert "├── k.tmp" not in document(plain_listing(tree(files), mode("always")))
    for name, shown in (("auto", True), ("never", True)):
        assert ("└── k.tmp" in document(plain_listing(tree(files), mode(name)))) == shown
    repository = tree({**files, ".git/HEAD": "ref"})
    assert "└── k.tmp" not in document(plain_listing(repository, mode("auto")))
    assert "└── k.tmp" in document(plain_listing(repository, mode("never")))


def test_rules_and_repositories_above_a_root(tree, spark):
    outer = {".git/HEAD": "", ".gitignore": "*.o\n!b.c\n", "in/.gitignore": "*.c\n", "x.o": "", "x.c": ""}
    entries = tree(outer, "outer").unionByName(tree({"a.o": "", "a.c": "", "b.c": "", "z": ""}, "inner"))
    entries = entries.unionByName(tree({"a.o": ""}, "apart"))
    corpora = places(spark, outer="/lake/p", inner="/lake/p/in/deep/", apart="/lake/p-2")
    assert {r.corpus_id for r in corpora_in_repositories(entries, corpora).collect()} == {"outer", "inner"}
    rules = ancestor_rules(entries, corpora).orderBy("corpus_id", "rule_seq").collect()
    assert [(r.corpus_id, r.pattern) for r in rules] == [("inner", "*.c"), ("inner", "*.o"), ("inner", "!b.c")]
    rows = plain_listing(entries, BARE, corpora=corpora)
    shown = {(r.corpus_id, r.line.split()[-1]) for r in rows.collect()}
    assert {x for c, x in shown if c == "inner"} == {".", "b.c", "z"}
    assert ("apart", "a.o") in shown and ("outer", "x.o") not in shown and ("outer", "x.c") in shown


def test_global_rules_come_last(tree):
    files = {".git/HEAD": "", ".gitignore": "!k.up\n", "k.up": "", "a": ""}
    options = Options(stats="off", loc="off", global_rules=("*.up", "# note"))
    assert document(plain_listing(tree(files), options)) == [".", "├── .gitignore", "└── a"]


def test_every_corpus_has_a_document(tree):
    entries = tree(PROJECT).unionByName(tree({"node_modules/a.js": ""}, "hollow")).unionByName(tree({"": ""}, "file"))
    for corpus in ("hollow", "file"):
        rows = plain_listing(entries, Options(stats="min", contents=True)).where(F.col("corpus_id") == corpus)
        assert document(rows) == [".", "", "**Stats**: 📂 0 dirs • 📄 0 files"]
        rows = plain_listing(entries, Options(stats="full")).where(F.col("corpus_id") == corpus)
        assert document(rows) == [".", "", "**Totals**: 📂 0 dirs • 📄 0 files"]
        rows = annotated_listing(entries, Options(stats="full", charset="unicode")).where(F.col("corpus_id") == corpus)
        assert document(rows) == ["", "**Totals**: 📂 0 dirs • 📄 0 files"]


def test_manifest_without_contents(tree):
    entries = tree(PROJECT).drop("content", "is_symlink")
    assert document(plain_listing(entries, Options(stats="min", contents=True)))[-1] == "**Stats**: 📂 2 dirs • 📄 4 files"
    rows = annotated_listing(entries.drop("size_bytes"), Options(stats="off"))
    assert [r.line for r in rows.orderBy("sort_key").collect()][-1].endswith("README.md")


def test_display_path_in_sections(tree):
    options = Options(stats="off", contents=True, display=("/w/p", "/w/p/src"))
    heads = [x.split("\n")[1] for x in document(plain_listing(tree(PROJECT), options)) if x.startswith("\n## ")]
    assert heads == ["## lib.rs", "## main.rs", "## ../README.md"]


def test_numbers_have_no_gaps_and_one_corpus_spans_partitions(spark):
    rows = [("big", k, f"l{k}") for k in range(3000)] + [(f"s{c}", k, "x") for c in range(40) for k in range(5)]
    table = spark.createDataFrame(rows, "corpus_id string, place int, line string").repartition(5)
    seen = numbered(table, "place")
    assert seen.columns == ["corpus_id", "place", "line", "seq"]
    found = seen.collect()
    assert {(r.corpus_id, r.place, r.seq) for r in found} == {(c, k, k + 1) for c, k, _ in rows} and len(found) == len(rows)
    plan = seen._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan


def test_numbers_of_a_document_follow_its_order(tree):
    rows = plain_listing(tree(PROJECT), Options(stats="full", contents=True))
    lines = [r.line for r in numbered_document(rows).orderBy("seq").collect()]
    assert lines == document(rows)
    assert numbered(rows.where("false"), "block", "sort_key").count() == 0
