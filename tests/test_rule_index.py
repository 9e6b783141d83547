"""Ignore rules by key against the translated rules, and the ordered sweep against plain Python."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from arborlake.functions.globs import ignore_rules, keyed_rules, rule_key
from arborlake.operators import ignore, ranges
from arborlake.operators.scratch import materialize

NAMES = ["a", "b.rs", ".x", "a.b.log", "log", "src", "x-1", "-", "é.log", "a.", "[", "docs"]
PATTERNS = [
    "a", "*.log", "*.b.log", "src/", "/src", "src/*.rs", "**/docs", "docs/**", "/a/b.rs", "x-?", "a*", "*x*", ".*",
    "src/**/a", "[ab]", "*.[lr]og", "\\!a", "!a", "!*.log", "!src/", "!/src/a", "docs/*/", "**", "*", "{a,log}",
    "# no", "", "a/", "/*/a", "a.b*", "!.x", "é*", "src/a.b.log", "*.", "a\\ ", "[", "!docs/**",
]


@pytest.mark.parametrize(
    "body, want",
    [
        ("**/target", ("n:target", True)), ("src", ("p:src", True)), ("a/b.c", ("p:a/b.c", True)), ("**/*.log", ("x:.log", True)),
        ("**/*.tar.gz", ("x:.tar.gz", True)), ("**/f*.log", ("x:.log", False)), ("a/*.log", ("x:.log", False)), ("a*/b", ("n:b", False)),
        ("a/**/*", ("f:a", False)), ("**/a*", (None, False)), ("**/{a,b}", (None, False)), ("**/*log", (None, False)), ("a/b*", ("f:a", False)),
    ],
)
def test_rule_keys(body, want):
    assert rule_key(body) == want


def verdict(lines, path, is_dir):
    """The last rule that matches decides."""
    hits = [r for r in ignore_rules(lines) if (is_dir or not r.dir_only) and re.search(r.regex.replace(r"\z", r"\Z"), path)]
    return bool(hits) and not hits[-1].negated


def test_rules_by_key_decide_as_the_rules_in_order(spark):
    rng = random.Random(11)
    layers = [(f"c{k}", "s" if k % 3 == 0 else "", 0, n, p) for k in range(30) for n, p in enumerate(rng.choices(PATTERNS, k=rng.randint(1, 9)))]
    paths = {"/".join(rng.choice(NAMES) for _ in range(rng.randint(1, 4))) for _ in range(150)}
    rows = [(f"c{k}", ("s/" if k % 3 == 0 else "") + p, bool(d)) for k in range(30) for p in sorted(paths) for d in (0, 1)]
    entries = spark.createDataFrame(rows, "corpus_id string, path string, is_dir boolean")
    got = {tuple(r) for r in ignore.ignored_entries(entries, ignore.layers_from_rows(spark, layers)).collect()}
    by_corpus = {}
    for c, _, _, _, p in layers:
        by_corpus.setdefault(c, []).append(p)
    scoped = {c: scope for c, scope, *_ in layers}
    want = {(c, p, d) for c, p, d in rows if verdict(by_corpus[c], p.removeprefix("s/") if scoped[c] else p, d)}
    assert got == want and want and len(want) < len(rows)


def test_blocks_keep_the_order_of_signs():
    loose, rules = keyed_rules(["*.log", "a*", "b*", "!keep.log", "c*", "*.log", "*.log"])
    assert [(r.key, r.negated, r.block) for r in rules] == [
        ("x:.log", False, 0), ("n:keep.log", True, 1), ("x:.log", False, 2), (None, False, 0), (None, False, 2),
    ]
    assert re.search(loose.replace(r"\z", r"\Z"), "x/abc") and not re.search(loose.replace(r"\z", r"\Z"), "x/keep.log")
    assert keyed_rules(["*.log", "# a", "[", ""])[0] is None


def test_only_loose_rules_of_a_scope_are_tried_on_all_its_entries(spark):
    lines = [f"*.e{k}" for k in range(400)] + [f"name{k}" for k in range(300)] + [f"dir{k}/*.x" for k in range(300)] + ["q*"]
    layers = ignore.layers_from_rows(spark, [("c", "", 0, n, p) for n, p in enumerate(lines)])
    index = ignore.rule_index(layers)
    assert index.count() == 400 + 300 + 1 + 1
    assert [len(r.rules) for r in index.where("key = '*'").collect()] == [1]


def naive(entries, marks):
    found = {}
    for c, p, d in entries:
        above = any((c, p[:i], True) in marks for i, x in enumerate(p) if x == "/")
        found[c, p, d] = 3 if above else marks.get((c, p, d), 0)
    return found


@pytest.mark.parametrize("parts", [1, 7])
def test_sweep_equals_the_test_of_every_ancestor(spark, parts):
    rng = random.Random(3)
    names = ["a", "a-", "a.b", "a0", "b", "é", "B"]
    files = {"/".join(rng.choice(names) for _ in range(rng.randint(1, 5))) + "/f" for _ in range(300)}
    entries = {(c, p, False) for c in "cd" for p in files} | {(c, p[:i], True) for c in "cd" for p in files for i, x in enumerate(p) if x == "/"}
    chosen = rng.sample(sorted(e for e in entries if e[2]), 25) + rng.sample(sorted(e for e in entries if not e[2]), 20)
    marks = {m: 1 + k % 2 for k, m in enumerate(chosen)}
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        table = spark.createDataFrame(sorted(entries), "corpus_id string, path string, is_dir boolean").withColumn("more", F.lit(1))
        written = materialize(spark.createDataFrame([(*m, code) for m, code in marks.items()], "corpus_id string, path string, is_dir boolean, code int"), "marks")
        got = ranges.with_codes(table, written)
        assert got.columns == ["corpus_id", "path", "is_dir", "more", "code"]
        assert {(r.corpus_id, r.path, r.is_dir): r.code for r in got.collect()} == naive(entries, marks)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_one_directory_with_most_of_the_rows_spans_partitions(spark):
    files = [("c", f"big/d{k % 50}/f{k}", False) for k in range(3000)] + [("c", f"z{k}", False) for k in range(10)]
    table = spark.createDataFrame(files, "corpus_id string, path string, is_dir boolean")
    marks = materialize(spark.createDataFrame([("c", "big", True, 2)], "corpus_id string, path string, is_dir boolean, code int"), "marks")
    coded = ranges.with_codes(table, marks)
    assert {r["code"]: r["count"] for r in coded.groupBy("code").count().collect()} == {3: 3000, 0: 10}
