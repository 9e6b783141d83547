"""Patterns, decisions, ignore files and repository boundaries."""

from __future__ import annotations

import re

import pytest
from conftest import kept
from pyspark.sql import functions as F

from arborlake.functions.globs import (
    glob_set_regex,
    glob_to_regex,
    ignore_rules,
    normalize_pattern,
    static_prefix,
)
from arborlake.operators import ignore
from arborlake.operators.inventory import all_entries, rejected_entries, walkable
from arborlake.operators.selection import (
    SAFETY_PATTERNS,
    SelectionRules,
    kept_files,
    nested_repositories,
    select_entries,
    with_decision,
)


def matches(pattern, path, dialect="user"):
    return re.search(glob_set_regex([pattern], dialect).replace(r"\z", r"\Z"), path) is not None


def test_normalize_pattern():
    cases = {
        "*.rs": "**/*.rs", "foo.txt": "**/foo.txt", "src/*.go": "src/*.go", "**/*.md": "**/*.md",
        "build/": "**/build/**", "__tests__": "**/__tests__/**", "vendor": "**/vendor/**",
        "src/lib/": "src/lib", "hoge/": "**/hoge/**",
    }
    assert {p: normalize_pattern(p) for p in cases} == cases
    assert static_prefix("vendor/**/*.py") == "vendor/"
    assert static_prefix("a/b") == "a/b"


@pytest.mark.parametrize(
    ("pattern", "path", "want"),
    [
        ("**/*.rs", "main.rs", True),
        ("**/*.rs", "a/b/main.rs", True),
        ("**/*.rs", "main.rsx", False),
        ("src/*.go", "src/a/b.go", True),  # a star crosses separators
        ("vendor/**/*.py", "vendor/x.py", True),
        ("vendor/**/*.py", "vendor/a/b/x.py", True),
        ("**/target/**", "target/debug/app", True),
        ("**/target/**", "target", False),
        ("**/target/**", "target/", True),
        ("a?c", "a/c", True),
        ("[ab].txt", "a.txt", True),
        ("[!ab].txt", "a.txt", False),
        ("[!ab].txt", "c.txt", True),
        ("{a,b}.txt", "b.txt", True),
        ("{a,b}.txt", "c.txt", False),
        ("{a,}.txt", ".txt", False),
        ("x{**/a,b}", "xb", True),
        ("a.b", "axb", False),
        (r"a\*b", "a*b", True),
        (r"a\*b", "axb", False),
        ("**", "anything/at/all", True),
        ("a+(b)", "a+(b)", True),
    ],
)
def test_user_globs(pattern, path, want):
    assert matches(pattern, path) is want


@pytest.mark.parametrize("pattern", ["[ab", "{a,b", "a}b", "*a\\", "[z-a]"])
def test_bad_patterns_fail_while_planning(pattern):
    with pytest.raises(ValueError):
        glob_to_regex(pattern)
    with pytest.raises(ValueError):
        SelectionRules(include=(pattern,))
    with pytest.raises(ValueError):
        SelectionRules(exclude=(pattern,))


def test_safety_patterns():
    assert len(SAFETY_PATTERNS) == len(set(SAFETY_PATTERNS)) == 70

    def unsafe(path):
        return any(matches(p, path, "plain") for p in SAFETY_PATTERNS)

    for path in (".env", ".env.local", ".ssh/id", "a/.ssh/key", "server.pem", "x/y/private.key",
                 "target/debug/app", "a/node_modules/b", ".DS_Store", "Thumbs.db", "id_rsa", "x/my_rsa",
                 "a/credentials", "credentials.json", "a/secrets.yml", "x.log", "a/tmp/b", "a/b.swp", "x~"):
        assert unsafe(path), path
    for path in ("src/.env", "a/id_x", "a/Thumbs.db", "package-lock.json", "Cargo.lock", "yarn.lock",
                 "targets/x", "src/main.rs", "environment", "my.environment"):
        assert not unsafe(path), path


def ignored(lines, path, is_dir=False):
    verdict = False
    for rule in ignore_rules(lines):
        if (is_dir or not rule.dir_only) and re.search(rule.regex.replace(r"\z", r"\Z"), path):
            verdict = not rule.negated
    return verdict


def test_ignore_dialect():
    assert ignored(["*.tmp"], "a/b.tmp")
    assert not ignored(["/x.tmp"], "a/x.tmp") and ignored(["/x.tmp"], "x.tmp")
    assert ignored(["build/"], "a/build", True) and not ignored(["build/"], "a/build")
    assert ignored(["src/*.rs"], "src/a.rs") and not ignored(["src/*.rs"], "src/b/a.rs")
    assert not ignored(["src/*.rs"], "x/src/a.rs")
    assert ignored(["*.log", "!keep.log"], "x.log") and not ignored(["*.log", "!keep.log"], "a/keep.log")
    assert ignored(["!keep.log", "*.log"], "keep.log")
    assert not ignored(["# *.log", "", "  "], "x.log")
    assert ignored(["\\#x"], "#x") and ignored(["\\!x"], "!x")
    assert ignored(["a/**"], "a/b") and not ignored(["a/**"], "a", True)
    assert ignored(["**/z"], "q/z") and ignored(["z  "], "z")
    assert not ignored(["[bad"], "[bad")
    assert not ignored(["a*c"], "a/c")


def decide(tree, files, **rules):
    return select_entries(tree(files), SelectionRules(**rules))


def test_exclude_narrows_generic_include(tree):
    files = ["src/main.rs", "src/lib.rs", "src/test_helper.rs", "tests/test_main.rs", "README.md"]
    got = decide(tree, files, include=["*.rs"], exclude=["test_*.rs"])
    assert kept(got) == {"src/main.rs", "src/lib.rs"}


def test_located_include_overrides_exclude_and_safety(tree):
    files = [
        "vendor/lib1/code.py", "vendor/lib2/code.py", "vendor/lib1/README.md", "vendor/lib2/LICENSE",
        "src/main.py",
    ]
    got = decide(tree, files, include=["vendor/**/*.py"], exclude=["vendor"])
    assert kept(got) == {"vendor/lib1/code.py", "vendor/lib2/code.py"}
    assert kept(got, dirs=True) == {"vendor", "vendor/lib1", "vendor/lib2"}


def test_bare_directory_equals_recursive_pattern(tree):
    files = ["__tests__/a.js", "__tests__/nested/deep.js", "src/__tests__/b.js", "src/main.js"]
    bare = kept(decide(tree, files, exclude=["__tests__"]))
    assert bare == {"src/main.js"}
    rooted = kept(decide(tree, files, exclude=["__tests__/**"]))
    assert rooted == {"src/main.js", "src/__tests__/b.js"}


def test_include_extension_set(tree):
    files = ["a.rs", "b.RS", "c.go", "d"]
    assert kept(decide(tree, files, include_ext=[".rs"])) == {"a.rs"}
    assert kept(decide(tree, files, include_ext=[".rs"], case_sensitive=False)) == {"a.rs", "b.RS"}


def test_include_with_trailing_slash_path_matches_that_path_only(tree):
    assert kept(decide(tree, ["src/lib/a.rs", "src/lib.rs"], include=["src/lib/"])) == set()


def test_reasons(tree):
    files = ["src/a.rs", "src/b.md", "x.log", "docs/c.rs", "vendor/d.rs"]
    rows = decide(tree, files, include=["*.rs", "vendor/d.rs"], exclude=["docs"]).collect()
    got = {r.path: r.reason for r in rows}
    assert got["src/a.rs"] == "included"
    assert got["src/b.md"] == "not_included"
    assert got["docs/c.rs"] == "excluded"
    assert got["vendor/d.rs"] == "path_include"
    assert got["docs"] == "empty"


def test_safety_on_and_off(tree):
    files = [
        ".env", ".env.local", ".ssh/id_rsa", "server.pem", "private.key", "target/debug/app",
        "node_modules/x/index.js", ".DS_Store", "Thumbs.db", "main.rs", "package-lock.json", "sub/.env",
    ]
    assert kept(decide(tree, files)) == {"main.rs", "package-lock.json", "sub/.env"}
    assert kept(decide(tree, files, safety=False)) == set(files)


def test_git_directory_is_pruned_but_a_root_git_file_stays(tree):
    assert kept(decide(tree, [".git/config", "a"], safety=False)) == {"a"}
    assert kept(decide(tree, [".git", "a"])) == {".git", "a"}


def test_depth_limit(tree):
    files = ["root.txt", "L1/file1.txt", "L1/L2/file2.txt", "L1/L2/L3/file3.txt"]
    for depth in (1, 2, 3):
        got = decide(tree, files, max_depth=depth)
        assert kept(got) == {f for f in files if f.count("/") < depth}
        assert kept(got, dirs=True) == {d for d in ("L1", "L1/L2", "L1/L2/L3") if d.count("/") < depth}


def test_empty_directories_stay_without_includes(tree):
    assert kept(decide(tree, {"a/": None, "b/x": ""}), dirs=True) == {"a", "b"}
    assert kept(decide(tree, {"a/": None, "b/x.rs": ""}, include=["*.rs"]), dirs=True) == {"b"}


def test_symlinks_and_bad_paths(spark):
    rows = [("c", "ok", False, False), ("c", "link", False, True)]
    frame = spark.createDataFrame(rows, "corpus_id string, path string, is_dir boolean, is_symlink boolean")
    bad = frame.limit(1).withColumn("path", F.unhex(F.lit("FF41")).cast("string"))
    entries = frame.unionByName(bad)
    assert [r.path for r in walkable(entries).collect()] == ["ok"]
    reasons = sorted(r.reject_reason for r in rejected_entries(entries).collect())
    assert reasons == ["path_not_utf8", "symlink"]


def test_nested_repository_is_cut_with_its_empty_parent(tree):
    files = [".git/HEAD", ".worktrees/pool-001/.git", ".worktrees/pool-001/src/a.rs", "src/b.rs"]
    got = decide(tree, files)
    assert kept(got) == {"src/b.rs"} and kept(got, dirs=True) == {"src"}


def test_nested_repository_with_git_directory_and_inner_one(tree):
    files = ["sub/.git/config", "sub/deep/.git", "sub/deep/x", "sub/y", "z"]
    entries = tree(files)
    assert {r.path for r in nested_repositories(entries).collect()} == {"sub", "sub/deep"}
    assert kept(select_entries(entries, SelectionRules())) == {"z"}


def test_unreached_repository_does_not_drop_empty_directories(tree):
    files = {"target/sub/.git": "", "target/sub/x": "", "void/": None, "a": ""}
    assert kept(decide(tree, files), dirs=True) == {"void"}
    assert kept(decide(tree, {**files, "lib/.git": ""}), dirs=True) == set()


def with_ignore(entries, mode="always", rules=None, extra=None):
    layers = ignore.layers_from_files(entries, extra)
    active = ignore.active_layers(layers, mode, entries)
    return select_entries(entries, rules or SelectionRules(safety=False), layers=active)


def test_nested_ignore_file_scope(tree):
    entries = tree({"a/b/c/.gitignore": "*.tmp\n", "a/b/c/remove.tmp": "", "a/b/keep.tmp": "", "a/b/c/d/e.tmp": ""})
    assert kept(with_ignore(entries)) == {"a/b/c/.gitignore", "a/b/keep.tmp"}


def test_negation_within_and_across_layers(tree):
    entries = tree({".gitignore": "*.log\n!keep.log\n", "keep.log": "", "x.log": "", "d/.gitignore": "!y.log\n", "d/y.log": ""})
    assert kept(with_ignore(entries)) == {".gitignore", "keep.log", "d/.gitignore"}


def test_ignored_directory_prunes_below_include(tree):
    entries = tree(
        {
            ".gitignore": "target/\nsrc/*.rs\ntarget/doc/src/*.html\n",
            "src/main.rs": "",
            "target/doc/src/x.html": "",
            "target/src/a": "",
        }
    )
    got = with_ignore(entries, rules=SelectionRules(include=["src"]))
    assert kept(got) == {"src/main.rs"}


def test_info_exclude_and_global_rules_win_last(tree, spark):
    entries = tree(
        {".git/info/exclude": ".worktrees/\nscratch/\n", ".worktrees/a": "", "scratch/b": "", ".gitignore": "!g.txt\n*.up\n", "g.txt": "", "c": "", "d.up": ""}
    )
    extra = spark.createDataFrame([("c", 0, "!d.up", "ancestor"), ("c", 0, "g.txt", "global")], "corpus_id string, rule_seq int, pattern string, source string")
    assert kept(with_ignore(entries, "auto", extra=extra)) == {".gitignore", "c", "d.up"}


def test_ancestor_rules_of_any_number_precede_the_exclude_file(tree, spark):
    entries = tree({".git/info/exclude": "!keep.txt\n", "keep.txt": "", "a": ""})
    for number in (5, 1500):
        extra = spark.createDataFrame([("c", number, "keep.txt")], "corpus_id string, rule_seq int, pattern string")
        assert "keep.txt" in kept(with_ignore(entries, extra=extra))


def test_rows_with_unknown_flags_are_plain_files(spark):
    rows = [("c", "a", None, None), ("c", "l", False, True), ("c", "", False, False), ("c", None, False, False)]
    entries = spark.createDataFrame(rows, "corpus_id string, path string, is_dir boolean, is_symlink boolean")
    assert [(r.path, r.is_dir) for r in all_entries(walkable(entries)).collect()] == [("a", False)]
    found = {(r.path, r.reject_reason) for r in rejected_entries(entries).collect()}
    assert found == {("l", "symlink"), ("", "path_empty"), (None, "path_missing")}


def test_ignore_modes(tree, spark):
    bare = tree({".gitignore": "*.o\n", "a.o": "", "b": ""})
    repo = tree({".gitignore": "*.o\n", "a.o": "", "b": "", ".git/HEAD": ""})
    assert "a.o" in kept(with_ignore(bare, "auto")) and "a.o" not in kept(with_ignore(repo, "auto"))
    assert "a.o" not in kept(with_ignore(bare, "always")) and "a.o" in kept(with_ignore(repo, "never"))
    above = ignore.active_layers(
        ignore.layers_from_files(bare), "auto", bare, spark.createDataFrame([("c",)], "corpus_id string")
    )
    assert "a.o" not in kept(select_entries(bare, SelectionRules(), layers=above))
    with pytest.raises(ValueError):
        ignore.active_layers(above, "sometimes", bare)


def test_rule_table_equals_rows(tree, spark):
    rows = [("c", "", 0, 0, "*.log"), ("c", "", 0, 1, "!k.log"), ("c", "s", 1, 0, "x/")]
    table = spark.createDataFrame(rows, "corpus_id string, scope string, layer_seq int, rule_seq int, pattern string")
    entries = tree(["a.log", "k.log", "s/x/f", "s/y", "x/f"])
    want = {"k.log", "s/y", "x/f"}
    for layers in (ignore.layers_from_rules(table), ignore.layers_from_rows(spark, rows)):
        assert kept(select_entries(entries, SelectionRules(safety=False), layers=layers)) == want


def test_corpora_do_not_mix(tree):
    one = tree({".gitignore": "*.o\n", "a.o": ""}, "one")
    two = tree({"a.o": "", "lib/.git": "", "lib/x": "", "void/": None}, "two")
    three = tree({"void/": None, "lib/x": ""}, "three")
    got = with_ignore(one.unionByName(two).unionByName(three))
    keys = {(r.corpus_id, r.path) for r in got.where("decision = 'include'").collect()}
    assert keys == {("one", ".gitignore"), ("two", "a.o"), ("three", "void"), ("three", "lib"), ("three", "lib/x")}


def test_kept_files_agree_with_the_selection(tree):
    entries = tree({"a.rs": "1", "x.log": "2", "lib/.git": "", "lib/b.rs": "3", "tmp/c": "4", "d": "5"})
    rules = SelectionRules()
    selected = select_entries(entries, rules)
    got = {r.path: r.content for r in kept_files(entries, selected, rules).collect()}
    assert got == {"a.rs": "1", "d": "5"} and set(got) == kept(selected)


def test_row_local_decision_has_no_shuffle(tree):
    frame = with_decision(tree(["a/b.rs"]), SelectionRules(include=["*.rs"], exclude=["x"]))
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan
