"""Path, type, language, label, size and count columns."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from arborlake.functions import classify, labels, lines, paths


def one(spark, values, build, kind="string"):
    """Apply a column to literal values, in order."""
    rows = [(i, v) for i, v in enumerate(values)]
    frame = spark.createDataFrame(rows, f"i int, v {kind}")
    return [r[0] for r in frame.orderBy("i").select(build(F.col("v"))).collect()]


def test_clean_path(spark):
    cases = {
        "./foo/bar": "foo/bar",
        "foo//bar": "foo/bar",
        "foo/bar/": "foo/bar",
        "./": ".",
        "/": "/",
        "//var///log/": "/var/log",
        "///": "/",
        "/foo//bar///baz/": "/foo/bar/baz",
        ".\\src\\main.rs": "src/main.rs",
        "foo//bar///": "foo/bar",
        "./foo//./bar": "foo/./bar",
        "": ".",
        ".": ".",
        "..": "..",
        "./..": "..",
        "\\/foo": "foo",
        "/\\foo": "/foo",
    }
    assert one(spark, cases, paths.clean_path) == list(cases.values())


def test_extension(spark):
    cases = {
        "a.tar.gz": "gz",
        "x/.gitignore": None,
        "x/Makefile": None,
        "trailing.": "",
        "..hidden": "hidden",
        "d.ir/file": None,
        ".env.local": "local",
    }
    assert one(spark, cases, paths.extension_of) == list(cases.values())


def test_parent_name_ancestors(spark):
    assert one(spark, ["a", "a/b", "a/b/c"], paths.parent_of) == ["", "a", "a/b"]
    assert one(spark, ["a", "a/b/c"], paths.ancestors_of) == [[], ["a", "a/b"]]
    assert one(spark, ["a", "a/b"], paths.ancestors_or_self) == [["a"], ["a", "a/b"]]
    assert one(spark, ["a", "a/b/c"], paths.depth_of) == [1, 3]


def test_relative_and_inside(spark):
    values = ["/r/a", "/r", "/rest/a", "/r/a/b"]
    assert one(spark, values, lambda c: paths.relative_to(c, "/r")) == ["a", "", None, "a/b"]
    assert one(spark, values, lambda c: paths.inside_root(c, "/r")) == [True, True, False, True]


def test_display_path(spark):
    values = ["/home/u/p/src/main.rs", "/home/u/other", "/home/u/p", "rel/x"]
    got = one(spark, values, lambda c: paths.display_path(c, "/home/u/p"))
    assert got == ["src/main.rs", "../other", "", "rel/x"]


def test_directory_hint(spark):
    assert one(spark, ["a/", "a\\", "a"], paths.has_directory_hint) == [True, True, False]


def test_sort_key_lists_directories_before_files(spark):
    entries = [
        ("b.txt", False), ("a", True), ("a/z", False), ("a-b", True), ("a/x", True), ("a/x/y", False),
        ("a.txt", False), ("é", False),
    ]
    frame = spark.createDataFrame(entries, "path string, is_dir boolean")
    ordered = [
        r.path for r in frame.orderBy(paths.sort_key(F.col("path"), F.col("is_dir"))).collect()
    ]
    assert ordered == ["a", "a/x", "a/x/y", "a/z", "a-b", "a.txt", "b.txt", "é"]


def test_file_types(spark):
    cases = {
        "Dockerfile": "Dockerfile", "dockerfile.dev": "Dockerfile", "Makefile": "Makefile",
        "GNUmakefile": "Makefile", "LICENSE": "License", "licence": "License", "LICENSE.md": "License",
        ".gitignore": "Ignore", ".dockerignore": "Ignore", "myignore": "Ignore", "Cargo.lock": "Lock",
        "package-lock.json": "Lock", "main_test.go": "Test", "user.spec.ts": "Test", "latest.txt": "Test",
        "main.rs": "Rust", "a.PYW": "Python", "b.mjs": "JavaScript", "c.tsx": "TypeScript",
        "d.hxx": "CPlusPlus", "e.h": "C", "f.kts": "Kotlin", "g.zsh": "Shell", "h.markdown": "Markdown",
        "i.yml": "Yaml", "j.cfg": "Ini", "k.xyz": "Unknown", "noext": "Unknown", "l.cs": "CSharp",
        "m.swift": "Swift", "n.rb": "Ruby", "o.php": "Php", "p.java": "Java", "q.xml": "Xml",
    }
    assert one(spark, [f"x/{n}" for n in cases], classify.file_type) == list(cases.values())


def test_display_names_cover_all_types(spark):
    names = one(spark, list(classify.TYPES), classify.type_display_name)
    assert names == [v[0] for v in classify.TYPES.values()]
    assert len(classify.TYPES) == 29
    emoji = one(spark, list(classify.TYPES), classify.default_label)
    assert emoji == [v[1] for v in classify.TYPES.values()]


def test_language_hint(spark):
    cases = {"a.rs": "rust", "B.JSON": "json", "c.unknown": None, "d": None, "e.yml": "yaml"}
    assert one(spark, cases, classify.language_hint) == list(cases.values())


def test_profiles_are_case_sensitive_and_ordered(spark):
    rows = classify.profile_rows() + [(9, "rs", "Text")]
    profiles = spark.createDataFrame(rows, "priority int, ext string, file_type string")
    files = spark.createDataFrame([("a.rs",), ("b.jsx",), ("c.RS",), ("d.pyi",), ("e.md",)], "path string")
    got = {r.path: r.profile_type for r in classify.with_profile_type(files, profiles).collect()}
    assert got == {"a.rs": "Rust", "b.jsx": "JavaScript", "c.RS": "Rust", "d.pyi": "Python", "e.md": "Markdown"}


def test_labels(spark):
    rows = classify.parse_label_arguments([".rs=R", ".rs=S", "test=T", "nope=X", "junk", "config=C"])
    assert rows == [("ext", "rs", "S"), ("type", "Test", "T"), ("type", "Json", "C")]
    files = spark.createDataFrame([("a.rs",), ("b_test.rs",), ("c_test.py",), ("d.go",)], "path string")
    files = files.withColumn("file_type", classify.file_type(F.col("path")))
    overrides = spark.createDataFrame(rows, "kind string, key string, label string")
    got = {r.path: r.label for r in classify.with_label(files, overrides).collect()}
    assert got == {"a.rs": "S", "b_test.rs": "S", "c_test.py": "T", "d.go": "🐹"}
    assert {r.label for r in classify.with_label(files, overrides, enabled=False).collect()} == {""}


def test_label_table_names(spark):
    table = spark.createDataFrame(
        [("ext", "..rs", "R"), ("type", "JS", "J"), ("type", "configuration", "C"), ("type", "py", "X")],
        "kind string, key string, label string",
    )
    got = {(r.kind, r.key, r.label) for r in classify.labels_from_table(table).collect()}
    assert got == {("ext", "rs", "R"), ("type", "JavaScript", "J"), ("type", "Json", "C")}


def test_binary_extension(spark):
    assert len(classify.BINARY_EXTENSIONS) == len(set(classify.BINARY_EXTENSIONS)) == 46
    cases = {"a.PNG": True, "Cargo.lock": True, "go.sum": True, "x.rs": False, "noext": False}
    assert one(spark, cases, classify.has_binary_extension) == list(cases.values())


@pytest.mark.parametrize("is_text", [True, False])
def test_binary_probe(spark, is_text):
    cases = [
        (b"Hello\x00World", True),
        (b"plain text", False),
        (b"12345678\x01", True),  # nine bytes: a tenth is zero
        (b"123456789\x01", False),
        (b"tab\tline\n\r\n", False),
        (b"x" * 8192 + b"\x00", False),  # beyond the sample
        (b"", False),
        ("é".encode() * 5000 + b"\x00", False),
    ]
    kind = "string" if is_text else "binary"
    values = [c.decode() if is_text else c for c, _ in cases]
    got = one(spark, values, lambda c: classify.looks_binary(c, is_text), kind)
    assert got == [want for _, want in cases]


def test_sample_utf8(spark):
    values = [b"ok", b"\xff\xfe", "é".encode()]
    got = one(
        spark, values, lambda c: classify.sample_is_utf8(classify.probe_sample(c, False)), "binary"
    )
    assert got == [True, False, True]


LINE_CASES = {
    "": [],
    "a": ["a"],
    "a\n": ["a"],
    "a\n\n": ["a", ""],
    "\n": [""],
    "a\r\nb\r\n": ["a", "b"],
    "a\r\r\nb": ["a\r", "b"],
    "a\rb": ["a\rb"],
    "end\r": ["end\r"],
}


def test_lines(spark):
    assert one(spark, LINE_CASES, lines.lines_of) == list(LINE_CASES.values())
    assert one(spark, LINE_CASES, lines.line_count) == [len(v) for v in LINE_CASES.values()]


def test_indent_counts_bytes_of_unicode_space(spark):
    cases = {"  x": 2, "\tx": 1, " x": 2, "　x": 3, "   ": 0, "": 0, "x ": 0, "  y": 6}
    assert one(spark, cases, lines.indent_of) == list(cases.values())


def loc(spark, name, content, mode="fast", is_text=True, size=None):
    kind = "string" if is_text else "binary"
    size = len(content.encode() if is_text else content) if size is None else size
    frame = spark.createDataFrame([(name, content, size)], f"path string, content {kind}, size bigint")
    column = lines.lines_of_code(
        F.col("path"), F.col("content"), F.col("size"), mode=mode, is_text=is_text
    )
    return frame.select(column).first()[0]


def test_loc_modes_and_gates(spark):
    code = "// c\nfn main() {\n\n    /* x */\n    println!();\n * y\n\t# z\n}\n"
    assert loc(spark, "a.rs", code) == 8
    assert loc(spark, "a.rs", code, "accurate") == 3
    assert loc(spark, "a.rs", code, "off") is None
    assert loc(spark, "a.lock", code) is None
    assert loc(spark, "a.rs", "x\x00y") is None
    assert loc(spark, "a.rs", code, size=10 * 1024 * 1024 + 1) is None
    assert loc(spark, "a.rs", code, size=10 * 1024 * 1024) == 8
    assert loc(spark, "a.rs", "") == 0
    with pytest.raises(ValueError):
        lines.lines_of_code(F.col("a"), F.col("b"), F.col("c"), mode="exact", is_text=True)


def test_loc_cutoff(spark):
    assert loc(spark, "a.rs", "x\n" * 100_005) == 100_001
    assert loc(spark, "a.rs", "x\n" * 100_000) == 100_000
    assert loc(spark, "a.rs", "#\n" * 100_005 + "x\n", "accurate") == 1


def test_loc_of_undecodable_lines(spark):
    raw = b"good line of text\nbad \xff line\n# note\nlast line here\n"
    assert loc(spark, "a.rs", raw, "fast", is_text=False) == 4
    assert loc(spark, "a.rs", raw, "accurate", is_text=False) == 2


def test_readable_text(spark):
    got = one(spark, [b"ok", b"\xff"], lambda c: lines.readable_text(c, False), "binary")
    assert got == ["ok", None]


def test_human_size(spark):
    cases = {
        0: "0 B", 100: "100 B", 1023: "1023 B", 1024: "1.0 KB", 1536: "1.5 KB", 1048576: "1.0 MB",
        1073741824: "1.0 GB", 1280: "1.2 KB", 1792: "1.8 KB", 1048575: "1024.0 KB", 5 * 1024**4: "5120.0 GB",
    }
    assert one(spark, cases, labels.human_size, "bigint") == list(cases.values())


def test_one_decimal_matches_exact_rounding(spark):
    values = [x / 1000 for x in range(1000, 3000, 50)] + [1.25, 2.35, 999.95, 123456.65, 1.05, 7.75]
    assert one(spark, values, labels.one_decimal, "double") == [f"{v:.1f}" for v in values]


def test_count_label(spark):
    cases = {0: "0", 999: "999", 1000: "1.0K", 1150: "1.1K", 1250: "1.2K", 1350: "1.4K", 3_400_000: "3.4M", 999_999: "1000.0K"}
    assert one(spark, cases, labels.count_label, "bigint") == list(cases.values())


def test_size_class_and_tick(spark):
    cases = {1024: "XS", 1025: "S", 8193: "M", 65537: "L", 524289: "XL", 4194305: "XXL"}
    assert one(spark, cases, labels.size_class, "bigint") == list(cases.values())
    assert one(spark, [1024, 1025, 10**9], labels.size_tick, "bigint") == [None, "▁", "▇"]


def test_loc_class_label_bar(spark):
    cases = {5: "XS", 50: "S", 150: "M", 400: "L", 800: "XL", 1500: "XXL"}
    assert one(spark, cases, labels.loc_class, "bigint") == list(cases.values())
    assert one(spark, [100, 999, 1000, 5000], labels.loc_label, "bigint") == ["100", "999", "1k+", "1k+"]
    bars = {(5, 100): 0, (0, 100): 0, (100, 100): 10, (50, 100): 5, (25, 100): 3, (2000, 2000): 10, (500, 2000): 5, (10, 5000): 1}
    frame = spark.createDataFrame(list(bars), "loc bigint, top bigint")
    got = {(r.loc, r.top): r.bar for r in frame.select("*", labels.loc_bar(F.col("loc"), F.col("top")).alias("bar")).collect()}
    assert got == {k: "[" + "█" * n + "·" * (10 - n) + "]" for k, n in bars.items()}


def test_share(spark):
    frame = spark.createDataFrame([(10, 14), (1, 8), (3, 8), (1, 200), (3, 200), (1, 1)], "n int, t int")
    percent = labels.share_percent(F.col("n"), F.col("t"))
    rows = frame.select("n", "t", labels.whole_percent(percent).alias("p"), labels.share_bar(percent).alias("b")).collect()
    got = {(r.n, r.t): (r.p, r.b) for r in rows}
    assert got[10, 14] == (71, "#" * 11 + "-" * 4)
    assert got[1, 8][0] == 12 and got[3, 8][0] == 38  # ties go to the even number
    assert got[1, 1] == (100, "#" * 15)
    assert got[1, 200][0] == 0 and got[3, 200][0] == 2
