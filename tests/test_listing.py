"""Tree rows, statistics, outliers, whole jobs, sinks and streams."""

from __future__ import annotations

import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from arborlake.functions.classify import file_type, with_label
from arborlake.operators import inventory, layout, stats
from arborlake.operators.ignore import layers_from_files
from arborlake.operators.selection import SelectionRules
from arborlake.plans.jobs import Options, annotated_listing, plain_listing
from arborlake.sources.entries import below_root, read_manifest, read_tree, with_size
from arborlake.sources.sinks import write_listing
from arborlake.streaming import classify_stream


def listed(tree, files, corpus_id="c"):
    return inventory.all_entries(inventory.walkable(tree(files, corpus_id)))


def lines(frame):
    return [r.line for r in frame.orderBy("corpus_id", "sort_key").collect()]


def draw(paths):
    """The listing, from a nested dictionary."""
    root: dict = {}
    for path in paths:
        node = root
        *dirs, name = path.rstrip("/").split("/")
        for part in dirs:
            node = node.setdefault(part, {})
        node.setdefault(name, {} if path.endswith("/") else None)

    def walk(node, prefix):
        ordered = sorted(node.items(), key=lambda item: (item[1] is None, item[0].encode()))
        for i, (name, below) in enumerate(ordered):
            last = i == len(ordered) - 1
            yield prefix + ("└── " if last else "├── ") + name + ("" if below is None else "/")
            if below:
                yield from walk(below, prefix + ("    " if last else "│   "))

    return [".", *walk(root, "")]


def test_tree_rows(tree):
    files = ["b.txt", "a/x/y.rs", "a/z.rs", "a-b/q", "a.txt", "e/", "é/ü"]
    assert lines(layout.tree_lines(listed(tree, files))) == draw(files)


def test_random_trees(tree):
    rng = random.Random(5)
    names = ["a", "b", "a-", "a.b", "B", "é", "_"]
    for _ in range(4):
        paths = {"/".join(rng.choice(names) + f"{d}" for d in range(rng.randint(1, 5))) for _ in range(25)}
        paths = {p + "/f" for p in paths} | {p + f"/{rng.choice(names)}.x" for p in paths}
        assert lines(layout.tree_lines(listed(tree, sorted(paths)))) == draw(sorted(paths))


@pytest.mark.parametrize(
    "bounds",
    [
        {"BROADCAST_ROWS": -1},  # plain shuffled joins: no key is above the floor
        {"BROADCAST_ROWS": -1, "HOT_FLOOR": 2},  # hot keys salted
        {"BROADCAST_ROWS": 3, "HOT_FLOOR": 2, "HOT_KEYS": 2},  # hot keys broadcast
    ],
)
def test_joins_beyond_the_broadcast_bounds_give_the_same_rows(tree, monkeypatch, bounds):
    from arborlake.operators import scratch
    from arborlake.operators.packing import pack
    from arborlake.operators.selection import select_entries

    files = {f"d{i % 3}/e{i % 2}/f{i}.rs": "x\ny\n" for i in range(20)}
    files |= {"d1/.git": "", "d2/lib/.git": "", "g/x.log": "", "v/": None, ".gitignore": "e1/\n*3.rs\n"}
    entries = tree(files).unionByName(tree({"a/b": "q", "c": "r"}, "other"))

    def results():
        decided = with_ignore_layers(entries)
        packed = pack(entries.where("not is_dir"), 30).select("corpus_id", "path", "n", "section")
        return (
            lines(layout.tree_lines(listed(tree, files))),
            sorted(map(tuple, decided.collect())),
            sorted(map(tuple, packed.collect())),
        )

    def with_ignore_layers(entries):
        return select_entries(entries, SelectionRules(), layers=layers_from_files(entries))

    want = results()
    assert want[0] == draw(files)
    for name, value in bounds.items():
        monkeypatch.setattr(scratch, name, value)
    assert results() == want


def test_charsets_and_line_counts(tree):
    entries = listed(tree, ["a/b", "c"]).withColumn("loc", F.when(F.col("path") == "c", 7).cast("bigint"))
    assert lines(layout.tree_lines(entries, "ascii")) == [".", "|-- a/", "|   `-- b", "`-- c  (7 lines)"]
    assert lines(layout.tree_lines(entries, "unicode")) == [".", "├─ a/", "│  └─ b", "└─ c  (7 lines)"]


def test_totals_count_the_root_and_null_loc(tree):
    files = ["src/models/a.rs", "src/controllers/", "tests/b.rs"]
    entries = listed(tree, files).withColumn("loc", F.lit(None).cast("bigint"))
    row = stats.corpus_totals(entries).first()
    assert (row.n_dirs, row.n_files, row.loc) == (5, 2, None)


def test_breakdown_shares_and_ties(tree):
    names = [f"{i}.rs" for i in range(10)] + [f"{i}.py" for i in range(3)] + ["a.js"]
    files = listed(tree, names).withColumn("file_type", file_type(F.col("path")))
    rows = stats.type_breakdown(files).orderBy("rank").collect()
    assert [(r.type_name, r.n_files, r.share) for r in rows] == [("Rust", 10, 71), ("Python", 3, 21), ("JavaScript", 1, 7)]
    many = ["a.rs", "a.py", "a.go", "a.js", "a.ts", "a.java", "a.cs", "a.c", "a.rb", "a.sh"]
    tied = listed(tree, many).withColumn("file_type", file_type(F.col("path")))
    got = [r.file_type for r in stats.type_breakdown(tied).orderBy("rank").collect()]
    assert len(got) == 8 and got == sorted(got)


def test_top_extensions(tree):
    names = ["a.RS", "b.rs", "c.md", "d.py", "e.go", "f.ts", "g.js", "h", ".env", "i"]
    rows = stats.top_extensions(tree(names)).orderBy("rank").collect()
    assert [r.shown for r in rows] == ["no-ext(3)", "rs(2)", "go(1)", "js(1)", "md(1)"]


@pytest.mark.parametrize("n", [0, 1, 19, 20, 21, 40, 200, 250])
def test_outlier_threshold(spark, n):
    rng = random.Random(n)
    counts = [rng.randint(0, 50) for _ in range(n)]
    rows = [("c", f"f{i}", v) for i, v in enumerate(counts)] + [("c", "none", None), ("d", "x", None)]
    files = spark.createDataFrame(rows, "corpus_id string, path string, loc bigint")
    got = {r.path: r.outlier for r in stats.with_outlier(files).where("corpus_id = 'c'").collect()}
    k = min(-(-n // 20), 10, n)
    limit = sorted(counts, reverse=True)[k - 1] if n else None
    assert got == {f"f{i}": v >= limit for i, v in enumerate(counts)} | {"none": False}


def test_child_counts_and_empty_directories(tree):
    entries = listed(tree, {"a/b": "", "a/c/d": "", "e/": None, "f": ""})
    got = {(r.parent, r.n_files, r.n_dirs) for r in inventory.child_counts(entries).collect()}
    assert got == {("", 1, 2), ("a", 1, 1), ("a/c", 1, 0)}
    assert [r.path for r in inventory.empty_directories(entries).collect()] == ["e"]
    own = {r.path: (r.n_files, r.n_dirs) for r in inventory.attach_to_parent(entries).collect()}
    assert own == {"a": (1, 1), "a/c": (1, 0), "e": (0, 0)}


def test_name_width_counts_bytes(tree):
    assert stats.name_width(tree(["x/é.rs", "y"])).first().name_width == 15


def test_first_label_of_a_type_in_listing_order(tree, spark):
    files = listed(tree, ["z.py", "b/q.pyw"]).where("not is_dir").withColumn("file_type", file_type(F.col("path")))
    labels = spark.createDataFrame([("ext", "pyw", "W")], "kind string, key string, label string")
    row = stats.type_counts(with_label(files, labels)).first()
    assert row.label == "W"


def document(rows):
    return [r.line for r in rows.orderBy("corpus_id", "block", "sort_key").collect()]


PROJECT = {
    "src/main.rs": "fn main() {\n    run();\n}\n",
    "src/lib.rs": "pub fn run() {}\n",
    "README.md": "# T\n",
    "node_modules/x/i.js": "x\n",
    ".env": "SECRET\n",
    "Cargo.lock": "v\n",
    "sub/.git": "gitdir\n",
    "sub/code.rs": "no\n",
}


def test_plain_listing_document(tree):
    rows = plain_listing(tree(PROJECT), Options(stats="full", contents=True))
    assert document(rows) == [
        ".",
        "├── src/",
        "│   ├── lib.rs  (1 lines)",
        "│   └── main.rs  (3 lines)",
        "├── Cargo.lock",
        "└── README.md  (1 lines)",
        "",
        "**Totals**: 📂 2 dirs • 📄 4 files • 🧾 ~5 LOC",
        "",
        "**By type**:",
        "- Rust: 2 (50%) ########-------",
        "- Lock: 1 (25%) ####-----------",
        "- Markdown: 1 (25%) ####-----------",
        "\n## src/lib.rs\n\n```rust\npub fn run() {}\n```",
        "\n## src/main.rs\n\n```rust\nfn main() {\n    run();\n}\n```",
        "\n## README.md\n\n```markdown\n# T\n```",
    ]


def test_plain_listing_options(tree):
    rows = plain_listing(tree(PROJECT), Options(stats="off", loc="off", rules=SelectionRules(max_depth=1)))
    # The repository at depth 1 is met, so directories left empty go.
    assert document(rows) == [".", "├── Cargo.lock", "└── README.md"]
    rows = plain_listing(tree(PROJECT), Options(stats="min", loc="off"))
    assert document(rows)[-1] == "**Stats**: 📂 2 dirs • 📄 4 files"
    with pytest.raises(ValueError):
        Options(max_bytes=10)


def test_annotated_listing(tree):
    files = {"a/big.rs": "x\n" * 40, "a/small.rs": "x\n" * 20, "b.md": "x\n"}
    rows = annotated_listing(tree(files), Options(stats="off", charset="unicode"), show_labels=True)
    assert document(rows) == [
        "├─ 📁 a/",
        "│  ├─ 🦀 big.rs  [██████████]  40  (S) ★",
        "│  └─ 🦀 small.rs  [█████·····]  20  (S)",
        "└─ 📘 b.md  [··········]  1  (XS)",
    ]


def test_sink_keeps_the_order(tree, tmp_path):
    rows = plain_listing(tree(PROJECT), Options(stats="min", contents=True, max_bytes=30))
    target = str(tmp_path / "out")
    write_listing(rows, target, "block", "sort_key")
    parts = sorted(Path(target).glob("corpus_id=c/part-*"))
    written = "".join(p.read_text() for p in parts)
    assert written == "".join(line + "\n" for line in document(rows))


def test_sources(spark, tmp_path, tree):
    root = tmp_path / "tree"
    (root / "a").mkdir(parents=True)
    (root / "a" / "x.rs").write_text("hello\n")
    (root / "y").write_bytes(b"\x00\xff")
    got = {(r.path, r.size_bytes) for r in read_tree(spark, str(root), "c").collect()}
    assert got == {("a/x.rs", 6), ("y", 2)}
    manifest = str(tmp_path / "manifest")
    spark.createDataFrame([("c", "a/"), ("c", "a/b")], "corpus_id string, path string").write.parquet(manifest)
    back = {(r.path, r.is_dir, r.is_symlink) for r in read_manifest(spark, manifest).collect()}
    assert back == {("a", True, False), ("a/b", False, False)}
    placed = spark.createDataFrame([("/r/a",), ("/r",), ("/q/a",)], "path string")
    assert [r.path for r in below_root(placed, "/r").collect()] == ["a"]
    sized = with_size(tree({"é": "é"}).withColumn("size_bytes", F.lit(None).cast("bigint")))
    assert sized.first().size_bytes == 2


def test_row_local_work_on_a_stream(spark, tmp_path, tree):
    source, sink = str(tmp_path / "in"), str(tmp_path / "out")
    files = tree({"a.rs": "x\ny\n", "b.log": "z", "vendor/c.py": "q"})
    files.write.parquet(source)
    stream = classify_stream(spark.readStream.schema(files.schema).parquet(source), SelectionRules())
    query = (
        stream.writeStream.format("parquet")
        .option("checkpointLocation", str(tmp_path / "state"))
        .trigger(availableNow=True)
        .start(sink)
    )
    assert query.awaitTermination(120)
    got = {(r.path, r.decision, r.reason, r.file_type, r.loc) for r in spark.read.parquet(sink).collect()}
    assert got == {
        ("a.rs", "include", "default", "Rust", 2),
        ("b.log", "exclude", "unsafe", "Unknown", 1),
        ("vendor/c.py", "exclude", "under_pruned_dir", "Python", 1),
    }
