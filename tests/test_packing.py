"""Budget search, cuts and sections, against fixed cases and the model."""

from __future__ import annotations

import random

import model
import pytest
from pyspark.sql import functions as F

from arborlake.operators import packing


def packed(files, budget=None, mode="head"):
    rows = packing.pack(files, budget, mode).collect()
    return {(r.corpus_id, r.path): r for r in rows}


def fence(path, lang, body):
    return f"\n## {path}\n\n```{lang}\n{body}```\n"


def test_sections_and_languages(tree):
    files = {
        "main.rs": "fn main() {}\n", "README.md": "# T", "a.py": "", "c.toml": "x=1\n", "d.json": "{}\n",
        "logo.png": "zz", "Cargo.lock": "v", "plain": "p\n",
    }
    got = {path: r.section for (_, path), r in packed(tree(files)).items()}
    assert got == {
        "main.rs": fence("main.rs", "rust", "fn main() {}\n"),
        "README.md": fence("README.md", "markdown", "# T\n"),
        "a.py": fence("a.py", "python", "\n"),
        "c.toml": fence("c.toml", "toml", "x=1\n"),
        "d.json": fence("d.json", "json", "{}\n"),
        "plain": fence("plain", "", "p\n"),
    }


def test_sections_follow_the_listing_order(tree):
    frame = packing.pack(tree({"b.rs": "1", "z/a.rs": "2", "a.rs": "3", "z/y/c.rs": "4"}))
    order = [r.path for r in frame.orderBy("sort_key").collect()]
    assert order == ["z/y/c.rs", "z/a.rs", "a.rs", "b.rs"]


def test_invalid_utf8_has_no_section(tree):
    got = packed(tree({"a.rs": b"ok\n", "b.rs": b"\xff\xfe"}, binary=True))
    assert [path for _, path in got] == ["a.rs"]


def test_head_examples(tree):
    got = packed(tree({"a.rs": "aaaa\nbbbb\ncccc", "b.rs": "dddd\neeee\nffff"}), 20)
    assert {r.n for r in got.values()} == {2}
    assert got["c", "a.rs"].section == fence("a.rs", "rust", "aaaa\nbbbb\n... (1 lines omitted)\n")
    got = packed(tree({"a": "a1\na2\na3\na4\na5\n", "b": "b1\nb2\nb3\nb4\nb5\n"}), 12)
    assert {(r.n, r.omitted) for r in got.values()} == {(2, 3)}


def test_zero_budget_keeps_empty_heads(tree):
    got = packed(tree({"a": "x\ny\n"}), 0)
    assert got["c", "a"].n == 0 and got["c", "a"].omitted == 2


def test_nest_is_not_monotone(tree):
    text = "a\n b\n  c\n b\n"  # 11, 21, 15 bytes at depths 2, 1, 0; 12 as it is
    assert [model.size(model.fold(text, d)[0]) for d in (2, 1, 0)] == [11, 21, 15]
    row = packed(tree({"a": text}), 11, "nest")["c", "a"]
    assert (row.method, row.n, row.omitted) == ("nest", 2, 0)
    longer = "a\n b\n  c\n b\nlonger than all the others\n"
    budget = model.size(model.fold(longer, 2)[0]) - 1
    assert model.best_depth([longer], budget) is None


def test_nest_falls_back_to_head(tree):
    row = packed(tree({"a": "a" * 1000}), 10, "nest")["c", "a"]
    assert (row.method, row.n, row.omitted) == ("head", 0, 1)


def test_nest_prints_marker_and_footer(tree):
    text = "fn main() {\n    let x = 1234567;\n    let y = 2345678;\n}\n"
    row = packed(tree({"a.rs": text}), 40, "nest")["c", "a.rs"]
    assert row.n == 3
    body = "fn main() {\n... (2 lines)\n}\n... (2 lines omitted)\n"
    assert row.section == fence("a.rs", "rust", body)


@pytest.mark.parametrize(
    "text",
    [
        "", "\n", "\n\n\nx", "\n\n   y\n", "a\n\n  b\n\n  c\n", "  x\n  y\nz", "\t\n\tq\n", " é\n  ü\n", "a\r\n  b\r\nc\r\n",
        "h\n" + "  x\n" * 9 + "e\n", "h\n" + "  x\n" * 10 + "e\n", "  x\n" * 99, "  x\n" * 100 + "y", " 1\n  2\n" * 60,
        "h\n" + "  x\n" * 1005 + "    y\n" * 12 + "e",
    ],
)
def test_fold_and_sizes_match_the_model(spark, text):
    """Folded text at every depth, and the step function the search relies on."""
    depths = sorted({model.depth_of(row) for row in model.split_lines(text)} | {0, 1, 2, 3})
    frame = spark.createDataFrame([("c", text)], "corpus_id string, text string")
    lined = packing.with_lines(frame.crossJoin(spark.createDataFrame([(d,) for d in depths], "depth int")))
    got = {r.depth: tuple(r.fold) for r in packing.with_folded(lined, "depth").collect()}
    assert got == {d: model.fold(text, d) for d in depths}
    steps = packing.budget_steps(frame, 10**6, "nest").where("kind = 'nest'").collect()
    for d in depths:
        assert sum(r.delta for r in steps if r.pos <= d) == model.size(model.fold(text, d)[0])


def random_text(rng: random.Random) -> str:
    rows = []
    for _ in range(rng.choice([0, 1, 3, 8, 25, 120])):
        kind = rng.random()
        if kind < 0.15:
            rows.append(rng.choice(["", "", "  ", "\t"]))
        else:
            pad = rng.choice(["", " ", "  ", "    ", "        ", "\t", " ", "　 "])
            rows += [pad + rng.choice(["x", "längere", "yy zz", "…"])] * rng.choice([1, 1, 2, 11])
    end = rng.choice(["\n", "\r\n"])
    return end.join(rows) + rng.choice(["", end])


@pytest.mark.parametrize("mode", ["head", "nest"])
def test_random_corpora_match_the_model(spark, mode):
    """Many corpora share one budget, so that all three methods occur."""
    rng = random.Random(f"seed-{mode}")
    corpora = {f"c{i}": [random_text(rng) for _ in range(rng.randint(1, 5))] for i in range(150)}
    rows = [
        (corpus, f"f{i}", False, text) for corpus, texts in corpora.items() for i, text in enumerate(texts)
    ]
    files = spark.createDataFrame(rows, "corpus_id string, path string, is_dir boolean, content string")
    methods = set()
    for budget in (0, 60, 400, 1500):
        got = packed(files, budget, mode)
        for corpus, texts in corpora.items():
            method, n, cuts = model.pack(texts, budget, mode)
            methods.add(method)
            for i, (text, left_out) in enumerate(cuts):
                row = got[corpus, f"f{i}"]
                assert (row.method, row.n, row.omitted) == (method, n, left_out), (corpus, budget)
                note = f"... ({left_out} lines omitted)\n" if left_out else ""
                closed = text if text.endswith("\n") else text + "\n"
                assert row.section == fence(f"f{i}", "", closed + note)
    assert methods == ({"full", "head"} if mode == "head" else {"full", "head", "nest"})


def test_arguments(tree):
    files = tree({"a": "x"})
    with pytest.raises(ValueError):
        packing.pack(files, 10, "tail")
    with pytest.raises(ValueError):
        packing.pack(files, -1)
    with pytest.raises(ValueError):
        packing.check_budget(contents=False, max_bytes=10)


def test_fence_and_display_are_parameters(tree):
    shown = F.concat(F.lit("root/"), F.col("path"))
    row = packing.pack(tree({"a.rs": "x\n"}), fence="~~~", display=shown).first()
    assert row.section == "\n## root/a.rs\n\n~~~rust\nx\n~~~\n"
