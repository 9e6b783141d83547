"""Manifests that name their contents."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F
from test_listing import PROJECT, document

from arborlake.functions.classify import COUNT_LIMIT_BYTES
from arborlake.operators import stats
from arborlake.plans.jobs import Options, annotated_listing, plain_listing
from arborlake.sources import contents
from arborlake.sources.contents import Places, refer_contents, with_contents


@pytest.fixture
def folder(tmp_path):
    return f"file:{tmp_path}/held"


def by_path(frame):
    return {r.path: r for r in frame.collect()}


def test_named_contents_come_back(tree, folder):
    files = {"a b/%41.txt": "x\n", ".hidden": "h", "empty": "", "copy": "x\n", "n.gz": "not packed", "d/": ""}
    named = refer_contents(tree(files), folder)
    assert "content" not in named.columns
    again = by_path(refer_contents(tree(files), folder))
    assert {p: r.content_uri for p, r in again.items()} == {p: r.content_uri for p, r in by_path(named).items()}
    found = by_path(with_contents(named.drop("size_bytes")))
    assert {p: None if r.content is None else bytes(r.content).decode() for p, r in found.items()} == {**{p: c for p, c in files.items() if p != "d/"}, "d": None}
    assert found["a b/%41.txt"].size_bytes == 2 and found["empty"].size_bytes == 0 and found["d"].size_bytes is None
    assert found["copy"].content_uri == found["a b/%41.txt"].content_uri


def test_only_wanted_files_are_read(tree, folder):
    named = refer_contents(tree({"a.py": "1", "b.png": "22", "c.py": "333"}), folder)
    wanted = F.endswith("path", F.lit(".py"))
    found = by_path(with_contents(named.withColumn("size_bytes", F.lit(None).cast("bigint")), wanted, largest=2))
    assert {p: (r.content and bytes(r.content), r.size_bytes) for p, r in found.items()} == {
        "a.py": (b"1", 1), "b.png": (None, 2), "c.py": (None, 3)
    }
    # sizes of the manifest are believed, and a file that is not asked for need not exist
    gone = named.withColumn("content_uri", F.lit("/no/such/file"))
    assert {r.size_bytes for r in with_contents(gone, F.lit(False)).collect()} == {1, 2, 3}


def test_missing_files_nulls_and_held_contents(spark, tree, folder, tmp_path):
    schema = "corpus_id string, path string, is_dir boolean, size_bytes bigint, content binary, content_uri string"
    rows = [
        ("c", "gone", False, None, None, f"{tmp_path}/gone"),
        ("c", "folder", None, None, None, str(tmp_path)),
        ("c", "none", False, None, None, None),
        ("c", "held", False, 4, bytearray(b"held"), f"{tmp_path}/gone"),
        (None, None, False, None, None, f"{tmp_path}/gone"),
    ]
    found = by_path(with_contents(spark.createDataFrame(rows, schema)))
    assert len(found) == 5 and bytes(found.pop("held").content) == b"held"
    assert all(r.content is None and r.size_bytes is None for r in found.values())
    empty = spark.createDataFrame([], schema)
    assert with_contents(empty).count() == 0 and refer_contents(tree({}), folder).count() == 0


def test_tasks_get_a_bounded_share(tree, folder, monkeypatch):
    named = refer_contents(tree({f"f{k}": f"{k % 3}" for k in range(40)}), folder)
    monkeypatch.setattr(contents, "TASK_FILES", 2)
    monkeypatch.setattr(contents, "BATCH_BYTES", 1)
    found = with_contents(named)
    per_task = found.groupBy(F.spark_partition_id()).count().collect()
    assert found.rdd.getNumPartitions() >= 20 and max(r["count"] for r in per_task) < 20
    assert sorted(bytes(r.content) for r in found.collect()) == sorted(str(k % 3).encode() for k in range(40))


def test_places_by_scheme(tmp_path):
    (tmp_path / "x").write_bytes(b"1")
    places = Places()
    for uri in (f"{tmp_path}/x", f"file:{tmp_path}/x", f"file://{tmp_path}/x", f"nowhere://host{tmp_path}/x"):
        if uri.startswith("nowhere"):
            with pytest.raises(Exception):  # noqa: B017
                places.read(uri, True, 10)
        else:
            assert places.read(uri, True, 10) == (b"1", 1)
    assert places.read(f"{tmp_path}/x", True, 0) == (None, 1)


def test_jobs_on_named_contents(tree, folder):
    files = {**PROJECT, ".git/HEAD": "ref", ".gitignore": "*.tmp\n", "k.tmp": "t", "p.png": "\0"}
    held = tree(files, binary=True)
    named = refer_contents(held, folder).drop("size_bytes")
    options = Options(stats="full", contents=True, max_bytes=200)
    assert document(plain_listing(named, options)) == document(plain_listing(held, options))
    marked = Options(loc="off", stats="off", charset="unicode")
    assert document(annotated_listing(named, marked)) == document(annotated_listing(held, marked))


def test_lost_and_uncounted_files_are_not_read(tree, folder, monkeypatch):
    files = {".git/HEAD": "ref", ".gitignore": "*.tmp\n", "k.tmp": "t", "p.png": "\0", "a.py": "1\n"}
    named = refer_contents(tree(files, binary=True), folder)
    # whatever is not wanted may lie anywhere
    broken = F.when(F.col("path").isin("k.tmp", "p.png"), F.lit("nowhere://x/y")).otherwise(F.col("content_uri"))
    shown = document(plain_listing(named.withColumn("content_uri", broken), Options(stats="off", contents=True)))
    assert [x for x in shown if "a.py" in x] and not [x for x in shown if "k.tmp" in x]
    large = named.withColumn("size_bytes", F.lit(COUNT_LIMIT_BYTES + 1)).withColumn("content_uri", F.lit("nowhere://x/y"))
    assert document(plain_listing(large, Options(stats="off", ignore_mode="never")))[-1] == "└── p.png"


def test_counts_per_label_are_not_sorted(spark):
    rows = [("c", "Rust", f"f{k}.rs", "R", k) for k in range(9)] + [("c", "Py", "b.py", "P", 1), ("c", "Py", "a/z.pyw", "W", None)]
    files = spark.createDataFrame(rows, "corpus_id string, file_type string, path string, label string, loc bigint")
    found = {(r.file_type, r.n_files, r["loc"], r.label) for r in stats.type_counts(files).collect()}
    assert found == {("Rust", 9, 36, "R"), ("Py", 2, 1, "W")}
    agreed = stats.type_counts(files.where("file_type = 'Rust'"))
    assert agreed.count() == 1
    nothing = files.withColumn("label", F.when(F.col("path") != "a/z.pyw", F.col("label")))
    assert {r.label for r in stats.type_counts(nothing).collect()} == {"R", None}
