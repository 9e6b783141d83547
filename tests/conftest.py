from __future__ import annotations

import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
sys.path.insert(0, str(ROOT / "tests"))

from pyspark.sql import SparkSession  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[8]")
        .appName("arborlake-tests")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "6g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def tree(spark):
    """Build entries from ``{path: content}``; a path with a final slash is a directory."""

    def build(files, corpus_id="c", binary=False):
        if not isinstance(files, dict):
            files = {path: "" for path in files}
        rows = []
        for path, content in files.items():
            is_dir = path.endswith("/")
            if binary and isinstance(content, str):
                content = content.encode()
            size = None if is_dir else len(content if binary else content.encode())
            rows.append(
                (corpus_id, path.rstrip("/"), is_dir, size, None if is_dir else content, False)
            )
        kind = "binary" if binary else "string"
        return spark.createDataFrame(
            rows,
            f"corpus_id string, path string, is_dir boolean, size_bytes bigint, content {kind},"
            " is_symlink boolean",
        )

    return build


def kept(selected, dirs=False):
    """Paths that a selection keeps."""
    rows = selected.where("decision = 'include'").select("path", "is_dir").collect()
    return {r.path for r in rows if r.is_dir == dirs}
