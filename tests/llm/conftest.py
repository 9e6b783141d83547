from __future__ import annotations

import pytest
from pyspark.sql import SparkSession


@pytest.fixture(scope="session")
def llm_spark(tmp_path_factory):
    folder = tmp_path_factory.mktemp("llm")
    spark = (
        SparkSession.builder.master("local[4]")
        .appName("llm-tests")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.warehouse.dir", str(folder / "warehouse"))
        .getOrCreate()
    )
    return spark


DOCUMENTS = "doc_id bigint, text string, lang string, source string, n_chars bigint, score double, bytes bigint, `key` string"


@pytest.fixture(scope="session")
def odd_rows():
    """NULLs in any column, empty and long texts, ties, repeated rows, clashing names."""
    base = " ".join(f"w{k}" for k in range(60))
    long = " ".join(f"v{k % 5000}" for k in range(20000))
    texts = [base, base, base.replace("w30", "x"), None, "", "  \n \t", "One two", "one TWO", "solo", long, long + " tail", base + "\n" + base]
    rows = [(k, t, "en" if k % 3 else None, f"s{k % 4}" if k % 5 else None, len(t or ""), 1.0, 7, "k") for k, t in enumerate(texts)]
    return rows + [rows[0], rows[6], (None, base, None, None, None, None, None, None), (None, None, None, None, None, None, None, None)]
