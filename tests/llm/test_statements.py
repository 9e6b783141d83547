"""Statements of the operators on documents, also on odd rows and with limits that split small tables."""

from __future__ import annotations

from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from arborlake.llm import line_dedup, mixing, oracle, sharding

from .conftest import DOCUMENTS

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def odd(llm_spark, odd_rows):
    return llm_spark.createDataFrame(odd_rows, DOCUMENTS)


@pytest.fixture(scope="module")
def odd_file(odd, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("odd") / "documents")
    odd.write.parquet(folder)
    return folder


def agrees(df, files, statement):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{files}'")
    said = Counter(con.execute(f"SELECT {', '.join(df.columns)} FROM ({statement})").fetchall())
    found = Counter(tuple(r) for r in df.collect())
    assert found == said, (list((found - said).items())[:3], list((said - found).items())[:3])
    return found


def both(spark, odd, odd_file):
    yield spark.read.parquet(f"{SMALL}/documents.parquet"), f"{SMALL}/documents.parquet"
    yield odd, f"{odd_file}/*.parquet"


@pytest.mark.parametrize("limit", [1, 900, 20_000, 64 << 20])
def test_shards(llm_spark, odd, odd_file, limit):
    for df, files in both(llm_spark, odd, odd_file):
        found = agrees(sharding.assigned(df, limit), files, oracle.sharding(limit))
        assert limit > 900 or len({r[2:5] for r in found}) > 4


def test_mixes(llm_spark, odd, odd_file):
    for df, files in both(llm_spark, odd, odd_file):
        agrees(mixing.mixed(df), files, oracle.STATEMENTS["op3_mixing"])


def test_lines(llm_spark, odd, odd_file):
    for df, files in both(llm_spark, odd, odd_file):
        found = line_dedup.removed_lines(df).withColumn("removed", F.array_join("removed", ","))
        assert any(r[2] for r in agrees(found, files, oracle.STATEMENTS["op8_line_dedup"]))
