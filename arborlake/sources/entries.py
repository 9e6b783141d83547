"""Reading entries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arborlake.functions.paths import relative_to
from arborlake.operators.inventory import walkable, with_entry_defaults
from arborlake.schema import ENTRIES


def read_manifest(spark: SparkSession, location: str, source: str = "parquet") -> DataFrame:
    """Entries of any table with the canonical columns; optional ones are filled."""
    return with_entry_defaults(spark.read.format(source).load(location))


def read_tree(spark: SparkSession, root: str, corpus_id: str) -> DataFrame:
    """Entries of a stored tree, listed and read by Spark.

    Spark's file index skips names that start with ``.`` or ``_``; where those
    matter, list the tree into a manifest. Directories without files are not seen.
    """
    uri = root if "://" in root else f"file:{root}"
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    )
    below = F.coalesce(relative_to(F.col("path"), uri), relative_to(F.col("path"), uri + "//"))
    return (
        files.select(
            F.lit(corpus_id).alias("corpus_id"),
            below.alias("path"),
            F.lit(False).alias("is_dir"),
            F.col("length").alias("size_bytes"),
            "content",
            F.lit(False).alias("is_symlink"),
        )
        .where(F.col("path").isNotNull())
        .to(ENTRIES)
    )


def below_root(entries: DataFrame, root: str) -> DataFrame:
    """Entries with absolute paths, made relative to a root; the others are dropped."""
    return (
        entries.withColumn("path", relative_to(F.col("path"), root))
        .where(F.col("path").isNotNull() & (F.col("path") != ""))
    )


def with_size(entries: DataFrame) -> DataFrame:
    """Fill ``size_bytes`` from the content where the manifest has none; else 0."""
    known = F.col("size_bytes") if "size_bytes" in entries.columns else F.lit(None).cast("bigint")
    measured = F.octet_length("content") if "content" in entries.columns else F.lit(None)
    return entries.withColumn("size_bytes", F.coalesce(known, measured, F.lit(0)).cast("bigint"))


def regular_files(entries: DataFrame) -> DataFrame:
    """File rows a walk visits."""
    return walkable(entries).where(~F.col("is_dir"))
