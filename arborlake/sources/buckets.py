"""Entries stored in buckets of their key, so that contents stay where they are.

A job that loses files to data-dependent rules, or cuts them by parameters that outgrow the
broadcast bounds, joins contents on ``(corpus_id, path)``. Stored in buckets of that key,
contents are read in its partitioning and only the narrow side of such a join is shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

KEY = ("corpus_id", "path")


def store_entries(entries: DataFrame, table: str, buckets: int, location: str | None = None) -> DataFrame:
    """Write entries as a table of ``buckets`` buckets, sorted by key, and return it.

    ``location`` must be storage that all executors reach; without it the warehouse is used.
    Take as many buckets as a shuffle of the contents would have partitions. Rows are dealt by
    the buckets before they are written, so that each bucket is one file.
    """
    dealt = entries.repartition(buckets, *KEY).write.bucketBy(buckets, *KEY).sortBy(*KEY).format("parquet")
    if location is not None:
        dealt = dealt.option("path", location)
    dealt.mode("errorifexists").saveAsTable(table)
    return stored_entries(entries.sparkSession, table)


def stored_entries(spark: SparkSession, table: str) -> DataFrame:
    return spark.table(table)
