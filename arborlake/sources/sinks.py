"""Writing ordered rows as text."""

from __future__ import annotations

from pyspark.sql import DataFrame


def write_listing(rows: DataFrame, location: str, *order: str, mode: str = "error") -> None:
    """Write ``line`` as text, one folder per corpus, in the given order.

    Rows are range-partitioned on corpus and order, so a large corpus spans many
    tasks; reading the part files of a corpus by name gives its document.
    """
    keys = ["corpus_id", *order]
    (
        rows.repartitionByRange(*keys)
        .sortWithinPartitions(*keys)
        .select("corpus_id", "line")
        .write.partitionBy("corpus_id")
        .mode(mode)
        .text(location)
    )
