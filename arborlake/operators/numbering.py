"""Line numbers of ordered rows without a window over all rows of a corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from arborlake.operators.scratch import lookup, materialize

#: Bits that hold the place of a row in its partition.
_LOCAL_BITS = 33


def numbered(rows: DataFrame, *order: str) -> DataFrame:
    """Replace nothing and add ``seq``: 1, 2, ... within each corpus in the given order.

    Rows are dealt to range partitions of corpus and order, sorted and written once with
    their place. What a partition holds of a corpus is counted, and the counts before it are
    summed; that table has about as many rows as there are partitions and corpora, so a corpus
    with any share of the rows is numbered by all tasks.
    """
    keys = ["corpus_id", *order]
    dealt = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id())
    written = materialize(dealt, "numbered").withColumns(
        {"_part": F.shiftright("_at", _LOCAL_BITS).cast("int"), "_local": F.col("_at").bitwiseAND((1 << _LOCAL_BITS) - 1)}
    )
    counts = written.groupBy("corpus_id", "_part").agg(F.count(F.lit(1)).alias("_n"), F.min("_local").alias("_first"))
    before = F.sum("_n").over(W.partitionBy("corpus_id").orderBy("_part").rowsBetween(W.unboundedPreceding, -1))
    shift = counts.select("corpus_id", "_part", (F.coalesce(before, F.lit(0)) - F.col("_first") + 1).alias("_shift"))
    shift = materialize(shift, "shifts")
    joined = lookup(written, shift, ["corpus_id", "_part"], F.col("_at"), "inner")
    return joined.withColumn("seq", F.col("_local") + F.col("_shift")).select(*rows.columns, "seq")
