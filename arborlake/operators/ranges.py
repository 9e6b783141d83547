"""Entries below marked directories, found by one ordered sweep.

A directory ``d`` and all that lies below it are the keys from ``d/`` up to ``d0``, the
character after the separator, in the order of bytes. Entries and marks are dealt to range
partitions of that order and swept once; no ancestor of an entry is ever listed. A range that
is open where a partition begins is found from the partition's first key alone and applied to
the partition afterwards, so a directory may hold any share of a corpus.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arborlake.functions.paths import ancestors_of
from arborlake.operators.scratch import materialize

#: The code of an entry below a marked directory; marks have smaller ones.
BELOW = 3


def place_of(path: Column, is_dir: Column) -> Column:
    """The key by which entries are ordered: a directory comes right before its content."""
    return F.when(is_dir, F.concat(path, F.lit("/"))).otherwise(path)


def _swept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Codes from the marks of the partition; ``batches`` are in order, marks first."""
    held = own = None
    code = 0
    for batch in batches:
        codes = []
        columns = (batch.column(n).to_pylist() for n in ("corpus_id", "place", "mark"))
        for corpus, place, mark in zip(*columns, strict=True):
            inside = held is not None and held[0] == corpus and place.startswith(held[1])
            if mark is not None:
                # a mark inside an open range adds nothing to it
                own, code = ((corpus, place), mark) if not inside else (None, 0)
                if not inside and place.endswith("/"):
                    held = (corpus, place)
                codes.append(None)
            elif (corpus, place) == own:
                codes.append(code)
            else:
                codes.append(BELOW if inside else 0)
        made = pa.array(codes, pa.int32())
        keep = made.is_valid()
        at = batch.schema.get_field_index("mark")
        yield batch.set_column(at, "code", made).filter(keep)


def with_codes(entries: DataFrame, marks: DataFrame) -> DataFrame:
    """Add ``code``: that of the entry's own mark, ``BELOW`` under a marked directory, else 0.

    ``entries`` has ``corpus_id``, ``path`` and ``is_dir``; ``marks`` is a materialized table
    ``(corpus_id, path, is_dir, code)`` with one row for each marked entry.
    """
    path, is_dir = F.col("path"), F.col("is_dir")
    keyed = entries.withColumn("place", place_of(path, is_dir)).withColumn("mark", F.lit(None).cast("int"))
    marked = marks.select("corpus_id", place_of(path, is_dir).alias("place"), F.col("code").cast("int").alias("mark"))
    order = ["corpus_id", "place"]
    sorted_rows = (
        keyed.unionByName(marked, allowMissingColumns=True)
        .repartitionByRange(*order)
        .sortWithinPartitions(*order, F.col("mark").desc_nulls_last())
    )
    dealt = sorted_rows.withColumn("part", F.spark_partition_id())
    fields = [f for f in dealt.schema.fields if f.name != "mark"]
    at = dealt.columns.index("mark")
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in fields[:at]] + ["code int"] + [f"`{f.name}` {f.dataType.simpleString()}" for f in fields[at:]])
    swept = materialize(dealt.mapInArrow(_swept, schema), "swept")
    # one row for each partition, so this side is bounded by their number
    heads = swept.groupBy("part").agg(F.min(F.struct("corpus_id", "place", "path")).alias("head"))
    above = heads.select("part", "head.corpus_id", F.explode(ancestors_of(F.col("head.path"))).alias("path"))
    opened = (
        marks.where("is_dir")
        .join(F.broadcast(above), ["corpus_id", "path"])
        .groupBy("part")
        .agg(F.min(F.struct("corpus_id", "path")).alias("open"))
    )
    joined = swept.join(F.broadcast(opened), "part", "left")
    begun = (F.col("corpus_id") == F.col("open.corpus_id")) & F.startswith(F.col("place"), F.concat(F.col("open.path"), F.lit("/")))
    code = F.when(begun, BELOW).otherwise(F.col("code"))
    return joined.withColumn("code", code).select(*entries.columns, "code")
