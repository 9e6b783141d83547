"""Intermediate tables and the joins that depend on their measured size."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

# A side is broadcast only below both bounds.
BROADCAST_ROWS = 500_000
BROADCAST_BYTES = 64 * 1024 * 1024
# Beyond them, keys with more rows than the floor are joined apart, the largest first.
HOT_FLOOR = 1_000_000
HOT_KEYS = 10_000
SALTS = 64


def scratch_folder(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by the session.

    Without ``spark.checkpoint.dir`` it lies below the warehouse, the storage that the
    session itself names.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        named = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"
    return named.rstrip("/")


def _size_metrics(frame: DataFrame) -> list[Column]:
    """Row count and an upper estimate of the bytes, as aggregates."""
    width = sum(
        (
            F.coalesce(F.octet_length(F.col(f"`{f.name}`").cast("string")), F.lit(0)) + 16
            for f in frame.schema.fields
        ),
        F.lit(0),
    )
    size = F.coalesce(F.sum(width), F.lit(0)).cast("bigint")
    return [F.count(F.lit(1)).alias("rows"), size.alias("size")]


def materialize(frame: DataFrame, label: str) -> DataFrame:
    """Write a narrow intermediate table once and read it back.

    Later consumers scan the written columns instead of recomputing the lineage, a
    lost executor costs a re-read only, and the size is measured while writing.
    """
    spark = frame.sparkSession
    target = f"{scratch_folder(spark)}/arborlake/{label}-{uuid.uuid4().hex}"
    seen = Observation(f"{label}-{uuid.uuid4().hex}")
    frame.observe(seen, *_size_metrics(frame)).write.parquet(target)
    written = spark.read.schema(frame.schema).parquet(target)
    metrics = seen.get
    if metrics.get("rows") is None or metrics.get("size") is None:
        metrics = written.agg(*_size_metrics(written)).first().asDict()
    written._measured = (metrics["rows"], metrics["size"])
    return written


def part_of(frame: DataFrame, table: DataFrame) -> DataFrame:
    """A cheap cut of a materialized table; where the whole fits, so does the cut."""
    if _fits_broadcast(table):
        frame._measured = table._measured
    return frame


def is_empty(table: DataFrame) -> bool:
    """Whether a materialized table has no rows, as counted while writing."""
    return table._measured[0] == 0


def _fits_broadcast(small: DataFrame) -> bool:
    """Whether the measured size is within the broadcast bounds."""
    measured = getattr(small, "_measured", None)
    rows, size = measured or small.agg(*_size_metrics(small)).first()
    return rows <= BROADCAST_ROWS and size <= BROADCAST_BYTES


def _salted(big: DataFrame, small: DataFrame, on: list[str], spread: Column, how: str) -> DataFrame:
    """Repeat the small rows once per salt; a large row takes the salt of ``spread``."""
    salted = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return (
        big.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int"))
        .join(salted, [*on, "_salt"], how)
        .drop("_salt")
    )


def hot_keys(rows: DataFrame, on: list[str]) -> DataFrame:
    """The most frequent keys, at most ``HOT_KEYS`` of them and only above the floor.

    A key outside the list has at most one row in ``HOT_KEYS``. The counts combine on
    the map side.
    """
    counts = rows.groupBy(*on).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > HOT_FLOOR)
    return materialize(counts.orderBy(F.desc("_n"), *on).limit(HOT_KEYS).select(*on), "hot-keys")


def lookup(
    big: DataFrame, small: DataFrame, on: list[str], spread: Column, how: str = "left"
) -> DataFrame:
    """Equi-join a large side, whose keys may be hot, with one small row per key.

    ``small`` must be cheap to scan again (a materialized table). It is broadcast when
    its measured size is within the bounds. Otherwise the hot keys are found first:
    their rows, at most ``HOT_KEYS`` on the small side, are broadcast or salted on
    ``spread``, and all other rows take a plain shuffled join.
    """
    if _fits_broadcast(small):
        return big.join(F.broadcast(small), on, how)
    hot = hot_keys(big, on)
    if is_empty(hot):
        return big.join(small, on, how)
    # Bounded by construction: HOT_KEYS rows of keys.
    listed = F.broadcast(hot)
    hot_small = materialize(small.join(listed, on, "left_semi"), "hot-rows")
    hot_big = big.join(listed, on, "left_semi")
    if _fits_broadcast(hot_small):
        hot_rows = hot_big.join(F.broadcast(hot_small), on, how)
    else:
        hot_rows = _salted(hot_big, hot_small, on, spread, how)
    cold_rows = big.join(listed, on, "left_anti").join(small, on, how)
    return hot_rows.unionByName(cold_rows)


def lookup_by_row(big: DataFrame, small: DataFrame, on: list[str], row: list[str]) -> DataFrame:
    """Inner equi-join of rows with a wide payload, one small row per key.

    Beyond the broadcast bounds the small side is looked up for the narrow row keys ``row``
    (which hold ``on``), and the payload meets the result by row. Row keys are not hot, and a
    payload stored in buckets of them (:mod:`arborlake.sources.buckets`) is not shuffled.
    """
    if _fits_broadcast(small):
        return big.join(F.broadcast(small), on, "inner")
    keys = lookup(big.select(*row).distinct(), small, on, F.xxhash64(*row), "inner")
    return big.join(keys, row, "inner")


def without_keys(big: DataFrame, dropped: DataFrame, on: list[str]) -> DataFrame:
    """Rows of ``big`` whose unique key is not among ``dropped``, a materialized table.

    Beyond the broadcast bounds only the dropped keys are shuffled where ``big`` is stored in
    buckets of the key.
    """
    side = F.broadcast(dropped) if _fits_broadcast(dropped) else dropped
    return big.join(side, on, "left_anti")
