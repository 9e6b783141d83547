"""Corpus statistics: totals, breakdowns, shares, outliers and report lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from arborlake.functions.classify import type_display_name
from arborlake.functions.labels import share_percent, totals_text, type_line, whole_percent
from arborlake.functions.paths import extension_of, name_of, parent_of, sort_key
from arborlake.operators.scratch import is_empty, lookup, materialize

# Report sizes and the outlier rule (top 5 %, at most 10 files).
TOP_EXTENSIONS = 5
TOP_TYPES = 8
OUTLIER_CAP = 10
OUTLIER_DIVISOR = 20
NAME_PADDING = 10


def corpus_totals(entries: DataFrame, corpora: DataFrame | None = None) -> DataFrame:
    """Files, directories and lines per corpus.

    The root counts as a directory when it has any child. ``loc`` is NULL when no file was
    countable. ``corpora`` lists all corpora; those without an entry get zeros.
    """
    loc = F.sum("loc") if "loc" in entries.columns else F.lit(None).cast("bigint")
    totals = entries.groupBy("corpus_id").agg(
        F.count_if(~F.col("is_dir")).alias("n_files"),
        (F.count_if(F.col("is_dir")) + 1).alias("n_dirs"),
        loc.alias("loc"),
    )
    if corpora is None:
        return totals
    return corpora.select("corpus_id").join(totals, "corpus_id", "left").fillna(0, ["n_files", "n_dirs"])


def type_counts(files: DataFrame) -> DataFrame:
    """Files and lines per type and, of labelled files, the label of its first in listing order.

    Counts are kept per label, so rows are hashed and not sorted. Only the files of types that
    have several labels in a corpus are asked for their order.
    """
    loc = F.sum("loc") if "loc" in files.columns else F.lit(None).cast("bigint")
    key = ["corpus_id", "file_type"]
    counts = [F.count(F.lit(1)).alias("n_files"), loc.alias("loc")]
    if "label" not in files.columns:
        return files.groupBy(*key).agg(*counts)
    by_label = materialize(files.groupBy(*key, "label").agg(*counts), "type-labels")
    summed = by_label.groupBy(*key).agg(
        F.sum("n_files").alias("n_files"), F.sum("loc").alias("loc"), F.first("label").alias("label"), F.count(F.lit(1)).alias("n")
    )
    several = materialize(summed.where(F.col("n") > 1).select(*key), "contested-types")
    if is_empty(several):
        return summed.drop("n")
    asked = lookup(files.select(*key, "path", "label"), several, key, F.col("path"), "inner")
    order = sort_key(F.col("path"), F.lit(False))
    first = asked.groupBy(*key).agg(F.struct(F.min_by("label", order).alias("label")).alias("first"))
    labelled = F.when(F.col("first").isNull(), F.col("label")).otherwise(F.col("first.label"))
    return summed.drop("n").join(first, key, "left").withColumn("label", labelled).drop("first")


def type_breakdown(files: DataFrame, top: int = TOP_TYPES) -> DataFrame:
    """Largest types of each corpus with their share of its files.

    The windows run over the aggregated rows, a few dozen types per corpus at
    most. Equal counts are ordered by type name.
    """
    counts = type_counts(files)
    corpus = W.partitionBy("corpus_id")
    percent = share_percent(F.col("n_files"), F.col("corpus_files"))
    return (
        counts.withColumn("corpus_files", F.sum("n_files").over(corpus))
        .withColumn(
            "rank", F.row_number().over(corpus.orderBy(F.desc("n_files"), F.asc("file_type")))
        )
        .where(F.col("rank") <= top)
        .withColumn("type_name", type_display_name(F.col("file_type")))
        .withColumn("percent", percent)
        .withColumn("share", whole_percent(F.col("percent")))
    )


def extension_counts(files: DataFrame) -> DataFrame:
    """Files per lower-cased extension; files without one share a bucket."""
    ext = F.coalesce(F.lower(extension_of(F.col("path"))), F.lit("(no ext)"))
    return files.groupBy("corpus_id", ext.alias("ext")).agg(F.count(F.lit(1)).alias("n_files"))


def top_extensions(files: DataFrame, top: int = TOP_EXTENSIONS) -> DataFrame:
    """Most frequent extensions of each corpus, rendered ``ext(n)``.

    The limit on the row number is pushed below the exchange by the planner.
    """
    order = W.partitionBy("corpus_id").orderBy(F.desc("n_files"), F.asc("ext"))
    shown = F.when(F.col("ext") == "(no ext)", "no-ext").otherwise(F.col("ext"))
    return (
        extension_counts(files)
        .withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= top)
        .withColumn("shown", F.format_string("%s(%d)", shown, F.col("n_files")))
    )


def max_loc_per_directory(files: DataFrame) -> DataFrame:
    """Largest line count among the direct files of each directory."""
    return files.groupBy("corpus_id", parent_of(F.col("path")).alias("parent")).agg(
        F.coalesce(F.max("loc"), F.lit(0)).alias("max_loc")
    )


def name_width(files: DataFrame) -> DataFrame:
    """Widest file name in bytes plus padding, per corpus."""
    width = F.max(F.octet_length(name_of(F.col("path")))) + NAME_PADDING
    return files.groupBy("corpus_id").agg(width.alias("name_width"))


def outlier_thresholds(files: DataFrame) -> DataFrame:
    """Smallest line count that marks an outlier, per corpus with countable files.

    It is the k-th largest count, k = min(ceil(n / 20), n, 10). Only the ten
    largest counts of each task cross the exchange.
    """
    counted = files.where(F.col("loc").isNotNull()).select("corpus_id", "loc")
    sizes = counted.groupBy("corpus_id").agg(F.count(F.lit(1)).alias("n"))
    order = W.partitionBy("corpus_id").orderBy(F.desc("loc"))
    largest = counted.withColumn("rank", F.row_number().over(order)).where(
        F.col("rank") <= OUTLIER_CAP
    )
    share = F.call_function("div", F.col("n") + (OUTLIER_DIVISOR - 1), F.lit(OUTLIER_DIVISOR))
    k = F.least(share, F.lit(OUTLIER_CAP), F.col("n"))
    return (
        largest.join(sizes, "corpus_id")
        .where(F.col("rank") == k)
        .select("corpus_id", F.col("loc").alias("threshold"))
    )


def with_outlier(files: DataFrame) -> DataFrame:
    """Add ``threshold`` and ``outlier`` to narrow file rows.

    Pass a materialized table: it is read for the ranking and again for the flag.
    """
    thresholds = materialize(outlier_thresholds(files), "outlier-thresholds")
    return lookup(files, thresholds, ["corpus_id"], F.col("path")).withColumn(
        "outlier", F.coalesce(F.col("loc") >= F.col("threshold"), F.lit(False))
    )


def stats_lines(
    entries: DataFrame, mode: str = "full", charset: str = "ascii", corpora: DataFrame | None = None
) -> DataFrame:
    """Report lines ``(corpus_id, seq, line)``, also for ``corpora`` without entries.

    ``entries`` has files (with ``file_type``, ``loc`` and optionally ``label``) and
    directories. Modes are ``off``, ``min``, ``full`` and ``footer``.
    """
    if mode not in ("off", "min", "full", "footer"):
        raise ValueError(f"stats mode must be off, min, full or footer, not {mode!r}")
    totals = corpus_totals(entries, corpora)
    numbers = (F.col("n_dirs"), F.col("n_files"), F.col("loc"))
    files = entries.where(~F.col("is_dir"))
    if mode == "off":
        return totals.where(F.lit(False)).select(
            "corpus_id", F.lit(0).alias("seq"), F.lit("").alias("line")
        )
    if mode == "min":
        return totals.select(
            "corpus_id", F.lit(0).alias("seq"), totals_text("Stats", *numbers).alias("line")
        )
    if mode == "footer":
        return _footer_lines(totals, files)
    head = totals.select(
        "corpus_id", F.lit(0).alias("seq"), totals_text("Totals", *numbers).alias("line")
    )
    label = F.col("label") if "label" in entries.columns else F.lit("")
    types = type_breakdown(files).select(
        "corpus_id",
        (F.col("rank") + 2).alias("seq"),
        type_line(label, F.col("type_name"), F.col("n_files"), F.col("percent"), charset).alias("line"),
    )
    heading = F.explode(
        F.array(
            F.struct(F.lit(1).alias("seq"), F.lit("").alias("line")),
            F.struct(F.lit(2).alias("seq"), F.lit("**By type**:").alias("line")),
        )
    )
    between = (
        totals.where(F.col("n_files") > 0)
        .select("corpus_id", heading.alias("row"))
        .select("corpus_id", "row.seq", "row.line")
    )
    return head.unionByName(between).unionByName(types)


def _footer_lines(totals: DataFrame, files: DataFrame) -> DataFrame:
    fixed = totals.select(
        "corpus_id",
        F.posexplode(
            F.array(
                F.lit("**Stats**"),
                F.concat(F.lit("- Dirs: "), F.col("n_dirs").cast("string")),
                F.concat(F.lit("- Files: "), F.col("n_files").cast("string")),
            )
        ).alias("seq", "line"),
    )
    ranked = F.array_sort(F.collect_list(F.struct("rank", "shown")))
    top = (
        top_extensions(files)
        .groupBy("corpus_id")
        .agg(F.array_join(ranked["shown"], ", ").alias("shown"))
        .select(
            "corpus_id",
            F.lit(3).alias("seq"),
            F.concat(F.lit("- Top by ext: "), F.col("shown")).alias("line"),
        )
    )
    return fixed.unionByName(top)

