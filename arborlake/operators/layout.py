"""Tree listings as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arborlake.functions.labels import STAR, loc_bar, loc_class, loc_label
from arborlake.functions.paths import ancestors_or_self, depth_of, name_of, parent_of, sort_key
from arborlake.operators.scratch import lookup, materialize, part_of
from arborlake.operators.stats import with_outlier

# Fixed values: (branch, last branch, continued, finished).
GLYPHS = {
    "plain": ("├── ", "└── ", "│   ", "    "),
    "unicode": ("├─ ", "└─ ", "│  ", "   "),
    "ascii": ("|-- ", "`-- ", "|   ", "    "),
}


def _rank_in_directory() -> Column:
    """Sibling order: directories first, then by the bytes of the name."""
    return F.struct((~F.col("is_dir")).alias("is_file"), name_of(F.col("path")).alias("name"))


def _parents(entries: DataFrame, charset: str) -> DataFrame:
    """One row per directory with children: its last child and its line prefix.

    A directory line is the last one of its parent when it is the parent's largest
    child, so the flag is a per-parent maximum, combined on the map side, and no
    group of siblings is ever gathered. The prefix of a directory needs the flags
    of its chain only: the chain is exploded on directories, not on files, and
    meets the (at most one per parent) last directories on an equi-join.
    """
    _, _, continued, finished = GLYPHS[charset]
    children = [F.max(_rank_in_directory()).alias("last_child")]
    if "loc" in entries.columns:
        direct = F.max(F.when(~F.col("is_dir"), F.col("loc")))
        children.append(F.coalesce(direct, F.lit(0)).cast("bigint").alias("max_loc"))
    parents = materialize(
        entries.groupBy("corpus_id", parent_of(F.col("path")).alias("parent")).agg(*children),
        "parents",
    )
    stem = F.when(F.col("parent") == "", F.lit("")).otherwise(F.concat("parent", F.lit("/")))
    last_dirs = part_of(
        parents.where(~F.col("last_child.is_file")).select(
            "corpus_id", F.concat(stem, F.col("last_child.name")).alias("ancestor")
        ),
        parents,
    )
    chains = parents.where(F.col("parent") != "").select(
        "corpus_id", "parent", F.explode(ancestors_or_self(F.col("parent"))).alias("ancestor")
    )
    ends = (
        lookup(chains, last_dirs, ["corpus_id", "ancestor"], F.col("parent"), "inner")
        .groupBy("corpus_id", "parent")
        .agg(F.collect_set(depth_of(F.col("ancestor"))).alias("ended"))
    )
    levels = F.sequence(F.lit(1), depth_of(F.col("parent")))
    drawn = F.array_join(
        F.transform(
            levels,
            lambda d: F.when(
                F.coalesce(F.array_contains("ended", d), F.lit(False)), F.lit(finished)
            ).otherwise(F.lit(continued)),
        ),
        "",
    )
    prefix = F.when(F.col("parent") == "", F.lit("")).otherwise(drawn)
    return materialize(
        parents.join(ends, ["corpus_id", "parent"], "left").select(
            *parents.columns, prefix.alias("prefix")
        ),
        "prefixes",
    )


def with_layout(entries: DataFrame, charset: str = "plain") -> DataFrame:
    """Add ``name``, ``is_last``, ``prefix``, ``branch`` and ``sort_key``.

    With a ``loc`` column, ``max_loc`` (largest among the direct files of the parent)
    comes along.
    ``entries`` lists the kept files and directories; pass a materialized table,
    it is read twice.
    """
    branch, last_branch, _, _ = GLYPHS[charset]
    path = F.col("path")
    keyed = entries.withColumn("parent", parent_of(path))
    joined = lookup(keyed, _parents(entries, charset), ["corpus_id", "parent"], path, "inner")
    return joined.withColumns(
        {
            "name": name_of(path),
            "is_last": _rank_in_directory() == F.col("last_child"),
            "sort_key": sort_key(path, F.col("is_dir")),
        }
    ).withColumn("branch", F.when(F.col("is_last"), last_branch).otherwise(branch)).drop("last_child")


def tree_lines(entries: DataFrame, charset: str = "plain", corpora: DataFrame | None = None) -> DataFrame:
    """Listing lines ``(corpus_id, sort_key, line)``; the first line is ``.``.

    ``corpora`` lists all corpora; those without an entry have the first line alone.

    Sorting by ``sort_key`` within a corpus gives the depth-first listing. The line
    count is appended where ``loc`` is known.
    """
    slash = F.when(F.col("is_dir"), F.lit("/")).otherwise(F.lit(""))
    line = F.concat("prefix", "branch", "name", slash)
    if "loc" in entries.columns:
        counted = ~F.col("is_dir") & F.col("loc").isNotNull()
        suffix = F.concat(F.lit("  ("), F.col("loc").cast("string"), F.lit(" lines)"))
        line = F.concat(line, F.when(counted, suffix).otherwise(F.lit("")))
    body = with_layout(entries, charset).select("corpus_id", "sort_key", line.alias("line"))
    roots = entries.select("corpus_id").distinct() if corpora is None else corpora
    return roots.select("corpus_id", F.lit("").alias("sort_key"), F.lit(".").alias("line")).unionByName(body)


def annotated_lines(entries: DataFrame, charset: str = "unicode") -> DataFrame:
    """Listing rows with the size columns of each counted file.

    ``entries`` has ``loc`` and optionally ``label``; pass a materialized table.
    Adds the text of the name part and the columns ``bar``, ``loc_label``,
    ``loc_class`` and ``star``; nothing is padded.
    """
    laid_out = with_layout(with_outlier(entries), charset)
    label = F.col("label") if "label" in entries.columns else F.lit("")
    shown = F.when(label == "", F.lit("")).otherwise(F.concat(label, F.lit(" ")))
    slash = F.when(F.col("is_dir"), F.lit("/")).otherwise(F.lit(""))
    loc = F.when(~F.col("is_dir"), F.col("loc"))
    return laid_out.select(
        "corpus_id",
        "path",
        "sort_key",
        F.concat("prefix", "branch", shown, "name", slash).alias("line"),
        loc_bar(loc, F.col("max_loc")).alias("bar"),
        loc_label(loc).alias("loc_label"),
        loc_class(loc).alias("loc_class"),
        F.when(F.col("outlier"), F.lit(STAR)).otherwise(F.lit("")).alias("star"),
    )
