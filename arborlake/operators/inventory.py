"""Which files and directories exist in each tree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arborlake.functions.paths import (
    ancestors_of,
    depth_of,
    extension_of,
    has_directory_hint,
    name_of,
    parent_of,
)


def is_text_column(frame: DataFrame, column: str = "content") -> bool:
    """True when the content column is STRING rather than BINARY."""
    return frame.schema[column].dataType.typeName() == "string"


def with_content_column(frame: DataFrame) -> DataFrame:
    """A manifest may come without contents; they are unknown then."""
    return frame if "content" in frame.columns else frame.withColumn("content", F.lit(None).cast("string"))


def corpora_of(entries: DataFrame) -> DataFrame:
    """Every corpus that has any entry, kept or not."""
    return entries.select("corpus_id").distinct()


def with_entry_defaults(frame: DataFrame) -> DataFrame:
    """Fill the optional entry columns of a manifest.

    A missing ``is_dir`` is read off a trailing separator, which is then removed.
    """
    columns = set(frame.columns)
    hint = has_directory_hint(F.col("path"))
    is_dir = F.coalesce(F.col("is_dir"), hint) if "is_dir" in columns else hint
    symlink = F.coalesce(F.col("is_symlink"), F.lit(False)) if "is_symlink" in columns else F.lit(False)
    return frame.withColumns(
        {"is_dir": is_dir, "is_symlink": symlink, "path": F.regexp_replace("path", r"[/\\]+\z", "")}
    )


def _acceptable() -> Column:
    return F.is_valid_utf8(F.col("path")) & (F.col("path") != "")


def _flag(entries: DataFrame, name: str) -> Column:
    """A flag that is false where it is NULL or the column is absent."""
    return F.coalesce(F.col(name), F.lit(False)) if name in entries.columns else F.lit(False)


def walkable(entries: DataFrame) -> DataFrame:
    """Entries a walk visits: no symlinks, no undecodable paths."""
    kept = entries.where(_acceptable() & ~_flag(entries, "is_symlink"))
    return kept.withColumn("is_dir", _flag(kept, "is_dir")) if "is_dir" in entries.columns else kept


def rejected_entries(entries: DataFrame) -> DataFrame:
    """Entries a walk skips, with the reason."""
    path = F.col("path")
    reason = (
        F.when(path.isNull(), "path_missing")
        .when(path == "", "path_empty")
        .when(~F.is_valid_utf8(path), "path_not_utf8")
        .when(_flag(entries, "is_symlink"), "symlink")
    )
    return entries.withColumn("reject_reason", reason).where(F.col("reject_reason").isNotNull())


def with_path_columns(entries: DataFrame) -> DataFrame:
    """Add name, extension (as written), parent and depth."""
    path = F.col("path")
    return entries.withColumns(
        {
            "name": name_of(path),
            "ext": extension_of(path),
            "parent": parent_of(path),
            "depth": depth_of(path).cast("int"),
        }
    )


def directories(entries: DataFrame) -> DataFrame:
    """All directories ``(corpus_id, path)``: explicit rows and ancestors of rows.

    Paths are exploded alone, and the distinct combines on the map side, so a
    crowded directory is one row per task before the exchange.
    """
    implied = entries.select("corpus_id", F.explode(ancestors_of(F.col("path"))).alias("path"))
    explicit = entries.where("is_dir").select("corpus_id", "path")
    return explicit.unionByName(implied).distinct()


def all_entries(entries: DataFrame) -> DataFrame:
    """Files and directories ``(corpus_id, path, is_dir)``, each once."""
    files = entries.withColumn("is_dir", _flag(entries, "is_dir")).where("not is_dir").select("corpus_id", "path", "is_dir")
    return files.unionByName(directories(entries).withColumn("is_dir", F.lit(True)))


def child_counts(entries: DataFrame) -> DataFrame:
    """Direct files and directories of every directory that has any child.

    ``entries`` must list directories too; the root is ``''``.
    """
    return (
        entries.groupBy("corpus_id", parent_of(F.col("path")).alias("parent"))
        .agg(
            F.count_if(~F.col("is_dir")).alias("n_files"),
            F.count_if(F.col("is_dir")).alias("n_dirs"),
        )
    )


def attach_to_parent(entries: DataFrame) -> DataFrame:
    """Each directory with the child counts of its own row; empty ones get zeros."""
    counts = child_counts(entries).withColumnRenamed("parent", "path")
    zero = {"n_files": 0, "n_dirs": 0}
    return (
        entries.where("is_dir").select("corpus_id", "path").join(counts, ["corpus_id", "path"], "left")
    ).fillna(zero)


def empty_directories(entries: DataFrame) -> DataFrame:
    """Directories without any child."""
    parents = entries.select("corpus_id", parent_of(F.col("path")).alias("path")).distinct()
    dirs = entries.where("is_dir").select("corpus_id", "path")
    return dirs.join(parents, ["corpus_id", "path"], "left_anti")
