"""Corpora that lie inside the trees of others.

``corpora`` names the place of each corpus: ``(corpus_id, root)`` with absolute roots. What
the trees above a corpus hold, a repository or ignore files, is found by joining the places
of those entries with the ancestors of the roots, so no path is compared with every root.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arborlake.functions.lines import lines_of
from arborlake.functions.paths import ancestors_of, ancestors_or_self, depth_of, parent_of
from arborlake.operators.ignore import is_ignore_file, repositories
from arborlake.operators.selection import nested_repositories

#: Lines of one ignore file have places below this number.
_LINES = 1 << 32


def _located(corpora: DataFrame) -> DataFrame:
    return corpora.select("corpus_id", F.regexp_replace("root", r"/+\z", "").alias("root"))


def _below(root: Column, path: Column) -> Column:
    return F.when(path == "", root).otherwise(F.concat(root, F.lit("/"), path))


def corpora_in_repositories(entries: DataFrame, corpora: DataFrame) -> DataFrame:
    """``corpus_id`` of corpora with a ``.git`` entry at their root or in a directory above it."""
    roots = _located(corpora)
    held = repositories(entries).withColumn("path", F.lit("")).unionByName(nested_repositories(entries))
    places = held.join(roots, "corpus_id").select(_below(F.col("root"), F.col("path")).alias("place")).distinct()
    above = roots.select("corpus_id", F.explode(ancestors_or_self(F.col("root"))).alias("place"))
    return above.join(places, "place", "left_semi").select("corpus_id").distinct()


def ancestor_rules(entries: DataFrame, corpora: DataFrame) -> DataFrame:
    """Rules ``(corpus_id, rule_seq, pattern, source)`` of the ignore files above each root.

    The nearest directory comes first, so what lies further out overrules it. Where several
    corpora hold the same place, each of their files counts.
    """
    roots = _located(corpora)
    files = entries.where(is_ignore_file(entries)).select(
        "corpus_id", parent_of(F.col("path")).alias("path"), lines_of(F.col("content").cast("string")).alias("lines")
    )
    placed = files.join(roots, "corpus_id").select(_below(F.col("root"), F.col("path")).alias("place"), "lines")
    above = roots.select("corpus_id", "root", F.explode(ancestors_of(F.col("root"))).alias("place"))
    met = above.join(placed, "place")
    distance = depth_of(F.col("root")) - depth_of(F.col("place"))
    return met.select("corpus_id", distance.alias("distance"), F.posexplode("lines").alias("line", "pattern")).select(
        "corpus_id",
        (F.col("distance").cast("bigint") * _LINES + F.col("line")).alias("rule_seq"),
        "pattern",
        F.lit("ancestor").alias("source"),
    )
