"""Ignore-file rules as data: layers of translated patterns joined to entries."""

from __future__ import annotations

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from arborlake.functions import globs
from arborlake.functions.globs import keyed_rules
from arborlake.functions.lines import lines_of
from arborlake.functions.paths import ancestors_of, match_form, name_of, parent_of
from arborlake.operators.scratch import lookup, materialize, part_of
from arborlake.schema import COMPILED_RULES, LAYERS

# The translation travels with the task, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(globs)


@F.pandas_udf(COMPILED_RULES)
def _translate(lines: pd.Series) -> pd.DataFrame:
    """Ignore-file lines to rules. Runs on ignore files only, never on content."""
    found = [keyed_rules(list(rows)) for rows in lines]
    return pd.DataFrame({"loose": [loose for loose, _ in found], "rules": [[vars(r) for r in rules] for _, rules in found]})


def _layers(ordered: DataFrame) -> DataFrame:
    """``(corpus_id, scope, seq, lines)`` to one row of rules per layer.

    A layer is one ignore file, or the few sources of the root layer.
    """
    return (
        ordered.groupBy("corpus_id", "scope", "layer_seq")
        .agg(F.array_sort(F.collect_list(F.struct("seq", "lines"))).alias("parts"))
        .select("corpus_id", "scope", F.col("layer_seq").cast("int").alias("layer"), _translate(F.flatten("parts.lines")).alias("rules"))
    )


def layers_from_rules(rules: DataFrame) -> DataFrame:
    """Layers of a rule table ``(corpus_id, scope, layer_seq, rule_seq, pattern)``."""
    return _layers(
        rules.select(
            "corpus_id",
            "scope",
            "layer_seq",
            F.col("rule_seq").alias("seq"),
            F.array("pattern").alias("lines"),
        )
    )


def layers_from_rows(spark: SparkSession, rows: list[tuple[str, str, int, int, str]]) -> DataFrame:
    """Layers of a short rule list known at plan time; translated on the driver."""
    grouped: dict[tuple[str, str, int], list[tuple[int, str]]] = {}
    for corpus_id, scope, layer_seq, rule_seq, pattern in rows:
        grouped.setdefault((corpus_id, scope, layer_seq), []).append((rule_seq, pattern))
    data = []
    for (corpus_id, scope, layer_seq), lines in grouped.items():
        loose, rules = keyed_rules([p for _, p in sorted(lines)])
        data.append((corpus_id, scope, layer_seq, (loose, [(r.key, r.regex, r.negated, r.dir_only, r.block) for r in rules])))
    return spark.createDataFrame(data, LAYERS)


#: Order of the sources of the root layer.
_ROOT, _ANCESTOR, _EXCLUDE, _GLOBAL = range(4)


def _place(source: Column, rule_seq: Column) -> Column:
    return F.struct(source.alias("source"), rule_seq.cast("bigint").alias("rule")).alias("seq")


def is_ignore_file(entries: DataFrame) -> Column:
    """Whether an entry is a ``.gitignore`` file outside ``.git``."""
    path = F.col("path")
    is_dir = F.coalesce("is_dir", F.lit(False)) if "is_dir" in entries.columns else F.lit(False)
    return ~is_dir & (name_of(path) == ".gitignore") & ~path.rlike(r"(\A|/)\.git/")


def layers_from_files(entries: DataFrame, extra_root_rules: DataFrame | None = None) -> DataFrame:
    """Layers of the ignore files that the entries themselves contain.

    The root layer is the root ``.gitignore``, then ``extra_root_rules``
    ``(corpus_id, rule_seq, pattern)`` of the ancestors, then
    ``.git/info/exclude``, then the extra rules whose optional column ``source`` is
    ``global``; any other source is an ancestor. The last match wins, so a later
    source overrules an earlier one. Every other ``.gitignore`` outside ``.git`` is a layer of its own.
    """
    path = F.col("path")
    exclude_file = path == ".git/info/exclude"
    text = F.col("content").cast("string")
    sources = entries.where(is_ignore_file(entries) | (exclude_file & ~F.coalesce("is_dir", F.lit(False)))).select(
        "corpus_id",
        F.when(exclude_file, F.lit("")).otherwise(parent_of(path)).alias("scope"),
        F.lit(0).alias("layer_seq"),
        _place(F.when(exclude_file, F.lit(_EXCLUDE)).otherwise(F.lit(_ROOT)), F.lit(0)),
        lines_of(text).alias("lines"),
    )
    if extra_root_rules is not None:
        outermost = F.col("source") == "global" if "source" in extra_root_rules.columns else F.lit(False)
        source = F.when(outermost, F.lit(_GLOBAL)).otherwise(F.lit(_ANCESTOR))
        sources = sources.unionByName(
            extra_root_rules.select(
                "corpus_id",
                F.lit("").alias("scope"),
                F.lit(0).alias("layer_seq"),
                _place(source, F.col("rule_seq")),
                F.array("pattern").alias("lines"),
            )
        )
    return materialize(_layers(sources), "ignore-layers")


def repositories(entries: DataFrame) -> DataFrame:
    """Corpora whose root holds a ``.git`` entry."""
    path = F.col("path")
    return (
        entries.where((path == ".git") | path.startswith(".git/")).select("corpus_id").distinct()
    )


def active_layers(
    layers: DataFrame, mode: str, entries: DataFrame, in_repository: DataFrame | None = None
) -> DataFrame | None:
    """Layers in force: all (``always``), none (``never``), or those of corpora that
    lie in a repository (``auto``).

    ``in_repository`` names corpora whose root lies below a repository root; only
    the caller can know that.
    """
    if mode == "never":
        return None
    if mode == "always":
        return layers
    if mode != "auto":
        raise ValueError(f"ignore mode must be auto, always or never, not {mode!r}")
    inside = repositories(entries)
    if in_repository is not None:
        inside = inside.unionByName(in_repository.select("corpus_id")).distinct()
    return layers.join(inside, "corpus_id", "left_semi")


#: The key of the rules that any entry of the scope may meet.
_LOOSE = "*"


def rule_index(layers: DataFrame) -> DataFrame:
    """The rules of all layers by ``(corpus_id, scope, layer, key)``, a materialized table."""
    rules = layers.select("corpus_id", "scope", "layer", F.col("rules.loose").alias("loose"), F.explode("rules.rules").alias("r"))
    keyed = rules.select(
        "corpus_id",
        "scope",
        "layer",
        F.coalesce("r.key", F.lit(_LOOSE)).alias("key"),
        F.when(F.col("r.key").isNull(), F.col("loose")).alias("loose"),
        F.struct("r.block", "r.negated", "r.dir_only", "r.regex").alias("rule"),
    )
    return materialize(
        keyed.groupBy("corpus_id", "scope", "layer", "key").agg(
            F.max("loose").alias("loose"), F.collect_list("rule").alias("rules")
        ),
        "ignore-index",
    )


def _keys(relative: Column) -> Column:
    """The keys under which a rule for the path may stand."""
    name = name_of(relative)
    dots = F.length(name) - F.length(F.replace(name, F.lit("."), F.lit("")))
    ends = F.transform(
        F.sequence(F.lit(1), dots), lambda i: F.concat(F.lit("x:."), F.call_function("substring_index", name, F.lit("."), -i))
    )
    first = F.call_function("substring_index", relative, F.lit("/"), F.lit(1))
    own = F.array(F.lit(_LOOSE), *(F.concat(F.lit(k), v) for k, v in (("n:", name), ("p:", relative), ("f:", first))))
    return F.when(dots > 0, F.concat(own, ends)).otherwise(own)


def ignored_entries(candidates: DataFrame, layers: DataFrame) -> DataFrame:
    """Candidates ``(corpus_id, path, is_dir)`` that any layer above them ignores.

    The candidate side carries paths only. It meets the scopes, then the rules by name, by end
    of the name, by path and by first segment, all on equi-joins; a regex is tried only for the
    rules that an entry meets, and one regex for each layer stands before those that have no
    key. Hits alone are grouped: in a layer the last block of rules that match decides.
    """
    path = match_form(F.col("path"))
    index = rule_index(layers)
    scopes = F.concat(F.array(F.lit("")), ancestors_of(path))
    exploded = candidates.select("corpus_id", "path", "is_dir", F.explode(scopes).alias("scope"))
    scoped = part_of(index.select("corpus_id", "scope").distinct(), index)
    inside = lookup(exploded, scoped, ["corpus_id", "scope"], F.col("path"), "inner")
    relative = F.when(F.col("scope") == "", F.col("path")).otherwise(
        F.substring(path, F.length("scope") + 2, F.length(path))
    )
    keyed = inside.withColumn("relative", relative).withColumn("key", F.explode(_keys(F.col("relative"))))
    met = lookup(keyed, index, ["corpus_id", "scope", "key"], F.col("path"), "inner")
    is_dir, relative = F.col("is_dir"), F.col("relative")
    # the regex of a scope is the same for all its rows, and the function compiles it anew only
    # when it changes
    written = F.when(is_dir, F.concat(relative, F.lit("/"))).otherwise(relative)
    may = F.col("loose").isNull() | (F.regexp_instr(written, F.col("loose")) > 0)
    hits = F.filter(
        "rules", lambda r: (is_dir | ~r["dir_only"]) & (r["regex"].isNull() | F.rlike(relative, r["regex"]))
    )
    last = F.array_max(F.transform(hits, lambda r: F.struct(r["block"].alias("block"), r["negated"].alias("negated"))))
    entry = ["corpus_id", "path", "is_dir"]
    found = met.where(may).select(*entry, "scope", "layer", last.alias("last")).where(F.col("last").isNotNull())
    decided = found.groupBy(*entry, "scope", "layer").agg(F.max("last").alias("last"))
    return decided.where(~F.col("last.negated")).select(*entry).distinct()
