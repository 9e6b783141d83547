"""End-to-end jobs: plain listing, annotated listing and packed context."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arborlake.functions.classify import COUNT_LIMIT_BYTES, file_type, has_binary_extension, with_label
from arborlake.functions.lines import lines_of_code
from arborlake.functions.paths import display_path
from arborlake.operators.containment import ancestor_rules, corpora_in_repositories
from arborlake.operators.ignore import active_layers, is_ignore_file, layers_from_files
from arborlake.operators.inventory import corpora_of, is_text_column, walkable, with_content_column
from arborlake.operators.layout import annotated_lines, tree_lines
from arborlake.operators.numbering import numbered
from arborlake.operators.packing import check_budget, pack
from arborlake.operators.scratch import is_empty, materialize
from arborlake.operators.selection import SelectionRules, kept_files, select_entries, with_decision
from arborlake.operators.stats import stats_lines
from arborlake.sources.contents import refers, with_contents
from arborlake.sources.entries import with_size


@dataclass(frozen=True)
class Options:
    """What a job shows. Selection has its own :class:`SelectionRules`.

    ``global_rules`` are the patterns of a user-wide ignore file. With ``display`` a pair
    ``(root, seen_from)``, sections name the path below ``root`` as it is seen from there.
    """

    rules: SelectionRules = field(default_factory=SelectionRules)
    ignore_mode: str = "auto"
    loc: str = "fast"
    stats: str = "full"
    charset: str = "plain"
    contents: bool = False
    max_bytes: int | None = None
    contents_mode: str = "head"
    global_rules: tuple[str, ...] = ()
    display: tuple[str, str] | None = None

    def __post_init__(self) -> None:
        check_budget(self.contents, self.max_bytes)


def _own_layers(entries: DataFrame, options: Options, corpora: DataFrame | None) -> DataFrame | None:
    """Layers of the ignore files that the entries hold, of those above, and of all users.

    A narrow pass over the paths tells first whether there are any.
    """
    path = F.col("path")
    any_file = is_ignore_file(entries) | (path == ".git/info/exclude")
    if not ("content" in entries.columns or refers(entries)) or (
        not options.global_rules and is_empty(materialize(entries.where(any_file).select("corpus_id"), "ignore-files"))
    ):
        return None
    rule_files = entries
    if refers(entries):
        rule_files = materialize(with_contents(entries.where(any_file)), "ignore-contents")
    extra = None
    if corpora is not None:
        extra = ancestor_rules(rule_files, corpora)
    if options.global_rules:
        listed = F.posexplode(F.array(*map(F.lit, options.global_rules))).alias("rule_seq", "pattern")
        everywhere = corpora_of(entries).select("corpus_id", listed).withColumn("source", F.lit("global"))
        everywhere = everywhere.withColumn("rule_seq", F.col("rule_seq").cast("bigint"))
        extra = everywhere if extra is None else extra.unionByName(everywhere)
    return layers_from_files(rule_files, extra)


def selection(
    entries: DataFrame,
    options: Options,
    layers: DataFrame | None = None,
    in_repository: DataFrame | None = None,
    corpora: DataFrame | None = None,
) -> DataFrame:
    """Decisions under the ignore mode of the options.

    Without ``layers`` the ignore files among the entries are read. ``corpora`` with the
    places of the roots adds the ignore files and the repositories above them; without it
    ``in_repository`` may name the corpora that lie in a repository.
    """
    if layers is None and options.ignore_mode != "never":
        layers = _own_layers(entries, options, corpora)
    active = None
    if layers is not None:
        if in_repository is None and corpora is not None and options.ignore_mode == "auto":
            in_repository = corpora_in_repositories(entries, corpora)
        active = active_layers(layers, options.ignore_mode, entries, in_repository)
    return select_entries(entries, options.rules, layers=active)


def listed_entries(
    entries: DataFrame,
    selected: DataFrame,
    options: Options,
    labels: DataFrame | None = None,
    show_labels: bool = False,
) -> DataFrame:
    """Kept files and directories with type, label, size and line count.

    Line counts are taken inside the scan, only where the row-local rules keep the
    file, and only the narrow result is joined and written. Contents that are only named are
    read for the kept files that may be counted.
    """
    path = F.col("path")
    entries = with_content_column(entries)
    if refers(entries):
        countable = F.lit(options.loc != "off") & ~has_binary_extension(path)
        files = with_contents(kept_files(entries, selected, options.rules), countable, COUNT_LIMIT_BYTES)
    else:
        files = with_decision(walkable(entries).where(~F.col("is_dir")), options.rules).where(F.col("decision") == "include")
    files = with_size(files)
    if options.loc == "off":
        loc = F.lit(None).cast("bigint")
    else:
        loc = lines_of_code(
            path,
            F.col("content"),
            F.col("size_bytes"),
            mode=options.loc,
            is_text=is_text_column(files),
        )
    measured = files.select("corpus_id", "path", "size_bytes", loc.alias("loc"))
    kept = selected.where(F.col("decision") == "include").select("corpus_id", "path", "is_dir")
    joined = kept.join(measured, ["corpus_id", "path"], "left").withColumn(
        "file_type", F.when(~F.col("is_dir"), file_type(path)).otherwise("Directory")
    )
    return materialize(with_label(joined, labels, show_labels), "listed")


def _stats_rows(listed: DataFrame, mode: str, charset: str, corpora: DataFrame) -> DataFrame:
    """Report rows after the tree, with the blank line that parts them."""
    lines = stats_lines(listed, mode, charset, corpora).select(
        "corpus_id", (F.col("seq") + 1).alias("seq"), "line"
    )
    blank = corpora.select(
        "corpus_id", F.lit(0).alias("seq"), F.lit("").alias("line")
    )
    return blank.unionByName(lines).select(
        "corpus_id",
        F.lit(1).alias("block"),
        F.lpad(F.col("seq").cast("string"), 4, "0").alias("sort_key"),
        "line",
    )


def plain_listing(
    entries: DataFrame,
    options: Options = Options(),
    layers: DataFrame | None = None,
    in_repository: DataFrame | None = None,
    corpora: DataFrame | None = None,
) -> DataFrame:
    """Tree, report and optional sections as rows ``(corpus_id, block, sort_key, line)``.

    Ordered by block and sort key they are the document of a corpus;
    :func:`numbered_document` numbers the rows and
    :func:`arborlake.sources.sinks.write_listing` writes them. Every corpus with any entry
    has a document, whatever the selection leaves of it. ``corpora`` is as in
    :func:`selection`.
    """
    entries = with_content_column(entries)
    selected = materialize(selection(entries, options, layers, in_repository, corpora), "selection")
    listed = listed_entries(entries, selected, options)
    every = materialize(corpora_of(entries), "corpora")
    rows = tree_lines(listed, options.charset, every).select(
        "corpus_id", F.lit(0).alias("block"), "sort_key", "line"
    )
    if options.stats != "off":
        rows = rows.unionByName(_stats_rows(listed, options.stats, "ascii", every))
    if options.contents:
        shown = None
        if options.display:
            root, seen_from = options.display
            shown = display_path(F.concat(F.lit(root.rstrip("/") + "/"), F.col("path")), seen_from)
        files = with_contents(kept_files(entries, selected, options.rules), ~has_binary_extension(F.col("path")))
        sections = pack(files, options.max_bytes, options.contents_mode, display=shown)
        rows = rows.unionByName(
            sections.select(
                "corpus_id",
                F.lit(2).alias("block"),
                "sort_key",
                F.regexp_replace("section", r"\n\z", "").alias("line"),
            )
        )
    return rows


def numbered_document(rows: DataFrame) -> DataFrame:
    """The rows of a listing as ``(corpus_id, block, seq, line)``, numbered from 1 in each corpus."""
    return numbered(rows, "block", "sort_key").select("corpus_id", "block", "seq", "line")


def annotated_listing(
    entries: DataFrame,
    options: Options = Options(charset="unicode"),
    layers: DataFrame | None = None,
    labels: DataFrame | None = None,
    show_labels: bool = False,
    in_repository: DataFrame | None = None,
    corpora: DataFrame | None = None,
) -> DataFrame:
    """Tree rows with bar, class and outlier columns, and the report rows of every corpus."""
    entries = with_content_column(entries)
    selected = selection(entries, options, layers, in_repository, corpora)
    listed = listed_entries(entries, selected, options, labels, show_labels)
    rows = annotated_lines(listed, options.charset).select(
        "corpus_id",
        F.lit(0).alias("block"),
        "sort_key",
        F.concat_ws(
            "  ", "line", "bar", "loc_label", F.concat(F.lit("("), "loc_class", F.lit(")"), "star")
        ).alias("line"),
    )
    if options.stats == "off":
        return rows
    charset = "ascii" if options.charset == "ascii" else "unicode"
    return rows.unionByName(_stats_rows(listed, options.stats, charset, materialize(corpora_of(entries), "corpora")))
