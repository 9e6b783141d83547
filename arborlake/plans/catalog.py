"""Registered queries: each operator over the driver tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arborlake.functions import classify, labels, lines, paths
from arborlake.operators import ignore, inventory, layout, packing, selection, stats
from arborlake.operators.scratch import lookup, materialize, scratch_folder
from arborlake.operators.selection import SelectionRules
from arborlake.plans import jobs
from arborlake.sources import contents as referred
from arborlake.sources import driver_tables as tables
from arborlake.sources import entries as sources

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

HEAD_BUDGET = 200_000
NEST_BUDGET = 450_000
TIGHT_BUDGET = 120_000
WIDE_BUDGET = 400_000
MIXED_RULES = SelectionRules(
    include=("*.rs", "*.md", "src3/**/*.py"), exclude=("docs", "src3/vendor/**", "test_*.rs")
)
PRUNE_RULES = SelectionRules(exclude=("docs", "core/", "src1*/config/**", "*.sql"))
LABEL_ROWS = [("ext", ".rs", "R"), ("type", "python", "P"), ("type", "md", "M"), ("type", "nope", "X")]
TYPE_LABELS = [("ext", "log", "L"), ("ext", "png", "I"), ("ext", "lock", "K"), ("ext", "pem", "E")]
LABEL_ARGUMENTS = [".rs=R", "docs=M", "nope=X", "plain", "py=p", "python=P", ".tsx=T"]
IGNORE_ROWS = [
    ("en", "", 0, 0, "*.log"),
    ("en", "", 0, 1, "!f21.log"),
    ("en", "", 0, 2, "build/"),
    ("de", "", 0, 0, "/src1"),
    ("fr", "src4", 1, 0, "docs/"),
    ("es", "src0/src", 1, 0, "*.py"),
]
UNSAFE = SelectionRules(safety=False)
REPOSITORY_FILES = [
    ("en", ".git/HEAD", "ref"),
    ("en", ".gitignore", "*.log\n!f1*.md\n"),
    ("en", "sub/.gitignore", "*.md\n"),
    ("fr", ".gitignore", "*.py\n"),
    ("es", ".git/info/exclude", "*.sql\n"),
]


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def _typed(files: DataFrame) -> DataFrame:
    return files.withColumn("file_type", classify.file_type(F.col("path")))


def _with_loc(files: DataFrame, mode: str = "fast") -> DataFrame:
    loc = lines.lines_of_code(
        F.col("path"), F.col("content"), F.col("size_bytes"), mode=mode, is_text=True
    )
    return files.withColumn("loc", loc)


def _with_dirs(files: DataFrame) -> DataFrame:
    """Files plus their directories, keeping the file columns."""
    dirs = inventory.directories(files).withColumn("is_dir", F.lit(True))
    return files.unionByName(dirs, allowMissingColumns=True)


def _key(name: str = "sort_key"):
    return F.hex(F.col(name).cast("binary")).alias("sort_hex")


# -- inventory ---------------------------------------------------------------


@query
def path_columns(spark: SparkSession, sf: str) -> DataFrame:
    files = tables.files_from_documents(spark, sf)
    return inventory.with_path_columns(files.select("corpus_id", "path"))


@query
def entry_listing(spark: SparkSession, sf: str) -> DataFrame:
    return inventory.all_entries(tables.files_from_documents(spark, sf))


@query
def rejected_entries(spark: SparkSession, sf: str) -> DataFrame:
    files = tables.files_from_documents(spark, sf)
    broken = F.concat(F.unhex(F.lit("FF")), F.col("path").cast("binary")).cast("string")
    odd = files.select(
        "corpus_id",
        F.when(F.octet_length("path") % 7 == 0, broken).otherwise(F.col("path")).alias("path"),
        "is_dir",
        (F.octet_length("path") % 5 == 0).alias("is_symlink"),
    )
    return (
        inventory.rejected_entries(odd)
        .groupBy("corpus_id", "reject_reason")
        .agg(F.count(F.lit(1)).alias("n"))
    )


@query
def walkable_entries(spark: SparkSession, sf: str) -> DataFrame:
    files = tables.files_from_documents(spark, sf)
    odd = files.withColumn("is_symlink", F.octet_length("path") % 5 == 0)
    return inventory.walkable(odd).select("corpus_id", "path")


@query
def manifest_hints(spark: SparkSession, sf: str) -> DataFrame:
    files = tables.files_from_documents(spark, sf)
    shown = F.when(F.octet_length("path") % 3 == 0, F.concat("path", F.lit("/"))).otherwise(F.col("path"))
    manifest = files.select("corpus_id", shown.alias("path"))
    return inventory.with_entry_defaults(manifest).select("corpus_id", "path", "is_dir", "is_symlink")


@query
def dir_children(spark: SparkSession, sf: str) -> DataFrame:
    return inventory.child_counts(_with_dirs(tables.files_from_documents(spark, sf)))


@query
def dir_parent_join(spark: SparkSession, sf: str) -> DataFrame:
    return inventory.attach_to_parent(_with_empty_dirs(tables.files_from_documents(spark, sf)))


def _with_empty_dirs(files: DataFrame) -> DataFrame:
    """Adds an explicit empty directory beside every Dockerfile directory."""
    extra = files.where(F.col("path").endswith("/Dockerfile")).select(
        "corpus_id",
        F.concat(paths.parent_of(F.col("path")), F.lit("/empty")).alias("path"),
        F.lit(True).alias("is_dir"),
    )
    return inventory.all_entries(
        files.select("corpus_id", "path", "is_dir").unionByName(extra)
    )


@query
def empty_dirs(spark: SparkSession, sf: str) -> DataFrame:
    return inventory.empty_directories(_with_empty_dirs(tables.files_from_documents(spark, sf)))


# -- paths -------------------------------------------------------------------


@query
def path_clean(spark: SparkSession, sf: str) -> DataFrame:
    files = tables.files_from_documents(spark, sf)
    size = F.octet_length("path")
    messy = (
        F.when(size % 4 == 0, F.concat(F.lit("./"), F.replace("path", F.lit("/"), F.lit("//"))))
        .when(size % 4 == 1, F.concat(F.lit("//"), F.col("path"), F.lit("///")))
        .when(size % 4 == 2, F.replace("path", F.lit("/"), F.lit("\\")))
        .otherwise(F.replace("path", F.lit("/"), F.lit("/./")))
    )
    return files.select(
        "corpus_id",
        messy.alias("written"),
        paths.clean_path(messy).alias("cleaned"),
        paths.match_form(messy).alias("match_form"),
        paths.has_directory_hint(messy).alias("dir_hint"),
    )


@query
def path_relative(spark: SparkSession, sf: str) -> DataFrame:
    files = tables.files_from_documents(spark, sf)
    placed = files.select(
        "corpus_id", F.concat(F.lit("/lake/"), F.col("path")).alias("path"), "is_dir"
    )
    return sources.below_root(placed, "/lake/src1").select("corpus_id", "path")


@query
def path_display(spark: SparkSession, sf: str) -> DataFrame:
    files = tables.files_from_documents(spark, sf)
    placed = F.concat(F.lit("/lake/"), F.col("path"))
    return files.select(
        "corpus_id",
        "path",
        paths.display_path(placed, "/lake/src1/docs").alias("shown"),
        paths.inside_root(placed, "/lake/src1").alias("inside"),
    )


# -- classification ----------------------------------------------------------


@query
def type_breakdown(spark: SparkSession, sf: str) -> DataFrame:
    files = _typed(tables.files_from_documents(spark, sf).select("corpus_id", "path"))
    return stats.type_breakdown(files).select(
        "corpus_id", "rank", "file_type", "type_name", "n_files", "share"
    )


@query
def file_types(spark: SparkSession, sf: str) -> DataFrame:
    files = tables.files_from_documents(spark, sf).select("corpus_id", "path")
    typed = _typed(files)
    return typed.withColumn("type_name", classify.type_display_name(F.col("file_type")))


@query
def lang_hint(spark: SparkSession, sf: str) -> DataFrame:
    files = tables.files_from_documents(spark, sf)
    return files.select("corpus_id", "path", classify.language_hint(F.col("path")).alias("language"))


@query
def profile_registry(spark: SparkSession, sf: str) -> DataFrame:
    profiles = spark.createDataFrame(classify.profile_rows(), "priority int, ext string, file_type string")
    files = tables.files_from_documents(spark, sf).select("corpus_id", "path")
    return classify.with_profile_type(files, profiles)


@query
def labels_join(spark: SparkSession, sf: str) -> DataFrame:
    written = spark.createDataFrame(LABEL_ROWS, "kind string, key string, label string")
    files = _typed(tables.files_from_documents(spark, sf).select("corpus_id", "path"))
    return classify.with_label(files, classify.labels_from_table(written))


@query
def label_arguments(spark: SparkSession, sf: str) -> DataFrame:
    rows = classify.parse_label_arguments(LABEL_ARGUMENTS)
    overrides = spark.createDataFrame(rows, "kind string, key string, label string")
    files = _typed(tables.files_from_documents(spark, sf).select("corpus_id", "path"))
    return classify.with_label(files, overrides)


@query
def binary_gate(spark: SparkSession, sf: str) -> DataFrame:
    files = tables.files_from_documents(spark, sf)
    size = F.octet_length("path")
    content = (
        F.when(size % 7 == 0, F.concat("content", F.lit("\u0000")))
        .when(size % 5 == 0, F.replace("content", F.lit("e"), F.lit("\u0001")))
        .otherwise(F.col("content"))
    )
    sample = classify.probe_sample(content, is_text=True)
    return files.select(
        "corpus_id",
        "path",
        classify.has_binary_extension(F.col("path")).alias("binary_ext"),
        classify.looks_binary(content, is_text=True).alias("looks_binary"),
        F.octet_length(sample).alias("sample_bytes"),
        classify.too_large_to_count(F.octet_length(content) * 1000).alias("too_large"),
    )


@query
def readable_text(spark: SparkSession, sf: str) -> DataFrame:
    files = tables.files_from_documents(spark, sf)
    raw = F.col("content").cast("binary")
    broken = F.when(F.octet_length("path") % 3 == 0, F.concat(raw, F.unhex(F.lit("C3")))).otherwise(raw)
    odd = files.withColumn("content", broken)
    return packing.readable_files(odd).select(
        "corpus_id", "path", F.octet_length("text").alias("n_bytes")
    )


# -- lines -------------------------------------------------------------------


@query
def loc_fast(spark: SparkSession, sf: str) -> DataFrame:
    return _with_loc(tables.files_from_documents(spark, sf)).select("corpus_id", "path", "loc")


@query
def loc_accurate(spark: SparkSession, sf: str) -> DataFrame:
    files = tables.files_from_documents(spark, sf)
    marked = F.regexp_replace("content", r"(?m)^([A-M])", "  # $1")
    counted = _with_loc(files.withColumn("content", marked), "accurate")
    return counted.select("corpus_id", "path", "loc")


@query
def loc_class_bar(spark: SparkSession, sf: str) -> DataFrame:
    files = materialize(
        _with_loc(tables.files_from_documents(spark, sf))
        .select("corpus_id", "path", "loc")
        .withColumn("parent", paths.parent_of(F.col("path"))),
        "loc",
    )
    largest = materialize(stats.max_loc_per_directory(files), "dir-max-loc")
    scaled = lookup(files, largest, ["corpus_id", "parent"], F.col("path"))
    loc = F.col("loc")
    return scaled.select(
        "corpus_id",
        "path",
        "loc",
        labels.loc_class(loc).alias("loc_class"),
        labels.loc_label(loc).alias("loc_label"),
        labels.loc_bar(loc, F.col("max_loc")).alias("bar"),
    )


@query
def loc_outliers(spark: SparkSession, sf: str) -> DataFrame:
    files = _with_loc(tables.files_from_documents(spark, sf)).select("corpus_id", "path", "loc")
    return stats.with_outlier(materialize(files, "loc"))


@query
def size_class(spark: SparkSession, sf: str) -> DataFrame:
    files = tables.files_from_documents(spark, sf)
    # Squared sizes spread over all classes and units.
    wide = F.col("size_bytes") * F.col("size_bytes")
    return files.select(
        "corpus_id",
        "path",
        "size_bytes",
        labels.human_size(F.col("size_bytes")).alias("human"),
        labels.human_size(wide).alias("wide_human"),
        labels.size_class(wide).alias("badge"),
        labels.size_tick(wide).alias("tick"),
    )


# -- statistics --------------------------------------------------------------


@query
def corpus_totals(spark: SparkSession, sf: str) -> DataFrame:
    files = _with_loc(tables.files_from_documents(spark, sf)).select("corpus_id", "path", "is_dir", "loc")
    return stats.corpus_totals(_with_dirs(files))


@query
def type_loc(spark: SparkSession, sf: str) -> DataFrame:
    files = _with_loc(tables.files_from_documents(spark, sf)).select("corpus_id", "path", "loc")
    return stats.type_counts(_typed(files))


@query
def type_labels(spark: SparkSession, sf: str) -> DataFrame:
    """Counts per type with the label of its first file, where labels by extension divide types."""
    given = spark.createDataFrame(TYPE_LABELS, "kind string, key string, label string")
    files = _with_loc(_typed(tables.files_from_documents(spark, sf)))
    return stats.type_counts(classify.with_label(files.drop("content"), given))


@query
def ext_counts(spark: SparkSession, sf: str) -> DataFrame:
    return stats.extension_counts(tables.files_from_documents(spark, sf).select("corpus_id", "path"))


@query
def ext_top5(spark: SparkSession, sf: str) -> DataFrame:
    return stats.top_extensions(tables.files_from_documents(spark, sf).select("corpus_id", "path"))


@query
def name_width(spark: SparkSession, sf: str) -> DataFrame:
    return stats.name_width(tables.files_from_documents(spark, sf))


def _stats_input(spark: SparkSession, sf: str) -> DataFrame:
    files = _typed(_with_loc(tables.files_from_documents(spark, sf))).select(
        "corpus_id", "path", "is_dir", "loc", "file_type"
    )
    return materialize(_with_dirs(classify.with_label(files)), "stats-input")


@query
def stats_min(spark: SparkSession, sf: str) -> DataFrame:
    return stats.stats_lines(_stats_input(spark, sf), "min")


@query
def stats_full(spark: SparkSession, sf: str) -> DataFrame:
    return stats.stats_lines(_stats_input(spark, sf), "full", "unicode")


@query
def stats_footer(spark: SparkSession, sf: str) -> DataFrame:
    return stats.stats_lines(_stats_input(spark, sf), "footer")


@query
def url_tree_totals(spark: SparkSession, sf: str) -> DataFrame:
    files = tables.files_from_pages(spark, sf).select("corpus_id", "path", "is_dir", "size_bytes")
    totals = stats.corpus_totals(_with_dirs(files.drop("size_bytes")))
    sizes = files.groupBy("corpus_id").agg(F.sum("size_bytes").alias("total_bytes"))
    return totals.drop("loc").join(sizes, "corpus_id")


@query
def url_type_breakdown(spark: SparkSession, sf: str) -> DataFrame:
    files = _typed(tables.files_from_pages(spark, sf).select("corpus_id", "path"))
    return stats.type_breakdown(files).select("corpus_id", "rank", "file_type", "n_files", "share")


# -- selection ---------------------------------------------------------------


@query
def depth_limit(spark: SparkSession, sf: str) -> DataFrame:
    rules = SelectionRules(safety=False, max_depth=2)
    return selection.select_entries(
        tables.files_from_documents(spark, sf), rules, nested_repository_boundary=False
    ).select("corpus_id", "path", "is_dir")


@query
def include_exclude(spark: SparkSession, sf: str) -> DataFrame:
    files = tables.files_from_documents(spark, sf).select("corpus_id", "path", "is_dir")
    return selection.with_decision(files, MIXED_RULES).drop("is_dir")


@query
def include_ext(spark: SparkSession, sf: str) -> DataFrame:
    rules = SelectionRules(include_ext=(".RS", ".Py"), case_sensitive=False)
    files = tables.files_from_documents(spark, sf).select("corpus_id", "path", "is_dir")
    return selection.with_decision(files, rules).drop("is_dir")


@query
def dir_prune(spark: SparkSession, sf: str) -> DataFrame:
    return selection.select_entries(
        tables.files_from_documents(spark, sf), PRUNE_RULES, nested_repository_boundary=False
    )


@query
def include_tree(spark: SparkSession, sf: str) -> DataFrame:
    return selection.select_entries(tables.files_from_documents(spark, sf), MIXED_RULES)


@query
def safety_filter(spark: SparkSession, sf: str) -> DataFrame:
    files = tables.files_from_documents(spark, sf).select("corpus_id", "path", "is_dir")
    return selection.with_decision(files, SelectionRules()).drop("is_dir")


@query
def safety_off(spark: SparkSession, sf: str) -> DataFrame:
    files = tables.files_from_documents(spark, sf).select("corpus_id", "path", "is_dir")
    return selection.with_decision(files, UNSAFE).drop("is_dir")


def _ignoring(spark: SparkSession, files: DataFrame, root: bool) -> DataFrame:
    rows = [r for r in IGNORE_ROWS if (r[1] == "") == root]
    layers = ignore.active_layers(ignore.layers_from_rows(spark, rows), "always", files)
    return selection.select_entries(files, UNSAFE, layers=layers, nested_repository_boundary=False)


@query
def ignore_root(spark: SparkSession, sf: str) -> DataFrame:
    return _ignoring(spark, tables.files_from_documents(spark, sf), True)


@query
def ignore_nested(spark: SparkSession, sf: str) -> DataFrame:
    return _ignoring(spark, tables.files_from_documents(spark, sf), False)


@query
def ignore_auto(spark: SparkSession, sf: str) -> DataFrame:
    """Only corpora with a ``.git`` entry at the root apply their rules."""
    files = tables.files_from_documents(spark, sf).select("corpus_id", "path", "is_dir")
    marks = files.where(F.col("corpus_id").isin("en", "fr")).select(
        "corpus_id", F.lit(".git/HEAD").alias("path"), "is_dir"
    )
    entries = files.unionByName(marks.distinct())
    layers = ignore.active_layers(ignore.layers_from_rows(spark, IGNORE_ROWS), "auto", entries)
    return selection.select_entries(
        entries, UNSAFE, layers=layers, nested_repository_boundary=False
    )


@query
def ignore_files(spark: SparkSession, sf: str) -> DataFrame:
    """Rules read from ``.gitignore`` rows at the root and in each ``docs`` directory."""
    files = tables.files_from_documents(spark, sf).select("corpus_id", "path", "is_dir", "content")
    root = files.select("corpus_id").distinct().select(
        "corpus_id",
        F.lit(".gitignore").alias("path"),
        F.lit(False).alias("is_dir"),
        F.lit("# tools\n\n*.yml\n!f1*.yml\n/src2/\ntarget/\n").alias("content"),
    )
    nested = (
        files.where(F.col("path").rlike(r"\Asrc\d+/docs/"))
        .select(
            "corpus_id",
            F.regexp_replace("path", r"\A(src\d+/docs/).*\z", "$1.gitignore").alias("path"),
        )
        .distinct()
        .select(
            "corpus_id",
            "path",
            F.lit(False).alias("is_dir"),
            F.lit("*.md\r\n/d*\r\n!f1*.yml\r\n").alias("content"),
        )
    )
    entries = files.unionByName(root).unionByName(nested)
    return selection.select_entries(
        entries, UNSAFE, layers=ignore.layers_from_files(entries), nested_repository_boundary=False
    )


@query
def nested_repo_prune(spark: SparkSession, sf: str) -> DataFrame:
    entries = tables.with_repository_marks(tables.files_from_documents(spark, sf))
    return selection.select_entries(entries, SelectionRules())


# -- layout ------------------------------------------------------------------


@query
def tree_rows(spark: SparkSession, sf: str) -> DataFrame:
    files = _with_loc(tables.files_from_documents(spark, sf)).select("corpus_id", "path", "is_dir", "loc")
    listed = materialize(_with_dirs(files), "tree-input")
    return layout.tree_lines(listed).select("corpus_id", _key(), "line")


@query
def url_tree_rows(spark: SparkSession, sf: str) -> DataFrame:
    files = tables.files_from_pages(spark, sf).select("corpus_id", "path", "is_dir")
    listed = materialize(_with_dirs(files), "url-tree-input")
    return layout.tree_lines(listed, "ascii").select("corpus_id", _key(), "line")


@query
def tree_annotated(spark: SparkSession, sf: str) -> DataFrame:
    files = _with_loc(_typed(tables.files_from_documents(spark, sf))).select(
        "corpus_id", "path", "is_dir", "loc", "file_type"
    )
    entries = _with_dirs(files).fillna({"file_type": "Directory"})
    listed = materialize(classify.with_label(entries), "tree-input")
    return layout.annotated_lines(listed).drop("sort_key")


# -- packing -----------------------------------------------------------------


@query
def readable_bytes(spark: SparkSession, sf: str) -> DataFrame:
    ready = packing.readable_files(tables.files_from_documents(spark, sf))
    return ready.groupBy("corpus_id").agg(F.sum(F.octet_length("text")).alias("n_bytes"))


@query
def pack_whole(spark: SparkSession, sf: str) -> DataFrame:
    return packing.pack(tables.files_from_documents(spark, sf)).select("corpus_id", "path", "section")


def _packed(frame: DataFrame) -> DataFrame:
    return frame.select("corpus_id", "path", "method", "n", "omitted", "section")


@query
def pack_fit(spark: SparkSession, sf: str) -> DataFrame:
    return _packed(packing.pack(tables.files_from_documents(spark, sf), WIDE_BUDGET))


@query
def pack_head(spark: SparkSession, sf: str) -> DataFrame:
    return _packed(packing.pack(tables.files_from_documents(spark, sf), HEAD_BUDGET))


@query
def pack_nest(spark: SparkSession, sf: str) -> DataFrame:
    files = tables.files_from_documents(spark, sf, indent=True)
    return _packed(packing.pack(files, NEST_BUDGET, "nest"))


@query
def pack_nest_tight(spark: SparkSession, sf: str) -> DataFrame:
    """A budget that some corpora meet by folding and others only by heads."""
    files = tables.files_from_documents(spark, sf, indent=True)
    return _packed(packing.pack(files, TIGHT_BUDGET, "nest"))


@query
def nest_parameters(spark: SparkSession, sf: str) -> DataFrame:
    """Method and parameter per corpus, with runs of a dozen lines and more."""
    files = tables.files_from_documents(spark, sf)
    blocks = F.array_join(
        F.transform(
            F.split("content", "\n"),
            lambda line, i: F.concat(F.repeat(F.lit(" "), F.floor(i / 12).cast("int") % 4), line),
        ),
        "\n",
    )
    ready = packing.readable_files(files.withColumn("content", blocks))
    steps = packing.budget_steps(ready, NEST_BUDGET, "nest")
    return packing.budget_parameters(steps, NEST_BUDGET, "nest")


@query
def fold_lines(spark: SparkSession, sf: str) -> DataFrame:
    files = tables.files_from_documents(spark, sf, indent=True)
    lined = packing.with_lines(files.withColumn("text", F.col("content")))
    return packing.with_folded(lined.withColumn("depth", F.lit(4)), "depth").select(
        "corpus_id", "path", F.col("fold.text").alias("text"), F.col("fold.omitted").alias("omitted")
    )


# -- whole jobs --------------------------------------------------------------


@query
def plain_listing(spark: SparkSession, sf: str) -> DataFrame:
    entries = tables.with_repository_marks(tables.files_from_documents(spark, sf))
    options = jobs.Options(contents=True, max_bytes=HEAD_BUDGET, stats="min")
    rows = jobs.plain_listing(entries, options)
    return rows.select("corpus_id", "block", _key(), "line")


@query
def referred_listing(spark: SparkSession, sf: str) -> DataFrame:
    """The plain listing of a manifest that names its contents and knows half of the sizes."""
    entries = tables.with_repository_marks(tables.files_from_documents(spark, sf))
    named = referred.refer_contents(entries, f"{scratch_folder(spark)}/contents")
    partly = named.withColumn("size_bytes", F.when(F.octet_length("path") % 2 == 0, F.col("size_bytes")))
    options = jobs.Options(contents=True, max_bytes=HEAD_BUDGET, stats="min")
    rows = jobs.plain_listing(partly, options)
    return rows.select("corpus_id", "block", _key(), "line")


@query
def annotated_listing(spark: SparkSession, sf: str) -> DataFrame:
    entries = tables.files_from_documents(spark, sf)
    rows = jobs.annotated_listing(entries, jobs.Options(charset="unicode", stats="full"))
    return rows.select("corpus_id", "block", _key(), "line")


@query
def numbered_listing(spark: SparkSession, sf: str) -> DataFrame:
    """The plain listing with its line numbers."""
    entries = tables.with_repository_marks(tables.files_from_documents(spark, sf))
    options = jobs.Options(contents=True, max_bytes=HEAD_BUDGET, stats="min")
    return jobs.numbered_document(jobs.plain_listing(entries, options))


@query
def bare_listing(spark: SparkSession, sf: str) -> DataFrame:
    """A manifest without contents, beside corpora of which nothing is kept."""
    files = tables.files_from_documents(spark, sf).select("corpus_id", "path", "is_dir")
    hollow = files.select(F.concat(F.lit("hollow-"), "corpus_id").alias("corpus_id"), "is_dir").distinct()
    entries = files.unionByName(hollow.withColumn("path", F.lit("node_modules/a.js")))
    rows = jobs.plain_listing(entries, jobs.Options(stats="min"))
    return rows.select("corpus_id", "block", _key(), "line")


@query
def ignore_above(spark: SparkSession, sf: str) -> DataFrame:
    """Auto mode of a whole job: repositories and rules above a root, at it, and of all users.

    The tree of ``de`` lies in that of ``en``, which is a repository; ``fr`` is in none.
    """
    files = tables.files_from_documents(spark, sf).select("corpus_id", "path", "is_dir", "content")
    extra = F.explode(F.array(*(F.struct(*map(F.lit, row)) for row in REPOSITORY_FILES))).alias("r")
    corpora = files.select("corpus_id").distinct()
    marks = corpora.select("corpus_id", extra).where(F.col("corpus_id") == F.col("r.col1"))
    entries = files.unionByName(
        marks.select("corpus_id", F.col("r.col2").alias("path"), F.lit(False).alias("is_dir"), F.col("r.col3").alias("content"))
    )
    root = F.when(F.col("corpus_id") == "de", F.lit("/lake/en/sub/de")).otherwise(F.concat(F.lit("/lake/"), "corpus_id"))
    options = jobs.Options(rules=UNSAFE, global_rules=("*.toml",))
    return jobs.selection(entries, options, corpora=corpora.withColumn("root", root))


@query
def manifest_sizes(spark: SparkSession, sf: str) -> DataFrame:
    """Sizes from the manifest, else from the content, else 0."""
    files = tables.files_from_documents(spark, sf)
    number = F.octet_length("path")
    partly = files.withColumns(
        {
            "size_bytes": F.when(number % 3 == 0, F.col("size_bytes")),
            "content": F.when(number % 2 == 0, F.col("content")),
        }
    )
    return sources.with_size(partly).select("corpus_id", "path", "size_bytes")


@query
def shown_sections(spark: SparkSession, sf: str) -> DataFrame:
    """Sections that name each path as it is seen from another directory."""
    files = tables.files_from_documents(spark, sf)
    options = jobs.Options(contents=True, stats="off", display=("/lake", "/lake/src1/docs"), rules=UNSAFE)
    rows = jobs.plain_listing(files, options).where("block = 2")
    return rows.select("corpus_id", _key(), F.substring_index(F.substring("line", 5, 1 << 30), "\n", 1).alias("heading"))
