"""Which entries are kept, and which rule decided."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property, reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arborlake.functions.globs import (
    anchored,
    anchored_directory,
    any_ancestor,
    glob_bodies,
    glob_set_regex,
    normalize_pattern,
    static_prefix,
)
from arborlake.functions.paths import ancestors_of, depth_of, extension_of, match_form
from arborlake.operators.ignore import ignored_entries
from arborlake.operators.inventory import all_entries, walkable
from arborlake.operators.ranges import BELOW, with_codes
from arborlake.operators.scratch import is_empty, lookup, materialize, without_keys

# ---------------------------------------------------------------------------
# The safety preset.
SAFETY_PATTERNS = (
    # environment files
    ".env", ".env.*",
    # keys
    ".ssh/**", "**/.ssh/**", "*.pem", "*.key", "*.p12", "*.pfx",
    "*_rsa", "*_dsa", "*_ecdsa", "*_ed25519", "id_*",
    # credentials
    "*.crt", "*.cer", "*.der", "*.keystore", "*.jks",
    "credentials", "credentials.*", "**/credentials", "**/credentials.*",
    "secrets", "secrets.*", "**/secrets", "**/secrets.*",
    # build output
    "target/**", "**/target/**", "node_modules/**", "**/node_modules/**",
    "vendor/**", "**/vendor/**", "dist/**", "**/dist/**",
    "build/**", "**/build/**", ".build/**", "**/.build/**", "out/**", "**/out/**",
    # package managers
    ".npm/**", "**/.npm/**", ".yarn/**", "**/.yarn/**",
    ".pnpm-store/**", "**/.pnpm-store/**",
    # editors
    ".idea/**", "**/.idea/**", ".vscode/**", "**/.vscode/**", "*.swp", "*.swo", "*~",
    # operating systems
    ".DS_Store", "Thumbs.db", "desktop.ini",
    # caches
    ".cache/**", "**/.cache/**", "__pycache__/**", "**/__pycache__/**", "*.pyc",
    # repository data
    ".git/**", "**/.git/**",
    # logs and temporary files
    "logs/**", "**/logs/**", "*.log", "tmp/**", "**/tmp/**", "temp/**", "**/temp/**",
)
# ---------------------------------------------------------------------------

KEEP_REASONS = ("path_include", "included", "default")
PRUNE_REASONS = ("repository_data", "ignored", "unsafe", "excluded")


def _any(terms: list[Column]) -> Column:
    return reduce(or_, terms, F.lit(False))


@dataclass(frozen=True)
class SelectionRules:
    """Declarative rules; patterns are checked and translated when first built.

    ``include_ext`` holds extensions with their dot. ``case_sensitive`` affects
    only that set. A malformed pattern raises ``ValueError``.
    """

    include: tuple[str, ...] = ()
    exclude: tuple[str, ...] = ()
    include_ext: tuple[str, ...] = ()
    case_sensitive: bool = True
    safety: bool = True
    max_depth: int | None = None

    def __post_init__(self) -> None:
        for field in ("include", "exclude", "include_ext"):
            object.__setattr__(self, field, tuple(getattr(self, field)))
        self._include_regex, self._exclude_bodies  # noqa: B018 - fail while planning

    @cached_property
    def include_patterns(self) -> list[str]:
        return [normalize_pattern(p) for p in self.include]

    @cached_property
    def _include_regex(self) -> str | None:
        return glob_set_regex(self.include_patterns) if self.include else None

    @cached_property
    def _exclude_bodies(self) -> list[str]:
        return glob_bodies([normalize_pattern(p) for p in self.exclude])

    @cached_property
    def _safety_bodies(self) -> list[str]:
        return glob_bodies(SAFETY_PATTERNS, "plain") if self.safety else []

    @cached_property
    def _located(self) -> list[str]:
        """Include patterns that name a place rather than any depth."""
        return [p for p in self.include_patterns if not p.startswith("**/")]

    @property
    def has_includes(self) -> bool:
        return bool(self.include or self.include_ext)

    # -- tests on one path ---------------------------------------------------

    def _included(self, path: Column) -> Column:
        terms = []
        if self.include_ext:
            ext = F.concat(F.lit("."), extension_of(path))
            wanted = self.include_ext
            if not self.case_sensitive:
                ext, wanted = F.lower(ext), tuple(e.lower() for e in wanted)
            terms.append(F.coalesce(ext.isin(*wanted), F.lit(False)))
        if self._include_regex:
            terms.append(match_form(path).rlike(self._include_regex))
        return _any(terms)

    def _located_include(self, path: Column) -> Column:
        if not self._located:
            return F.lit(False)
        return match_form(path).rlike(glob_set_regex(self._located))

    def holds_located_include(self, directory: Column) -> Column:
        """A located include pattern points into this directory or above it."""
        inside = F.concat(match_form(directory), F.lit("/"))
        terms = []
        for pattern in self._located:
            terms.append(F.startswith(F.lit(pattern), inside))
            if static_prefix(pattern):
                terms.append(F.startswith(inside, F.lit(static_prefix(pattern))))
        return _any(terms)

    def _may_hold_include(self, directory: Column) -> Column:
        if len(self._located) < len(self.include_patterns):
            return F.lit(True)
        return self.holds_located_include(directory)

    # -- decisions -----------------------------------------------------------

    def file_reason(self, path: Column, ignored: Column | None = None) -> Column:
        """Name of the first rule that decides a file."""
        chain = F
        if self.has_includes:
            chain = chain.when(~self._included(path), "not_included")
        if self._located:
            chain = chain.when(self._located_include(path), "path_include")
        if self.exclude:
            chain = chain.when(match_form(path).rlike(anchored(self._exclude_bodies)), "excluded")
        if self.has_includes:
            return chain.otherwise("included") if chain is not F else F.lit("included")
        if ignored is not None:
            chain = chain.when(ignored, "ignored")
        if self.safety:
            chain = chain.when(match_form(path).rlike(anchored(self._safety_bodies)), "unsafe")
        return F.lit("default") if chain is F else chain.otherwise("default")

    def dir_reason(self, path: Column) -> Column:
        """Name of the first rule, ignore files aside, that decides a directory."""
        form = match_form(path)
        closed = F.concat(form, F.lit("/"))
        chain = F.when((form == ".git") | form.startswith(".git/"), "repository_data")
        if self._located:
            chain = chain.when(self.holds_located_include(path), "path_include")
        if self.safety:
            chain = chain.when(closed.rlike(anchored_directory(self._safety_bodies)), "unsafe")
        if self.has_includes:
            chain = chain.when(self._included(path) | self._may_hold_include(path), "included")
        if self.exclude:
            chain = chain.when(closed.rlike(anchored_directory(self._exclude_bodies)), "excluded")
        return chain.otherwise("default")

    def prunes_above(self, path: Column) -> Column:
        """Some proper ancestor of the path is pruned.

        Without include rules one regex over the path finds it. With them each
        ancestor is judged, because an include may keep it.
        """
        if self.has_includes:
            return F.exists(
                ancestors_of(path), lambda d: self.dir_reason(d).isin(*PRUNE_REASONS)
            )
        bodies = [r"\.git", *self._safety_bodies, *self._exclude_bodies]
        return match_form(path).rlike(any_ancestor(bodies))

    def within_depth(self, path: Column) -> Column:
        return F.lit(True) if self.max_depth is None else depth_of(path) <= self.max_depth


def with_decision(entries: DataFrame, rules: SelectionRules) -> DataFrame:
    """Add ``decision`` and ``reason`` from the rules alone, row by row.

    No join and no shuffle: whether an ancestor is pruned is read off the path.
    Other columns ride along, and a streaming frame works too. Ignore files and
    nested repositories depend on other rows and need :func:`select_entries`.
    """
    path, is_dir = F.col("path"), F.col("is_dir")
    under = rules.prunes_above(path)
    own = F.when(is_dir, rules.dir_reason(path)).otherwise(rules.file_reason(path))
    reason = F.when(~rules.within_depth(path), "too_deep").when(under, "under_pruned_dir")
    return entries.withColumn("reason", reason.otherwise(own)).withColumn("decision", _decision())


def _decision() -> Column:
    reason, is_dir = F.col("reason"), F.col("is_dir")
    return (
        F.when(reason.isin(*KEEP_REASONS), "include")
        .when(is_dir & reason.isin(*PRUNE_REASONS, "nested_repository"), "prune")
        .otherwise("exclude")
    )


def nested_repositories(entries: DataFrame) -> DataFrame:
    """Directories below the root that hold a ``.git`` entry, file or directory.

    Symlinks count here: the test is whether the name exists.
    """
    inner = F.col("path").rlike(r"/\.git(/|\z)")
    segments = F.split("path", "/")
    at = F.filter(
        F.sequence(F.lit(2), F.size(segments)), lambda i: F.element_at(segments, i) == ".git"
    )
    root = F.call_function("substring_index", F.col("path"), F.lit("/"), F.col("at") - 1)
    return (
        entries.where(inner)
        .select("corpus_id", "path", F.explode(at).alias("at"))
        .select("corpus_id", root.alias("path"))
        .distinct()
    )


def select_entries(
    entries: DataFrame,
    rules: SelectionRules,
    *,
    layers: DataFrame | None = None,
    nested_repository_boundary: bool = True,
) -> DataFrame:
    """Decide every file and directory of every corpus.

    Returns ``(corpus_id, path, is_dir, decision, reason)`` for all entries within
    the depth limit. Only paths take part; join the result back on
    ``(corpus_id, path)`` to reach the content.
    """
    names = entries.select(
        "corpus_id", "path", "is_dir", *[c for c in ("is_symlink",) if c in entries.columns]
    )
    listed = all_entries(walkable(names)).where(rules.within_depth(F.col("path")))
    decided = with_decision(listed, rules).drop("decision")
    data_rules = layers is not None or nested_repository_boundary
    if data_rules:
        # Read by the ignore join, the prune join and the final join: written once.
        decided = materialize(decided, "decided")
        decided = _apply_data_rules(
            decided,
            rules,
            layers,
            nested_repositories(names) if nested_repository_boundary else None,
        )
    if rules.has_includes or nested_repository_boundary:
        decided = _drop_empty_directories(decided, rules)
    return decided.withColumn("decision", _decision()).select(
        "corpus_id", "path", "is_dir", "decision", "reason"
    )


def _apply_data_rules(
    decided: DataFrame,
    rules: SelectionRules,
    layers: DataFrame | None,
    repositories: DataFrame | None,
) -> DataFrame:
    """Overlay what other rows decide: ignore files and repository boundaries.

    The marks are the ignored entries and the repository roots. An entry falls when it
    carries a mark or lies below a marked directory, which one ordered sweep tells.
    """
    key = ["corpus_id", "path"]
    path = F.col("path")
    live = decided.where(F.col("reason") != "under_pruned_dir")
    marks = []
    if layers is not None:
        # With include rules, every file is settled before ignore files are asked.
        asked = live.where("is_dir") if rules.has_includes else live
        ignored = materialize(
            ignored_entries(asked.select(*key, "is_dir"), layers).where(
                ~F.col("is_dir") | ~rules.holds_located_include(path)
            ),
            "ignored",
        )
        marks.append(ignored.select(*key, "is_dir", F.lit(1).alias("code")))
    if repositories is not None:
        marks.append(repositories.select(*key, F.lit(True).alias("is_dir"), F.lit(2).alias("code")))
    marked = reduce(DataFrame.unionByName, marks).groupBy(*key, "is_dir").agg(F.max("code").alias("code"))
    marked = materialize(marked, "marked")
    if is_empty(marked):
        return decided
    coded = with_codes(decided, marked)
    spared = F.col("reason").isin("repository_data", "path_include", "excluded", "not_included")
    spared = F.when(F.col("is_dir"), F.col("reason").isin("repository_data", "path_include")).otherwise(spared)
    fallen = F.col("reason") == "under_pruned_dir"
    return coded.withColumn(
        "reason",
        F.when(fallen | (F.col("code") == BELOW), "under_pruned_dir")
        .when(F.col("code") == 2, "nested_repository")
        .when((F.col("code") == 1) & ~spared, "ignored")
        .otherwise(F.col("reason")),
    ).drop("code")


def _drop_empty_directories(decided: DataFrame, rules: SelectionRules) -> DataFrame:
    """Mark kept directories without any kept file below as ``empty``.

    Applies to every corpus when include rules exist, else only to corpora where a
    nested repository was met.
    """
    decided = materialize(decided, "selected")
    key = ["corpus_id", "path"]
    kept_file = ~F.col("is_dir") & F.col("reason").isin(*KEEP_REASONS)
    alive = (
        decided.where(kept_file)
        .select("corpus_id", F.explode(ancestors_of(F.col("path"))).alias("path"))
        .distinct()
        .withColumn("alive", F.lit(True))
    )
    dirs = decided.where("is_dir").join(alive, key, "left")
    if rules.has_includes:
        applies = F.lit(True)
    else:
        met = (
            decided.where(F.col("reason") == "nested_repository")
            .select("corpus_id")
            .distinct()
            .withColumn("applies", F.lit(True))
        )
        met = materialize(met, "met-repositories")
        if is_empty(met):
            return decided
        dirs = lookup(dirs, met, ["corpus_id"], F.col("path"))
        applies = F.coalesce(F.col("applies"), F.lit(False))
    empty = applies & F.col("alive").isNull() & F.col("reason").isin(*KEEP_REASONS)
    marked = dirs.withColumn("reason", F.when(empty, "empty").otherwise(F.col("reason")))
    return decided.where(~F.col("is_dir")).unionByName(marked.select(*decided.columns))


def kept_files(entries: DataFrame, selected: DataFrame, rules: SelectionRules) -> DataFrame:
    """File rows, content included, that the selection keeps.

    The row-local rules filter the content where it is read. What remains is the set
    of files lost to ignore files and repository boundaries; it is subtracted with a
    broadcast when its measured size allows, so that content is not shuffled then.
    """
    key = ["corpus_id", "path"]
    local = with_decision(walkable(entries).where(~F.col("is_dir")), rules)
    lost = with_decision(
        selected.where(~F.col("is_dir") & (F.col("decision") != "include")).select(*key, "is_dir"),
        rules,
    ).where(F.col("decision") == "include")
    return without_keys(
        local.where(F.col("decision") == "include").drop("decision", "reason"),
        materialize(lost.select(*key), "lost"),
        key,
    )
