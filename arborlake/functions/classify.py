"""Type, language, label and binary columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arborlake.functions.paths import extension_of, name_of

# ---------------------------------------------------------------------------
# The type table. type -> (display name, default label, extensions)
TYPES = {
    "Directory": ("Directory", "📁", ()),
    "Rust": ("Rust", "🦀", ("rs",)),
    "Python": ("Python", "🐍", ("py", "pyw")),
    "Go": ("Go", "🐹", ("go",)),
    "JavaScript": ("JavaScript", "✨", ("js", "mjs", "cjs")),
    "TypeScript": ("TypeScript", "✨", ("ts", "tsx")),
    "Java": ("Java", "☕", ("java",)),
    "CSharp": ("C#", "💜", ("cs",)),
    "CPlusPlus": ("C++", "🔧", ("cpp", "cc", "cxx", "hpp", "hxx")),
    "C": ("C", "🔧", ("c", "h")),
    "Swift": ("Swift", "🐦", ("swift",)),
    "Kotlin": ("Kotlin", "🦊", ("kt", "kts")),
    "Ruby": ("Ruby", "💎", ("rb",)),
    "Php": ("PHP", "🐘", ("php",)),
    "Shell": ("Shell", "🐚", ("sh", "bash", "zsh", "fish")),
    "Markdown": ("Markdown", "📘", ("md", "markdown")),
    "Text": ("Text", "📄", ("txt", "text")),
    "Json": ("JSON", "⚙️", ("json",)),
    "Yaml": ("YAML", "⚙️", ("yaml", "yml")),
    "Toml": ("TOML", "⚙️", ("toml",)),
    "Xml": ("XML", "⚙️", ("xml",)),
    "Ini": ("INI", "⚙️", ("ini", "cfg", "conf")),
    "License": ("License", "📜", ()),
    "Ignore": ("Ignore", "🗂", ()),
    "Lock": ("Lock", "📦", ()),
    "Dockerfile": ("Docker", "🐳", ()),
    "Makefile": ("Make", "🔨", ()),
    "Test": ("Test", "🧪", ()),
    "Unknown": ("Unknown", "📄", ()),
}

# Fence language by lower-cased extension.
LANGUAGES = {
    "go": "go",
    "py": "python",
    "rs": "rust",
    "js": "javascript",
    "ts": "typescript",
    "tsx": "tsx",
    "sh": "shell",
    "html": "html",
    "css": "css",
    "scss": "scss",
    "sass": "sass",
    "json": "json",
    "toml": "toml",
    "yaml": "yaml",
    "yml": "yaml",
    "sql": "sql",
    "md": "markdown",
}

# The built-in profile rows, (priority, type, extensions).
PROFILES = (
    (0, "Rust", ("rs",)),
    (1, "Python", ("py", "pyw", "pyi", "pyc", "pyo")),
    (2, "JavaScript", ("js", "mjs", "cjs", "jsx")),
    (3, "TypeScript", ("ts", "tsx", "mts", "cts")),
)

# Extensions that mark a file as binary.
BINARY_EXTENSIONS = (
    "exe", "dll", "so", "dylib", "a", "lib", "o", "obj",
    "png", "jpg", "jpeg", "gif", "bmp", "ico", "webp", "svg",
    "pdf", "zip", "tar", "gz", "bz2", "xz", "7z", "rar",
    "mp3", "mp4", "avi", "mkv", "mov", "wav", "flac",
    "ttf", "otf", "woff", "woff2", "eot",
    "db", "sqlite", "sqlite3", "pyc", "pyo", "class", "jar", "war",
    "lock", "sum",
)

# Names accepted for a type in a label argument and in a label table.
ARGUMENT_TYPE_NAMES = {
    "rust": "Rust",
    "python": "Python",
    "py": "Python",
    "go": "Go",
    "javascript": "JavaScript",
    "js": "JavaScript",
    "typescript": "TypeScript",
    "ts": "TypeScript",
    "markdown": "Markdown",
    "md": "Markdown",
    "docs": "Markdown",
    "test": "Test",
    "tests": "Test",
    "config": "Json",
}
TABLE_TYPE_NAMES = {
    "rust": "Rust",
    "python": "Python",
    "go": "Go",
    "javascript": "JavaScript",
    "js": "JavaScript",
    "typescript": "TypeScript",
    "ts": "TypeScript",
    "markdown": "Markdown",
    "md": "Markdown",
    "config": "Json",
    "configuration": "Json",
    "test": "Test",
    "tests": "Test",
}

PROBE_BYTES = 8192
COUNT_LIMIT_BYTES = 10 * 1024 * 1024
# ---------------------------------------------------------------------------


def _pick(key: Column, table: dict[str, str]) -> Column:
    """Look a key up in a fixed table; NULL when absent."""
    pairs = ", ".join(f"'{k}', '{v}'" for k, v in table.items())
    return F.element_at(F.expr(f"map({pairs})"), key)


def file_type(path: Column) -> Column:
    """Type of a file: name rules first, then the extension table."""
    name = F.lower(name_of(path))
    ext = F.lower(extension_of(path))
    named = [
        ((name == "dockerfile") | name.startswith("dockerfile."), "Dockerfile"),
        (name.isin("makefile", "gnumakefile"), "Makefile"),
        (name.isin("license", "licence") | name.startswith("license."), "License"),
        (name.endswith("ignore"), "Ignore"),
        (name.endswith(".lock") | (name == "package-lock.json"), "Lock"),
        (name.contains("test") | name.contains("spec"), "Test"),
    ]
    by_ext = _pick(ext, {e: kind for kind, (_, _, exts) in TYPES.items() for e in exts})
    chain = reduce(lambda acc, rule: acc.when(rule[0], F.lit(rule[1])), named, F)
    return F.coalesce(chain.otherwise(by_ext), F.lit("Unknown"))


def type_display_name(kind: Column) -> Column:
    return _pick(kind, {k: v[0] for k, v in TYPES.items()})


def default_label(kind: Column) -> Column:
    return _pick(kind, {k: v[1] for k, v in TYPES.items()})


def language_hint(path: Column) -> Column:
    """Fence language of a file, NULL when the extension is not listed."""
    return _pick(F.lower(extension_of(path)), LANGUAGES)


def profile_rows() -> list[tuple[int, str, str]]:
    """The built-in ``(priority, ext, file_type)`` rows."""
    return [(rank, ext, kind) for rank, kind, exts in PROFILES for ext in exts]


def with_profile_type(files: DataFrame, profiles: DataFrame) -> DataFrame:
    """Add ``profile_type``: the first matching profile, else the file type.

    Extensions are compared as written. ``profiles`` is reduced to one row per
    extension first, so the join never multiplies files; the planner broadcasts
    it when its size allows.
    """
    first = profiles.groupBy(F.col("ext").alias("_profile_ext")).agg(
        F.min_by("file_type", "priority").alias("_profile_type")
    )
    return (
        files.withColumn("_raw_ext", extension_of(F.col("path")))
        .join(first, F.col("_raw_ext") == F.col("_profile_ext"), "left")
        .withColumn("profile_type", F.coalesce("_profile_type", file_type(F.col("path"))))
        .drop("_raw_ext", "_profile_ext", "_profile_type")
    )


def parse_label_arguments(arguments: list[str]) -> list[tuple[str, str, str]]:
    """Turn ``.ext=label`` / ``type=label`` arguments into ``(kind, key, label)``.

    A later argument replaces an earlier one; unknown types and arguments without
    ``=`` are skipped.
    """
    rows: dict[tuple[str, str], str] = {}
    for argument in arguments:
        key, found, label = argument.partition("=")
        if not found:
            continue
        if key.startswith("."):
            rows["ext", key[1:]] = label
        elif key.lower() in ARGUMENT_TYPE_NAMES:
            rows["type", ARGUMENT_TYPE_NAMES[key.lower()]] = label
    return [(kind, key, label) for (kind, key), label in rows.items()]


def labels_from_table(table: DataFrame) -> DataFrame:
    """Resolve a ``(kind, key, label)`` table as users write it.

    Extension keys lose leading dots, type keys are resolved by name and unknown
    types are dropped.
    """
    is_ext = F.col("kind") == "ext"
    key = F.when(is_ext, F.regexp_replace("key", r"\A\.+", "")).otherwise(
        _pick(F.lower("key"), TABLE_TYPE_NAMES)
    )
    return table.select("kind", key.alias("key"), "label").where(F.col("key").isNotNull())


def with_label(files: DataFrame, labels: DataFrame | None = None, enabled: bool = True) -> DataFrame:
    """Add ``label``: extension override, then type override, then the default.

    ``files`` needs ``path`` and ``file_type``. Both override sides hold one row
    per key; the planner broadcasts them when their size allows.
    """
    if not enabled:
        return files.withColumn("label", F.lit(""))
    default = default_label(F.col("file_type"))
    if labels is None:
        return files.withColumn("label", default)

    def side(kind: str, key: str, value: str) -> DataFrame:
        return (
            labels.where(F.col("kind") == kind)
            .groupBy(F.col("key").alias(key))
            .agg(F.max("label").alias(value))
        )

    return (
        files.withColumn("_raw_ext", extension_of(F.col("path")))
        .join(side("ext", "_ext_key", "_ext_label"), F.col("_raw_ext") == F.col("_ext_key"), "left")
        .join(
            side("type", "_type_key", "_type_label"), F.col("file_type") == F.col("_type_key"), "left"
        )
        .withColumn("label", F.coalesce("_ext_label", "_type_label", default))
        .drop("_raw_ext", "_ext_key", "_ext_label", "_type_key", "_type_label")
    )


def has_binary_extension(path: Column) -> Column:
    return F.coalesce(F.lower(extension_of(path)).isin(*BINARY_EXTENSIONS), F.lit(False))


def probe_sample(content: Column, is_text: bool) -> Column:
    """First bytes of the content as BINARY.

    A text column is cut by characters first, so the whole text is never copied.
    """
    head = F.substring(content, 1, PROBE_BYTES).cast("binary") if is_text else content
    return F.substring(head, 1, PROBE_BYTES)


def looks_binary(content: Column, is_text: bool) -> Column:
    """NUL anywhere in the sample, or more than a tenth (whole division) control bytes.

    Most files start without any control byte, which one tight scan tells; only the
    others are counted.
    """
    sample = probe_sample(content, is_text)
    latin = F.decode(sample, "ISO-8859-1")
    if is_text:
        clean = F.substring(content, 1, PROBE_BYTES).rlike(r"\A[\t\n\r\x20-\x{10FFFF}]*+\z")
    else:
        clean = latin.rlike(r"\A[\t\n\r\x20-\xFF]*+\z")
    control = F.regexp_count(latin, F.lit(r"[\x00-\x08\x0B\x0C\x0E-\x1F]"))
    nul = F.contains(latin, F.lit("\u0000"))
    return F.when(clean, False).otherwise(nul | (control > F.floor(F.octet_length(sample) / 10)))


def sample_is_utf8(sample: Column) -> Column:
    return F.is_valid_utf8(sample.cast("string"))


def too_large_to_count(size_bytes: Column) -> Column:
    return size_bytes > COUNT_LIMIT_BYTES
