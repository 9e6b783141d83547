"""Path columns.

Every function takes a path column with ``/`` separators and returns a column
expression, so it fuses into the scan stage and works on batch and streaming
frames alike.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def name_of(path: Column) -> Column:
    """Last path segment."""
    return F.call_function("substring_index", path, F.lit("/"), F.lit(-1))


def parent_of(path: Column) -> Column:
    """Everything before the last segment; ``''`` for an entry at the root."""
    return F.left(path, F.length(path) - F.length(name_of(path)) - F.lit(1))


def extension_of(path: Column) -> Column:
    """Text after the last dot of the name.

    NULL when there is no dot or the only dot leads the name (``.gitignore``);
    ``''`` when the name ends with a dot.
    """
    name = name_of(path)
    tail = F.call_function("substring_index", name, F.lit("."), F.lit(-1))
    return F.when(F.length(name) - F.length(tail) > 1, tail)


def depth_of(path: Column) -> Column:
    """Number of segments."""
    return F.length(path) - F.length(F.replace(path, F.lit("/"), F.lit(""))) + F.lit(1)


def _prefixes(path: Column, last: Column) -> Column:
    cut = F.transform(
        F.sequence(F.lit(1), last),
        lambda i: F.call_function("substring_index", path, F.lit("/"), i),
    )
    return F.when(last >= 1, cut).otherwise(F.array().cast("array<string>"))


def ancestors_of(path: Column) -> Column:
    """Proper ancestors from the top down; the root itself is not listed."""
    return _prefixes(path, depth_of(path) - 1)


def ancestors_or_self(path: Column) -> Column:
    """Proper ancestors followed by the path itself."""
    return _prefixes(path, depth_of(path))


def match_form(path: Column) -> Column:
    """The form that patterns are tested against: backslashes become slashes."""
    return F.translate(path, "\\", "/")


def relative_to(path: Column, root: Column | str) -> Column:
    """Path below ``root``; ``''`` for the root itself and NULL outside it."""
    base = F.lit(root.rstrip("/")) if isinstance(root, str) else root
    below = F.startswith(path, F.concat(base, F.lit("/")))
    return F.when(path == base, F.lit("")).when(
        below, F.substring(path, F.length(base) + 2, F.length(path))
    )


def inside_root(path: Column, root: str) -> Column:
    """Lexical containment on a component boundary."""
    base = root.rstrip("/")
    return (path == F.lit(base or "/")) | F.startswith(path, F.lit(base + "/"))


def display_path(path: Column, display_root: str) -> Column:
    """Path as seen from ``display_root``, climbing with ``..`` where needed.

    A relative path cannot be expressed from an absolute root and is returned
    unchanged, and so is an absolute path seen from a relative root.
    """
    absolute = display_root.startswith("/")
    base = [s for s in display_root.split("/") if s not in ("", ".")]
    segments = F.filter(F.split(path, "/"), lambda s: (s != "") & (s != "."))
    shared = F.lit(0)
    if base:
        shared = F.size(
            F.filter(
                F.sequence(F.lit(1), F.lit(len(base))),
                lambda i: F.slice(segments, F.lit(1), i)
                == F.slice(F.array(*[F.lit(s) for s in base]), F.lit(1), i),
            )
        )
    climb = F.array_repeat(F.lit(".."), F.lit(len(base)) - shared)
    rest = F.slice(segments, shared + 1, F.greatest(F.size(segments) - shared, F.lit(0)))
    same_kind = F.startswith(path, F.lit("/")) if absolute else ~F.startswith(path, F.lit("/"))
    return F.when(same_kind, F.array_join(F.concat(climb, rest), "/")).otherwise(path)


def clean_path(path: Column) -> Column:
    """Lexical clean-up.

    Runs of either separator collapse to one ``/``, one leading ``./`` and a
    trailing ``/`` go, an empty result becomes ``.``. An inner ``./`` stays.
    """
    squeezed = F.regexp_replace(path, r"[/\\]+", "/")
    rooted = F.when(
        F.startswith(path, F.lit("\\")), F.substring(squeezed, F.lit(2), F.length(squeezed))
    ).otherwise(squeezed)
    return F.regexp_replace(
        F.regexp_replace(F.regexp_replace(rooted, r"\A\./", ""), r"(?<=.)/\z", ""), r"\A\z", "."
    )


def has_directory_hint(path: Column) -> Column:
    """True when the written path ends with a separator."""
    return path.rlike(r"[/\\]\z")


def sort_key(path: Column, is_dir: Column) -> Column:
    """One string whose byte order is the depth-first listing order.

    Each segment gets a class digit (directories before files) and segments are
    joined by NUL, which no file name can hold and which sorts below all else, so
    a directory comes right before its content.
    """
    depth = depth_of(path)
    return F.array_join(
        F.transform(
            F.split(path, "/"),
            lambda s, i: F.concat(
                F.when((i + 1 < depth) | is_dir, F.lit("0")).otherwise(F.lit("1")), s
            ),
        ),
        "\u0000",
    )
