"""Text and line columns."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from arborlake.functions.classify import (
    has_binary_extension,
    looks_binary,
    too_large_to_count,
)

# The Unicode White_Space characters.
WHITE_SPACE = "".join(
    map(
        chr,
        [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B)]
        + [0x2028, 0x2029, 0x202F, 0x205F, 0x3000],
    )
)
# Line starts that count as comments, and the counting cut-off.
COMMENT_STARTS = ("//", "#", "/*", "*")
COUNT_CUTOFF = 100_001


def readable_text(content: Column, is_text: bool) -> Column:
    """Content as text; NULL when the bytes are not valid UTF-8."""
    return F.try_validate_utf8(content if is_text else content.cast("string"))


def _newlines(text: Column) -> Column:
    return F.octet_length(text) - F.octet_length(F.replace(text, F.lit("\n"), F.lit("")))


def _open_end(text: Column) -> Column:
    """1 when the text has a last line without a line end, else 0."""
    return F.when((F.octet_length(text) > 0) & ~F.endswith(text, F.lit("\n")), 1).otherwise(0)


def line_count(text: Column) -> Column:
    """Number of lines, from byte counts alone (no array is built)."""
    return _newlines(text) + _open_end(text)


def unix_text(text: Column) -> Column:
    """Text with every CRLF turned into LF."""
    return F.replace(text, F.lit("\r\n"), F.lit("\n"))


def lines_of(text: Column) -> Column:
    """Lines as an array; a trailing line end makes no extra line."""
    return F.slice(F.split(unix_text(text), "\n"), F.lit(1), line_count(text))


def trimmed(line: Column) -> Column:
    return F.trim(line, F.lit(WHITE_SPACE))


def indent_of(line: Column) -> Column:
    """Bytes of leading white space; 0 for a blank line, which is never hidden."""
    body = F.ltrim(line, F.lit(WHITE_SPACE))
    return F.when(body == "", 0).otherwise(F.octet_length(line) - F.octet_length(body))


def is_code_line(line: Column) -> Column:
    body = trimmed(line)
    comment = F.lit(False)
    for start in COMMENT_STARTS:
        comment = comment | F.startswith(body, F.lit(start))
    return (body != "") & ~comment


#: The start of a line whose first character after white space begins no comment.
CODE_LINE = (
    rf"(?:\A|\n)[{WHITE_SPACE.replace(chr(10), '')}]*+(?!\n|\z|" + "|".join(re.escape(s) for s in COMMENT_STARTS) + ")"
)


def _code_lines(content: Column, is_text: bool) -> Column:
    """One scan counts the starts of code lines; no line is cut out of a valid text."""
    text = content if is_text else content.cast("string")
    valid = F.regexp_count(text, F.lit(CODE_LINE))
    if is_text:
        return valid
    # Undecodable lines do not count: judge each line on its own bytes.
    latin = F.split(F.decode(content, "ISO-8859-1"), "\n")

    def decodable_code(line: Column) -> Column:
        text_line = F.encode(line, "ISO-8859-1").cast("string")
        return F.is_valid_utf8(text_line) & is_code_line(text_line)

    return F.when(F.is_valid_utf8(text), valid).otherwise(F.size(F.filter(latin, decodable_code)))


def lines_of_code(
    path: Column, content: Column, size_bytes: Column, *, mode: str, is_text: bool
) -> Column:
    """Line count of a file, NULL where the file is not counted.

    ``CASE`` stops at the first gate that fires, so the cheap tests (size,
    extension) shield the probe and the probe shields the full read.
    """
    if mode not in ("off", "fast", "accurate"):
        raise ValueError(f"loc mode must be off, fast or accurate, not {mode!r}")
    if mode == "off":
        return F.lit(None).cast("bigint")
    text = content if is_text else content.cast("string")
    counted = line_count(text) if mode == "fast" else _code_lines(content, is_text)
    return (
        F.when(content.isNull() | too_large_to_count(size_bytes), F.lit(None).cast("bigint"))
        .when(has_binary_extension(path), F.lit(None).cast("bigint"))
        .when(looks_binary(content, is_text), F.lit(None).cast("bigint"))
        .otherwise(F.least(counted, F.lit(COUNT_CUTOFF)).cast("bigint"))
    )
