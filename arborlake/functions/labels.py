"""Text labels of numbers: sizes, counts, bars, classes and report lines.

Decimals are rounded from the exact binary value, ties to the even digit.
Spark's ``round`` and ``format_string`` round the printed digits half up, so the
labels are built from whole numbers instead.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Class bounds, glyphs and scale ends.
LOC_CLASSES = ((10, "XS"), (120, "S"), (300, "M"), (600, "L"), (1000, "XL"))
SIZE_CLASSES = ((1024, "XS"), (8192, "S"), (65536, "M"), (524288, "L"), (4194304, "XL"))
TOP_CLASS = "XXL"
SIZE_UNITS = ("B", "KB", "MB", "GB")
TICKS = "▁▂▃▄▅▆▇"
TICK_LOW_BYTES = 1024
TICK_HIGH_BYTES = 100_000_000
SHARE_BAR_CELLS = 15
SHARE_GLYPHS = {"unicode": ("▰", "▱"), "ascii": ("#", "-")}
LOC_BAR_CELLS = 10
LOC_BAR_GLYPHS = ("█", "·")
STAR = " ★"
# ---------------------------------------------------------------------------

_FRACTION_BITS = 1 << 52


def one_decimal(value: Column) -> Column:
    """A DOUBLE of at least 1 with one decimal, ties to even on the exact value.

    From 1 on, a fraction is a whole number of 2^-52 steps, so scaling it is
    exact and the rest of the work is whole-number arithmetic.
    """
    whole = F.floor(value)
    scaled = ((value - whole) * F.lit(float(_FRACTION_BITS))).cast("bigint") * 10
    digit = F.shiftright(scaled, 52)
    rest2 = (scaled - digit * _FRACTION_BITS) * 2
    up = (rest2 > _FRACTION_BITS) | ((rest2 == _FRACTION_BITS) & (digit % 2 == 1))
    tenths = whole * 10 + digit + F.when(up, 1).otherwise(0)
    return F.concat(
        F.call_function("div", tenths, F.lit(10)).cast("string"), F.lit("."), (tenths % 10).cast("string")
    )


def human_size(size_bytes: Column) -> Column:
    """``512 B``, ``1.5 KB`` … in steps of 1024, with GB as the last unit."""
    out = F.concat(size_bytes.cast("string"), F.lit(" B"))
    chain = F.when(size_bytes < 1024, out)
    for step, unit in enumerate(SIZE_UNITS[1:], start=1):
        label = F.concat(
            one_decimal(size_bytes.cast("double") / float(1024**step)), F.lit(f" {unit}")
        )
        last = step == len(SIZE_UNITS) - 1
        chain = chain.otherwise(label) if last else chain.when(size_bytes < 1024 ** (step + 1), label)
    return chain


def _class_of(value: Column, bounds: tuple[tuple[int, str], ...]) -> Column:
    chain = F
    for bound, label in bounds:
        chain = chain.when(value <= bound, F.lit(label))
    return chain.otherwise(F.lit(TOP_CLASS))


def size_class(size_bytes: Column) -> Column:
    return _class_of(size_bytes, SIZE_CLASSES)


def size_tick(size_bytes: Column) -> Column:
    """Glyph for the place of a size on a log scale; NULL up to 1 KiB."""
    low, high = F.log(F.lit(float(TICK_LOW_BYTES))), F.log(F.lit(float(TICK_HIGH_BYTES)))
    place = (F.log(size_bytes.cast("double")) - low) / (high - low)
    bounded = F.least(F.greatest(place, F.lit(0.0)), F.lit(1.0))
    index = F.round(bounded * (len(TICKS) - 1)).cast("int")
    glyphs = F.array(*[F.lit(t) for t in TICKS])
    return F.when(size_bytes > TICK_LOW_BYTES, F.element_at(glyphs, index + 1))


def loc_class(loc: Column) -> Column:
    return F.when(loc.isNotNull(), _class_of(loc, LOC_CLASSES))


def loc_label(loc: Column) -> Column:
    return F.when(loc >= 1000, F.lit("1k+")).otherwise(loc.cast("string"))


def loc_bar(loc: Column, max_in_dir: Column, cells: int = LOC_BAR_CELLS) -> Column:
    """Bar scaled to the largest count among the direct files of the directory."""
    full, empty = LOC_BAR_GLYPHS
    top = F.least(F.greatest(max_in_dir, F.lit(1)), F.lit(1000)).cast("double")
    share = F.least(loc, F.lit(1000)).cast("double") / top
    filled = F.least(
        F.greatest(F.ceil(share * F.lit(float(cells))), F.lit(1)), F.lit(cells)
    ).cast("int")
    filled = F.when(loc < 10, 0).otherwise(filled)
    bar = F.concat(
        F.lit("["), F.repeat(F.lit(full), filled), F.repeat(F.lit(empty), F.lit(cells) - filled), F.lit("]")
    )
    return F.when(loc.isNotNull(), bar)


def count_label(count: Column) -> Column:
    """``999``, ``1.2K``, ``3.4M``."""
    value = count.cast("double")
    return (
        F.when(count >= 1_000_000, F.concat(one_decimal(value / 1e6), F.lit("M")))
        .when(count >= 1_000, F.concat(one_decimal(value / 1e3), F.lit("K")))
        .otherwise(count.cast("string"))
    )


def share_percent(count: Column, total: Column) -> Column:
    """Single-precision percentage, as a FLOAT."""
    ratio = (count.cast("float") / total.cast("float")).cast("float")
    return ratio * F.lit(100).cast("float")


def whole_percent(percent: Column) -> Column:
    return F.bround(percent, 0).cast("int")


def share_bar(percent: Column, charset: str = "ascii", cells: int = SHARE_BAR_CELLS) -> Column:
    full, empty = SHARE_GLYPHS[charset]
    scaled = (percent * F.lit(cells).cast("float")).cast("float") / F.lit(100).cast("float")
    filled = F.least(F.round(scaled.cast("float")).cast("int"), F.lit(cells))
    return F.concat(F.repeat(F.lit(full), filled), F.repeat(F.lit(empty), F.lit(cells) - filled))


def totals_text(heading: str, dirs: Column, files: Column, loc: Column) -> Column:
    """The one-line totals report; the line part is left out when nothing counted."""
    lines = F.coalesce(F.concat(F.lit(" • 🧾 ~"), count_label(loc), F.lit(" LOC")), F.lit(""))
    return F.concat(
        F.lit(f"**{heading}**: 📂 "),
        dirs.cast("string"),
        F.lit(" dirs • 📄 "),
        files.cast("string"),
        F.lit(" files"),
        lines,
    )


def type_line(
    label: Column, name: Column, count: Column, percent: Column, charset: str = "ascii"
) -> Column:
    """One by-type report line."""
    shown = F.when(label == "", F.lit("")).otherwise(F.concat(label, F.lit(" ")))
    return F.concat(
        F.lit("- "), shown, name, F.lit(": "), count.cast("string"), F.lit(" ("),
        whole_percent(percent).cast("string"), F.lit("%) "), share_bar(percent, charset),
    )
