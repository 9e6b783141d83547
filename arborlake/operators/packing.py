"""Cutting a corpus to a byte budget.

The budget is spent on content bytes; headings and fences are free. One number
per corpus, the head length or the indentation depth, is found by an aggregation
over the lines, and then a narrow pass over the content applies it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from arborlake.functions.classify import has_binary_extension, language_hint
from arborlake.functions.lines import indent_of, line_count, lines_of, readable_text, unix_text
from arborlake.functions.paths import sort_key
from arborlake.operators.inventory import is_text_column
from arborlake.operators.scratch import lookup, lookup_by_row, materialize

# The text of a folded run is "... (k lines)": 12 bytes and the digits.
MARKER_BYTES = 12
# A hidden line takes at least three bytes, so no text holds a run of 10^9 lines.
MAX_RUN_DIGITS = 9
FENCE = "```"


def readable_files(files: DataFrame) -> DataFrame:
    """Files that get a section, with their ``text``: no binary extension, valid UTF-8."""
    text = readable_text(F.col("content"), is_text_column(files))
    return (
        files.where(~has_binary_extension(F.col("path")))
        .withColumn("text", text)
        .where(F.col("text").isNotNull())
    )


# -- one file ----------------------------------------------------------------


def head_cut(text: Column, n: Column) -> Column:
    """First ``n`` lines joined by LF; the untouched text when it has no more."""
    cut = F.call_function("substring_index", unix_text(text), F.lit("\n"), n)
    return F.when(n >= line_count(text), text).when(n <= 0, F.lit("")).otherwise(cut)


def head_omitted(text: Column, n: Column) -> Column:
    return F.greatest(line_count(text) - n, F.lit(0))


def with_lines(files: DataFrame) -> DataFrame:
    """Add ``lines``, and ``indents`` with the bytes of leading white space of each.

    Arrays that lambdas use are columns of their own, referenced more than once, so
    the optimizer does not inline them into a lambda body.
    """
    return files.withColumn("lines", lines_of(F.col("text"))).withColumn(
        "indents", F.transform("lines", lambda line: indent_of(line).cast("int"))
    )


def with_folded(files: DataFrame, depth: str) -> DataFrame:
    """Add ``fold``: the text with deep runs folded, and the lines left out.

    A run of lines indented by more than the ``depth`` column becomes one marker
    line. Zero-length lines at the very top vanish, because a separator only follows
    text. ``fold`` is NULL where ``text`` or ``depth`` is.
    """
    marked = files.withColumn("hidden", F.expr(f"transform(indents, d -> d > {depth})"))
    edges = marked.withColumns(
        {
            "first": F.expr(
                "filter(transform(hidden, (h, i) -> if(h and (i = 0 or not hidden[i - 1]), i, null)),"
                " i -> i is not null)"
            ),
            "last": F.expr(
                "filter(transform(hidden, (h, i) -> if(h and (i = size(hidden) - 1 or not hidden[i + 1]),"
                " i, null)), i -> i is not null)"
            ),
            "shown": F.expr(
                "filter(transform(lines, (line, i) -> struct(i as at, if(hidden[i], null, line) as line)),"
                " row -> row.line is not null)"
            ),
        }
    )
    markers = (
        "transform(arrays_zip(first, last), run -> struct(run.first as at,"
        " concat('... (', run.last - run.first + 1, ' lines)') as line))"
    )
    return (
        edges.withColumn("rows", F.expr(f"array_sort(concat(shown, {markers}))"))
        .withColumn(
            "fold",
            F.expr(
                "struct(trim(leading char(10) from array_join(rows.line, char(10))) as text,"
                " size(filter(hidden, h -> h)) as omitted)"
            ),
        )
        .drop("hidden", "first", "last", "shown", "rows")
    )


# -- budget search -----------------------------------------------------------

_NO_STEPS = "cast(array() as array<struct<pos:int,delta:bigint>>)"


def _step(pos: str, delta: str) -> str:
    return f"struct(cast({pos} as int) as pos, cast({delta} as bigint) as delta)"


def _head_steps(max_bytes: int) -> str:
    """Growth of the head cut at each length.

    Line n adds its bytes and the joining LF; the last length also brings back the
    bytes that joining loses. Beyond ``max_bytes + 1`` lines the joining LFs alone
    exceed the budget, so such lengths are never candidates.
    """
    limit = min(max_bytes + 1, 2**31 - 1)
    grow = _step("i + 1", "octet_length(line) + if(i > 0, 1, 0)")
    return (
        f"concat(transform(slice(lines, 1, {limit}), (line, i) -> {grow}),"
        f" if(lost > 0 and size(lines) <= {limit}, array({_step('size(lines)', 'lost')}), {_NO_STEPS}))"
    )


def _run_steps(minima: str, amount: int) -> str:
    """Intervals of depths at which a run of hidden lines starts at each line."""
    above = "if(i = 0, 0, indents[greatest(i - 1, 0)])"
    rise, fall = _step(above, str(amount)), _step("low", str(-amount))
    return (
        f"flatten(transform({minima}, (low, i) -> if(low > {above}, array({rise}, {fall}), {_NO_STEPS})))"
    )


def _with_run_minima(files: DataFrame) -> tuple[DataFrame, list[str]]:
    """Add, per power of ten m, the smallest of the m indents from each line on.

    Each column looks ten entries ahead in the one before. It is NULL for files too
    short to hold such a run.
    """
    before, columns = "indents", []
    for exponent in range(1, MAX_RUN_DIGITS):
        stride = 10 ** (exponent - 1)
        ahead = ", ".join(f"{before}[i + {step * stride}]" for step in range(1, 10))
        name = f"minima_{exponent}"
        files = files.withColumn(
            name,
            F.expr(
                f"case when size({before}) > {9 * stride} and array_max({before}) > 0 then"
                f" transform(slice({before}, 1, size({before}) - {9 * stride}),"
                f" (low, i) -> least(low, {ahead})) end"
            ),
        )
        before = name
        columns.append(name)
    return files, columns


def _nest_steps(minima: list[str]) -> str:
    """Size of the folded text as a step function of the depth.

    A line of indent d shows at every depth >= d. A run of hidden lines that starts
    at line i exists exactly for the depths from the indent of line i-1 up to the
    indent of line i, and has at least m lines for the depths below the minimum of
    the m indents from line i. So the marker bytes, one more per power of ten, are a
    sum of intervals, and the sum over lines, files and corpora is plain addition:
    no candidate depth is ever tried out.

    Every line is counted with a separator; the first printed line has none, and
    zero-length lines at the top are not printed.
    """
    shown = _step("indents[i]", "octet_length(line) + 1")
    parts = [
        f"transform(lines, (line, i) -> {shown})",
        f"array({_step('0', '-(top + if(top < size(lines), 1, 0))')})",
        # The shortest marker and its separator, then a byte per further digit.
        _run_steps("indents", MARKER_BYTES + 2),
        *[f"coalesce({_run_steps(name, 1)}, {_NO_STEPS})" for name in minima],
    ]
    return f"concat({', '.join(parts)})"


def budget_steps(files: DataFrame, max_bytes: int, mode: str) -> DataFrame:
    """One pass over the content: summed size steps ``(corpus_id, kind, pos, delta)``.

    ``kind`` is ``full``, ``head`` or ``nest``. Lines become numbers inside the scan
    stage and the sums combine on the map side; what crosses the exchange is one row
    per task, corpus and position.
    """
    text = F.col("text")
    plain = unix_text(text)
    ended = F.when(F.endswith(text, F.lit("\n")), 1).otherwise(0)
    frame = with_lines(files.select("corpus_id", "text")).withColumns(
        {
            "lost": F.octet_length(text) - F.octet_length(plain) + ended,
            "top": F.octet_length(plain) - F.octet_length(F.ltrim(plain, F.lit("\n"))),
        }
    )
    kinds = {
        "full": f"array({_step('0', 'octet_length(text)')})",
        "head": _head_steps(max_bytes),
    }
    if mode == "nest":
        frame, minima = _with_run_minima(frame)
        kinds["nest"] = _nest_steps(minima)
    tagged = ", ".join(
        f"transform({steps}, s -> struct('{kind}' as kind, s.pos as pos, s.delta as delta))"
        for kind, steps in kinds.items()
    )
    return (
        frame.select("corpus_id", F.expr(f"explode(concat({tagged}))").alias("step"))
        .groupBy("corpus_id", "step.kind", "step.pos")
        .agg(F.sum("step.delta").alias("delta"))
    )


def budget_parameters(steps: DataFrame, max_bytes: int, mode: str) -> DataFrame:
    """Method and parameter of each corpus: ``(corpus_id, method, n)``.

    The running sums go over positions already aggregated per corpus: at most one
    row per line number of its longest file, or per distinct indentation. The
    folded size does not shrink steadily with the depth, so every depth is checked
    and the largest that fits wins.
    """
    order = W.partitionBy("corpus_id", "kind").orderBy("pos")
    fits = F.col("size") <= max_bytes
    depth = F.coalesce(F.lead("pos").over(order) - 1, F.col("pos"))
    running = order.rowsBetween(W.unboundedPreceding, W.currentRow)
    sized = steps.withColumn("size", F.sum("delta").over(running)).withColumn(
        "last", F.when(F.col("kind") == "nest", depth).otherwise(F.col("pos"))
    )
    found = sized.groupBy("corpus_id").agg(
        F.bool_or(F.when(F.col("kind") == "full", fits)).alias("whole"),
        F.max(F.when((F.col("kind") == "nest") & fits, F.col("last"))).alias("depth"),
        F.max(F.when((F.col("kind") == "head") & fits, F.col("last"))).alias("head"),
    )
    nest = F.lit(mode == "nest") & F.col("depth").isNotNull()
    return found.select(
        "corpus_id",
        F.when(F.col("whole"), "full").when(nest, "nest").otherwise("head").alias("method"),
        F.when(F.col("whole"), F.lit(None))
        .when(nest, F.col("depth"))
        .otherwise(F.coalesce("head", F.lit(0)))
        .cast("int")
        .alias("n"),
    )


# -- sections ----------------------------------------------------------------


def section_text(
    display: Column, path: Column, content: Column, omitted: Column, fence: str = FENCE
) -> Column:
    """Heading, fenced content and the note of what was left out."""
    hint = F.coalesce(language_hint(path), F.lit(""))
    closed = F.when(F.endswith(content, F.lit("\n")), content).otherwise(
        F.concat(content, F.lit("\n"))
    )
    note = F.when(
        omitted > 0, F.concat(F.lit("... ("), omitted.cast("string"), F.lit(" lines omitted)\n"))
    ).otherwise(F.lit(""))
    return F.concat(
        F.lit("\n## "), display, F.lit(f"\n\n{fence}"), hint, F.lit("\n"), closed, note, F.lit(f"{fence}\n")
    )


def check_budget(contents: bool, max_bytes: int | None) -> None:
    """A budget without contents is a mistake of the caller."""
    if max_bytes is not None and not contents:
        raise ValueError("max_bytes needs contents")
    if max_bytes is not None and max_bytes < 0:
        raise ValueError("max_bytes must not be negative")


def pack(
    files: DataFrame,
    max_bytes: int | None = None,
    mode: str = "head",
    fence: str = FENCE,
    display: Column | None = None,
) -> DataFrame:
    """One section row per readable file, cut to the budget of its corpus.

    Returns ``(corpus_id, path, sort_key, method, n, omitted, section)``. With a
    budget the content is read twice: for the steps and for the cut. It is never
    shuffled unless the per-corpus parameters outgrow the broadcast bounds.
    """
    if mode not in ("head", "nest"):
        raise ValueError(f"contents mode must be head or nest, not {mode!r}")
    check_budget(True, max_bytes)
    ready = readable_files(files)
    text = F.col("text")
    if max_bytes is None:
        cut = ready.select(
            "*",
            F.lit("full").alias("method"),
            F.lit(None).cast("int").alias("n"),
            text.alias("kept"),
            F.lit(0).alias("omitted"),
        )
    else:
        steps = budget_steps(ready, max_bytes, mode)
        parameters = materialize(budget_parameters(steps, max_bytes, mode), "budget-parameters")
        joined = lookup_by_row(ready, parameters, ["corpus_id"], ["corpus_id", "path"])
        whole = F.struct(text.alias("text"), F.lit(0).alias("omitted"))
        head = F.struct(
            head_cut(text, F.col("n")).alias("text"),
            head_omitted(text, F.col("n")).cast("int").alias("omitted"),
        )
        result = F.when(F.col("method") == "full", whole)
        if mode == "nest":
            nested = F.when(F.col("method") == "nest", F.col("n"))
            joined = with_folded(with_lines(joined).withColumn("depth", nested), "depth")
            result = result.when(F.col("method") == "nest", F.col("fold"))
        cut = joined.withColumn("cut", result.otherwise(head)).select(
            "*", F.col("cut.text").alias("kept"), F.col("cut.omitted").alias("omitted")
        )
    path = F.col("path")
    shown = path if display is None else display
    return cut.select(
        "corpus_id",
        "path",
        sort_key(path, F.lit(False)).alias("sort_key"),
        "method",
        "n",
        "omitted",
        section_text(shown, path, F.col("kept"), F.col("omitted"), fence).alias("section"),
    )
