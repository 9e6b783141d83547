"""Quality rules and robust multivariate outliers.

A scan of the texts gives the statistics of each document. Their transformed vectors are
compared within each language and source by the squared Mahalanobis distance to a
minimum-covariance-determinant estimate: the mean and covariance of the half of the vectors
that lie closest together, so less than half of a group may be junk. The search starts from
medians and median deviations and takes concentration steps: take the vectors within the
group's median of distance, compute their moments, measure again. The last step takes the
moments of all vectors within the quantile ``SURE_QUANTILE``, which uses the rows that the
half leaves out. Distances, quantiles and moments of all groups come from one pass over the
vectors per step; they are sums and sketches that combine before the shuffle, so a group may
hold any part of all rows. Only the moments of a group, a few dozen numbers, meet in one row.
Copies with equal counts count once in the estimate, so no text that is copied often becomes
the ordinary one of its source.

The covariance is scaled to consistency at the normal distribution. A statistic that is the
same for most documents, such as a count of zero symbols, has no spread in the half; its
variance is raised to what one symbol, line or word makes in the median document of the
group, times ``UNIT_SPREAD``. The covariance is kept otherwise.

Every group is judged by its own estimate, pooled with that of its language, which counts for
``PRIOR_ROWS`` rows of the covariance and ``PRIOR_MEANS`` of the mean, and that likewise with
the estimate of all rows. A small group moves from the one to the other row by row; no size
changes the rule.

Defined results: a NULL or empty text has zero counts and fails the base rules; NULL
languages and sources are groups of their own; repeated rows are judged each.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arborlake.llm import words as W
from arborlake.llm.store import drop, keep

LEAST_WORDS = 50
REPEAT_PERCENT = 50
SYMBOLS = "#*$%&|<>"
#: Share of a group's vectors that the concentration steps rest on: less than the rest may be junk.
KEPT_SHARE = 0.5
#: Concentration steps after the start; the objective falls in the first few.
STEPS = 4
#: The last estimate takes the vectors within this quantile of the chi-squared distribution.
SURE_QUANTILE = 0.975
#: Least standard deviation of a count that is zero in most documents, in units of the count:
#: a Poisson count that is zero half of the time has the mean and variance ln 2.
UNIT_SPREAD = math.sqrt(math.log(2))
#: Vectors beyond this quantile of the chi-squared distribution are rejected. Means over few
#: words have heavier tails than the normal distribution: about one in 100 ordinary documents
#: lies beyond it, instead of one in 10,000.
REJECT_QUANTILE = 0.9999
#: Rows that the wider group's covariance counts for in the estimate of a group, twice the dimensions.
PRIOR_ROWS = 10
#: Rows that the wider group's mean counts for; a mean needs fewer rows than a covariance.
PRIOR_MEANS = 1
#: Standard deviations that stand for the wider group of all rows; they matter in tables of a few rows.
PRIOR_SPREAD = (1.0, 0.5, 1.0, 0.2, 1.0)

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Counts with the lines that are not blank, which duplicate lines are a share of.
STATISTICS = (*COUNTS, "n_lines")
RESULT = ", ".join(f"{c} bigint" for c in STATISTICS)
_SPACES = " \t\n\x0b\x0c\r"


def text_counts(text: bytes | None, codes: W.WordCodes) -> tuple[int, ...]:
    """The counts of ``STATISTICS`` for one text."""
    if not text:
        return (0,) * len(STATISTICS)
    words = text.split()
    decoded = text.decode()
    chars = len(decoded) - sum(map(decoded.count, _SPACES))
    symbols = sum(map(decoded.count, SYMBOLS))
    lines = [x for x in text.split(b"\n") if x and not x.isspace()]
    repeats = 0
    if len(words) >= 3:
        grams = W.windows(codes.of(words), 3)
        _, inverse, times = np.unique(grams, return_inverse=True, return_counts=True)
        starts = np.flatnonzero(times[inverse] > 1)
        if len(starts):
            repeats = int(W.covered(starts, 3, len(words)).sum())
    return len(words), chars, symbols, len(lines) - len(set(lines)), repeats, len(lines)


def counts_column(text: Column) -> Column:
    @F.arrow_udf(RESULT)
    def counted(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        codes = W.WordCodes()
        for batch in batches:
            rows = [text_counts(t, codes) for t in W.as_bytes(batch)]
            columns = zip(*rows, strict=True) if rows else [[]] * len(STATISTICS)
            yield pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in columns], names=list(STATISTICS))

    return counted(text)


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))


def vector() -> Column:
    """Transformed statistics: near normal for ordinary prose, far out for junk."""
    words = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    return F.array(
        F.log1p(F.col("n_words").cast("double")),
        4 * F.log1p(F.col("word_chars") / words),
        2 * F.log1p(100 * F.col("n_symbols") / words),
        F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)),
        5 * F.sqrt(F.col("n_repeat_words") / words),
    )


def units() -> Column:
    """What one word, character, symbol, line (of ten at least) and repeated run makes in each statistic."""
    words = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    return F.array(
        1 / words,
        4 / (words + F.col("word_chars")),
        2 * F.log1p(100 / words),
        1 / F.greatest(F.col("n_lines"), F.lit(10)),
        5 * F.sqrt(3 / words),
    )


DIMENSIONS = 5
#: Columns of a group: its language and source, where empty stands for all.
GROUP = ["lang", "source"]


def chi_squared_below(x: float, k: int) -> float:
    """Probability of a value below ``x``, by the series of the incomplete gamma function."""
    total = term = 1.0 / (k / 2)
    for n in range(1, 1000):
        term *= (x / 2) / (k / 2 + n)
        total += term
        if term < total * 1e-16:
            break
    return total * math.exp(-x / 2 + (k / 2) * math.log(x / 2) - math.lgamma(k / 2))


def chi_squared_quantile(p: float, k: int) -> float:
    low, high = 1e-9, 1000.0
    for _ in range(100):
        middle = (low + high) / 2
        low, high = (middle, high) if chi_squared_below(middle, k) < p else (low, middle)
    return (low + high) / 2


def _spread(first: list[float], second: list[float], n: int, unit: list[float], consistency: float) -> tuple[np.ndarray, np.ndarray]:
    """Mean and scaled covariance from sums; no variance is below that of the units."""
    mean = np.array(first) / n
    spread = (np.array(second).reshape(DIMENSIONS, DIMENSIONS) / n - np.outer(mean, mean)) * consistency
    least = (UNIT_SPREAD * np.array(unit)) ** 2
    return mean, spread + np.diag(np.maximum(0.0, least - np.diag(spread)))


def pooled(path: list[dict], consistency: float) -> tuple[np.ndarray, np.ndarray]:
    """Mean and covariance of the last group of ``path``, which leads to it from all rows."""
    mean, spread = None, np.diag(np.square(PRIOR_SPREAD))
    for group in path:
        n = group["n"]
        own, own_spread = _spread(group["first"], group["second"], n, group["unit"], consistency)
        mean = own if mean is None else mean
        gap, share, near = own - mean, n / (n + PRIOR_ROWS), n / (n + PRIOR_MEANS)
        # what the means differ by is spread as well, or a group of one row would be far from its own mean
        spread = share * own_spread + (1 - share) * spread + near * (1 - near) * np.outer(gap, gap)
        mean = mean + near * gap
    return mean, spread


def _estimates(moments: DataFrame, consistency: float) -> DataFrame:
    """Mean and inverse covariance of each group, from its sums and those of the wider groups."""

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [pooled([g for g in path if g is not None], consistency) for path in batch.column("path").to_pylist()]
            columns = [batch.column(c) for c in (*GROUP, "unit")]
            columns.append(pa.array([m.tolist() for m, _ in found], pa.list_(pa.float64())))
            columns.append(pa.array([np.linalg.inv(v).ravel().tolist() for _, v in found], pa.list_(pa.float64())))
            yield pa.RecordBatch.from_arrays(columns, names=[*GROUP, "unit", "mean", "inverse"])

    moments = keep(moments, "moments")
    sums = F.struct("n", "first", "second", "unit")
    every = moments.where(F.col("lang") == "").select(sums.alias("every"))
    languages = moments.where((F.col("lang") != "") & (F.col("source") == "")).select("lang", sums.alias("language"))
    path = F.array(
        F.col("every"), F.when(F.col("source") != "", F.col("language")), F.when(F.col("lang") != "", sums)
    )
    paths = moments.join(languages, "lang", "left").crossJoin(F.broadcast(every)).select(*GROUP, "unit", path.alias("path"))
    schema = "lang string, source string, unit array<double>, mean array<double>, inverse array<double>"
    estimate = keep(paths.mapInArrow(solve, schema), "step")
    drop(moments)
    return estimate


def distance(x: Column, mean: Column, inverse: Column) -> Column:
    """Squared Mahalanobis distance, written out for codegen."""
    gap = [x[i] - mean[i] for i in range(DIMENSIONS)]
    total = F.lit(0.0)
    for i in range(DIMENSIONS):
        row = F.lit(0.0)
        for j in range(DIMENSIONS):
            row = row + inverse[i * DIMENSIONS + j] * gap[j]
        total = total + gap[i] * row
    return total


def _moments(vectors: DataFrame) -> DataFrame:
    x = F.col("x")
    firsts = [F.sum(x[i]).alias(f"f{i}") for i in range(DIMENSIONS)]
    pairs = [(i, j) for i in range(DIMENSIONS) for j in range(i, DIMENSIONS)]
    seconds = [F.sum(x[i] * x[j]).alias(f"s{i}_{j}") for i, j in pairs]
    sums = vectors.groupBy(*GROUP).agg(F.count(F.lit(1)).alias("n"), *firsts, *seconds)
    full = [F.col(f"s{min(i, j)}_{max(i, j)}") for i in range(DIMENSIONS) for j in range(DIMENSIONS)]
    return sums.select(*GROUP, "n", F.array(*(f"f{i}" for i in range(DIMENSIONS))).alias("first"), F.array(*full).alias("second"))


def _medians(columns: list[Column], name: str) -> list[Column]:
    return [F.percentile_approx(c, 0.5, 1000).alias(f"{name}{i}") for i, c in enumerate(columns)]


def _start(vectors: DataFrame) -> DataFrame:
    """Medians and median deviations of every group as the moments of its rows."""
    each = range(DIMENSIONS)
    packed = lambda name: F.array(*(F.col(f"{name}{i}") for i in each))
    middle = vectors.groupBy(*GROUP).agg(*_medians([F.col("x")[i] for i in each], "m"), *_medians([F.col("u")[i] for i in each], "u"))
    middle = keep(middle.select(*GROUP, packed("m").alias("middle"), packed("u").alias("unit")), "middle")
    gaps = vectors.join(middle.drop("unit"), GROUP)
    deviations = gaps.groupBy(*GROUP).agg(
        F.count(F.lit(1)).alias("n"), *_medians([F.abs(F.col("x")[i] - F.col("middle")[i]) for i in each], "d")
    )
    start = deviations.join(middle, GROUP)
    m = lambda i: F.col("middle")[i]
    square = lambda i, j: m(i) * m(j) + (F.pow(1.4826 * F.col(f"d{i}"), F.lit(2.0)) if i == j else F.lit(0.0))
    return start.select(
        *GROUP,
        "n",
        F.array(*(F.col("n") * m(i) for i in each)).alias("first"),
        F.array(*(F.col("n") * square(i, j) for i in each for j in each)).alias("second"),
        "unit",
    )


def _concentrate(vectors: DataFrame) -> DataFrame:
    """The estimate of every group."""
    consistency = lambda share: share / chi_squared_below(chi_squared_quantile(share, DIMENSIONS), DIMENSIONS + 2)
    estimate = _estimates(_start(vectors), 1.0)
    for step in range(STEPS + 1):
        measured = vectors.join(estimate, GROUP).withColumn("d", distance(F.col("x"), F.col("mean"), F.col("inverse")))
        limits = measured.groupBy(*GROUP).agg(F.percentile_approx("d", KEPT_SHARE, 1000).alias("limit"))
        share = KEPT_SHARE
        if step == STEPS:
            share = SURE_QUANTILE
            limits = limits.withColumn("limit", F.greatest("limit", F.lit(chi_squared_quantile(share, DIMENSIONS))))
        closest = measured.join(limits, GROUP).where(F.col("d") <= F.col("limit"))
        sums = _moments(closest).join(estimate.select(*GROUP, "unit"), GROUP)
        before, estimate = estimate, _estimates(sums, consistency(share))
        drop(before)
    return estimate


def judged(documents: DataFrame) -> DataFrame:
    """``doc_id``, the counts, ``distance``, ``base_failed`` and ``kept`` of every row."""
    statistics = keep(
        documents.select(
            "doc_id",
            F.coalesce(F.concat(F.lit("+"), F.col("lang").cast("string")), F.lit("-")).alias("lang"),
            F.coalesce(F.concat(F.lit("+"), F.col("source").cast("string")), F.lit("-")).alias("source"),
            counts_column(F.col("text").cast("string")).alias("c"),
        ).select("doc_id", "lang", "source", "c.*"),
        "statistics",
    )
    # a row belongs to its language and source, to its language, and to all rows
    groups = [
        F.struct("lang", "source"),
        F.struct("lang", F.lit("").alias("source")),
        F.struct(F.lit("").alias("lang"), F.lit("").alias("source")),
    ]
    member = statistics.where(~base_failed()).select(F.explode(F.array(*groups)).alias("group"), *STATISTICS)
    sample = keep(member.select("group.*", *STATISTICS).distinct(), "sample")
    estimate = _concentrate(sample.select(*GROUP, vector().alias("x"), units().alias("u")))
    result = statistics.select("*", vector().alias("x"))
    # a group without rows in the estimate has that of the wider group
    for n, names in enumerate((GROUP, GROUP[:1], [])):
        of = estimate.where(F.lit(True) if n == 0 else (F.col("source") == "") & (F.col("lang") != "") if n == 1 else F.col("lang") == "")
        of = of.select(*names, *(F.col(c).alias(f"{c}{n}") for c in ("mean", "inverse")))
        result = result.join(of, names, "left") if names else result.join(F.broadcast(of), F.lit(True), "left")
    chosen = [F.coalesce(*(F.col(f"{c}{n}") for n in range(3))) for c in ("mean", "inverse")]
    limit = chi_squared_quantile(REJECT_QUANTILE, DIMENSIONS)
    result = result.withColumns({"m": chosen[0], "v": chosen[1]})
    result = result.withColumn("distance", distance(F.col("x"), F.col("m"), F.col("v")))
    return result.select(
        "doc_id",
        *COUNTS,
        base_failed().alias("base_failed"),
        F.round("distance", 6).alias("distance"),
        (~base_failed() & (F.coalesce(F.col("distance"), F.lit(0.0)) <= limit)).alias("kept"),
    )
