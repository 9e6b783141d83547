"""Approximate nearest neighbours by multi-index hashing.

**Codes.** Vectors are scaled by the largest norm and get one more component that brings them
to length one, so the largest inner product with a query is the smallest angle to it. A
rotation is learned on a bounded sample: principal axes, then turned so that the signs of the
rotated sample lose least (alternating between signs and the orthogonal matrix that fits them
best). A code is the signs of a rotated vector, 64 bits at most.

**Radius.** A bounded sample of queries is answered by brute force over all rows, and the
Hamming radius is the least one that holds the share ``aim`` of the true neighbours' codes.

**Search.** Queries meet all rows in blocks (:mod:`arborlake.llm.vectors`). A task cuts the
codes of its rows into substrings of about as many bits as the logarithm of the rows, and
indexes each: rows in the order of the substring, with the start of every value. Within a
radius ``R = m * s + a`` of ``m`` substrings, one of the first ``a + 1`` is within ``s`` bits
or one of the others within ``s - 1`` (the pigeonhole principle), so all values in these
radii are probed and no code within ``R`` is missed. What is found is reranked by the inner
products of the original vectors. Queries that find fewer than ``k`` rows are asked again with
the radius that holds every code, so a query gets ``k`` rows wherever there are as many.

Every row is indexed; only the rotation and the radius come from samples (``SAMPLE_ROWS``,
``SAMPLE_QUERIES``). On data without structure the radius is wide and a query meets a large
part of the codes; what it costs then is a scan of short codes.

Defined results: rows without an id, with a NULL or zero vector, with a NULL, NaN or infinite
component, or of another length than most take no part. An id that repeats is one query, with
its least vector; rows with a query's id are never among its neighbours, other repeated rows
are listed as often as they come. Equal scores are ordered by id. An empty table, or one with
a single id, gives an empty result. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arborlake.llm.store import keep
from arborlake.llm.vectors import Best, finite, matrix, met, usual_length

#: Rows that the rotation is learned on, and queries that the radius is learned on.
SAMPLE_ROWS = 8192
SAMPLE_QUERIES = 128
#: Share of the sampled queries' true neighbours that the radius holds.
AIM = 0.95
#: Turns of the rotation's fit.
TURNS = 30
#: Pairs of a query and a found row that a task looks at in one step.
STEP_PAIRS = 1 << 20


@dataclass(frozen=True)
class Coder:
    """The learned codes: ``sign((augmented vector - centre) @ axes)``."""

    norm: float
    centre: np.ndarray
    axes: np.ndarray

    @property
    def bits(self) -> int:
        return self.axes.shape[1]

    def rows(self, vectors: np.ndarray) -> np.ndarray:
        scaled = vectors / self.norm
        rest = np.sqrt(np.maximum(0.0, 1.0 - np.einsum("ij,ij->i", scaled, scaled)))
        return self._codes(np.column_stack([scaled, rest]))

    def queries(self, vectors: np.ndarray) -> np.ndarray:
        # scaled by the largest component first, so that squares of tiny ones do not vanish
        scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
        unit = scaled / np.linalg.norm(scaled, axis=1, keepdims=True)
        return self._codes(np.column_stack([unit, np.zeros(len(unit))]))

    def _codes(self, augmented: np.ndarray) -> np.ndarray:
        signs = (augmented - self.centre) @ self.axes > 0
        return (signs.astype(np.uint64) << np.arange(self.bits, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)


def learned(sample: np.ndarray, norm: float, bits: int = 64) -> Coder:
    """Principal axes of the augmented sample, rotated towards the corners of the cube."""
    scaled = sample / norm
    rest = np.sqrt(np.maximum(0.0, 1.0 - np.einsum("ij,ij->i", scaled, scaled)))
    augmented = np.column_stack([scaled, rest])
    bits = min(bits, sample.shape[1])
    centre = augmented.mean(axis=0)
    _, axes = np.linalg.eigh((augmented - centre).T @ (augmented - centre))
    axes = axes[:, ::-1][:, :bits]
    around = (augmented - centre) @ axes
    turn, _ = np.linalg.qr(np.random.default_rng(1).normal(size=(bits, bits)))
    for _ in range(TURNS):
        signs = np.where(around @ turn > 0, 1.0, -1.0)
        left, _, right = np.linalg.svd(signs.T @ around)
        turn = (left @ right).T
    return Coder(norm, centre, axes @ turn)


def substrings(bits: int, rows: int) -> list[tuple[int, int]]:
    """Shift and width of each substring; widths of about the logarithm of the rows."""
    width = int(min(max(round(np.log2(max(rows, 2))), 4), 16))
    count = max(1, -(-bits // width))
    ends = [bits * k // count for k in range(count + 1)]
    return [(a, b - a) for a, b in zip(ends, ends[1:], strict=False)]


def radii(radius: int, parts: list[tuple[int, int]]) -> list[int]:
    """Bits in which each substring may differ; -1 where it need not be probed."""
    whole, over = divmod(radius, len(parts))
    return [min(whole if k <= over else whole - 1, width) for k, (_, width) in enumerate(parts)]


class Index:
    """Codes of some rows, looked up by each of their substrings."""

    def __init__(self, codes: np.ndarray, bits: int) -> None:
        self.codes = codes
        self.parts = substrings(bits, len(codes))
        self.values, self.order, self.starts = [], [], []
        for shift, width in self.parts:
            own = ((codes >> np.uint64(shift)) & np.uint64((1 << width) - 1)).astype(np.int64)
            order = np.argsort(own, kind="stable")
            self.values.append(own)
            self.order.append(order)
            self.starts.append(np.searchsorted(own[order], np.arange((1 << width) + 1)))

    def within(self, asked: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """Every pair of an asked code and a row whose codes differ in at most ``radius`` bits."""
        found, limits, asked_values = [], radii(radius, self.parts), []
        for k, (shift, width) in enumerate(self.parts):
            values = ((asked >> np.uint64(shift)) & np.uint64((1 << width) - 1)).astype(np.int64)
            asked_values.append(values)
            if limits[k] < 0:
                continue
            near = np.arange(1 << width, dtype=np.int64)
            near = near[np.bitwise_count(near) <= limits[k]]
            probes = values[:, None] ^ near[None, :]
            first = self.starts[k][probes].ravel()
            count = self.starts[k][probes + 1].ravel() - first
            query = np.repeat(np.arange(len(asked)), len(near))
            held = count > 0
            first, count, query = first[held], count[held], query[held]
            before = np.cumsum(count) - count
            row = self.order[k][np.arange(count.sum()) + np.repeat(first - before, count)]
            query = np.repeat(query, count)
            # a pair belongs to the first substring that finds it
            new = np.ones(len(row), bool)
            for j in range(k):
                if limits[j] >= 0:
                    new &= np.bitwise_count(asked_values[j][query] ^ self.values[j][row]) > limits[j]
            query, row = query[new], row[new]
            near_enough = np.bitwise_count(asked[query] ^ self.codes[row]) <= radius
            found.append((query[near_enough], row[near_enough]))
        return np.concatenate([q for q, _ in found]), np.concatenate([r for _, r in found])


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows, in one order of summation whatever the number of rows."""
    return (a * b).sum(axis=1)


class Search:
    """The best of the rows that a block of queries finds within the radius."""

    def __init__(self, queries: pa.Table, coder: Coder, radius: int, k: int, dims: int) -> None:
        self.coder, self.radius, self.dims = coder, radius, dims
        self.own = queries["id"].to_numpy()
        self.vectors = matrix(queries["vec"], dims)
        self.codes = coder.queries(self.vectors)
        self.best = Best(len(self.own), k)

    def add(self, rows: pa.Table) -> None:
        ids, vectors = rows["id"].to_numpy(), matrix(rows["vec"], self.dims)
        index = Index(self.coder.rows(vectors), self.coder.bits)
        step = max(1, STEP_PAIRS // len(ids))
        for start in range(0, len(self.own), step):
            query, row = index.within(self.codes[start : start + step], self.radius)
            query = query + start
            other = self.own[query] != ids[row]
            self._rank(query[other], row[other], ids, vectors)

    def _rank(self, query: np.ndarray, row: np.ndarray, ids: np.ndarray, vectors: np.ndarray) -> None:
        # few rows first: the best of them leave little of the others to be sorted
        cuts = [0, *(1 << b for b in range(8, 64) if 1 << b < len(ids)), len(ids)]
        share = np.searchsorted(cuts, row, side="right") - 1
        for k in range(len(cuts) - 1):
            at = np.flatnonzero(share == k)
            for part in np.array_split(at, max(1, -(-len(at) // 65_536))):
                self.best.offer(query[part], ids[row[part]], products(self.vectors[query[part]], vectors[row[part]]))

    def result(self) -> pa.RecordBatch:
        query, ids, scores, _ = self.best.entries()
        return pa.RecordBatch.from_arrays([pa.array(self.own[query]), pa.array(ids), pa.array(scores)], names=["query_id", "vec_id", "score"])


def _first(found: DataFrame, k: int) -> DataFrame:
    """The ``k`` best of each query with their rank."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def sampled(rows: DataFrame, count: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """At most ``size`` ids and vectors, chosen by a hash of the ids before they are sorted."""
    place = F.xxhash64("id", F.lit(7))
    chosen = rows.where(F.pmod(place, F.lit(max(count, 1))) < 2 * size)
    got = chosen.orderBy(place, "id", "vec").limit(size).select("id", "vec").collect()
    return np.array([r["id"] for r in got], np.int64), np.array([r["vec"] for r in got], np.float64)


def fitted_radius(rows: DataFrame, ids: np.ndarray, asked: np.ndarray, coder: Coder, k: int, aim: float) -> int:
    """The least radius that holds the share ``aim`` of the sampled queries' true neighbours."""
    codes, dims = coder.queries(asked), asked.shape[1]

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(len(ids), k)
        for batch in batches:
            own, vectors = batch.column("id").to_numpy(), matrix(batch.column("vec"), dims)
            scores = asked @ vectors.T
            query, row = np.nonzero((scores >= best.least()[:, None]) & (ids[:, None] != own[None, :]))
            apart = np.bitwise_count(codes[query] ^ coder.rows(vectors)[row]).astype(np.int64)
            best.offer(query, own[row], scores[query, row], apart)
        query, near, scores, apart = best.entries()
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids[query]), pa.array(near), pa.array(scores), pa.array(apart)], names=["query_id", "vec_id", "score", "apart"]
        )

    found = rows.select("id", "vec").mapInArrow(compared, "query_id bigint, vec_id bigint, score double, apart bigint")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    true = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    held = {r["apart"]: r["n"] for r in true.groupBy("apart").agg(F.count(F.lit(1)).alias("n")).collect()}
    total, radius = 0, 0
    for radius in range(coder.bits + 1):
        total += held.get(radius, 0)
        if total >= aim * sum(held.values()):
            break
    return radius


def searched(queries: DataFrame, rows: DataFrame, sizes: tuple[int, int], coder: Coder, radius: int, k: int, dims: int) -> DataFrame:
    """The ``k`` best of the rows within the radius of each query."""

    def begin(asked: pa.Table) -> Search:
        return Search(asked, coder, radius, k, dims)

    return _first(met(queries, rows, sizes, begin, "query_id bigint, vec_id bigint, score double"), k)


def nearest(
    table: DataFrame, asks: Column, k: int = 20, aim: float = AIM, id_name: str = "vec_id", vec_name: str = "embedding"
) -> DataFrame:
    """``query_id, rank, vec_id, score`` of the ``k`` rows found for every row that ``asks`` selects."""
    found, _ = nearest_within(table, asks, k, aim, id_name, vec_name)
    return found


def nearest_within(
    table: DataFrame, asks: Column, k: int, aim: float, id_name: str, vec_name: str
) -> tuple[DataFrame, int | None]:
    """:func:`nearest` and the radius that was learned."""
    spark = table.sparkSession
    dims = usual_length(table, F.col(vec_name))
    empty = spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    if dims is None:
        return empty, None
    vec = F.col(vec_name)
    taken = table.where(F.col(id_name).isNotNull() & finite(vec) & (F.size(vec) == dims) & F.exists(vec, lambda x: x != 0))
    rows = keep(taken.select(F.col(id_name).cast("bigint").alias("id"), vec.cast("array<double>").alias("vec"), asks.alias("asks")), "vectors")
    queries = keep(rows.where("asks").groupBy("id").agg(F.min("vec").alias("vec")), "queries")
    rows = rows.select("id", "vec")
    square = F.aggregate("vec", F.lit(0.0), lambda s, x: s + x * x)
    about = rows.agg(F.count(F.lit(1)).alias("n"), F.max(F.sqrt(square)).alias("norm")).first()
    sizes = (queries.count(), about["n"])
    if not sizes[0] or not sizes[1]:
        return empty, None
    coder = learned(sampled(rows, sizes[1], SAMPLE_ROWS)[1], about["norm"])
    radius = fitted_radius(rows, *sampled(queries, sizes[0], SAMPLE_QUERIES), coder, k, aim)
    found = keep(searched(queries, rows, sizes, coder, radius, k, dims), "found")
    # queries with fewer than k rows in their radius are asked for every code
    full = found.where(F.col("rank") == k).select(F.col("query_id").alias("id"))
    short = keep(queries.join(full, "id", "left_anti"), "short")
    again = short.count()
    if not again:
        return found, radius
    rest = keep(searched(short, rows, (again, sizes[1]), coder, coder.bits, k, dims), "rest")
    return found.join(full.withColumnRenamed("id", "query_id"), "query_id", "left_semi").select(rest.columns).unionByName(rest), radius
