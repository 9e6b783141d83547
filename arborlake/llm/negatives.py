"""Hard negatives: rows of other labels that are almost as near as a positive.

Vectors become integers, ``floor(scale * x)``, and a score is their inner product, so scores
and ties are exact. Anchors meet all rows in blocks (:mod:`arborlake.llm.vectors`). A task
multiplies tiles of anchors and rows by Strassen's recursion on 64-bit integers: seven
products of half the size instead of eight, odd sides padded with zeros, down to ``LEAF``.
The additions on the way are exact in the ring of 64-bit integers, so the product is too.

Two passes keep heaps that merge. The first keeps the best rows of each anchor's label, its
positives. The second knows the positives' scores, so each anchor and positive has a window of
scores, and its heap keeps the best rows of other labels in the window. Heaps of tasks merge
by their order; no score leaves a task unless it is in one.

Defined results: rows without an id or a label, with a NULL vector, with a NULL, NaN or
infinite component, or of another length than most take no part. An id that repeats is one
anchor, with its least label and vector; rows with an anchor's id are neither its positives
nor its negatives, other repeated rows are listed as often as they come. Equal scores are
ordered by id. An anchor without another row of its label, or without a row in a window,
gives no row; an empty table gives an empty result. Integer components beyond 2 ** 28 end the
job with an error, as scores would not fit a long. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arborlake.llm.store import keep
from arborlake.llm.vectors import Best, finite, matrix, met, usual_length

LARGEST = 1 << 28
#: Sides up to which tiles are multiplied directly.
LEAF = 16
#: Anchors and rows of a tile.
TILE = (512, 2048)


def product(a: np.ndarray, b: np.ndarray, leaf: int = LEAF) -> np.ndarray:
    """``a @ b`` of 64-bit integers by Strassen's recursion."""
    m, k, n = len(a), a.shape[1], b.shape[1]
    if min(m, k, n) <= leaf:
        return np.einsum("ik,kj->ij", a, b)
    a = np.pad(a, ((0, m % 2), (0, k % 2)))
    b = np.pad(b, ((0, k % 2), (0, n % 2)))
    (a11, a12), (a21, a22) = (np.split(half, 2, axis=1) for half in np.split(a, 2))
    (b11, b12), (b21, b22) = (np.split(half, 2, axis=1) for half in np.split(b, 2))
    p1 = product(a11 + a22, b11 + b22, leaf)
    p2 = product(a21 + a22, b11, leaf)
    p3 = product(a11, b12 - b22, leaf)
    p4 = product(a22, b21 - b11, leaf)
    p5 = product(a11 + a12, b22, leaf)
    p6 = product(a21 - a11, b11 + b12, leaf)
    p7 = product(a12 - a22, b21 + b22, leaf)
    whole = np.block([[p1 + p4 - p5 + p7, p3 + p5], [p2 + p4, p1 - p2 + p3 + p6]])
    return whole[:m, :n]


class _Tiles:
    """The scores of a block of anchors, tile by tile."""

    def __init__(self, anchors: pa.Table, dims: int) -> None:
        self.dims = dims
        self.own = anchors["id"].to_numpy()
        self.labels = anchors["label"].to_numpy()
        self.vectors = integers(anchors["vec"], dims)

    def add(self, rows: pa.Table) -> None:
        ids, labels, vectors = rows["id"].to_numpy(), rows["label"].to_numpy(), integers(rows["vec"], self.dims)
        for r in range(0, len(ids), TILE[1]):
            part = slice(r, r + TILE[1])
            across = np.ascontiguousarray(vectors[part].T)
            for a in range(0, len(self.own), TILE[0]):
                scores = product(self.vectors[a : a + TILE[0]], across)
                self.look(a, scores, ids[part], labels[part])


class Positives(_Tiles):
    """Heaps of the best rows of each anchor's own label."""

    def __init__(self, anchors: pa.Table, dims: int, count: int) -> None:
        super().__init__(anchors, dims)
        self.best = Best(len(self.own), count, np.int64)

    def look(self, start: int, scores: np.ndarray, ids: np.ndarray, labels: np.ndarray) -> None:
        at = slice(start, start + len(scores))
        fits = (self.labels[at, None] == labels[None, :]) & (self.own[at, None] != ids[None, :])
        anchor, row = np.nonzero(fits & (scores >= self.best.least()[at, None]))
        self.best.offer(anchor + start, ids[row], scores[anchor, row])

    def result(self) -> pa.RecordBatch:
        anchor, ids, scores, _ = self.best.entries()
        return pa.RecordBatch.from_arrays(
            [pa.array(self.own[anchor]), pa.array(ids), pa.array(scores)], names=["anchor_id", "positive_id", "positive_score"]
        )


class Negatives(_Tiles):
    """Heaps of the best rows of other labels in each positive's window."""

    def __init__(self, anchors: pa.Table, dims: int, count: int, window: tuple[int, int]) -> None:
        super().__init__(anchors, dims)
        lists = anchors["scores"].combine_chunks()
        self.positives = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        self.start = np.cumsum(self.positives) - self.positives
        of = lists.flatten().to_numpy().tolist()
        # the least and the greatest whole score in the window; whole numbers of any size
        self.low = np.array([-((-window[0] * s) // 100) for s in of], np.int64)
        self.high = np.array([(window[1] * s) // 100 for s in of], np.int64)
        self.best = Best(len(of), count, np.int64)

    def look(self, start: int, scores: np.ndarray, ids: np.ndarray, labels: np.ndarray) -> None:
        at = np.arange(start, start + len(scores))
        other = self.labels[at, None] != labels[None, :]
        for rank in range(int(self.positives[at].max(initial=0))):
            has = np.flatnonzero(self.positives[at] > rank)
            heap = self.start[at[has]] + rank
            least = np.maximum(self.low[heap], self.best.least()[heap])
            of = scores[has]
            anchor, row = np.nonzero(other[has] & (of >= least[:, None]) & (of <= self.high[heap][:, None]))
            self.best.offer(heap[anchor], ids[row], of[anchor, row])

    def result(self) -> pa.RecordBatch:
        heap, ids, scores, _ = self.best.entries()
        anchor = np.repeat(np.arange(len(self.own)), self.positives)[heap]
        place = heap - self.start[anchor]
        return pa.RecordBatch.from_arrays(
            [pa.array(self.own[anchor]), pa.array(place), pa.array(ids), pa.array(scores)],
            names=["anchor_id", "place", "negative_id", "negative_score"],
        )


def integers(column: pa.ChunkedArray, dims: int) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy().astype(np.int64, copy=False).reshape(-1, dims)


def _ranked(found: DataFrame, keys: list[str], score: str, own: str, count: int, rank: str) -> DataFrame:
    """Heaps of tasks merged: the first of each key."""
    order = Window.partitionBy(*keys).orderBy(F.desc(score), own)
    return found.withColumn(rank, F.row_number().over(order)).where(F.col(rank) <= count)


def mined(
    table: DataFrame,
    anchors: Callable[[Column], Column],
    label: Column,
    positives: int = 5,
    negatives: int = 3,
    window: tuple[int, int] = (50, 95),
    scale: int = 256,
    id_name: str = "vec_id",
    vec_name: str = "embedding",
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    ``anchors`` tells from the id whether a row is an anchor; ``label`` is computed from the
    table's columns. A negative's score lies within ``window`` percent of the positive's.
    """
    spark = table.sparkSession
    vec = F.col(vec_name)
    named = table.where(F.col(id_name).isNotNull() & label.isNotNull())
    dims = usual_length(named, vec)
    empty = spark.createDataFrame(
        [], "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"
    )
    if dims is None:
        return empty
    whole = F.transform(vec, lambda x: F.floor(x.cast("double") * scale).cast("bigint"))
    fits = F.forall(whole, lambda x: (x <= LARGEST) & (x >= -LARGEST))
    checked = F.when(fits, whole).otherwise(F.raise_error(F.lit("a component is too large for exact scores")).cast("array<bigint>"))
    taken = named.where(finite(vec) & (F.size(vec) == dims))
    rows = keep(taken.select(F.col(id_name).cast("bigint").alias("id"), checked.alias("vec"), label.cast("bigint").alias("label")), "vectors")
    chosen = rows.where(anchors(F.col("id"))).groupBy("id").agg(F.min(F.struct("label", "vec")).alias("own"))
    asked = keep(chosen.select("id", "own.vec", "own.label"), "anchors")
    sizes = (asked.count(), rows.count())
    if not sizes[0]:
        return empty

    def begin_positives(block: pa.Table) -> Positives:
        return Positives(block, dims, positives)

    def begin_negatives(block: pa.Table) -> Negatives:
        return Negatives(block, dims, negatives, window)

    near = met(asked, rows, sizes, begin_positives, "anchor_id bigint, positive_id bigint, positive_score bigint")
    first = keep(_ranked(near, ["anchor_id"], "positive_score", "positive_id", positives, "place"), "positives")
    # a bounded number of positives for each anchor, in their order
    lists = first.groupBy(F.col("anchor_id").alias("id")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("place", "positive_score"))), lambda p: p["positive_score"]).alias("scores")
    )
    windows = asked.join(lists, "id")
    hard = met(windows, rows, sizes, begin_negatives, "anchor_id bigint, place bigint, negative_id bigint, negative_score bigint")
    ranked = _ranked(hard, ["anchor_id", "place"], "negative_score", "negative_id", negatives, "rank")
    named_first = first.withColumn("place", F.col("place").cast("bigint") - 1)
    return ranked.join(named_first, ["anchor_id", "place"]).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"
    )
