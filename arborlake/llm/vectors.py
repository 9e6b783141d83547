"""Vectors of a table, and a set of query rows met with all rows in blocks.

A grid cell holds one block of queries and one share of the rows. Rows are dealt to
``row_shares`` shares by a hash, a number that grows with the square root of the rows, and
queries to blocks of about ``QUERY_BLOCK``. A task holds the queries of its cell, streams
the rows past them in chunks and hands on what each query keeps, so its memory is bounded
by the block and the chunk and no pair of a query and a row ever becomes a row of Spark.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Queries that a task holds, about; queries are dealt to blocks by a hash.
QUERY_BLOCK = 16_384
#: Rows that a task works on at a time.
CHUNK_ROWS = 32_768
#: Rows per share are this many times the number of shares.
ROWS_PER_SHARE = 64


def finite(vec: Column) -> Column:
    """Whether the vector is given and none of its components is NULL, NaN or infinite."""
    return vec.isNotNull() & F.forall(vec, lambda x: x.isNotNull() & (F.abs(x) < F.lit(float("inf"))))


def usual_length(table: DataFrame, vec: Column) -> int | None:
    """The length that most vectors have, the smaller one on a tie; None without vectors."""
    counts = table.where(finite(vec) & (F.size(vec) > 0)).groupBy(F.size(vec).alias("n")).agg(F.count(F.lit(1)).alias("rows"))
    top = counts.orderBy(F.desc("rows"), "n").limit(1).collect()
    return top[0]["n"] if top else None


def row_shares(rows: int) -> int:
    return max(1, math.isqrt(rows // ROWS_PER_SHARE))


def matrix(column: pa.ChunkedArray | pa.Array, dims: int) -> np.ndarray:
    """Vectors of equal length as a matrix of doubles."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(-1, dims)


class Meeting(Protocol):
    """What a block of queries keeps of the rows that pass by."""

    def add(self, rows: pa.Table) -> None: ...

    def result(self) -> pa.RecordBatch: ...


def met(
    queries: DataFrame, rows: DataFrame, sizes: tuple[int, int], begin: Callable[[pa.Table], Meeting], schema: str
) -> DataFrame:
    """Every query of ``queries`` meets every row of ``rows``.

    Both have the columns of ``rows`` (``id``, ``vec`` and others); ``queries`` may have more.
    ``sizes`` are their numbers of rows, which only set the grid. ``begin`` takes the queries
    of a cell and returns their :class:`Meeting`.
    """
    blocks, shares = max(1, math.ceil(sizes[0] / QUERY_BLOCK)), row_shares(sizes[1])
    more = [c for c in queries.columns if c not in rows.columns]
    bare = rows.select("*", *(F.lit(None).cast(queries.schema[c].dataType).alias(c) for c in more))

    def every(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    asked = queries.select(*bare.columns, F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("_block"), every(shares).alias("_share"))
    passed = bare.select("*", every(blocks).alias("_block"), F.pmod(F.xxhash64("id", "vec"), F.lit(shares)).cast("int").alias("_share"))
    tagged = asked.withColumn("_row", F.lit(0)).unionByName(passed.withColumn("_row", F.lit(1)))
    celled = tagged.withColumn("_cell", F.col("_block") * shares + F.col("_share")).drop("_block", "_share")
    dealt = celled.repartitionById(blocks * shares, F.col("_cell")).sortWithinPartitions("_cell", "_row")

    def walked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, asked, waiting, held, meeting = None, [], [], 0, None

        def finished() -> Iterator[pa.RecordBatch]:
            if meeting is not None:
                if waiting:
                    meeting.add(pa.Table.from_batches(waiting))
                yield meeting.result()

        for batch in batches:
            cells = batch.column("_cell").to_numpy()
            kinds = batch.column("_row").to_numpy()
            turns = np.flatnonzero((np.diff(cells) != 0) | (np.diff(kinds) != 0)) + 1
            for start, end in zip([0, *turns], [*turns, len(cells)], strict=True):
                if start == end:
                    continue
                part = batch.slice(start, end - start)
                if cells[start] != cell:
                    yield from finished()
                    cell, asked, waiting, held, meeting = cells[start], [], [], 0, None
                if not kinds[start]:
                    asked.append(part)
                elif asked:
                    meeting = meeting or begin(pa.Table.from_batches(asked))
                    waiting.append(part)
                    held += len(part)
                    if held >= CHUNK_ROWS:
                        meeting.add(pa.Table.from_batches(waiting))
                        waiting, held = [], 0
        yield from finished()

    return dealt.mapInArrow(walked, schema)


class Best:
    """The ``size`` best entries of each query: highest score first, then least id.

    An entry may carry a number of its own, ``notes``.
    """

    def __init__(self, queries: int, size: int, kind: type = np.float64) -> None:
        self.size = size
        self.scores = np.full((queries, size), -np.inf if kind is np.float64 else np.iinfo(np.int64).min, kind)
        self.ids = np.zeros((queries, size), np.int64)
        self.notes = np.zeros((queries, size), np.int64)
        self.filled = np.zeros(queries, np.int64)

    def least(self) -> np.ndarray:
        """The score that a further entry of each query must reach."""
        return self.scores[:, -1]

    def offer(self, query: np.ndarray, ids: np.ndarray, scores: np.ndarray, notes: np.ndarray | None = None) -> None:
        """Merge entries, which need not be in any order."""
        if notes is None:
            notes = np.zeros(len(query), np.int64)
        well = scores >= self.scores[query, -1]
        query, ids, scores, notes = query[well], ids[well], scores[well], notes[well]
        if not len(query):
            return
        touched = np.unique(query)
        held, place = _positions(touched, self.filled[touched])
        query = np.r_[held, query]
        ids = np.r_[self.ids[held, place], ids]
        scores = np.r_[self.scores[held, place], scores]
        notes = np.r_[self.notes[held, place], notes]
        # ascending by the complement of the id and reversed, as the least integer has no negative
        order = np.lexsort((~ids, scores, -query))[::-1]
        query = query[order]
        first = np.flatnonzero(np.r_[True, query[1:] != query[:-1]])
        rank = np.arange(len(query)) - np.repeat(first, np.diff(np.r_[first, len(query)]))
        top = rank < self.size
        query, rank, order = query[top], rank[top], order[top]
        self.ids[query, rank] = ids[order]
        self.scores[query, rank] = scores[order]
        self.notes[query, rank] = notes[order]
        self.filled[touched] = np.bincount(query, minlength=len(self.filled))[touched]

    def entries(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Query, id, score and note of all that is held."""
        query, place = _positions(np.arange(len(self.filled)), self.filled)
        return query, self.ids[query, place], self.scores[query, place], self.notes[query, place]


def _positions(queries: np.ndarray, filled: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each query as often as it has entries, and the places of the entries."""
    return np.repeat(queries, filled), np.arange(filled.sum()) - np.repeat(np.cumsum(filled) - filled, filled)
