"""Substring deduplication by difference-cover anchors.

A word is removed if a window of ``WINDOW`` words around it, in the same order, starts in a
document with a smaller id as well.

Anchors. ``COVER`` is a difference cover modulo ``PERIOD``: for any two places there is a
step below ``PERIOD`` that brings both to a place whose remainder is in the cover. So if a
window of ``WINDOW`` words occurs twice, the two occurrences hold equal runs of ``ANCHOR =
WINDOW - PERIOD + 1`` words at equal distance from their starts, both at cover places. Only
runs at cover places, three in seven, are hashed and compared. Runs that only one document
has are done with; around the others the match is extended: all windows that hold a shared
anchor are hashed in full, and the least id of each window decides.

Shuffles. Each batch sends the anchors (and then the windows) of its documents as arrays,
one row for each key range, and lists a hash once, for the least id it has seen; the other
ids of the batch are already known to share it. A passage that a third of all documents
hold is thus one entry a batch and no hot key. Texts move once, by id; both uses of them
read the same exchange.

Defined results: NULL and empty texts have no words; texts with fewer words than a window
keep all; a window that only repeats within its own document stays; rows that repeat an id
with the same text are alike; rows without an id keep all words and are nobody's earlier
document.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arborlake.llm import words as W

WINDOW = 13
PERIOD = 7
COVER = (0, 1, 3)
ANCHOR = WINDOW - PERIOD + 1
#: Hashes that a task gathers before it hands them on; bounds its memory.
BATCH_HASHES = 1 << 20

_SALT = np.uint64(0x8CB92BA72F3D8DD7)
#: ``known`` rows are decided within the batch; the others are to be compared.
_SENT = "part bigint, known boolean, ids array<bigint>, texts array<bigint>, counts array<int>, hashes array<bigint>, places array<int>"
_FOUND = "bucket bigint, ids array<bigint>, texts array<bigint>, counts array<int>, places array<int>"
_PLACES = "doc_id bigint, text_key bigint, places array<int>"


def anchor_places(length: int) -> np.ndarray:
    """Places of the anchors in a text of so many words."""
    places = np.arange(max(0, length - ANCHOR + 1))
    return places[np.isin(places % PERIOD, COVER)]


class Sender:
    """Gathers hashes by document and hands them on by range."""

    def __init__(self, ranges: int):
        self.ranges = ranges
        self.clear()

    def clear(self) -> None:
        self.ids, self.texts, self.hashes, self.places, self.held = [], [], [], [], 0

    def add(self, doc_id: int, text_key: int, hashes: np.ndarray, places: np.ndarray) -> bool:
        """True if it is time to flush."""
        if len(hashes):
            self.ids.append(doc_id)
            self.texts.append(text_key)
            self.hashes.append(hashes)
            self.places.append(places)
            self.held += len(hashes)
        return self.held >= BATCH_HASHES

    def flush(self, later_known: bool) -> Iterator[pa.RecordBatch]:
        """``later_known``: only later ids are decided by the batch, else all that share."""
        if not self.held:
            return
        sizes = [len(h) for h in self.hashes]
        ids, texts = np.array(self.ids, np.int64), np.array(self.texts, np.int64)
        owner = np.repeat(np.arange(len(ids)), sizes)
        hashes, places = np.concatenate(self.hashes), np.concatenate(self.places).astype(np.int32)
        self.clear()
        order = np.lexsort((ids[owner], hashes))
        hashes, owner, places = hashes[order], owner[order], places[order]
        group, least, shared = _groups(hashes, ids[owner])
        of_least = ids[owner] == least
        known = ~of_least if later_known else shared
        yield from self._rows(ids, texts, hashes, owner, places, known, True)
        # of a hash, the places of its least id are sent; one will do where all are known
        send = of_least if later_known else ~shared | np.r_[True, hashes[1:] != hashes[:-1]]
        yield from self._rows(ids, texts, hashes, owner, places, send, False)

    def _rows(self, ids, texts, hashes, owner, places, rows, known) -> Iterator[pa.RecordBatch]:
        if not rows.any():
            return
        hashes, owner, places = hashes[rows], owner[rows], places[rows]
        by = ids[owner] if known else hashes
        part = (W.mix(by.view(np.uint64) ^ _SALT) % np.uint64(self.ranges)).astype(np.int64)
        order = np.lexsort((places, owner, part))
        hashes, owner, places, part = hashes[order], owner[order], places[order], part[order]
        cuts = np.flatnonzero(np.diff(part, prepend=-1))
        runs = np.flatnonzero(np.r_[True, (np.diff(part) != 0) | (np.diff(owner) != 0)])
        counts = np.diff(np.r_[runs, len(part)])
        at = np.searchsorted(runs, cuts)[1:]
        columns = [
            pa.array(part[cuts] + (self.ranges if known else 0)),
            pa.array(np.full(len(cuts), known)),
            W.list_array(np.split(ids[owner[runs]], at), pa.int64()),
            W.list_array(np.split(texts[owner[runs]], at), pa.int64()),
            W.list_array(np.split(counts, at), pa.int32()),
            W.list_array([np.empty(0)] * len(cuts) if known else np.split(hashes.view(np.int64), cuts[1:]), pa.int64()),
            W.list_array(np.split(places, cuts[1:]), pa.int32()),
        ]
        yield pa.RecordBatch.from_arrays(columns, names=["part", "known", "ids", "texts", "counts", "hashes", "places"])


def _groups(hashes: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Group number, least id and whether two ids share it, of rows in order of hash and id."""
    first = np.r_[True, hashes[1:] != hashes[:-1]]
    group = np.cumsum(first) - 1
    starts = np.flatnonzero(first)
    least = ids[starts]
    most = ids[np.r_[starts[1:], len(ids)] - 1]
    return group, least[group], (least != most)[group]


def _by_id(ids: np.ndarray, ranges: int) -> np.ndarray:
    return (W.mix(ids.view(np.uint64) ^ _SALT) % np.uint64(ranges)).astype(np.int64)


def _flat(table: pa.Table, *names: str) -> list[np.ndarray]:
    return [table[c].combine_chunks().flatten().to_numpy() for c in names]


def _met(later_known: bool, ranges: int) -> Callable[[pa.Table], pa.Table]:
    """Compare the entries of a range: places to go on with, in one row for a range of ids."""

    def compared(table: pa.Table) -> pa.Table:
        ids, texts, counts, hashes, places = _flat(table, "ids", "texts", "counts", "hashes", "places")
        ids, texts = np.repeat(ids, counts), np.repeat(texts, counts)
        if not table["known"][0].as_py():
            order = np.lexsort((ids, hashes))
            ids, texts, places = ids[order], texts[order], places[order]
            _, least, shared = _groups(hashes[order], ids)
            wanted = ids > least if later_known else shared
            ids, texts, places = ids[wanted], texts[wanted], places[wanted]
        bucket = _by_id(ids, ranges)
        order = np.lexsort((places, texts, ids, bucket))
        ids, texts, places, bucket = ids[order], texts[order], places[order], bucket[order]
        cuts = np.flatnonzero(np.diff(bucket, prepend=-1))
        runs = np.flatnonzero(np.r_[True, (np.diff(ids) != 0) | (np.diff(texts) != 0)]) if len(ids) else cuts
        at = np.searchsorted(runs, cuts)[1:]
        split = lambda values, where: np.split(values, where) if len(cuts) else []
        return pa.table(
            {
                "bucket": pa.array(bucket[cuts]),
                "ids": W.list_array(split(ids[runs], at), pa.int64()),
                "texts": W.list_array(split(texts[runs], at), pa.int64()),
                "counts": W.list_array(split(np.diff(np.r_[runs, len(ids)]), at), pa.int32()),
                "places": W.list_array(split(places, cuts[1:]), pa.int32()),
            }
        )

    return compared


def _regrouped(table: pa.Table) -> pa.Table:
    """One row for each document of a range of ids."""
    ids, texts, counts, places = _flat(table, "ids", "texts", "counts", "places")
    ids, texts = np.repeat(ids, counts), np.repeat(texts, counts)
    order = np.lexsort((places, texts, ids))
    ids, texts, places = ids[order], texts[order], places[order]
    runs = np.flatnonzero(np.r_[True, (np.diff(ids) != 0) | (np.diff(texts) != 0)])
    return pa.table(
        {"doc_id": pa.array(ids[runs]), "text_key": pa.array(texts[runs]), "places": W.list_array(np.split(places, runs[1:]), pa.int32())}
    )


def _gathered(sent: DataFrame, later_known: bool, ranges: int) -> DataFrame:
    """All places of each document in one row; no more than it has words."""
    met = sent.groupBy("part").applyInArrow(_met(later_known, ranges), _FOUND)
    return met.groupBy("bucket").applyInArrow(_regrouped, _PLACES)


def removed_places(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Texts by id, and the starts of windows that an earlier document has."""
    ranges = max(1, int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64(text).alias("text_key"), text.alias("text"))

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, sender = W.WordCodes(), Sender(ranges)
        for batch in batches:
            for doc, key, value in zip(batch["doc_id"].to_pylist(), batch["text_key"].to_pylist(), W.as_bytes(batch["text"]), strict=True):
                words = value.split()
                if doc is None or len(words) < WINDOW:
                    continue
                places = anchor_places(len(words))
                if sender.add(doc, key, W.windows(codes.of(words), ANCHOR)[places], places):
                    yield from sender.flush(False)
        yield from sender.flush(False)

    def extended(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, sender = W.WordCodes(), Sender(ranges)
        for batch in batches:
            places = batch["places"].to_pylist()
            for doc, key, value, at in zip(batch["doc_id"].to_pylist(), batch["text_key"].to_pylist(), W.as_bytes(batch["text"]), places, strict=True):
                if not at:
                    continue
                words = value.split()
                count = len(words) - WINDOW + 1
                marks = W.covered(np.maximum(np.array(at) - PERIOD + 1, 0), PERIOD, count + PERIOD)[:count]
                starts = np.flatnonzero(marks)
                if sender.add(doc, key, W.windows(codes.of(words), WINDOW)[starts], starts):
                    yield from sender.flush(True)
        yield from sender.flush(True)

    shared = _gathered(rows.mapInArrow(anchors, _SENT), False, ranges)
    near = rows.join(shared, ["doc_id", "text_key"], "left")
    removed = _gathered(near.select("doc_id", "text_key", "text", "places").mapInArrow(extended, _SENT), True, ranges)
    return rows, removed


def deduplicated(documents: DataFrame) -> DataFrame:
    """``doc_id, n_words, n_removed, kept`` of every row; ``kept`` is the text that is left."""
    rows, removed = removed_places(documents)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, gone, kept = [], [], []
            for value, at in zip(W.as_bytes(batch["text"]), batch["places"].to_pylist(), strict=True):
                words = value.split()
                counts.append(len(words))
                if at:
                    marks = W.covered(np.array(at), WINDOW, len(words))
                    words = [w for w, m in zip(words, marks.tolist(), strict=True) if not m]
                gone.append(counts[-1] - len(words))
                kept.append(b" ".join(words))
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], pa.array(counts, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())],
                names=["doc_id", "n_words", "n_removed", "kept"],
            )

    met = rows.join(removed, ["doc_id", "text_key"], "left").select("doc_id", "text", "places")
    return met.mapInArrow(cut, "doc_id bigint, n_words bigint, n_removed bigint, kept string")
