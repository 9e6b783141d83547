"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

The patterns are the windows of ``WINDOW`` consecutive words of the benchmark items; an
item with fewer words is one window. All patterns of one length share a shift table over
blocks of two words: a block that ends a pattern has shift 0, any other block the least
distance to the end of a pattern, an unknown block the whole window but one word. The scan
of a text jumps by these shifts; where the shift is 0, the bucket of the block that ends
there gives the patterns to compare word by word.

A benchmark of at most ``BROADCAST_BYTES`` of text, measured before any of it is read, goes
to every task by broadcast: the work on a document needs nothing but its own row, so there is
no shuffle of texts and no hot group. A larger one never passes through the driver. Its shift
tables are built by Spark over hashed blocks, ``1 << SHIFT_BITS`` bytes for each length, and
with them a table of ``1 << SUFFIX_BITS`` bytes that tells by a bit whether a window may be a
pattern; collisions only shorten shifts and let places pass. These tables have one size whatever
the benchmark, and are broadcast. Documents are scanned as before; places where the shift is 0
and the bit is set become rows with a digest of 128 bits, and meet the patterns' digests in a
join, so windows of clean documents are hardly ever written. Documents are known there by the
digest of their text, so copies of a text count once; results join back by that digest.

Defined results: a NULL or empty text has no words, no hits and is not contaminated; NULL
or empty items have no windows; items without an id count as hits but are not named;
repeated rows are judged one by one; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arborlake.llm import words as W
from arborlake.llm.store import fresh_name, keep

WINDOW = 13
#: Most text of a benchmark that is broadcast. A task's tables take about 1 KB for each word.
BROADCAST_BYTES = 1 << 20
#: Windows in one batch of rows.
BATCH_ROWS = 1 << 14
#: Entries, of one byte, of the hashed shift table of a length and of the table of windows.
SHIFT_BITS = 22
SUFFIX_BITS = 24
#: A document is contaminated if its hit words are at least one of so many.
SHARE = 20

#: Letters and digits of ASCII and everything beyond ASCII make up words.
_FOLD = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32
    for b in range(256)
)

RESULT = "n_words bigint, n_hit bigint, items array<string>"


def folded_words(text: bytes | None) -> list[bytes]:
    return text.translate(_FOLD).split() if text else []


class PatternSet:
    """Patterns of one length with their shift table and buckets."""

    def __init__(self, patterns: dict[tuple[bytes, ...], set[str | None]], length: int):
        self.length = length
        self.block = min(2, length)
        self.jump = length - self.block + 1
        self.shift: dict[tuple[bytes, ...], int] = {}
        self.bucket: dict[tuple[bytes, ...], list] = defaultdict(list)
        for pattern, items in patterns.items():
            for end in range(self.block, length + 1):
                at = pattern[end - self.block : end]
                self.shift[at] = min(self.shift.get(at, self.jump), length - end)
            self.bucket[pattern[-self.block :]].append((pattern[0], pattern, items))

    def search(self, words: list[bytes], found: Callable[[int, set], None]) -> None:
        """Call ``found(start, items)`` for every occurrence."""
        length, shift, jump, bucket = self.length, self.shift, self.jump, self.bucket
        end, count = length, len(words)
        if self.block == 1:
            for k, word in enumerate(words):
                for _, _, items in bucket.get((word,), ()):
                    found(k, items)
            return
        while end <= count:
            at = (words[end - 2], words[end - 1])
            step = shift.get(at, jump)
            if step:
                end += step
                continue
            start = end - length
            first = words[start]
            for head, pattern, items in bucket[at]:
                if head == first and pattern == tuple(words[start:end]):
                    found(start, items)
                    break
            end += 1


def pattern_sets(items: list[tuple[str | None, str | None]], window: int = WINDOW) -> list[PatternSet]:
    """Shift tables and buckets of the items, one set for each length of pattern."""
    by_length: dict[int, dict[tuple[bytes, ...], set]] = defaultdict(lambda: defaultdict(set))
    for item, text in items:
        words = folded_words(text.encode() if text else None)
        size = min(window, len(words))
        if size:
            for k in range(len(words) - size + 1):
                by_length[size][tuple(words[k : k + size])].add(item)
    return [PatternSet(patterns, size) for size, patterns in sorted(by_length.items())]


def search_words(words: list[bytes], sets: list[PatternSet]) -> tuple[list[tuple[int, int]], set[str]]:
    """Spans of words inside an occurrence, and the items that occur."""
    spans: list[tuple[int, int]] = []
    items: set = set()
    for each in sets:
        size = each.length

        def found(start: int, names: set, size: int = size) -> None:
            spans.append((start, start + size))
            items.update(names)

        each.search(words, found)
    items.discard(None)
    return spans, items


def search_column(text: Column, items) -> Column:
    """Struct of word count, hit words and occurring items; ``items`` is a broadcast."""

    @F.arrow_udf(RESULT)
    def searched(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        sets = pattern_sets(items.value)
        for batch in batches:
            counts, hits, names = [], [], []
            for value in W.as_bytes(batch):
                words = folded_words(value)
                spans, found = search_words(words, sets)
                counts.append(len(words))
                hit = 0
                if spans:
                    marks = np.zeros(len(words), bool)
                    for start, end in spans:
                        marks[start:end] = True
                    hit = int(marks.sum())
                hits.append(hit)
                names.append(sorted(found))
            yield pa.StructArray.from_arrays(
                [pa.array(counts, pa.int64()), pa.array(hits, pa.int64()), pa.array(names, pa.list_(pa.string()))],
                names=["n_words", "n_hit", "items"],
            )

    return searched(text)


def benchmark_items(benchmark: DataFrame) -> DataFrame:
    rows = benchmark.select(F.col("item_id").cast("string").alias("item"), F.col("text").cast("string").alias("text"))
    return rows.where(F.col("text").isNotNull())


def fits_broadcast(items: DataFrame) -> bool:
    held = F.octet_length("text") + F.coalesce(F.octet_length("item"), F.lit(0)) + 64
    return (items.agg(F.sum(held).alias("n")).first()["n"] or 0) <= BROADCAST_BYTES


def item_windows(items: DataFrame) -> DataFrame:
    """``item, size, code``: the windows of each item with a digest of 128 bits."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, text in zip(batch.column(0).to_pylist(), W.as_bytes(batch.column(1)), strict=True):
                words = folded_words(text)
                size = min(WINDOW, len(words))
                for low in range(0, len(words) - size + 1 if size else 0, BATCH_ROWS):
                    starts = range(low, min(low + BATCH_ROWS, len(words) - size + 1))
                    codes = [window_digest(words, k, size) for k in starts]
                    columns = [pa.array([name] * len(codes), pa.string()), pa.array([size] * len(codes), pa.int64()), pa.array(codes, pa.binary())]
                    yield pa.RecordBatch.from_arrays(columns, names=["item", "size", "code"])

    return items.select("item", "text").mapInArrow(cut, "item string, size bigint, code binary")


def window_digest(words: list[bytes], start: int, size: int) -> bytes:
    return hashlib.md5(b" ".join(words[start : start + size])).digest()


def block_entries(codes: np.ndarray, size: int) -> np.ndarray:
    """The entry of each block of two words, or of each word where patterns have one."""
    return (W.windows(codes, min(2, size)) >> np.uint64(64 - SHIFT_BITS)).astype(np.int64)


def suffix_entries(codes: np.ndarray, starts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Entry and bit of the windows of ``size`` words at the starts."""
    total = np.full(len(starts), size, np.uint64)
    for k in range(size):
        total = W.mix(total + codes[starts + k])
    return (total >> np.uint64(64 - SUFFIX_BITS)).astype(np.int64), np.uint8(1) << (total & np.uint64(7)).astype(np.uint8)


def hashed_tables(items: DataFrame) -> tuple[dict[int, np.ndarray], np.ndarray]:
    """The shift table of each length, and the table of windows, built from the items.

    Entries are combined in parts of at most 2 ** 20; the driver receives the tables only.
    """
    part_bits = 20

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = W.WordCodes()
        for batch in batches:
            for text in W.as_bytes(batch.column(0)):
                codes = known.of(folded_words(text))
                size = min(WINDOW, len(codes))
                for low in range(0, len(codes) - size + 1 if size else 0, BATCH_ROWS):
                    piece = codes[low : low + BATCH_ROWS + size - 1]
                    blocks, width = block_entries(piece, size), min(2, size)
                    # the first blocks of an item end no window of it
                    ends = np.arange(len(blocks)) + width + low
                    shift = np.maximum(size - ends, 0).astype(np.uint8)
                    entries, bits = suffix_entries(piece, np.arange(len(piece) - size + 1), size)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.r_[np.full(len(blocks), size), np.zeros(len(entries), np.int64)].astype(np.int64)),
                            pa.array(np.r_[blocks, entries]),
                            pa.array(np.r_[shift, bits].astype(np.int64)),
                        ],
                        names=["size", "entry", "value"],
                    )

    def packed(table: pa.Table) -> pa.Table:
        size, entry, value = (table[c].to_numpy() for c in ("size", "entry", "value"))
        held = np.zeros(1 << part_bits, np.uint8) if size[0] == 0 else np.full(1 << part_bits, 255, np.uint8)
        at = entry & ((1 << part_bits) - 1)
        (np.bitwise_or if size[0] == 0 else np.minimum).at(held, at, value.astype(np.uint8))
        return pa.table({"size": [int(size[0])], "part": [int(entry[0] >> part_bits)], "held": [held.tobytes()]})

    rows = items.select("text").mapInArrow(listed, "size bigint, entry bigint, value bigint")
    once = rows.groupBy("size", "entry").agg(F.when(F.col("size") == 0, F.bit_or("value")).otherwise(F.min("value")).alias("value"))
    parts = once.groupBy("size", F.shiftright("entry", part_bits)).applyInArrow(packed, "size bigint, part bigint, held binary")
    shifts: dict[int, np.ndarray] = {}
    suffixes = np.zeros(1 << SUFFIX_BITS, np.uint8)
    for r in parts.toLocalIterator():
        held = np.frombuffer(r["held"], np.uint8)
        low = r["part"] << part_bits
        if r["size"]:
            # an unknown block shifts by the whole window but one word
            jump = r["size"] - min(2, r["size"]) + 1
            table = shifts.setdefault(r["size"], np.full(1 << SHIFT_BITS, jump, np.uint8))
            table[low : low + len(held)] = np.minimum(held[: len(table) - low], jump)
        else:
            suffixes[low : low + len(held)] = held[: len(suffixes) - low]
    return shifts, suffixes


def places(codes: np.ndarray, size: int, shift: np.ndarray, suffixes: np.ndarray) -> np.ndarray:
    """Starts of the windows that may be patterns: jumps by the shifts, then the bits of the windows."""
    if len(codes) < size:
        return np.empty(0, np.int64)
    steps = shift[block_entries(codes, size)].tolist()
    width, end, count, found = min(2, size), size, len(codes), []
    while end <= count:
        step = steps[end - width]
        if not step:
            found.append(end - size)
        end += step or 1
    starts = np.array(found, np.int64)
    entries, bits = suffix_entries(codes, starts, size)
    return starts[(suffixes[entries] & bits) > 0]


def place_rows(texts: DataFrame, tables) -> DataFrame:
    """``digest, start, size, code`` of the windows of each text that may be patterns."""

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shifts, suffixes = tables.value
        known = W.WordCodes()
        for batch in batches:
            for name, text in zip(batch.column(0).to_pylist(), W.as_bytes(batch.column(1)), strict=True):
                words = folded_words(text)
                codes = known.of(words)
                for size, shift in shifts.items():
                    starts = places(codes, size, shift, suffixes)
                    for low in range(0, len(starts), BATCH_ROWS):
                        some = starts[low : low + BATCH_ROWS]
                        digests = [window_digest(words, k, size) for k in some.tolist()]
                        columns = [pa.array([name] * len(some), pa.string()), pa.array(some), pa.array([size] * len(some), pa.int64())]
                        yield pa.RecordBatch.from_arrays([*columns, pa.array(digests, pa.binary())], names=["digest", "start", "size", "code"])

    return texts.select("digest", "text").mapInArrow(scanned, "digest string, start bigint, size bigint, code binary")


def text_digest(text: Column) -> Column:
    return F.sha2(F.coalesce(text.cast("string"), F.lit("")), 256)


def joined_hits(documents: DataFrame, items: DataFrame) -> DataFrame:
    """``digest, n_hit, items`` of every text with hits, by a join of windows."""
    named = keep(item_windows(items).distinct(), "item_windows")
    tables = documents.sparkSession.sparkContext.broadcast(hashed_tables(items))
    texts = documents.select(text_digest(F.col("text")).alias("digest"), F.col("text").cast("string").alias("text"))
    wanted = named.select("size", "code").distinct()
    # copies of a text give the same rows
    places_ = place_rows(texts.where(F.col("text").isNotNull()), tables).distinct()
    hits = keep(places_.join(wanted, ["size", "code"], "left_semi"), "hits")
    # the words of a text that hits cover: each run begins past the greatest end so far
    ordered = Window.partitionBy("digest").orderBy("start", "size").rowsBetween(Window.unboundedPreceding, -1)
    end = F.col("start") + F.col("size")
    fresh = F.greatest(F.lit(0), end - F.greatest("start", F.coalesce(F.max(end).over(ordered), F.lit(0))))
    counted = hits.withColumn("fresh", fresh).groupBy("digest").agg(F.sum("fresh").alias("n_hit"))
    pairs = hits.select("digest", "size", "code").distinct().join(named.where(F.col("item").isNotNull()), ["size", "code"])
    held = pairs.select("digest", "item").distinct().groupBy("digest").agg(F.array_sort(F.collect_list("item")).alias("items"))
    return keep(counted.join(held, "digest", "left"), "text_hits")


def word_count(text: Column) -> Column:
    @F.arrow_udf("bigint")
    def counted(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([len(folded_words(t)) for t in W.as_bytes(batch)], pa.int64())

    return counted(text)


def with_hits(documents: DataFrame, benchmark: DataFrame, name: str, columns: list[str]) -> DataFrame:
    """``columns`` of every row, and the struct ``name`` of ``n_words, n_hit, items``."""
    items = benchmark_items(benchmark)
    if fits_broadcast(items):
        rows = [(r["item"], r["text"]) for r in items.collect()]  # within BROADCAST_BYTES
        found = search_column(F.col("text").cast("string"), documents.sparkSession.sparkContext.broadcast(rows))
        return documents.select(*columns, found.alias(name))
    digest, held, count = (fresh_name(documents, stem=x) for x in ("digest", "hits", "count"))
    hits = joined_hits(documents, items).select(F.col("digest").alias(digest), F.struct("n_hit", "items").alias(held))
    keyed = documents.select(*columns, text_digest(F.col("text")).alias(digest), word_count(F.col("text").cast("string")).alias(count))
    found = F.struct(
        F.col(count).alias("n_words"),
        F.coalesce(F.col(held)["n_hit"], F.lit(0)).cast("bigint").alias("n_hit"),
        F.coalesce(F.col(held)["items"], F.array().cast("array<string>")).alias("items"),
    )
    return keyed.join(hits, digest, "left").select(*columns, found.alias(name))


def hit_report(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``doc_id, n_words, n_hit, items`` of every row."""
    return with_hits(documents, benchmark, "found", ["doc_id"]).select("doc_id", "found.*")


def contaminated(n_hit: Column, n_words: Column, share: int = SHARE) -> Column:
    return (n_hit > 0) & (n_hit * share >= n_words)


def without_contaminated(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows that are not contaminated, with all their columns."""
    name = fresh_name(documents, stem="found")
    tested = with_hits(documents, benchmark, name, [f"`{c}`" for c in documents.columns])
    return tested.where(~contaminated(F.col(f"{name}.n_hit"), F.col(f"{name}.n_words"))).drop(name)


def items_digest(items: Column) -> Column:
    return F.sha2(F.array_join(F.array_sort(items), ","), 256)
