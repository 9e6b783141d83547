"""Words and word windows of whole texts, inside tasks.

White space is space and ``\\x09-\\x0D``, which is what ``bytes.split`` takes; a word is a
longest run of anything else. Lower-casing ``bytes`` touches A-Z only.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from xxhash import xxh3_64_intdigest

#: Words whose codes a task remembers; others are hashed again. Bounds its memory only.
REMEMBERED = 1 << 18

_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_MIXER = np.uint64(0xD6E8FEB86659FD93)
_HALF = np.uint64(32)


class WordCodes(dict):
    """64-bit codes of words."""

    def __missing__(self, word: bytes) -> int:
        code = xxh3_64_intdigest(word)
        if len(self) < REMEMBERED:
            self[word] = code
        return code

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mix(values: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values; one to one."""
    values = (values ^ (values >> _HALF)) * _MIXER
    return values ^ (values >> _HALF)


def windows(codes: np.ndarray, size: int) -> np.ndarray:
    """64-bit codes of every ``size`` consecutive words."""
    count = len(codes) - size + 1
    if count <= 0:
        return np.empty(0, np.uint64)
    total = np.full(count, size, np.uint64)
    for k in range(size):
        total = total * _MULTIPLIER + codes[k : k + count]
    return mix(total)


def shingles(codes: np.ndarray, size: int) -> np.ndarray:
    """Sorted distinct windows; a shorter text is one window of all its words."""
    if not len(codes):
        return np.empty(0, np.uint64)
    return np.unique(windows(codes, min(size, len(codes))))


def covered(starts: np.ndarray, size: int, length: int) -> np.ndarray:
    """Which of ``length`` positions lie within ``size`` of one of the starts."""
    marks = np.zeros(length + 1, np.int64)
    np.add.at(marks, starts, 1)
    np.add.at(marks, np.minimum(starts + size, length), -1)
    return np.cumsum(marks[:length]) > 0


def as_bytes(column: pa.Array) -> list[bytes | None]:
    """The UTF-8 bytes of a text column."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()


def list_array(parts: Iterable[np.ndarray], kind: pa.DataType) -> pa.Array:
    """A list column with one element per array."""
    parts = list(parts)
    ends = np.cumsum([0, *map(len, parts)])
    values = np.concatenate(parts) if parts else np.empty(0)
    numbers = pa.array(values.astype(kind.to_pandas_dtype(), copy=False), kind)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), numbers)
