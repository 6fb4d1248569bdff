"""Ids of texts from ids of their pieces: each distinct piece of a slice is encoded once."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 12 << 20

#: 1: ASCII letters, 2: ASCII punctuation without the apostrophe, 0: everything else.
_KIND = np.zeros(256, np.int8)
_KIND[[*range(65, 91), *range(97, 123)]] = 1
_KIND[[*range(33, 39), *range(40, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = 2


class Remembered:
    """Ids of pieces, for at most ``limit`` pieces kept between slices."""

    def __init__(self, encode: Callable[[list[bytes]], list], limit: int = 500_000):
        self.encode, self.limit = encode, limit
        self.place: dict[bytes, int] = {}
        self.start = np.zeros(1, np.int64)
        self.flat = np.zeros(0, np.int32)

    def of(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all pieces in order, number of ids per piece)."""
        coded = pieces.dictionary_encode()
        codes = coded.indices.to_numpy(zero_copy_only=False)
        names = coded.dictionary.to_pylist()
        get = self.place.get
        place = np.fromiter((get(n, -1) for n in names), np.int64, len(names))
        unknown = np.flatnonzero(place < 0)
        new = self.encode([names[i] for i in unknown]) if len(unknown) else []
        lengths = np.fromiter(map(len, new), np.int64, len(new))
        added = np.fromiter(chain.from_iterable(new), np.int32, int(lengths.sum()))
        flat = np.concatenate([self.flat, added])
        start = np.concatenate([self.start, self.start[-1] + np.cumsum(lengths)])
        place[unknown] = len(self.start) - 1 + np.arange(len(unknown))
        room = self.limit - len(self.place)
        if room > 0 and len(unknown):
            kept = unknown[:room]
            self.place.update((names[i], int(place[i])) for i in kept)
            self.start = start[: len(self.start) + len(kept)].copy()
            self.flat = flat[: self.start[-1]].copy()
        at = place[codes]
        size = (start[1:] - start[:-1])[at]
        ends = np.cumsum(size)
        total = int(ends[-1]) if len(ends) else 0
        where = np.repeat(start[at] - (ends - size), size) + np.arange(total)
        return flat[where], size


def row_slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about ``limit`` bytes of text together, one row at least."""
    sizes = np.cumsum(pc.binary_length(column.fill_null("")).to_numpy(zero_copy_only=False))
    first = 0
    while first < len(column):
        base = sizes[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(sizes, base + limit, side="right")))
        yield first, last
        first = last


def whole(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a slice of texts and the offsets of its rows, nulls as empty texts."""
    column = pa.concat_arrays([column.cast(pa.binary()).fill_null(b"")])  # own buffers, without the rest of the batch
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    bytes_ = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return bytes_[ends[0] : ends[-1]], ends - ends[0]


def binary_array(data: np.ndarray, cuts: np.ndarray) -> pa.Array:
    """The pieces of ``data`` between consecutive cuts."""
    return pa.Array.from_buffers(pa.binary(), len(cuts) - 1, [None, pa.py_buffer(cuts.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])


def letter_edges(data: np.ndarray) -> np.ndarray:
    """Where an ASCII letter meets ASCII punctuation: patterns that split words always cut there.

    Entry i stands for the border before byte i. Apostrophes are left out, as they begin contractions.
    """
    kind = _KIND[data]
    out = np.zeros(len(data) + 1, bool)
    if len(data):
        out[1:-1] = kind[1:] + kind[:-1] == 3
    return out
