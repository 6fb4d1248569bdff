"""Numpy views of texts inside a task: words, their hashes and hashes of runs of words.

Texts are joined into one byte buffer per slice of about half a megabyte (a longer text is a slice of
its own), so temporary arrays stay small whatever the batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np

SLICE = 1 << 19
_WHITE = np.zeros(256, bool)
_WHITE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Odd multipliers of the two hash lanes, and the random values that stand for bytes.
BASES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))
_BYTES = np.random.Generator(np.random.PCG64(20240229)).integers(0, 2**63, (2, 256), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def slices(texts: list[bytes], limit: int = SLICE) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``limit`` bytes together."""
    first, size = 0, 0
    for i, text in enumerate(texts):
        if size and size + len(text) > limit:
            yield first, i
            first, size = i, 0
        size += len(text) + 1
    if first < len(texts):
        yield first, len(texts)


@dataclass
class Words:
    """The words of several texts: byte spans in ``data`` and the first word of each text."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray  # one more entry than there are texts

    @property
    def row(self) -> np.ndarray:
        """The text that each word belongs to."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    @property
    def position(self) -> np.ndarray:
        """The place of each word in its text."""
        return np.arange(len(self.start)) - np.repeat(self.first[:-1], np.diff(self.first))


def split_words(texts: list[bytes], *, lower: bool = False) -> Words:
    data = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
    if lower:
        data = LOWER[data]
    inside = ~_WHITE[data]
    edge = np.diff(inside.view(np.int8), prepend=0, append=0)
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    offset = np.cumsum([0, *(len(t) + 1 for t in texts)])
    return Words(data, start, end, np.searchsorted(start, offset))


@lru_cache(maxsize=4)
def _powers(lane: int, log: int) -> tuple[np.ndarray, np.ndarray]:
    base = BASES[lane]
    inverse = np.uint64(pow(int(base), -1, 1 << 64))
    ones = np.ones(1 << log, np.uint64)
    up, down = ones * base, ones * inverse
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


def _prefix(values: np.ndarray, lane: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = _powers(lane, max(20, int(len(values) + 1).bit_length()))
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], out=out[1:])
    return out, down


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every bit of a 64-bit value over all others."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def word_hashes(words: Words, lane: int = 0) -> np.ndarray:
    """A 64-bit hash of each word's bytes, the same in every process."""
    prefix, down = _prefix(_BYTES[lane][words.data], lane)
    length = (words.end - words.start).astype(np.uint64)
    return mix((prefix[words.end] - prefix[words.start]) * down[words.start] + length)


def run_hashes(hashes: np.ndarray, starts: np.ndarray, length, lane: int = 0) -> np.ndarray:
    """A hash of the ``length`` consecutive values from each start; ``length`` may be an array."""
    prefix, down = _prefix(hashes, lane)
    return mix((prefix[starts + length] - prefix[starts]) * down[starts])


def arrow_bytes(column) -> list[bytes]:
    """The texts of an Arrow column as UTF-8, a null as an empty text."""
    import pyarrow as pa

    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [x or b"" for x in column.cast(kind).to_pylist()]
