"""Byte-pair encoding and decoding by a tokenization automaton.

The automaton reads a pre-split word byte by byte and its arcs carry tokens. It is compiled from
the ranked merges, one gadget each: the gadget of merge (a, b) adds the arc of the joined token and
forbids, from its rank on, the sequence of an arc that ends in ``a`` and an arc that begins with
``b``. A token ends in everything on its right edge (itself, its right part, that one's right part,
...), and a gadget only sees a part that is not yet absorbed at its rank. The state after an arc is
its token. What is left is deterministic: exactly one path spells each word, and it is the result
of the merges. Rows of the transition table are filled on first use, since most of the squared
vocabulary never meets. Decoding emits the byte labels of the arcs.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from flowmill.llm.pieces import Remembered, binary_array, letter_edges, row_slices, whole
from flowmill.llm.text import _WHITE

_END = 1 << 60

#: Rows decoded and handed on together.
ROWS = 512

#: The pre-split of byte-level vocabularies.
PRE_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_symbols() -> dict[str, int]:
    """The printable characters that stand for bytes in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in set(plain)]
    return {**{chr(b): b for b in plain}, **{chr(256 + i): b for i, b in enumerate(other)}}


def _rare_rows(data: np.ndarray, ends: np.ndarray, marks: list[bytes]) -> np.ndarray:
    """Rows with white space beyond the six ASCII characters, or with a special token."""
    a, b, c = data[:-2], data[1:-1], data[2:]
    odd = np.zeros(len(data), bool)
    odd |= (data >= 0x1C) & (data <= 0x1F)
    if len(data) >= 2:
        odd[:-1] |= (data[:-1] == 0xC2) & ((data[1:] == 0x85) | (data[1:] == 0xA0))
    if len(data) >= 3:
        odd[:-2] |= (a == 0xE1) & (((b == 0x9A) & (c == 0x80)) | ((b == 0xA0) & (c == 0x8E)))
        odd[:-2] |= (a == 0xE2) & (b == 0x80) & ((c <= 0x8B) | (c == 0xA8) | (c == 0xA9) | (c == 0xAF))
        odd[:-2] |= (a == 0xE2) & (b == 0x81) & (c == 0x9F)
        odd[:-2] |= (a == 0xE3) & (b == 0x80) & (c == 0x80)
    at = list(np.flatnonzero(odd))
    text = data.tobytes()
    for mark in marks:
        found = text.find(mark)
        while found >= 0:
            at.append(found)
            found = text.find(mark, found + 1)
    return np.unique(np.searchsorted(ends, np.array(at, np.int64), side="right") - 1)


def _chunks(data: np.ndarray, ends: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """Pieces that no word of the pre-split crosses, and their number per row.

    A run of other characters takes one blank before it along; what white space is left before a
    run falls in two, all but its last character and that one; at the end of a text it is one piece.
    Holds where all white space is ASCII.
    """
    white = _WHITE[data]
    size = len(data)
    last = np.zeros(size + 1, bool)
    last[ends] = True  # a row begins here, or all ends
    change = np.ones(size + 1, bool)
    change[1:-1] = white[1:] != white[:-1]
    change |= last
    edges = np.flatnonzero(change)
    begin, end = edges[:-1], edges[1:]
    blank = white[begin] if size else np.zeros(0, bool)
    begin, end = begin[blank], end[blank]
    inner = ~last[end]  # more of the text follows
    cut = change.copy()
    cut[end[inner & (data[end - 1] == 32)]] = False
    cut[(end - 1)[inner & (end - begin >= 2)]] = True
    cut |= last | letter_edges(data)
    cuts = np.flatnonzero(cut)
    if not size:
        return binary_array(data, np.zeros(1, np.int64)), np.zeros(len(ends) - 1, np.int64)
    return binary_array(data, cuts), np.diff(np.searchsorted(cuts, ends))


class Automaton:
    def __init__(self, labels: list[bytes], merges: list[tuple[int, int, int]], limit: int = 1_000_000):
        """``labels``: bytes per id; ``merges``: (left, right, joined) by rank; ``limit``: table entries kept."""
        self.labels = labels
        self.rank = {}
        for rank, (a, b, joined) in enumerate(merges):
            self.rank.setdefault((a, b), (rank, joined))
        made = {joined for _, _, joined in merges}
        single = [i for i, label in enumerate(labels) if len(label) == 1 and i not in made]
        self.base = {labels[i]: i for i in single}
        #: Right and left edges: (part, rank at which it is absorbed), outermost first.
        self.right: dict[int, list[tuple[int, int]]] = {i: [(i, _END)] for i in single}
        self.left: dict[int, list[tuple[int, int]]] = {i: [(i, _END)] for i in single}
        self.arcs: dict[bytes, int] = dict(self.base)
        for a, b, joined in merges:
            rank, target = self.rank[a, b]
            # the arc stands only if the merges lead from its own bytes to it, by this merge
            if target == joined and joined not in self.right and a in self.right and b in self.left and self._meets(a, b, rank):
                self.right[joined] = [(joined, _END), (b, rank), *self.right[b][1:]]
                self.left[joined] = [(joined, _END), (a, rank), *self.left[a][1:]]
                self.arcs[labels[joined]] = joined
        prefixes = {label[:i] for label in self.arcs for i in range(1, len(label))}
        self.more = prefixes
        self.table: dict[tuple[int, int], bool] = {}
        self.limit = limit
        #: The next shorter arc that reads a prefix of an arc's label.
        self.shorter = {}
        for label, token in self.arcs.items():
            self.shorter[token] = next((self.arcs[label[:i]] for i in range(len(label) - 1, 0, -1) if label[:i] in self.arcs), -1)

    def _meets(self, a: int, b: int, before: int) -> bool:
        """No gadget of a lower rank joins across the border of ``a`` and ``b``."""
        return all(
            rank >= before or not (rank < gone_a and rank <= gone_b)
            for part_a, gone_a in self.right[a]
            for part_b, gone_b in self.left[b]
            if (rank := self.rank.get((part_a, part_b), (_END,))[0]) < _END
        )

    def follows(self, state: int, token: int) -> bool:
        """Whether the transition table has an arc ``token`` out of ``state``."""
        known = self.table.get((state, token))
        if known is None:
            known = self._meets(state, token, _END)
            if len(self.table) > self.limit:
                self.table.clear()
            self.table[state, token] = known
        return known

    def longest(self, word: bytes, at: int) -> int:
        """The longest arc that reads on from ``at``."""
        arcs, more, size = self.arcs, self.more, len(word)
        found, to = -1, at + 1
        while True:
            piece = word[at:to]
            found = arcs.get(piece, found)
            if to == size or piece not in more:
                return found
            to += 1

    def path(self, word: bytes) -> list[int]:
        """The tokens of the one accepted path that spells ``word``.

        Longest arcs first; the state at a place is the same on every path to it, so a place that
        was left for want of an arc is never entered again.
        """
        size, labels, shorter = len(word), self.labels, self.shorter
        out: list[int] = []
        if not size:
            return out
        closed: set[int] = set()
        at, token = 0, self.longest(word, 0)
        while True:
            to = at + len(labels[token])
            if to not in closed and (not out or self.follows(out[-1], token)):
                out.append(token)
                at = to
                if at == size:
                    return out
                token = self.longest(word, at)
                continue
            token = shorter[token]
            while token < 0:
                closed.add(at)
                token = out.pop()
                at -= len(labels[token])
                token = shorter[token]


class Codec:
    """Encodes and decodes texts with one byte-level vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        symbols = byte_symbols()
        vocab = spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        labels = [b""] * (1 + max([*vocab.values(), *self.special.values()]))
        for token, i in vocab.items():
            labels[i] = bytes(symbols[c] for c in token)
        self._merges = [(vocab[a], vocab[b], vocab[a + b]) for a, b in (m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"])]
        self._spelled = list(labels)
        for token, i in self.special.items():
            labels[i] = token.encode()
        self.labels = labels
        self.split = regex.compile(PRE_SPLIT)
        self.marks = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.seen = Remembered(lambda pieces: [self.piece(p.decode()) for p in pieces])

    @cached_property
    def automaton(self) -> Automaton:
        """Compiled on first use: decoding needs the labels alone."""
        return Automaton(self._spelled, self._merges)

    def piece(self, piece: str) -> list[int]:
        """Ids of text that ends where the pre-split cuts."""
        path, out = self.automaton.path, []
        for word in self.split.findall(piece):
            out += path(word.encode())
        return out

    def encode(self, text: str) -> list[int]:
        parts = self.marks.split(text) if self.marks and any(m in text for m in self.special) else (text,)
        out: list[int] = []
        for i, part in enumerate(parts):
            out += [self.special[part]] if i % 2 else self.piece(part)
        return out

    def encode_column(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in order, offsets of the texts in them)."""
        data, ends = whole(column)
        rare = _rare_rows(data, ends, [m.encode() for m in self.special])
        pieces, per_row = _chunks(data, ends)
        ids, size = self.seen.of(pieces)
        offsets = np.append(0, np.cumsum(size))[np.append(0, np.cumsum(per_row))]
        if not len(rare):
            return ids, offsets
        parts, lengths = [], np.diff(offsets)
        at = 0
        for row in rare:
            parts += [ids[offsets[at] : offsets[row]], np.array(self.encode(column[int(row)].as_py()), np.int32)]
            lengths[row] = len(parts[-1])
            at = row + 1
        return np.concatenate([*parts, ids[offsets[at] :]]), np.append(0, np.cumsum(lengths))

    def decode(self, ids: np.ndarray) -> str:
        return b"".join(map(self.labels.__getitem__, ids.tolist())).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    """One compiled codec per worker process and file."""
    return Codec(path)


def _encoded(coder: Codec, batch: pa.RecordBatch, text: str) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
    """Slices of a batch with the ids of their texts."""
    column = batch.column(batch.schema.get_field_index(text))
    for a, b in row_slices(column):
        flat, ends = coder.encode_column(column.slice(a, b - a))
        yield batch.slice(a, b - a), pa.ListArray.from_arrays(ends.astype(np.int32), flat)


def _decoded(coder: Codec, column: pa.Array) -> pa.Array:
    column = column.fill_null([])
    flat, ends = column.flatten().to_numpy(), np.append(0, np.cumsum(column.value_lengths().to_numpy()))
    return pa.array([coder.decode(flat[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)], pa.string())


def _with(batch: pa.RecordBatch, **columns: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*batch.columns, *columns.values()], names=[*batch.schema.names, *columns])


def _ids_field(name: str) -> T.StructField:
    return T.StructField(name, T.ArrayType(T.IntegerType(), False))


def encode(docs: DataFrame, path: str, *, text: str = "text", ids: str = "ids") -> DataFrame:
    """``docs`` with an array of token ids; a null text is empty and has none. ``path`` is the
    vocabulary file, present on every machine. A column of that name is replaced."""
    own = docs.drop(ids)

    def run(batches):
        coder = codec(path)
        for batch in batches:
            for part, found in _encoded(coder, batch, text):
                yield _with(part, **{ids: found})

    return own.mapInArrow(run, T.StructType([*own.schema.fields, _ids_field(ids)]))


def decode(encoded: DataFrame, path: str, *, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """``encoded`` with the text its ids spell; null ids give an empty text."""
    own = encoded.drop(decoded)

    def run(batches):
        coder = codec(path)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                yield _with(part, **{decoded: _decoded(coder, part.column(part.schema.get_field_index(ids)))})

    return own.mapInArrow(run, T.StructType([*own.schema.fields, T.StructField(decoded, T.StringType())]))


def encode_decode(docs: DataFrame, path: str, *, text: str = "text", ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """Both directions in one pass: the ids of a slice are decoded where they were made."""
    own = docs.drop(ids, decoded)

    def run(batches):
        coder = codec(path)
        for batch in batches:
            for part, found in _encoded(coder, batch, text):
                for at in range(0, part.num_rows, ROWS):
                    some = found.slice(at, ROWS)
                    yield _with(part.slice(at, ROWS), **{ids: some, decoded: _decoded(coder, some)})

    fields = [*own.schema.fields, _ids_field(ids), T.StructField(decoded, T.StringType())]
    return own.mapInArrow(run, T.StructType(fields))
