"""Cost-balanced packing of token sequences.

Documents are packed per block of about ``block_tokens`` tokens inside a task, so packing needs no
shuffle. In a block, the sequences' capacities add up to exactly its tokens: full ones and, for the
rest, a few whose lengths are powers of two, which need no padding either. Documents go in by
descending length, each to the sequence of the lowest estimated cost (linear plus quadratic in the
lengths of its pieces, as attention stays within a document) that still has room for it; what fits
nowhere whole is cut and fills the cheapest sequences with room.
"""

from __future__ import annotations

import os
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from flowmill.llm.pieces import Remembered, binary_array, letter_edges, row_slices, whole
from flowmill.llm.text import _WHITE, LOWER

END_ID = 2


@lru_cache(maxsize=2)
def tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    loaded = Tokenizer.from_file(path)
    loaded.no_truncation()
    loaded.no_padding()
    return loaded


class Ids:
    """Ids of texts for a lower-case vocabulary that drops white space and ends words by a mark.

    Each run between blanks stands alone, and so do letters and punctuation in it.
    """

    def __init__(self, path: str):
        self.tokenizer = tokenizer(path)
        vocab = self.tokenizer.get_vocab(with_added_tokens=False)
        self.ends = np.zeros(1 + max(vocab.values()), bool)
        self.ends[[i for token, i in vocab.items() if token.endswith("</w>")]] = True
        self.seen = Remembered(self.encode)

    def encode(self, pieces: list[bytes]) -> list[list[int]]:
        texts = [p.decode() for p in pieces]
        out: list[list[int]] = [[]] * len(texts)
        # a piece of letters is one word: many are encoded as one text and parted at the word ends
        plain = [i for i, t in enumerate(texts) if t.isalpha()]
        other = [i for i, t in enumerate(texts) if not t.isalpha() and t.strip(" \t\n\v\f\r")]
        encode = self.tokenizer.encode_batch_fast
        for at in range(0, len(plain), 512):
            part = plain[at : at + 512]
            ids = np.array(encode([" ".join(texts[i] for i in part)], add_special_tokens=False)[0].ids, np.int64)
            last = np.flatnonzero(self.ends[ids]) + 1
            if len(last) != len(part):  # letters of which normal forms make something else
                other += part
                continue
            flat, start = ids.tolist(), 0
            for i, end in zip(part, last.tolist(), strict=True):
                out[i] = flat[start:end]
                start = end
        for at in range(0, len(other), 512):
            part = other[at : at + 512]
            for i, coded in zip(part, encode([texts[i] for i in part], add_special_tokens=False), strict=True):
                out[i] = coded.ids
        return out

    def of(self, column: pa.Array) -> list[np.ndarray]:
        """Ids of each text with the end id; a null is an empty text."""
        data, ends = whole(column)
        marked = data.tobytes().find(b"<|") >= 0
        if len(data):
            data = LOWER[data]
            white = _WHITE[data]
            cut = letter_edges(data)
            cut[1:-1] |= white[1:] != white[:-1]
            cut[ends] = cut[0] = cut[-1] = True
            cuts = np.flatnonzero(cut)
        else:
            cuts = np.zeros(1, np.int64)
        ids, size = self.seen.of(binary_array(data, cuts))
        offset = np.append(0, np.cumsum(size))[np.searchsorted(cuts, ends)]
        out = [np.append(ids[a:b], END_ID).astype(np.uint32) for a, b in zip(offset[:-1], offset[1:], strict=True)]
        if marked:  # special tokens are found in the text as it is
            for i, text in enumerate(column.to_pylist()):
                if text and "<|" in text:
                    out[i] = np.array([*self.tokenizer.encode(text, add_special_tokens=False).ids, END_ID], np.uint32)
        return out


def capacities(total: int, size: int) -> list[int]:
    """Lengths of the sequences of a block: full ones, then the powers of two that make up the rest."""
    rest = total % size
    return [size] * (total // size) + [1 << b for b in reversed(range(rest.bit_length())) if rest >> b & 1]


def pack_block(lengths: np.ndarray, size: int, linear: float, quadratic: float) -> list[tuple[int, int, int, int, int]]:
    """Pieces (document, start, length, sequence, offset) of documents of the given lengths."""
    room = np.array(capacities(int(lengths.sum()), size), np.int64)
    held = room.copy()
    cost = np.zeros(len(room))
    out: list[tuple[int, int, int, int, int]] = []

    def put(doc: int, start: int, length: int, to: int) -> None:
        out.append((doc, start, length, to, int(held[to] - room[to])))
        room[to] -= length
        cost[to] += linear * length + quadratic * length * length

    whole = int((room == size).sum())
    filled = 0
    rest: list[tuple[int, int, int]] = []
    for doc, length in enumerate(lengths.tolist()):
        start = 0
        while length - start >= size and filled < whole:  # as long as a sequence: one of its own
            put(doc, start, size, filled)
            filled, start = filled + 1, start + size
        if start < length:
            rest.append((length - start, doc, start))
    rest.sort(key=lambda x: (-x[0], x[1]))
    open_ = np.arange(filled, len(room))
    for length, doc, start in rest:
        fits = open_[room[open_] >= length]
        if len(fits):
            put(doc, start, length, int(fits[np.argmin(cost[fits])]))
        else:
            while length:
                left = open_[room[open_] > 0]
                to = int(left[np.argmin(cost[left])])
                take = min(length, int(room[to]))
                put(doc, start, take, to)
                start, length = start + take, length - take
        if len(open_) and len(out) % 64 == 0:
            open_ = open_[room[open_] > 0]
    return out


def pack(
    docs: DataFrame,
    path: str,
    *,
    key: str = "doc_id",
    text: str = "text",
    size: int = 4096,
    linear: float = 1.0,
    quadratic: float = 1 / 4096,
    block_tokens: int = 1 << 20,
) -> DataFrame:
    """One row per piece: key, start, length, doc_tokens, sequence_id, offset and its ids as
    little-endian unsigned 32-bit numbers.

    ``sequence_id`` is made of the task's partition and a running number, so it is unique and the
    same when a task is run again. A null or empty text is its end id alone; rows that repeat a key
    are packed like any other. ``size`` is a power of two. The key may be of any type and null.
    """
    own = docs.select(key, text)

    def run(batches):
        coder = Ids(path)
        first = TaskContext.get().partitionId() << 32
        keys, ids, tokens = [], [], 0
        for batch in batches:
            for a, b in row_slices(batch.column(1)):
                part = batch.slice(a, b - a)
                found = coder.of(part.column(1))
                for row, one in zip(part.column(0).to_pylist(), found, strict=True):
                    keys.append(row)
                    ids.append(one)
                    tokens += len(one)
                    if tokens >= block_tokens:
                        yield _block(key, keys, ids, batch.schema.field(0).type, first, size, linear, quadratic)
                        first += len(capacities(tokens, size))
                        keys, ids, tokens = [], [], 0
        if keys:
            yield _block(key, keys, ids, batch.schema.field(0).type, first, size, linear, quadratic)

    schema = T.StructType(
        [
            own.schema[key],
            *(T.StructField(n, T.LongType()) for n in ("start", "length", "doc_tokens", "sequence_id", "offset")),
            T.StructField("ids", T.BinaryType()),
        ]
    )
    return own.mapInArrow(run, schema)


def _block(name, keys, ids, kind, first, size, linear, quadratic) -> pa.RecordBatch:
    pieces = pack_block(np.array([len(x) for x in ids]), size, linear, quadratic)
    doc, start, length, sequence, offset = map(list, zip(*pieces, strict=True))
    return pa.RecordBatch.from_arrays(
        [
            pa.array([keys[d] for d in doc], kind),
            pa.array(start, pa.int64()),
            pa.array(length, pa.int64()),
            pa.array([len(ids[d]) for d in doc], pa.int64()),
            pa.array([first + s for s in sequence], pa.int64()),
            pa.array(offset, pa.int64()),
            pa.array([ids[d][s : s + n].astype("<u4").tobytes() for d, s, n in zip(doc, start, length, strict=True)], pa.binary()),
        ],
        names=[name, "start", "length", "doc_tokens", "sequence_id", "offset", "ids"],
    )
