"""Fill-in-the-middle examples, cut at lines found from memoized content-defined chunks.

A rolling hash cuts a text into chunks whose ends depend on their content alone, so passages that
texts share become equal chunks wherever they stand. What a chunk adds to a text (lines, code points,
places of its line ends, whether a control string is inside) is worked out once and kept under the
chunk's own bytes; a hit is a comparison of the bytes, not of hashes. Summaries add up: running sums
of lines find the chunk that holds a cut, its line ends the place in it, and the bytes on both sides
of a boundary tell whether a control string lies across.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowmill.llm.text import arrow_bytes, slices

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
_MARKS = tuple(m.encode() for m in (PREFIX, SUFFIX, MIDDLE))
#: Bytes that the rolling hash sees, bits that must be zero at an end (chunks of about 1 KB) and the
#: least and most bytes of a chunk.
WINDOW, BITS = 32, 10
LEAST, MOST = 128, 8192
#: Bytes of chunks that a task remembers; a full memory is emptied.
MEMORY = 32 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BYTES = np.random.Generator(np.random.PCG64(13)).integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def boundaries(data: np.ndarray) -> np.ndarray:
    """Ends of chunks by content: places where the hash of the last bytes has zeros on top."""
    if len(data) <= WINDOW:
        return np.zeros(0, np.int64)
    rolled, width = _BYTES[data], 1
    while width < WINDOW:  # the hash of twice the bytes from two of half as many
        power = np.uint64(pow(int(_BASE), width, 1 << 64))
        rolled, width = rolled[:-width] * power + rolled[width:], 2 * width
    return np.flatnonzero(rolled >> np.uint64(64 - BITS) == 0) + WINDOW


def cut(text: bytes, ends: np.ndarray) -> list[bytes]:
    """The chunks of one text: content-defined ends, none closer than ``LEAST`` or farther than ``MOST``."""
    out, at = [], 0
    for end in [*ends.tolist(), len(text)]:
        while end - at > MOST:
            out.append(text[at : at + MOST])
            at += MOST
        if end - at >= LEAST or (end == len(text) and end > at):
            out.append(text[at:end])
            at = end
    return out


@dataclass(frozen=True)
class Summary:
    """What a chunk adds to a text that holds it."""

    size: int
    points: int
    line_ends: np.ndarray  # places after each line end
    marked: bool
    head: bytes
    tail: bytes


def points(text: bytes) -> int:
    """Code points that begin in a piece of UTF-8, which may begin or end inside one."""
    return int(np.count_nonzero((np.frombuffer(text, np.uint8) & 0xC0) != 0x80))


def summarize(chunk: bytes) -> Summary:
    data = np.frombuffer(chunk, np.uint8)
    return Summary(len(chunk), points(chunk), np.flatnonzero(data == 10).astype(np.int32) + 1, any(m in chunk for m in _MARKS), chunk[:2], chunk[-2:])


class Memory:
    """Summaries by content."""

    def __init__(self, limit: int = MEMORY):
        self.known: dict[bytes, Summary] = {}
        self.limit, self.held, self.hits = limit, 0, 0

    def of(self, chunk: bytes) -> Summary:
        found = self.known.get(chunk)
        if found is not None:
            self.hits += 1
            return found
        found = summarize(chunk)
        cost = 2 * len(chunk) + 200
        if self.held + cost > self.limit:
            self.known, self.held = {}, 0
        self.known[chunk] = found
        self.held += cost
        return found


class Text:
    """A text as the sum of its chunks."""

    def __init__(self, chunks: list[bytes], memory: Memory):
        self.parts = [memory.of(c) for c in chunks]
        self.starts = np.cumsum([0, *(p.size for p in self.parts)])
        self.lines = np.cumsum([0, *(len(p.line_ends) for p in self.parts)])
        self.size = int(self.starts[-1])
        ended = int(self.lines[-1])
        #: A rest without a line end is a line too.
        self.n = ended + int(self.size > 0 and (ended == 0 or self._after(ended) < self.size))

    def _after(self, lines: int) -> int:
        """The place after that many line ends, one at least."""
        chunk = int(np.searchsorted(self.lines, lines)) - 1
        return int(self.starts[chunk] + self.parts[chunk].line_ends[lines - self.lines[chunk] - 1])

    def place(self, lines: int) -> int:
        """The byte where the line with that number begins."""
        if lines == 0:
            return 0
        return self._after(lines) if lines <= self.lines[-1] else self.size

    def marked(self) -> bool:
        """Whether a control string stands in the text, across chunks included."""
        left = b""
        for part in self.parts:
            if part.marked or any(m in left + part.head for m in _MARKS):
                return True
            left = (left + part.tail)[-2:] if part.size < 2 else part.tail
        return False

    def points(self, text: bytes, a: int, b: int) -> int:
        """Code points between two places; whole chunks are not looked at again."""
        first, last = int(np.searchsorted(self.starts, a)), int(np.searchsorted(self.starts, b, side="right")) - 1
        if first > last:
            return points(text[a:b])
        inner = sum(p.points for p in self.parts[first:last])
        return inner + points(text[a : int(self.starts[first])]) + points(text[int(self.starts[last]) : b])


def _transform(rate: int, spm: int):
    def run(batches):
        memory = Memory()
        for batch in batches:
            h = [batch.column(i).to_pylist() for i in range(1, 5)]
            texts = arrow_bytes(batch.column(0))
            for a, b in slices(texts):
                data = np.frombuffer(b"".join(texts[a:b]), np.uint8)
                ends, starts = boundaries(data), np.cumsum([0, *(len(t) for t in texts[a:b])])
                rows: list[tuple] = []
                for i in range(a, b):
                    text, begin = texts[i], int(starts[i - a])
                    # an end counts only if the hash saw this text alone
                    own = ends[np.searchsorted(ends, begin + WINDOW) : np.searchsorted(ends, begin + len(text))] - begin
                    whole = Text(cut(text, own), memory)
                    h1, h2, h3, h4 = (x[i] for x in h)
                    if not text or whole.marked() or h3 % 100 >= rate:
                        rows.append((whole.n, "plain", None, None, text))
                        continue
                    x, y = sorted((h1 % (whole.n + 1), h2 % (whole.n + 1)))
                    p, q = whole.place(x), whole.place(y)
                    pre, mid, suf = text[:p], text[p:q], text[q:]
                    form = "spm" if h4 % 100 < spm else "psm"
                    order = (_MARKS[1], suf, _MARKS[0], pre) if form == "spm" else (_MARKS[0], pre, _MARKS[1], suf)
                    rows.append((whole.n, form, whole.points(text, 0, p), whole.points(text, p, q), b"".join([*order, _MARKS[2], mid])))
                n, form, prefix, middle, output = zip(*rows, strict=True)
                kept = [batch.column(j).slice(a, b - a) for j in range(5, batch.num_columns)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(n, pa.int64()), pa.array(form), pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()),
                        pa.array(output, pa.binary()).view(pa.string()), *kept,
                    ],
                    names=["n", "form", "prefix_chars", "middle_chars", "output", *batch.schema.names[5:]],
                )

    return run


def fill_in_middle(docs: DataFrame, *, key: str = "doc_id", text: str = "text", seed: int = 7, rate: int = 100, spm: int = 50) -> DataFrame:
    """``docs`` with ``n`` (lines), ``form``, ``prefix_chars``, ``middle_chars`` and ``output``.

    The text is cut after two numbers of lines, from 0 to all, drawn by a hash of seed and key, into
    prefix, middle and suffix; ``form`` is ``psm``, ``spm`` (``spm`` of 100) or ``plain``. Plain are
    empty and null texts, those with a control string in them and all but ``rate`` of 100 others: their
    output is the text, an empty one for a null, and their counts of characters are null.

    Rows do not depend on each other: repeated rows give equal output, a null key is drawn as an
    empty one. Columns of the input that are named like an added one are replaced; if key or text are
    named so, they stay and the added column begins with two underscores.
    """
    added = ["n", "form", "prefix_chars", "middle_chars", "output"]
    kept = [c for c in docs.columns if c not in added or c in (key, text)]
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit(""))), 256)
    draws = [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long").alias(f"h{i}") for i in range(4)]
    # columns go by number inside, so no name clashes
    inputs = docs.select(F.col(f"`{text}`").alias("text"), *draws, *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(kept)])
    kinds = [T.LongType(), T.StringType(), T.LongType(), T.LongType(), T.StringType()]
    fields = [T.StructField(c, k) for c, k in zip(added, kinds, strict=True)]
    fields += [T.StructField(f"c{i}", docs.schema[c].dataType) for i, c in enumerate(kept)]
    out = inputs.mapInArrow(_transform(rate, spm), T.StructType(fields))
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(kept)], *[F.col(c).alias(f"__{c}" if c in kept else c) for c in added])


def restore(output: Column, form: Column) -> Column:
    """The text that an output of a form was made from."""

    def after(value: Column, mark: str) -> Column:
        return F.substr(value, F.locate(mark, value) + len(mark))

    def before(value: Column, mark: str) -> Column:
        return F.substring_index(value, mark, 1)

    body = F.substr(output, F.lit(4))
    psm = F.concat(before(body, SUFFIX), after(body, MIDDLE), before(after(body, SUFFIX), MIDDLE))
    spm = F.concat(before(after(body, PREFIX), MIDDLE), after(body, MIDDLE), before(body, PREFIX))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)
