"""Substring dedup by difference-cover anchors.

A difference cover of a period P is a set of residues such that any two places have an offset below
P that takes both to covered residues. Anchors, short runs of words, are hashed only at covered
places. Two equal windows of ``window`` words then always share an anchor at the same offset, if
the anchor has ``window - P + 1`` words; so every repeat is found from a fraction of the places.
Around each repeated anchor the whole windows are then compared, by a 64-bit hash plus the bits that
pick its owner among the partitions, and every word inside a repeated window goes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from flowmill.llm.exchange import (
    ASK_SCHEMA,
    REPLY_SCHEMA,
    answer_repeats,
    ask_repeats,
    asks,
    deal,
    ordered,
    partitions,
    places,
    texts_of,
)
from flowmill.llm.text import Words, run_hashes, slices, split_words, word_hashes

#: Perfect difference covers by period.
COVERS = {1: (0,), 3: (0, 1), 7: (0, 1, 3), 13: (0, 1, 3, 9), 21: (0, 1, 4, 14, 16), 31: (0, 1, 3, 8, 12, 18), 57: (0, 1, 3, 13, 32, 36, 43, 52)}


def period(window: int) -> int:
    """The longest period that leaves anchors of about half a window."""
    return max(p for p in COVERS if p == 1 or p <= 0.62 * window)


def _owner(words: Words, starts: np.ndarray, length: int, count: int) -> np.ndarray:
    second = run_hashes(word_hashes(words, 1), starts, length, 1)
    return ((second >> np.uint64(32)) * np.uint64(count) >> np.uint64(32)).astype(np.int32)


def _walk(table: pa.Table, text: str):
    """(rows, words, number of the first word) of each slice of a bucket's texts."""
    texts, base = texts_of(table, text), 0
    for a, b in slices(texts):
        words = split_words(texts[a:b])
        yield a, b, words, base
        base += len(words.start)


def _anchors(table, src, text, window, count):
    step = period(window)
    length = window - step + 1
    cover = np.zeros(step, bool)
    cover[list(COVERS[step])] = True
    hashes, owners, where = [], [], []
    for _, _, words, base in _walk(table, text):
        position = words.position
        size = np.repeat(np.diff(words.first), np.diff(words.first))
        at = np.flatnonzero(cover[position % step] & (position + length <= size) & (size >= window))
        hashes.append(run_hashes(word_hashes(words), at, length))
        owners.append(_owner(words, at, length, count))
        where.append(at + base)
    if not hashes:
        return asks([])
    return ask_repeats(src, *map(np.concatenate, (hashes, owners, where)), count)


def _inside(found: np.ndarray, base: int, size: int) -> np.ndarray:
    return found[np.searchsorted(found, base) : np.searchsorted(found, base + size)] - base


def _windows(table, src, text, anchors, window, count):
    """Whole windows around repeated anchors."""
    reach = period(window) - 1
    hashes, owners, where = [], [], []
    for _, _, words, base in _walk(table, text):
        at = _inside(anchors, base, len(words.start))
        if not len(at):
            continue
        row = words.row[at]
        low = np.maximum(at - reach, words.first[row])
        high = np.minimum(at, words.first[row + 1] - window)
        held = low <= high
        change = np.zeros(len(words.start) + 1, np.int32)
        np.add.at(change, low[held], 1)
        np.add.at(change, high[held] + 1, -1)
        starts = np.flatnonzero(np.cumsum(change[:-1]) > 0)
        hashes.append(run_hashes(word_hashes(words), starts, window))
        owners.append(_owner(words, starts, window, count))
        where.append(starts + base)
    if not hashes:
        return asks([])
    return ask_repeats(src, *map(np.concatenate, (hashes, owners, where)), count)


def _remove(table: pa.Table, text: str, starts: np.ndarray, window: int) -> tuple[list, list[int], list[int]]:
    kept = table.column(text).to_pylist()
    n_words, n_removed = [], []
    for a, b, words, base in _walk(table, text):
        size = len(words.start)
        at = _inside(starts, base, size)
        change = np.zeros(size + window + 1, np.int32)
        np.add.at(change, at, 1)
        np.add.at(change, at + window, -1)
        gone = np.cumsum(change)[:size] > 0
        total = np.append(0, np.cumsum(gone))
        lost = total[words.first[1:]] - total[words.first[:-1]]
        n_words += np.diff(words.first).tolist()
        n_removed += lost.tolist()
        for row in np.flatnonzero(lost).tolist():
            # a word goes with the white space that follows it
            first, last = words.first[row], words.first[row + 1]
            flags = gone[first:last]
            edge = np.diff(flags.astype(np.int8), prepend=0, append=0)
            begin, end = np.flatnonzero(edge == 1) + first, np.flatnonzero(edge == -1) + first
            text_of, at_byte = [], 0
            raw = (kept[a + row] or "").encode()
            offset = int(words.start[first]) - (len(raw) - len(raw.lstrip(b" \t\n\x0b\x0c\r")))
            for i, j in zip(begin.tolist(), end.tolist(), strict=True):
                text_of.append(raw[at_byte : int(words.start[i]) - offset])
                at_byte = int(words.start[j]) - offset if j < last else len(raw)
            text_of.append(raw[at_byte:])
            kept[a + row] = b"".join(text_of).decode()
    return kept, n_words, n_removed


def substring_dedup(docs: DataFrame, *, key: str = "doc_id", text: str = "text", window: int = 35) -> DataFrame:
    """``docs`` without repeated passages, plus ``n_words`` and ``n_removed`` (words).

    A word goes if it lies in a window of ``window`` words whose words also start anywhere else,
    in the same text or another, in the texts as they came. What is kept stays as it is, white space
    included. Null texts stay null and count no words; texts shorter than a window are untouched.
    Each row is a text of its own: rows that repeat a key and text lose their windows to each other.
    Null keys are allowed. Columns ``n_words`` and ``n_removed`` of the input are replaced.
    """
    count = partitions(docs.sparkSession)
    own = docs.drop("n_words", "n_removed")
    dealt = deal(own, key, text)

    def anchors(group, table):
        return _anchors(ordered(table, key), group[0].as_py(), text, window, count)

    def windows(group, table, reply):
        return _windows(ordered(table, key), group[0].as_py(), text, places(reply), window, count)

    names = own.columns

    def remove(group, table, reply):
        table = ordered(table, key)
        kept, n_words, n_removed = _remove(table, text, places(reply), window)
        columns = [pa.array(kept, pa.string()) if n == text else table.column(n) for n in names]
        return pa.table([*columns, pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64())], names=[*names, "n_words", "n_removed"])

    grouped = dealt.groupBy("__bucket")

    def answered(asked: DataFrame):
        return asked.repartition(count, "dst").mapInArrow(answer_repeats, REPLY_SCHEMA).groupBy("bucket")

    found = answered(grouped.applyInArrow(anchors, ASK_SCHEMA))
    confirmed = answered(grouped.cogroup(found).applyInArrow(windows, ASK_SCHEMA))
    schema = T.StructType([*own.schema.fields, T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType())])
    return grouped.cogroup(confirmed).applyInArrow(remove, schema)
