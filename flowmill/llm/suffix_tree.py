"""Probabilistic suffix tree over the bytes of tokens.

A text is its words in lower case, one blank between them, and an end symbol. The tree holds
contexts of up to five preceding bytes. The top (contexts of up to two bytes, at most 65,792 of
them) is kept whole; a longer context is kept if its next-symbol distribution diverges from that of
the context without its first byte, the weighted divergence outweighing the cost of its parameters,
or if a still longer one that ends in it is kept. Distributions are smoothed towards the parent
context (Witten-Bell). A symbol is scored in the longest kept context that ends before it.

All six-byte strings of the corpus are counted. They are dealt by the two bytes before the symbol,
so each partition holds whole subtrees and prunes and scores them by itself; a bucket of documents
asks for the strings it holds and gets their probabilities back, and no tree is sent around.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowmill.llm.exchange import (
    ASK_SCHEMA,
    REPLY_SCHEMA,
    asks,
    by_owner,
    deal,
    ordered,
    pack,
    partitions,
    replies,
    texts_of,
    unpack,
)
from flowmill.llm.text import _WHITE, Words, arrow_bytes, slices, split_words, word_hashes

DEPTH = 5
#: Bytes that no UTF-8 text holds: before a text and at its end.
PAD, END = 0xFD, 0xFE
SYMBOLS = 256
_WORDS, _STRINGS, _STATS = 0, 1, 2
_GATHER = 1 << 19


def stream(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """The symbols of texts, each after ``DEPTH`` pads, and the row of each symbol."""
    inside = ~_WHITE[words.data]
    held = inside.copy()
    held[words.end] = True  # the first white space after a word
    rows = len(words.first) - 1
    at = np.flatnonzero(held)
    size = words.end - words.start + 1
    per_row = np.add.reduceat(np.append(size, 0), np.minimum(words.first[:-1], len(size))) if len(size) else np.zeros(rows, np.int64)
    per_row = np.where(np.diff(words.first) > 0, per_row, 1)
    begin = np.cumsum(per_row + DEPTH) - per_row
    out = np.full(int((per_row + DEPTH).sum()), PAD, np.uint8)
    row = np.repeat(np.arange(rows), per_row + DEPTH)
    full = np.diff(words.first) > 0
    symbol = np.zeros(len(out), bool)
    symbol[np.repeat(begin, per_row) + _ramp(per_row)] = True
    values = np.where(inside[at], words.data[at], 32)
    target = np.repeat(begin[full], per_row[full]) + _ramp(per_row[full])
    out[target] = values
    out[begin + per_row - 1] = END
    return out, np.where(symbol, row, -1)


def _ramp(lengths: np.ndarray) -> np.ndarray:
    ends = np.cumsum(lengths)
    return np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - lengths, lengths)


def strings(out: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each symbol with its predecessors as one number, and its row."""
    wide = out.astype(np.uint64)
    key = wide[DEPTH:].copy()
    for d in range(1, DEPTH + 1):
        key |= wide[DEPTH - d : len(wide) - d] << np.uint64(8 * d)
    at = row[DEPTH:] >= 0
    return key[at], row[DEPTH:][at]


def top_counts(docs: DataFrame, train: Column, text: str) -> tuple[np.ndarray, int, int]:
    """Counts of symbol pairs, words and texts of the training part.

    What reaches the driver is bounded by the alphabet: 65,536 pairs and two numbers.
    """

    def run(batches):
        total, words_, texts_ = np.zeros(1 << 16, np.int64), 0, 0
        for batch in batches:
            texts = arrow_bytes(batch.column(0))
            texts_ += len(texts)
            for a, b in slices(texts):
                words = split_words(texts[a:b], lower=True)
                words_ += len(words.start)
                out, row = stream(words)
                pair = (out[:-1].astype(np.int64) << 8 | out[1:])[row[1:] >= 0]
                total += np.bincount(pair, minlength=1 << 16)
        used = np.flatnonzero(total)
        pairs = np.concatenate([used, [-1, -2]])
        counts = np.concatenate([total[used], [words_, texts_]])
        yield pa.RecordBatch.from_arrays([pa.array(pairs), pa.array(counts)], names=["pair", "n"])

    counted = docs.where(train).select(text).mapInArrow(run, "pair long, n long")
    rows = counted.groupBy("pair").agg(F.sum("n").alias("n")).collect()
    pairs, words_, texts_ = np.zeros(1 << 16, np.int64), 0, 0
    for pair, n in rows:
        if pair >= 0:
            pairs[pair] = n
        elif pair == -1:
            words_ = n
        else:
            texts_ = n
    return pairs, words_, texts_


def _grouped(codes: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    unique, inverse = np.unique(codes, return_inverse=True)
    return unique, np.bincount(inverse, weights, len(unique))


def _questions(table: pa.Table, src: int, text: str, count: int) -> pa.Table:
    texts, train = texts_of(table, text), table.column("__train").to_numpy(zero_copy_only=False).astype(bool)
    found: dict[int, list] = {_WORDS: [], _STRINGS: []}
    for a, b in slices(texts):
        words = split_words(texts[a:b], lower=True)
        counts = train[a:b]
        for kind, values, rows in ((_WORDS, word_hashes(words), words.row), (_STRINGS, *strings(*stream(words)))):
            codes, unique = pd.factorize(values)
            parts = found[kind]
            parts.append((unique, np.bincount(codes, counts[rows], len(unique))))
            if sum(len(x) for x, _ in parts[1:]) > _GATHER:  # merge before much has gathered
                parts[:] = [_grouped(*map(np.concatenate, zip(*parts, strict=True)))]
    rows = []
    for kind, parts in found.items():
        if not parts:
            continue
        unique, times = _grouped(*map(np.concatenate, zip(*parts, strict=True)))
        spread = unique if kind == _WORDS else ((unique >> np.uint64(8)) & np.uint64(0xFFFF)) * np.uint64(0x9E3779B97F4A7C15)
        owner = ((spread >> np.uint64(32)) * np.uint64(count) >> np.uint64(32)).astype(np.int32)
        rows += [(dst, src, kind, pack(unique[i], times[i].astype(np.uint32))) for dst, i in enumerate(by_owner(owner, count)) if len(i)]
    return asks(rows)


def _parents(child: np.ndarray, depth: int, parents: np.ndarray) -> np.ndarray:
    return np.searchsorted(parents, child & np.uint64(256 ** (depth - 1) - 1))


def tree_scores(keys: np.ndarray, counts: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    """log10 probability of each distinct string's last symbol.

    ``keys`` are ascending and hold every string that shares the two bytes before its symbol.
    """
    symbol = (keys & np.uint64(255)).astype(np.int64)
    table = pairs.reshape(256, 256)
    root = table.sum(axis=0)
    p = ((root + 0.5) / (root.sum() + 0.5 * SYMBOLS))[symbol]
    before = (keys >> np.uint64(8) & np.uint64(255)).astype(np.int64)
    n, kinds = table.sum(axis=1)[before], (table > 0).sum(axis=1)[before]
    p = np.where(n > 0, (table[before, symbol] + kinds * p) / np.maximum(n + kinds, 1), p)
    levels = []
    for d in range(2, DEPTH + 1):
        joint, inverse = np.unique(keys & np.uint64(256 ** (d + 1) - 1), return_inverse=True)
        c = np.bincount(inverse, counts, len(joint))
        contexts, of = np.unique(joint >> np.uint64(8), return_inverse=True)
        total = np.bincount(of, c, len(contexts))
        types = np.bincount(of, c > 0, len(contexts))
        levels.append((d, joint, inverse, c, contexts, of, total, types))
    keep = {2: np.ones(len(levels[0][4]), bool)}
    for (_, joint_, _, c_, _, of_, total_, _), (d, joint, _, c, contexts, of, total, types) in zip(levels, levels[1:], strict=False):
        up = np.searchsorted(joint_, joint & np.uint64(256**d - 1))  # the same symbol after the shorter context
        seen = c > 0
        gain = np.zeros(len(joint))
        gain[seen] = c[seen] * np.log((c[seen] / total[of[seen]]) / (c_[up[seen]] / total_[of_[up[seen]]]))
        keep[d] = np.bincount(of, gain, len(contexts)) > 0.5 * types * np.log(np.maximum(total, 2))
    for d in range(DEPTH, 2, -1):  # what a kept context ends in is kept
        if d > 3:
            up = _parents(levels[d - 2][4][keep[d]], d, levels[d - 3][4])
            keep[d - 1][up] = True
    for d, _, inverse, c, _, of, total, types in levels:
        context = of[inverse]
        use = keep[d][context] & (total[context] > 0)
        p = np.where(use, (c[inverse] + types[context] * p) / np.maximum(total[context] + types[context], 1), p)
    return np.log10(p)


def _answers(pairs: np.ndarray):
    def run(batches):
        parts: dict[int, list] = {_WORDS: [], _STRINGS: []}
        for batch in batches:
            for src, kind, payload in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
                keys, times = unpack(payload)
                parts[kind].append((keys, times, src))
        for kind, found in parts.items():
            if not found:
                continue
            keys, times = (np.concatenate([x[i] for x in found]) for i in (0, 1))
            unique, inverse = np.unique(keys, return_inverse=True)
            total = np.bincount(inverse, times, len(unique))
            if kind == _WORDS:
                value = total.astype(np.int64)
                yield replies([(-1, _STATS, int((total > 0).sum()), b"")])
            else:
                value = tree_scores(unique, total, pairs)
            at = 0
            for part, _, src in found:
                yield replies([(src, kind, 0, pack(part, value[inverse[at : at + len(part)]]))])
                at += len(part)

    return run


def _merged(reply: pa.Table, kind: int) -> tuple[np.ndarray, np.ndarray]:
    found = [unpack(p) for k, p in zip(reply.column("kind").to_pylist(), reply.column("payload").to_pylist(), strict=True) if k == kind]
    if not found:
        return np.zeros(0, np.uint64), np.zeros(0)
    keys, values = map(np.concatenate, zip(*found, strict=True))
    order = np.argsort(keys)
    return keys[order], values[order]


_OUT = "n_tokens long, n_known long, base_sum double, score double"


def suffix_tree_scores(docs: DataFrame, train: Column, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Key, ``train``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score`` and ``score`` per row.

    ``train`` says which rows the counts come from (null: no). Tokens are the words and one end; the
    base model gives each its share of the training tokens, half a count added. A null text is
    empty and scores its end alone; without training rows all symbols are equally likely. Repeated
    rows count and score as often as they come; keys may be null.
    """
    spark = docs.sparkSession
    count = partitions(spark)
    marked = docs.select(F.col(key), F.col(text), F.coalesce(train, F.lit(False)).alias("__train"))
    pairs, n_words, n_texts = top_counts(marked, F.col("__train"), text)
    grouped = deal(marked, key, text).groupBy("__bucket")

    def ask(group, table):
        return _questions(ordered(table, key), group[0].as_py(), text, count)

    def score(group, table, reply):
        table = ordered(table, key)
        words_, seen = _merged(reply, _WORDS)
        strings_, value = _merged(reply, _STRINGS)
        tokens, known, base, total = [], [], [], []
        for a, b in slices(texts := texts_of(table, text)):
            words = split_words(texts[a:b], lower=True)
            row, rows = words.row, b - a
            codes, unique = pd.factorize(word_hashes(words))
            c = seen[np.searchsorted(words_, unique)][codes] if len(unique) else np.zeros(0)
            tokens.append(np.diff(words.first) + 1)
            known.append(np.bincount(row, c > 0, rows).astype(np.int64) + (n_texts > 0))
            base.append(np.bincount(row, np.log10(c + 0.5), rows) + np.log10(n_texts + 0.5))
            keys, at = strings(*stream(words))
            codes, unique = pd.factorize(keys)
            total.append(np.bincount(at, value[np.searchsorted(strings_, unique)][codes], rows))
        none = [np.zeros(0)]
        columns = [
            pa.array(np.concatenate(tokens or none).astype(np.int64)),
            pa.array(np.concatenate(known or none).astype(np.int64)),
            pa.array(np.concatenate(base or none)),
            pa.array(np.concatenate(total or none)),
        ]
        return pa.table([table.column(key), table.column("__train"), *columns], names=[key, "train", "n_tokens", "n_known", "base_sum", "score"])

    asked = grouped.applyInArrow(ask, ASK_SCHEMA)
    answered = asked.repartition(count, "dst").mapInArrow(_answers(pairs), REPLY_SCHEMA)
    kind = marked.schema[key].dataType.simpleString()
    scored = grouped.cogroup(answered.where("bucket >= 0").groupBy("bucket")).applyInArrow(score, f"`{key}` {kind}, train boolean, {_OUT}")
    distinct = answered.where("bucket < 0").agg(F.coalesce(F.sum("value"), F.lit(0)).alias("__v"))  # one row
    n_tokens = n_words + n_texts
    share = F.log10(F.lit(float(n_tokens)) + 0.5 * (F.col("__v") + (1 if n_texts else 0) + 1))
    return scored.crossJoin(distinct).select(
        key,
        "train",
        "n_tokens",
        "n_known",
        F.lit(n_tokens).cast("long").alias("train_tokens"),
        (F.col("base_sum") - F.col("n_tokens") * share).alias("base_score"),
        "score",
    )
