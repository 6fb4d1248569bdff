"""Quality classifier: supervised subword embeddings.

A document is the average of learned vectors of its words and of the byte n-grams inside and at
the edges of its words, all hashed into a fixed number of buckets; a softmax over two classes sits
on top. It is trained by plain stochastic gradient descent in numpy on a bounded sample of the
labelled rows, whole texts. As averaging and the last layer are linear, scoring needs one number
per bucket, and is one pass over the documents without a shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowmill.llm.text import _WHITE, Words, arrow_bytes, mix, slices, split_words, word_hashes

LOG_BUCKETS = 17  # for words, and as many again for n-grams
GRAMS = (1, 2, 3, 4)
#: Counted beside a text's own features, with a vector of zeros: a few words alone decide little.
SHRINK = 60


def _gram_buckets(data: np.ndarray, n: int, white: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of the n-gram at each byte, and which stand: no white space within, not all white."""
    size = len(data) - n + 1
    if size <= 0:
        return np.zeros(0, np.int64), np.zeros(0, bool)
    value = np.full(size, n * 0x51ED270B & 0xFFFFFFFF, np.uint32)
    for j in range(n):
        value = (value ^ data[j : j + size]) * np.uint32(0x01000193)
        value ^= value >> np.uint32(15)
    whole = ~white[:size] if n == 1 else ~(white[:size] & white[n - 1 :])
    for j in range(1, n - 1):
        whole &= ~white[j : j + size]
    value *= np.uint32(0x9E3779B1)
    return (value >> np.uint32(32 - LOG_BUCKETS)).astype(np.int64) + (1 << LOG_BUCKETS), whole


def _word_buckets(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of words, of each word with the next one, and which pairs lie in one text.

    A pair is hashed by the difference of its bits, so that all pairs of equal words share a bucket.
    """
    hashes = word_hashes(words)
    row = words.row
    top = np.uint64(64 - LOG_BUCKETS)
    pair = mix(hashes[:-1] ^ hashes[1:]) >> top
    return (hashes >> top).astype(np.int64), pair.astype(np.int64), row[:-1] == row[1:]


def features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of every word and n-gram of the texts, each text ending in white space."""
    words = split_words(texts)
    bucket, pair, paired = _word_buckets(words)
    rows, buckets = [words.row, words.row[:-1][paired]], [bucket, pair[paired]]
    white = _WHITE[words.data]
    plain = np.where(white, np.uint8(32), words.data)
    ends = np.cumsum([len(t) + 1 for t in texts])
    for n in GRAMS:
        bucket, whole = _gram_buckets(plain, n, white)
        at = np.flatnonzero(whole)
        rows.append(np.searchsorted(ends, at, side="right"))
        buckets.append(bucket[at])
    return np.concatenate(rows), np.concatenate(buckets)


@dataclass
class Model:
    """Score per bucket and bias: the difference of the two classes' outputs."""

    weight: np.ndarray
    bias: float

    def logits(self, texts: list[bytes]) -> np.ndarray:
        out = np.full(len(texts), self.bias)
        for a, b in slices(texts):
            words = split_words(texts[a:b])
            bucket, pair, paired = _word_buckets(words)
            row = words.row
            total = np.bincount(row, self.weight[bucket], b - a)
            total += np.bincount(row[:-1][paired], self.weight[pair[paired]], b - a)
            count = np.bincount(row, minlength=b - a) + np.bincount(row[:-1][paired], minlength=b - a).astype(float)
            white = _WHITE[words.data]
            plain = np.where(white, np.uint8(32), words.data)
            start = np.cumsum([0, *(len(t) + 1 for t in texts[a : b - 1])])
            for n in GRAMS:
                bucket, whole = _gram_buckets(plain, n, white)
                if len(bucket):
                    value = np.zeros(len(plain))
                    held = np.zeros(len(plain))
                    value[: len(bucket)] = np.where(whole, self.weight[bucket], 0)
                    held[: len(bucket)] = whole
                    total += np.add.reduceat(value, start)
                    count += np.add.reduceat(held, start)
            out[a:b] += total / (count + SHRINK)
        return out


def train(texts: list[bytes], labels: np.ndarray, weights: np.ndarray, *, dim: int = 16, epochs: int = 6, least_steps: int = 8000, rate: float = 0.6, seed: int = 7) -> Model:
    """Fit bucket vectors and the two output vectors; the order of rows is fixed by the seed.

    Few rows are gone through more often, until there were ``least_steps`` steps.
    """
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1, 1, (2 << LOG_BUCKETS, dim)).astype(np.float32) / dim
    output = np.zeros((2, dim), np.float32)
    bias = np.zeros(2, np.float32)
    sparse = []
    for text in texts:
        _, bucket = features([text])
        used, times = np.unique(bucket, return_counts=True)
        sparse.append((used.astype(np.int32), (times / (times.sum() + SHRINK)).astype(np.float32)))
    epochs = max(epochs, -(-least_steps // len(texts)))
    steps, done = epochs * len(texts), 0
    for _ in range(epochs):
        for i in rng.permutation(len(texts)):
            used, share = sparse[i]
            mean = share @ vectors[used] if len(used) else np.zeros(dim, np.float32)
            raw = output @ mean + bias
            p = np.exp(raw - raw.max())
            p /= p.sum()
            p[int(labels[i])] -= 1
            step = np.float32(rate * (1 - done / steps) * weights[i])
            back = p @ output
            output -= step * np.outer(p, mean)
            bias -= step * p
            if len(used):
                # a bucket's vector moves by its share of the average; rare buckets need a larger step
                vectors[used] -= (step * 50 * share)[:, None] * back[None, :]
            done += 1
    return Model(vectors @ (output[1] - output[0]), float(bias[1] - bias[0]))


def fit(docs: DataFrame, labels: DataFrame, usable: Column, *, key: str = "doc_id", text: str = "text", max_rows: int = 4000) -> Model:
    """Train on at most ``max_rows`` labelled documents for which ``usable`` holds.

    Half of the bound is for each class, picked by the hash of the key, so the sample is repeatable
    and needs no sort of the table; each class weighs as much as it has labelled rows. Rows without
    a label, text or key are not used; of rows that share a key the one with the smallest text hash
    is, so the bound holds for rows too. Without any labelled row of a class every score is that of
    the class prior.
    """
    marked = labels.where(F.col("quality").isNotNull() & F.col(key).isNotNull()).groupBy(key).agg(F.min("quality").cast("int").alias("quality"))
    rows = docs.select(F.col(key), F.col(text).alias("text")).where(F.col(key).isNotNull() & F.col("text").isNotNull() & usable)
    chosen, sizes = [], []
    keyed = marked.where(usable)
    for label in (0, 1):
        one = keyed.where(F.col("quality") == label)
        ids = one.orderBy(F.xxhash64(key), key).limit(max_rows // 2)
        chosen.append(ids)
        sizes.append(one.count())
    labelled = rows.join(chosen[0].unionByName(chosen[1]), key)
    one_each = labelled.groupBy(key).agg(F.min_by(F.struct("text", "quality"), F.struct(F.xxhash64("text"), "text")).alias("row"))
    picked = one_each.select(key, "row.text", "row.quality").toPandas()
    picked = picked.sort_values(key).reset_index(drop=True)
    labels_ = picked["quality"].to_numpy(int) if len(picked) else np.zeros(0, int)
    if len(set(labels_)) < 2:
        share = (sizes[1] + 0.5) / (sum(sizes) + 1)
        return Model(np.zeros(2 << LOG_BUCKETS, np.float32), float(np.log(share / (1 - share))))
    have = np.bincount(labels_, minlength=2)
    weight = np.array(sizes) / sum(sizes) * len(labels_) / have
    return train([t.encode() for t in picked["text"]], labels_, weight[labels_])


def score(docs: DataFrame, model: Model, *, text: str = "text") -> DataFrame:
    """``docs`` with ``score``, the probability of the good class; other columns are untouched.

    A null or empty text has no vectors and gets the score of the bias. An existing ``score`` column
    is replaced.
    """
    own = docs.drop("score")
    weight, bias = model.weight, model.bias

    def run(batches):
        fitted = Model(weight, bias)
        for batch in batches:
            logit = fitted.logits(arrow_bytes(batch.column(batch.schema.get_field_index(text))))
            value = 1 / (1 + np.exp(-np.clip(logit, -700, 700)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(value)], names=[*batch.schema.names, "score"])

    schema = T.StructType([*own.schema.fields, T.StructField("score", T.DoubleType())])
    return own.mapInArrow(run, schema)
