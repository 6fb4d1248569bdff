"""Ranked lexical search over a length-stratified index.

A document's score depends on its length only by a whole number m, so documents with equal m form a
stratum in which a term's share of the score, its impact, is a function of the term's frequency
alone. The index keeps strata together (a range partitioning by m; a large stratum is spread over
several ranges) and, inside a stratum, the postings of a term by descending frequency: impacts are
computed once per frequency that occurs, and the first posting gives the term's bound. A search
visits the strata of a range in the order of their bounds and stops below the tenth best score.

Queries come in blocks whose terms fit a bound. A block needs one pass over the texts, which keeps
the postings of its terms only, and one over the postings.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowmill.llm.exchange import partitions
from flowmill.llm.text import LOWER, Words, arrow_bytes, slices, word_hashes
from flowmill.session import stage

#: A term is a run of ASCII letters and digits and of any characters beyond ASCII.
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
_ASCII_LOWER = {i: i + 32 for i in range(65, 91)}
_INSIDE = np.zeros(256, bool)
_INSIDE[128:] = True
for _a, _b in ("09", "AZ", "az"):
    _INSIDE[ord(_a) : ord(_b) + 1] = True

#: Most distinct terms and items of one block of queries.
BLOCK_TERMS, BLOCK_ITEMS = 200_000, 4096
#: Documents, postings and cells (strata times terms) that one search step holds.
STEP_DOCS, STEP_POSTINGS, STEP_CELLS = 1 << 16, 1 << 22, 1 << 21
_COUNTED = "kind int, doc long, slot long, n long, terms array<int>, tfs array<long>"


def terms_of(text: str | None) -> list[str]:
    return TERM.findall((text or "").translate(_ASCII_LOWER))


def split_terms(texts: list[bytes]) -> Words:
    """The terms of texts, A-Z in lower case."""
    data = LOWER[np.frombuffer(b"\n".join([*texts, b""]), np.uint8)]
    edge = np.diff(_INSIDE[data].view(np.int8), prepend=0, append=0)
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    offset = np.cumsum([0, *(len(t) + 1 for t in texts)])
    return Words(data, start, end, np.searchsorted(start, offset))


class Vocabulary:
    """Numbers of the terms that a block of queries asks for, by two 64-bit hashes."""

    def __init__(self, terms: list[str]):
        words = split_terms([t.encode() for t in terms])
        first, second = word_hashes(words), word_hashes(words, 1)
        self.number = np.argsort(first).astype(np.int32)
        self.first, self.second = first[self.number], second[self.number]

    def look_up(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """(place among the words, term) of every word that is asked for."""
        hashes = word_hashes(words)
        at = np.minimum(np.searchsorted(self.first, hashes), max(len(self.first) - 1, 0))
        place = np.flatnonzero(self.first[at] == hashes) if len(self.first) else np.zeros(0, np.int64)
        place = place[self.second[at[place]] == word_hashes(words, 1)[place]]
        return place, self.number[at[place]]


def _count(vocabulary: Vocabulary, size: int):
    """Per text its terms asked for and their frequencies (kind 0); per task the totals (kind 1)."""

    def run(batches):
        held, total, slot = 0, 0, 0
        df = np.zeros(size, np.int64)
        for batch in batches:
            texts = arrow_bytes(batch.column(1))
            for a, b in slices(texts):
                words = split_terms(texts[a:b])
                count = np.diff(words.first)
                place, term = vocabulary.look_up(words)
                keys, tf = np.unique(words.row[place].astype(np.int64) * size + term, return_counts=True)
                row, term = np.divmod(keys, max(size, 1))
                df += np.bincount(term, minlength=size)
                held += int((count > 0).sum())
                total += int(count.sum())
                offsets = pa.array(np.searchsorted(row, np.arange(b - a + 1)).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.zeros(b - a, np.int32)),
                        batch.column(0).slice(a, b - a),
                        pa.array(np.arange(slot, slot + b - a)),
                        pa.array(count.astype(np.int64)),
                        pa.ListArray.from_arrays(offsets, pa.array(term.astype(np.int32))),
                        pa.ListArray.from_arrays(offsets, pa.array(tf.astype(np.int64))),
                    ],
                    names=["kind", "doc", "slot", "n", "terms", "tfs"],
                )
                slot += b - a
        found = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([1], pa.int32()),
                pa.array([total], pa.int64()),
                pa.array([0], pa.int64()),
                pa.array([held], pa.int64()),
                pa.array([found.astype(np.int32)], pa.list_(pa.int32())),
                pa.array([df[found]], pa.list_(pa.int64())),
            ],
            names=["kind", "doc", "slot", "n", "terms", "tfs"],
        )

    return run


def weight(documents: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))


def normaliser(documents: int, total: int) -> Column:
    """m of a document with ``n`` terms."""
    return F.lit(100 - 75) + F.expr(f"(75 * n * {int(documents)}L) div {max(int(total), 1)}L")


def impact(tf, m):
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


class _Step:
    """Consecutive strata of one range with their postings by (stratum, term, descending tf)."""

    def __init__(self, m: np.ndarray, doc: np.ndarray, known: np.ndarray, length: np.ndarray, term: np.ndarray, tf: np.ndarray, weights: np.ndarray):
        size = len(weights)
        level, stratum = np.unique(m, return_inverse=True)
        self.doc, self.known, self.strata = doc, known, len(level)
        row = np.repeat(np.arange(len(doc)), length)
        of = stratum[row]
        order = np.lexsort((-tf, term, of))
        self.row = row[order]
        cell, tf = of[order] * size + term[order], tf[order]
        # one impact per frequency of a stratum
        pairs, which = np.unique(np.stack([of[order], tf]), axis=1, return_inverse=True)
        impacts = impact(pairs[1], level[pairs[0]])
        self.share = weights[term[order]] * impacts[which.reshape(-1)]
        cells, first = np.unique(cell, return_index=True)
        self.first = np.zeros(self.strata * size, np.int64)
        self.count = np.zeros(self.strata * size, np.int64)
        self.bound = np.zeros(self.strata * size, np.int64)
        self.first[cells] = first
        self.count[cells] = np.diff(np.append(first, len(cell)))
        self.bound[cells] = self.share[first]
        self.first, self.count, self.bound = (x.reshape(self.strata, size) for x in (self.first, self.count, self.bound))

    def search(self, terms: np.ndarray, repeats: np.ndarray, best: _Best) -> None:
        bounds = self.bound[:, terms] @ repeats
        order = np.argsort(-bounds, kind="stable")
        at, width = 0, 1
        while at < self.strata and bounds[order[at]] > 0 and bounds[order[at]] >= best.least():
            visit = order[at : at + width]
            visit = visit[(bounds[visit] > 0) & (bounds[visit] >= best.least())]
            first, count = (x[np.ix_(visit, terms)].ravel() for x in (self.first, self.count))
            ends = np.cumsum(count)
            posting = np.arange(ends[-1]) + np.repeat(first - ends + count, count)
            times = np.repeat(np.tile(repeats, len(visit)), count)
            rows, where = np.unique(self.row[posting], return_inverse=True)
            score = np.zeros(len(rows), np.int64)
            np.add.at(score, where, self.share[posting] * times)
            best.add(score, self.doc[rows], self.known[rows])
            at, width = at + width, 2 * width


class _Best:
    """The highest scores of one item so far; documents without an id come after equal scores."""

    def __init__(self, k: int):
        self.k = k
        self.score, self.doc, self.known = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)

    def least(self) -> int:
        """A score that a document must reach."""
        return int(self.score[-1]) if len(self.score) == self.k else 1

    def add(self, score: np.ndarray, doc: np.ndarray, known: np.ndarray) -> None:
        good = score >= self.least()
        score, doc, known = (np.concatenate(x) for x in ((self.score, score[good]), (self.doc, doc[good]), (self.known, known[good])))
        order = np.lexsort((doc, ~known, -score))[: self.k]
        self.score, self.doc, self.known = score[order], doc[order], known[order]


def _steps(batches, size: int) -> Iterator[pa.Table]:
    """Rows sorted by m, as many at once as one step may hold."""
    held: list[pa.RecordBatch] = []
    docs = postings = 0
    levels: set[int] = set()
    for batch in batches:
        for a in range(0, batch.num_rows, 4096):
            part = batch.slice(a, 4096)
            fresh = set(part.column(0).to_pylist())
            more = len(part.column(2).flatten())
            full = docs + part.num_rows > STEP_DOCS or postings + more > STEP_POSTINGS or len(levels | fresh) * size > STEP_CELLS
            if held and full:
                yield pa.Table.from_batches(held)
                held, docs, postings, levels = [], 0, 0, set()
            held.append(part)
            docs, postings, levels = docs + part.num_rows, postings + more, levels | fresh
    if held:
        yield pa.Table.from_batches(held)


def _search(items: list[tuple[int, np.ndarray, np.ndarray]], weights: np.ndarray, k: int):
    """The best ``k`` documents of one range per item, from rows (m, doc, terms, tfs) sorted by m."""

    def run(batches):
        best = {number: _Best(k) for number, _, _ in items}
        for table in _steps(batches, len(weights)):
            table = table.combine_chunks()
            m, doc, terms, tfs = (table.column(i).combine_chunks() for i in range(4))
            known = doc.is_valid().to_numpy(zero_copy_only=False)
            length = terms.value_lengths().fill_null(0).to_numpy()
            step = _Step(
                m.to_numpy(), doc.fill_null(0).to_numpy(), known, length, terms.flatten().to_numpy().astype(np.int64), tfs.flatten().to_numpy(), weights
            )
            for number, asked, repeats in items:
                step.search(asked, repeats, best[number])
        rows = [(number, int(s), int(d) if o else None) for number, b in best.items() for s, d, o in zip(b.score, b.doc, b.known, strict=True)]
        if rows:
            item, score, doc = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(item, pa.int64()), pa.array(score, pa.int64()), pa.array(doc, pa.int64())], names=["item", "score", "doc"])

    return run


def _blocks(items: DataFrame, key: str, text: str) -> Iterator[list[tuple]]:
    """(key, counts of terms) of items, as many as one block may hold; nothing else is brought over."""
    block: list[tuple] = []
    terms: set[str] = set()
    for row in items.select(key, text).toLocalIterator():
        counts = Counter(terms_of(row[1]))
        if block and (len(block) == BLOCK_ITEMS or len(terms | counts.keys()) > BLOCK_TERMS):
            yield block
            block, terms = [], set()
        if counts:
            block.append((row[0], counts))
            terms |= counts.keys()
    if block:
        yield block


def _search_block(docs: DataFrame, block: list[tuple], key: str, text: str, k: int) -> DataFrame:
    """(item, rank, doc, score), ``item`` being the place in the block."""
    spark = docs.sparkSession
    asked = sorted(set().union(*(counts for _, counts in block)))
    number = {t: i for i, t in enumerate(asked)}
    source = docs.select(F.col(key).cast("long"), F.col(text))
    counted = stage(source.mapInArrow(_count(Vocabulary(asked), len(asked)), _COUNTED), "postings")
    # what the tasks add up to: two numbers and one per term of the block
    totals = counted.where("kind = 1")
    held, total = totals.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("doc"), F.lit(0))).first()
    df = np.zeros(len(asked), np.int64)
    found = totals.select(F.explode(F.arrays_zip("terms", "tfs")).alias("x")).groupBy(F.col("x.terms").alias("t"))
    for row in found.agg(F.sum("x.tfs").alias("df")).toLocalIterator():
        df[row["t"]] = row["df"]
    weights = np.array([weight(held, int(x)) if x else 0 for x in df], np.int64)
    items = []
    for i, (_, counts) in enumerate(block):
        terms = np.array([number[t] for t in counts], np.int64)
        items.append((i, terms, np.array(list(counts.values()), np.int64)))
    index = counted.where("kind = 0 AND size(terms) > 0").select(normaliser(held, total).alias("m"), "doc", "terms", "tfs", "slot")
    count = partitions(spark)
    line = index.repartitionByRange(count, "m", "slot", "doc").sortWithinPartitions("m").select("m", "doc", "terms", "tfs")
    best = line.mapInArrow(_search(items, weights, k), "item long, score long, doc long")
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc"))
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("item", "rank", "doc", "score")


def rank_documents(docs: DataFrame, items: DataFrame, *, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", k: int = 10) -> DataFrame:
    """(item, rank, key, score): each item's ``k`` best documents with a score above 0, best first.

    A term's weight is ``floor(1000 ln((2N+2) / (2 df+1)))`` over the N documents with a term; its
    impact in a document with frequency tf is ``10^9 tf div (1000 tf + 8 m)``, where m is
    ``25 + 75 n N div L`` for a document of n terms and L terms in all. A score is the sum over the
    item's terms, repeats included. Equal scores go by ascending key, documents without a key last.

    Keys of documents are whole numbers. Null and empty texts have no terms: such documents are not
    counted, such items give no rows, nor do items none of whose terms occurs. Every row is a document
    and every row of ``items`` an item of its own, whether or not keys repeat. Other columns are ignored.
    """
    spark = docs.sparkSession
    schema = T.StructType([items.schema[item], T.StructField("rank", T.IntegerType()), T.StructField(key, T.LongType()), T.StructField("score", T.LongType())])
    out = spark.createDataFrame([], schema)
    for block in _blocks(items, item, item_text):
        ranked = _search_block(docs, block, key, text, k)
        names = spark.createDataFrame([(i, name) for i, (name, _) in enumerate(block)], T.StructType([T.StructField("item", T.LongType()), T.StructField("__name", items.schema[item].dataType)]))
        named = ranked.join(names, "item").select(F.col("__name").alias(item), "rank", F.col("doc").alias(key), "score")
        out = out.unionByName(named)
    return out
