"""Documents dealt once into buckets, and questions between buckets as packed arrays.

Rows of a bucket are put in one order (key, then text hash), so a number counted along them means
the same row whenever the bucket is read again, by whichever executor. Questions about hashes go to
the partition that owns the hash and their answers go back to the bucket. A bucket asks once per
distinct hash, so a hash that a third of all rows share is one entry per bucket where it is judged.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ASK_SCHEMA = "dst int, src int, kind int, payload binary"
REPLY_SCHEMA = "bucket int, kind int, value long, payload binary"
_ASK = pa.schema([("dst", pa.int32()), ("src", pa.int32()), ("kind", pa.int32()), ("payload", pa.binary())])
_REPLY = pa.schema([("bucket", pa.int32()), ("kind", pa.int32()), ("value", pa.int64()), ("payload", pa.binary())])


def pack(*arrays: np.ndarray) -> bytes:
    head = np.array([len(arrays)] + [x for a in arrays for x in (ord(a.dtype.char), len(a))], np.int64)
    return zstandard.ZstdCompressor(level=1).compress(b"".join([head.tobytes(), *(np.ascontiguousarray(a).tobytes() for a in arrays)]))


def unpack(payload: bytes) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(payload)
    count = int(np.frombuffer(raw, np.int64, 1)[0])
    head = np.frombuffer(raw, np.int64, 2 * count, 8).tolist()
    out, at = [], 8 + 16 * count
    for kind, length in zip(head[::2], head[1::2], strict=True):
        dtype = np.dtype(chr(kind))
        out.append(np.frombuffer(raw, dtype, length, at))
        at += length * dtype.itemsize
    return out


def gaps(ascending: np.ndarray) -> np.ndarray:
    """Differences of ascending numbers, which pack far better; ``np.cumsum`` undoes it."""
    return np.diff(ascending, prepend=0).astype(np.uint32)


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def deal(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``docs`` with ``__bucket`` and ``__hash``, one exchange of the texts that all readers share."""
    count = partitions(docs.sparkSession)
    hashed = docs.withColumn("__hash", F.xxhash64(key, text))
    return hashed.withColumn("__bucket", F.pmod("__hash", F.lit(count)).cast("int")).repartition(count, "__bucket")


def ordered(table: pa.Table, key: str) -> pa.Table:
    return table.take(pc.sort_indices(table, [(key, "ascending"), ("__hash", "ascending")])).combine_chunks()


def texts_of(table: pa.Table, text: str) -> list[bytes]:
    return [x or b"" for x in table.column(text).cast(pa.binary()).to_pylist()]


def asks(rows: list[tuple[int, int, int, bytes]]) -> pa.Table:
    columns = list(zip(*rows, strict=True)) if rows else [[], [], [], []]
    return pa.table([pa.array(c, f.type) for c, f in zip(columns, _ASK, strict=True)], schema=_ASK)


def replies(rows: list[tuple[int, int, int, bytes]]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[], [], [], []]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _REPLY, strict=True)], schema=_REPLY)


def by_owner(owner: np.ndarray, count: int) -> list[np.ndarray]:
    """Indices per owner 0..count-1, in order."""
    order = np.argsort(owner, kind="stable")
    return np.split(order, np.searchsorted(owner[order], np.arange(1, count)))


def ask_repeats(src: int, hashes: np.ndarray, owner: np.ndarray, where: np.ndarray, count: int) -> pa.Table:
    """Questions "does this hash occur elsewhere?" of one bucket, ``where`` naming the places.

    Places whose hash the bucket itself holds twice are answered here (kind 1); of such a hash one
    marked entry is still sent, for the other buckets' sake.
    """
    order = np.lexsort((where, hashes))
    sorted_ = hashes[order]
    first = np.ones(len(order), bool)
    first[1:] = sorted_[1:] != sorted_[:-1]
    starts = np.flatnonzero(first)
    runs = np.diff(np.append(starts, len(order)))
    known = np.sort(where[order[np.repeat(runs > 1, runs)]])
    sent = order[starts]
    marked = runs > 1
    by_place = np.argsort(where[sent])
    sent, marked = sent[by_place], marked[by_place]
    rows = [
        (dst, src, 0, pack(hashes[sent[i]], gaps(where[sent[i]]), np.packbits(marked[i])))
        for dst, i in enumerate(by_owner(owner[sent], count))
        if len(i)
    ]
    if len(known):
        rows.append((src, src, 1, pack(gaps(known))))
    return asks(rows)


def answer_repeats(batches):
    """For ``mapInArrow`` over the owners' partitions: places whose hash some other entry shares."""
    hashes, where, marked, owner, dsts = [], [], [], [], []
    for batch in batches:
        known = []
        for dst, src, kind, payload in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if kind == 1:
                known.append((src, 0, 0, payload))
                continue
            h, w, m = unpack(payload)
            hashes.append(h)
            where.append(np.cumsum(w, dtype=np.int64))
            marked.append(np.unpackbits(m, count=len(h)).astype(bool))
            owner.append(np.full(len(h), src, np.int32))
            dsts.append(np.full(len(h), dst, np.int32))
        if known:
            yield replies(known)
    if not hashes:
        return
    h, w, m, o, d = map(np.concatenate, (hashes, where, marked, owner, dsts))
    order = np.lexsort((d, h))  # a hash belongs to its owner: the owner's number counts as more bits of it
    same = (h[order][1:] == h[order][:-1]) & (d[order][1:] == d[order][:-1])
    shared = np.zeros(len(h), bool)
    shared[order[1:][same]] = True
    shared[order[:-1][same]] = True
    shared &= ~m
    at = np.flatnonzero(shared)
    if not len(at):
        return
    at = at[np.lexsort((w[at], o[at]))]
    sources, first = np.unique(o[at], return_index=True)
    for src, part in zip(sources.tolist(), np.split(at, first[1:]), strict=True):
        yield replies([(src, 0, 0, pack(gaps(w[part])))])


def places(reply: pa.Table) -> np.ndarray:
    """All places that replies to a bucket name, ascending."""
    found = [np.cumsum(unpack(p)[0], dtype=np.int64) for p in reply.column("payload").to_pylist()]
    return np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
