"""WARC archives, written and read back in parallel.

An archive can be read from the middle only by looking for the words that begin a record, and a
payload may hold the same words. So each task emits candidates: every place with the magic, and
where its record would end by its own header, which is where its successor would begin. Only what
a chain of successors from the start of the file reaches is a record. Inside the stretch of a file
that a task reads, chains are contracted to where they leave it; between stretches pointer jumping
from the start of the file finds the entry of each stretch, in as many rounds as the number of
stretches has binary digits. Magic inside a payload is on no such chain.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from flowmill.llm.text import arrow_bytes
from flowmill.session import scratch_path, stage

MAGIC = "WARC/1."
#: Lines are cut where the magic begins a line; this text has no border, so no match hides another.
_CUT = "\n" + MAGIC
_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_IDENTICAL = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_URN = "urn:record:"


def base32_sha1(payload: Column) -> Column:
    """The SHA-1 of a text or of bytes in upper-case base32, 32 characters."""

    def spelled(digest: Column) -> Column:
        # Spark's digits of base 32 are 0-9 and A-V; five hex digits are four of them
        groups = [F.lpad(F.conv(F.substring(digest, at, n), 16, 32), n * 4 // 5, "0") for at, n in ((1, 15), (16, 15), (31, 10))]
        return F.translate(F.concat(*groups), "0123456789ABCDEFGHIJKLMNOPQRSTUV", _BASE32)

    # bound once: a branch of a conditional works out each mention of a digest anew
    return F.transform(F.array(F.sha1(payload)), spelled)[0]


def assign_roles(pages: DataFrame, *, key: str = "page_id", url: str = "url", payload: str = "html", least_bytes: int = 0) -> DataFrame:
    """(key, url, payload, bytes, digest, refers) per page; ``refers`` is null for a response.

    Of rows with equal payloads of at least ``least_bytes`` bytes the one with the largest key is the
    response and the others refer to it; rows that share that key are all responses, and so are rows
    of a payload that comes without any key.
    """
    rows = pages.select(F.col(key).alias("key"), F.col(url).alias("url"), F.coalesce(F.col(payload), F.lit("")).alias("payload"))
    rows = rows.withColumns({"bytes": F.octet_length("payload").cast("long"), "digest": base32_sha1(F.col("payload")), "check": F.xxhash64("payload")})
    # equal payloads combine before they meet, and a payload that occurs once has no row here
    same = ["digest", "bytes", "check"]
    largest = rows.where(F.col("bytes") >= least_bytes).groupBy(*same).agg(F.max("key").alias("largest"), F.count(F.lit(1)).alias("n"))
    largest = stage(largest.where("n > 1 AND largest IS NOT NULL").drop("n"), "responses")
    marked = rows.join(largest, same, "left")
    return marked.withColumn("refers", F.when(~F.col("key").eqNullSafe(F.col("largest")), F.col("largest"))).drop("largest", "check")


def _line(name: str, value: Column) -> Column:
    """A header line; nothing where the value is null."""
    return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit(""))


def _urn(key: Column) -> Column:
    return F.concat(F.lit(f"<{_URN}"), F.coalesce(F.url_encode(key.cast("string")), F.lit("")), F.lit(">"))


def key_of(record_id: Column) -> Column:
    """The key that a record id names, as text; null where it names none."""
    return F.url_decode(F.nullif(F.regexp_extract(record_id, f"^<{_URN}(.*)>$", 1), F.lit("")))


def records(pages: DataFrame, *, date: str = "1970-01-01T00:00:00Z", **columns) -> DataFrame:
    """(record): the text of one WARC record per page, less the two line ends that close it."""
    marked = assign_roles(pages, **columns)
    revisit = F.col("refers").isNotNull()
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("bytes").cast("string"), F.lit("\r\n\r\n"))
    address = F.col("url")
    for plain, escaped in (("\r", "%0D"), ("\n", "%0A"), ("\t", "%09"), (" ", "%20")):
        address = F.replace(address, F.lit(plain), F.lit(escaped))
    marked = marked.withColumn("block", F.concat(http, F.when(revisit, "").otherwise(F.col("payload"))))
    head = F.concat(
        F.lit("WARC/1.1\r\n"),
        _line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        _line("WARC-Record-ID", _urn(F.col("key"))),
        _line("WARC-Date", F.lit(date)),
        _line("WARC-Target-URI", address),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "digest")),
        _line("WARC-Profile", F.when(revisit, _IDENTICAL)),
        _line("WARC-Refers-To", F.when(revisit, _urn(F.col("refers")))),
        F.lit("Content-Type: application/http; msgtype=response\r\n"),
        _line("Content-Length", F.octet_length("block").cast("string")),
        F.lit("\r\n"),
    )
    return marked.select(F.concat(head, "block").alias("record"))


def write_archives(pages: DataFrame, path: str, **options) -> None:
    """One archive per task below ``path``, through Spark's own file writer.

    Null payloads are written as empty ones; a null url leaves its header line out, and a null key
    gives an empty record id. Columns other than key, url and payload are not written.
    """
    records(pages, **options).write.option("lineSep", "\r\n\r\n").text(path)


_LINES = """file string, block long, rel long, size long, first boolean, head long, length long, pre int, post int, leaves long,
 fields map<string,string>, body binary"""


def _head(line: bytes) -> tuple[int, int, dict[str, str]] | None:
    """(bytes of the head, length of the block, fields) of a line that begins as a record does."""
    end = line.find(b"\r\n\r\n")
    if end < 0 or line[1:3] != b"\r\n" or not line[:1].isdigit():
        return None
    fields = {}
    for row in line[3:end].split(b"\r\n"):
        name, colon, value = row.partition(b":")
        if not colon:
            return None
        fields[name.decode("latin-1").strip().lower()] = value.decode("utf-8", "replace").strip(" \t")
    length = fields.get("content-length", "")
    if not (length.isascii() and length.isdigit()):
        return None
    return end + 4, int(length), fields


def _forest(starts: np.ndarray, successor: np.ndarray, end: int) -> tuple[list, list, list]:
    """(pre, post, leaves) of candidates in ascending order, each one's parent being its successor.

    Candidate x is on the chain of e where ``pre[x] <= pre[e] < post[x]``. ``leaves`` is where the
    chain of a candidate leaves the stretch, -1 where it breaks inside.
    """
    n = len(starts)
    at = np.minimum(np.searchsorted(starts, successor), max(n - 1, 0))
    inside = (successor >= 0) & (successor < end)
    parent = np.where(inside & (starts[at] == successor), at, -1).tolist() if n else []
    size, pre, slot, leaves = [1] * n, [0] * n, [0] * n, [-1] * n
    for i in range(n):
        if parent[i] >= 0:
            size[parent[i]] += size[i]
    free = 0
    for i in reversed(range(n)):
        p = parent[i]
        if p >= 0:
            pre[i], slot[p], leaves[i] = slot[p], slot[p] + size[i], leaves[p]
        else:
            pre[i], free = free, free + size[i]
            leaves[i] = int(successor[i]) if successor[i] >= end else -1
        slot[i] = pre[i] + 1
    return pre, [a + b for a, b in zip(pre, size, strict=True)], leaves


def _scan(batches):
    """Lines of each stretch with their places in it, and what each would be as a record.

    Rows come in the order of the file: (file, block, first, line). Offsets count from the first line
    that the stretch owns. A line of a record that is no candidate has a null ``head``.
    """
    current, lines = None, []
    for batch in batches:
        names, blocks = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for key, line in zip(zip(names, blocks, strict=True), arrow_bytes(batch.column(2)), strict=True):
            if key != current:
                if lines:
                    yield from _stretch(current, lines)
                current, lines = key, []
            lines.append(line)
    if lines:
        yield from _stretch(current, lines)


def _stretch(key, lines: list[bytes]):
    opening = key[1] == 0
    cut = len(_CUT)
    # the first line of a file begins with the magic itself; every other one follows a cut
    skip = [len(MAGIC) if opening and i == 0 and line.startswith(MAGIC.encode()) else 0 for i, line in enumerate(lines)]
    step = np.array([len(x) + cut for x in lines])
    rel = np.cumsum(step) - step
    heads = [_head(line[s:]) if s or not (opening and i == 0) else None for i, (line, s) in enumerate(zip(lines, skip, strict=True))]
    known = [i for i, h in enumerate(heads) if h]
    begin = np.array([rel[i] + skip[i] for i in known], np.int64)
    successor = np.array([rel[i] + skip[i] + heads[i][0] + heads[i][1] + 4 + len(MAGIC) for i in known], np.int64)
    pre, post, leaves = _forest(begin, successor, int(rel[-1] + step[-1]))
    place = {i: n for n, i in enumerate(known)}
    for a in range(0, len(lines), 256):
        rows = range(a, min(len(lines), a + 256))

        def of(values, rows=rows):
            return [values[place[i]] if i in place else None for i in rows]

        yield pa.RecordBatch.from_arrays(
            [
                pa.array([key[0]] * len(rows)),
                pa.array([key[1]] * len(rows), pa.int64()),
                pa.array([int(rel[i] + skip[i]) for i in rows], pa.int64()),
                pa.array([int(step[i]) for i in rows], pa.int64()),
                pa.array([opening and i == 0 for i in rows]),
                pa.array([heads[i] and heads[i][0] for i in rows], pa.int64()),
                pa.array([heads[i] and heads[i][1] for i in rows], pa.int64()),
                pa.array(of(pre), pa.int32()),
                pa.array(of(post), pa.int32()),
                pa.array(of(leaves), pa.int64()),
                pa.array([heads[i] and list(heads[i][2].items()) for i in rows], pa.map_(pa.string(), pa.string())),
                pa.array([lines[i][skip[i] :] for i in rows], pa.binary()),
            ],
            names=["file", "block", "rel", "size", "first", "head", "length", "pre", "post", "leaves", "fields", "body"],
        )


def _stretches(lines: DataFrame) -> DataFrame:
    """(file, block, base, entry): where each stretch begins and, by pointer jumping, its first record.

    A place is that of the byte after the magic; ``entry`` is the first record's number in the order
    of chains, null where no record begins in the stretch.
    """
    blocks = lines.groupBy("file", "block").agg(F.sum("size").alias("bytes"))
    # one row for each stretch of a file
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    based = stage(blocks.select("file", "block", F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("base")), "stretches")
    longest = based.groupBy("file").count().agg(F.coalesce(F.max("count"), F.lit(0))).first()[0]
    candidates = lines.where("head IS NOT NULL").join(based, ["file", "block"]).withColumn("at", F.col("base") + F.col("rel"))
    reached = candidates.where("first").select("file", "at")
    if longest > 1:
        hops = stage(candidates.where("leaves >= 0").select("file", "at", (F.col("base") + F.col("leaves")).alias("to")), "hops")
        rounds = int(longest - 1).bit_length()
        for turn in range(rounds):
            ahead = reached.join(hops, ["file", "at"]).select("file", F.col("to").alias("at"))
            reached = stage(reached.union(ahead), "reached")
            if turn < rounds - 1:
                onward = hops.select("file", F.col("at").alias("to"), F.col("to").alias("beyond"))
                hops = stage(hops.join(onward, ["file", "to"]).select("file", "at", F.col("beyond").alias("to")), "hops")
    entries = candidates.join(reached, ["file", "at"]).select("file", "block", F.col("pre").alias("entry"))
    return stage(based.join(entries, ["file", "block"], "left"), "entries")


def _put_together(marked: DataFrame) -> DataFrame:
    """Records that go on over several lines: those whose payload holds the magic.

    Only these records and the lines that no chain reaches are shuffled: to their stretch, where each
    line finds the last record before it (what earlier stretches left open is a row per stretch), and
    then to that record.
    """
    opened = F.when(F.col("record"), F.struct("at", (F.col("at") + F.col("head") + F.col("length")).alias("end")))
    line = marked.withColumn("opened", opened)
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = line.groupBy("file", "block").agg(F.max("opened").alias("opened"))
    carried = stage(carried.select("file", "block", F.max("opened").over(before).alias("carried")).where("carried IS NOT NULL"), "carried")
    held = Window.partitionBy("file", "block").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    owned = line.withColumn("owner", F.max("opened").over(held)).join(carried, ["file", "block"], "left")
    owned = owned.withColumn("owner", F.coalesce("owner", "carried")).where("at < owner.end")
    joined = owned.groupBy("file", F.col("owner.at").alias("at")).agg(
        *[F.first(F.when(F.col("record"), F.col(c)), ignorenulls=True).alias(c) for c in ("head", "length", "fields")],
        F.array_sort(F.collect_list(F.struct("at", "body"))).alias("parts"),
    )
    first, more = F.col("parts")[0]["body"], F.slice("parts", 2, F.greatest(F.size("parts") - 1, F.lit(0)))
    body = F.aggregate(more, first, lambda whole, part: F.concat(whole, F.lit(_CUT.encode()), part["body"]))
    return joined.select("file", "at", "head", "length", "fields", body.alias("body")).where(F.octet_length("body") >= F.col("head") + F.col("length"))


_RECORD = """file string, offset long, record_type string, record_id string, target_uri string, date string,
 payload_digest string, refers_to string, http_length long, payload binary"""
_FIELDS = ["warc-type", "warc-record-id", "warc-target-uri", "warc-date", "warc-payload-digest", "warc-refers-to"]


def _http(block: bytes) -> tuple[int | None, bytes]:
    """(length that the header states, what follows the header)."""
    head, end, payload = block.partition(b"\r\n\r\n")
    if not end:
        return None, b""
    for row in head.split(b"\r\n")[1:]:
        name, _, value = row.partition(b":")
        if name.strip().lower() == b"content-length" and value.strip().isdigit():
            return int(value), payload
    return None, payload


def _parse(batches):
    for batch in batches:
        file, at, head, length, fields, body = (batch.column(i).to_pylist() for i in range(6))
        columns: list[list] = [[] for _ in range(8)]
        for h, n, pairs, data in zip(head, length, fields, body, strict=True):
            named = dict(pairs)
            block = data[h : h + n]
            stated, payload = _http(block) if named.get("content-type", "").lower().startswith("application/http") else (None, block)
            row = [named.get(f) for f in _FIELDS] + [stated, None if named.get("warc-type") == "revisit" else payload]
            for column, value in zip(columns, row, strict=True):
                column.append(value)
        kinds = [pa.string()] * 6 + [pa.int64(), pa.binary()]
        yield pa.RecordBatch.from_arrays(
            [pa.array(file, pa.string()), pa.array([a - len(MAGIC) for a in at], pa.int64()), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))],
            names=["file", "offset", "record_type", "record_id", "target_uri", "date", "payload_digest", "refers_to", "http_length", "payload"],
        )


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """Every record of the plain WARC files below ``path``.

    (file, offset, record_type, record_id, target_uri, date, payload_digest, refers_to, http_length,
    payload): ``payload`` is what follows the HTTP header of an HTTP block, the whole block of another,
    and null for a revisit, whose ``http_length`` is the length of the payload it stands for. A record
    cut off by the end of its file is left out; what follows a broken header is out of reach. Empty
    files have no records.
    """
    text = spark.read.option("lineSep", _CUT).option("recursiveFileLookup", True).text(path)
    rows = text.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("line"))
    lines = stage(rows.mapInArrow(_scan, _LINES), "lines", "zstd")
    stretches = _stretches(lines.drop("fields", "body"))
    marked = lines.join(stretches, ["file", "block"]).withColumn("at", F.col("base") + F.col("rel"))
    # on the chain of the entry
    reached = F.col("head").isNotNull() & (F.col("pre") <= F.col("entry")) & (F.col("entry") < F.col("post"))
    marked = marked.select("file", "block", "at", "head", "length", "fields", "body", F.coalesce(reached, F.lit(False)).alias("record"))
    complete = F.col("record") & (F.octet_length("body") >= F.col("head") + F.col("length"))
    columns = ["file", "at", "head", "length", "fields", "body"]
    found = marked.where(complete).select(*columns).unionByName(_put_together(marked.where(~complete)).select(*columns))
    return found.select(*columns).mapInArrow(_parse, _RECORD)


def archive_pages(pages: DataFrame, path: str | None = None, **options) -> DataFrame:
    """:func:`write_archives` into ``path`` (by default a scratch folder) and :func:`read_archives` of it."""
    target = path or scratch_path(pages.sparkSession, "archives")
    write_archives(pages, target, **options)
    return read_archives(pages.sparkSession, target)
