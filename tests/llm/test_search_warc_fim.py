"""Lexical search, archives and fill-in-the-middle against brute force on small rows with every awkward case."""

import base64
import collections
import hashlib
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowmill.llm import fim, lexical, warc

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def ranked(docs, items, k=10):
    counted = [(d, collections.Counter(terms(t)), len(terms(t))) for d, t in docs]
    counted = [c for c in counted if c[2]]
    n_docs, total = len(counted), sum(c[2] for c in counted)
    df = collections.Counter(t for _, c, _ in counted for t in c)
    out = []
    for item, text in items:
        scores = []
        for doc, c, n in counted:
            m = 25 + (75 * n * n_docs) // total
            score = sum(
                math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in terms(text) if c[t]
            )
            if score > 0:
                scores.append((-score, doc is None, doc or 0, doc))
        scores.sort(key=lambda x: x[:3])
        out += [(item, r, s[3], -s[0]) for r, s in enumerate(scores[:k], 1)]
    return sorted(out, key=str)


def words_of(rng, size, width):
    return " ".join(f"t{int(width * rng.random() ** 3)}" for _ in range(size))


def sample_docs():
    rng = random.Random(3)
    docs = [(i, words_of(rng, rng.choice([3, 7, 7, 7, 40, 41]), 60)) for i in range(300)]
    docs += [(300, None), (301, ""), (302, " ,.;"), (303, "T1 T2 T3"), (304, "t1,t2;t3"), (305, "É é Straße İ"), (None, "t1 t2 t3"), (None, None)]
    docs += [docs[5], docs[5], (5, docs[5][1]), (400, words_of(rng, 20_000, 60))]
    return docs


ITEMS = [(1, "t1 t2 t59 T59"), (2, "nothing here occurs"), (3, None), (4, ""), (5, "É straße x"), (1, "t40 t41 t42"), (None, "t7 t8")]


@pytest.mark.parametrize("block", [lexical.BLOCK_TERMS, 3])
def test_lexical_search_equals_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(lexical, "BLOCK_TERMS", block)
    docs = sample_docs()
    table = spark.createDataFrame([(d, t, 0, "x") for d, t in docs], "doc_id long, text string, score int, rank string").repartition(5)
    items = spark.createDataFrame([(i, t, 1) for i, t in ITEMS], "item_id long, text string, doc_id int")
    got = [tuple(r) for r in lexical.rank_documents(table, items).collect()]
    assert sorted(got, key=str) == ranked(docs, ITEMS)


def test_lexical_search_steps_and_bounds(monkeypatch):
    """Small steps and pruning give what one step over everything gives."""
    monkeypatch.setattr(lexical, "STEP_CELLS", 200)
    rng = np.random.default_rng(5)
    weights, best = np.arange(40, dtype=np.int64) * 100, {}
    m = np.sort(rng.integers(30, 60, 500))
    rows = [(int(x), i, sorted(rng.choice(40, 6, replace=False).tolist()), rng.integers(1, 9, 6).tolist()) for i, x in enumerate(m)]
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays(
        [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int64())), strict=True)],
        names=["m", "doc", "terms", "tfs"],
    )
    items = [(i, rng.choice(40, 5, replace=False), rng.integers(1, 3, 5)) for i in range(20)]
    table = next(lexical._search(items, weights, 10)([batch.slice(a, 50) for a in range(0, 500, 50)]))
    for number, s, d in zip(*(c.to_pylist() for c in table.columns), strict=True):
        best.setdefault(number, []).append((-s, d))
    for number, asked, repeats in items:
        want = []
        for level, doc, t, tf in rows:
            has = dict(zip(t, tf, strict=True))
            want.append((-sum(int(weights[a]) * int(r) * (10**9 * has[a] // (1000 * has[a] + 8 * level)) for a, r in zip(asked.tolist(), repeats.tolist(), strict=True) if a in has), doc))
        assert best[number] == sorted(w for w in want if w[0] < 0)[:10]


def test_lexical_search_of_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert lexical.rank_documents(docs, items).collect() == []
    assert lexical.rank_documents(spark.createDataFrame(sample_docs(), "doc_id long, text string"), items.limit(0)).collect() == []


# --- archives -------------------------------------------------------------------------------------

FAKE = "\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:record:666>\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"
PAGES = [
    (1, "http://a/1", "<html>one</html>"),
    (2, "http://a/2\r\nX: y", None),
    (3, None, ""),
    (4, "http://a/é b", "\nWARC/1.1\r\nContent-Length: 9999999\r\n\r\nrest"),
    (5, "http://a/5", FAKE * 3),
    (6, "http://a/6", FAKE[4:] + "é\x00\r\n" + FAKE),
    (7, "http://a/7", "<html>one</html>"),
    (8, "http://a/8", "WARC/1.0\r\n\r\n"),
    (9, "http://a/9", "x" * 3000 + "\nWARC/1." + "y" * 3000),
    (10, "http://a/10", "<html>one</html>"),
    (-3, "http://a/m3", "negative"),
]


def roles(pages):
    largest = {}
    for key, _, html in pages:
        if key is not None:
            largest[html or ""] = max(largest.get(html or "", key), key)
    return largest


def expected(pages, least=0):
    largest = roles(pages)
    out = []
    for key, _, html in pages:
        data = (html or "").encode()
        top = largest.get(html or "", key)
        revisit = len(data) >= least and top != key
        out.append((key, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if revisit else "response", top if revisit else None))
    return sorted(out, key=str)


def digests(found):
    full = F.col("record_type") == "response"
    return found.select(
        warc.key_of(F.col("record_id")).cast("long"),
        F.when(full, F.octet_length("payload").cast("long")).otherwise(F.col("http_length")),
        F.when(full, warc.base32_sha1(F.col("payload"))).otherwise(F.substring("payload_digest", 6, 32)),
        "record_type",
        warc.key_of(F.col("refers_to")).cast("long"),
    )


@pytest.mark.parametrize("split,files", [("128m", 3), ("1500b", 2)])
def test_archives_read_back_whole(spark, split, files):
    pages = PAGES + [(20 + i, f"http://b/{i}", f"page {i % 7} " * (i % 40) + FAKE * (i % 3)) for i in range(30)]
    pages += [pages[0], (None, "http://n", "no key"), (None, None, "<html>one</html>")]
    table = spark.createDataFrame([(*p, 1, "e") for p in pages], "page_id long, url string, html string, digest int, refers string")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    spark.conf.set("spark.sql.files.openCostInBytes", "1b" if split != "128m" else "4m")
    try:
        found = warc.archive_pages(table.repartition(files)).cache()
        assert sorted((tuple(r) for r in digests(found).collect()), key=str) == expected(pages)
        texts = {(r.record_id, bytes(r.payload)) for r in found.where("record_type = 'response'").collect()}
        assert texts >= {(f"<urn:record:{k}>", h.encode()) for k, _, h in PAGES if h and roles(pages)[h] == k}
        uris = {r.record_id: r.target_uri for r in found.collect()}
        assert uris["<urn:record:2>"] == "http://a/2%0D%0AX:%20y" and uris["<urn:record:3>"] is None and uris["<urn:record:4>"] == "http://a/é%20b"
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_digest_is_worked_out_once(spark):
    """A branch of a conditional shares no subexpressions, so each mention of the hash is one more hash of the payload."""
    payloads = spark.range(200).select(F.when(F.col("id") > 0, F.sha2(F.col("id").cast("string"), 512)).alias("p"))
    found = payloads.select("p", F.when(F.col("p").isNotNull(), warc.base32_sha1(F.col("p"))).alias("d"))
    assert found._jdf.queryExecution().optimizedPlan().toString().count("sha1(") == 1
    for p, d in found.collect():
        assert d == (p and base64.b32encode(hashlib.sha1(p.encode()).digest()).decode())


def test_archives_least_bytes_and_empty_table(spark):
    table = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    assert sorted((tuple(r) for r in digests(warc.archive_pages(table, least_bytes=17)).collect()), key=str) == expected(PAGES, 17)
    assert warc.archive_pages(table.limit(0)).collect() == []


def test_broken_archives(spark, tmp_path):
    def record(key, payload):
        return f"WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:record:{key}>\r\nContent-Length: {len(payload)}\r\n\r\n{payload}\r\n\r\n"

    (tmp_path / "cut.warc").write_bytes((record(1, "a") + record(2, "b" * 50)).encode()[:-30])
    (tmp_path / "junk.warc").write_bytes(("junk\n" + record(3, "c")).encode())
    (tmp_path / "broken.warc").write_bytes((record(4, "d") + "WARC/1.1\r\nno colon\r\n\r\n" + record(5, "e")).encode())
    (tmp_path / "empty.warc").write_bytes(b"")
    found = warc.read_archives(spark, str(tmp_path)).collect()
    assert sorted((r.record_id, bytes(r.payload), r.offset) for r in found) == [("<urn:record:1>", b"a", 0), ("<urn:record:4>", b"d", 0)]


def test_chains_of_candidates():
    """Intervals tell who is on whose chain, as walking the chain does."""
    rng = np.random.default_rng(1)
    starts = np.unique(rng.integers(0, 500, 80))
    successor = starts + rng.integers(1, 60, len(starts))
    successor = np.where(rng.random(len(starts)) < 0.7, starts[np.minimum(np.searchsorted(starts, successor), len(starts) - 1)], successor)
    successor = np.where(successor <= starts, starts + 7, successor)
    pre, post, leaves = warc._forest(starts, successor, 500)
    where = {int(s): i for i, s in enumerate(starts)}
    for e in range(len(starts)):
        chain, at = [e], int(successor[e])
        while at in where and at < 500:
            chain.append(where[at])
            at = int(successor[where[at]])
        assert {x for x in range(len(starts)) if pre[x] <= pre[e] < post[x]} == set(chain)
        assert leaves[e] == (at if at >= 500 else -1)


# --- fill in the middle ---------------------------------------------------------------------------


def example(key, text, rate=100, spm=50):
    text = text or ""
    lines = re.findall(r"[^\n]*\n|[^\n]+", text)
    n = len(lines)
    digest = hashlib.sha256(f"7:{'' if key is None else key}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * i : 8 * i + 8], 16) for i in range(4))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= rate:
        return n, "plain", None, None, text
    x, y = sorted((h1 % (n + 1), h2 % (n + 1)))
    a, b, c = "".join(lines[:x]), "".join(lines[x:y]), "".join(lines[y:])
    if h4 % 100 < spm:
        return n, "spm", len(a), len(b), f"<S>{c}<P>{a}<M>{b}"
    return n, "psm", len(a), len(b), f"<P>{a}<S>{c}<M>{b}"


def fim_rows():
    rng = random.Random(9)
    passage = "".join(f"shared line {i} é漢🙂\n" * (i % 3 + 1) for i in range(200))
    texts = [None, "", "\n", "a", "a\n", "\n\n\n", "no end\nhere", "<P", "S><", "x<S>y\nz", "<<P>>", "é\n" * 5000, "z" * 30_000, "z" * 8190 + "<M>" + "z" * 9000]
    texts += ["".join(rng.choice(["one\n", "two ", "é", "漢\n", "\n", "long " * 50]) for _ in range(rng.randrange(400))) for _ in range(60)]
    texts += [passage, "before\n" + passage, passage + "after", "x" * 77 + passage + passage, passage * 40]
    rows = [(i, t) for i, t in enumerate(texts)]
    return rows + [rows[10], rows[10], (None, passage), (None, None)]


@pytest.mark.parametrize("rate,spm", [(100, 50), (60, 0), (0, 100)])
def test_fill_in_middle_equals_brute_force(spark, rate, spm):
    rows = fim_rows()
    table = spark.createDataFrame([(k, t, 3, "e") for k, t in rows], "doc_id long, text string, n int, form string").repartition(3)
    made = fim.fill_in_middle(table, rate=rate, spm=spm)
    made = made.withColumn("restored", fim.restore(F.col("output"), F.col("form")))
    assert made.columns == ["doc_id", "text", "n", "form", "prefix_chars", "middle_chars", "output", "restored"]
    got = sorted(((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output, r.restored) for r in made.collect()), key=str)
    assert got == sorted(((k, *example(k, t, rate, spm), t or "") for k, t in rows), key=str)


def test_fill_in_middle_of_an_empty_table_and_other_names(spark):
    assert fim.fill_in_middle(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    table = spark.createDataFrame([("a", "x\ny\nz", 1)], "form string, output string, t int")
    row = fim.fill_in_middle(table, key="form", text="output").collect()[0]
    assert row["__output"] == example("a", "x\ny\nz")[4] and row["output"] == "x\ny\nz"


def test_chunks_are_cut_by_content_and_remembered():
    rng = np.random.default_rng(2)
    shared = bytes(rng.integers(97, 123, 60_000, dtype=np.uint8))
    texts = [bytes(rng.integers(97, 123, size, dtype=np.uint8)) + shared for size in (0, 1, 777, 5000)]
    cuts = [fim.cut(t, fim.boundaries(np.frombuffer(t, np.uint8))) for t in texts]
    assert all(b"".join(c) == t for c, t in zip(cuts, texts, strict=True))
    assert all(len(x) <= fim.MOST for c in cuts for x in c) and all(len(x) >= fim.LEAST for c in cuts for x in c[:-1])
    assert all(len(set(cuts[0]) & set(c)) > 0.8 * len(cuts[0]) for c in cuts)
    memory = fim.Memory(limit=10_000)
    for c in cuts:
        whole = fim.Text(c, memory)
        assert whole.size == sum(map(len, c)) and memory.held <= 10_000
    memory = fim.Memory()
    for c in cuts:
        fim.Text(c, memory)
    assert memory.hits > 2 * len(cuts[0])


def test_control_strings_across_chunks():
    memory = fim.Memory()
    for chunks, want in (([b"a<", b"P", b">b"], True), ([b"a<P", b">"], True), ([b"<", b"M>"], True), ([b"<", b"<", b"P>"], True), ([b"a<", b"b", b"P>"], False)):
        assert fim.Text(chunks, memory).marked() is want
