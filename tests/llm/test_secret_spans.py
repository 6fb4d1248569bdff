"""Spans and masks of all kinds against the standard library's expressions, on short and on crowded texts."""

import random
import re
import time

import pytest

pytest.importorskip("public_tokenizers")

from flowmill.llm import secret_scan  # noqa: E402

#: (kind, expression, judged group, least length), written apart from the operator's own rules
KINDS = [
    ("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]+", 0, 24),
    ("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1),
    ("github", r"(?:ghp|gho|ghu|ghs|ghr)_[A-Za-z0-9]{36,}", 0, 1),
    ("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}", 0, 1),
    ("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 1),
]
PARTS = [
    "token=abcdef1", "Secret : 'x'", "api_key=\"0123456789abcdef0123456789\"", "AKIA" + "Q7" * 9, "AKIAQ", "ab12" * 7,
    "-----BEGIN RSA PRIVATE KEY-----", "-----BEGIN KEY-----", "ghp_" + "aB3" * 13, "ghx_" + "a" * 40, "xoxb-1234567890-ab",
    "xoxz-1234567890", "eyJhbGciOiJI.eyJzdWIiOiIx.c2lnbmF0dXJl", "plain", "é世𝄞", "\n", "password=ghp_" + "z" * 36,
]


def spans_of(text):
    found = []
    for order, (kind, pattern, group, least) in enumerate(KINDS):
        found += [(m.start(), order, m.end(), kind) for m in re.finditer(pattern, text) if len(m[group]) >= least]
    return sorted(found)


def masked(text):
    out, at = [], 0
    for start, _, end, _ in spans_of(text):
        if start >= at:
            out += [text[at:start], "[SECRET]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def check(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    scanned = secret_scan.scan(docs)
    for row in scanned.collect():
        assert [tuple(s) for s in row.spans] == spans_of(texts[row.doc_id] or ""), row.doc_id
    for row in secret_scan.mask(scanned).collect():
        assert row.text == (None if texts[row.doc_id] is None else masked(texts[row.doc_id])), row.doc_id


def test_all_kinds(spark):
    dice = random.Random(3)
    texts = [None, "", " "]
    for size in [1, 2, 3, 5, 8, 20, 60] * 6:
        texts.append(dice.choice(["", " ", "\n"]).join(dice.choice(PARTS) for _ in range(size)))
    check(spark, texts)


def test_crowded_text(spark):
    """20,000 spans in one text take seconds; a fold that copies all it gathered takes a minute."""
    crowded = " ".join(f"é token=value{i} " + ("0123456789abcdef" * 2 if i % 2 else "-") for i in range(14_000))
    assert len(spans_of(crowded)) == 21_000
    begin = time.perf_counter()
    check(spark, [crowded, "token=abcdef"])
    assert time.perf_counter() - begin < 30
