"""Cutoffs against a brute-force version, and the bounds on what the quality operators learn from."""

import math

import pytest
from pyspark.sql import functions as F

pytest.importorskip("public_tokenizers")

from flowmill.llm import quality_classifier, quality_rules  # noqa: E402

COUNTS = sorted({c for top, bottom, _ in quality_rules.RULES.values() for c in (top, bottom)})


def tail(k, n, rate):
    return 1.0 if k > n * rate else sum(math.comb(n, i) * rate**i * (1 - rate) ** (n - i) for i in range(k + 1))


def measured_rows():
    """(key, stratum, counts): 1,500 keys of which some symbols stand out, some rows three times."""
    rows = []
    for i in range(1500):
        counts = dict.fromkeys(COUNTS, 0) | {"word_chars": 100, "n_words": 40, "n_lines": 10}
        counts["n_symbols"] = 45 if i % 400 == 0 else 22 if i % 90 == 0 else i % 3
        counts["n_stutter"] = 12 if i % 30 == 0 else 0
        for repeat in range(3 if i % 5 == 0 else 1):
            rows.append((i, "en" if i < 1400 else None, *[counts[c] + (repeat if c == "n_symbols" else 0) for c in COUNTS]))
    return rows


def cutoffs_by_hand(rows, bad, rate, level):
    share = rate / len(quality_rules.RULES)
    groups = {}
    for key, stratum, *counts in rows:
        if key not in bad:
            groups.setdefault(stratum, {}).setdefault(key, []).append(dict(zip(COUNTS, counts)))
    found = {}
    for stratum, keys in groups.items():
        for rule, (top, bottom, ladder) in quality_rules.RULES.items():
            values = [max(c[top] / c[bottom] if c[bottom] else 0.0 for c in of) for of in keys.values()]
            for cutoff in ladder:
                if tail(sum(v > cutoff for v in values), len(values), share) > level / len(quality_rules.RULES) / len(groups):
                    break
                found[stratum, rule] = cutoff
    return found


def test_cutoffs_are_those_of_fixed_sequence_tests(spark):
    rows = measured_rows()
    schema = "doc_id long, lang string, " + ", ".join(f"{c} long" for c in COUNTS)
    measured = spark.createDataFrame(rows, schema).repartition(3)
    bad = {i for i in range(0, 1500, 11)}
    # a key labelled good and bad is not good; labels without a value or key are left out
    labels = [(i, 1) for i in range(1500)] + [(i, 0) for i in bad] + [(3, None), (None, 1)]
    labels = spark.createDataFrame(labels, "doc_id long, quality int")
    got = {
        (r.stratum, rule): r[f"cut_{rule}"]
        for r in quality_rules.fit_cutoffs(measured, labels).collect()
        for rule in quality_rules.RULES
        if r[f"cut_{rule}"] is not None
    }
    expected = cutoffs_by_hand(rows, bad, 0.05, 0.05)
    assert got == expected
    # some ladder is proven to its end, some stops on the way, and a small stratum proves nothing
    ends = {rule: ladder[-1] for rule, (_, _, ladder) in quality_rules.RULES.items()}
    assert any(got[k] == ends[k[1]] for k in got) and any(got[k] > ends[k[1]] for k in got)
    assert not any(stratum is None for stratum, _ in got)

    judged = quality_rules.apply_cutoffs(measured.withColumn("rejected_by", F.lit("own")), quality_rules.fit_cutoffs(measured, labels))
    for r in judged.collect():
        over = [
            rule for rule, (top, bottom, _) in quality_rules.RULES.items()
            if (r.lang, rule) in expected and r[bottom] and r[top] / r[bottom] > expected[r.lang, rule]
        ]
        assert r.rejected_by == over


def test_repeated_rows_prove_nothing(spark):
    """200 good keys are too few for a cutoff, and stay so when every row is there ten times."""
    one = dict.fromkeys(COUNTS, 0) | {"word_chars": 100, "n_words": 40, "n_lines": 10}
    schema = "doc_id long, lang string, " + ", ".join(f"{c} long" for c in COUNTS)
    measured = spark.createDataFrame([(i, "en", *[one[c] for c in COUNTS]) for i in range(200)] * 10, schema)
    labels = spark.createDataFrame([(i, 1) for i in range(200)], "doc_id long, quality int")
    assert quality_rules.fit_cutoffs(measured, labels).count() == 0


def test_chance_of_a_wrong_proof_is_bounded():
    """Where good documents are rejected at the allowed rate, the chance to prove the cutoff is at most the level."""
    rate, level = 0.05 / len(quality_rules.RULES), 0.05 / len(quality_rules.RULES)
    for n in (700, 2000):
        wrong = sum(math.comb(n, k) * rate**k * (1 - rate) ** (n - k) for k in range(n // 20) if tail(k, n, rate) <= level)
        assert wrong <= level


def test_classifier_reads_one_row_of_a_key(spark, monkeypatch):
    """Rows that share a key count once, so the bound on learned rows holds whatever repeats."""
    good, bad = "a calm sentence about rivers and hills", "BUY NOW $$$ click click"
    rows = [(i, good if i % 2 else bad) for i in range(40)] + [(1, f"{good} {j}") for j in range(300)] + [(None, good), (2, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] * 2, "doc_id long, quality int")
    seen = []
    learn = quality_classifier.train
    monkeypatch.setattr(quality_classifier, "train", lambda texts, *rest: seen.append(texts) or learn(texts, *rest))
    model = quality_classifier.fit(docs, labels, F.lit(True), max_rows=20)
    again = quality_classifier.fit(docs.repartition(5), labels, F.lit(True), max_rows=20)
    assert len(seen[0]) == 20 and seen[0] == seen[1] and model.bias == again.bias
