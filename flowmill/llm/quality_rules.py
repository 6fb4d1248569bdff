"""Quality rules whose cutoffs carry a guarantee: risk-controlled thresholds.

Each rule rejects a document when one measure of its text is above a cutoff. Good documents of a
labelled holdout say how often a cutoff rejects wrongly: k of n. The cutoff is safe if the exact
(Clopper-Pearson) upper bound of that rate is below the rule's share of the permitted rate, that
is if ``P(Binomial(n, share) <= k)`` is small. Per stratum and rule the cutoffs of a fixed ladder
are tested from the laxest on and testing stops at the first that fails (fixed-sequence testing,
so the ladder itself costs nothing); over rules and strata the level is divided (Bonferroni). With
probability ``1 - level`` no stratum loses more than ``max_false_rejection`` of its good
documents to the rules. A stratum with too few labels proves nothing and loses none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowmill.llm.columns import UPPER, count_of, words
from flowmill.session import stage

SYMBOLS = "#*$%&|<>"
MARKS = "!?"
WINDOW = 8

#: Rule -> (numerator, denominator, ladder of cutoffs from the laxest to the strictest).
RULES = {
    "symbols": ("n_symbols", "word_chars", (0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.1, 0.08, 0.06, 0.04, 0.03, 0.02)),
    "shouting": ("n_upper", "word_chars", (0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.2, 0.15)),
    "exclaiming": ("n_marks", "word_chars", (0.5, 0.4, 0.3, 0.2, 0.15, 0.1, 0.08, 0.06, 0.04)),
    "equal_lines": ("n_dup_lines", "n_lines", (0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.25, 0.2)),
    "equal_windows": ("n_repeat_words", "n_words", (0.9, 0.7, 0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.1)),
    "stutter": ("n_stutter", "n_words", (0.9, 0.7, 0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.1)),
}


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """The counts that the rules use, added to every row; ``text`` itself is dropped.

    ``n_repeat_words`` counts the words inside 8-word windows that the text holds at least twice,
    all of it in the row's own arrays: window hashes (64 bits, within one text), and only where two
    agree a sort of (hash, position). A null text counts as empty; an empty text has zeros
    everywhere. Columns of the same names as the counts are replaced.
    """
    own = ["word_chars", "n_words", "n_symbols", "n_upper", "n_marks", "n_lines", "n_dup_lines", "n_repeat_words", "n_stutter"]
    kept = [c for c in docs.columns if c not in own and c != text]
    base = docs.select(
        *kept,
        F.coalesce(F.col(text), F.lit("")).alias("__t"),
    )
    base = base.select(
        *kept,
        words(F.col("__t")).alias("__w"),
        F.filter(F.split("__t", "\n"), lambda x: F.rlike(x, F.lit(r"[^\x20\x09-\x0D]"))).alias("__l"),
        # what is counted is gathered first: it is far shorter than the text
        F.regexp_replace("__t", f"[^{SYMBOLS}{MARKS}A-Z]++", "").alias("__s"),
    )
    counts = ["n_symbols", "n_upper", "n_marks"]
    base = base.select(
        *kept,
        F.length(F.array_join("__w", "")).cast("long").alias("word_chars"),
        count_of(F.col("__s"), SYMBOLS).cast("long").alias("n_symbols"),
        count_of(F.col("__s"), UPPER).cast("long").alias("n_upper"),
        count_of(F.col("__s"), MARKS).cast("long").alias("n_marks"),
        F.size("__w").cast("long").alias("n_words"),
        F.size("__l").cast("long").alias("n_lines"),
        (F.size("__l") - F.size(F.array_distinct("__l"))).cast("long").alias("n_dup_lines"),
        F.expr("transform(__w, x -> xxhash64(x))").alias("__x"),
    )
    following = ", ".join(f"__x[i + {j}]" for j in range(1, WINDOW))
    counts += ["word_chars", "n_words", "n_lines", "n_dup_lines"]
    base = base.select(
        *kept,
        *counts,
        F.expr("size(filter(__x, (x, i) -> i > 0 AND x = __x[i - 1]))").cast("long").alias("n_stutter"),
        F.expr(
            f"CASE WHEN size(__x) >= {WINDOW} THEN transform(slice(__x, 1, size(__x) - {WINDOW - 1}),"
            f" (x, i) -> xxhash64(x, {following})) ELSE array() END"
        ).alias("__h"),
    )
    counts += ["n_stutter"]
    base = base.select(
        *kept,
        *counts,
        F.expr(
            "CASE WHEN size(array_distinct(__h)) < size(__h)"
            " THEN array_sort(transform(__h, (h, i) -> struct(h AS h, i AS i))) ELSE array() END"
        ).alias("__p"),
    )
    base = base.select(
        *kept,
        *counts,
        F.expr(
            "array_sort(transform(filter(__p, (x, k) -> get(__p, k - 1).h <=> x.h OR get(__p, k + 1).h <=> x.h),"
            " x -> x.i))"
        ).alias("__f"),
    )
    return base.select(
        *kept,
        *counts,
        F.expr(
            f"aggregate(__f, struct(0L AS n, CAST(-{WINDOW} AS INT) AS last),"
            f" (a, i) -> struct(a.n + least({WINDOW}, i - a.last) AS n, i AS last), a -> a.n)"
        ).alias("n_repeat_words"),
    )


def _value(rule: str) -> Column:
    top, bottom, _ = RULES[rule]
    return F.when(F.col(bottom) > 0, F.col(top) / F.col(bottom)).otherwise(F.lit(0.0))


def _tail(k: Column, n: Column, rate: float) -> Column:
    """``P(Binomial(n, rate) <= k)`` from its exact terms; 1 where k is above the mean."""
    odds = rate / (1 - rate)
    steps = F.when(k >= 1, F.sequence(F.lit(1).cast("long"), k)).otherwise(F.array().cast("array<bigint>"))
    first = n * F.log(F.lit(1 - rate))
    total = F.aggregate(
        steps,
        F.struct(first.cast("double").alias("t"), F.exp(first).cast("double").alias("s")),
        lambda a, i: F.struct(
            (a.t + F.log((n - i + 1) / i * odds)).alias("t"),
            (a.s + F.exp(a.t + F.log((n - i + 1) / i * odds))).alias("s"),
        ),
        lambda a: a.s,
    )
    return F.when(k > n * rate, F.lit(1.0)).otherwise(total)


def fit_cutoffs(
    measured: DataFrame,
    labels: DataFrame,
    *,
    key: str = "doc_id",
    stratum: str = "lang",
    max_false_rejection: float = 0.05,
    level: float = 0.05,
) -> DataFrame:
    """One row per stratum, a column per rule with its cutoff, null where none is proven.

    ``labels`` has (key, quality); rows whose quality is null are left out, a key labelled more
    than once counts as good only if every label says so. A null stratum is a stratum of its own.
    A key is one trial in a stratum however many rows it has there, at the largest of their values:
    repeated rows are no independent evidence.
    """
    share = max_false_rejection / len(RULES)
    good = labels.where("quality IS NOT NULL").groupBy(key).agg(F.min("quality").alias("quality"))
    held = (
        measured.join(good.where("quality = 1"), key)
        .groupBy(key, F.col(stratum).alias("stratum"))
        .agg(*[F.max(_value(r)).alias(r) for r in RULES])
    )
    over = [F.sum((F.col(r) > c).cast("long")).alias(f"{r}@{i}") for r, (_, _, ladder) in RULES.items() for i, c in enumerate(ladder)]
    counts = held.groupBy("stratum").agg(F.count(F.lit(1)).alias("n"), *over)
    cells = F.array(
        *[
            F.struct(F.lit(r).alias("rule"), F.lit(i).alias("step"), F.lit(float(c)).alias("cutoff"), F.col(f"`{r}@{i}`").alias("k"))
            for r, (_, _, ladder) in RULES.items()
            for i, c in enumerate(ladder)
        ]
    )
    tests = (
        counts.select("stratum", "n", F.inline(cells))
        .withColumn("p", _tail(F.col("k"), F.col("n"), share))
        .crossJoin(counts.agg(F.count(F.lit(1)).alias("strata")))  # one row
        .withColumn("failed", F.col("p") > level / len(RULES) / F.col("strata"))
    )
    stop = tests.where("failed").groupBy("stratum", "rule").agg(F.min("step").alias("stop"))
    tests = tests.alias("t").join(stop.alias("s"), F.expr("t.stratum <=> s.stratum AND t.rule = s.rule"), "left")
    passed = tests.where("s.stop IS NULL OR t.step < s.stop").select("t.stratum", "t.rule", "t.cutoff")
    return passed.groupBy("stratum").agg(*[F.min(F.when(F.col("rule") == r, F.col("cutoff"))).alias(f"cut_{r}") for r in RULES])


def apply_cutoffs(measured: DataFrame, cutoffs: DataFrame, *, stratum: str = "lang") -> DataFrame:
    """Adds ``rejected_by`` (or replaces it): the names of the rules above their stratum's cutoff."""
    joined = measured.drop("rejected_by").alias("m").join(cutoffs.alias("c"), F.expr(f"m.`{stratum}` <=> c.stratum"), "left")
    hit = F.array(*[F.when(_value(r) > F.col(f"c.cut_{r}"), F.lit(r)) for r in RULES])
    return joined.select("m.*", F.array_compact(hit).alias("rejected_by"))


def quality_rules(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", stratum: str = "lang", **control) -> DataFrame:
    """Counts, ``base_failed``, ``rejected_by`` and ``kept`` for every document.

    The measures are written once, without the texts, and serve both the fit and the verdict.
    Empty texts fail the base rule (fewer than 20 words); repeated rows each get their own result.
    """
    measured = stage(measure(docs, text), "quality-measures")
    judged = apply_cutoffs(measured, fit_cutoffs(measured, labels, key=key, stratum=stratum, **control), stratum=stratum)
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return judged.withColumn("base_failed", failed).withColumn("kept", ~failed & (F.size("rejected_by") == 0))
