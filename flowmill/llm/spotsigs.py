"""Document fingerprints by spot signatures.

A spot is a run of common words; its last word is the anchor, and the anchor with the chain of the
next content words (common words in between are skipped) is a signature. The fingerprint of a text
is the set of its signatures as sorted 64-bit hashes in hex. Common words sit in running prose and
not in navigation, tables or boilerplate, so the set follows the prose of a page.

Two sets are compared by Jaccard similarity; ``jaccard`` can leave a pair out by its sizes, as
similarity is at most the smaller size over the larger one. There is no search for similar pairs
here: pairs are given, no query uses ``size_partition``, and none leaves a pair out.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Common words of four languages.
COMMON = {
    "en": "a an and are as at be but by for from had has have he her his in is it its not of on or she that the their they this to was were which with you".split(),
    "de": "als am an auch auf aus bei das dem den der des die ein eine einem einen einer es für hat im in ist mit nach nicht noch sich sie sind und von war werden wie wird zu zum zur".split(),
    "fr": "à au aux avec ce ces dans de des du elle en est et il ils la le les leur mais ne ou par pas plus pour qu que qui sa se ses son sont sur un une".split(),
    "es": "al como con de del e el ella en entre es esta este ha la las lo los más me no o para pero por que se sin sobre son su sus un una y".split(),
}
CHAIN = 3




def _common() -> str:
    words = sorted({w for words in COMMON.values() for w in words})
    return ", ".join("'" + w + "'" for w in words)


def add_signatures(rows: DataFrame, text: str, name: str) -> DataFrame:
    """``rows`` with the array ``name`` of the signatures of column ``text``, sorted and distinct.

    A text without a full chain (too short, or no common word) has one signature, of its exact
    characters; so equal texts always have equal sets, and such texts meet only their copies. A null
    text is empty.
    """
    chain = ", ".join(f"get(__w, get(__c, j + {k}))" for k in range(CHAIN))
    kept = [c for c in rows.columns if c != name]
    body = F.coalesce(F.col(text), F.lit(""))
    steps = rows.select(*kept, F.array_remove(F.split(F.lower(body), r"[^\p{L}\p{N}]++"), "").alias("__w"))
    steps = steps.select("*", F.expr(f"filter(transform(__w, (x, i) -> IF(x IN ({_common()}), -1, i)), i -> i >= 0)").alias("__c"))
    # the content words that directly follow a common word and start a full chain
    steps = steps.select(
        "*",
        F.expr(
            f"CASE WHEN size(__c) >= {CHAIN} THEN filter(sequence(0, size(__c) - {CHAIN}),"
            " j -> __c[j] > coalesce(get(__c, j - 1), -1) + 1) ELSE array() END"
        ).alias("__s"),
    )
    found = F.expr(f"array_sort(array_distinct(transform(__s, j -> xxhash64(__w[__c[j] - 1], {chain}))))")
    whole = F.array(F.xxhash64(F.lit("whole text"), body))
    return steps.select(*kept, F.when(F.size("__s") > 0, found).otherwise(whole).alias(name))


def fingerprint(signatures: Column) -> Column:
    """The set as a string: its sorted hashes in hex, 16 digits each, comma-joined."""
    return F.array_join(F.transform(signatures, lambda x: F.lpad(F.lower(F.hex(x)), 16, "0")), ",")


def size_partition(size: Column, least: float) -> Column:
    """Partition of a set size such that sets two or more apart cannot reach ``least``."""
    return F.floor(F.log(F.greatest(size, F.lit(1)).cast("double")) / -math.log(least)).cast("int")


def jaccard(a: Column, b: Column, least: float = 0.0) -> Column:
    """Similarity of two sets; 0 without a comparison where the sizes rule ``least`` out."""
    common = F.size(F.array_intersect(a, b))
    value = common / (F.size(a) + F.size(b) - common)
    return F.when(F.least(F.size(a), F.size(b)) < least * F.greatest(F.size(a), F.size(b)), F.lit(0.0)).otherwise(value)


def _in_blocks(rows: DataFrame, key: str, blocks: int) -> DataFrame:
    """``rows`` with ``__block``: ranges of the key with about equally many rows, in key order.

    Only quantiles of the key reach the driver, one per block. They are nested two deep so a row looks
    at about twice the square root of their number.
    """
    cuts = rows.agg(F.percentile_approx(key, [i / blocks for i in range(1, blocks)], 100 * blocks)).first()[0] or []
    cuts = sorted(set(cuts))
    side = max(1, math.isqrt(len(cuts)))
    groups = [cuts[i : i + side] for i in range(0, len(cuts), side)]
    if not groups:
        return rows.withColumn("__block", F.lit(0))
    heads = F.array(*[F.lit(g[0]) for g in groups])
    nested = F.array(*[F.array(*[F.lit(c) for c in g]) for g in groups])
    rows = rows.withColumn("__g", F.size(F.filter(heads, lambda c: c < F.col(key))))
    within = F.size(F.filter(F.get(nested, F.col("__g") - 1), lambda c: c < F.col(key)))
    block = F.when(F.col("__g") > 0, (F.col("__g") - 1) * side + within).otherwise(F.lit(0))
    return rows.withColumn("__block", F.coalesce(block, F.lit(0)).cast("int")).drop("__g")


def with_next(rows: DataFrame, key: str, columns: list[str], *, blocks_per_partition: int = 4) -> DataFrame:
    """``rows`` with ``next_<column>``: the values of the next row by key, after the last the first.

    Rows move once, to the range of keys they belong to; the last row of a range takes the first one
    of the following range. Null keys come first, equal keys are in order of their columns.
    """
    spark = rows.sparkSession
    blocks = max(2, blocks_per_partition * int(spark.conf.get("spark.sql.shuffle.partitions")))
    placed = _in_blocks(rows, key, blocks)
    order = Window.partitionBy("__block").orderBy(F.col(key).asc_nulls_first(), *columns)
    line = placed.select("*", F.lead(F.struct(*columns)).over(order).alias("__next"), F.row_number().over(order).alias("__n"))
    heads = line.where("__n = 1").select(F.col("__block").alias("of"), F.struct(*columns).alias("__head"))
    # which block's first row each block's last row takes: a row per block
    used = placed.select("__block").distinct()
    ends = used.agg(F.min("__block").alias("first"))
    after = used.crossJoin(ends).select(
        "__block", F.coalesce(F.lead("__block").over(Window.orderBy("__block")), F.col("first")).alias("of")
    )
    heads = after.join(heads, "of").select(F.col("__block").alias("__to"), "__head")
    joined = line.join(heads, F.col("__block") == F.col("__to"), "left")
    following = F.coalesce("__next", "__head")
    return joined.select(*rows.columns, *[following[c].alias(f"next_{c}") for c in columns])


def compare_edits(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Each document with its edited text (the last half of its characters replaced by the first as
    many of the next document) and the signatures of both and of the next document.

    A table of one document is its own next one. Repeated rows follow each other.
    """
    plain = docs.select(F.col(key).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    signed = add_signatures(plain, "text", "signatures")
    paired = with_next(signed, "doc_id", ["text", "signatures"])
    size = F.length("text")
    half = F.floor(size / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), size - half), F.substring("next_text", F.lit(1), half))
    paired = paired.withColumn("edited", edited).drop("next_text")
    return add_signatures(paired, "edited", "edited_signatures")
