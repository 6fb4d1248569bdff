"""Secret scan over a trigram inverted index.

Every rule is a regular expression. What any of its matches must contain is kept as a Boolean
trigram query, derived from the expression by :func:`trigram_query`: alternatives of sets of
trigrams (a set is an AND, the alternatives an OR). The index lists, per trigram that some query
names, the documents that hold it; a query is answered by intersecting postings and its documents
are verified with the expression itself. A rule without mandatory trigrams scans every document.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from re import _constants as sre  # the parser of the standard library, under its name since 3.11
from re import _parser as sre_parse

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowmill.llm.columns import lower_ascii


@dataclass(frozen=True)
class Rule:
    """A kind of secret. A match stands only if ``group`` has at least ``least`` characters."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


#: The three base kinds.
BASE = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]{24,}", 0, 24),  # all of a run, hence the same spans as a bare run of 24 or more
)
#: Well-known credential formats that the base kinds miss.
MORE = (
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", r"(?:ghp|gho|ghu|ghs|ghr)_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
)
RULES = BASE + MORE


def trigram_query(pattern: str) -> frozenset[frozenset[str]]:
    """Alternatives of mandatory lower-case trigrams; one empty alternative means "no condition"."""
    found = set()
    for runs in _strings(sre_parse.parse(pattern)):
        trigrams = {run[i : i + 3] for run in runs for i in range(len(run) - 2)}
        found.add(frozenset(trigrams))
    return frozenset([frozenset()]) if frozenset() in found else frozenset(found)


def _strings(parsed, limit: int = 64) -> list[tuple[str, ...]]:
    """What any match holds: alternatives, each the literal runs in order."""
    ways: list[tuple[str, ...]] = [("",)]
    for op, arg in parsed:
        if op is sre.LITERAL:
            part = [(chr(arg).lower(),)] if arg < 128 else [("", "")]
        elif op is sre.SUBPATTERN:
            part = _strings(arg[-1], limit)
        elif op is sre.BRANCH:
            part = [w for branch in arg[1] for w in _strings(branch, limit)]
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT) and arg[:2] == (0, 1):
            part = [("",), *_strings(arg[2], limit)]
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT) and arg[0] >= 1:
            part = [w[:1] + ("",) + w[-1:] if (arg[0], arg[1]) != (1, 1) else w for w in _strings(arg[2], limit)]
        else:  # a class or an optional part: anything may stand here
            part = [("", "")]
        joined = {(*a[:-1], a[-1] + b[0], *b[1:]) for a in ways for b in part}
        # what is too wide to spell out becomes "anything"
        ways = sorted(joined) if len(joined) <= limit else [(*a, "") for a in ways]
    return ways


def _plan(rules: tuple[Rule, ...]) -> tuple[list[tuple[str, int, str, int]], list[str], list[str]]:
    clauses, full = [], []
    for rule in rules:
        query = trigram_query(rule.pattern)
        if frozenset() in query:
            full.append(rule.kind)
            continue
        for i, clause in enumerate(sorted(sorted(c) for c in query)):
            clauses += [(rule.kind, i, t, len(clause)) for t in clause]
    return clauses, full, sorted({t for _, _, t, _ in clauses})


def postings(docs: DataFrame, trigrams: list[str], *, key: str, text: str) -> DataFrame:
    """The inverted index: (trigram, key) for the trigrams that queries name, letters in lower case."""
    low = docs.select(F.col(key).alias("key"), lower_ascii(F.coalesce(F.col(text), F.lit(""))).alias("low"))
    held = F.array_compact(F.array(*[F.when(F.contains("low", F.lit(t)), F.lit(t)) for t in trigrams]))
    return low.select("key", F.explode(held).alias("trigram"))


def candidates(index: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """(key, kinds): the rules whose trigram query a document answers."""
    clauses, _, _ = _plan(rules)
    asked = index.sparkSession.createDataFrame(clauses, "kind string, clause int, trigram string, needed int")
    met = (
        index.distinct()
        .join(asked, "trigram")  # the query table is as small as the rules
        .groupBy("key", "kind", "clause")
        .agg(F.count(F.lit(1)).alias("n"), F.first("needed").alias("needed"))
        .where("n = needed")
    )
    return met.groupBy("key").agg(F.collect_set("kind").alias("kinds"))


_SPANS = "array<struct<start:int,ord:int,end:int,kind:string>>"


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value evaluated once."""
    return F.transform(F.array(value), use)[0]


def _by_blocks(
    items: Column,
    advance: Callable[[Column, Column], Column],
    walk: Callable[[Column, Column], Column],
) -> Column:
    """``walk(block, position)`` for each block of ``items``, where a position goes from 0 through ``advance``.

    A fold copies what it gathered at every step, so it may gather only a little: blocks of about the
    square root of the items keep the cost of n items at n ** 1.5 copied references.
    """
    none = F.array().cast("array<int>")

    def each(items: Column) -> Column:
        side = F.ceil(F.sqrt(F.size(items))).cast("int")
        blocks = F.transform(
            F.sequence(F.lit(0), F.floor((F.size(items) - 1) / side).cast("int")),
            lambda i: F.slice(items, i * side + 1, side),
        )

        def with_positions(blocks: Column) -> Column:
            begins = F.aggregate(
                blocks,
                F.struct(F.lit(0).alias("at"), none.alias("out")),
                lambda a, block: F.struct(
                    F.aggregate(block, a["at"], advance).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out")
                ),
                lambda a: a["out"],
            )
            return F.zip_with(blocks, begins, walk)

        return _bound(blocks, with_positions)

    return _bound(items, each)


def _spans(text: Column, rule: Rule, order: int) -> Column:
    """Spans of a rule's matches as structs (start, order, end, kind), code points, end exclusive."""
    whole = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    judged = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)) if rule.group else whole
    between = F.split(text, rule.pattern, -1)
    # the pieces between matches have one more entry than the matches; it has a null match
    zipped = F.arrays_zip(whole.alias("m"), judged.alias("g"), between.alias("b"))

    def advance(at: Column, z: Column) -> Column:
        return at + F.length(z["b"]) + F.coalesce(F.length(z["m"]), F.lit(0))

    def step(a: Column, z: Column) -> Column:
        start = a["at"] + F.length(z["b"])
        span = F.struct(
            start.alias("start"),
            F.lit(order).alias("ord"),
            (start + F.length(z["m"])).alias("end"),
            F.lit(rule.kind).alias("kind"),
        )
        stands = F.length(z["g"]) >= rule.least
        return F.struct(
            advance(a["at"], z).alias("at"),
            F.when(stands, F.concat(a["out"], F.array(span))).otherwise(a["out"]).alias("out"),
        )

    def walk(block: Column, begin: Column) -> Column:
        return F.aggregate(
            block, F.struct(begin.alias("at"), F.array().cast(_SPANS).alias("out")), step, lambda a: a["out"]
        )

    found = F.flatten(_by_blocks(zipped, advance, walk))
    return F.when(F.rlike(text, F.lit(rule.pattern)), found).otherwise(F.array().cast(_SPANS))


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with ``spans``: array of (start, ord, end, kind) by start, then rule order.

    Matches are leftmost and do not overlap within a kind. A null text is empty and has no spans.
    Rows that repeat a key each get the spans of their own text; the index then answers for the key
    as a whole, which can only add rows to verify. Null keys meet as one key. A column named
    ``spans`` is replaced.
    """
    _, full, trigrams = _plan(rules)
    kinds = candidates(postings(docs, trigrams, key=key, text=text), rules)
    own = docs.drop("spans")
    joined = own.alias("d").join(kinds.alias("k"), F.expr(f"d.`{key}` <=> k.key"), "left")
    body = F.coalesce(F.col(f"d.`{text}`"), F.lit(""))
    none = F.array().cast(_SPANS)
    parts = []
    for order, rule in enumerate(rules):
        found = _spans(body, rule, order)
        if rule.kind not in full:
            found = F.when(F.array_contains("k.kinds", rule.kind), found).otherwise(none)
        parts.append(found)
    return joined.select("d.*", F.array_sort(F.concat(*parts)).alias("spans"))


def mask(scanned: DataFrame, *, text: str = "text", cover: str = "[SECRET]") -> DataFrame:
    """Texts with every span replaced by ``cover`` and no ``spans`` column; overlapping spans merge.

    A null text stays null and a text without spans stays as it is.
    """
    body = F.coalesce(F.col(text), F.lit(""))

    def advance(at: Column, span: Column) -> Column:
        return F.greatest(at, span["end"])

    def step(a: Column, span: Column) -> Column:
        gap = F.struct(a["at"].alias("from"), span["start"].alias("to"))
        apart = span["start"] >= a["at"]
        return F.struct(
            advance(a["at"], span).alias("at"),
            F.when(apart, F.concat(a["out"], F.array(gap))).otherwise(a["out"]).alias("out"),
        )

    def covered(gaps: Column) -> Column:
        # characters are counted from the start of a text, so a block first takes its own stretch
        first, last = F.get(gaps, F.lit(0))["from"], F.get(gaps, F.size(gaps) - 1)["to"]
        stretch = F.substring(body, first + 1, last - first)
        return F.coalesce(
            _bound(
                F.struct(stretch.alias("s"), first.alias("first")),
                lambda own: F.array_join(
                    F.transform(
                        gaps,
                        lambda g: F.concat(F.substring(own["s"], g["from"] - own["first"] + 1, g["to"] - g["from"]), F.lit(cover)),
                    ),
                    "",
                ),
            ),
            F.lit(""),
        )

    def walk(block: Column, begin: Column) -> Column:
        none = F.array().cast("array<struct<from:int,to:int>>")
        return F.aggregate(block, F.struct(begin.alias("at"), none.alias("out")), step, lambda a: covered(a["out"]))

    end = F.array_max(F.transform("spans", lambda s: s["end"]))
    masked = F.concat(
        F.array_join(_by_blocks(F.col("spans"), advance, walk), ""), F.substring(body, end + 1, F.length(body))
    )
    return scanned.withColumn(text, F.when(F.size("spans") > 0, masked).otherwise(F.col(text))).drop("spans")
