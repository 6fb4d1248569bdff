"""Chat formatting by prefix-target expansion.

A turn is written ``<s>role\\ntext</s>\\n``. Every assistant turn becomes an example of its own: its
context is everything the conversation holds before it, its target is its own text, and nothing
else is trainable. :func:`expand` writes each context out, however long it is, so n turns are written up to
n times, and :func:`read_examples` reads every context back. A conversation of more than :data:`STRETCH`
code points is dealt out in stretches, each to a task that is sent all turns up to its end and writes the
examples that begin in it. So a turn is shuffled once for each stretch after it, not once for each
example; what an example adds to the one before it is shuffled once.

Strings that control a template (of this one or of a common other one) are escaped inside texts
by a backslash after their first character, one more each time, so the escape is reversible.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Control strings that may not occur in a text as they are: <s> </s> [INST] [/INST] <<SYS>> <</SYS>>.
_TAIL = r"(/?s>|<?/?SYS>>|/?INST\])"
_END = "</s>\n"
#: Code points of a conversation whose examples one task writes.
STRETCH = 1 << 18
#: Code points of a conversation up to which contexts are written out: any number.
WRITTEN = (1 << 63) - 1


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])(\\*)" + _TAIL, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])\\(\\*)" + _TAIL, r"$1$2$3")


def _line(role: Column) -> Column:
    return escape(F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))


def render(turns: DataFrame, *, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One written segment per turn: conversation, turn_no from 0, begin (code points of the
    conversation before it), segment, body_begin and body_end (its text, inside the conversation).

    Turns are in order of their number, then role, then text, nulls first, so ties and repeated
    rows have a place; a null role or text is empty; a null conversation is one conversation.
    """
    who, said = F.coalesce(F.col(role), F.lit("")), F.coalesce(F.col(text), F.lit(""))
    order = Window.partitionBy("conv").orderBy(F.col("turn").asc_nulls_first(), "who", "said")
    plain = turns.select(F.col(conversation).alias("conv"), F.col(turn).alias("turn"), who.alias("who"), said.alias("said"))
    head = F.concat(F.lit("<s>"), _line(F.col("who")), F.lit("\n"))
    plain = plain.withColumn("head", head).withColumn("body", escape(F.col("said")))
    plain = plain.withColumn("segment", F.concat("head", "body", F.lit(_END)))
    end = F.sum(F.length("segment").cast("long")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    placed = plain.select(
        "conv", (F.row_number().over(order) - 1).cast("long").alias("turn_no"), end.alias("end"), "head", "body", "segment", (F.col("who") == "assistant").alias("target")
    )
    begin = F.col("end") - F.length("segment")
    return placed.select(
        F.col("conv").alias(conversation),
        "turn_no",
        begin.alias("begin"),
        "segment",
        (begin + F.length("head")).alias("body_begin"),
        (begin + F.length("head") + F.length("body")).alias("body_end"),
        "target",
    )


def expand(segments: DataFrame, *, conversation: str = "conv_id", limit: int = WRITTEN, stretch: int = STRETCH) -> DataFrame:
    """One example per assistant turn: ``context`` is all that the conversation holds before the text of
    the turn, ``completion`` that text and its end.

    Offsets count the code points of the conversation: the context goes from ``context_begin`` (0) to
    ``context_end``, the first ``shared`` ones are the whole row before it, and the loss covers
    ``loss_begin`` to ``loss_end``. Turns that no answer follows are one row more, a context without
    completion, end and loss.

    Written out, contexts are quadratic in the turns of a conversation. Rows that begin in the same
    ``stretch`` code points are written by one task; it holds the turns up to there, spilled if need be,
    and one context at a time.

    A caller who wants rows linear in the turns instead gives a ``limit``: from the first turn that begins
    after that many code points each turn is a row, answer or not, whose context goes on from the end
    of the row before it (``context_begin`` is ``shared``); :func:`with_context` writes these out as
    well.
    """
    order = Window.partitionBy(conversation).orderBy("turn_no")
    end = F.col("begin") + F.length("segment")
    own = F.expr(f"begin div {int(stretch)}")
    placed = segments.select(
        "*",
        F.max(F.when(F.col("target") | (end > limit), end)).over(order.rowsBetween(Window.unboundedPreceding, -1)).alias("shared"),
        (F.col("target") | (end > limit) | F.lead("turn_no").over(order).isNull()).alias("kept"),
        own.alias("__own"),
        F.when(end <= limit, F.max(own).over(Window.partitionBy(conversation))).otherwise(own).alias("__last"),
    )
    # a named number of partitions is kept: their sizes tell little of the work, which is in the contexts
    n = int(segments.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = placed.select("*", F.explode(F.sequence("__own", "__last")).alias("__at")).repartition(n, conversation, "__at")
    earlier = Window.partitionBy(conversation, "__at").orderBy("turn_no").rowsBetween(Window.unboundedPreceding, -1)
    told = dealt.withColumn("told", F.collect_list(F.when(end <= limit, F.col("segment"))).over(earlier)).where("kept AND __own = __at")
    head = F.expr("substring(segment, 1, CAST(body_begin - begin AS INT))")
    tail = F.expr("substring(segment, CAST(body_begin - begin AS INT) + 1, length(segment))")
    goes_on = F.col("begin") > limit

    def of_answer(value: Column) -> Column:
        return F.when(F.col("target"), value)

    return told.select(
        conversation,
        F.col("turn_no").alias("example"),
        F.coalesce("shared", F.lit(0)).cast("long").alias("shared"),
        F.when(goes_on, F.col("begin")).otherwise(0).cast("long").alias("context_begin"),
        F.concat(F.when(goes_on, "").otherwise(F.array_join("told", "")), F.when(F.col("target"), head).otherwise(F.col("segment"))).alias("context"),
        of_answer(F.col("body_begin")).alias("context_end"),
        of_answer(tail).alias("completion"),
        of_answer(F.col("body_begin")).alias("loss_begin"),
        of_answer(F.col("body_end")).alias("loss_end"),
    )


def with_context(segments: DataFrame, examples: DataFrame, *, conversation: str = "conv_id") -> DataFrame:
    """Examples with every ``context`` from the beginning of its conversation, however long."""
    kept = [c for c in examples.columns if c not in ("context", "context_begin")]
    s, e = segments.alias("s"), examples.select(*kept).alias("e")
    earlier = e.join(s, F.expr(f"s.`{conversation}` <=> e.`{conversation}` AND s.turn_no <= e.example"))
    parts = F.sort_array(F.collect_list(F.struct("s.turn_no", "s.segment")))
    keys = [F.col(f"e.`{c}`") for c in kept]
    joined = earlier.groupBy(*keys).agg(F.array_join(F.transform(parts, lambda x: x["segment"]), "").alias("whole"))
    whole = F.expr("coalesce(substring(whole, 1, CAST(context_end AS INT)), whole)")
    return joined.select(*kept, F.lit(0).cast("long").alias("context_begin"), whole.alias("context"))


def read_examples(examples: DataFrame, *, conversation: str = "conv_id") -> DataFrame:
    """Turns and losses as the examples have them, in the columns of :func:`read_back` that :func:`digest` takes.

    Each example is read whole, context and completion. A turn is taken from the first example that holds
    it and a loss from the example it is the target of. The part of a context that repeats the row
    before it has to equal it, and one that goes on from there has to begin at its end; where that is
    not so, what the example adds has no place in the conversation, and its segments, roles and
    texts are null. So are role and text of what is no turn.
    """
    # counting code points is what takes time, so a context is cut once; what follows the cut is short
    cut = examples.select("*", F.expr("CAST(least(shared, coalesce(context_end, shared)) AS LONG)").alias("cut"))
    cut = cut.withColumn("front", F.expr("substring(context, 1, CAST(cut - context_begin AS INT))"))
    cut = cut.withColumn("back", F.expr("CAST(substring(CAST(context AS BINARY), octet_length(front) + 1) AS STRING)"))
    back = F.expr("coalesce(substring(back, 1, CAST(context_end - cut AS INT)), back)")
    whole = cut.withColumn("tail", F.concat(back, F.coalesce("completion", F.lit("")))).withColumn("whole", F.concat("front", "tail"))
    # else the context ends where it should not and ``front`` is not the part that is shared
    plain = (F.col("shared") == F.col("cut")) & (F.octet_length("back") > 0)
    loss = F.when(
        plain & (F.col("loss_begin") >= F.col("shared")), F.expr("substring(tail, CAST(loss_begin - shared AS INT) + 1, CAST(loss_end - loss_begin AS INT))")
    ).otherwise(F.expr("substring(whole, CAST(loss_begin - context_begin AS INT) + 1, CAST(loss_end - loss_begin AS INT))"))
    added = F.when(plain, F.col("tail")).otherwise(F.expr("substring(whole, CAST(shared - context_begin AS INT) + 1, length(whole))"))
    own = whole.select(
        conversation,
        "example",
        "context_begin",
        F.when(plain, F.col("shared") + F.length("tail")).otherwise(F.col("context_begin") + F.length("whole")).alias("end"),
        F.sha2(F.when(plain, F.col("front")).otherwise(F.expr("substring(whole, 1, CAST(shared - context_begin AS INT))")), 256).alias("repeated"),
        F.sha2("whole", 256).alias("held"),
        F.split(added, _END).alias("parts"),
        unescape(loss).alias("loss"),
    )
    order = Window.partitionBy(conversation).orderBy("example")
    same = F.col("repeated") == F.coalesce(F.lag("held").over(order), F.sha2(F.lit(""), 256))
    fits = F.when(F.col("context_begin") > 0, F.col("context_begin") == F.lag("end").over(order)).otherwise(same)
    own = own.select(conversation, "example", fits.alias("fits"), "parts", "loss")
    # what follows the end of the last turn is empty, or else a turn that was cut off
    turns = own.select("*", F.size("parts").alias("n"), F.posexplode("parts").alias("at", "part")).where("at < n - 1 OR part <> ''")
    closed = F.expr("at < n - 1")
    turns = turns.select(
        conversation,
        (F.col("example") - F.col("n") + 2 + F.col("at")).alias("turn_no"),
        F.when(F.col("fits"), F.concat("part", F.when(closed, _END).otherwise(""))).alias("segment"),
        F.when(F.expr("at = greatest(n - 2, 0)"), F.col("loss")).alias("loss"),
        (closed & F.col("part").startswith("<s>") & F.col("part").contains("\n")).alias("whole"),
    )
    role, text = (F.when(F.col("whole"), said) for said in _said())
    return turns.select(conversation, "turn_no", "segment", role.alias("role"), text.alias("text"), "loss")


def _said() -> tuple[Column, Column]:
    """Role and text of a written segment."""
    at = F.expr("instr(segment, '\\n')")
    role = unescape(F.expr("substring(segment, 4, instr(segment, '\\n') - 4)"))
    role = F.replace(F.replace(F.replace(role, F.lit("\\\\"), F.lit("\x00")), F.lit("\\n"), F.lit("\n")), F.lit("\x00"), F.lit("\\"))
    return role, unescape(F.substring("segment", at + 1, F.length("segment") - at - len(_END)))


def read_back(segments: DataFrame) -> DataFrame:
    """Role and text of each written segment, and the text under the loss mask (null if none)."""
    role, text = _said()
    masked = F.expr("substring(segment, CAST(body_begin - begin AS INT) + 1, CAST(body_end - body_begin AS INT))")
    return segments.select("*", role.alias("role"), text.alias("text"), F.when(F.col("target"), unescape(masked)).alias("loss"))


def digest(read: DataFrame, *, conversation: str = "conv_id") -> DataFrame:
    """Per conversation: turns, hashes and sizes of what was read back.

    A hash of a whole conversation needs its turns in order, but only one at a time: tasks stream
    through sorted rows and keep running hashes, so a conversation of any length fits. Where a turn
    could not be read (null) the hash of the turns is null, where its segment is not known the size.
    """
    rows = read.select(
        F.col(conversation).alias("conv"),
        "turn_no",
        F.concat("role", F.lit("\n"), "text", F.lit("\n")).alias("said"),
        "loss",
        F.length("segment").cast("long").alias("size"),
    )
    rows = rows.repartition("conv").sortWithinPartitions("conv", "turn_no")

    def run(batches):
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        current, state, kind = None, None, None

        def row():
            return (current[0], state[0], state[1] and state[1].hexdigest(), state[2], state[3].hexdigest(), state[4])

        def batch_of(out):
            cols = list(zip(*out, strict=True))
            kinds = [kind, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)

        for batch in batches:
            kind, out = batch.schema.field(0).type, []
            columns = [batch.column(i).to_pylist() for i in (0, 2, 3, 4)]
            for conv, said, loss, size in zip(*columns, strict=True):
                if current != (conv,):
                    if current is not None:
                        out.append(row())
                    current, state = (conv,), [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                state[0] += 1
                if said is None:
                    state[1] = None
                elif state[1]:
                    state[1].update(said.encode())
                if loss is not None:
                    state[2] += len(loss)
                    state[3].update(loss.encode())
                state[4] = None if size is None or state[4] is None else state[4] + size
            if out:
                yield batch_of(out)
        if current is not None:
            yield batch_of([row()])

    kind = read.schema[conversation].dataType.simpleString()
    return rows.mapInArrow(run, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
