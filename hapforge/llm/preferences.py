"""Preference formatting: shared prompt, paired completions, and what of them is trained on.

The turns that a chosen and a rejected conversation share from the start (role and text equal) are
rendered once as the prompt; the rest of each is rendered as its completion. In a completion only the
texts of assistant turns and the end marks after them are trained; the mask lists them as spans of
code points.

Everything is array functions on one row a pair; no Python runs on the executors.

Defined results: a null role or text counts as empty. Turns come in the order of their number (nulls
first), role and text; equal rows are one turn. A null conversation identifier is one conversation.
Conversations of one turn or none are pairs like any other: what is shared is prompt, what isn't is
completion, and either may be empty. One without an answer is all prompt. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hapforge.shared import materialize

#: Fixed marks around a turn.
HEAD, TAIL, END = "<|", "|>\n", "<|end|>\n"
TRAINED = "assistant"

TURN = "struct<turn: bigint, role: string, text: string>"


def turns_of(rows: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, turns) with the turns of each conversation in order. Copies of a turn collapse before the shuffle."""
    turn = F.struct(
        F.col(turn_col).cast("long").alias("turn"), F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")
    )
    return rows.select(F.col(id_col).cast("long").alias("conv_id"), turn.alias("t")).groupBy("conv_id").agg(F.array_sort(F.collect_set("t")).alias("turns"))


def common_turns(a: Column, b: Column) -> Column:
    """How many turns both start with; roles and texts count, numbers don't."""
    shared = F.least(F.size(a), F.size(b))
    same = F.zip_with(F.slice(a, 1, F.greatest(shared, F.lit(0))), F.slice(b, 1, F.greatest(shared, F.lit(0))), lambda x, y: (x.role == y.role) & (x.text == y.text))
    first = F.array_position(same, F.lit(False))
    return F.when(first > 0, first.cast("int") - 1).otherwise(shared)


def rendered(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit(HEAD), t.role, F.lit(TAIL), t.text, F.lit(END))), "")


def trained_spans(turns: Column) -> Column:
    """[(start, end)) of assistant texts with their end marks in the rendered turns, in code points."""
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start: int, end: int>>").alias("spans"))

    def step(acc: Column, t: Column) -> Column:
        start = acc.at + F.length(t.role) + F.lit(len(HEAD) + len(TAIL))
        end = start + F.length(t.text) + F.lit(len(END))
        span = F.array(F.struct(start.alias("start"), end.alias("end")))
        return F.struct(end.alias("at"), F.when(t.role == TRAINED, F.concat(acc.spans, span)).otherwise(acc.spans).alias("spans"))

    return F.aggregate(turns, zero, step, lambda acc: acc.spans)


def format_pairs(pairs: DataFrame, chosen: str = "chosen", rejected: str = "rejected") -> DataFrame:
    """``pairs`` with arrays of turns under two names -> the other columns and n_prompt_turns, prompt, and for either side completion and mask."""
    keep = [c for c in pairs.columns if c not in (chosen, rejected)]
    rest = lambda c: F.slice(F.col(c), F.col("__n") + 1, F.greatest(F.size(c) - F.col("__n"), F.lit(0)))
    with_n = pairs.withColumn("__n", common_turns(F.col(chosen), F.col(rejected)))
    return with_n.select(
        *keep, F.col("__n").cast("long").alias("n_prompt_turns"), rendered(F.slice(F.col(chosen), F.lit(1), F.col("__n"))).alias("prompt"),
        rendered(rest(chosen)).alias("chosen_completion"), trained_spans(rest(chosen)).alias("chosen_mask"),
        rendered(rest(rejected)).alias("rejected_completion"), trained_spans(rest(rejected)).alias("rejected_mask"),
    )


def exchange_answers(conversations: DataFrame) -> DataFrame:
    """(conv_id, chosen, rejected) from (conv_id, turns): a conversation, and the same with another one's turns from some answer on.

    The answer is the (conv_id mod answers)-th, so pairs part early and late. What follows in the
    rejected side are the turns of the neighbour, whose identifier differs in the lowest bit, from its
    own such answer to its end. Without a neighbour that answers, the rejected side ends before the
    answer; a conversation without any answer is the same on both sides. No turn is left out: every
    conversation is the chosen side of its row as it is.
    """
    places = F.filter(F.sequence(F.lit(1), F.greatest(F.size("turns"), F.lit(1))), lambda i: F.coalesce(F.get(F.col("turns"), i - 1).role == TRAINED, F.lit(False)))
    nth = F.coalesce(F.pmod(F.col("conv_id"), F.when(F.size("places") > 0, F.size("places"))), F.lit(0)).cast("int")
    parted = conversations.withColumn("places", places).withColumn("at", F.get(F.col("places"), nth)).drop("places")
    rest = F.slice("turns", F.col("at"), F.greatest(F.size("turns") - F.col("at") + 1, F.lit(0)))
    other = parted.where("at IS NOT NULL").select(F.col("conv_id").bitwiseXOR(F.lit(1)).alias("__id"), rest.alias("__rest"))
    joined = parted.join(other, F.col("conv_id") == F.col("__id"), "left")
    head = F.slice("turns", F.lit(1), F.coalesce(F.col("at") - 1, F.size("turns")))
    rejected = F.when(F.col("at").isNotNull() & F.col("__rest").isNotNull(), F.concat(head, "__rest")).otherwise(head)
    return joined.select("conv_id", F.col("turns").alias("chosen"), rejected.alias("rejected"))


def preference_rows(rows: DataFrame) -> DataFrame:
    """Pairs made from a table of turns, formatted."""
    return format_pairs(exchange_answers(materialize(turns_of(rows), "turns")))
