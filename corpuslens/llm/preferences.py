"""Preference formatting: the longest common turn prefix of a chosen and a rejected conversation
is rendered once as the prompt; what follows in each is its completion, with the spans of the
assistant's turns that the loss may see.  Everything else is masked.

Defined results: turns are ordered by turn, then role, then text; repeated rows stay.  A null role
reads `unknown`, a null text is empty.  Turns of a null conv_id belong to no conversation.  Two
conversations that are equal, or of which one is the other's prefix, give an empty completion.
An empty table gives an empty result; other columns are not read.  A conversation of any length is
one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def gathered(turns: DataFrame) -> DataFrame:
    """(conv_id, turns: array<struct<role, text>>) of rows (conv_id, turn, role, text)."""
    row = F.struct("turn", F.coalesce("role", F.lit("unknown")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    got = turns.where("conv_id is not null").groupBy("conv_id").agg(F.array_sort(F.collect_list(row)).alias("t"))
    return got.select("conv_id", F.transform("t", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text"))).alias("turns"))


def head(turn: Column) -> Column:
    return F.concat(F.lit("<|"), turn["role"], F.lit("|>\n"))


def body(turn: Column) -> Column:
    return F.concat(turn["text"], F.lit("<|end|>\n"))


def rendered(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda x: F.concat(head(x), body(x))), "")


def seen_spans(turns: Column) -> Column:
    """start:end of each assistant turn's text and end mark in the rendered turns, comma-joined; code points."""
    done = F.aggregate(
        turns,
        F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("spans")),
        lambda a, x: F.struct(
            (a["at"] + F.length(head(x)) + F.length(body(x))).alias("at"),
            F.when(
                x["role"] == "assistant",
                F.concat(a["spans"], F.array(F.concat((a["at"] + F.length(head(x))).cast("string"), F.lit(":"), (a["at"] + F.length(head(x)) + F.length(body(x))).cast("string")))),
            )
            .otherwise(a["spans"])
            .alias("spans"),
        ),
    )
    return F.array_join(done["spans"], ",")


def formatted(pairs: DataFrame) -> DataFrame:
    """(pair_id, n_prompt_turns, prompt, chosen, rejected, chosen_spans, rejected_spans).

    pairs: (pair_id, chosen, rejected), both arrays of struct<role, text>.
    """
    shorter = F.least(F.size("chosen"), F.size("rejected"))
    differ = F.array_position(F.zip_with(F.slice("chosen", F.lit(1), shorter), F.slice("rejected", F.lit(1), shorter), lambda a, b: a.eqNullSafe(b)), False)
    common = F.when(differ > 0, differ - 1).otherwise(shorter).cast("int")
    pairs = pairs.withColumn("n_prompt_turns", common)
    rest = lambda c: F.slice(c, F.col("n_prompt_turns") + 1, F.greatest(F.size(c), F.lit(1)))
    return pairs.select(
        "pair_id",
        "n_prompt_turns",
        rendered(F.slice("chosen", 1, F.col("n_prompt_turns"))).alias("prompt"),
        rendered(rest("chosen")).alias("chosen"),
        rendered(rest("rejected")).alias("rejected"),
        seen_spans(rest("chosen")).alias("chosen_spans"),
        seen_spans(rest("rejected")).alias("rejected_spans"),
    )


def neighbour_branches(turns: DataFrame) -> DataFrame:
    """(pair_id, chosen, rejected): each conversation, and a branch of it that goes on as another does.

    The branch keeps the first conv_id mod (turns + 1) turns; what the neighbour (conv_id with the
    lowest bit flipped) has after as many turns follows.  So the two part at any turn, at once, at the
    end or never, and a branch may be the longer or the shorter one.  Without a neighbour nothing follows.
    """
    mine = gathered(turns)
    other = mine.select(F.col("conv_id").bitwiseXOR(F.lit(1)).alias("conv_id"), F.col("turns").alias("other"))
    kept = F.pmod("conv_id", F.size("turns") + 1).cast("int")
    rest = F.slice("other", kept + 1, F.greatest(F.size("other"), F.lit(1)))
    return mine.join(other, "conv_id", "left").select(
        F.col("conv_id").alias("pair_id"),
        F.col("turns").alias("chosen"),
        F.concat(F.slice("turns", F.lit(1), kept), F.coalesce(rest, F.array().cast(mine.schema["turns"].dataType))).alias("rejected"),
    )
