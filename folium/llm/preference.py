"""Preference formatting: a shared prompt and two masked completions from paired conversations.

A pair is a chosen and a rejected conversation.  Their longest common prefix of turns (same role,
same text) is rendered once as the prompt; what follows on each side is a completion, with the
character spans a loss applies to (what the assistant wrote, and its end marker).

One aggregation by pair brings a pair's turns together; a conversation is a row of the result, so a
group is never larger than what the result holds.

Cases: null role or text counts as empty; turns are ordered by number, then role, then text, nulls
first, and repeated turns stay; a pair of which one side is missing has an empty prompt; equal
conversations give empty completions; a null pair key is a pair of its own; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

END = "<|end|>"


def render_turn(turn: Column) -> Column:
    return F.concat(F.lit("<|"), turn["role"], F.lit("|>\n"), turn["text"], F.lit(END + "\n"))


def render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, render_turn), "")


def loss_spans(turns: Column, role: str = "assistant") -> Column:
    """[start, end) in characters of the rendered turns, for what ``role`` wrote."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,stop:int>>").alias("spans"))

    def step(acc: Column, turn: Column) -> Column:
        head = F.char_length(turn["role"]) + F.lit(5)
        body = F.char_length(turn["text"]) + F.lit(len(END))
        first = (acc["at"] + head).cast("int")
        span = F.struct(first.alias("start"), (first + body).cast("int").alias("stop"))
        return F.struct(
            (acc["at"] + head + body + F.lit(1)).cast("int").alias("at"),
            F.when(turn["role"] == role, F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"]).alias("spans"),
        )

    return F.aggregate(turns, start, step, lambda acc: acc["spans"])


def format_preferences(chosen: DataFrame, rejected: DataFrame, pair: str = "pair_id") -> DataFrame:
    """Tables of turns (pair, turn, role, text) -> one row per pair.

    prompt, prompt_turns, chosen, rejected, chosen_spans, rejected_spans, complete (both sides
    present), same (the conversations do not differ).
    """
    empty = F.lit("")
    columns = lambda d, side: d.select(
        F.col(pair).alias("pair_id"), F.lit(side).alias("side"), F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role"), empty).alias("role"), F.coalesce(F.col("text"), empty).alias("text"),
    )
    both = columns(chosen, 0).unionByName(columns(rejected, 1))
    listed = both.groupBy("pair_id").agg(F.array_sort(F.collect_list(F.struct("side", "turn", "role", "text"))).alias("all"))
    of = lambda side: F.transform(F.filter("all", lambda t: t["side"] == side), lambda t: F.struct(t["role"], t["text"]))
    sides = listed.select("pair_id", of(0).alias("c"), of(1).alias("r"))
    differs = F.array_position(F.zip_with("c", "r", lambda x, y: x.eqNullSafe(y)), False)
    shared = F.when(differs > 0, differs - 1).otherwise(F.size("c")).cast("int")
    cut = sides.withColumn("shared", shared).withColumn("prompt", F.slice("c", 1, F.col("shared")))
    rest = lambda name: F.slice(name, F.col("shared") + 1, F.size(name))
    cut = cut.withColumn("c_rest", rest("c")).withColumn("r_rest", rest("r"))
    return cut.select(
        "pair_id",
        F.col("shared").cast("long").alias("prompt_turns"),
        render(F.col("prompt")).alias("prompt"),
        render(F.col("c_rest")).alias("chosen"),
        render(F.col("r_rest")).alias("rejected"),
        loss_spans(F.col("c_rest")).alias("chosen_spans"),
        loss_spans(F.col("r_rest")).alias("rejected_spans"),
        ((F.size("c") > 0) & (F.size("r") > 0)).alias("complete"),
        ((F.size("c_rest") == 0) & (F.size("r_rest") == 0)).alias("same"),
    )


def spans_text(spans: Column) -> Column:
    """Spans as ``start-stop`` pairs joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat(s["start"].cast("string"), F.lit("-"), s["stop"].cast("string"))), ",")
