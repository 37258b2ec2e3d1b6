"""Preference formatting: one prompt, two masked completions.

The longest common turn prefix of a chosen and a rejected conversation is
rendered once, as the prompt; what follows in either becomes a completion with
the spans of it that a model is trained on. All of it is DataFrame operations.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F


@dataclass(frozen=True)
class Template:
    """A turn is open + role + after_role + text + close; ``trained`` roles are not masked."""
    open: str = "<|im_start|>"
    after_role: str = "\n"
    close: str = "<|im_end|>\n"
    trained: tuple[str, ...] = ("assistant",)

    def turn(self, role: Column, text: Column) -> Column:
        return F.concat(F.lit(self.open), role, F.lit(self.after_role), text, F.lit(self.close))

    def lead(self, role: Column) -> Column:
        """Characters of a rendered turn before its text."""
        return F.lit(len(self.open) + len(self.after_role)) + F.length(role)


def _turns(turns: DataFrame, side: str, pair: str, turn: str, role: str, text: str) -> DataFrame:
    order = Window.partitionBy("pair").orderBy("at", "role", "text")
    plain = turns.select(F.col(pair).alias("pair"), F.col(turn).alias("at"),
                         F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"),
                         F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    return (plain.filter("pair is not null").withColumn("place", F.row_number().over(order))
            .select("pair", "place", F.struct("role", "text").alias(side)))


def preference_pairs(chosen: DataFrame, rejected: DataFrame, pair_col: str = "pair_id", turn_col: str = "turn",
                     role_col: str = "role", text_col: str = "text", template: Template = Template()) -> DataFrame:
    """One row per pair of two turn tables (pair, turn, role, text).

    Returns the pair, prompt, chosen, rejected, chosen_spans and rejected_spans
    ("start-end,..." in characters of the completion: the texts and ends of
    trained turns; everything else, the prompt included, is masked) and the
    numbers of turns. Turns count as common if role and text are equal; null
    roles and texts are empty. Turns are ordered by turn (null first), then role
    and text, so repeated turns have a fixed order. A pair on one side only has
    an empty other completion and an empty prompt; rows without a pair are left
    out; an empty table gives no rows.
    """
    both = _turns(chosen, "c", pair_col, turn_col, role_col, text_col).join(
        _turns(rejected, "r", pair_col, turn_col, role_col, text_col), ["pair", "place"], "full")
    parting = both.groupBy("pair").agg(
        F.min(F.when(~F.col("c").eqNullSafe(F.col("r")), F.col("place"))).alias("parting"))
    marked = both.join(parting, "pair").withColumn(
        "common", F.col("parting").isNull() | (F.col("place") < F.col("parting")))
    sides = marked.select(
        "pair", "place", "common",
        F.explode(F.when(F.col("common"), F.array(F.struct(F.lit("p").alias("side"), F.col("c").alias("turn"))))
                  .otherwise(F.array(F.struct(F.lit("c").alias("side"), F.col("c").alias("turn")),
                                     F.struct(F.lit("r").alias("side"), F.col("r").alias("turn"))))).alias("x"))
    sides = sides.select("pair", "place", "x.side", F.col("x.turn.role").alias("role"),
                         F.col("x.turn.text").alias("text")).filter("text is not null")
    sides = sides.withColumn("piece", template.turn(F.col("role"), F.col("text")))
    before = Window.partitionBy("pair", "side").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    sides = sides.withColumn("start", F.coalesce(F.sum(F.length("piece")).over(before), F.lit(0)))
    span = F.when(F.col("role").isin(*template.trained), F.concat_ws(
        "-", (F.col("start") + template.lead(F.col("role"))).cast("string"),
        (F.col("start") + F.length("piece")).cast("string")))

    def joined(side: str, value: str, by: str) -> Column:
        parts = F.sort_array(F.collect_list(F.when((F.col("side") == side) & F.col(value).isNotNull(),
                                                   F.struct("place", value))))
        return F.array_join(F.transform(parts, lambda p: p[value]), by)

    def turns(side: str) -> Column:
        return F.count(F.when(F.col("side") == side, 1))

    return sides.withColumn("span", span).groupBy("pair").agg(
        joined("p", "piece", "").alias("prompt"), joined("c", "piece", "").alias("chosen"),
        joined("r", "piece", "").alias("rejected"), joined("c", "span", ",").alias("chosen_spans"),
        joined("r", "span", ",").alias("rejected_spans"), turns("p").alias("n_prompt_turns"),
        turns("c").alias("n_chosen_turns"), turns("r").alias("n_rejected_turns")
    ).withColumnRenamed("pair", pair_col)


def echo_negatives(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn",
                   role_col: str = "role", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Chosen and rejected turns from plain conversations.

    Chosen is a conversation up to its last assistant turn; in rejected that turn
    only repeats the turn before it. Turns without a number come first, as in
    ``preference_pairs``; both sides are numbered by place. Conversations without an
    assistant turn are left out, as there is nothing to prefer.
    """
    whole = Window.partitionBy(conv_col)
    order = whole.orderBy(turn_col, role_col, text_col)
    assistant = F.col(role_col) == "assistant"
    placed = turns.filter(F.col(conv_col).isNotNull()).select(
        F.col(conv_col).alias("pair_id"), F.row_number().over(order).alias("turn"), F.col(role_col).alias("role"),
        F.col(text_col).alias("text"), F.lag(text_col).over(order).alias("before"), F.col(turn_col).alias("number"),
        F.max(F.when(assistant, F.col(turn_col))).over(whole).alias("last"))
    # Turns that share the last number are all kept; the last place tells only where no assistant turn has one.
    marked = placed.withColumn("last_place", F.max(F.when(F.col("role") == "assistant", F.col("turn"))).over(
        Window.partitionBy("pair_id")))
    kept = marked.filter((F.col("turn") <= F.col("last_place")) | (F.col("number") <= F.col("last")))
    ends = F.when(F.col("last").isNull(), F.col("turn") == F.col("last_place")).otherwise(
        F.coalesce(F.col("number") == F.col("last"), F.lit(False)))
    echoed = F.when(ends & (F.col("role") == "assistant"), F.coalesce("before", F.lit(""))).otherwise(F.col("text"))
    columns = ["pair_id", "turn", "role"]
    return kept.select(*columns, "text"), kept.select(*columns, echoed.alias("text"))
