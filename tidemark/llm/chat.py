"""Preference pairs as one prompt and two masked completions.

The longest common prefix of turns of the chosen and the rejected conversation is rendered once as the prompt; what follows
in either is its completion. A completion's mask holds the code point spans that are trained on: the bodies of assistant
turns with their end mark, not the role headers nor other roles' turns. Marks that occur in a text are broken up, so
a text can't forge a turn. Only DataFrame functions are used.

Defined cases: a null role or text is the empty one; equal conversations are all prompt and have empty completions; a
conversation that is the other's beginning has an empty completion; repeated rows of a turn count once, and of different rows of
one turn all stay, in order of role and text; rows with a null conversation id belong to no conversation and rows with a null turn come first. Other
columns are not looked at. A conversation's turns are gathered into one row, as its rendering is one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import let, running, table

START, END = "<|im_start|>", "<|im_end|>"
TRAINED_ROLE = "assistant"


def gathered(turns: DataFrame) -> DataFrame:
    """``(conv_id, turns array<struct<role, text>>)`` from ``turns(conv_id, turn, role, text)``."""
    rows = turns.where("conv_id is not null").select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).distinct()
    ordered = F.sort_array(F.collect_list(F.struct("turn", "role", "text")))
    return rows.groupBy("conv_id").agg(F.transform(ordered, lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))


def _plain(text: Column) -> Column:
    return F.replace(text, F.lit("<|"), F.lit("< |"))


def _head(turn: Column) -> Column:
    return F.concat(F.lit(START), _plain(turn["role"]), F.lit("\n"))


def _body(turn: Column) -> Column:
    return F.concat(_plain(turn["text"]), F.lit(END + "\n"))


def rendered(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(_head(t), _body(t))), "")


def mask(turns: Column) -> Column:
    """``array<struct<start, end>>`` of the trained code points in ``rendered(turns)``."""
    parts = F.transform(turns, lambda t: F.struct((t["role"] == TRAINED_ROLE).alias("own"), F.length(_head(t)).alias("head"), F.length(_body(t)).alias("body")))

    def placed(p: Column) -> Column:
        before = running(F.transform(p, lambda x: x["head"] + x["body"]), lambda a, x: a + x)
        span = lambda x, at: F.struct((at + x["head"]).alias("start"), (at + x["head"] + x["body"]).alias("end"), x["own"].alias("own"))
        every = let(before, lambda b: F.transform(p, lambda x, i: span(x, F.get(b, i))))
        return F.transform(F.filter(every, lambda s: s["own"]), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))

    return let(parts, placed)


def common_turns(a: Column, b: Column) -> Column:
    """Length of the longest common prefix of two arrays of turns."""
    n = F.least(F.size(a), F.size(b))
    same = F.transform(F.slice(a, 1, n), lambda t, i: t.eqNullSafe(F.get(b, i)))
    at = F.array_position(same, F.lit(False)).cast("int")
    return F.when(at > 0, at - 1).otherwise(n)


def format_preferences(pairs: DataFrame) -> DataFrame:
    """One row for each of ``pairs(pair_id, chosen, rejected)``, both arrays of ``struct<role, text>``."""
    known = pairs.select("pair_id", *(F.coalesce(c, F.array().cast("array<struct<role:string,text:string>>")).alias(c) for c in ("chosen", "rejected")))
    cut = known.withColumn("shared", common_turns(F.col("chosen"), F.col("rejected")))
    rest = lambda c: F.slice(c, F.col("shared") + 1, F.greatest(F.size(c) - F.col("shared"), F.lit(0)))
    cut = cut.select("pair_id", "shared", F.slice("chosen", 1, F.col("shared")).alias("prompt"), rest("chosen").alias("chosen"), rest("rejected").alias("rejected"))
    return cut.select(
        "pair_id", F.col("shared").alias("n_prompt_turns"), rendered(F.col("prompt")).alias("prompt"),
        rendered(F.col("chosen")).alias("chosen"), mask(F.col("chosen")).alias("chosen_mask"),
        rendered(F.col("rejected")).alias("rejected"), mask(F.col("rejected")).alias("rejected_mask"),
    )


def last_replies(turns: DataFrame) -> DataFrame:
    """``(conv_id, reply)``: the last assistant turn of each conversation that has one, as ``struct<role, text>``."""
    text = F.coalesce("text", F.lit(""))
    last = turns.where((F.col("role") == TRAINED_ROLE) & F.col("conv_id").isNotNull()).groupBy("conv_id").agg(F.max(F.struct("turn", text.alias("text"))).alias("t"))
    return last.select("conv_id", F.struct(F.lit(TRAINED_ROLE).alias("role"), F.col("t.text").alias("text")).alias("reply"))


def next_ids(ids: DataFrame, rows: int = 65536) -> DataFrame:
    """``(conv_id, next)``: the next id of distinct ones, the least after the greatest.

    Ids are parted into ranges of about ``rows`` of them; a range's last id is followed by the first of the next filled range,
    which is looked up among a row for each range.
    """
    known = ids.agg(F.min("conv_id").alias("a"), F.max("conv_id").alias("b"), F.count("*").alias("n")).first()
    width = max(1, (known["b"] - known["a"] + 1) * rows // known["n"]) if known["n"] else 1
    parted = ids.select("conv_id", F.floor(F.col("conv_id") / F.lit(width)).alias("part"))
    inside = parted.withColumn("own", F.lead("conv_id").over(Window.partitionBy("part").orderBy("conv_id")))
    heads = parted.groupBy("part").agg(F.min("conv_id").alias("head"))
    order = Window.orderBy("part")
    after = heads.select("part", F.coalesce(F.lead("head").over(order), F.first("head").over(order)).alias("after"))
    return inside.join(after, "part").select("conv_id", F.coalesce("own", "after").alias("next"))


def with_other_reply(turns: DataFrame) -> DataFrame:
    """``(pair_id, chosen, rejected)`` of each conversation with a reply: up to its last reply, and with the last reply of the next one instead.

    A corpus of plain conversations has no rejected side; a reply from elsewhere is the usual negative. The next conversation is the one
    with the next id that has a reply, the first one after the last. What follows the last reply is left out. Conversations
    without a reply, and those whose next reply is the same, give no pair.
    """
    replies = last_replies(turns)
    other = next_ids(replies.select("conv_id")).join(replies.select(F.col("conv_id").alias("next"), F.col("reply").alias("other")), "next")
    at = F.size("turns") + 1 - F.array_position(F.reverse(F.transform("turns", lambda t: t["role"] == TRAINED_ROLE)), F.lit(True)).cast("int")
    ended = gathered(turns).join(other.select("conv_id", "other"), "conv_id").select("conv_id", F.slice("turns", 1, at).alias("chosen"), "other")
    swapped = F.concat(F.slice("chosen", 1, F.size("chosen") - 1), F.array("other"))
    return ended.where(F.element_at("chosen", -1)["text"] != F.col("other.text")).select(F.col("conv_id").alias("pair_id"), "chosen", swapped.alias("rejected"))


def spans(mask_col: str) -> Column:
    return F.array_join(F.transform(mask_col, lambda s: F.concat_ws(":", s["start"], s["end"])), ",")


def op7_preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = format_preferences(with_other_reply(table(spark, sf_dir, "conversations")))
    return out.select("pair_id", "n_prompt_turns", "prompt", "chosen", spans("chosen_mask").alias("chosen_mask"), "rejected", spans("rejected_mask").alias("rejected_mask"))


SQL = """
with t as (
  select conv_id, turn, coalesce(role, '') role, coalesce(text, '') "text" from (select distinct conv_id, turn, role, "text" from conversations) where conv_id is not null
), g as (
  select conv_id, list({'role': role, 'text': "text"} order by turn nulls first, role, "text") turns from t group by 1
), h as (
  select conv_id, turns[:list_filter(range(1, len(turns) + 1), lambda i: turns[i].role = 'assistant')[-1]] turns
  from g where len(list_filter(turns, lambda x: x.role = 'assistant')) > 0
), o as (
  select conv_id, turns, coalesce(lead(turns[-1]) over (order by conv_id), first_value(turns[-1]) over (order by conv_id)) other from h
), p as (
  select conv_id pair_id, turns chosen, list_concat(turns[:-2], [other]) rejected from o where turns[-1]."text" <> other."text"
), c as (
  select *, least(len(chosen), len(rejected)) n from p
), d as (
  select *, coalesce(list_min(list_filter(range(1, n + 1), lambda i: chosen[i] is distinct from rejected[i])) - 1, n)::int k from c
), e as (
  select pair_id, k, chosen[:k] a, chosen[k + 1:] b, rejected[k + 1:] r from d
), f as (
  select pair_id, k,
    list_transform(a, lambda x: '<|im_start|>' || replace(x.role, '<|', '< |') || chr(10) || replace(x."text", '<|', '< |') || '<|im_end|>' || chr(10)) a,
    list_transform(b, lambda x: {'t': x.role = 'assistant', 'h': '<|im_start|>' || replace(x.role, '<|', '< |') || chr(10), 'b': replace(x."text", '<|', '< |') || '<|im_end|>' || chr(10)}) b,
    list_transform(r, lambda x: {'t': x.role = 'assistant', 'h': '<|im_start|>' || replace(x.role, '<|', '< |') || chr(10), 'b': replace(x."text", '<|', '< |') || '<|im_end|>' || chr(10)}) r
  from e
)
select pair_id, k n_prompt_turns, coalesce(array_to_string(a, ''), '') prompt,
  coalesce(array_to_string(list_transform(b, lambda x: x.h || x.b), ''), '') chosen,
  coalesce(array_to_string(list_transform(list_filter(range(1, len(b) + 1), lambda i: b[i].t), lambda i:
    (coalesce(list_sum(list_transform(b[:i - 1], lambda x: length(x.h || x.b))), 0) + length(b[i].h))::bigint || ':' ||
    (list_sum(list_transform(b[:i], lambda x: length(x.h || x.b))))::bigint), ','), '') chosen_mask,
  coalesce(array_to_string(list_transform(r, lambda x: x.h || x.b), ''), '') rejected,
  coalesce(array_to_string(list_transform(list_filter(range(1, len(r) + 1), lambda i: r[i].t), lambda i:
    (coalesce(list_sum(list_transform(r[:i - 1], lambda x: length(x.h || x.b))), 0) + length(r[i].h))::bigint || ':' ||
    (list_sum(list_transform(r[:i], lambda x: length(x.h || x.b))))::bigint), ','), '') rejected_mask
from f
"""
