"""Preference formatting: the common turns of a chosen and a rejected conversation, once, as a prompt.

For a pair of conversations the longest common prefix of turns (same role and text) is rendered as the
prompt; the turns after it become the two completions, each with a mask: the character spans, from 0
and end-exclusive, of the assistant turns' contents with their end mark. Only those count in training.

A turn is rendered as ``<|im_start|>role\\ntext<|im_end|>\\n``; ``<|`` inside a text becomes ``< |``, so
that no text can forge a mark.

Defined cases: a null role or text is an empty one; turns are ordered by turn (null first), then role,
then text, and repeated turns stay; two equal conversations have empty completions and masks; a pair
without a rejected conversation has a null rejected id, an empty prompt, its chosen turns as the
completion, and a null rejected completion and mask; a null conv_id is a conversation of its own;
an empty table gives no rows; further columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickforge.llm._common import materialize, ranked, read

BEGIN, END = "<|im_start|>", "<|im_end|>\n"
TURN = "struct<turn:bigint,role:string,text:string>"


def conversations(turns: DataFrame) -> DataFrame:
    """conv_id, turns: a row per conversation, its turns in order."""
    clean = F.replace(F.coalesce("text", F.lit("")), F.lit("<|"), F.lit("< |"))
    one = F.struct(F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), clean.alias("text"))
    return turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(one)).alias("turns"))


def common_turns(a: Column, b: Column) -> Column:
    """The number of turns at the start of both that agree in role and text."""
    agree = F.zip_with(a, b, lambda x, y: F.coalesce((x["role"] == y["role"]) & (x["text"] == y["text"]), F.lit(False)))
    miss = F.array_position(agree, False)
    return F.when(miss == 0, F.size(agree)).otherwise(miss - 1).cast("int")


def rendered(turns: Column) -> Column:
    one = F.transform(turns, lambda t: F.concat(F.lit(BEGIN), t["role"], F.lit("\n"), t["text"], F.lit(END)))
    return F.array_join(one, "")


def masked(turns: Column, trained: str = "assistant") -> Column:
    """The spans of what a model is trained on, as array<struct<begin, end>>."""
    head = lambda t: F.char_length(t["role"]) + (len(BEGIN) + 1)
    body = lambda t: F.char_length(t["text"]) + len(END)
    none = F.array().cast("array<struct<begin:int,end:int>>")

    def step(acc, t):
        begin = acc["at"] + head(t)
        span = F.struct(begin.alias("begin"), (begin + body(t) - 1).alias("end"))  # without the last newline
        spans = F.when(t["role"] == trained, F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"])
        return F.struct((begin + body(t)).alias("at"), spans.alias("spans"))

    start = F.struct(F.lit(0).alias("at"), none.alias("spans"))
    return F.aggregate(turns, start, step, lambda acc: acc["spans"])


def format_preferences(pairs: DataFrame, convs: DataFrame) -> DataFrame:
    """pairs(chosen_id, rejected_id), convs(conv_id, turns) -> a row per pair with its prompt and completions."""
    side = lambda name: convs.select(F.col("conv_id").alias(f"{name}_conv"), F.col("turns").alias(f"{name}_turns"))
    both = pairs
    for name in ("chosen", "rejected"):
        other = side(name)
        # A missing rejected id finds no partner; a null conv_id is matched as a value by its flag.
        fits = F.col(f"{name}_id").eqNullSafe(F.col(f"{name}_conv"))
        fits = fits & F.col("paired") if name == "rejected" else fits
        both = both.join(other, fits, "left").drop(f"{name}_conv")
    a, b = F.col("chosen_turns"), F.col("rejected_turns")
    both = both.withColumn("n_common", F.when(b.isNull(), 0).otherwise(common_turns(a, b)))
    rest = lambda t: F.slice(t, F.col("n_common") + 1, F.greatest(F.size(t), F.lit(0)))
    return both.select(
        "chosen_id", "rejected_id", "paired", "n_common",
        rendered(F.slice(a, F.lit(1), F.col("n_common"))).alias("prompt"),
        rendered(rest(a)).alias("chosen"), rendered(rest(b)).alias("rejected"),
        masked(rest(a)).alias("chosen_mask"), masked(rest(b)).alias("rejected_mask"),
    )


def pairs_by_opening(convs: DataFrame) -> DataFrame:
    """Pairs each conversation with another that opens with the same turn, while there are two.

    Within an opening, conversations in hash order alternate as chosen and rejected; those left over,
    one of each odd group, are paired with each other in the same way, and one at most stays single.
    """
    digest = lambda c: F.conv(F.substring(F.md5(c), 1, 8), 16, 10).cast("long")
    first = F.element_at("turns", 1)
    base = materialize(convs.select(
        "conv_id",
        F.md5(F.concat(first["role"], F.lit("\n"), first["text"])).alias("opening"),
        digest(F.coalesce(F.col("conv_id").cast("string"), F.lit(""))).alias("h"),
    ))
    sizes = base.groupBy("opening").agg(F.count(F.lit(1)).alias("n"))
    total = base.count()
    placed = materialize(ranked(base, ["opening"], "h", ["conv_id"], "place", total).join(sizes, "opening"))
    single = (F.col("place") == F.col("n") - 1) & (F.col("n") % 2 == 1)
    left = materialize(placed.where(single).select(F.lit("").alias("opening"), "conv_id", "h"))
    left = ranked(left, ["opening"], "h", ["conv_id"], "place", left.count())
    placed = placed.where(~single).select("opening", "conv_id", "h", "place").unionByName(left.select("opening", "conv_id", "h", "place"))
    couple = placed.groupBy("opening", F.floor(F.col("place") / 2).alias("pair")).agg(
        F.min(F.struct("place", "conv_id"))["conv_id"].alias("chosen_id"),
        F.max(F.struct("place", "conv_id"))["conv_id"].alias("last"),
        (F.count(F.lit(1)) == 2).alias("paired"),
    )
    return couple.select("chosen_id", F.when(F.col("paired"), F.col("last")).alias("rejected_id"), "paired")


def op10_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    convs = materialize(conversations(read(spark, sf_dir, "conversations")))
    made = format_preferences(pairs_by_opening(convs), convs)
    spans = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws("-", s["begin"].cast("string"), s["end"].cast("string"))), ",")
    return made.select(
        "chosen_id", "rejected_id", "n_common", "prompt", "chosen", "rejected",
        spans(F.col("chosen_mask")).alias("chosen_mask"), spans(F.col("rejected_mask")).alias("rejected_mask"),
    )


ORACLE = r"""
with t as (
  select conv_id, turn, coalesce(role, '') as role, replace(coalesce(text, ''), '<|', '< |') as text from conversations),
numbered as (
  select *, row_number() over (partition by conv_id order by turn nulls first, encode(role), encode(text)) as k from t),
heads as (
  select conv_id, md5(role || chr(10) || text) as opening,
    ('0x' || substr(md5(coalesce(conv_id::varchar, '')), 1, 8))::bigint as h
  from numbered where k = 1),
ranks as (
  select *, row_number() over (partition by opening order by h, conv_id) - 1 as place, count(*) over (partition by opening) as n
  from heads),
sides as (
  select opening, conv_id, place from ranks where not (place = n - 1 and n % 2 = 1)
  union all
  select '', conv_id, row_number() over (order by h, conv_id) - 1 from ranks where place = n - 1 and n % 2 = 1),
pairs as (
  select arg_min(conv_id, place) as chosen_id, case when count(*) = 2 then arg_max(conv_id, place) end as rejected_id
  from sides group by opening, place // 2),
lengths as (select conv_id, max(k) as n from numbered group by conv_id),
agree as (
  select p.chosen_id, coalesce(min(case when a.role is distinct from b.role or a.text is distinct from b.text then a.k end) - 1,
    max(a.k)) as n_common
  from pairs p join numbered a on a.conv_id = p.chosen_id left join numbered b on b.conv_id = p.rejected_id and b.k = a.k
  group by p.chosen_id),
cut as (
  select p.*, case when p.rejected_id is null then 0 else a.n_common end as n_common from pairs p join agree a using (chosen_id)),
shown as (
  select conv_id, k, role, '<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10) as r,
    length(role) + 13 as head, length(text) + 11 as body
  from numbered),
part as (
  select c.chosen_id, 'chosen' as side, s.*, s.k <= c.n_common as shared from cut c join shown s on s.conv_id = c.chosen_id
  union all
  select c.chosen_id, 'rejected', s.*, s.k <= c.n_common from cut c join shown s on s.conv_id = c.rejected_id),
spans as (
  select *, coalesce(sum(head + body) over (partition by chosen_id, side, shared order by k
    rows between unbounded preceding and 1 preceding), 0) + head as b from part),
texts as (
  select chosen_id, coalesce(string_agg(r, '' order by k) filter (side = 'chosen' and shared), '') as prompt,
    coalesce(string_agg(r, '' order by k) filter (side = 'chosen' and not shared), '') as chosen,
    coalesce(string_agg(r, '' order by k) filter (side = 'rejected' and not shared), '') as rejected,
    coalesce(string_agg(b || '-' || (b + body - 1), ',' order by k) filter (side = 'chosen' and not shared and role = 'assistant'), '') as chosen_mask,
    coalesce(string_agg(b || '-' || (b + body - 1), ',' order by k) filter (side = 'rejected' and not shared and role = 'assistant'), '') as rejected_mask
  from spans group by chosen_id)
select chosen_id, rejected_id, n_common::int as n_common, prompt, chosen,
  case when rejected_id is not null then rejected end as rejected, chosen_mask,
  case when rejected_id is not null then rejected_mask end as rejected_mask
from cut join texts using (chosen_id)
"""
