"""From turn rows to message lists, first exchanges and rolling prompts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.chat import user_prompt
from ..functions.text import ANSWER_MARK, strip, text_or_empty
from .index import int_div, row_index

ROLES = ("system", "user", "prompter", "assistant")


def _messages(items: Column) -> Column:
    """Sorted ``(turn, role, text)`` structs to ``array<struct<role, content>>``."""
    return F.transform(F.array_sort(items),
                       lambda m: F.struct(m["role"].alias("role"), m["text"].alias("content")))


def assemble_messages(df: DataFrame, conv: str = "conv_id", turn: str = "turn",
                      role: str = "role", text: str = "text") -> DataFrame:
    """Whole conversations as one row each. The result row is the conversation, so
    its size is what the caller asks for; use ``first_messages`` or
    ``leading_messages`` when only part of it is needed."""
    item = F.struct(F.col(turn).alias("turn"), F.col(role).alias("role"), F.col(text).alias("text"))
    return df.groupBy(conv).agg(_messages(F.collect_list(item)).alias("messages"))


def first_messages(df: DataFrame, roles: Sequence[str] = ROLES, conv: str = "conv_id",
                   turn: str = "turn", role: str = "role", text: str = "text",
                   last: bool = False) -> DataFrame:
    """Message list holding only the first (or last) message of each role.

    ``min_by`` combines before the shuffle, so a conversation of any length sends
    one row per role and task.
    """
    pick, edge = (F.max_by, F.max) if last else (F.min_by, F.min)
    aggs = []
    for i, r in enumerate(roles):
        at = F.when(F.col(role) == r, F.col(turn))
        aggs += [edge(at).alias(f"__t{i}"), pick(F.col(text), at).alias(f"__x{i}")]
    d = df.groupBy(conv).agg(*aggs)
    item = F.array(*[F.when(F.col(f"__t{i}").isNotNull(),
                            F.struct(F.col(f"__t{i}").alias("turn"), F.lit(r).alias("role"),
                                     F.col(f"__x{i}").alias("text")))
                     for i, r in enumerate(roles)])
    return d.select(conv, _messages(F.filter(item, lambda m: m.isNotNull())).alias("messages"))


def leading_messages(df: DataFrame, n: int, conv: str = "conv_id", turn: str = "turn",
                     role: str = "role", text: str = "text") -> DataFrame:
    """Message list of the first ``n`` turns; ranks are pruned before the shuffle."""
    w = Window.partitionBy(conv).orderBy(turn)
    head = df.withColumn("__r", F.row_number().over(w)).filter(F.col("__r") <= n)
    return assemble_messages(head.drop("__r"), conv, turn, role, text)


def exchanges(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role",
              text: str = "text", chunk: int = 1024) -> DataFrame:
    """One row per user turn with the assistant turn right after it, if any.

    Turns get a position in their conversation, positions are cut into chunks, and
    the first turn of a chunk is also sent to the chunk before. A window then never
    holds more than ``chunk + 1`` turns, however long a conversation is.
    """
    d = row_index(df.select(F.col(conv).alias("conv_id"), F.col(turn).alias("turn"),
                            F.col(role).alias("role"), F.col(text).alias("text")),
                  "turn", "i", ["conv_id"])
    own = int_div("i", chunk)
    d = d.withColumn("c", F.explode(
        F.when((F.col("i") % chunk == 0) & (F.col("i") > 0), F.array(own - 1, own))
        .otherwise(F.array(own))))
    w = Window.partitionBy("conv_id", "c").orderBy("i")
    d = d.withColumn("next_role", F.lead("role").over(w)).withColumn("next_text", F.lead("text").over(w))
    return (d.filter((F.col("role") == "user") & (F.col("c") == own))
            .select("conv_id", "turn", text_or_empty("text").alias("user"),
                    F.when(F.col("next_role") == "assistant", text_or_empty("next_text"))
                    .alias("assistant")))


def rolling_prompts(ex: DataFrame, max_turns: int = 8, chunk: int = 1024) -> DataFrame:
    """The prompt shown before each user turn is answered: up to ``max_turns - 1``
    earlier exchanges and the open one.

    Chunks overlap by ``max_turns - 1`` rows, so the window groups stay bounded.
    An earlier exchange nobody answered stays an open template.
    """
    keep = max_turns - 1
    turn = user_prompt(F.col("user"))
    done = F.when(F.col("assistant").isNull(), turn).otherwise(
        F.concat(turn, strip("assistant"), F.lit("\n")))
    d = row_index(ex, "turn", "i", ["conv_id"]).withColumn("done", done).withColumn("open", turn)
    own = int_div("i", chunk)
    d = d.withColumn("c", F.explode(
        F.when(F.col("i") % chunk >= chunk - keep, F.array(own, own + 1)).otherwise(F.array(own))))
    w = Window.partitionBy("conv_id", "c").orderBy("i").rowsBetween(-keep, -1)
    d = d.withColumn("past", F.array_join(F.collect_list("done").over(w), ""))
    return (d.filter(F.col("c") == own)
            .select("conv_id", "turn", F.concat("past", "open").alias("prompt")))


def dialog_prompt(history: Column | str, max_turns: int = 8) -> Column:
    """Prompt for a ready-made ``array<struct<user, assistant>>`` history column.

    When the last kept exchange is answered (or there is none) an empty open turn
    is added.
    """
    h = F.col(history) if isinstance(history, str) else history
    h = F.coalesce(h, F.array().cast("array<struct<user:string,assistant:string>>"))
    n = F.size(h)
    k = F.least(n, F.lit(max_turns))
    kept = F.slice(h, n - k + 1, k)

    def one(x: Column) -> Column:
        t = user_prompt(text_or_empty(x["user"]))
        return F.when(x["assistant"].isNull(), t).otherwise(
            F.concat(t, strip(x["assistant"]), F.lit("\n")))

    body = F.array_join(F.transform(kept, one), "")
    return F.when(body.endswith(ANSWER_MARK), body).otherwise(
        F.concat(body, user_prompt(F.lit(""))))
