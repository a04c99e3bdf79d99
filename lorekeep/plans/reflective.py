"""Reflective answering: the model judges passages and its own answer, column by column.

All steps work on a table of requests, so one request and a million run the same
plan. A request row has: request_id, query, conversation array<struct<role,content>>,
system_prompt, max_tokens, and hits array<struct<rank,content,chat_time,chat_time_str>>,
the at most 50 results of its search (NULL when there is no collection).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorekeep.functions import context, labels
from lorekeep.functions.binding import let
from lorekeep.sources.collections import staged
from lorekeep.sources.providers import ChatModel, message, with_replies

ROUTING_TOKENS = 300
JUDGING_TOKENS = 400
LABEL_TOKENS = 200


@dataclass(frozen=True)
class Wording:
    """Instructions around the fixed labels. Any text works that asks for the same labels."""

    routing: str = (
        "判断下面的消息是否要先查聊天记录才能回答。只输出一行：[Retrieve] 是 或 [Retrieve] 否\n\n消息："
    )
    judging: str = "逐条判断下列段落与用户问题是否相关，每条一行，格式：[IsRel] 编号 相关/不相关\n\n"
    grounded: str = "\n\n先自然作答，再另起两行自评：[IsSup] 完全支持/部分支持/无支持，[IsUse] 1-5"
    plain: str = "\n\n先自然作答，再另起一行自评：[IsUse] 1-5"
    context_prefix: str = "相关的历史聊天记录：\n"
    role_guide: str = ""


def _user(content: Column) -> Column:
    return message("user", content)


def _system(content: Column) -> Column:
    return message("system", content)


def routed(requests: DataFrame, model: ChatModel, words: Wording, raw_markup: bool = False) -> DataFrame:
    """Adds `retrieve`: whether the request wants passages.

    Answers of local models carry markup of their own (`raw_markup`); it is
    removed first, bracket labels included, so the word decides.
    """
    asked = requests.withColumn(
        "_ask", F.array(_user(F.concat(F.lit(words.routing), F.col("query"))))
    ).withColumn("_tokens", F.lit(ROUTING_TOKENS))
    answered = with_replies(asked, model, "_ask", "_tokens", "_routing")
    text = labels.without_model_markup(F.col("_routing")) if raw_markup else F.col("_routing")
    return answered.withColumn("retrieve", labels.wants_retrieval(text)).drop("_ask", "_tokens", "_routing")


def _by_rank(hits: Column) -> Column:
    return F.array_sort(hits)


def judged(requests: DataFrame, model: ChatModel, words: Wording, first: int | None = None) -> DataFrame:
    """Adds `relevant_hits`: hits without those that the model calls irrelevant; it sees all of them, or the `first` ones."""
    hits = _by_rank(F.col("hits"))
    seen = F.least(F.size("hits"), F.lit(first)) if first else F.size("hits")
    lines = F.transform(
        F.filter(hits, lambda h: h["rank"] <= seen),
        lambda h: context.numbered_passage(h["rank"], h["content"]),
    )
    last = F.coalesce(F.try_element_at(F.col("conversation"), F.lit(-1))["content"], F.col("query"))
    ask = F.array(_system(F.concat(F.lit(words.judging), F.array_join(lines, "\n"))), _user(last))
    # Requests without hits are not sent.
    asked = requests.withColumn("_ask", F.when(F.size("hits") > 0, ask)).withColumn("_tokens", F.lit(JUDGING_TOKENS))
    answered = with_replies(asked, model, "_ask", "_tokens", "_judging")
    flags = labels.relevance_flags(F.col("_judging"), seen)
    kept = let(
        flags, lambda f: F.filter(hits, lambda h: (h["rank"] > seen) | labels.flag_of(f, h["rank"]))
    )
    return answered.withColumn("relevant_hits", kept).drop("_ask", "_tokens", "_judging")


def budgeted_context(hits: Column, budget: int = 2000, with_time: bool = True) -> Column:
    """Lines of hits in rank order up to the first that overflows the budget, as one text."""
    lines = F.transform(
        hits, lambda h: context.chat_line(h["content"], h["chat_time_str"], h["chat_time"], with_time)
    )
    start = F.struct(F.lit(0).alias("used"), F.lit(True).alias("open"), F.array().cast("array<string>").alias("kept"))

    def add(state: Column, line: Column) -> Column:
        fits = state["open"] & (state["used"] + F.length(line) <= budget)
        return F.struct(
            F.when(fits, state["used"] + F.length(line)).otherwise(state["used"]).alias("used"),
            fits.alias("open"),
            F.when(fits, F.concat(state["kept"], F.array(line))).otherwise(state["kept"]).alias("kept"),
        )

    return F.aggregate(lines, start, add, lambda s: F.array_join(s["kept"], "\n"))


def _answered(requests: DataFrame, model: ChatModel, words: Wording, budget: int) -> DataFrame:
    """Adds reply, is_sup, is_use. Requests with relevant hits get a grounded answer, others a plain one."""
    grounded = F.coalesce(F.size("relevant_hits"), F.lit(0)) > 0
    context_text = F.concat(F.lit(words.context_prefix + "\n"), budgeted_context(F.col("relevant_hits"), budget), F.lit("\n\n"))
    role = F.concat(F.col("system_prompt"), F.lit(words.role_guide))
    system = F.when(grounded, F.concat(context_text, role, F.lit(words.grounded))).otherwise(
        F.concat(role, F.lit(words.plain))
    )
    asked = (
        requests.withColumn("_grounded", grounded)
        .withColumn("_ask", F.concat(F.array(_system(system)), F.col("conversation")))
        .withColumn("_tokens", F.col("max_tokens") + LABEL_TOKENS)
    )
    raw = with_replies(asked, model, "_ask", "_tokens", "_raw")
    text = F.col("_raw")
    had_hits = F.coalesce(F.size("hits"), F.lit(0)) > 0
    reply = F.when(F.col("_grounded"), labels.grounded_reply(text)).otherwise(labels.plain_reply(text))
    support = F.when(F.col("_grounded"), labels.support(text)).when(
        had_hits & F.col("retrieve"), F.lit(labels.SUPPORT_NONE)
    )
    return raw.withColumns({"reply": reply, "is_sup": support, "is_use": labels.use_score(text)}).drop(
        "_ask", "_tokens", "_raw", "_grounded"
    )


def reflective_answers(
    requests: DataFrame,
    model: ChatModel,
    words: Wording = Wording(),
    critique: bool = True,
    use_threshold: int = 3,
    budget: int = 2000,
    router: ChatModel | None = None,
    router_markup: bool = False,
    judged_hits: int | None = None,
) -> DataFrame:
    """request_id, reply, error, is_sup, is_use, retried.

    Answers that follow from passages and miss the quality gate are asked once
    more; the second answer counts when there is one. Model calls are staged, so
    no call runs twice. `router` is a model of its own for the routing step.
    """
    empty = F.array().cast(requests.schema["hits"].dataType)
    seen = staged(routed(requests, router or model, words, router_markup))
    seen = seen.withColumn("hits", F.when(F.col("retrieve"), F.coalesce("hits", empty)).otherwise(empty))
    first = staged(_answered(judged(seen, model, words, judged_hits), model, words, budget))
    from_search = F.col("retrieve") & (F.size("hits") > 0)
    gate = labels.needs_retry(F.col("is_sup"), F.col("is_use"), use_threshold)
    retry = F.lit(critique) & from_search & F.col("reply").isNotNull() & F.coalesce(gate, F.lit(False))
    first = first.withColumn("retried", retry)
    columns = ["request_id", "query", "conversation", "system_prompt", "max_tokens", "hits", "retrieve"]
    again = first.where("retried").select(*columns)
    second = staged(
        _answered(judged(again, model, words, judged_hits), model, words, budget).select("request_id", F.col("reply").alias("_second"))
    )
    joined = first.join(second, "request_id", "left")
    error = F.when(from_search & F.col("reply").isNull(), F.lit("no answer was generated"))
    return joined.select(
        "request_id",
        F.coalesce("_second", "reply").alias("reply"),
        error.alias("error"),
        "is_sup",
        "is_use",
        "retried",
    )
