"""Reading and removing the labels a model writes about its own answer."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lorekeep.functions.binding import let
from lorekeep.functions.text import or_null, stripped

# The labels and the words after them.
IRRELEVANT = "不相关"
YES = "是"
SUPPORT_NONE = "无支持"
SUPPORT_PARTLY = "部分支持"
DEFAULT_USE = 3
RETRIEVE = r"(?U)\[Retrieve\]\s*(是|否)"
RELEVANCE = r"(?U)\[IsRel\]\s*(\d+)\s*(相关|不相关)"
SUPPORT = r"(?U)\[IsSup\]\s*(完全支持|部分支持|无支持)"
USE = r"(?U)\[IsUse\]\s*(\d)"
NUMBERED_LINE = r"(?mdU)(?:^|\n)\s*(\d+)[.:)]\s*(相关|不相关)"
PASSAGE_LINE = r"(?U)段落\s*(\d+)\s*[：:]\s*(相关|不相关)"
LABEL_TO_LINE_END = r"\[(?:Retrieve|IsRel|IsSup|IsUse)\][^\n]*(?:\n|$)"
PARAGRAPH_SPAN = r"(?s)<paragraph>.*?</paragraph>"


def _pairs(text: Column, pattern: str) -> Column:
    """array<struct<idx,relevant>> in text order. The text is searched once; number and word come from each match."""
    return F.transform(
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)),
        lambda m: F.struct(
            F.regexp_extract(m, r"(?U)(\d+)", 1).try_cast("int").alias("idx"),
            (~m.endswith(IRRELEVANT)).alias("relevant"),
        ),
    )


def relevance_flags(text: Column, passages: Column) -> Column:
    """array<struct<idx,relevant>> of the judged passages, or an empty array.

    The bracket form wins and takes any number; the two looser forms count only
    for numbers of given passages. Later labels come later in the array.
    """
    def bounded(pairs: Column) -> Column:
        return F.filter(pairs, lambda p: (p["idx"] >= 1) & (p["idx"] <= passages))

    def unless_found(pairs: Column, other: Column) -> Column:
        return let(pairs, lambda found: F.when(F.size(found) > 0, found).otherwise(other))

    loose = unless_found(bounded(_pairs(text, NUMBERED_LINE)), bounded(_pairs(text, PASSAGE_LINE)))
    none = F.array().cast("array<struct<idx:int,relevant:boolean>>")
    return F.when(text.isNull(), none).otherwise(unless_found(_pairs(text, RELEVANCE), loose))


def flag_of(flags: Column, idx: Column) -> Column:
    """Flag of one passage: the last label for it, true when there is none."""
    return F.coalesce(
        F.try_element_at(F.filter(flags, lambda p: p["idx"] == idx), F.lit(-1))["relevant"], F.lit(True)
    )


def support(text: Column) -> Column:
    return F.coalesce(or_null(F.regexp_extract(text, SUPPORT, 1)), F.lit(SUPPORT_PARTLY))


def use_score(text: Column) -> Column:
    """1..5, taken from the first digit after the label."""
    digit = F.regexp_extract(text, USE, 1).try_cast("int")
    digit = F.coalesce(digit, F.lit(DEFAULT_USE))
    return F.greatest(F.lit(1), F.least(F.lit(5), digit))


def wants_retrieval(text: Column) -> Column:
    """Decision of the routing call; a failed call (NULL) means yes."""
    tag = or_null(F.regexp_extract(text, RETRIEVE, 1))
    return F.when(text.isNull(), F.lit(True)).otherwise(
        F.coalesce(tag == YES, text.contains(YES))
    )


def needs_retry(is_sup: Column, is_use: Column, threshold: int = 3) -> Column:
    return (is_sup == SUPPORT_NONE) | (is_use < threshold)


def without_labels(text: Column) -> Column:
    """Remove each label up to the end of its line."""
    return F.regexp_replace(text, LABEL_TO_LINE_END, "")


def _labelled(line: Column) -> Column:
    # The plain test spares most lines the patterns.
    return line.contains("[Is") & (line.rlike(SUPPORT) | line.rlike(USE) | line.rlike(RELEVANCE))


def grounded_reply(text: Column) -> Column:
    """Answer text: lines with labels dropped, left-over labels removed, NULL when empty."""
    lines = F.filter(F.split(text, "\n"), lambda line: ~_labelled(line))
    return or_null(stripped(without_labels(stripped(F.array_join(lines, "\n")))))


def plain_reply(text: Column) -> Column:
    """Answer text of a call without passages, NULL when empty."""
    return or_null(stripped(without_labels(text)))


def reply_between_labels(text: Column) -> Column:
    """Text after the last relevance line and before the first support or use line."""
    lines = F.transform(
        F.split(text, "\n"),
        lambda line: F.struct(
            line.alias("line"),
            (line.contains("[IsRel]") & line.rlike(RELEVANCE)).alias("judges"),
            (line.contains("[Is") & (line.rlike(SUPPORT) | line.rlike(USE))).alias("rates"),
        ),
    )

    def after_judging(marked: Column) -> Column:
        # Lines from the end up to the last judging one; all of them when there is none.
        back = F.array_position(F.transform(F.reverse(marked), lambda p: p["judges"]), True)
        count = F.when(back > 0, back - 1).otherwise(F.size(marked)).cast("int")
        return F.slice(marked, F.size(marked) - count + 1, count)

    def before_rating(rest: Column) -> Column:
        stop = F.array_position(F.transform(rest, lambda p: p["rates"]), True)
        kept = F.slice(rest, 1, F.when(stop > 0, stop - 1).otherwise(F.size(rest)).cast("int"))
        return stripped(F.array_join(F.transform(kept, lambda p: p["line"]), "\n"))

    between = let(let(lines, after_judging), before_rating)
    return let(
        between,
        lambda reply: F.when(reply != "", or_null(stripped(without_labels(reply)))).otherwise(plain_reply(text)),
    )


def without_model_markup(text: Column) -> Column:
    """Clean the raw output of a local model: spans, bracket tokens, sentence marks, blanks."""
    text = F.regexp_replace(text, PARAGRAPH_SPAN, "")
    text = F.regexp_replace(text, r"\[[^\n]*?\]", "")
    text = F.replace(F.replace(text, F.lit("<s>"), F.lit("")), F.lit("</s>"), F.lit(""))
    return stripped(F.regexp_replace(text, r"(?U)[\s\x1c-\x1f]+", " "))
