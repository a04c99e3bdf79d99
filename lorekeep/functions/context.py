"""Lines that go into a prompt: chat context, cited book context, numbered passages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lorekeep.functions.text import one_line, or_null, stripped


def chat_line(content: Column, time_text: Column, time: Column, with_time: bool = True) -> Column:
    """[time] content. No prefix when neither a time text nor a time above 0 is known."""
    if not with_time:
        return stripped(content)
    shown = F.coalesce(or_null(time_text), F.when(time != 0, time.cast("string")))
    prefix = F.when(shown.isNull(), F.lit("")).otherwise(F.concat(F.lit("["), shown, F.lit("] ")))
    return F.concat(prefix, stripped(content))


def cited_passage(
    content: Column, chapter: Column, section: Column, page: Column, source: Column
) -> Column:
    """Passage under its place in the book, or under its file when no place is known."""
    page_label = F.when(page != 0, F.concat(F.lit("第"), page.cast("string"), F.lit("页")))
    place = or_null(F.concat_ws(" > ", or_null(chapter), or_null(section), page_label))
    return F.concat(
        F.lit("【"), F.coalesce(place, source, F.lit("")), F.lit("】\n"), stripped(content), F.lit("\n")
    )


def numbered_passage(rank: Column, content: Column) -> Column:
    return F.concat(F.lit("["), rank.cast("string"), F.lit("] "), one_line(content))
