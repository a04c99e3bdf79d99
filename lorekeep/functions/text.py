"""Text rules: trimming, message validity, previews, page noise and headings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters that count as white space at the ends of a text.
SPACES = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# What makes a chat message worthless for retrieval.
MIN_MESSAGE_CHARS = 3
PLACEHOLDER_PREFIXES = ("[", "表情")
STICKER_TYPE = "动画表情"
FRIEND_NOTICE = "I've accepted your friend request. Now let's chat!"
MARKUP_TAG = "<msg>"

# Pronouns that call for coreference resolution.
PRONOUNS = ("他", "她", "它", "他们", "她们", "它们", "那个", "那些", "这个", "这些")

# Lines that repeat on every textbook page.
# Flags: m = line anchors, d = only \n ends a line, U = Unicode classes.
NOISE_LINES = (
    r"^Principle and Technology of Database\s*$",
    r"^NOTES\s*$",
    r"^Copyright\s*©.*$",
    r"^Page\s+\d+\s*$",
)

# How a heading starts.
HEADING_START = (
    r"(?U)^(?:第[一二三四五六七八九十\d]+[章节]\s+"
    r"|\d+\.\d+(?:\.\d+)?\s+"
    r"|(?i:Chapter)\s+\d+)"
)
DECIMAL_START = r"(?U)^\d+\.\d+"

# Lines of a longer text that start like a heading, found in one pass. Blanks
# around the line are cut afterwards, hence the visible character at the end.
HEADING_LINE = (
    r"(?mdU)^[\s&&[^\n]]*((?:"
    r"(?:第[一二三四五六七八九十\d]+[章节]|\d+\.\d+(?:\.\d+)?)[\s&&[^\n]]+[^\s]"
    r"|(?i:Chapter)[\s&&[^\n]]+\d"
    r")[^\n]*)"
)

PREVIEW_CHARS = 120
OCR_MIN_CHARS = 50


def stripped(text: Column) -> Column:
    """Trim white space of every kind, not only the ASCII blank."""
    return F.btrim(text, F.lit(SPACES))


def or_null(text: Column) -> Column:
    """Empty text counts as missing."""
    return F.nullif(text, F.lit(""))


def int_or_null(text: Column) -> Column:
    """Whole number from text, NULL when it is none. Underscores between digits are allowed."""
    plain = F.regexp_replace(stripped(text), r"(?<=\d)_(?=\d)", "")
    return F.when(plain.rlike(r"^[+-]?\d+$"), plain.try_cast("bigint"))


def is_valid_message(msg: Column, type_name: Column) -> Column:
    """True for messages that carry text worth indexing. A missing type counts as empty."""
    body = stripped(msg)
    keep = (
        (F.length(body) >= MIN_MESSAGE_CHARS)
        & ~F.coalesce(type_name, F.lit("")).contains(STICKER_TYPE)
        & (body != FRIEND_NOTICE)
        & ~body.contains(MARKUP_TAG)
    )
    for prefix in PLACEHOLDER_PREFIXES:
        keep = keep & ~body.startswith(prefix)
    return F.coalesce(keep, F.lit(False))


def has_pronoun(text: Column) -> Column:
    return text.rlike("|".join(PRONOUNS))


def is_blank(text: Column) -> Column:
    return F.coalesce(stripped(text) == "", F.lit(True))


def prefix(text: Column, chars: int | None = None) -> Column:
    """The first `chars` characters of a text, or all of it."""
    return text if chars is None else F.substring(text, 1, chars)


def one_line(text: Column, chars: int = PREVIEW_CHARS) -> Column:
    """Trimmed text on one line, cut to a number of characters."""
    return F.substring(F.replace(stripped(text), F.lit("\n"), F.lit(" ")), 1, chars)


def shortened(text: Column, limit: int = 300) -> Column:
    """Text up to a limit; beyond it the cut text and the full length."""
    note = F.concat(
        F.substring(text, 1, limit), F.lit("...("), F.length(text).cast("string"), F.lit("字)")
    )
    return F.when(F.length(text) <= limit, text).otherwise(note)


def without_noise(text: Column, extra: Sequence[str] = ()) -> Column:
    """Drop repeated page lines, squeeze runs of blank lines, trim.

    One pass per pattern: dropping a line can bring the parts of the next match together.
    """
    for pattern in (*NOISE_LINES, *extra):
        text = F.regexp_replace(text, f"(?mdU){pattern}", "")
    return stripped(F.regexp_replace(text, "\n{3,}", "\n\n"))


def needs_ocr(raw_text: Column, enabled: bool = True, threshold: int = OCR_MIN_CHARS) -> Column:
    return F.lit(enabled) & (F.length(stripped(raw_text)) < threshold)


def heading_lines(text: Column) -> Column:
    """Trimmed lines of a text that start like a heading, in order."""
    return F.transform(F.regexp_extract_all(text, F.lit(HEADING_LINE), F.lit(1)), stripped)


def heading_kind(text: Column) -> Column:
    """'chapter', 'section' or NULL. A decimal heading that mentions 章 is a chapter."""
    chapter = text.contains("章") | text.startswith("Chapter")
    section = text.contains("节") | text.rlike(DECIMAL_START)
    return F.when(
        text.rlike(HEADING_START),
        F.when(chapter, F.lit("chapter")).when(section, F.lit("section")),
    )
