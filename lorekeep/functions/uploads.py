"""How a file sent into a chat appears as a message."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Largest accepted file, and how much of a text file is quoted.
MAX_UPLOAD_BYTES = 10 * 1024 * 1024
QUOTED_CHARS = 1000


def size_text(size: Column) -> Column:
    """Bytes, or KB or MB with one decimal."""
    return (
        F.when(size < 1024, F.concat(size.cast("string"), F.lit(" B")))
        .when(size < 1024 * 1024, F.format_string("%.1f KB", size / 1024))
        .otherwise(F.format_string("%.1f MB", size / (1024 * 1024)))
    )


def is_accepted(size: Column) -> Column:
    return size <= MAX_UPLOAD_BYTES


def upload_message(name: Column, kind: Column, size: Column, content: Column) -> Column:
    """Name and start of the content of a text file; name, type and size of any other."""
    head = F.concat(F.lit("用户上传了文件: "), name)
    quoted = F.concat(head, F.lit("\n文件内容:\n"), F.substring(content, 1, QUOTED_CHARS))
    described = F.concat(head, F.lit(" ("), kind, F.lit(", "), size_text(size), F.lit(")"))
    return F.when(F.coalesce(content != "", F.lit(False)), quoted).otherwise(described)
