"""Chat record columns: header formats, normalising, content, time and keys."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from lorekeep.functions.text import int_or_null, or_null, stripped

# Header fields that tell the two known chat formats apart.
STANDARD_FIELDS = ("id", "MsgSvrID", "type_name", "is_sender", "talker", "msg", "CreateTime")
SIMPLE_FIELDS = ("is_sender", "talker", "msg")
OPTIONAL_FIELDS = ("src", "room_name", "is_forward")
ALL_FIELDS = (*STANDARD_FIELDS, *OPTIONAL_FIELDS)

FORMAT_STANDARD = "wechat_standard"
FORMAT_SIMPLE = "simple"
FORMAT_UNKNOWN = "unknown"


def header_format(header: Iterable[str]) -> str:
    """Name of the chat format a header belongs to."""
    names = {name.strip() for name in header if name}
    if names.issuperset(STANDARD_FIELDS):
        return FORMAT_STANDARD
    if names.issuperset(SIMPLE_FIELDS):
        return FORMAT_SIMPLE
    return FORMAT_UNKNOWN


def normalised_fields() -> dict[str, Column]:
    """Typed columns from the raw text columns of a chat row."""
    return {
        "talker": stripped(F.col("talker")),
        "msg": stripped(F.col("msg")),
        "is_sender": F.coalesce(int_or_null(F.col("is_sender")), F.lit(0)),
        "CreateTime": or_null(F.col("CreateTime")),
        "MsgSvrID": or_null(F.col("MsgSvrID")),
        "type_name": or_null(F.col("type_name")),
        "src": or_null(F.col("src")),
        "room_name": or_null(F.col("room_name")),
        "is_forward": int_or_null(F.col("is_forward")),
        "id": F.col("id"),
    }


def has_required(talker: Column, msg: Column) -> Column:
    """Rows without talker or message are rejected, missing values included."""
    return F.coalesce((talker != "") & (msg != ""), F.lit(False))


def has_time(create_time: Column) -> Column:
    return create_time.isNotNull()


def has_room(room_name: Column) -> Column:
    return F.coalesce(room_name != "", F.lit(False))


def message_type(type_name: Column) -> Column:
    return F.coalesce(or_null(type_name), F.lit("text"))


def sparse_json(fields: Iterable[str]) -> Column:
    """JSON object with the fields that have a value."""
    return F.to_json(F.struct(*fields))


def content(talker: Column, room_name: Column, msg: Column) -> Column:
    """talker@room: message, without @room for private chats."""
    where = F.when(has_room(room_name), F.concat(F.lit("@"), room_name)).otherwise(F.lit(""))
    return F.concat(talker, where, F.lit(": "), msg)


# The usual shape; Spark's own cast reads it fastest.
_PLAIN = r"^\d{4}-\d{2}-\d{2}(?:[ T]\d{2}:\d{2}:\d{2}(?:\.\d{1,6})?(?:Z|[+-]\d{2}:\d{2})?)?$"

# Shapes of time text. Time of day: HH, HH:MM, HH:MM:SS with a fraction, or without colons.
_CLOCK = r"(\d{2})(?::?(\d{2})(?::?(\d{2})(?:[.,]\d+)?)?)?"
_ZONE = r"(Z|[+-]\d{2}(?::?\d{2})?)?"
_ISO_DAY = rf"^(\d{{4}})-(\d{{2}})-(\d{{2}})(?:.{_CLOCK}{_ZONE})?$"
_COMPACT_DAY = rf"^(\d{{4}})(\d{{2}})(\d{{2}})(?:.{_CLOCK}{_ZONE})?$"
_LOOSE = r"^(\d{4})-(\d{1,2})-(\d{1,2})\s+(\d{1,2}):(\d{1,2}):(\d{1,2})$"
_WEEK = rf"^(\d{{4}})-?W(\d{{2}})(?:-?([1-7]))?(?:.{_CLOCK}{_ZONE})?$"


def _part(text: Column, pattern: str, group: int, missing: str = "00") -> Column:
    return F.coalesce(or_null(F.regexp_extract(text, pattern, group)), F.lit(missing))


def _zone(text: Column, pattern: str, group: int) -> Column:
    """Offset as +HH:MM, or the session zone when the text has none."""
    raw = F.regexp_extract(text, pattern, group)
    digits = F.rpad(F.regexp_replace(raw, r"[^\d]", ""), 4, "0")
    signed = F.concat(
        F.substring(raw, 1, 1), F.substring(digits, 1, 2), F.lit(":"), F.substring(digits, 3, 2)
    )
    return F.when(raw == "", F.current_timezone()).when(raw == "Z", F.lit("+00:00")).otherwise(signed)


def _seconds(day: Column, clock: Column, zone: Column) -> Column:
    stamp = F.concat(day, F.lit(" "), clock, F.lit(" "), zone)
    return F.unix_timestamp(F.try_to_timestamp(stamp, F.lit("yyyy-MM-dd HH:mm:ss VV")))


def _from_shape(text: Column, pattern: str) -> Column:
    day = F.concat_ws("-", *[_part(text, pattern, g) for g in (1, 2, 3)])
    clock = F.concat_ws(":", *[_part(text, pattern, g) for g in (4, 5, 6)])
    return F.when(text.rlike(pattern), _seconds(day, clock, _zone(text, pattern, 7)))


def _from_week(text: Column) -> Column:
    year = F.regexp_extract(text, _WEEK, 1)
    first_monday = F.trunc(F.try_to_date(F.concat(year, F.lit("-01-04"))), "week")
    days = (_part(text, _WEEK, 2).try_cast("int") - 1) * 7 + _part(text, _WEEK, 3, "1").try_cast("int") - 1
    day = F.date_format(F.date_add(first_monday, days), "yyyy-MM-dd")
    clock = F.concat_ws(":", *[_part(text, _WEEK, g) for g in (4, 5, 6)])
    return F.when(text.rlike(_WEEK), _seconds(day, clock, _zone(text, _WEEK, 7)))


def _from_loose(text: Column) -> Column:
    def two(group: int) -> Column:
        return F.lpad(F.regexp_extract(text, _LOOSE, group), 2, "0")

    day = F.concat_ws("-", F.regexp_extract(text, _LOOSE, 1), two(2), two(3))
    clock = F.concat_ws(":", two(4), two(5), two(6))
    return F.when(text.rlike(_LOOSE), _seconds(day, clock, F.current_timezone()))


def chat_time(create_time: Column) -> Column:
    """Epoch seconds of a time text, 0 when it cannot be read.

    Reads ISO 8601 (dashed, compact and week dates, any one-character separator,
    optional offset) and `yyyy-M-d H:m:s`. Text without an offset is in the session zone.
    """
    plain = F.when(create_time.rlike(_PLAIN), F.unix_timestamp(create_time.try_cast("timestamp")))
    return F.coalesce(
        plain,
        _from_shape(create_time, _ISO_DAY),
        _from_shape(create_time, _COMPACT_DAY),
        _from_loose(create_time),
        _from_week(create_time),
        F.lit(0).cast("long"),
    )


def record_hash(source: Column, row_no: Column, create_time: Column, msg: Column) -> Column:
    """Identity of an imported row: file, row number, time and message."""
    parts = [source, row_no.cast("string"), F.coalesce(create_time, F.lit("")), msg]
    return F.sha2(F.concat_ws("|", *parts), 256)


def upsert_id(source: Column, time: Column, msg_content: Column) -> Column:
    """Key of a stored chat record. Talker and room are not part of it."""
    return F.md5(F.concat(source, time.cast("string"), msg_content))
