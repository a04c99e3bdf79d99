"""Session messages: retention and prompt assembly."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorekeep.operators.ordering import first_rows

SESSION_MESSAGES = 40


def latest_messages(messages: DataFrame, keep: int = SESSION_MESSAGES) -> DataFrame:
    """The last messages of each session. Each task passes on at most `keep` per session."""
    return first_rows(messages, ["session_id"], [F.col("seq").desc()], keep)


def without_session(messages: DataFrame, session_id: str) -> DataFrame:
    return messages.where(~F.col("session_id").eqNullSafe(session_id))
