"""Messages and the replies that follow them within a time span, as a join of two streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def replies_within(messages: DataFrame, replies: DataFrame, span: str = "30 minutes", late: str = "1 hour", key: str = "talker") -> DataFrame:
    """Message and reply of one talker, the reply after the message and at most `span` later.

    Both sides have id, ts and the key, on streams or tables. On streams each side drops rows that come more than
    `late` behind the latest time seen up to the batch before last, and with the watermark and the span Spark knows
    when a row can meet no other any more: its state goes. Rows without a time or key meet nothing.
    """
    m = messages.select(F.col("id").alias("message_id"), F.col("ts").alias("message_ts"), F.col(key).alias("message_key")).withWatermark("message_ts", late)
    r = replies.select(F.col("id").alias("reply_id"), F.col("ts").alias("reply_ts"), F.col(key).alias("reply_key")).withWatermark("reply_ts", late)
    in_time = (F.col("reply_ts") > F.col("message_ts")) & (F.col("reply_ts") <= F.col("message_ts") + F.expr(f"INTERVAL {span}"))
    return m.join(r, (F.col("message_key") == F.col("reply_key")) & in_time).select(
        "message_id", "reply_id", F.col("message_key").alias(key), "message_ts", "reply_ts")
