"""Session messages as an append-only table."""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lorekeep.operators.sessions import SESSION_MESSAGES, latest_messages
from lorekeep.sources import files

MESSAGE = "session_id string, seq long, role string, content string"
RESET = "reset"
BUCKETS = 256


def _bucket(session_id: Column) -> Column:
    return F.pmod(F.xxhash64(session_id), F.lit(BUCKETS)).cast("int")


class SessionStore:
    """Messages by session. A reset is a row of its own; what came before it no longer counts."""

    def __init__(self, spark: SparkSession, path: str, keep: int = SESSION_MESSAGES):
        self.spark, self.path, self.keep = spark, path, keep

    def _all(self) -> DataFrame:
        if not files.exists(self.spark, self.path):
            return self.spark.createDataFrame([], f"{MESSAGE}, bucket int")
        return self.spark.read.schema(f"{MESSAGE}, bucket int").parquet(self.path)

    def add(self, session_id: str, role: str, content: str | None) -> None:
        row = self.spark.createDataFrame([(session_id, time.time_ns(), role, content)], MESSAGE)
        row = row.coalesce(1).withColumn("bucket", _bucket(F.col("session_id")))
        row.write.mode("append").partitionBy("bucket").parquet(self.path)

    def messages(self, session_id: str | None = None) -> DataFrame:
        """The kept messages of all sessions, or of one, read from its bucket only."""
        rows = self._all()
        if session_id is not None:
            rows = rows.where((F.col("bucket") == _bucket(F.lit(session_id))) & (F.col("session_id") == session_id))
        rows = rows.drop("bucket")
        resets = rows.where(F.col("role") == RESET).groupBy("session_id").agg(F.max("seq").alias("_reset"))
        live = rows.join(resets, "session_id", "left").where(
            F.col("_reset").isNull() | (F.col("seq") > F.col("_reset"))
        )
        return latest_messages(live.drop("_reset"), self.keep)

    def history(self, session_id: str) -> list[dict[str, str]]:
        """Kept messages of one session in order: at most `keep`."""
        mine = self.messages(session_id).orderBy("seq")
        return [{"role": r.role, "content": r.content} for r in mine.collect()]

    def reset(self, session_id: str) -> None:
        self.add(session_id, RESET, None)

    def export_json(self, path: str, session_id: str | None = None) -> None:
        """One JSON line per message, numbered per session, for one session or all."""
        rows = self.messages(session_id)
        # At most `keep` rows per session reach this window.
        place = F.row_number().over(W.partitionBy("session_id").orderBy("seq"))
        rows.select("session_id", place.alias("message_no"), "role", "content").write.mode("overwrite").json(path)
