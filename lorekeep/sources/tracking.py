"""Hashes of what was imported, one table per collection.

The table is bucketed by the hash. A join against it moves what comes in, never what was tracked before.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekeep.operators.chatrows import without_known
from lorekeep.sources import files

LEAST_BUCKETS = 64


class Tracking:
    """Append-only table of one hash column; a missing table is an empty one.

    It has `buckets` buckets, fixed when it is made, by default one for each shuffle partition (64 at least):
    with fewer Spark would rather move both sides of a join.
    """

    def __init__(self, spark: SparkSession, path: str, key: str = "record_hash", buckets: int | None = None):
        self.spark, self.path, self.key, self.buckets = spark, path.rstrip("/"), key, buckets

    def _made(self) -> int | None:
        """Buckets of the table, None where there is none. Its folder says so."""
        names = [n for n in files.children(self.spark, self.path) if n.startswith("buckets-")]
        return int(names[0].removeprefix("buckets-")) if names else None

    def _table(self, buckets: int) -> str:
        """The table in the session's catalog, which forgets it when the session ends."""
        folder = f"{self.path}/buckets-{buckets}"
        name = f"tracked_{hashlib.md5(folder.encode()).hexdigest()}"
        quoted = folder.replace("\\", "\\\\").replace("'", "\\'")
        self.spark.sql(
            f"CREATE TABLE IF NOT EXISTS {name} (`{self.key}` STRING) USING parquet "
            f"CLUSTERED BY (`{self.key}`) SORTED BY (`{self.key}`) INTO {buckets} BUCKETS LOCATION '{quoted}'"
        )
        self.spark.catalog.refreshTable(name)
        return name

    def read(self) -> DataFrame:
        buckets = self._made()
        if buckets is None:
            return self.spark.createDataFrame([], f"`{self.key}` string")
        return self.spark.table(self._table(buckets))

    def add(self, hashes: DataFrame) -> None:
        """Store the hashes that are not there yet."""
        new = without_known(hashes.select(self.key).distinct(), self.read(), [self.key])
        default = max(LEAST_BUCKETS, int(self.spark.conf.get("spark.sql.shuffle.partitions")))
        buckets = self._made() or self.buckets or default
        # One file for each bucket that gets rows.
        new.repartition(buckets, self.key).write.insertInto(self._table(buckets))

    def clear(self) -> None:
        files.delete(self.spark, self.path)


def tracked_in_json(spark: SparkSession, path: str, key: str = "record_hash") -> DataFrame:
    """Hashes from a tracking file: {"imported_hashes": [...]} or a plain list. Unreadable means none."""
    none = spark.createDataFrame([], f"{key} string")
    if not files.exists(spark, path):
        return none
    raw = spark.read.option("wholetext", True).text(path)
    listed = F.coalesce(
        F.from_json("value", "struct<imported_hashes:array<string>>")["imported_hashes"],
        F.from_json("value", "array<string>"),
    )
    return raw.select(F.explode(listed).alias(key)).distinct()
