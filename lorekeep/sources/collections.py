"""Collections of embedded records as Parquet tables.

A collection lives in <root>/<name>: `about` holds one row with its metric,
`rows` the records in hash buckets of their id, and `changes` what upserts have
brought since: one folder each, read before the rows, the latest first. Compaction
brings both together.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekeep.operators.ordering import first_rows
from lorekeep.session import checkpoint_dir
from lorekeep.sources import files


def _staging(spark: SparkSession) -> str:
    return f"{checkpoint_dir(spark)}/staged-{spark.sparkContext.applicationId}"


def staged(df: DataFrame) -> DataFrame:
    """Write a table to the shared folder and read it back: later uses do not repeat its work."""
    spark = df.sparkSession
    path = f"{_staging(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_staged(spark: SparkSession) -> None:
    """Delete what this application has staged. Tables returned from it can no longer be read."""
    files.delete(spark, _staging(spark))


class Collections:
    def __init__(self, spark: SparkSession, root: str, buckets: int = 64):
        self.spark, self.root, self.buckets = spark, root.rstrip("/"), buckets

    def _rows(self, name: str) -> str:
        return f"{self.root}/{name}/rows"

    def _about(self, name: str) -> str:
        return f"{self.root}/{name}/about"

    def open(self, name: str, metric: str = "l2") -> str:
        """Create the collection if it is new; returns its metric."""
        if not files.exists(self.spark, self._about(name)):
            about = self.spark.createDataFrame([(name, metric, self.buckets)], "name string, metric string, buckets int")
            about.coalesce(1).write.parquet(self._about(name))
        return self.spark.read.parquet(self._about(name)).head().metric

    def _buckets_of(self, name: str) -> int:
        return self.spark.read.parquet(self._about(name)).head().buckets

    def delete(self, name: str) -> bool:
        return files.delete(self.spark, f"{self.root}/{name}")

    def _changes(self, name: str) -> str:
        return f"{self.root}/{name}/changes"

    def has_rows(self, name: str) -> bool:
        return files.exists(self.spark, self._rows(name)) or files.exists(self.spark, self._changes(name))

    def _changed(self, name: str) -> DataFrame | None:
        """The latest change of each changed id. Reads and moves changes only, not the stored rows."""
        if not files.exists(self.spark, self._changes(name)):
            return None
        found = self.spark.read.option("mergeSchema", True).parquet(self._changes(name))
        return first_rows(found, ["bucket", "id"], [F.col("change").desc()]).drop("change")

    def _merged(self, name: str) -> DataFrame:
        """All records with their bucket: changes, and stored rows without a change.

        Changes are few between two compactions, so Spark broadcasts their ids to the scan of the stored rows.
        """
        changed = self._changed(name)
        if not files.exists(self.spark, self._rows(name)):
            return changed
        stored = self.spark.read.parquet(self._rows(name))
        if changed is None:
            return stored
        kept = stored.join(changed.select("bucket", "id"), ["bucket", "id"], "left_anti")
        return kept.unionByName(changed, allowMissingColumns=True)

    def read(self, name: str) -> DataFrame:
        return self._merged(name).drop("bucket")

    def searchable(self, name: str) -> tuple[DataFrame, Callable[[DataFrame, list], DataFrame]]:
        """The rows with their bucket, and how to pick a few ids: from the buckets of those ids only."""
        rows, count = self._merged(name), self._buckets_of(name)

        def pick(df: DataFrame, ids: list) -> DataFrame:
            wanted = self.spark.createDataFrame([(i,) for i in ids], "id string").select(_bucket(count).alias("b"))
            return df.where(F.col("bucket").isin([r.b for r in wanted.distinct().collect()]) & F.col("id").isin(ids))

        return rows, pick

    def sizes(self) -> DataFrame:
        """name, metric, total_records of every collection."""
        if not files.children(self.spark, self.root):
            return self.spark.createDataFrame([], "name string, metric string, total_records long")
        about = self.spark.read.parquet(f"{self.root}/*/about").select("name", "metric")
        names = files.children(self.spark, self.root)
        changed = [n for n in names if files.exists(self.spark, self._changes(n))]
        plain = [n for n in names if n not in changed and files.exists(self.spark, self._rows(n))]
        ids = self.spark.createDataFrame([], "name string")
        if plain:  # one scan of the ids of all of them
            place = F.regexp_extract(F.col("_metadata.file_path"), r"/([^/]+)/rows/", 1)
            stored = self.spark.read.schema("id string").option("recursiveFileLookup", True).parquet(*map(self._rows, plain))
            ids = ids.unionByName(stored.select(F.url_decode(place).alias("name")))
        for n in changed:
            ids = ids.unionByName(self._merged(n).select(F.lit(n).alias("name")))
        counts = ids.groupBy("name").agg(F.count(F.lit(1)).alias("total_records"))
        return about.join(counts, "name", "left").withColumn(
            "total_records", F.coalesce("total_records", F.lit(0).cast("long"))
        )

    def _write(self, name: str, rows: DataFrame, replace_buckets: bool = False, sort_by: str | None = None) -> None:
        """Append, or replace just the buckets that `rows` has rows for."""
        even = rows.hint("rebalance", "bucket")
        if sort_by in rows.columns:
            # Sorted files let range filters on this column skip row groups.
            even = even.sortWithinPartitions("bucket", sort_by)
        writer = even.write.partitionBy("bucket").mode("overwrite" if replace_buckets else "append")
        if replace_buckets:
            writer = writer.option("partitionOverwriteMode", "dynamic")
        writer.parquet(self._rows(name))

    def _bucketed(self, name: str, rows: DataFrame) -> DataFrame:
        return rows.withColumn("bucket", _bucket(self._buckets_of(name)))

    def append(self, name: str, rows: DataFrame, sort_by: str | None = "chat_time") -> None:
        self._write(name, self._bucketed(name, rows), sort_by=sort_by)

    def upsert(self, name: str, rows: DataFrame, sort_by: str | None = "chat_time") -> int:
        """Store rows by id, one row per id; returns the number of the change, 0 for the first rows and for none.

        What is stored is neither read nor written: the rows are a change of their own, and readers
        take the latest change of an id. Running it again with the same rows gives the same records.
        No rows are no change. One writer at a time. What `rows` comes from is worked out once: whether there
        were any shows in what was written.
        """
        if not self.has_rows(name):
            self._write(name, self._bucketed(name, rows), sort_by=sort_by)
            self._dropped_if_empty(self._rows(name))
            return 0
        done = [int(c.removeprefix("change=")) for c in files.children(self.spark, self._changes(name)) if c.startswith("change=")]
        change = max(done, default=0) + 1
        even = self._bucketed(name, rows).hint("rebalance", "bucket")
        even.write.partitionBy("bucket").parquet(f"{self._changes(name)}/change={change}")
        return 0 if self._dropped_if_empty(f"{self._changes(name)}/change={change}", self._changes(name)) else change

    def _dropped_if_empty(self, path: str, *around: str) -> bool:
        """Delete a folder that no bucket was written to, then the folders around it that this leaves empty."""
        if any(c.startswith("bucket=") for c in files.children(self.spark, path)):
            return False
        files.delete(self.spark, path)
        for folder in around:
            if not files.children(self.spark, folder):
                files.delete(self.spark, folder)
        return True

    def compact(self, name: str, sort_by: str | None = "chat_time") -> None:
        """Bring changes into the stored rows: only buckets with a changed id are written anew.

        Buckets are replaced before the changes go. After a failure in between the changes are
        still there, and say what the rows say.
        """
        changed = self._changed(name)
        if changed is None:
            return
        changed = staged(changed)
        touched = [r.bucket for r in changed.select("bucket").distinct().collect()]  # at most `buckets`
        merged = self._merged(name).where(F.col("bucket").isin(touched))
        self._write(name, staged(merged), True, sort_by)
        files.delete(self.spark, self._changes(name))


def _bucket(count: int) -> Column:
    return F.pmod(F.xxhash64("id"), F.lit(count)).cast("int")
