"""A small JSON table that is replaced as a whole: each change writes the next version."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lorekeep.sources import files


class VersionedJson:
    def __init__(self, spark: SparkSession, path: str, schema: str):
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema

    def _latest(self) -> int:
        """Highest finished version, 0 when there is none."""
        done = [
            int(name.removeprefix("v"))
            for name in files.children(self.spark, self.path)
            if name.startswith("v") and files.exists(self.spark, f"{self.path}/{name}/_SUCCESS")
        ]
        return max(done, default=0)

    def read(self) -> DataFrame:
        version = self._latest()
        if version == 0:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).json(f"{self.path}/v{version:08d}")

    def replace(self, rows: DataFrame) -> None:
        """Readers see the old version until the new one is complete."""
        rows.write.mode("overwrite").json(f"{self.path}/v{self._latest() + 1:08d}")
