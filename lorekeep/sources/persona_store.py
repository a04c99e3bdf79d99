"""The persona catalogue."""

from __future__ import annotations

import datetime
import uuid

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from lorekeep.operators import personas as P
from lorekeep.sources import files
from lorekeep.sources.versioned import VersionedJson

PERSONA = (
    "seq long, _type string, id string, name string, collection string, system_prompt string, "
    "created_at string, doc_count long, model_params struct<max_tokens:int>, "
    "rag_params struct<k:int,include_nearby:boolean,time_window_minutes:int,"
    "nearby_per_result:int,max_total_results:int,lambda_mult:double>"
)


class PersonaStore:
    """Personas by id. Header rows (_type = schema) are hidden from reads and kept on changes."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        self.table = VersionedJson(spark, path, PERSONA)

    def load_json(self, path: str) -> None:
        """Take over a catalogue file: one JSON array, in file order. An unreadable file gives none."""
        if not files.exists(self.spark, path):
            return
        element = PERSONA.removeprefix("seq long, ")
        whole = self.spark.read.option("wholetext", True).text(path)
        parsed = whole.select(F.posexplode(F.from_json("value", f"array<struct<{_struct(element)}>>")).alias("seq", "p"))
        self.table.replace(parsed.select(F.col("seq").cast("long"), "p.*"))

    def list(self) -> DataFrame:
        return P.visible(self.table.read()).orderBy("seq")

    def get(self, persona_id: str) -> Row | None:
        return self.list().where(F.col("id") == persona_id).head()

    def get_or_first(self, persona_id: str | None) -> Row | None:
        return P.lookup(self.table.read(), persona_id).head()

    def create(self, name: str, system_prompt: str, collection: str | None = None) -> Row:
        pid = str(uuid.uuid4())
        old = self.table.read()
        seq = (old.agg(F.max("seq")).head()[0] or 0) + 1
        now = datetime.datetime.now().isoformat()
        row = (seq, None, pid, name, collection or f"persona_{pid[:8]}", system_prompt, now, 0, None, None)
        self.table.replace(old.unionByName(self.spark.createDataFrame([row], PERSONA)))
        return self.get(pid)

    def _change(self, persona_id: str, column: str, value: Column) -> None:
        old = self.table.read()
        mine = F.col("id").eqNullSafe(persona_id)
        self.table.replace(old.withColumn(column, F.when(mine, value).otherwise(F.col(column))))

    def set_doc_count(self, persona_id: str, count: int) -> None:
        self._change(persona_id, "doc_count", F.lit(count).cast("long"))

    def set_max_tokens(self, persona_id: str, max_tokens: int) -> None:
        merged = F.coalesce("model_params", F.struct(F.lit(None).cast("int").alias("max_tokens")))
        self._change(persona_id, "model_params", merged.withField("max_tokens", F.lit(max_tokens).cast("int")))

    def delete(self, persona_id: str) -> bool:
        """Drop the catalogue row; the collection stays."""
        old = self.table.read()
        if self.get(persona_id) is None:
            return False
        self.table.replace(old.where(~F.col("id").eqNullSafe(persona_id)))
        return True


def _struct(fields: str) -> str:
    """`name type` pairs as struct fields, `name:type`."""
    return ",".join(field.replace(" ", ":", 1) for field in fields.split(", "))
