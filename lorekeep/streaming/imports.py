"""Chat files imported as they arrive.

The checkpoint remembers files, the tracking table remembers rows, so a batch
that runs again after a failure imports nothing twice.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from lorekeep.functions import chat
from lorekeep.operators import chatrows
from lorekeep.plans.imports import chat_tracking, documents_of, import_documents
from lorekeep.sources.chat_csv import ROWS_PER_BLOCK
from lorekeep.sources.collections import Collections, staged
from lorekeep.sources.providers import Embedder


def chat_file_stream(spark: SparkSession, folder: str, header: Sequence[str], files_per_batch: int = 1000) -> DataFrame:
    """Rows of new CSV files with one known header, with source, block and position."""
    if chat.header_format(header) == chat.FORMAT_UNKNOWN:
        raise ValueError(f"not a chat header: {list(header)}")
    schema = T.StructType([T.StructField(n, T.StringType()) for n in header])
    rows = (
        spark.readStream.schema(schema)
        .option("header", True)
        .option("multiLine", True)
        .option("quote", '"')
        .option("escape", '"')
        .option("maxFilesPerTrigger", files_per_batch)
        .csv(folder)
    )
    fields = [F.col(n) if n in header else F.lit(None).cast("string").alias(n) for n in chat.ALL_FIELDS]
    return rows.select(*fields, F.col("_metadata.file_name").alias("source"))


def with_places(batch: DataFrame) -> DataFrame:
    """Block and position inside a micro-batch. A file arrives in one batch, so row numbers hold."""
    row = F.monotonically_increasing_id()
    return batch.withColumns({"block": F.floor(row / ROWS_PER_BLOCK), "position": row})


def start_import(
    stream: DataFrame,
    store: Collections,
    collection: str,
    embedder: Embedder,
    checkpoint: str,
    **trigger,
) -> StreamingQuery:
    """Import every micro-batch of raw chat rows into the collection.

    Default trigger: all files there are, then stop. Rows without block and
    position get them from their place in the micro-batch.
    """
    spark = stream.sparkSession
    store.open(collection, metric="l2")

    def load(batch: DataFrame, batch_id: int) -> None:
        documents = documents_of(batch if "position" in batch.columns else with_places(batch))
        # A small batch against all that was ever tracked.
        tracked = chat_tracking(spark, store.root, collection).read()
        new = chatrows.without_known(staged(documents), tracked, ["record_hash"])
        import_documents(new, store, collection, embedder, batch_id + 1)

    return (
        stream.writeStream.foreachBatch(load)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
