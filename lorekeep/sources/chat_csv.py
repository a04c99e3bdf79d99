"""Chat exports in CSV files: header formats, ordered reading, cleaned output."""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lorekeep.functions import chat

ROWS_PER_BLOCK = 1_000_000
PLACE_COLUMNS = ("source", "block", "position")


@dataclass(frozen=True)
class HeaderGroup:
    """Files that share one header line."""

    header: tuple[str, ...]
    paths: tuple[str, ...]

    @property
    def format(self) -> str:
        return chat.header_format(self.header)


def _open(path: str) -> io.TextIOBase:
    from pyarrow import fs

    if path.startswith("file:") or "://" not in path:
        stream = fs.LocalFileSystem().open_input_stream(path.removeprefix("file://").removeprefix("file:"))
    else:
        system, inner = fs.FileSystem.from_uri(path)
        stream = system.open_input_stream(inner)
    return io.TextIOWrapper(stream, encoding="utf-8", newline="")


def _read_headers(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        found = []
        for path in batch["path"]:
            with _open(path) as lines:
                found.append(next(csv.reader(lines), []))
        yield pd.DataFrame({"path": batch["path"], "header": found})


def header_groups(spark: SparkSession, folder: str, pattern: str = "*.csv") -> list[HeaderGroup]:
    """Files of a folder by header. Tasks read one line per file; the driver gets names, as for any file list."""
    files = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", pattern)
        .option("recursiveFileLookup", True)
        .load(folder)
        .where(F.col("length") > 0)
        .select("path", "length")
    )
    headers = files.mapInPandas(_read_headers, "path string, header array<string>")
    grouped = headers.groupBy("header").agg(F.array_sort(F.collect_list("path")).alias("files"))
    return [
        HeaderGroup(tuple(r.header), tuple(r.files))
        for r in grouped.orderBy("files").collect()
        if r.header
    ]


def _field_names(header: tuple[str, ...]) -> list[str]:
    """Column names as a reader by key sees them: of equal names the last counts."""
    names = []
    for i, name in enumerate(header):
        hidden = not name or name in header[i + 1 :]
        names.append(f"_unnamed_{i}" if hidden else name)
    return names


def read_group(spark: SparkSession, group: HeaderGroup) -> DataFrame:
    """All rows of a header group as text, with source, block and position.

    Fields may span lines, so a file is read by one task, and the files of a folder side by side.
    """
    names = _field_names(group.header)
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    rows = (
        spark.read.schema(schema)
        .option("header", True)
        .option("multiLine", True)
        .option("quote", '"')
        .option("escape", '"')
        .option("maxCharsPerColumn", -1)
        .csv(list(group.paths))
    )
    placed = _placed(rows, F.col("_metadata.file_path"), F.monotonically_increasing_id())
    return _plain_breaks(placed, schema).drop(*[n for n in names if n.startswith("_unnamed_")])


def _decoded(name: Column) -> Column:
    """Percent signs resolved; a plus sign is itself in paths."""
    return F.url_decode(F.replace(name, F.lit("+"), F.lit("%2B")))


def _plain_breaks(rows: DataFrame, schema: T.StructType) -> DataFrame:
    """Line breaks inside fields as \\n, however the file writes them."""
    crlf, cr, lf = F.lit("\r\n"), F.lit("\r"), F.lit("\n")
    return rows.withColumns({n: F.replace(F.replace(F.col(f"`{n}`"), crlf, lf), cr, lf) for n in schema.names})


def _placed(rows: DataFrame, path: Column, row: Column) -> DataFrame:
    """Adds source, block and position. A file is read by one task, so row numbers rise along it."""
    # Written tables keep the file name in a folder name, source=<name>.
    folder = _decoded(_decoded(F.regexp_extract(path, r"/source=([^/]+)/", 1)))
    own = _decoded(F.regexp_extract(path, r"([^/]+)$", 1))
    return rows.select(
        "*",
        F.when(folder != "", folder).otherwise(own).alias("source"),
        F.struct(path.alias("path"), F.floor(row / ROWS_PER_BLOCK).alias("part")).alias("block"),
        F.struct(path.alias("path"), row.alias("row")).alias("position"),
    )


def chat_fields(rows: DataFrame) -> DataFrame:
    """The known chat fields of raw rows, looked up by exact name; NULL where a file has none."""
    columns = [F.col(f"`{n}`") if n in rows.columns else F.lit(None).cast("string").alias(n) for n in chat.ALL_FIELDS]
    return rows.select(*PLACE_COLUMNS, *columns)


def read_chat(spark: SparkSession, folder: str, pattern: str = "*.csv") -> DataFrame:
    """Rows of all files in a known format; files with another header are left out."""
    known = [g for g in header_groups(spark, folder, pattern) if g.format != chat.FORMAT_UNKNOWN]
    if not known:
        raise ValueError(f"no chat file in a known format matches {folder}/{pattern}")
    rows = chat_fields(read_group(spark, known[0]))
    for group in known[1:]:
        rows = rows.unionByName(chat_fields(read_group(spark, group)))
    return rows


def write_clean(rows: DataFrame, folder: str, mode: str = "append") -> None:
    """CSV output with the columns of the input, one sub-folder per source file.

    Ranges over (source, position) keep the row order across part files and
    spread one very large source over several of them.
    """
    ordered = rows.repartitionByRange("source", "position").sortWithinPartitions("source", "position")
    (
        ordered.drop("position", "block")
        .write.mode(mode)
        .partitionBy("source")
        .option("header", True)
        .option("quote", '"')
        .option("escape", '"')
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .csv(folder)
    )
