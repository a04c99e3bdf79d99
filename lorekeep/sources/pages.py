"""Pages of PDF files through a page reader."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekeep.functions.text import OCR_MIN_CHARS

PDF_GLOB = "*.[pP][dD][fF]"
PAGE = "path string, source string, page int, text string, ocr boolean, error string"


class PageReader(Protocol):
    """Opens files by path inside tasks."""

    def page_count(self, path: str) -> int: ...

    def page_text(self, path: str, page: int) -> str:
        """Text of a page, counted from 1."""

    def ocr_text(self, path: str, page: int) -> str:
        """Text recognised in the image of a page."""


class FormFeedPages:
    """Plain text with form feeds between pages. Stands in where no PDF library is installed."""

    def _pages(self, path: str) -> list[str]:
        with open(path.removeprefix("file:"), encoding="utf-8") as f:
            return f.read().split("\f")

    def page_count(self, path: str) -> int:
        return len(self._pages(path))

    def page_text(self, path: str, page: int) -> str:
        return self._pages(path)[page - 1]

    def ocr_text(self, path: str, page: int) -> str:
        return self.page_text(path, page)


class MuPdfPages:
    """PDF text and OCR through PyMuPDF, where it is installed."""

    def __init__(self, language: str = "chi_sim+eng", dpi: int = 150):
        self.language, self.dpi = language, dpi

    def _open(self, path: str):
        try:
            import fitz
        except ImportError as exc:
            raise RuntimeError("reading PDF files needs PyMuPDF on the executors") from exc
        return fitz.open(path.removeprefix("file:"))

    def page_count(self, path: str) -> int:
        with self._open(path) as doc:
            return len(doc)

    def page_text(self, path: str, page: int) -> str:
        with self._open(path) as doc:
            return doc[page - 1].get_text("text")

    def ocr_text(self, path: str, page: int) -> str:
        with self._open(path) as doc:
            sheet = doc[page - 1]
            seen = sheet.get_textpage_ocr(language=self.language, dpi=self.dpi, full=True)
            return sheet.get_text("text", textpage=seen)


def read_pages(
    spark: SparkSession,
    folder: str,
    reader: PageReader,
    ocr_enabled: bool = True,
    ocr_below: int = OCR_MIN_CHARS,
    pattern: str = PDF_GLOB,
) -> DataFrame:
    """One row per page: path, source, page, text, ocr, error.

    Pages, not files, are spread over tasks, so one long book uses many of
    them. A page or file that cannot be read becomes a row with an error.
    """
    paths = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder).select("path")

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for path in frame["path"]:
                try:
                    rows.append((path, reader.page_count(path), None))
                except Exception as exc:
                    rows.append((path, 1, f"{type(exc).__name__}: {exc}"))
            yield pd.DataFrame(rows, columns=["path", "pages", "error"])

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for path, page, error in zip(frame["path"], frame["page"], frame["error"]):
                rows.append((path, path.rsplit("/", 1)[-1], page, *_page(path, int(page), error)))
            yield pd.DataFrame(rows, columns=["path", "source", "page", "text", "ocr", "error"])

    def _page(path: str, page: int, error: str | None):
        if error is not None:
            return None, False, error
        try:
            text = reader.page_text(path, page)
            ocr = ocr_enabled and len(text.strip()) < ocr_below
            return (reader.ocr_text(path, page) if ocr else text), ocr, None
        except Exception as exc:
            return None, False, f"{type(exc).__name__}: {exc}"

    counted = paths.mapInPandas(count, "path string, pages int, error string").where(F.col("pages") > 0)
    each = counted.select("path", F.explode(F.sequence(F.lit(1), F.col("pages"))).alias("page"), "error")
    spread = each.repartition(F.col("path"), F.col("page"))
    return spread.mapInPandas(read, PAGE)
