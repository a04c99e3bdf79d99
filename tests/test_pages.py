"""Headings and chunks against a line-by-line model, on random books."""

import functools
import random
import re

from pyspark.sql import functions as F

from lorekeep.operators import pages

STARTS = [
    re.compile(p)
    for p in (r"第[一二三四五六七八九十\d]+章\s+", r"第[一二三四五六七八九十\d]+节\s+", r"\d+\.\d+(\.\d+)?\s+", r"(?i)Chapter\s+\d+")
]


class Place:
    """Chapter and section while reading."""

    def __init__(self, chapter="前言", section=""):
        self.chapter, self.section = chapter, section

    def see(self, line):
        if any(p.match(line) for p in STARTS):
            if "章" in line or line.startswith("Chapter"):
                self.chapter, self.section = line, ""
            elif "节" in line or re.match(r"\d+\.\d+", line):
                self.section = line


def model_headings(book):
    place, out = Place(), []
    for text in book:
        for line in text.split("\n"):
            place.see(line.strip())
        out.append((place.chapter, place.section))
    return out


def model_chunks(text, chapter, section, size, overlap):
    """One step per paragraph over (open text, closed chunks)."""
    place = Place(chapter, section)

    def labelled(body):
        return (body, place.chapter, place.section)

    def step(state, para):
        body, closed = state
        place.see(para)
        grown = "\n".join(filter(None, (body, para)))
        if len(body) + 1 + len(para) <= size:
            return grown, closed
        tail = body[len(body) - overlap :] + "\n" if len(body) > overlap else ""
        return tail + para, closed + [labelled(body)] * bool(body)

    paragraphs = [p.strip() for p in re.split("\n{2,}", text) if p.strip()]
    body, closed = functools.reduce(step, paragraphs, ("", []))
    return closed + [labelled(body)] * bool(body.strip())


def random_book(rng, n_pages):
    heads = ["第一章 绪论", "第二节 模型", "1.2 本章小结", "2.3 查询", "Chapter 3 SQL", "chapter 4 x", "第3章"]
    book = []
    for _ in range(n_pages):
        parts = []
        for _ in range(rng.randint(1, 7)):
            parts.append(rng.choice(heads) if rng.random() < 0.25 else "字" * rng.choice([1, 9, 19, 20, 21, 39, 60, 90]))
            parts.append(rng.choice(["\n", "\n\n", "\n\n"]))
        book.append("".join(parts).strip())
    return book


def test_books_match_the_model(spark):
    rng = random.Random(11)
    books = {f"b{i}": random_book(rng, rng.randint(1, 30)) for i in range(8)}
    rows = [(b, n, t, False) for b, texts in books.items() for n, t in enumerate(texts, 1)]
    df = spark.createDataFrame(rows, "source string, page int, text string, ocr boolean").repartition(5)
    headed = pages.with_headings(df, pages_per_block=4)
    got = {(r.source, r.page): (r.chapter, r.section) for r in headed.collect()}
    want = {(b, n): hs for b, texts in books.items() for n, hs in enumerate(model_headings(texts), 1)}
    assert got == want
    for size, overlap in ((100, 20), (60, 10), (1000, 200)):
        chunks = pages.page_chunks(headed, size, overlap)
        made = {}
        for r in chunks.orderBy("source", "page", "chunk_no").collect():
            made.setdefault((r.source, r.page), []).append((r.text, r.chapter, r.section))
        expected = {}
        for b, texts in books.items():
            for n, t in enumerate(texts, 1):
                cut = model_chunks(t, *want[(b, n)], size, overlap)
                if cut:
                    expected[(b, n)] = cut
        assert made == expected


def page(spark, text, chapter="前言", section=""):
    return spark.createDataFrame([("b", 1, text, False, chapter, section)], "source string, page int, text string, ocr boolean, chapter string, section string")


def test_heading_that_closes_a_chunk_labels_it(spark):
    got = pages.page_chunks(page(spark, "a" * 50 + "\n\n第二章 新的开始"), 55, 10).orderBy("chunk_no").collect()
    assert [(r.chapter, r.text[-8:]) for r in got] == [("第二章 新的开始", "a" * 8), ("第二章 新的开始", "第二章 新的开始")]


def test_long_paragraph_and_exact_overlap(spark):
    got = pages.page_chunks(page(spark, "a" * 10 + "\n\n" + "b" * 200), 50, 10).orderBy("chunk_no").collect()
    assert [r.text for r in got] == ["a" * 10, "b" * 200]


def test_unreadable_and_blank_pages_are_dropped(spark):
    raw = spark.createDataFrame(
        [("b", 1, "NOTES\nPage 1\n", None), ("b", 2, "text", None), ("b", 3, "text", "boom"), ("b", 4, "x" * 60, None)],
        "source string, page int, text string, error string",
    )
    clean = pages.cleaned_pages(raw)
    assert sorted((r.page, r.ocr) for r in clean.collect()) == [(2, True), (4, False)]
    assert pages.page_counts(raw, clean).collect()[0][1:] == (4, 2, 1)


def test_copies_stay_in_a_file_but_not_across_files(spark):
    rows = [("a", 1, 0, "same"), ("a", 2, 0, "same"), ("b", 1, 0, "same"), ("b", 1, 1, "own"), ("c", 1, 0, "known")]
    chunks = spark.createDataFrame(rows, "source string, page int, chunk_no int, text string")
    tracked = pages.with_chunk_keys(chunks.where("text = 'known'")).select("text_hash")
    got = sorted((r.source, r.page, r.chunk_no) for r in pages.new_chunks(chunks, tracked).collect())
    assert got == [("a", 1, 0), ("a", 2, 0), ("b", 1, 1)]
    ids = [r.id for r in pages.new_chunks(chunks).select("id").collect()]
    assert len(ids) == len(set(ids)) == 4


def test_headings_stay_split_by_block(spark):
    name = F.concat(F.lit("b"), (F.col("id") > 50).cast("string"))
    df = spark.range(100).select(name.alias("source"), F.col("id").alias("page"), F.lit("x").alias("text"), F.lit(False).alias("ocr"))
    plan = pages.with_headings(df)._jdf.queryExecution().executedPlan().toString()
    # Pages move by (source, block); only one row per block moves by source alone.
    wide = [line for line in plan.split("\n") if "hashpartitioning(source" in line and "_block" not in line]
    assert len(wide) == 1 and plan.count("_block") > 3
