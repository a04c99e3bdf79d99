"""Text rules on the rows the tables never show."""

import random
import re

import pytest
from pyspark.sql import functions as F

from lorekeep.functions import chat, text


def column(spark, expr, values):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string")
    return [r.out for r in rows.select("i", expr(F.col("x")).alias("out")).orderBy("i").collect()]


def test_strip_equals_python(spark):
    pad = ["", " ", "\t", "\n", "　", "\xa0", "\x1c", "\x0b", " ", "\x85", "​"]
    rng = random.Random(1)
    values = ["".join(rng.choices(pad, k=3)) + w + "".join(rng.choices(pad, k=3)) for w in ["", "a", "a b", "语 x"] * 20]
    assert column(spark, text.stripped, values) == [v.strip() for v in values]


def test_int_or_null(spark):
    values = ["", "x", "1.0", " 1 ", "+3", "-2", "1_0", "_1", "1__0", None, "99999999999", "9" * 20]
    assert column(spark, text.int_or_null, values) == [None, None, None, 1, 3, -2, 10, None, None, None, 99999999999, None]


@pytest.mark.parametrize(
    ("msg", "kind", "kept"),
    [
        ("ab", "text", False), ("abc", "text", True), ("　ab\t", "text", False), ("　abc\t", None, True),
        ("[图片]xx", "text", False), ("表情包", "text", False), ("hello", "含动画表情的", False),
        ("I've accepted your friend request. Now let's chat!", "", False), ("a <msg> b", "", False),
        ("x [ok]", "", True), (None, "", False), ("   ", "", False), ("你好啊", "", True),
    ],
)
def test_message_validity(value, msg, kind, kept):
    assert value(text.is_valid_message(F.col("x"), F.col("t")), x=msg, t=kind) is kept


def test_chat_time(spark):
    cases = {
        "2024-01-15 10:30:45": 1705314645,
        "2024-01-15T10:30:45": 1705314645,
        "2024-01-15T10:30:45.123456": 1705314645,
        "2024-01-15T10:30:45+08:00": 1705314645 - 28800,
        "2024-01-15T10:30:45Z": 1705314645,
        "2024-01-15 10:30": 1705314600,
        "2024-01-15": 1705276800,
        "20240115T103045": 1705314645,
        "2024-W03-1": 1705276800,
        "2024-1-5 3:04:5": 1704423845,
        "2024-01": 0, "junk": 0, "": 0, "2024-13-01 00:00:00": 0, "2024/01/15": 0,
    }
    assert column(spark, chat.chat_time, list(cases)) == list(cases.values())
    assert column(spark, chat.chat_time, [None]) == [0]


def test_chat_time_uses_the_session_zone(spark):
    spark.conf.set("spark.sql.session.timeZone", "Asia/Shanghai")
    try:
        assert column(spark, chat.chat_time, ["2024-01-15 10:30:45"]) == [1705314645 - 28800]
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_header_format():
    full = ["id", "MsgSvrID", "type_name", "is_sender", "talker", "msg", "CreateTime"]
    assert chat.header_format([*full, "extra"]) == "wechat_standard"
    assert chat.header_format([" msg", "talker ", "is_sender"]) == "simple"
    assert chat.header_format(["msg", "talker"]) == "unknown"


def test_previews(spark):
    assert column(spark, lambda x: text.one_line(x, 5), [" a\nb c d \n"]) == ["a b c"]
    assert column(spark, lambda x: text.shortened(x, 3), ["abc", "abcd"]) == ["abc", "abc...(4字)"]


def python_clean(page):
    for p in (r"^Principle and Technology of Database\s*$", r"^NOTES\s*$", r"^Copyright\s*©.*$", r"^Page\s+\d+\s*$"):
        page = re.sub(p, "", page, flags=re.M)
    return re.sub("\n{3,}", "\n\n", page).strip()


def test_page_noise_equals_one_pattern_at_a_time(spark):
    parts = ["NOTES", "NOTES ", "Page 3", "Page", "12", "Page 3 x", "Copyright © 2020 a", "Copyright", "© b", "text",
             "Principle and Technology of Database", "", "", " 　", "x NOTES", "1.1 y"]
    rng = random.Random(2)
    values = ["\n".join(rng.choices(parts, k=8)) for _ in range(300)]
    assert column(spark, text.without_noise, values) == [python_clean(v) for v in values]


def test_extra_noise(spark):
    assert column(spark, lambda x: text.without_noise(x, ["^draft.*$"]), ["draft 1\nbody"]) == ["body"]


def test_heading_kind(spark):
    cases = {
        "第一章 绪论": "chapter", "第1章": None, "第二节 模型": "section", "1.2 概念": "section",
        "1.2 本章小结": "chapter", "Chapter 3 SQL": "chapter", "chapter 3 sql": None, "1.2.3 x": "section",
        "12 x": None, "text 第一章 x": None, "CHAPTER 4 第四章": "chapter",
    }
    assert column(spark, text.heading_kind, list(cases)) == list(cases.values())


def test_heading_lines_equal_line_by_line_matching(spark):
    start = re.compile(r"第[一二三四五六七八九十\d]+[章节]\s+|\d+\.\d+(\.\d+)?\s+|(?i:Chapter)\s+\d+")
    parts = ["第一章 绪论", "  第1章  ", "第1章", "第二节\t模型 ", "1.2", "1.2 概念", " 1.2.3　x", "Chapter", "3 x",
             "chapter 3", "x Chapter 3", "", "1.2.", "1.2 ", "Chapter  9　"]
    rng = random.Random(3)
    values = ["\n".join(rng.choices(parts, k=7)) for _ in range(300)]
    expected = [[x for x in (line.strip() for line in v.split("\n")) if start.match(x)] for v in values]
    assert column(spark, text.heading_lines, values) == expected
