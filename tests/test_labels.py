"""Label reading on every shape of answer, against a plain model with Python's re."""

import itertools
import random
import re

from pyspark.sql import functions as F

from lorekeep.functions import labels

REL = re.compile(r"\[IsRel\]\s*(\d+)\s*(相关|不相关)")
NUM = re.compile(r"(?:^|\n)\s*(\d+)[\.:\)]\s*(相关|不相关)", re.M)
PAR = re.compile(r"段落\s*(\d+)\s*[：:]\s*(相关|不相关)")
SUP = re.compile(r"\[IsSup\]\s*(完全支持|部分支持|无支持)")
USE = re.compile(r"\[IsUse\]\s*(\d)")
TAG = re.compile(r"\[(?:Retrieve|IsRel|IsSup|IsUse)\][^\n]*(?:\n|$)")


def model_flags(text, n):
    shapes = [REL.findall(text)] + [[f for f in p.findall(text) if int(f[0]) in range(1, n + 1)] for p in (NUM, PAR)]
    return {int(i): w == "相关" for i, w in next(filter(None, shapes), [])}


def labelled(line, *patterns):
    return any(p.search(line) for p in patterns)


def model_reply(text):
    plain = "\n".join(x for x in text.split("\n") if not labelled(x, REL, SUP, USE))
    return TAG.sub("", plain.strip()).strip() or None


def model_between(text):
    after = text.split("\n")
    while any(labelled(x, REL) for x in after):
        after = after[1:]
    before_end = list(itertools.takewhile(lambda x: not labelled(x, SUP, USE), after))
    return TAG.sub("", "\n".join(before_end).strip() or text).strip() or None


def answers(n=400):
    parts = ["[IsRel] 1 相关", "[IsRel]2 不相关", "[IsRel] 20 相关", "[IsRel] 1 不相关", "1. 相关", " 2: 不相关", "3) 相关", "99. 相关",
             "段落1：相关", "段落 2: 不相关", "段落 77:相关", "[IsSup] 无支持", "[IsSup]完全支持 x", "[IsSup] 支持", "[IsUse] 1-5", "[IsUse] 9",
             "[IsUse]0", "[Retrieve] 是", "hello", "", "  ", "text [IsSup] 部分支持 tail", "你好　"]
    rng = random.Random(13)
    return ["\n".join(rng.choices(parts, k=rng.randint(1, 6))) for _ in range(n)]


def test_labels_match_the_model(spark):
    values = answers()
    rows = spark.createDataFrame(list(enumerate(values)), "i int, x string")
    x = F.col("x")
    got = rows.select(
        "i",
        labels.relevance_flags(x, F.lit(15)).alias("flags"),
        labels.support(x).alias("sup"),
        labels.use_score(x).alias("use"),
        labels.grounded_reply(x).alias("reply"),
        labels.plain_reply(x).alias("plain"),
        labels.reply_between_labels(x).alias("between"),
    ).orderBy("i").collect()
    for text, r in zip(values, got):
        assert {p.idx: p.relevant for p in r.flags} == model_flags(text, 15), text
        sup, use = SUP.search(text), USE.search(text)
        assert r["sup"] == (sup.group(1) if sup else "部分支持")
        assert r["use"] == (max(1, min(5, int(use.group(1)))) if use else 3)
        assert r["reply"] == model_reply(text)
        assert r["plain"] == (TAG.sub("", text).strip() or None)
        assert r["between"] == model_between(text), text


def test_missing_answer(value):
    x = F.col("x")
    assert value(labels.relevance_flags(x, F.lit(3)), x=None) == []
    assert value(labels.flag_of(labels.relevance_flags(x, F.lit(3)), F.lit(1)), x=None) is True
    assert value(labels.wants_retrieval(x), x=None) is True


def test_flag_of_takes_the_last(value):
    flags = labels.relevance_flags(F.col("x"), F.lit(3))
    text = "[IsRel] 1 相关\n[IsRel] 1 不相关"
    assert value(labels.flag_of(flags, F.lit(1)), x=text) is False
    assert value(labels.flag_of(flags, F.lit(2)), x=text) is True


def test_wants_retrieval(value):
    w = labels.wants_retrieval(F.col("x"))
    cases = {"[Retrieve] 是": True, "[Retrieve]否": False, "[Retrieve] 否，是": False, "不是": True, "no": False, "": False}
    assert {t: value(w, x=t) for t in cases} == cases


def test_quality_gate(value):
    gate = labels.needs_retry(F.col("s"), F.col("u"))
    cases = {("无支持", 5): True, ("部分支持", 2): True, ("部分支持", 3): False, ("完全支持", 2): True, ("完全支持", 3): False}
    assert {(s, u): value(gate, s=s, u=u) for s, u in cases} == cases


def test_model_markup(spark):
    values = ["<s>a [Retrieval]\n<paragraph>x\ny</paragraph> b</s>", "[a\nb] c", "[x][y] d　 e", " <paragraph>open "]
    rows = spark.createDataFrame(list(enumerate(values)), "i int, x string")
    got = [r.o for r in rows.select("i", labels.without_model_markup(F.col("x")).alias("o")).orderBy("i").collect()]

    def model(t):
        t = re.sub(r"<paragraph>.*?</paragraph>", "", t, flags=re.S)
        t = re.sub(r"\[.*?\]", "", t).replace("<s>", "").replace("</s>", "")
        return re.sub(r"\s+", " ", t).strip()

    assert got == [model(v) for v in values]
