"""Licence notices found by the Dice coefficient over word pairs. DataFrame functions only.

Lines, and whole texts of several lines, are normalised to lower-case words. A template and a
unit of text match when twice the word pairs they share is at least `least` times the pairs
of both. Sizes alone rule most templates out: each is listed under the sizes that can still
reach `least`, and a unit only meets those listed under its own size.

Notices that are wrapped, or stand inside longer lines, are found as windows: consecutive words
of a text, across its lines, from one shared pair to another. Only texts with one of a few words
are looked at: a match of any kind shares so many pairs of its template that one has such a word.
"""

from __future__ import annotations

import json
import math
import re
from collections import Counter
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekeep.llm.licence_texts import TEXTS
from lorekeep.sources.collections import staged

LEAST = 0.8
#: In a window, a template of so few pairs must occur whole.
WHOLE_PAIRS = 3

# The Creative Commons licences and their clauses.
_CC = {
    "BY": "Attribution", "BY-SA": "Attribution-ShareAlike", "BY-ND": "Attribution-NoDerivatives",
    "BY-NC": "Attribution-NonCommercial", "BY-NC-SA": "Attribution-NonCommercial-ShareAlike",
    "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives",
}

# Short forms in which licences are commonly named.
TEMPLATES = {
    "MIT": "Released under the MIT License.",
    "MIT-notice": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "LGPL-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "AGPL-3.0": "This work is licensed under the GNU Affero General Public License, version 3.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "BSD": "Distributed under the BSD 3-Clause License.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "CC0-1.0": "This work is dedicated to the public domain under CC0 1.0 Universal.",
    "All-rights-reserved": "Copyright. All rights reserved.",
    "All-rights-reserved-short": "All rights reserved.",
    **{f"CC-{k}-4.0": f"This work is licensed under a Creative Commons {v} 4.0 International License." for k, v in _CC.items()},
    **{f"CC-{k}-4.0-short": f"Licensed under CC {k} 4.0." for k in _CC},
    **{f"CC-{k}-4.0-work": f"This work is licensed under CC {k} 4.0." for k in _CC},
    **{f"CC-{k}-4.0-name": f"CC {k} 4.0" for k in _CC},
    **TEXTS,
}

#: Words that ordinary texts have: the last that windows are looked for by.
_COMMON = set("a all an and any are as at be by can copy copies for free from in is it may not of on or that the this to under use "
              "with without work you your".split())

NOT_WORD, WORD = r"[^\p{L}\p{N}]+", r"[\p{L}\p{N}]+"


def pairs_of(text: str) -> list[str]:
    """Word pairs of a template (none may repeat); a single word stands for itself."""
    words = re.sub(r"[\W_]+", " ", text.lower()).split()
    return list(dict.fromkeys(" ".join(p) for p in zip(words, words[1:]))) or words


def sizes_of(n: int, least: float) -> range:
    """Sizes of sets that can reach `least` with one of n elements."""
    return range(math.ceil(n * least / (2 - least) - 1e-9), math.floor(n * (2 - least) / least + 1e-9) + 1)


def needed_in_window(n: int, least: float) -> int:
    """Pairs of a template of n that a window must share; fewer can't reach `least`."""
    return n if n <= WHOLE_PAIRS else math.ceil(n * least / (2 - least) - 1e-9)


def telling(templates: dict[str, str], least: float) -> tuple[list[str], list[str]]:
    """Words, and pairs of short words, of which every unit that matches has at least one.

    For each template fewer pairs than a match shares are without them.
    """
    words: set[str] = set()
    pairs: set[str] = set()
    listed = [pairs_of(t) for t in templates.values()]

    def left(of: list[str]) -> list[str]:
        rest = [p for p in of if p not in pairs and not any(w in words for w in p.split(" "))]
        return rest if len(rest) >= math.ceil(len(of) * least / (2 - least) - 1e-9) else []

    while rest := [p for of in listed for p in left(of)]:
        able = Counter(w for p in rest for w in set(p.split(" ")) if len(w) > 4 and w not in _COMMON)
        if able:
            words.add(max(able, key=lambda w: (able[w], len(w), w)))
        else:
            pairs.add(max(rest, key=lambda p: (rest.count(p), len(p), p)))
    return sorted(w for w in words if not any(v != w and v in w for v in words)), sorted(pairs)


def _told(text: Column, templates: dict[str, str], least: float) -> Column:
    words, pairs = telling(templates, least)

    def any_in(low: Column) -> Column:
        tests = [low.contains(w) for w in words]
        if pairs:
            tests.append(low.rlike("|".join(NOT_WORD.join(map(re.escape, p.split(" "))) for p in pairs)))
        return reduce(lambda a, b: a | b, tests)

    # In a lambda, so that a text is put into lower case once and not for each test.
    return F.exists(F.array(F.lower(text)), any_in)


def template_table(spark: SparkSession, templates: dict[str, str], least: float) -> DataFrame:
    rows = [(name, pairs, len(pairs), size) for name, text in templates.items()
            for pairs in [pairs_of(text)] for size in sizes_of(len(pairs), least)]
    return spark.createDataFrame(rows, "licence string, template array<string>, n_template int, size int")


def _pairs(text: Column) -> Column:
    words = F.split(F.trim(F.regexp_replace(F.lower(text), NOT_WORD, " ")), " ")
    several = F.size(words) > 1
    return F.zip_with(
        F.when(several, F.slice(words, 1, F.size(words) - 1)).otherwise(words),
        F.when(several, F.slice(words, 2, F.size(words) - 1)).otherwise(F.array(F.lit(None).cast("string"))),
        lambda a, b: F.concat_ws(" ", a, b),
    )


#: Endings of template names that tell forms of one licence apart.
FORMS = r"-(notice|short|work|name|text|title|header|permission)$"
#: Names that stand for another one.
SAME = {"BSD": "BSD-3-Clause"}


def licence_of(name: Column) -> Column:
    """The licence that a template is a form of."""
    out = F.regexp_replace(name, FORMS, "")
    for form, licence in SAME.items():
        out = F.when(name == form, F.lit(licence)).otherwise(out)
    return out


def licences_found(docs: DataFrame, templates: dict[str, str] | None = None, least: float = LEAST) -> DataFrame:
    """doc_id, line, licence, dice: the licence that each line names, or the window of words that begins there.

    Of several templates the one that matches best counts, of equal ones the longer one, then the later name; all
    forms of a licence have one name. A window over several lines goes if one of them matches as well by itself, and
    the whole text (line 0) counts only for a licence that no line names. NULL and empty texts name nothing. Rows
    alike in id and text count once, rows alike in id alone, or without an id, are texts of their own.
    """
    templates = templates or TEMPLATES
    keyed = docs.select(F.struct(docs["doc_id"].alias("id"), F.md5(docs["text"]).alias("md5")).alias("doc_id"), docs["text"])
    sizes = F.from_json(F.lit(json.dumps({k: len(pairs_of(v)) for k, v in templates.items()})), "map<string,int>")
    found = _matches(keyed, templates, least).withColumn("n_template", F.element_at(sizes, F.col("licence")))
    best = found.groupBy("doc_id", "line").agg(F.max(F.struct("dice", "n_template", "licence", "till")).alias("m")).select(
        "doc_id", "line", "m.till", licence_of(F.col("m.licence")).alias("licence"), "m.dice")
    best = staged(best)
    alone = best.where((F.col("line") > 0) & (F.col("till") == F.col("line")))
    # A window is no longer than a template allows, and so are its lines.
    over = best.where(F.col("till") > F.col("line")).withColumn("covered", F.explode(F.sequence("line", "till")))
    beaten = over.join(
        alone.select("doc_id", F.col("line").alias("covered"), F.col("dice").alias("own")), ["doc_id", "covered"]
    ).where(F.col("own") >= F.col("dice")).select("doc_id", "line").distinct()
    named = best.where("line > 0").join(beaten, ["doc_id", "line"], "left_anti")
    whole = best.where("line = 0").join(named.select("doc_id", "licence").distinct(), ["doc_id", "licence"], "left_anti")
    columns = [F.col("doc_id.id").alias("doc_id"), "line", "licence", "dice"]
    return named.select(*columns).unionByName(whole.select(*columns))


def licence_matches(docs: DataFrame, templates: dict[str, str] | None = None, least: float = LEAST) -> DataFrame:
    """doc_id, line, licence, dice: every line (from 1; 0: the whole of a text of several lines) and template that match.

    Also every window of words that matches better than those that overlap it, with the line it begins in, unless the
    whole text, or a line that the window touches, matches the template. The size of a unit is its number of word pairs, repeats included; shared pairs count once. NULL and empty texts,
    and lines without words, match nothing. Rows alike give their matches each; several templates may match a line.
    Words of every line of a text with a telling word are counted; only of units whose size some template admits are pairs built. Further columns
    are ignored.
    """
    return _matches(docs, templates or TEMPLATES, least).drop("till")


def _matches(docs: DataFrame, templates: dict[str, str], least: float) -> DataFrame:
    """The matches with the line that they end in."""
    docs = docs.select(docs["doc_id"], docs["text"]).where(_told(docs["text"], templates, least))
    # One row per template and size: as many as the templates' words, whatever the input.
    known = template_table(docs.sparkSession, templates, least)
    sizes = [sizes_of(len(pairs_of(t)), least) for t in templates.values()]
    low, high = min(map(min, sizes)), max(map(max, sizes))
    counted = docs.select(
        docs["doc_id"], docs["text"],
        F.transform(F.split(docs["text"], "\n", -1),
                    lambda x: F.struct(x.alias("unit"), F.regexp_count(x, F.lit(WORD)).alias("words"))).alias("lines"),
    )

    def fits(words: Column) -> Column:
        return (words > 0) & F.greatest(words - 1, F.lit(1)).between(low, high)

    # A line break ends a word, so the words of the whole text are those of its lines.
    total = F.aggregate("lines", F.lit(0), lambda a, x: a + x["words"])
    placed = F.filter(F.transform("lines", lambda x, i: F.struct((i + 1).alias("line"), x["unit"].alias("unit"), x["words"].alias("words"))),
                      lambda x: fits(x["words"]))
    whole = F.when((F.size("lines") > 1) & fits(total), F.array(F.struct(F.lit(0).alias("line"), F.col("text").alias("unit"), total.alias("words"))))
    none = F.array().cast("array<struct<line: int, unit: string, words: int>>")
    units = counted.select("doc_id", F.explode(F.concat(placed, F.coalesce(whole, none))).alias("u"))
    own = units.select("doc_id", "u.line", _pairs(F.col("u.unit")).alias("pairs")).withColumn("size", F.size("pairs"))
    shared = F.size(F.array_intersect("pairs", "template"))
    dice = 2 * shared / (F.col("size") + F.col("n_template"))
    found = own.join(F.broadcast(known), "size").withColumn("dice", dice).where(F.col("dice") >= least)
    return found.select("doc_id", "line", F.col("line").alias("till"), "licence", "dice").unionByName(_windows(docs, templates, least))


def _windows(docs: DataFrame, templates: dict[str, str], least: float) -> DataFrame:
    """doc_id, line, till, licence, dice of windows. All work on a text is done inside its row."""
    listed = [(k, p, len(p), needed_in_window(len(p), least), math.floor(len(p) * (2 - least) / least + 1e-9))
              for k, v in templates.items() for p in [pairs_of(v)] if " " in p[0]]
    known = docs.sparkSession.createDataFrame(
        listed, "licence string, template array<string>, n_template int, needed int, largest int")
    texts = docs.select(docs["doc_id"], F.lower(docs["text"]).alias("text"))
    # Words with their line; lines without words have none.
    lines = F.transform(F.split("text", "\n", -1), lambda x: F.trim(F.regexp_replace(x, NOT_WORD, " ")))
    placed = F.flatten(F.transform(lines, lambda x, i: F.transform(
        F.filter(F.split(x, " "), lambda w: w != ""), lambda w: F.struct(w.alias("w"), (i + 1).alias("line")))))
    texts = texts.select("doc_id", F.size(lines).alias("n_lines"), placed.alias("words"))
    # Pairs of any template: place, pair, line of the first and of the second word.
    every = sorted({p for _, pairs, *_ in listed for p in pairs})
    all_pairs = F.zip_with(
        F.slice("words", 1, F.greatest(F.size("words") - 1, F.lit(0))), F.slice("words", 2, F.greatest(F.size("words") - 1, F.lit(0))),
        lambda a, b: F.struct(F.concat_ws(" ", a["w"], b["w"]).alias("pair"), a["line"].alias("line"), b["line"].alias("till")))
    hits = F.filter(
        F.transform(all_pairs, lambda x, i: F.struct(i.alias("at"), x["pair"].alias("pair"), x["line"].alias("line"), x["till"].alias("till"))),
        lambda x: x["pair"].isin(every))
    texts = texts.select("doc_id", "n_lines", "words", hits.alias("hits"))
    # From each pair to the templates that have it: a text meets the templates of which it has enough pairs.
    of_pair: dict[str, list[str]] = {}
    for name, pairs, *_ in listed:
        for pair in pairs:
            of_pair.setdefault(pair, []).append(name)
    having = F.from_json(F.lit(json.dumps(of_pair)), "map<string,array<string>>")
    needed = F.from_json(F.lit(json.dumps({name: n for name, _, _, n, _ in listed})), "map<string,int>")
    shared = F.array_sort(F.flatten(F.transform(F.array_distinct("hits.pair"), lambda p: F.element_at(having, p))))
    texts = texts.withColumn("shared", shared)
    enough = F.filter(F.array_distinct("shared"), lambda k: F.size(F.filter("shared", lambda x: x == k)) >= F.element_at(needed, k))
    near = texts.withColumn("licence", F.explode(enough)).drop("shared").join(F.broadcast(known), "licence")
    own = near.withColumn("hits", F.filter("hits", lambda x: F.array_contains("template", x["pair"])))
    # The last place before with the same pair, as far back as a window can reach.
    before = F.transform("hits", lambda x, i: F.struct(
        x["at"].alias("at"), x["line"].alias("line"), x["till"].alias("till"), x["pair"].alias("pair"),
        F.coalesce(F.array_max(F.transform(F.filter(
            F.slice("hits", F.greatest(i + 1 - F.col("largest"), F.lit(1)), F.least(i, F.col("largest"))),
            lambda y: y["pair"] == x["pair"]), lambda y: y["at"])), F.lit(-1)).alias("prev")))
    own = own.withColumn("hits", before)
    n = F.col("n_template")

    def best_from(a: Column, i: Column) -> Column:
        """Of the windows that begin with hit a: the best end."""
        start = F.struct(F.lit(0).alias("shared"), F.lit(0.0).alias("dice"), a["at"].alias("till_at"), a["till"].alias("till"))

        def step(s: Column, b: Column) -> Column:
            shared = s["shared"] + (b["prev"] < a["at"]).cast("int")
            size = b["at"] - a["at"] + 1
            dice = F.when(size <= F.col("largest"), 2.0 * shared / (size + n)).otherwise(0.0)
            better = dice > s["dice"]
            return F.struct(
                shared.alias("shared"), F.when(better, dice).otherwise(s["dice"]).alias("dice"),
                F.when(better, b["at"]).otherwise(s["till_at"]).alias("till_at"), F.when(better, b["till"]).otherwise(s["till"]).alias("till"))

        end = F.aggregate(F.slice("hits", i + 1, F.col("largest")), start, step)
        return F.transform(F.array(end), lambda e: F.struct(
            a["at"].alias("at"), e["till_at"].alias("till_at"), a["line"].alias("line"), e["till"].alias("till"), e["dice"].alias("dice")))[0]

    limit = F.when(n <= WHOLE_PAIRS, 1.0).otherwise(F.lit(float(least)))
    # A whole text that matches by itself is reported above.
    whole = F.when(F.col("n_lines") > 1, 2.0 * F.size(F.array_distinct("hits.pair")) / (F.size("words") - 1 + n)).otherwise(0.0)
    starts = F.when(whole < least, F.transform("hits", best_from)).otherwise(F.array())
    # Of windows that overlap, the best; of equal ones the first.
    kind = "array<struct<at: int, till_at: int, line: int, till: int, dice: double>>"
    picked = F.aggregate(F.filter(starts, lambda x: x["dice"] >= limit), F.array().cast(kind), lambda s, x: F.when(
        (F.size(s) > 0) & (F.element_at(s, -1)["till_at"] >= x["at"]),
        F.when(x["dice"] > F.element_at(s, -1)["dice"], F.concat(F.slice(s, 1, F.size(s) - 1), F.array(x))).otherwise(s),
    ).otherwise(F.concat(s, F.array(x))))
    # Outer, so that the optimizer does not repeat all of the above in a filter.
    each = own.select("doc_id", "licence", "n_template", "words", "hits", F.explode_outer(picked).alias("x")).where("x is not null")

    def alone(line: Column) -> Column:
        shared = F.size(F.array_distinct(F.transform(F.filter("hits", lambda h: (h["line"] == line) & (h["till"] == line)), lambda h: h["pair"])))
        return 2.0 * shared / (F.size(F.filter("words", lambda w: w["line"] == line)) - 1 + n) >= least

    found = each.where(~F.exists(F.sequence("x.line", "x.till"), alone))
    return found.select("doc_id", F.col("x.line").alias("line"), F.col("x.till").alias("till"), "licence", F.col("x.dice").alias("dice"))
