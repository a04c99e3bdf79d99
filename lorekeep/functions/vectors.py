"""Similarity of embedding columns, as native array expressions in double precision."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from lorekeep.functions.binding import let

METRICS = ("cosine", "l2")

#: What `hashed` counts: runs of letters and digits, and every other character beyond ASCII by itself.
FEATURE = r"[a-z0-9\x{C0}-\x{24F}]+|[^\x00-\x7F]"
LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: ASCII beside letters and digits, and the characters that are features by themselves.
_BETWEEN = "".join(chr(i) for i in range(128) if not chr(i).isalnum())
_ALONE = r"([^\x00-\x7F\x{C0}-\x{24F}])"


def as_literal(vector: Sequence[float]) -> Column:
    """A query vector as a constant array."""
    return F.array(*[F.lit(float(x)) for x in vector])


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda total, x: total + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def squared_l2(a: Column, b: Column) -> Column:
    gaps = F.zip_with(a, b, lambda x, y: x.cast("double") - y.cast("double"))
    return F.aggregate(gaps, F.lit(0.0), lambda total, x: total + x * x)


def distance_to(a: Column, query: Sequence[float], metric: str = "cosine") -> Column:
    """Distance of a vector column to one query, smaller is nearer: 1 - cosine, or squared Euclidean.

    The query is scaled here, once, so that a row costs one product and one norm.
    """
    if metric == "l2":
        return squared_l2(a, as_literal(query))
    if metric != "cosine":
        raise ValueError(f"unknown metric {metric!r}, expected one of {METRICS}")
    length = norm(a)
    return F.when(length == 0, F.lit(1.0)).otherwise(F.lit(1.0) - dot(a, unit_literal(query)) / length)


def unit(a: Column) -> Column:
    """Vector scaled to length one, in double precision."""
    return let(
        norm(a), lambda size: F.transform(a, lambda x: F.when(size == 0, F.lit(0.0)).otherwise(x.cast("double") / size))
    )


def unit_literal(query: Sequence[float]) -> Column:
    """A query vector scaled to length one, as a constant array."""
    size = math.sqrt(sum(float(x) ** 2 for x in query))
    return as_literal([float(x) / size if size else 0.0 for x in query])


def hashed(text: Column, dim: int = 64) -> Column:
    """Text as a vector of length 1000 in whole numbers: its features, A-Z lower-cased, counted in hashed places.

    A feature counts up or down in one of `dim` places, by the first eight digits of its MD5. Whole numbers make
    distances exact, whatever the order of summation. Text without features gives zeros, NULL gives NULL.
    """
    # All matches of FEATURE, by one translation and a split: a search for so many short matches costs several times as much.
    apart = F.when(text.rlike(_ALONE), F.regexp_replace(text, _ALONE, " $1 ")).otherwise(text)
    words = F.split(F.translate(apart, LETTERS + _BETWEEN, LETTERS.lower() + " " * len(_BETWEEN)), " ")
    features = F.filter(words, lambda w: w != "")
    place = lambda w: F.conv(F.left(F.md5(w), F.lit(8)), 16, 10).cast("long") % (2 * dim)
    # A character for each place and direction: counting is a search in one string, not a pass over an array of codes.
    signs = [chr(1 + i) for i in range(2 * dim)]
    count = lambda marks, sign: F.length(marks) - F.length(F.replace(marks, sign, F.lit("")))
    pairs = F.array(*[F.struct(F.lit(up).alias("up"), F.lit(down).alias("down")) for up, down in zip(signs[:dim], signs[dim:])])
    sums = let(
        F.array_join(F.transform(features, lambda w: F.get(F.lit(signs), place(w).cast("int"))), ""),
        lambda marks: F.transform(pairs, lambda p: count(marks, p["up"]) - count(marks, p["down"])),
    )
    scaled = let(
        sums, lambda v: let(norm(v), lambda size: F.transform(v, lambda x: F.when(size == 0, F.lit(0.0)).otherwise(F.floor(x * F.lit(1000.0) / size + 0.5)).cast("float")))
    )
    return F.when(text.isNotNull(), scaled)
