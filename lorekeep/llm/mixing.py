"""Mixing sources to target weights by the cube method.

Every source gets a target number of words; a document is taken target / size-of-source
times on average: the whole part for certain, the fraction as an inclusion probability. The
cube method turns the probabilities into yes or no while it keeps two totals per source: the
words and the documents taken. In a block of documents, three at a time, probabilities move
along the one direction that changes neither total, until one of them is 0 or 1; at most two
documents of a block stay undecided. These go on to larger blocks, level by level, until one
block per source is left, whose last two are drawn at random (the landing).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lorekeep.llm.tables import WORD, own, small, unused
from lorekeep.sources.collections import staged

WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
MOST_COPIES = 2.0
BLOCK_ROWS = 4096


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE,
                   most: float = MOST_COPIES) -> DataFrame:
    """source, source_size, n_docs, target. `sizes`: source, size.

    Sources in code point order, NULL last, take the weights in turn. `share` of all words is dealt out
    by weight; no target is above `most` times its source's size, what is over goes to the others.
    One row per source is all that is ordered or summed here.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    rank = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last()))
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.col("rank") - 1) % len(weights) + 1).cast("int"))
    ranked = per.withColumn("rank", rank).withColumn("weight", weight).withColumn("cap", F.col("source_size") * most)
    # The sources that reach their cap are those with the least cap per weight: with the first k
    # of them full, the others get the rest by weight. The level is the first that overfills none of them.
    by_fill = W.orderBy(F.col("cap") / F.col("weight"), "rank").rowsBetween(W.unboundedPreceding, -1)
    everyone = W.partitionBy()
    rest = F.sum("source_size").over(everyone) * share - F.coalesce(F.sum("cap").over(by_fill), F.lit(0.0))
    left = F.sum("weight").over(everyone) - F.coalesce(F.sum("weight").over(by_fill), F.lit(0.0))
    filled = ranked.withColumn("level", rest / left)
    fits = F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct(F.col("cap") / F.col("weight"), "level"))
    level = F.min(fits).over(everyone)["level"]
    target = F.coalesce(F.least(F.col("cap"), level * F.col("weight")), F.col("cap"))
    return filled.select("source", "source_size", "n_docs", target.cast("double").alias("target"))


def cube_flight(prob: np.ndarray, size: np.ndarray, seed: int) -> np.ndarray:
    """Probabilities after the flight: all but at most two are 0 or 1, both totals are kept."""
    rng, p = np.random.default_rng(seed), prob.astype(float).copy()
    tiny = 1e-9
    active: list[int] = []
    for i in range(len(p)):
        if p[i] < tiny or p[i] > 1 - tiny:
            p[i] = round(p[i])
            continue
        active.append(i)
        while len(active) == 3:
            a, b, c = active
            # What changes neither the number nor the words: u_a + u_b + u_c = 0, and the same weighted by size.
            u = (size[b] - size[c], size[c] - size[a], size[a] - size[b])
            if not any(u):
                u = (1.0, -1.0, 0.0)
            up = min((1 - p[i]) / v if v > 0 else p[i] / -v for i, v in zip(active, u) if v)
            down = min(p[i] / v if v > 0 else (1 - p[i]) / -v for i, v in zip(active, u) if v)
            move = up if rng.random() * (up + down) < down else -down
            for i2, v in zip(active, u):
                p[i2] += move * v
                if p[i2] < tiny or p[i2] > 1 - tiny:
                    p[i2] = float(p[i2] > 0.5)
            active = [k for k in active if 0 < p[k] < 1]
    return p


def _landing(p: np.ndarray, seed: int) -> np.ndarray:
    rng, out, carry = np.random.default_rng(seed), p.copy(), 0.0
    for i in np.flatnonzero((p > 0) & (p < 1)):
        # Rounded in turn, the rounding error goes into the next draw: the count stays within one.
        q = min(1.0, max(0.0, p[i] + carry))
        out[i] = float(rng.random() < q)
        carry = q - out[i]
    return out


def _flight(names: list[str], seed: int, level: int, last: bool):
    def fly(group: pa.Table) -> pa.Table:
        # Large documents first: what is left open in the end is small.
        group = group.sort_by([("size", "descending"), ("doc_id", "ascending")])
        # The seed comes from what the block holds, so it does not depend on how Spark deals blocks out.
        mark = int(group["spread"].to_numpy().sum()) & 0xFFFFFFFF
        p = cube_flight(group["p"].to_numpy(), group["size"].to_numpy().astype(float),
                        hash((seed, level, mark)) & 0xFFFFFFFF)
        p = _landing(p, hash((seed, -1, mark)) & 0xFFFFFFFF) if last else p
        for name, values in (("p", pa.array(p)), ("level", pa.array(np.full(len(p), level + 1, np.int32)))):
            group = group.set_column(names.index(name), name, values)
        return group.select(names)

    return fly


def take_copies(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE,
                most: float = MOST_COPIES, seed: int = 7, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """doc_id, size, source, source_size, target, copies for every document.

    `docs`: doc_id, size, source. NULL size counts as 0; documents of size 0 or of a source without words
    are taken as often as their source's rate says, and add no words. Rows alike in all three columns are
    drawn one by one; which of them is taken makes no difference. A rerun on the same rows, in any order
    and any partitioning, gives the same result. An empty table gives an empty result.
    """
    base = docs.select("doc_id", F.coalesce("size", F.lit(0)).cast("long").alias("size"), "source")
    targets = staged(source_targets(base, weights, share, most))
    joined = base.alias("d").join(small(targets).alias("t"), F.expr("d.source <=> t.source"))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    rate = F.least(rate, F.lit(float(most)))
    whole = F.floor(rate + 1e-12)
    rows = joined.select(
        "d.doc_id", "d.size", "d.source", "source_size", "target", "n_docs",
        whole.cast("int").alias("sure"), F.greatest(rate - whole, F.lit(0.0)).alias("p"),
        F.xxhash64("d.doc_id", "d.size").alias("spread"), F.lit(0).alias("level"),
    )
    schema = rows.schema
    names = schema.fieldNames()
    undecided, done = rows, None
    most_docs = max(1, targets.agg(F.max("n_docs")).head()[0] or 1)
    level = 0
    while True:
        # A block holds block_rows documents on average; each leaves at most two for the next level.
        blocks = F.ceil(F.col("n_docs") * (2.0 / block_rows) ** level / block_rows).cast("long")
        last = most_docs * (2.0 / block_rows) ** level <= block_rows
        block = F.lit(0).cast("long") if last else F.pmod(F.xxhash64("spread", F.lit(level)), blocks)

        flown = staged(undecided.groupBy("source", block.alias("block")).applyInArrow(_flight(names, seed, level, last), schema))
        settled = flown.where((F.col("p") <= 0) | (F.col("p") >= 1))
        done = settled if done is None else done.unionByName(settled)
        if last:
            break
        undecided = flown.where((F.col("p") > 0) & (F.col("p") < 1))
        level += 1
    copies = (F.col("sure") + F.col("p").cast("int")).cast("long")
    return done.select("doc_id", "size", "source", "source_size", "target", copies.alias("copies"))


def with_size(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """doc_id, source and size: the number of words of the text (NULL: 0)."""
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")
    return docs.select(*own(docs, "doc_id", "source"), size.alias("size"))


def mixed(docs: DataFrame, seed: int = 7) -> DataFrame:
    """doc_id, size, source_size, target, taken (words, repeats counted) of every document."""
    return take_copies(with_size(docs), seed=seed).select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).cast("long").alias("taken")
    )


def repeated(docs: DataFrame, seed: int = 7) -> DataFrame:
    """`docs`, all columns, each row as often as the mixture takes its document.

    What is joined to the texts is one small row per distinct (doc_id, source, size) with the copies of all such
    rows, given to them in turn. NULL text has size 0. Cases as in take_copies.
    """
    size, no, copies, key = unused(docs, "size", "no", "copies", "key")
    words = F.coalesce(F.regexp_count(docs["text"], F.lit(WORD)), F.lit(0)).cast("long")
    with_key = docs.withColumn(size, words).withColumn(key, F.xxhash64("doc_id", "source", size))
    drawn = take_copies(with_size(docs), seed=seed)
    per_key = drawn.groupBy(F.xxhash64("doc_id", "source", "size").alias(key)).agg(
        F.sort_array(F.collect_list("copies"), asc=False).alias(copies))
    per_key = small(staged(per_key))
    joined = with_key.join(per_key, key)
    # Rows alike take the drawn copies in turn; a key of one row, the usual case, needs no numbering.
    alone = joined.where(F.size(copies) == 1).withColumn(no, F.lit(1))
    alike = joined.where(F.size(copies) > 1).withColumn(no, F.row_number().over(W.partitionBy(key).orderBy(size)))
    out = alone.unionByName(alike)
    times = F.element_at(F.col(copies), F.col(no))
    return out.where(times > 0).withColumn(no, F.explode(F.sequence(F.lit(1).cast("long"), times))).select(*docs.columns)
