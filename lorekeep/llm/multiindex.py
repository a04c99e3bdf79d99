"""Near duplicates among vectors by an inverted multi-index.

Unit vectors are cut into halves, and each half has a codebook of its own, learned from a bounded
sample. The two codebooks span a grid: a vector lies in the cell of its nearest code words. Two
vectors of cosine c are sqrt(2 - 2c) apart, so a vector at this distance lies in a cell whose
borders are no farther: for each half, the distance to the hyperplane between the nearest code
word and another one is a lower bound of the way into that one's cells. From each vector the
multi-sequence walk takes the cells in ascending order of the two bounds together, and stops at
the wished recall: at the bound that holds for certain (recall 1), or at one that the sample's
neighbours need. Vectors meet the members of the cells they visit, and the exact cosine decides.

Equal vectors are one class. Tasks hand on how many links a vector has in a cell, and which
vectors hang together there as one link each to the smallest: never the pairs.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorekeep.llm.components import connected_components
from lorekeep.llm.neighbours import usable
from lorekeep.sources.collections import staged

LEAST_COSINE = 0.98
#: Share of links that the walks are to find. On a table no larger than the sample, with under 1000 links, that is all of them.
WISHED_RECALL = 0.999
SAMPLE_ROWS = 8192
#: Code words per half: as many as give cells of about CELL_ROWS rows, within these bounds.
CELL_ROWS, FEWEST_WORDS, MOST_WORDS = 4096, 4, 64
#: Members and visitors of a cell that meet in one group at most (on average).
BLOCK_ROWS = 4096


def _units(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # so that squares neither overflow nor vanish
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def exact_cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosine of each row of a with the same row of b, summed in the same order whichever comes first."""
    dots, left, right = np.zeros(len(a)), np.zeros(len(a)), np.zeros(len(a))
    a, b = a / np.abs(a).max(axis=1, keepdims=True), b / np.abs(b).max(axis=1, keepdims=True)
    for d in range(a.shape[1]):
        dots += a[:, d] * b[:, d]
        left += a[:, d] * a[:, d]
        right += b[:, d] * b[:, d]
    return dots / np.sqrt(left * right)


def _code_words(x: np.ndarray, words: int, rounds: int = 20, seed: int = 11) -> np.ndarray:
    """k-means; distinct code words, at most `words`."""
    found = np.unique(x, axis=0)
    if len(found) <= words:
        return found
    found = found[np.random.default_rng(seed).choice(len(found), words, replace=False)]
    for _ in range(rounds):
        near = _squares(x, found).argmin(axis=1)
        counts = np.bincount(near, minlength=len(found))
        sums = np.zeros_like(found)
        np.add.at(sums, near, x)
        moved = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], found)
        if np.array_equal(moved, found):
            break
        found = moved
    return np.unique(found, axis=0)


def _squares(x: np.ndarray, words: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(axis=1)[:, None] - 2 * x @ words.T + (words * words).sum(axis=1), 0)


@dataclass
class Grid:
    """Code words of both halves, and how far (squared) a walk goes."""

    first: np.ndarray
    second: np.ndarray
    reach: float

    def _halves(self, units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return units[:, : self.first.shape[1]], units[:, self.first.shape[1] :]

    def cells(self, units: np.ndarray) -> np.ndarray:
        """The cell of each vector, as one number."""
        a, b = self._halves(units)
        return _squares(a, self.first).argmin(axis=1) * len(self.second) + _squares(b, self.second).argmin(axis=1)

    def bounds(self, units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each vector and code word of each half, the least squared way to where that word is nearest."""
        return tuple(_ways(x, words) for x, words in zip(self._halves(units), (self.first, self.second)))

    def visits(self, units: np.ndarray) -> list[np.ndarray]:
        """The cells that each vector's walk visits, nearest first."""
        ways_a, ways_b = self.bounds(units)
        order_a, order_b = np.argsort(ways_a, axis=1, kind="stable"), np.argsort(ways_b, axis=1, kind="stable")
        out = []
        for wa, wb, oa, ob in zip(ways_a, ways_b, order_a, order_b):
            out.append(np.array([oa[i] * len(self.second) + ob[j] for i, j in _walk(wa[oa], wb[ob], self.reach)], np.int64))
        return out


def _ways(x: np.ndarray, words: np.ndarray) -> np.ndarray:
    squares = _squares(x, words)
    own = squares.argmin(axis=1)
    apart = np.sqrt(np.maximum(_squares(words, words), 1e-300))
    way = np.maximum(squares - squares[np.arange(len(x)), own][:, None], 0) / (2 * apart[own])
    way[np.arange(len(x)), own] = 0
    return way * way


def _walk(a: np.ndarray, b: np.ndarray, reach: float) -> Iterator[tuple[int, int]]:
    """Multi-sequence: pairs of places in two ascending lists by ascending sum, up to `reach`."""
    heap = [(a[0] + b[0], 0, 0)]
    while heap:
        total, i, j = heapq.heappop(heap)
        if total > reach:
            return
        yield i, j
        if j + 1 < len(b):
            heapq.heappush(heap, (a[i] + b[j + 1], i, j + 1))
        if j == 0 and i + 1 < len(a):
            heapq.heappush(heap, (a[i + 1] + b[0], i + 1, 0))


def fit_grid(sample: np.ndarray, words: int, least: float = LEAST_COSINE, recall: float = WISHED_RECALL, seed: int = 37) -> Grid:
    """A grid from a sample of vectors, and how far a walk on it goes.

    With recall 1 that is as far as a linked vector can be. With less it is as far as this share of linked vectors
    needs: of those that are made from the sample, each as far off as a link allows and in a random direction, and
    of the sample's own links (found by comparing all of it); the farther of the two counts.
    """
    units = _units(sample.astype(float))
    cut = -(-units.shape[1] // 2)
    # A hair more than the bound, for the rounding of the ways.
    grid = Grid(_code_words(units[:, :cut], words), _code_words(units[:, cut:], words), 2 - 2 * least + 1e-9)
    if recall >= 1:
        return grid
    cells, (ways_a, ways_b) = grid.cells(units), grid.bounds(units)

    def needed(of: np.ndarray, there: np.ndarray) -> np.ndarray:
        return ways_a[of, there // len(grid.second)] + ways_b[of, there % len(grid.second)]

    off = np.random.default_rng(seed).normal(size=units.shape)
    off -= (off * units).sum(axis=1, keepdims=True) * units
    off /= np.maximum(np.sqrt((off * off).sum(axis=1, keepdims=True)), 1e-300)
    made = least * units + np.sqrt(max(0.0, 1 - least * least)) * off
    own = [np.zeros(0)]
    for start in range(0, len(units), 1024):
        i, j = np.nonzero(units[start : start + 1024] @ units.T >= least)
        i += start
        own.append(needed(i[i != j], cells[j[i != j]]))
    ways = [np.sort(needed(np.arange(len(units)), grid.cells(made))), np.sort(np.concatenate(own))]
    most = max(float(w[max(0, int(np.ceil(recall * len(w))) - 1)]) for w in ways if len(w))
    grid.reach = min(grid.reach, most + 1e-9)
    return grid


def _matrix(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _hang_together(left: np.ndarray, right: np.ndarray, n: int) -> np.ndarray:
    """The smallest number that each of n nodes reaches over links left[i] - right[i]."""
    least = np.arange(n)
    while True:
        low = np.minimum(least[left], least[right])
        again = least.copy()
        np.minimum.at(again, left, low)
        np.minimum.at(again, right, low)
        again = again[again]
        if np.array_equal(again, least):
            return least
        least = again


def _placed(grid_of):
    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grid = Grid(*grid_of.value)
        for batch in batches:
            for start in range(0, batch.num_rows, 4096):
                part = batch.slice(start, 4096)
                units = _units(_matrix(part["v"]).astype(float))
                visits = grid.visits(units)
                places = pa.array(np.concatenate(([0], np.cumsum([len(v) for v in visits]))), pa.int32())
                there = pa.ListArray.from_arrays(places, pa.array(np.concatenate(visits), pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [part["key"], part["class"], part["copies"], part["v"], pa.array(grid.cells(units), pa.int64()), there],
                    ["key", "class", "copies", "v", "cell", "visits"])

    return place


def _meeting(least: float):
    """A function of a cell's visitors and members that gives links per class, and one link to the smallest it hangs together with."""

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        out_class, out_links, out_root = [], [], []
        if left.num_rows and right.num_rows:
            ids = np.concatenate((left["class"].to_numpy(), right["class"].to_numpy()))
            a, b = _matrix(left["v"]).astype(float), _matrix(right["v"]).astype(float)
            ua, ub = _units(a), _units(b)
            copies_a, copies_b = left["copies"].to_numpy(), right["copies"].to_numpy()
            at_home = left["home"].to_numpy(zero_copy_only=False)
            id_a, id_b = left["class"].to_numpy(), right["class"].to_numpy()
            links_a, links_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
            root = np.arange(len(ids))
            for start in range(0, len(a), 512):
                part = slice(start, start + 512)
                rough = ua[part] @ ub.T
                linked = rough >= least + 1e-9
                # Rounding of the quick product is far below 1e-9: what is that close is weighed exactly.
                i, j = np.nonzero(np.abs(rough - least) < 1e-9)
                linked[i, j] = exact_cosines(a[part][i], b[j]) >= least
                linked &= id_a[part][:, None] != id_b[None, :]
                links_a[part] = linked @ copies_b
                links_b += copies_a[part][~at_home[part]] @ linked[~at_home[part]]
                i, j = np.nonzero(linked)
                if len(i):
                    root = _hang_together(np.concatenate((np.arange(len(ids)), i + start)), np.concatenate((root, j + len(a))), len(ids))
            smallest = np.full(len(ids), np.iinfo(np.int64).max)
            np.minimum.at(smallest, root, ids)  # the smallest class of each group stands for it
            touched = np.concatenate((links_a, links_b)) > 0
            touched |= smallest[root] != ids
            out_class, out_root = ids[touched], smallest[root][touched]
            out_links = np.concatenate((links_a, links_b))[touched]
        return pa.table({"class": pa.array(out_class, pa.int64()), "links": pa.array(out_links, pa.int64()), "root": pa.array(out_root, pa.int64())})

    return meet


def _links(classes: DataFrame, rows: int, least: float, recall: float, sample_rows: int, words: int | None, block_rows: int) -> DataFrame:
    """class, links, root of a staged table of classes (key, class, copies, v) of vectors of one length."""
    spark = classes.sparkSession
    value = classes.schema["v"].dataType.elementType.simpleString()
    drawn = classes.orderBy(F.xxhash64("class", F.lit(23)), "class").limit(sample_rows).select("v").toArrow()
    words = words or int(min(MOST_WORDS, max(FEWEST_WORDS, np.sqrt(rows / CELL_ROWS))))
    fitted = fit_grid(_matrix(drawn["v"]), words, least, recall)
    grid = spark.sparkContext.broadcast((fitted.first, fitted.second, fitted.reach))  # arrays: workers need no class of ours
    index = staged(classes.mapInArrow(
        _placed(grid), f"key long, class long, copies long, v array<{value}>, cell long, visits array<long>"))
    # Few rows: one for each label and cell.
    sizes = index.groupBy("key", "cell").agg(F.count(F.lit(1)).alias("members"))
    blocks = sizes.select("key", "cell", F.ceil(F.col("members") / block_rows).cast("int").alias("blocks"))
    members = index.join(blocks, ["key", "cell"]).select(
        "key", "cell", F.pmod(F.xxhash64("class", F.lit(29)), F.col("blocks")).cast("int").alias("block"), "class", "copies", "v")
    # Of two cells the walk of the lower one's vectors finds the links, for both sides; each cell visits itself.
    there = index.select("key", "class", "copies", "v", F.col("cell").alias("own"), F.explode("visits").alias("cell")).where("cell >= own")
    asked = there.groupBy("key", "cell").agg(F.count(F.lit(1)).alias("visitors")).select(
        "key", "cell", F.ceil(F.col("visitors") / (4 * block_rows)).cast("int").alias("chunks"))
    shape = staged(blocks.join(asked, ["key", "cell"]))
    visitors = (
        there.join(shape, ["key", "cell"])
        .withColumn("chunk", F.pmod(F.xxhash64("class", F.lit(31)), F.col("chunks")).cast("int"))
        .select("key", "cell", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "chunk", "class", "copies", "v",
                (F.col("own") == F.col("cell")).alias("home"))
    )
    members = members.join(shape.select("key", "cell", "chunks"), ["key", "cell"]).select(
        "key", "cell", "block", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), "class", "copies", "v")
    members = members.select(*[F.col(c).alias(c) for c in members.columns])  # names of their own beside the visitors'
    keys = ["key", "cell", "block", "chunk"]
    return visitors.groupBy(*keys).cogroup(members.groupBy(*keys)).applyInArrow(_meeting(least), "class long, links long, root long")


def linked_vectors(
    vectors: DataFrame, least: float = LEAST_COSINE, recall: float = WISHED_RECALL, id_col: str = "vec_id", vector_col: str = "embedding",
    label_col: str = "label", sample_rows: int = SAMPLE_ROWS, words: int | None = None, block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """vec_id, n_links, component_id, kept: one row for each row of `vectors`, whose ids are whole numbers.

    Two rows link if their labels are equal and not NULL, their vectors have the same length and their cosine in
    double precision is `least` or more; of such links the share `recall` is looked for (1: all). n_links counts the other rows that a row links with, component_id is the
    smallest id that it reaches over links (its own, where it links with nothing), kept whether that is its own.

    Vectors that are NULL, empty, zero or hold NULL or non-finite components link with nothing; so do rows
    with a NULL id (component_id NULL, not kept). Rows alike in id, label and vector are rows of their own that link with
    each other. An empty table gives an empty result. Other columns are not looked at.
    """
    v, kind = F.col("v"), vectors.schema[vector_col].dataType.elementType.simpleString()
    kind = kind if kind in ("float", "double") else "double"
    all_rows = vectors.select(
        vectors[id_col].cast("long").alias("vec_id"), vectors[label_col].alias("label"), vectors[vector_col].cast(f"array<{kind}>").alias("v"))
    good = usable(all_rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull()), "v")
    # -0.0 and 0.0 are one value.
    good = good.withColumn("v", F.transform(v, lambda x: F.when(x == 0, F.lit(0.0).cast(kind)).otherwise(x)))
    classes = staged(good.groupBy("label", "v").agg(F.min("vec_id").alias("class"), F.count(F.lit(1)).alias("copies")))
    # An id may stand for several vectors: then the class needs a number of its own.
    if classes.select(F.count(F.lit(1)) - F.count_distinct("class")).head()[0]:
        classes = staged(classes.withColumn("least_id", F.col("class")).withColumn("class", F.monotonically_increasing_id()))
    else:
        classes = classes.withColumn("least_id", F.col("class"))
    classes = classes.withColumn("key", F.xxhash64("label", F.size("v")))
    lengths = [r["d"] for r in classes.select(F.size("v").alias("d")).distinct().collect()]  # a row for each length
    links = None
    for d in lengths:
        one = classes.where(F.size("v") == d).select("key", "class", "copies", "v")
        rows = one.count()
        found = _links(one, rows, least, recall, sample_rows, words, block_rows)
        links = found if links is None else links.unionByName(found)
    if links is None:
        return all_rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.col("vec_id").isNotNull().alias("kept"))
    links = staged(links)
    per_class = links.groupBy("class").agg(F.sum("links").alias("links"))
    parts = connected_components(links.select(F.col("class").alias("a"), F.col("root").alias("b")))
    known = classes.join(per_class, "class", "left").join(parts.withColumnRenamed("node", "class"), "class", "left")
    known = known.select("label", "v", "class", "copies", "least_id", "links", F.coalesce("component", "class").alias("component"))
    smallest = known.groupBy("component").agg(F.min("least_id").alias("component_id"))
    return _for_rows(all_rows, known.join(smallest, "component"), kind)


def _for_rows(all_rows: DataFrame, known: DataFrame, kind: str) -> DataFrame:
    """The classes' results for each row."""
    plain = F.transform("v", lambda x: F.when(x == 0, F.lit(0.0).cast(kind)).otherwise(x))
    own: Column = F.coalesce("component_id", "vec_id")
    of = known.select("label", "v", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
    rows = all_rows.withColumn("v", plain)
    found = rows.where(F.col("vec_id").isNotNull()).join(of, ["label", "v"], "left")
    out = found.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), own.alias("component_id"))
    none = F.lit(None).cast("long")
    out = out.unionByName(rows.where(F.col("vec_id").isNull()).select("vec_id", F.lit(0).cast("long").alias("n_links"), none.alias("component_id")))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
