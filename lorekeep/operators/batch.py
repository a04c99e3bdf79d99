"""Vector search for a table of queries at once.

Queries go to the tasks in blocks of bounded size, and the blocks are worked on side by side. A task scans its
rows once for all queries of a block and keeps the k nearest of each, so that what it hands on is k ids a query,
never a pair table. A row is weighed exactly only if a matrix product finds it as near as the k-th so far. These meet query by query, and the diverse selection reads the vectors of the k best of each.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lorekeep.functions import vectors as V
from lorekeep.operators.similarity import diverse_selections
from lorekeep.sources.collections import staged

#: Components of the query vectors that travel to the tasks together (8 bytes each): 32 MB.
BLOCK_VALUES = 1 << 22
#: Blocks that the queries are dealt to, of so many queries at least; more blocks only if one would pass BLOCK_VALUES.
BLOCKS, LEAST_QUERIES = 48, 512
#: Rows that a task scans for a block, about, where there are several blocks.
ROWS_EACH = 1 << 18
#: Similarities that a task holds at a time (8 bytes each).
CELLS = 1 << 21


def _gaps(queries: np.ndarray, rows: np.ndarray, q: np.ndarray, r: np.ndarray, metric: str) -> np.ndarray:
    """Distances of the pairs (q, r), summed in the same order whatever stands beside a row."""
    total = np.zeros(len(q))
    for d in range(queries.shape[1]):
        ours, theirs = queries[:, d][q], rows[:, d][r]
        if metric == "l2":
            total += (theirs - ours) ** 2
        else:
            total += theirs * ours
    if metric == "l2":
        return total
    length = np.zeros(len(rows))
    for d in range(queries.shape[1]):
        length += rows[:, d] * rows[:, d]
    size = np.sqrt(length)[r] * np.array([np.sqrt((x * x).sum()) for x in queries])[q]
    return 1 - np.divide(total, size, out=np.zeros(len(q)), where=size > 0)


class _Best:
    """The k nearest rows of each query so far. What is found is merged in when it has grown to a share of what is kept."""

    def __init__(self, queries: int, k: int):
        self.k, self.kept, self.found, self.waiting = k, None, [], 0
        self.bars = np.full(queries, np.inf)  # the k-th distance, once there are k

    def add(self, q: np.ndarray, gaps: np.ndarray, ids: pa.Array) -> None:
        self.found.append(pa.table({"q": q.astype(np.int32), "gap": gaps, "id": ids}))
        self.waiting += len(q)
        if not np.isfinite(self.bars).all() or 2 * self.waiting >= len(self.bars) * self.k:
            self.merge()

    def merge(self) -> None:
        if not self.found:
            return
        both = pa.concat_tables(([] if self.kept is None else [self.kept]) + self.found).combine_chunks()
        both = both.take(pc.sort_indices(both, sort_keys=[("q", "ascending"), ("gap", "ascending"), ("id", "ascending")]))
        q = both["q"].to_numpy()
        first = np.searchsorted(q, np.arange(len(self.bars)))
        place = np.arange(len(q)) - first[q]
        last = np.flatnonzero(place == self.k - 1)
        self.bars[q[last]] = both["gap"].to_numpy()[last]
        self.kept, self.found, self.waiting = both.filter(pa.array(place < self.k)), [], 0


def _searcher(sent, k: int, metric: str):
    """A function of batches (id, embedding) that gives the k nearest rows of each query among those of a task."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start, queries = sent.value
        best = _Best(len(queries), k)
        squares = (queries * queries).sum(axis=1)
        # The larger this product, the nearer; `top` less the product is the distance.
        if metric == "l2":
            ours, top = 2 * queries, squares
        else:
            ours, top = queries / np.where(squares > 0, np.sqrt(squares), 1)[:, None], np.ones(len(queries))
        at_once = max(64, CELLS // max(1, len(queries)))
        for batch in batches:
            lengths = batch["embedding"].value_lengths().to_numpy(zero_copy_only=False)
            batch = batch.filter(pa.array(lengths == queries.shape[1]))
            for at in range(0, batch.num_rows, at_once):
                part = batch.slice(at, at_once)
                rows = part["embedding"].flatten().to_numpy(zero_copy_only=False).astype(float).reshape(part.num_rows, -1)
                norms = (rows * rows).sum(axis=1)
                if metric == "l2":
                    near = ours @ rows.T
                    near -= norms
                else:
                    near = ours @ (rows / np.where(norms > 0, np.sqrt(norms), 1)[:, None]).T
                bars = best.bars.copy()
                if k < part.num_rows and np.isinf(bars).any():
                    few = np.flatnonzero(np.isinf(bars))
                    bars[few] = top[few] - np.partition(near[few], part.num_rows - k, axis=1)[:, part.num_rows - k]
                # The quick product rounds far below 1e-9 of the values: what is that close is weighed exactly.
                slack = 1e-9 * np.maximum(np.maximum(1.0, np.where(np.isinf(bars), 1.0, np.abs(bars))), squares if metric == "l2" else 1.0)
                q, r = np.divmod(np.flatnonzero(near >= (top - bars - slack)[:, None]), part.num_rows)
                if len(q):
                    gaps = _gaps(queries, rows, q, r, metric)
                    fits = gaps <= best.bars[q]
                    best.add(q[fits], gaps[fits], part["id"].take(pa.array(r[fits])))
        best.merge()
        if best.kept is not None:
            for found in best.kept.to_batches(max_chunksize=1 << 16):
                numbers = pa.array(found["q"].to_numpy().astype(np.int64) + start)
                yield pa.RecordBatch.from_arrays([numbers, found["id"], found["gap"]], ["query_no", "id", "distance"])

    return search


def _blocks(queries: DataFrame, most: int) -> Iterator[tuple[list, np.ndarray]]:
    """Query ids and vectors of one length, at most `most` a block; the driver holds one block for each length."""
    open_: dict[int, tuple[list, list]] = {}
    for row in queries.toLocalIterator():
        ids, vectors = open_.setdefault(len(row["embedding"]), ([], []))
        ids.append(row["query_id"])
        vectors.append(row["embedding"])
        if len(ids) >= most or (len(ids) + 1) * len(row["embedding"]) > BLOCK_VALUES:
            yield ids, np.array(vectors, float)
            del open_[len(row["embedding"])]
    for ids, vectors in open_.values():
        yield ids, np.array(vectors, float)


def _usable(df: DataFrame, key: str) -> DataFrame:
    vector = F.col("embedding")
    whole = ~F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return df.where(F.col(key).isNotNull() & (F.size(vector) > 0) & whole).select(key, vector.cast("array<double>").alias("embedding"))


def batch_nearest(table: DataFrame, queries: DataFrame, k: int, metric: str = "cosine") -> DataFrame:
    """query_id, id, distance, rank: the k nearest rows of `table` (id, embedding) for each row of `queries` (query_id, embedding).

    Exact; ties go to the smaller id. Rows and queries without an id, or whose vector is NULL, empty or holds NULL or
    non-finite components, take no part, nor do rows of another length than the query. A table of queries of any
    size is worked through in blocks.
    """
    if metric not in V.METRICS:
        raise ValueError(f"unknown metric {metric!r}, expected one of {V.METRICS}")
    spark = table.sparkSession
    id_type, query_type = (d.schema[c].dataType.simpleString() for d, c in ((table, "id"), (queries, "query_id")))
    rows, asked = _usable(table, "id"), _usable(queries, "query_id")
    most = max(LEAST_QUERIES, -(-asked.count() // BLOCKS))
    names, founds = [], []
    for ids, vectors in _blocks(asked, most):
        if len(founds) == 1:  # scanned again for each block
            rows = staged(rows)
            rows = rows.coalesce(max(1, -(-rows.count() // ROWS_EACH)))
        sent = spark.sparkContext.broadcast((len(names), vectors))
        founds.append(rows.mapInArrow(_searcher(sent, k, metric), f"query_no long, id {id_type}, distance double"))
        names += enumerate(ids, len(names))
    if not founds:
        return spark.createDataFrame([], f"query_id {query_type}, id {id_type}, distance double, rank int")
    rank = F.row_number().over(W.partitionBy("query_no").orderBy("distance", "id"))
    ranked = reduce(DataFrame.unionAll, founds).withColumn("rank", rank).where(F.col("rank") <= k)
    named = spark.createDataFrame(names, f"query_no long, query_id {query_type}")
    return ranked.join(named, "query_no").select("query_id", "id", "distance", "rank")


def batch_search(table: DataFrame, queries: DataFrame, k: int, fetch_k: int, lambda_mult: float = 0.6, metric: str = "cosine") -> DataFrame:
    """query_id, id, rank: of the fetch_k nearest rows of each query, k chosen for relevance and variety. Ids of queries are unique."""
    near = staged(batch_nearest(table, queries, fetch_k, metric))
    target = queries.select("query_id", V.unit(F.col("embedding")).alias("target"))
    # The scan of the vectors meets a few ids for each query.
    scored = (
        table.select("id", V.unit(F.col("embedding")).alias("vec")).join(near.select("query_id", "id"), "id").join(target, "query_id")
        .select("query_id", "id", "vec", V.dot(F.col("vec"), F.col("target")).alias("sim"))
    )
    return diverse_selections(scored, k, lambda_mult, ["query_id"])
