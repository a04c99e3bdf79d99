"""Approximate nearest neighbours by learned partitions.

On a bounded sample of the vectors a graph of nearest neighbours is cut into parts of equal
size that keep neighbours together. A small network learns to tell from a vector alone in
which parts its neighbours lie. It then places every vector of the table in its most probable
part and sends each query to so many of its most probable parts as sample queries need to
reach the wished recall. In these parts the exact cosine decides.

The number of parts follows the rows of the table, and the sample follows the parts. Small parts
travel together in blocks: a block's vectors are sent once, and each query once to every block
that holds a part it probes.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lorekeep.sources.collections import staged

#: A part for so many rows of the table, up to so many parts.
PART_ROWS, MAX_PARTS = 96, 512
#: The sample: at least so many vectors, and so many for each part (16,384 for the most parts).
SAMPLE_ROWS, SAMPLE_PART_ROWS = 8192, 32
GRAPH_NEIGHBOURS = 10
WISHED_RECALL = 0.93
#: Candidates held for a block (on average), queries that share a copy of it, and queries weighed at once.
BLOCK_ROWS, QUERY_ROWS, STEP = 8192, 65536, 256


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # so that squares neither overflow nor vanish
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def exact_pairs(asked: np.ndarray, there: np.ndarray) -> np.ndarray:
    """Cosine of row i of `asked` with row i of `there`, unit vectors, summed in the same order whatever stands beside it."""
    out = np.zeros(len(asked))
    for d in range(asked.shape[1]):
        out += there[:, d] * asked[:, d]
    return out


def nearest_rows(asked: np.ndarray, x: np.ndarray, k: int) -> np.ndarray:
    """The k rows of x nearest to each asked row, both unit vectors, in no set order."""
    out = []
    for start in range(0, len(asked), STEP):
        near = -(asked[start : start + STEP] @ x.T)
        out.append(np.argpartition(near, k - 1, axis=1)[:, :k].copy())  # a view would keep all columns
    return np.vstack(out)


def neighbour_graph(x: np.ndarray, k: int) -> np.ndarray:
    """The k nearest other rows of each row of unit vectors."""
    k, out = min(k, len(x) - 1), []
    for start in range(0, len(x), STEP):
        near = -(x[start : start + STEP] @ x.T)
        near[np.arange(len(near)), start + np.arange(len(near))] = 2
        out.append(np.argpartition(near, k - 1, axis=1)[:, :k].copy())  # a view would keep all columns
    return np.vstack(out)


def balanced_parts(x: np.ndarray, graph: np.ndarray, parts: int, rounds: int = 12) -> np.ndarray:
    """A part for each row, of equal size within a tenth, that keeps graph neighbours together.

    Halves along main directions give equal parts to begin with; then rows move to the part that
    most of their neighbours are in, those that gain most first, while there is room.
    """
    part = np.zeros(len(x), int)
    pieces = [np.arange(len(x))]
    while len(pieces) < parts:
        pieces.sort(key=len)
        rows = pieces.pop()
        centred = x[rows] - x[rows].mean(axis=0)
        _, turned = np.linalg.eigh(centred.T @ centred)
        order = rows[np.argsort(centred @ turned[:, -1], kind="stable")]
        pieces += [order[: len(order) // 2], order[len(order) // 2 :]]
    for i, rows in enumerate(pieces):
        part[rows] = i
    room = int(np.ceil(len(x) / parts * 1.1))
    back = [[] for _ in range(len(x))]
    for i, row in enumerate(graph):
        for j in row:
            back[j].append(i)
    around = [np.concatenate((row, back[i])).astype(int) for i, row in enumerate(graph)]
    for _ in range(rounds):
        want, gain = np.zeros(len(x), int), np.zeros(len(x), int)
        for i, near in enumerate(around):
            votes = np.bincount(part[near], minlength=parts)
            want[i] = votes.argmax()
            gain[i] = votes[want[i]] - votes[part[i]]
        size, moved = np.bincount(part, minlength=parts), 0
        for i in np.argsort(-gain, kind="stable"):
            if gain[i] <= 0:
                break
            if size[want[i]] < room:
                size[part[i]] -= 1
                size[want[i]] += 1
                part[i] = want[i]
                moved += 1
        if not moved:
            break
    return part


@dataclass
class Router:
    """The network: one hidden layer, and how many parts a query needs."""

    hidden: np.ndarray
    hidden_shift: np.ndarray
    out: np.ndarray
    out_shift: np.ndarray
    probes: int

    def values(self, unit: np.ndarray) -> np.ndarray:
        return np.maximum(unit @ self.hidden + self.hidden_shift, 0) @ self.out + self.out_shift

    def part(self, unit: np.ndarray) -> np.ndarray:
        """The most probable part of each vector."""
        return self.values(unit).argmax(axis=1)

    def order(self, unit: np.ndarray) -> np.ndarray:
        """Parts of each vector, most probable first."""
        return np.argsort(-self.values(unit), axis=1, kind="stable")


def _train(x: np.ndarray, wanted: np.ndarray, parts: int, width: int = 128, rounds: int = 25, rate: float = 3e-3, seed: int = 3) -> Router:
    """`wanted` holds for each row parts that it is to be sent to, those that count more than once repeated."""
    rng = np.random.default_rng(seed)
    w = [rng.normal(size=(x.shape[1], width)) * np.sqrt(2 / x.shape[1]) * 4, np.zeros(width),
         rng.normal(size=(width, parts)) * np.sqrt(1 / width), np.zeros(parts)]
    slope, square, step = [np.zeros_like(a) for a in w], [np.zeros_like(a) for a in w], 0
    for _ in range(rounds):
        order = rng.permutation(len(x))
        for start in range(0, len(x), 256):
            rows = order[start : start + 256]
            a = np.maximum(x[rows] @ w[0] + w[1], 0)
            e = a @ w[2] + w[3]
            e = np.exp(e - e.max(axis=1, keepdims=True))
            d = e / e.sum(axis=1, keepdims=True)
            np.subtract.at(d, (np.arange(len(rows))[:, None], wanted[rows]), 1 / wanted.shape[1])
            d /= len(rows)
            da = (d @ w[2].T) * (a > 0)
            step += 1
            for i, g in enumerate((x[rows].T @ da, da.sum(axis=0), a.T @ d, d.sum(axis=0))):
                slope[i] = 0.9 * slope[i] + 0.1 * g
                square[i] = 0.999 * square[i] + 0.001 * g * g
                w[i] = w[i] - rate * (slope[i] / (1 - 0.9**step)) / (np.sqrt(square[i] / (1 - 0.999**step)) + 1e-8)
    return Router(*w, probes=parts)


def parts_for(rows: int, part_rows: int = PART_ROWS, max_parts: int = MAX_PARTS) -> int:
    """A power of two (so that halving gives equal parts): one part for `part_rows` rows, within the bound."""
    return 1 << max(0, min(rows // part_rows, max_parts).bit_length() - 1)


def fit_router(sample: np.ndarray, parts: int, wished: float = WISHED_RECALL, k: int = 5) -> Router:
    """Partition, network and number of probes from a sample of vectors.

    A quarter of the sample is kept from the graph: it plays the queries whose recall sets the probes.
    """
    unit = _unit(sample.astype(float))
    held = len(unit) // 4
    kept, asked = unit[held:], unit[:held]
    if parts == 1 or len(kept) < 4 * parts or len(kept) <= k or not held:
        none = np.zeros((unit.shape[1], 1))
        return Router(none, np.zeros(1), np.zeros((1, 1)), np.zeros(1), 1)
    graph = neighbour_graph(kept, GRAPH_NEIGHBOURS)
    part = balanced_parts(kept, graph, parts)
    router = _train(kept, np.column_stack([part[graph], part, part]), parts)
    placed = router.part(kept)
    place_of = np.argsort(router.order(asked), axis=1)  # at which probe a part is reached
    reached = place_of[np.arange(len(asked))[:, None], placed[nearest_rows(asked, kept, k)]]
    shares = np.array([(reached < probes).mean() for probes in range(1, parts + 1)])
    router.probes = int(np.argmax(shares >= wished)) + 1
    return router


def blocks_of(counts: dict[int, int], parts: int, block_rows: int = BLOCK_ROWS) -> tuple[list[int], list[int]]:
    """For each part its bundle, and for each bundle in how many blocks its rows are split.

    Neighbouring small parts share a bundle of at most `block_rows` rows; a larger part has its own.
    """
    bundle_of, rows = [], []
    for part in range(parts):
        count = counts.get(part, 0)
        if rows and rows[-1] + count <= block_rows:
            rows[-1] += count
        else:
            rows.append(count)
        bundle_of.append(len(rows) - 1)
    return bundle_of, [max(1, -(-n // block_rows)) for n in rows]


def best_in_block(asked: np.ndarray, own: np.ndarray, probes: list, there: np.ndarray, ids: np.ndarray, part: np.ndarray, k: int):
    """Places of queries and candidates and their cosines: the k best of each query in the parts that it probes.

    `there` stands in the order of `part`. Rounding of the quick product is far below 1e-9: what may be
    among the k of a part is weighed exactly.
    """
    turn = np.unique(ids, return_inverse=True)[1] if ids.dtype == object else ids
    lengths = np.array([len(p) for p in probes])
    query_of, probed = np.repeat(np.arange(len(asked)), lengths), np.concatenate(probes).astype(int)
    by_part = np.argsort(probed, kind="stable")
    query_of, probed = query_of[by_part], probed[by_part]
    best = [np.zeros(0, int)] * 2 + [np.zeros(0)]
    cuts = np.flatnonzero(np.diff(probed)) + 1
    for queries, number in zip(np.split(query_of, cuts), probed[np.concatenate(([0], cuts))]):
        first, last = np.searchsorted(part, (number, number + 1))
        if first == last:
            continue
        rough = asked[queries] @ there[first:last].T
        rough[own[queries][:, None] == ids[None, first:last]] = -np.inf
        bar = np.partition(rough, -k, axis=1)[:, -k] if rough.shape[1] > k else np.full(len(rough), -np.inf)
        q, c = np.nonzero((rough >= bar[:, None] - 1e-9) & (rough > -np.inf))
        q, c = queries[q], c + first
        q, c, score = (np.concatenate(x) for x in zip(best, (q, c, exact_pairs(asked[q], there[c]))))
        order = np.lexsort((turn[c], -score, q))
        q, c, score = q[order], c[order], score[order]
        rank = np.arange(len(q)) - np.searchsorted(q, q)
        best = [q[rank < k], c[rank < k], score[rank < k]]
    return best


def usable(vectors: DataFrame, vector_col: str) -> DataFrame:
    """Rows whose vector is not NULL, not empty, not all zero and holds only finite numbers."""
    v = F.col(vector_col)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vectors.where(v.isNotNull() & (F.size(v) > 0)).where(~bad & F.exists(v, lambda x: x != 0))


def nearest(
    vectors: DataFrame,
    is_query,
    k: int = 5,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    part_rows: int = PART_ROWS,
    block_rows: int = BLOCK_ROWS,
    query_rows: int = QUERY_ROWS,
    wished: float = WISHED_RECALL,
) -> DataFrame:
    """query_id, rank, vec_id, score: the k rows of largest cosine found for each row that `is_query` holds for.

    A row is never its own neighbour, nor is any row with the query's id; ties go to the smaller id.
    Vectors that are NULL, empty, zero, hold NULL or non-finite components or have another length than
    most, and rows with a NULL id, take no part. Rows alike in id and vector count as one. Tables too small
    for two parts are searched whole; an empty table gives an empty result.
    """
    spark = vectors.sparkSession
    id_type = vectors.schema[id_col].dataType.simpleString()
    kind = vectors.schema[vector_col].dataType.elementType.simpleString()
    kind = kind if kind == "float" else "double"  # single numbers travel as such and are weighed in double
    rows = usable(vectors.select(vectors[id_col].alias("id"), vectors[vector_col].cast(f"array<{kind}>").alias("v")), "v")
    rows = rows.where(F.col("id").isNotNull())
    lengths = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    if not lengths:
        return spark.createDataFrame([], f"query_id {id_type}, rank int, vec_id {id_type}, score double")
    rows = rows.where(F.size("v") == lengths[0]["d"]).dropDuplicates(["id", "v"])
    parts = parts_for(lengths[0]["count"], part_rows)
    wanted = max(SAMPLE_ROWS, SAMPLE_PART_ROWS * parts)
    drawn = rows.orderBy(F.xxhash64("id", F.lit(17)), "id", "v").limit(wanted).select("v").toArrow()
    router = fit_router(_matrix(drawn["v"].combine_chunks()), parts, wished, k)
    parts = len(router.out_shift)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                unit, asks = _unit(_matrix(batch["v"])), batch["asks"].to_numpy(zero_copy_only=False)
                orders = iter(router.order(unit[asks]).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [batch["id"], batch["v"], pa.array(router.part(unit).astype(np.int32)),
                     pa.array([next(orders) if a else None for a in asks], pa.list_(pa.int32()))],
                    names=["id", "v", "part", "parts"],
                )

    asks = F.coalesce(is_query(F.col("id")), F.lit(False)).alias("asks")
    index = staged(
        rows.select("id", "v", asks).mapInArrow(place, f"id {id_type}, v array<{kind}>, part int, parts array<int>")
    )
    counts = {r["part"]: r["count"] for r in index.groupBy("part").count().collect()}  # one row per part
    # From the most probable part on, as many as set, and on until k others are sure to be there.
    held = F.array(*[F.lit(counts.get(p, 0)).cast("long") for p in range(parts)])
    reach = F.aggregate(
        "parts",
        F.struct(F.lit(0).alias("probes"), F.lit(0).cast("long").alias("rows")),
        lambda a, p: F.when((a["probes"] >= router.probes) & (a["rows"] >= k + 1), a).otherwise(
            F.struct((a["probes"] + 1).alias("probes"), (a["rows"] + held[p]).alias("rows"))
        ),
    )["probes"]
    bundle_of, split = blocks_of(counts, parts, block_rows)
    bundle, blocks = F.array(*map(F.lit, bundle_of)), F.array(*map(F.lit, split))
    probing = index.where(F.col("parts").isNotNull()).select("id", "v", F.slice("parts", F.lit(1), reach).alias("parts"))
    meeting = probing.select(
        "id", "v", "parts", F.explode(F.array_distinct(F.transform("parts", lambda p: bundle[p]))).alias("bundle")
    )
    asked_of = {r["bundle"]: r["count"] for r in meeting.groupBy("bundle").count().collect()}  # one row per bundle
    copies = F.array(*[F.lit(max(1, -(-asked_of.get(b, 0) // query_rows))) for b in range(len(split))])
    queries = meeting.select(
        "bundle",
        F.explode(F.sequence(F.lit(0), blocks[F.col("bundle")] - 1)).alias("block"),
        F.pmod(F.xxhash64("id", F.lit(5)), copies[F.col("bundle")]).cast("int").alias("copy"),
        F.lit(parts).alias("part"),  # behind all candidates of the block
        "id", "v",
        F.filter("parts", lambda p: bundle[p] == F.col("bundle")).alias("probes"),
    )
    candidates = index.select("id", "v", "part", bundle[F.col("part")].alias("bundle")).select(
        "bundle",
        F.pmod(F.xxhash64("id", F.lit(6)), blocks[F.col("bundle")]).cast("int").alias("block"),
        F.explode(F.sequence(F.lit(0), copies[F.col("bundle")] - 1)).alias("copy"),
        "part", "id", "v", F.lit(None).cast("array<int>").alias("probes"),
    )

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Holds the candidates of one block, then lets its queries pass."""
        key, block, ready = None, [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            marks = np.column_stack([batch[c].to_numpy() for c in ("bundle", "block", "copy")]
                                    + [batch["part"].to_numpy() == parts])
            cuts = np.flatnonzero((np.diff(marks, axis=0) != 0).any(axis=1)) + 1
            for first, last in zip([0, *cuts], [*cuts, len(marks)]):
                run = batch.slice(first, last - first)
                if tuple(marks[first, :3]) != key:
                    key, block, ready = tuple(marks[first, :3]), [], None
                if not marks[first, 3]:
                    block.append(run)
                elif block:
                    if ready is None:
                        ready = (_unit(np.vstack([_matrix(b["v"]) for b in block])), np.concatenate([_values(b["id"]) for b in block]),
                                 np.concatenate([b["part"].to_numpy() for b in block]))
                        block = [None]
                    for start in range(0, run.num_rows, STEP):
                        step = run.slice(start, STEP)
                        vectors, own = _matrix(step["v"]), _values(step["id"])
                        probes = [np.asarray(p) for p in step["probes"].to_pylist()]
                        q, c, score = best_in_block(_unit(vectors), own, probes, *ready, k)
                        same = np.array([zlib.crc32(v.tobytes()) for v in vectors])
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(own[q], batch["id"].type), pa.array(ready[1][c], batch["id"].type), pa.array(score),
                             pa.array(same[q].astype(np.int64))],
                            names=["query_id", "vec_id", "score", "mark"],
                        )

    keys = ["bundle", "block", "copy"]
    ranked = (
        candidates.unionByName(queries).repartition(*keys).sortWithinPartitions(*keys, "part")
        .mapInArrow(rank, f"query_id {id_type}, vec_id {id_type}, score double, mark long")
    )
    # `mark` keeps apart query rows that share an id but not a vector.
    place_in = W.partitionBy("query_id", "mark").orderBy(F.desc("score"), "vec_id")
    best = ranked.withColumn("rank", F.row_number().over(place_in)).where(F.col("rank") <= k)
    return best.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _matrix(v: pa.ListArray) -> np.ndarray:
    return v.flatten().to_numpy(zero_copy_only=False).reshape(len(v), -1).astype(float)


def _values(ids: pa.Array) -> np.ndarray:
    return np.array(ids.to_pylist(), dtype=object) if pa.types.is_string(ids.type) else ids.to_numpy()
