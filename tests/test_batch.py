"""Searches and neighbours for whole tables of queries, against plain versions."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lorekeep.operators import batch, neighbours, timeline
from lorekeep.operators.similarity import mmr


def brute_nearest(rows, queries, k, metric):
    def good(v):
        return v and all(x is not None and math.isfinite(x) for x in v)

    out = []
    for q in queries:
        if q[0] is None or not good(q[1]):
            continue
        a, near = np.array(q[1]), []
        for i, v in rows:
            if i is not None and good(v) and len(v) == len(a):
                b = np.array(v)
                size = np.linalg.norm(a) * np.linalg.norm(b)
                gap = ((a - b) ** 2).sum() if metric == "l2" else 1 - (a @ b / size if size else 0)
                near.append((round(float(gap), 9) + 0.0, i))
        out += [(q[0], i, rank) for rank, (_, i) in enumerate(sorted(near)[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("metric", ["cosine", "l2"])
def test_batch_nearest(spark, monkeypatch, metric):
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=6).tolist()) for i in range(200)]
    rows += [(300 + i, rows[7][1]) for i in range(30)]  # ties
    rows += [(400, [0.0] * 6), (401, None), (402, []), (403, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (404, [math.nan] * 6), (405, [1.0, 2.0]), (None, rows[3][1])]
    queries = [(f"q{i}", rng.normal(size=6).tolist()) for i in range(25)] + [("same", rows[7][1]), ("zero", [0.0] * 6), ("short", [2.0, 1.0]),
                                                                          ("none", None), ("odd", [math.inf] * 6), (None, rows[1][1])]
    table = spark.createDataFrame(rows, "id long, embedding array<double>").repartition(5)
    asked = spark.createDataFrame(queries, "query_id string, embedding array<double>")
    want = brute_nearest(rows, queries, 9, metric)
    got = sorted((r.query_id, r.id, r["rank"]) for r in batch.batch_nearest(table, asked, 9, metric).collect())
    assert got == want
    monkeypatch.setattr(batch, "BLOCK_VALUES", 40)  # several blocks
    monkeypatch.setattr(batch, "CELLS", 64)
    assert sorted((r.query_id, r.id, r["rank"]) for r in batch.batch_nearest(table, asked, 9, metric).collect()) == want
    assert batch.batch_nearest(table.limit(0), asked, 9).count() == 0 == batch.batch_nearest(table, asked.limit(0), 9).count()
    with pytest.raises(ValueError):
        batch.batch_nearest(table, asked, 9, "dot")


def test_queries_are_weighed_together_and_dealt_to_tasks(spark, monkeypatch):
    rng = np.random.default_rng(5)
    table = spark.createDataFrame([(i, v) for i, v in enumerate(rng.normal(size=(60, 4)).tolist())], "id long, embedding array<double>").coalesce(1)
    asked = spark.createDataFrame([(i, v) for i, v in enumerate(rng.normal(size=(1500, 4)).tolist())], "query_id int, embedding array<double>")
    searcher, gaps, sent, calls = batch._searcher, batch._gaps, [], []
    monkeypatch.setattr(batch, "_searcher", lambda *a: sent.append(a) or searcher(*a))
    found = batch.batch_nearest(table, asked, 3)
    assert len(sent) == 3  # one partition of rows, yet three tasks
    want = brute_nearest([tuple(r) for r in table.collect()], [tuple(r) for r in asked.collect()], 3, "cosine")
    assert sorted((r.query_id, r.id, r["rank"]) for r in found.collect()) == want
    monkeypatch.setattr(batch, "_gaps", lambda *a: calls.append(a) or gaps(*a))
    assert sum(b.num_rows for b in searcher(*sent[0])(iter(table.toArrow().to_batches()))) == 3 * 512
    assert len(calls) == 1  # not one a query


def test_nearest_rows_that_come_last_are_found():
    import pyarrow as pa

    rows = np.array([[1.0, x] for x in range(400, 0, -1)] + [[1.0, 0.0]] * 3)
    names = [f"r{i:03}" for i in range(403)]
    batches = pa.table({"id": names, "embedding": rows.tolist()}).to_batches(max_chunksize=7)
    queries = np.array([[1.0, 0.0], [1.0, 390.0]])

    class Sent:
        value = (5, queries)

    got = [tuple(r.values()) for b in batch._searcher(Sent, 2, "l2")(iter(batches)) for r in b.to_pylist()]
    assert got == [(5, "r400", 0.0), (5, "r401", 0.0), (6, "r010", 0.0), (6, "r009", 1.0)]


def test_batch_search_equals_one_search_after_the_other(spark):
    rng = np.random.default_rng(3)
    table = spark.createDataFrame([(i, rng.normal(size=5).tolist()) for i in range(80)], "id long, embedding array<double>")
    asked = spark.createDataFrame([(i, rng.normal(size=5).tolist()) for i in range(6)], "query_id int, embedding array<double>")
    got = {(r.query_id, r["rank"]): r.id for r in batch.batch_search(table, asked, 5, 20, 0.4).collect()}
    want = {(q.query_id, r["rank"]): r.id for q in asked.collect() for r in mmr(table, q.embedding, 5, 20, 0.4).collect()}
    assert got == want and len(got) == 30


def brute_timeline(rows, window, per):
    out = []
    timed = sorted((t, seq, i) for i, seq, t in rows if t is not None)
    for i, _, t in rows:
        if t is not None and t > 0:
            near = [r for r in timed if abs(r[0] - t) <= window][:per]
            out += [(i, pos, r[2]) for pos, r in enumerate(near, 1)]
    return sorted(out)


def test_neighbours_of_all_records(spark):
    rng = random.Random(4)
    rows = [(i, i, rng.choice([None, 0, -5, rng.randint(1, 9000)])) for i in range(150)]
    rows += [(i, i, 20_000 + rng.randint(0, 3)) for i in range(200, 320)]  # a busy second or two
    table = spark.createDataFrame(rows, "id long, seq long, chat_time long").repartition(4)
    want = brute_timeline(rows, 600, 5)
    for ranges in (None, 1, 7):
        got = timeline.all_time_neighbours(table, 10, 5, ranges=ranges)
        assert sorted((r.anchor_id, r.neighbour_pos, r.id) for r in got.collect()) == want
    assert timeline.all_time_neighbours(table.limit(0)).count() == 0
    # The same as the search for a few anchors.
    anchors = [(r[0], r[2]) for r in rows if r[2]][:6]
    few = neighbours.time_neighbours(table, anchors, 10, 5)
    assert {(r.anchor_rank, r.neighbour_pos, r.id) for r in few.collect()} == {w for w in want if w[0] in dict(anchors) and dict(anchors)[w[0]] > 0}


def test_a_busy_hour_makes_no_more_pairs(spark):
    rows = spark.range(30_000).select("id", F.col("id").alias("seq"), F.when(F.col("id") % 5 < 2, 7200 + F.col("id") % 3600).otherwise(F.col("id") * 60).alias("chat_time"))
    got = timeline.all_time_neighbours(rows, 30, 4, ranges=12)
    assert got.count() <= 4 * 30_000
    sizes = [r["count"] for r in got.groupBy(F.pmod(F.xxhash64("anchor_id"), F.lit(12))).count().collect()]
    assert max(sizes) < 2 * sorted(sizes)[6]


def test_stored_first_looks_at_the_first_records_only(spark):
    rows = spark.createDataFrame([(i, i, 1000 - 10 * i) for i in range(10)], "id int, seq int, chat_time long")
    got = neighbours.time_neighbours(rows, [(1, 950)], 2, 2).orderBy("neighbour_pos").collect()
    assert [r.id for r in got] == [9, 8]
    got = neighbours.time_neighbours(rows, [(1, 950)], 2, 2, stored_first=4).orderBy("neighbour_pos").collect()
    assert [r.id for r in got] == [3, 2]
