"""Nearest vectors, diverse selection, neighbours and the merged list against brute force."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lorekeep.operators import neighbours, results, similarity
from lorekeep.plans.search import ChatSearch, chat_search
from lorekeep.sources.providers import HashEmbedder, with_embeddings


def vectors(spark, n=60, dim=8, seed=0):
    rng = np.random.default_rng(seed)
    m = rng.normal(size=(n, dim)).astype("float32")
    return m, spark.createDataFrame([(i, [float(x) for x in m[i]]) for i in range(n)], "id int, embedding array<float>")


def unit(m):
    return m / np.linalg.norm(m, axis=-1, keepdims=True)


def model_mmr(m, q, k, fetch, lam):
    m, q = unit(m.astype("float64")), unit(np.asarray(q, "float64"))
    sim = m @ q
    pool = sorted(range(len(m)), key=lambda i: (-sim[i], i))[:fetch]
    chosen = []
    while pool and len(chosen) < k:
        def gain(i):
            if not chosen:
                return sim[i]
            return lam * sim[i] - (1 - lam) * max(float(m[i] @ m[j]) for j in chosen)
        best = max(pool, key=lambda i: (gain(i), sim[i], -i))
        chosen.append(best)
        pool.remove(best)
    return chosen


@pytest.mark.parametrize(("k", "fetch", "lam"), [(5, 20, 0.6), (20, 60, 0.0), (10, 10, 1.0), (80, 200, 0.5), (1, 3, 0.6)])
def test_mmr(spark, k, fetch, lam):
    m, df = vectors(spark, seed=k)
    q = [float(x) for x in m[3] * 0.5 + m[7]]
    got = [r.id for r in similarity.mmr(df, q, k, fetch, lam).orderBy("rank").collect()]
    assert got == model_mmr(m, q, k, fetch, lam)


def test_mmr_with_lambda_one_is_nearest(spark):
    m, df = vectors(spark, seed=9)
    q = [float(x) for x in m[0]]
    near = [r.id for r in similarity.nearest(df, q, 12).orderBy("rank").collect()]
    assert near == [r.id for r in similarity.mmr(df, q, 12, 40, 1.0).orderBy("rank").collect()]


def test_nearest_metrics_and_plan(spark):
    m, df = vectors(spark, seed=4)
    q = m[5].astype("float64") + 0.1
    l2 = [r.id for r in similarity.nearest(df, list(map(float, q)), 7, "l2").orderBy("rank").collect()]
    assert l2 == sorted(range(60), key=lambda i: ((m[i].astype("float64") - q) ** 2).sum())[:7]
    plan = similarity.nearest(df, [1.0] * 8, 7)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "Cartesian" not in plan
    with pytest.raises(ValueError):
        similarity.nearest(df, [1.0] * 8, 7, "dot")


def test_empty_collection(spark):
    empty = spark.createDataFrame([], "id int, embedding array<float>")
    assert similarity.mmr(empty, [1.0, 0.0], 5, 60).collect() == []


def model_search(records, order, p, key_chars=None):
    """records: id -> (content, time); order: ids of the selected hits."""
    w = p.time_window_minutes * 60
    arrivals = [(hit, 0, i, "semantic", 1.0) for hit, i in enumerate(order)]
    for hit, i in enumerate(order):
        t = records[i][1]
        if p.include_nearby and t > 0 and w > 0:
            stored = [j for j in sorted(records) if t - w <= records[j][1] <= t + w][: p.nearby_stored_first]
            for pos, j in enumerate(sorted(stored, key=lambda j: (records[j][1], j))[: p.nearby_per_result], 1):
                arrivals.append((hit, pos, j, "temporal", 0.5 - 0.5 * abs(records[j][1] - t) / w))
    firsts = {}
    for arrival in sorted(arrivals):
        firsts.setdefault(records[arrival[2]][0][:key_chars], arrival)
    best = sorted(firsts.values(), key=lambda a: (-a[4], a[0], a[1]))
    return [a[2:] for a in best][: min(50, p.max_total_results)]


@pytest.mark.parametrize(
    "params",
    [
        ChatSearch(k=6, nearby_per_result=3, time_window_minutes=2),
        ChatSearch(k=15, nearby_per_result=8, time_window_minutes=10),
        ChatSearch(k=15, nearby_per_result=4, nearby_stored_first=8, time_window_minutes=10),
        ChatSearch(k=5, include_nearby=False),
        ChatSearch(k=5, time_window_minutes=0),
        ChatSearch(k=30, nearby_per_result=1, time_window_minutes=1, max_total_results=200),
        ChatSearch(k=4, nearby_per_result=5, time_window_minutes=5, max_total_results=7),
    ],
)
def test_search_matches_the_step_by_step_list(spark, params):
    rng = np.random.default_rng(params.k)
    m, df = vectors(spark, n=120, seed=params.k)
    # Times repeat, some are unknown, contents share their first 50 characters.
    times = rng.integers(0, 1500, 120)
    times[rng.random(120) < 0.1] = 0
    records = {i: ("p" * 49 + str(i % 9) + f" tail {i}" if i % 3 == 0 else f"text {i % 40}", int(times[i])) for i in range(120)}
    table = spark.createDataFrame([(i, i, c, t) for i, (c, t) in records.items()], "id int, seq int, content string, chat_time long")
    q = [float(x) for x in m[1]]
    got = chat_search(df, table, q, params).orderBy("rank").collect()
    sim_l2 = sorted(range(120), key=lambda i: (((m[i].astype("float64") - np.array(q)) ** 2).sum(), i))[: params.fetch_k]
    order = [sim_l2[i] for i in model_mmr(m[sim_l2], q, params.k, params.fetch_k, params.lambda_mult)]
    want = model_search(records, order, params)
    assert [(r.id, r.result_source, pytest.approx(r.score)) for r in got] == want


def test_contents_that_start_alike(spark):
    same = "p" * 50
    hits = spark.createDataFrame([(1, same + "a", 1), (2, same + "b", 2), (3, same + "a", 3)], "id int, content string, rank int")
    assert [r.id for r in results.merged_results(hits, None).orderBy("rank").collect()] == [1, 2]
    assert [r.id for r in results.merged_results(hits, None, content_key_chars=50).collect()] == [1]


def test_neighbours_nearest_mode(spark):
    rows = spark.createDataFrame([(i, i, 100 + 10 * i) for i in range(10)], "id int, seq int, chat_time long")
    got = neighbours.time_neighbours(rows, [(1, 150)], 1, 3, mode="nearest").orderBy("neighbour_pos").collect()
    assert [r.id for r in got] == [4, 5, 6]
    with pytest.raises(ValueError):
        neighbours.time_neighbours(rows, [(1, 150)], mode="last")


def test_neighbour_windows_reach_the_scan(spark, tmp_path):
    spark.range(1000).select(F.col("id").alias("seq"), F.col("id").alias("chat_time")).write.parquet(str(tmp_path / "t"))
    rows = spark.read.parquet(str(tmp_path / "t"))
    plan = neighbours.time_neighbours(rows, [(1, 100), (2, 120), (3, 500)], 1)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(chat_time,40)" in plan and "BroadcastHashJoin" in plan
    assert neighbours.merged_windows([100, 120, 500], 60) == [(40, 180), (440, 560)]


def ranked(spark, contents, **extra):
    rows = [(i, c, "", 0) for i, c in enumerate(contents, 1)]
    return spark.createDataFrame(rows, "rank int, content string, chat_time_str string, chat_time long")


def test_budget_stops_at_the_first_overflow(spark):
    df = ranked(spark, ["a" * 5, "b" * 5, "c" * 6, "d"])
    assert results.chat_context(df, 10).head().context == "aaaaa\nbbbbb"
    assert results.chat_context(df, 9).head().context == "aaaaa"
    assert results.chat_context(df, 4).head().context == ""


def test_context_line_times(spark):
    df = spark.createDataFrame(
        [(1, " a ", "t1", 5), (2, "b", "", 5), (3, "c", None, 0)], "rank int, content string, chat_time_str string, chat_time long"
    )
    assert results.chat_context(df).head().context == "[t1] a\n[5] b\nc"
    assert results.chat_context(df, with_time=False).head().context == "a\nb\nc"


BOOK = "rank int, content string, chapter string, section string, page int, source string"


def test_chapter_sources(spark):
    rows = [(1, "x", "c1", "s1", 9, "f"), (2, "x", "c1", "s2", 10, "g"), (3, "x", "", "", 1, "f"), (4, "x", "c2", "", 3, "f"),
            (5, "x", "c1", "", 11, "f"), (6, "x", "c1", "", 8, "f"), (7, "x", "c3", "", 0, "f"), (8, "x", "c4", "", 2, "f")]
    got = results.chapter_sources(spark.createDataFrame(rows, BOOK)).orderBy("source_no").collect()
    assert [tuple(r)[1:] for r in got] == [("c1", "s1", "10, 11, 8...", "f"), ("c2", "", "3", "f"), ("c3", "", "", "f")]


def test_book_context_and_repeats(spark):
    rows = [(1, "x", "c", "s", 9, "f"), (2, "x", "c", "s", 9, "f"), (3, "y ", "", "", None, "f"), (4, "x", "c", "", 10, "f")]
    unique = results.unique_passages(spark.createDataFrame(rows, BOOK))
    assert [r.content for r in unique.orderBy("rank").collect()] == ["x", "y ", "x"]
    assert results.book_context(unique).head().context == "【c > s > 第9页】\nx\n\n【f】\ny\n\n【c > 第10页】\nx\n"


def test_relevance_filter_defaults_to_keep(spark):
    df = ranked(spark, [f"m{i}" for i in range(1, 18)])
    flags = spark.createDataFrame([(2, False), (3, True), (16, False)], "rank int, relevant boolean")
    kept = [r["rank"] for r in results.relevant_results(df, flags).orderBy("rank").collect()]
    assert kept == [1, *range(3, 18)]


def test_numbered_passages(spark):
    df = ranked(spark, [f" line\n{i} " + "z" * 200 for i in range(20)])
    text = results.numbered_passages(df).head().passages.split("\n")
    assert len(text) == 15 and text[0].startswith("[1] line 0 z") and len(text[0]) == 4 + 120


def test_hashed_vectors_count_all_features(spark):
    import hashlib
    import re

    from lorekeep.functions.vectors import hashed

    texts = ["", " \x00\x01 ", "Ab aB,c_d\x7fÉté ɏɐ", "相关的 word×÷ÀÖ", "x🙂y © À", "a " * 300 + "À\u0301", "$1 \\ tail\n\t", None]
    for dim in (64, 200):
        column = hashed(F.col("t"), dim)
        assert "array_remove" not in str(column) and "regexp_extract_all" not in str(column)
        rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", column.alias("v")).collect()
        for i, v in rows:
            if texts[i] is None:
                assert v is None
                continue
            sums = [0] * dim
            low = re.sub("[A-Z]", lambda m: m[0].lower(), texts[i])
            for w in re.findall("[a-z0-9\u00c0-\u024f]+|[^\x00-\x7f]", low):
                code = int(hashlib.md5(w.encode()).hexdigest()[:8], 16) % (2 * dim)
                sums[code % dim] += 1 if code < dim else -1
            size = math.sqrt(sum(x * x for x in sums))
            assert v == [math.floor(x * 1000 / size + 0.5) if size else 0 for x in sums], texts[i]


def test_hashed_vectors_by_expression_and_on_the_driver(spark):
    texts = ["", "  \t", "Über die Straße, naïve CAFÉ x1", "我们去 Beijing 吧😀😀", "a a a b", "word " * 3000, "İI\n.,;"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, None])], "i int, content string")
    embedder = HashEmbedder(16)
    got = [r.embedding for r in with_embeddings(rows, embedder).orderBy("i").collect()]
    assert got == [*embedder.embed(texts), None]
    assert got[0] == got[1] == [0.0] * 16 and abs(np.linalg.norm(got[2]) - 1000) < 3
    plan = with_embeddings(rows, embedder)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
