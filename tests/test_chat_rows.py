"""Cleaning, numbering, incremental selection, upsert keys."""

import hashlib
import random

from pyspark.sql import functions as F

from lorekeep.operators import chatrows, ordering, stats

RAW = (
    "source string, block int, position int, id string, MsgSvrID string, type_name string, is_sender string, "
    "talker string, msg string, CreateTime string, src string, room_name string, is_forward string"
)


def raw(spark, rows):
    """rows: (source, talker, msg, CreateTime) or with a dict of more fields."""
    out = []
    for i, (source, talker, msg, time, *more) in enumerate(rows):
        f = {"id": str(i), "MsgSvrID": "", "type_name": "text", "is_sender": "0", "src": None, "room_name": "", "is_forward": None}
        f.update(more[0] if more else {})
        out.append((source, i // 3, i, f["id"], f["MsgSvrID"], f["type_name"], f["is_sender"], talker, msg, time,
                    f["src"], f["room_name"], f["is_forward"]))
    return spark.createDataFrame(out, RAW)


def test_cleaning_keeps_the_first_of_a_key(spark):
    long_a, long_b = "x" * 200 + "a", "x" * 200 + "b"
    rows = raw(spark, [
        ("f1", "ann", "hello", "t1"), ("f1", "bob", "hello", "t1"), ("f1", "bob", "hello", "t2"),
        ("f2", "ann", "hello", "t1"), ("f1", "ann", long_a, ""), ("f1", "ann", long_b, ""), ("f1", "ann", long_b, None),
        ("f1", "ann", " hello", "t1"), ("f1", "ann", "no", "t1"),
    ])
    kept = {r.position for r in chatrows.cleaned_rows(rows).collect()}
    assert kept == {0, 2, 3, 4, 5, 7}
    assert {r.position for r in chatrows.cleaned_rows(rows, key_chars=200).collect()} == {0, 2, 3, 4, 7}
    counts = {r.source: (r.total, r.filtered, r.duplicates, r.kept, r.saved_pct) for r in chatrows.cleaning_counts(rows).collect()}
    assert counts == {"f1": (8, 1, 2, 5, 37.5), "f2": (1, 0, 0, 1, 0.0)}
    beside = chatrows.counts_beside(rows, chatrows.cleaned_rows(rows))
    assert sorted(beside.collect()) == sorted(chatrows.cleaning_counts(rows).select(*beside.columns).collect())
    total = chatrows.cleaning_totals(chatrows.cleaning_counts(rows)).head()
    assert (total.total, total.kept, total.saved, total.saved_pct) == (9, 6, 3, 33.3)


def test_cleaning_twice_changes_nothing(spark):
    rng = random.Random(5)
    rows = raw(spark, [("f%d" % rng.randint(1, 2), "t", rng.choice(["aaa", "bbb", "[x]y", "cc"]), rng.choice(["", "1", "2"])) for _ in range(80)])
    once = chatrows.cleaned_rows(rows)
    assert sorted(once.collect()) == sorted(chatrows.cleaned_rows(once).collect())


def test_totals_of_nothing(spark):
    total = chatrows.cleaning_totals(chatrows.cleaning_counts(raw(spark, []))).head()
    assert (total.total, total.kept, total.saved_pct) == (0, 0, None)


def test_normalising(spark):
    rows = raw(spark, [
        ("f", " ann ", "　hi you ", "", {"is_sender": "", "room_name": "r", "is_forward": "1"}),
        ("f", "ann", "", "t"), ("f", None, "hi", "t"), ("f", "ann", "hi", "t", {"is_sender": "1.0", "type_name": "", "is_forward": "x"}),
    ])
    found = chatrows.normalised_records(rows).orderBy("position").collect()
    assert [(r.talker, r.msg, r.is_sender, r.CreateTime, r.room_name, r.is_forward, r.type_name) for r in found] == [
        ("ann", "hi you", 0, None, "r", 1, "text"), ("ann", "hi", 0, "t", None, None, None),
    ]


def test_row_numbers_skip_rejected_rows_and_cross_blocks(spark):
    rows = raw(spark, [("f", "t", "" if i in (2, 5) else f"message {i}", "") for i in range(10)] + [("g", "t", "abc", "")])
    numbered = chatrows.numbered_records(chatrows.normalised_records(rows))
    got = {(r.source, r.position): r.row_no for r in numbered.collect()}
    kept = [i for i in range(10) if i not in (2, 5)]
    assert got == {**{("f", p): n for n, p in enumerate(kept, 2)}, ("g", 10): 2}


def test_incremental_runs_add_up_to_a_full_one(spark):
    rows = raw(spark, [("f", "t", f"message {i % 7}", str(i)) for i in range(20)])
    docs = chatrows.chat_documents(chatrows.numbered_records(chatrows.normalised_records(rows)))
    assert docs.where(F.col("row_no") == 2).head().record_hash == hashlib.sha256("f|2|0|message 0".encode()).hexdigest()
    first = docs.where(F.col("row_no") < 9)
    second = chatrows.unseen(docs, first, "record_hash")
    assert second.count() == docs.count() - first.count()
    assert {r.record_hash for r in first.collect()} | {r.record_hash for r in second.collect()} == {
        r.record_hash for r in docs.collect()
    }


def test_upsert_ids_drop_copies_and_merge(spark):
    rows = raw(spark, [("f", "ann", "same text", ""), ("f", "bob", "same text", ""), ("f", "bob", "other", "2024-01-01")])
    docs = chatrows.chat_documents(chatrows.numbered_records(chatrows.normalised_records(rows)))
    keyed = chatrows.with_upsert_ids(docs).orderBy("row_no").collect()
    assert [(r.talker, r.row_no) for r in keyed] == [("ann", 2), ("bob", 4)]
    assert keyed[0].id == hashlib.md5("f0same text".encode()).hexdigest()
    a = spark.createDataFrame([("1", "old"), ("2", "old")], "id string, v string")
    b = spark.createDataFrame([("2", "new"), ("3", "new")], "id string, v string")
    assert sorted(chatrows.merged_by_id(a, b).collect()) == [("1", "old"), ("2", "new"), ("3", "new")]


def limit_of(lengths, percentile=90):
    """One and a half times the value at position floor(n * p / 100), 30 at least, 150 for no values."""
    n = len(lengths)
    at = dict(enumerate(sorted(lengths))).get(min(n * percentile // 100, n - 1))
    return 150 if at is None else max(at * 3 // 2, 30)


def test_reply_limit_uses_the_index_rule(spark):
    rng = random.Random(7)
    samples = [list(range(1, 11)), [], [200] * 5, [rng.randint(1, 200) for _ in range(97)], [7], [25] * 100]
    rows = [(str(g), 1, "m" * n) for g, s in enumerate(samples) for n in s] + [(str(g), 0, "m" * 199) for g in range(len(samples))]
    docs = spark.createDataFrame(rows, "g string, is_sender int, msg_content string")
    got = {r.g: r.max_tokens for r in stats.reply_token_limit(docs, ["g"]).collect()}
    assert got == {str(g): limit_of(s) for g, s in enumerate(samples)}
    assert stats.reply_token_limit(docs).head().max_tokens == limit_of([n for s in samples for n in s])
    none = stats.reply_token_limit(docs.where("g = '1'")).head()
    assert (none.own_messages, none.max_tokens) == (0, 150)


def test_hot_key_is_cut_before_the_shuffle(spark):
    df = spark.range(1000).select(F.when(F.col("id") < 990, 1).otherwise(2).alias("k"), "id")
    plan = ordering.first_rows(df, ["k"], [F.col("id")])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


def test_sender_sample(spark):
    rows = spark.createDataFrame([(i, f"u{i // 100}") for i in range(300)], "seq int, talker string")
    r = stats.sender_sample(rows, [F.col("seq")]).head()
    assert (r.total_records, r.sample_size, r.unique_senders, r.is_approximate) == (300, 200, ["u0", "u1"], True)
