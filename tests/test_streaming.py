"""Streaming import and session state."""

from datetime import datetime, timedelta

from lorekeep.operators.sessions import latest_messages
from lorekeep.sources.collections import Collections
from lorekeep.sources.providers import HashEmbedder
from lorekeep.streaming.imports import chat_file_stream, start_import
from lorekeep.streaming.replies import replies_within
from lorekeep.streaming.sessions import MESSAGE, TIMED, live_sessions, session_tails
from tests.test_sources import STANDARD, standard_rows, write_csv


def test_files_are_imported_once_as_they_arrive(spark, tmp_path):
    inbox = tmp_path / "in"
    inbox.mkdir()
    store = Collections(spark, str(tmp_path / "store"), buckets=2)

    def run():
        stream = chat_file_stream(spark, str(inbox), STANDARD, files_per_batch=1)
        query = start_import(stream, store, "live", HashEmbedder(), str(tmp_path / "checkpoint"))
        query.awaitTermination()
        return store.read("live").count()

    write_csv(inbox / "a.csv", STANDARD, standard_rows(12, "alpha"))
    write_csv(inbox / "b.csv", STANDARD, standard_rows(5, "beta"))
    assert run() == 17
    assert run() == 17
    write_csv(inbox / "c.csv", STANDARD, standard_rows(3, "gamma"))
    assert run() == 20
    # A new checkpoint sees all files again; the tracked rows keep the table as it is.
    stream = chat_file_stream(spark, str(inbox), STANDARD)
    start_import(stream, store, "live", HashEmbedder(), str(tmp_path / "other")).awaitTermination()
    assert store.read("live").count() == 20


def test_session_state_equals_the_batch_window(spark, tmp_path):
    inbox = str(tmp_path / "in")
    rows = [(f"s{i % 3}", i, "user", f"m{i}") for i in range(60)]
    for part in (rows[:25], rows[25:40], rows[40:]):
        spark.createDataFrame(part, MESSAGE).coalesce(1).write.mode("append").parquet(inbox)
    seen = {}

    def collect(batch, _):
        for r in batch.collect():
            seen.setdefault((r.session_id, _), []).append((r.seq, r.content))

    stream = spark.readStream.schema(MESSAGE).option("maxFilesPerTrigger", 1).parquet(inbox)
    query = (
        session_tails(stream, keep=4).writeStream.outputMode("update").foreachBatch(collect)
        .option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    last = {}
    for (session, batch), kept in sorted(seen.items(), key=lambda x: x[0][1]):
        last[session] = sorted(kept)
    want = {}
    for r in latest_messages(spark.createDataFrame(rows, MESSAGE), 4).collect():
        want.setdefault(r.session_id, []).append((r.seq, r.content))
    assert last == {s: sorted(v) for s, v in want.items()}


def arriving(spark, folder, parts, schema):
    for part in parts:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)


def at(minutes):
    return datetime(2024, 1, 1) + timedelta(minutes=minutes)


def test_live_sessions_carry_end_and_forget(spark, tmp_path):
    rows = [[("a", 1, "user", "a1", at(0)), ("a", 2, "user", "a2", at(1)), ("b", 1, "user", "b1", at(0)), (None, 1, "user", "x", at(0)), ("n", 1, None, None, None)],
            [("a", 3, "user", "a3", at(5)), ("a", 4, "user", "a4", at(6)), ("c", 1, None, "c1", at(7))],
            [("b", 2, "user", "b2", at(90)), ("a", 5, "user", "late", at(3))],
            [("a", 6, "user", "a6", at(95)), ("d", 1, "user", "d1", at(200)), ("e", 1, "user", "too late", at(2))],
            [("d", 2, "user", "d2", at(201)), ("a", 7, "user", "a7", at(201))]]
    stream = arriving(spark, str(tmp_path / "in"), rows, TIMED)
    seen = []

    def collect(batch, no):
        seen.extend((no, r.session_id, r.seq, r.content) for r in batch.collect())

    query = (
        live_sessions(stream, keep=3, idle="30 minutes", late="1 minute").writeStream.outputMode("update").foreachBatch(collect)
        .option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    kept = {}
    for no, session, seq, content in sorted(seen):
        kept.setdefault((no, session), []).append(content)
    # Carried over a batch, begun anew after a pause. What is late by the times of the batch before last is gone: e, but not a5.
    assert kept == {(0, "a"): ["a1", "a2"], (0, "b"): ["b1"], (1, "a"): ["a2", "a3", "a4"], (1, "c"): ["c1"], (2, "a"): ["a3", "a4", "late"], (2, "b"): ["b2"],
                    (3, "a"): ["a6"], (3, "d"): ["d1"], (4, "a"): ["a7"], (4, "d"): ["d1", "d2"]}
    state = spark.read.format("statestore").option("stateVarName", "latest").load(str(tmp_path / "c"))
    held = {r[0] for r in state.selectExpr("key.session_id").collect()}
    assert "c" not in held and {"a", "d"} <= held  # timers have forgotten the sessions that ended


def test_replies_within_a_span(spark, tmp_path):
    schema = "id long, ts timestamp, talker string, kind string"
    rows = [[(1, at(0), "u", "m"), (2, at(10), "u", "r"), (3, at(10), "v", "r"), (4, None, "u", "r"), (5, at(1), None, "m")],
            [(6, at(40), "u", "m"), (7, at(41), "u", "r"), (8, at(70), "u", "r"), (9, at(71), "u", "m")],
            [(10, at(300), "u", "m"), (11, at(300), "u", "r")],
            [(12, at(42), "u", "r"), (13, at(310), "u", "r"), (14, at(330), "u", "r"), (15, at(331), "u", "r")], [(16, at(43), "u", "r")]]
    stream = arriving(spark, str(tmp_path / "in"), rows, schema)
    found = replies_within(stream.where("kind = 'm'"), stream.where("kind = 'r'"), "30 minutes", "1 hour")
    found.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    got = {(r.message_id, r.reply_id) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    # 16 came too late (12 not, by the times of the batch before last), 11 at the same moment, 15 beyond the span.
    assert got == {(1, 2), (6, 7), (6, 8), (6, 12), (10, 13), (10, 14)}
    table = spark.createDataFrame([r for part in rows for r in part], schema)
    whole = {(r.message_id, r.reply_id) for r in replies_within(table.where("kind = 'm'"), table.where("kind = 'r'")).collect()}
    assert whole == got | {(6, 16)}
