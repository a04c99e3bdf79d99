"""Files in, tables out."""

import csv
import os

import pytest
from pyspark.sql import functions as F

from lorekeep.operators import chatrows
from lorekeep.plans import imports
from lorekeep.sources import chat_csv, files
from lorekeep.sources.collections import Collections
from lorekeep.sources.pages import FormFeedPages, read_pages
from lorekeep.sources.persona_store import PersonaStore
from lorekeep.sources.providers import HashEmbedder, ServiceBusy, vectors_or_none, with_embeddings
from lorekeep.sources.session_store import SessionStore
from lorekeep.sources.sketches import SenderSketches, estimated, sender_sketches
from lorekeep.sources.tracking import Tracking, tracked_in_json

STANDARD = ["id", "MsgSvrID", "type_name", "is_sender", "talker", "src", "msg", "CreateTime", "room_name"]


def write_csv(path, header, rows):
    with open(path, "w", encoding="utf-8", newline="") as f:
        w = csv.writer(f)
        w.writerow(header)
        w.writerows(rows)


def standard_rows(n, prefix):
    return [[i, f"m{i}", "text", i % 2, f"u{i % 3}", "", f"{prefix} message {i}", f"2024-01-15 10:{i % 60:02d}:00", "room" if i % 4 == 0 else ""] for i in range(n)]


@pytest.fixture
def folder(tmp_path):
    d = tmp_path / "csv"
    d.mkdir()
    write_csv(d / "a.csv", STANDARD, standard_rows(20, "alpha"))
    write_csv(d / "b.csv", ["is_sender", "talker", "msg"], [[1, "self", 'He said "yes",\nthen left'], [0, "ann", "plain words"], [0, "ann", "plain words"]])
    write_csv(d / "c.csv", ["x", "y"], [[1, 2]])
    write_csv(d / "d.csv", [" msg", "talker", "is_sender"], [["lost", "ann", 1]])
    (d / "e.csv").write_text("id,MsgSvrID,type_name,is_sender,talker,msg,CreateTime\n1,m,text,1,ann\n2,m,text,1,ann,good words,\n\n3,m,text,0,bob,more words,2024-01-15 10:00:00,extra\n", encoding="utf-8")
    (d / "empty.csv").write_text("")
    return str(d)


def test_formats_and_rows(spark, folder):
    groups = {os.path.basename(p): g.format for g in chat_csv.header_groups(spark, folder) for p in g.paths}
    assert groups == {"a.csv": "wechat_standard", "b.csv": "simple", "c.csv": "unknown", "d.csv": "simple", "e.csv": "wechat_standard"}
    rows = chat_csv.read_chat(spark, folder)
    counts = {r.source: r["count"] for r in rows.groupBy("source").count().collect()}
    assert counts == {"a.csv": 20, "b.csv": 3, "d.csv": 1, "e.csv": 3}
    b = rows.where("source = 'b.csv'").orderBy("position").collect()
    assert b[0].msg == 'He said "yes",\nthen left' and b[0].CreateTime is None
    records = chatrows.numbered_records(chatrows.normalised_records(rows))
    got = {(r.source, r.row_no): r.msg for r in records.where("source != 'a.csv'").collect()}
    # A padded header loses its rows, a short row has no message.
    assert got == {("b.csv", 2): 'He said "yes",\nthen left', ("b.csv", 3): "plain words", ("b.csv", 4): "plain words",
                   ("e.csv", 2): "good words", ("e.csv", 3): "more words"}
    assert chat_csv.read_chat(spark, folder, "b*.csv").select("source").distinct().collect()[0].source == "b.csv"
    with pytest.raises(ValueError):
        chat_csv.read_chat(spark, folder, "c*.csv")


def test_rows_equal_those_of_the_csv_module(spark, tmp_path):
    """Random files with quotes, breaks and stray quotes."""
    import io
    import random

    rng = random.Random(17)
    pieces = ["word", 'say "hi"', "two\nlines", "a,b", "", " ", "3\n\n4", '"', 'x"y', "语", "\r\nz"]
    d = tmp_path / "csv"
    d.mkdir()
    header = ["is_sender", "talker", "msg"]
    for n in range(6):
        text = io.StringIO()
        end = "\r\n" if n % 2 else "\n"
        w = csv.writer(text, lineterminator=end, quoting=csv.QUOTE_ALL if n == 5 else csv.QUOTE_MINIMAL)
        w.writerow(header)
        for i in range(120):
            w.writerow([i, *("".join(rng.choices(pieces, k=rng.randint(1, 3))) for _ in range(2))])
            if n >= 3 and rng.random() < 0.2:
                # Stray quotes inside unquoted fields, as hand-made files have them.
                odd = ['0,5" disk,ok', '0,a"b"c,"q\nr"', '0,5" a,"open\nclose",6" b', '1,x"y,"open ""it""\n2,closed"', ',,"m\n"', ""]
                text.write(rng.choice(odd) + end)
        (d / f"f{n}.csv").write_bytes(text.getvalue().encode())
    (group,) = chat_csv.header_groups(spark, str(d))
    got = chat_csv.read_group(spark, group).orderBy("position").collect()
    for n in range(6):
        with open(d / f"f{n}.csv", encoding="utf-8", newline="") as f:
            want = [[(r[h] or "").replace("\r\n", "\n") or None for h in header] for r in csv.DictReader(f)]
        assert [[r[h] or None for h in header] for r in got if r.source == f"f{n}.csv"] == want


def test_row_order_within_and_across_files(spark, tmp_path):
    d = tmp_path / "csv"
    d.mkdir()
    for part in range(6):
        write_csv(d / f"big{part}.csv", STANDARD, standard_rows(2000, "w" * 40))
    rows = chat_csv.read_chat(spark, str(d))
    numbered = chatrows.numbered_records(chatrows.normalised_records(rows)).select("source", "row_no", F.col("id").cast("int")).collect()
    assert len(numbered) == 12000 and all(r.row_no == r.id + 2 for r in numbered)


def test_clean_folder_and_reread(spark, folder, tmp_path):
    out = str(tmp_path / "csv_clean")
    assert files.chat_folder(spark, str(tmp_path)).endswith("/csv")
    counts = {r.source: (r.total, r.kept) for r in imports.clean_chat_folder(spark, folder, out, "[abe].csv").collect()}
    assert counts == {"a.csv": (20, 20), "b.csv": (3, 2), "e.csv": (3, 2)}
    assert files.chat_folder(spark, str(tmp_path)).endswith("/csv_clean")
    again = chat_csv.read_chat(spark, out)
    assert {r.source: r["count"] for r in again.groupBy("source").count().collect()} == {"a.csv": 20, "b.csv": 2, "e.csv": 2}
    order = again.where("source = 'a.csv'").orderBy("position").select(F.col("id").cast("int")).collect()
    assert [r.id for r in order] == list(range(20))


def test_odd_file_names(spark, tmp_path):
    d = tmp_path / "csv"
    d.mkdir()
    for name in ("b x.csv", "a+b%20c.csv", "聊天=1.csv"):
        write_csv(d / name, STANDARD[3:5] + ["msg"], [[1, "self", "line one\nline two"], [0, "ann", "hello"]])
    counts = {r.source: r.kept for r in imports.clean_chat_folder(spark, str(d), str(tmp_path / "csv_clean")).collect()}
    again = chat_csv.read_chat(spark, str(tmp_path / "csv_clean"))
    assert counts == {"b x.csv": 2, "a+b%20c.csv": 2, "聊天=1.csv": 2}
    assert {r.source: r["count"] for r in again.groupBy("source").count().collect()} == counts


def test_clean_in_place(spark, folder):
    imports.clean_chat_folder(spark, folder, "", "[ab].csv", in_place=True)
    rows = chat_csv.read_chat(spark, folder, "*.csv")
    assert {r.source: r["count"] for r in rows.groupBy("source").count().collect()} == {"a.csv": 20, "b.csv": 2, "d.csv": 1, "e.csv": 3}


def test_collections(spark, tmp_path):
    store = Collections(spark, str(tmp_path / "store"), buckets=4)
    assert store.sizes().collect() == []
    assert store.open("one", "cosine") == "cosine" and store.open("one") == "cosine"
    assert [tuple(r) for r in store.sizes().collect()] == [("one", "cosine", 0)]
    schema = "id string, v string"
    store.upsert("one", spark.createDataFrame([(str(i), "old") for i in range(20)], schema))
    store.upsert("one", spark.createDataFrame([("3", "new"), ("99", "new")], schema))
    store.upsert("one", spark.createDataFrame([("3", "new"), ("99", "new")], schema))
    got = {r.id: r.v for r in store.read("one").collect()}
    assert len(got) == 21 == store.read("one").count() and got["3"] == "new" and got["4"] == "old"
    store.open("two")
    assert {r.name: r.total_records for r in store.sizes().collect()} == {"one": 21, "two": 0}
    assert store.delete("one") and not store.has_rows("one")


def test_upserts_work_their_rows_out_once(spark, tmp_path):
    store = Collections(spark, str(tmp_path), buckets=3)
    store.open("c")
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    for first in (0, 400):
        rows = spark.range(first, first + 500, 1, 4).selectExpr("cast(id as string) as id", "'v' as v").mapInArrow(counted, "id string, v string")
        store.upsert("c", rows)
    assert seen.value == 1000 and store.read("c").count() == 900
    assert store.upsert("c", rows.limit(0)) == 0 and store.read("c").count() == 900
    store.compact("c")
    assert store.upsert("c", rows.limit(0)) == 0 and store.read("c").count() == 900
    store.open("new")
    assert store.upsert("new", rows.limit(0)) == 0 and not store.has_rows("new")


def test_upserts_write_what_comes_in(spark, tmp_path):
    store = Collections(spark, str(tmp_path / "store"), buckets=8)
    store.open("c")
    first = spark.range(5000).selectExpr("cast(id as string) as id", "'old' as v")
    assert store.upsert("c", first) == 0
    before = {f: f.stat().st_mtime_ns for f in (tmp_path / "store/c/rows").rglob("*.parquet")}
    some = spark.range(100, 400).selectExpr("cast(id as string) as id", "'new' as v", "id as extra")
    assert store.upsert("c", some) == 1
    assert store.upsert("c", spark.range(399, 402).selectExpr("cast(id as string) as id", "'newest' as v")) == 2
    assert {f: f.stat().st_mtime_ns for f in (tmp_path / "store/c/rows").rglob("*.parquet")} == before
    assert spark.read.parquet(str(tmp_path / "store/c/changes/change=1")).count() == 300

    def check():
        got = {r.id: (r.v, r.extra) for r in store.read("c").collect()}
        assert len(got) == 5000 == store.read("c").count()
        assert got["99"] == ("old", None) and got["100"] == ("new", 100) and got["398"][0] == "new" and got["399"] == got["401"] == ("newest", None)
        assert {r.name: r.total_records for r in store.sizes().collect()} == {"c": 5000}
        rows, pick = store.searchable("c")
        assert {(r.id, r.v) for r in pick(rows, ["5", "150", "400"]).collect()} == {("5", "old"), ("150", "new"), ("400", "newest")}

    check()
    store.compact("c")
    check()
    assert not (tmp_path / "store/c/changes").exists()
    store.compact("c")
    assert store.upsert("c", spark.createDataFrame([("x", "v")], "id string, v string")) == 1 and store.read("c").count() == 5001


def test_tracking(spark, tmp_path):
    t = Tracking(spark, str(tmp_path / "t"))
    t.add(spark.createDataFrame([("a",), ("b",), ("a",)], "record_hash string"))
    t.add(spark.createDataFrame([("b",), ("c",)], "record_hash string"))
    assert sorted(r.record_hash for r in t.read().collect()) == ["a", "b", "c"]
    t.clear()
    assert t.read().count() == 0
    (tmp_path / "x.json").write_text('{"imported_hashes": ["h1", "h2"], "file_timestamps": {}}')
    (tmp_path / "y.json").write_text('["h3"]')
    (tmp_path / "z.json").write_text("broken")
    found = {n: sorted(r.record_hash for r in tracked_in_json(spark, str(tmp_path / f"{n}.json")).collect()) for n in "xyzw"}
    assert found == {"x": ["h1", "h2"], "y": ["h3"], "z": [], "w": []}


def test_tracked_hashes_stay_where_they_are(spark, tmp_path):
    t = Tracking(spark, str(tmp_path / "it's"), buckets=8)
    t.add(spark.range(3000).select(F.sha2(F.col("id").cast("string"), 256).alias("record_hash")))
    t.add(spark.range(2000, 4000).select(F.sha2(F.col("id").cast("string"), 256).alias("record_hash")))
    assert t.read().count() == 4000
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = spark.range(3990, 4010).select("id", F.sha2(F.col("id").cast("string"), 256).alias("record_hash"))
        new = chatrows.unseen(rows, t.read(), "record_hash")
        assert sorted(r.id for r in new.collect()) == list(range(4000, 4010))
        plan = new._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    # One exchange, of what comes in.
    assert plan.count("SelectedBucketsCount: 8 out of 8") == plan.count("Exchange hashpartitioning(record_hash") > 0


def test_sender_sketches(spark, tmp_path):
    kept = SenderSketches(spark, str(tmp_path / "s"))
    assert kept.counts().count() == 0
    rows = spark.range(60_000).selectExpr("cast(id % 3 as string) as collection", "concat('u', id % 20000) as talker")
    rows = rows.unionByName(spark.createDataFrame([("0", None)], "collection string, talker string"))
    for part in (rows.where("collection < '2'"), rows.where("collection >= '1'"), rows.limit(0)):
        kept.add(part)
    got = {r.collection: (r.records, r.unique_senders) for r in kept.counts().collect()}
    assert got["0"][0] == 20_001 and got["1"][0] == 40_000 and set(got) == {"0", "1", "2"}
    for _, senders in got.values():
        assert abs(senders - 20_000) <= 0.05 * 20_000


def test_sketches_estimate_alike_however_rows_were_dealt(spark, tmp_path):
    rows = spark.range(6000).selectExpr("concat('c', id % 2) AS collection", "concat('u', id % 2999) AS talker")
    kept = SenderSketches(spark, str(tmp_path / "s"))
    kept.add(rows.where("talker < 'u5'"))
    kept.add(rows.where("talker >= 'u4'"))
    parts = {r.collection: r.unique_senders for r in kept.counts().collect()}
    for n in (1, 7):
        whole = sender_sketches(rows.repartition(n)).select("collection", estimated("senders").alias("n"))
        assert {r.collection: r.n for r in whole.collect()} == parts
    assert all(abs(n - 2999) < 150 for n in parts.values())



class Failing:
    def embed(self, texts):
        if any("bad" in t for t in texts):
            raise ServiceBusy("429")
        return [[float(len(t))] for t in texts]


def test_embedding_failures(spark):
    waits = []
    assert vectors_or_none(Failing(), ["bad"], wait=waits.append) is None and waits == [2.0, 4.0]
    assert vectors_or_none(object(), ["bad"], wait=waits.append) is None and waits[2:] == [1.0, 1.0]
    rows = spark.createDataFrame([(i, "bad" if i == 13 else f"text {i}") for i in range(30)], "i int, content string").coalesce(1)
    import lorekeep.sources.providers as p

    got = with_embeddings(rows, NoWait(Failing()), batch=10).collect()
    assert [r.i for r in got if r.embedding is None] == list(range(10, 20))
    assert p.HashEmbedder(8).embed(["abc"]) == p.HashEmbedder(8).embed(["abc"])


class NoWait:
    """Fails at once, without the waits of a rate limit."""

    def __init__(self, inner):
        self.inner = inner

    def embed(self, texts):
        try:
            return self.inner.embed(texts)
        except RuntimeError:
            return None


def test_chat_import_runs(spark, folder, tmp_path):
    store = Collections(spark, str(tmp_path / "store"), buckets=4)
    people = PersonaStore(spark, str(tmp_path / "personas"))
    me = people.create("me", "be kind", "mine")
    one = imports.import_chat(spark, store, "mine", folder, HashEmbedder(), "a.csv", personas=people, persona_id=me.id)
    assert (one.documents, one.written, one.failed, one.collection_size) == (20, 20, 0, 20)
    two = imports.import_chat(spark, store, "mine", folder, HashEmbedder(), "*.csv", personas=people, persona_id=me.id)
    # b.csv holds one record twice.
    assert (two.documents, two.written, two.collection_size) == (5, 4, 24)
    three = imports.import_chat(spark, store, "mine", folder, HashEmbedder(), "*.csv", personas=people, persona_id=me.id)
    assert (three.documents, three.written, three.collection_size) == (0, 0, 24)
    assert people.get(me.id).doc_count == 24 and people.get(me.id).model_params.max_tokens == two.max_tokens
    full = imports.import_chat(spark, store, "mine", folder, HashEmbedder(), "a.csv", incremental=False)
    assert (full.written, full.collection_size) == (20, 20)


def test_failed_rows_are_tried_again(spark, folder, tmp_path):
    store = Collections(spark, str(tmp_path / "store"), buckets=4)

    class Flaky(NoWait):
        def __init__(self):
            super().__init__(None)

        def embed(self, texts):
            return None if any("message 3" in t for t in texts) else HashEmbedder().embed(texts)

    first = imports.import_chat(spark, store, "c", folder, Flaky(), "a.csv")
    assert first.failed > 0 and first.written + first.failed == 20
    second = imports.import_chat(spark, store, "c", folder, HashEmbedder(), "a.csv")
    assert second.documents == first.failed and second.collection_size == 20


def test_book_import(spark, tmp_path):
    d = tmp_path / "books"
    d.mkdir()
    (d / "one.PDF").write_text("NOTES\n第一章 绪论\n\n" + "甲" * 60 + "\f" + "1.1 概念\n\n" + "乙" * 70 + "\fPage 3\n", encoding="utf-8")
    (d / "two.pdf").write_text("第二章 模型\n\n" + "甲" * 60, encoding="utf-8")
    (d / "bad.pdf").write_bytes(b"\xff\xfe\xff")
    pages = {(r.source, r.page): (r.ocr, r.error) for r in read_pages(spark, str(d), FormFeedPages()).collect()}
    assert pages[("one.PDF", 3)] == (True, None) and pages[("bad.pdf", 1)][1].startswith("UnicodeDecodeError")
    store = Collections(spark, str(tmp_path / "store"), buckets=2)
    report = imports.import_books(spark, store, "books", str(d), FormFeedPages(), HashEmbedder(), size=40, overlap=5)
    assert (report.files, report.failed, report.imported) == (3, 0, report.collection_size)
    rows = {(r.source, r.page, r.chunk_no): (r.chapter, r.section, r.ocr) for r in store.read("books").collect()}
    assert rows[("one.PDF", 1, 0)][0].startswith("第一章") and rows[("one.PDF", 2, 0)][1] == "1.1 概念"
    again = imports.import_books(spark, store, "books", str(d), FormFeedPages(), HashEmbedder(), size=40, overlap=5)
    assert (again.imported, again.collection_size) == (0, report.collection_size)


def test_personas(spark, tmp_path):
    people = PersonaStore(spark, str(tmp_path / "p"))
    assert people.list().collect() == [] and people.get_or_first("x") is None
    (tmp_path / "personas.json").write_text(
        '[{"_type": "schema", "id": "doc"}, {"id": "a", "name": "A", "collection": "ca", "doc_count": 3, "rag_params": {"k": 7}},'
        ' {"id": "b", "name": "B", "collection": "cb"}]', encoding="utf-8")
    people.load_json(str(tmp_path / "personas.json"))
    assert [r.id for r in people.list().collect()] == ["a", "b"]
    assert people.get("a").rag_params.k == 7 and people.get("doc") is None
    assert people.get_or_first("b").id == "b" and people.get_or_first("zzz").id == "a" and people.get_or_first(None).id == "a"
    new = people.create("C", "prompt")
    assert new.collection == f"persona_{new.id[:8]}" and new.doc_count == 0
    people.set_doc_count("a", 9)
    people.set_max_tokens("b", 120)
    people.set_max_tokens("b", 130)
    assert people.get("a").doc_count == 9 and people.get("b").model_params.max_tokens == 130
    assert people.delete("a") and not people.delete("a")
    assert [r.id for r in people.list().collect()] == ["b", new.id]
    assert people.table.read().where("_type = 'schema'").count() == 1


def test_sessions(spark, tmp_path):
    s = SessionStore(spark, str(tmp_path / "s"), keep=3)
    assert s.history("x") == []
    for i in range(5):
        s.add("x", "user", f"m{i}")
    s.add("y", "user", "other")
    assert [m["content"] for m in s.history("x")] == ["m2", "m3", "m4"]
    s.export_json(str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 4
    s.reset("x")
    assert s.history("x") == [] and len(s.history("y")) == 1
    s.add("x", "user", "new")
    assert [m["content"] for m in s.history("x")] == ["new"]
