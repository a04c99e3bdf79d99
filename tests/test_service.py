"""The services end to end, with canned models."""

import pytest

from lorekeep.plans import imports
from lorekeep.plans.reflective import Wording, reflective_answers
from lorekeep.plans.service import ChatService, Prompts, RequestError, TutorService
from lorekeep.sources.collections import Collections
from lorekeep.sources.pages import FormFeedPages
from lorekeep.sources.persona_store import PersonaStore
from lorekeep.sources.providers import CannedModel, FirstAvailable, HashEmbedder, LocalModel
from lorekeep.sources.session_store import SessionStore
from tests.test_sources import STANDARD, standard_rows, write_csv


class Recorder:
    """Keeps the calls made from the driver."""

    def __init__(self, answer="fine"):
        self.calls, self.answer = [], answer

    def reply(self, messages, max_tokens):
        self.calls.append((messages, max_tokens))
        return self.answer


@pytest.fixture(scope="module")
def world(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("world")
    (root / "csv").mkdir()
    write_csv(root / "csv" / "a.csv", STANDARD, standard_rows(40, "alpha"))
    store = Collections(spark, str(root / "store"), buckets=2)
    people = PersonaStore(spark, str(root / "people"))
    me = people.create("me", "be kind", "mine")
    imports.import_chat(spark, store, "mine", str(root / "csv"), HashEmbedder(), personas=people, persona_id=me.id)
    return store, people, SessionStore(spark, str(root / "sessions")), me


def service(spark, world, model, **options):
    store, people, sessions, _ = world
    return ChatService(spark, store, people, sessions, HashEmbedder(), model, **options)


def test_chat_puts_search_results_into_the_system_message(spark, world):
    model = Recorder()
    chat = service(spark, world, model, rewriting=False)
    assert chat.chat(" alpha message 7 ", "s1") == "fine"
    messages, tokens = model.calls[-1]
    assert messages[0]["role"] == "system" and "alpha message 7" in messages[0]["content"] and "be kind" in messages[0]["content"]
    assert messages[1:] == [{"role": "user", "content": "alpha message 7"}]
    assert tokens == world[1].get(world[3].id).model_params.max_tokens
    assert [m["role"] for m in world[2].history("s1")] == ["user", "assistant"]
    chat.reset("s1")
    assert world[2].history("s1") == []


def test_rewriting_and_pronouns(spark, world):
    model = Recorder("better query")
    chat = service(spark, world, model)
    assert chat.search_query("他在哪", None) == "better query" and len(model.calls) == 2
    assert service(spark, world, Recorder(None)).search_query("他在哪", None) == "他在哪"
    plain = Recorder("x")
    assert service(spark, world, plain, rewriting=False).search_query("where", None) == "where" and plain.calls == []


def test_bad_requests(spark, world):
    chat = service(spark, world, Recorder(None), rewriting=False, resolving=False)
    with pytest.raises(RequestError) as blank:
        chat.chat(" 　")
    assert blank.value.status == 400
    with pytest.raises(RequestError) as failed:
        chat.chat("hello there", "s2")
    assert failed.value.status == 500 and [m["role"] for m in world[2].history("s2")] == ["user"]
    with pytest.raises(RequestError) as missing:
        chat.delete_persona("nobody")
    assert missing.value.status == 404


def test_health_and_stats(spark, world):
    chat = service(spark, world, Recorder())
    assert chat.health() == {"status": "healthy", "rag_enabled": True, "persona_count": 1}
    assert chat.stats()["me"].total_records == 40 and chat.stats()["me"].unique_senders == ["u0", "u1", "u2"]


WORDS = Wording(routing="ROUTE ", judging="JUDGE ", grounded=" GROUNDED", plain=" PLAIN")


def test_reflective_chat(spark, world):
    model = CannedModel({"ROUTE": "[Retrieve] 是", "JUDGE": "[IsRel] 1 不相关", "GROUNDED": "an answer\n[IsSup] 完全支持\n[IsUse] 5"})
    chat = service(spark, world, model, rewriting=False, reflective=True, prompts=Prompts(reflective=WORDS))
    assert chat.chat("alpha message 3", "s3") == "an answer"


HIT = "array<struct<rank:int,content:string,chat_time:bigint,chat_time_str:string>>"
REQUEST = f"request_id string, query string, conversation array<struct<role:string,content:string>>, system_prompt string, max_tokens int, hits {HIT}"


def requests(spark, *rows):
    hit = [(1, "first hit", 5, ""), (2, "second hit", 6, "t")]
    return spark.createDataFrame([(i, q, [("user", q)], "S", 10, hit if h else ([] if h is False else None)) for i, q, h in rows], REQUEST)


class Scripted:
    """Answers by step and query, so that every path of a batch is taken once."""

    def reply(self, messages, max_tokens):
        first, last = messages[0]["content"], messages[-1]["content"]
        if first.startswith("ROUTE"):
            return None if "down" in first else ("[Retrieve] 否" if "greet" in first else "[Retrieve] 是")
        if first.startswith("JUDGE"):
            return "[IsRel] 1 不相关\n[IsRel] 2 不相关" if "unrelated" in last else "[IsRel] 1 不相关"
        if "GROUNDED" in first:
            assert "first hit" not in first and "second hit" in first
            if "mute" in last:
                return None
            support = "无支持" if "weak" in last else "完全支持"
            return f"grounded {last}\n[IsSup] {support}\n[IsUse] {2 if 'dull' in last else 4}"
        return f"plain {last}\n[IsUse] 4"


def test_reflective_batch_takes_every_path(spark):
    batch = requests(spark, ("a", "ask", True), ("b", "greet", True), ("c", "down", True), ("d", "ask none", False),
                     ("e", "ask null", None), ("f", "unrelated", True), ("g", "weak", True), ("h", "dull", True), ("i", "mute", True))
    got = {r.request_id: r for r in reflective_answers(batch, Scripted(), WORDS).collect()}
    assert {k: r.reply for k, r in got.items()} == {
        "a": "grounded ask", "b": "plain greet", "c": "grounded down", "d": "plain ask none", "e": "plain ask null",
        "f": "plain unrelated", "g": "grounded weak", "h": "grounded dull", "i": None,
    }
    assert {k for k, r in got.items() if r.retried} == {"f", "g", "h"}
    assert {k for k, r in got.items() if r.error} == {"i"}
    assert got["f"].is_sup == "无支持" and got["b"].is_sup is None and got["h"].is_use == 2
    calm = {r.request_id for r in reflective_answers(batch, Scripted(), WORDS, critique=False).where("retried").collect()}
    assert calm == set()


def test_tutor(spark, tmp_path):
    d = tmp_path / "books"
    d.mkdir()
    (d / "db.pdf").write_text("第一章 绪论\n\n" + "关系模型的基础。" * 8 + "\f第二章 查询\n\n" + "连接与聚合的写法。" * 8, encoding="utf-8")
    model = Recorder("see chapter one")
    tutor = TutorService(spark, Collections(spark, str(tmp_path / "store"), 2), SessionStore(spark, str(tmp_path / "s")), HashEmbedder(), model, rewriting=False)
    assert tutor.chat("关系模型", "t0") == {"reply": "see chapter one", "sources": []}
    assert tutor.import_books(str(d), FormFeedPages()).imported == 2
    answer = tutor.chat("关系模型", "t1")
    assert {s["chapter"] for s in answer["sources"]} == {"第一章 绪论", "第二章 查询"}
    system = model.calls[-1][0][0]["content"]
    assert "【第一章 绪论 > 第1页】" in system and system.endswith(Prompts().tutor_system)
    events = list(tutor.chat_events("关系模型", "t2"))
    assert [e["type"] for e in events] == ["sources", "token", "done"] and len(events[0]["sources"]) == 2
    assert [m["role"] for m in tutor.sessions.history("t2")] == ["user", "assistant"]
    assert tutor.stats()["total_records"] == 2
    with pytest.raises(RequestError):
        tutor.chat("  ")
    tutor.reset("t1")
    assert tutor.sessions.history("t1") == []


def test_model_fallback_stays(spark):
    first = Recorder(None)
    both = FirstAvailable(first, Recorder("second"))
    assert both.reply([], 1) == "second" and both.reply([], 1) == "second" and len(first.calls) == 1
    assert LocalModel("no/such-model").reply([{"role": "user", "content": "x"}], 5) is None


def test_router_of_its_own(spark):
    router = CannedModel({"ROUTE": "<s>[Retrieve] 是 [x] 否</s>"})
    batch = requests(spark, ("a", "ask", True))
    got = reflective_answers(batch, Scripted(), WORDS, router=router, router_markup=True).head()
    # Without its brackets the answer reads as a plain yes or no word.
    assert got.reply == "grounded ask"
