"""The chat and tutor services as Python calls; each runs Spark searches over a collection."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from lorekeep.functions.text import PRONOUNS, SPACES
from lorekeep.operators import results as R
from lorekeep.operators import stats
from lorekeep.operators.personas import DEFAULT_MAX_TOKENS, RETRIEVAL_DEFAULTS
from lorekeep.plans import imports
from lorekeep.plans.reflective import Wording, reflective_answers
from lorekeep.plans.search import BookSearch, ChatSearch, book_search, chat_search
from lorekeep.sources.collections import Collections
from lorekeep.sources.pages import PageReader
from lorekeep.sources.persona_store import PersonaStore
from lorekeep.sources.providers import ChatModel, Embedder
from lorekeep.sources.session_store import SessionStore

REWRITE_TOKENS = 500
TUTOR_REWRITE_TOKENS = 300
TUTOR_MAX_TOKENS = 1500
CHAT_BUDGET = 2000
TUTOR_BUDGET = 4000
STORE_ORDER = ("import_no", "source", "row_no")


class RequestError(ValueError):
    """A request that cannot be served; `status` is its HTTP code."""

    def __init__(self, status: int, text: str):
        super().__init__(text)
        self.status = status


@dataclass(frozen=True)
class Prompts:
    """Wording of the prompts; all of it can be replaced."""

    default_system: str = "你是一个友好的助手，用简短自然的中文回答。"
    resolve: str = "把问题里的代词换成具体的名字，只输出改好的问题。"
    rewrite: str = "把问题改写成便于检索聊天记录的关键词，用逗号分隔，只输出结果。"
    tutor_rewrite: str = "把学生的问题改写成便于检索教材的查询，只输出结果。"
    tutor_system: str = "你是课程助教，依据教材内容用中文回答，并注明章节和页码。"
    tutor_context: str = "与问题相关的教材内容：\n\n"
    reflective: Wording = field(default_factory=Wording)


def _blank(text: str | None) -> bool:
    return not (text or "").strip(SPACES)


class ChatService:
    def __init__(
        self,
        spark: SparkSession,
        store: Collections,
        personas: PersonaStore,
        sessions: SessionStore,
        embedder: Embedder,
        model: ChatModel,
        prompts: Prompts = Prompts(),
        rewriting: bool = True,
        resolving: bool = True,
        reflective: bool = False,
        rag_enabled: bool = True,
    ):
        self.spark, self.store, self.personas, self.sessions = spark, store, personas, sessions
        self.embedder, self.model, self.prompts = embedder, model, prompts
        self.rewriting, self.resolving, self.reflective = rewriting, resolving, reflective
        self.rag_enabled = rag_enabled

    # ── queries ──

    def _ask(self, instruction: str, query: str, max_tokens: int) -> str:
        """The model's version of a query; the query itself when the call gives nothing."""
        answer = self.model.reply([{"role": "user", "content": f"{instruction}\n\n{query}"}], max_tokens)
        return query if _blank(answer) else answer.strip(SPACES)

    def search_query(self, query: str, persona: Row | None) -> str:
        name = persona.name if persona else ""
        if self.resolving and any(p in query for p in PRONOUNS):
            who = f"分身：{name}\n" if name else ""
            query = self._ask(who + self.prompts.resolve, query, REWRITE_TOKENS)
        if self.rewriting:
            about = ""
            if persona:
                about = f"分身：{name}，{persona.doc_count or 0}条记录，设定：{(persona.system_prompt or '')[:200]}\n"
            query = self._ask(about + self.prompts.rewrite, query, REWRITE_TOKENS)
        return query

    def search(self, query: str, persona: Row, **override) -> DataFrame | None:
        """Results for a text query in the persona's collection; None for a blank query or no records."""
        if _blank(query) or not self.store.has_rows(persona.collection):
            return None
        own = persona.rag_params.asDict() if persona.rag_params else {}
        chosen = {n: own.get(n) if own.get(n) is not None else d for n, d in RETRIEVAL_DEFAULTS.items()}
        chosen.update(override)
        params = ChatSearch(
            k=chosen["k"],
            include_nearby=chosen["include_nearby"],
            time_window_minutes=chosen["time_window_minutes"],
            nearby_per_result=chosen["nearby_per_result"],
            max_total_results=chosen["max_total_results"],
            lambda_mult=chosen["lambda_mult"],
            metric=self.store.open(persona.collection),
        )
        vector = self.embedder.embed([self.search_query(query, persona)])[0]
        rows, pick = self.store.searchable(persona.collection)
        vectors = rows.select("id", "embedding", "bucket")
        return chat_search(vectors, rows.drop("embedding"), vector, params, STORE_ORDER, pick)

    # ── calls ──

    def chat(self, message: str, session_id: str = "default", persona_id: str | None = None) -> str:
        """Answer a message in a session and keep both; the message stays when the model fails."""
        message = (message or "").strip(SPACES)
        if not message:
            raise RequestError(400, "the message is empty")
        persona = self.personas.get_or_first(persona_id)
        self.sessions.add(session_id, "user", message)
        messages = self.sessions.history(session_id)
        system = persona.system_prompt if persona else self.prompts.default_system
        max_tokens = DEFAULT_MAX_TOKENS
        if persona and persona.model_params and persona.model_params.max_tokens:
            max_tokens = persona.model_params.max_tokens
        found = self.search(message, persona) if persona and self.rag_enabled else None
        if self.reflective:
            reply = self._reflect(message, messages, system, max_tokens, found)
        else:
            reply = self.model.reply(self._with_context(messages, found, system), max_tokens)
        if reply is None:
            raise RequestError(500, "the model gave no answer")
        self.sessions.add(session_id, "assistant", reply)
        return reply

    def _with_context(self, messages: list[dict], found: DataFrame | None, system: str) -> list[dict]:
        """Messages with one system message in front, only when the search found something."""
        text = R.chat_context(found, CHAT_BUDGET).head().context if found is not None else ""
        if not text:
            return messages
        words = self.prompts.reflective
        content = f"{words.context_prefix}\n{text}\n\n{system}{words.role_guide}"
        return [{"role": "system", "content": content}, *messages]

    def _reflect(self, query: str, messages: list[dict], system: str, max_tokens: int, found: DataFrame | None) -> str | None:
        hit = "struct<rank:int,content:string,chat_time:bigint,chat_time_str:string>"
        base = self.spark.createDataFrame(
            [("1", query, messages, system, max_tokens)],
            "request_id string, query string, conversation array<struct<role:string,content:string>>, "
            "system_prompt string, max_tokens int",
        )
        if found is None:
            request = base.withColumn("hits", F.lit(None).cast(f"array<{hit}>"))
        else:
            # At most 50 results in one array.
            packed = found.agg(
                F.collect_list(F.struct("rank", "content", "chat_time", "chat_time_str").cast(hit)).alias("hits")
            ).withColumn("request_id", F.lit("1"))
            request = base.join(packed, "request_id")
        return reflective_answers(request, self.model, self.prompts.reflective).head().reply

    def reset(self, session_id: str = "default") -> None:
        self.sessions.reset(session_id)

    def list_personas(self) -> DataFrame:
        return self.personas.list()

    def delete_persona(self, persona_id: str) -> None:
        if not self.personas.delete(persona_id):
            raise RequestError(404, "no such persona")

    def health(self) -> dict:
        return {"status": "healthy", "rag_enabled": self.rag_enabled, "persona_count": self.personas.list().count()}

    def stats(self) -> dict[str, Row]:
        """Per persona name: record count and sampled talkers of its collection."""
        out = {}
        for p in self.personas.list().collect():
            if self.store.has_rows(p.collection):
                order = [F.col(c) for c in STORE_ORDER]
                out[p.name] = stats.sender_sample(self.store.read(p.collection), order).head()
        return out


class TutorService:
    def __init__(
        self,
        spark: SparkSession,
        store: Collections,
        sessions: SessionStore,
        embedder: Embedder,
        model: ChatModel,
        collection: str = "textbook_embeddings",
        prompts: Prompts = Prompts(),
        rewriting: bool = True,
    ):
        self.spark, self.store, self.sessions = spark, store, sessions
        self.embedder, self.model, self.collection = embedder, model, collection
        self.prompts, self.rewriting = prompts, rewriting

    def search(self, query: str, params: BookSearch = BookSearch()) -> DataFrame | None:
        if _blank(query) or not self.store.has_rows(self.collection):
            return None
        if self.rewriting:
            asked = [{"role": "user", "content": f"{self.prompts.tutor_rewrite}\n\n{query}"}]
            answer = self.model.reply(asked, TUTOR_REWRITE_TOKENS)
            query = query if _blank(answer) else answer.strip(SPACES)
        vector = self.embedder.embed([query])[0]
        rows, pick = self.store.searchable(self.collection)
        return book_search(rows.select("id", "embedding", "bucket"), rows.drop("embedding"), vector, params, pick)

    def _asked(self, message: str, session_id: str) -> tuple[list[dict[str, str]], list[dict]]:
        """Messages for the model and up to three cited chapters; keeps the question."""
        message = (message or "").strip(SPACES)
        if not message:
            raise RequestError(400, "the message is empty")
        self.sessions.add(session_id, "user", message)
        messages = self.sessions.history(session_id)
        found = self.search(message)
        text, sources = "", []
        if found is not None:
            text = R.book_context(found, TUTOR_BUDGET).head().context
            cited = R.chapter_sources(found).orderBy("source_no").collect()
            sources = [{n: r[n] for n in ("chapter", "section", "page", "source")} for r in cited]
        system = self.prompts.tutor_system
        if text:
            system = f"{self.prompts.tutor_context}{text}\n\n{system}"
        return [{"role": "system", "content": system}, *messages], sources

    def chat(self, message: str, session_id: str = "tutor-default") -> dict:
        """The reply and its sources."""
        messages, sources = self._asked(message, session_id)
        reply = self.model.reply(messages, TUTOR_MAX_TOKENS)
        if reply is None:
            raise RequestError(500, "the model gave no answer")
        self.sessions.add(session_id, "assistant", reply)
        return {"reply": reply, "sources": sources}

    def chat_events(self, message: str, session_id: str = "tutor-default") -> Iterator[dict]:
        """The same as events: sources, then tokens, then done. Models without `stream` give one token."""
        messages, sources = self._asked(message, session_id)
        yield {"type": "sources", "sources": sources}
        stream = getattr(self.model, "stream", None)
        tokens = stream(messages, TUTOR_MAX_TOKENS) if stream else [self.model.reply(messages, TUTOR_MAX_TOKENS) or ""]
        said = []
        for token in tokens:
            said.append(token)
            yield {"type": "token", "content": token}
        yield {"type": "done"}
        self.sessions.add(session_id, "assistant", "".join(said))

    def reset(self, session_id: str = "tutor-default") -> None:
        self.sessions.reset(session_id)

    def import_books(self, folder: str, reader: PageReader, **options) -> imports.BookReport:
        return imports.import_books(self.spark, self.store, self.collection, folder, reader, self.embedder, **options)

    def stats(self) -> dict:
        count = self.store.read(self.collection).count() if self.store.has_rows(self.collection) else 0
        return {"connected": True, "total_records": count, "collection": self.collection}
