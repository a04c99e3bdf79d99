"""Models and page readers behind small interfaces, and how Spark tasks call them.

The engine never needs a network: tests use the deterministic ones below.
"""

from __future__ import annotations

import hashlib
import json
import math
import re
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Sequence
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lorekeep.functions.vectors import LETTERS, hashed

EMBED_BATCH = 10
#: Seconds before the second and the third try: after a failure, and where the service is busy.
PAUSES = ((1.0, 2.0), (1.0, 4.0))
#: HTTP codes by which a service asks for patience.
BUSY_CODES = (429, 503)


class ServiceBusy(RuntimeError):
    """The service limits calls for now."""


class Embedder(Protocol):
    def embed(self, texts: Sequence[str]) -> list[list[float]]: ...


class ChatModel(Protocol):
    def reply(self, messages: Sequence[dict[str, str]], max_tokens: int) -> str | None: ...


class HashEmbedder:
    """Words hashed into a vector by expressions (`functions.vectors.hashed`): repeatable, no model, no Python per row."""

    def __init__(self, dim: int = 64):
        self.dim = dim

    def column(self, text: Column) -> Column:
        return hashed(text, self.dim)

    def embed(self, texts: Sequence[str]) -> list[list[float]]:
        """The same for a few texts on the driver, such as a question."""
        return [self._one(t) for t in texts]

    def _one(self, text: str) -> list[float]:
        lower = text.translate(str.maketrans(LETTERS, LETTERS.lower()))
        sums = [0] * self.dim
        for word in re.findall("[a-z0-9\u00c0-\u024f]+|[^\\x00-\\x7f]", lower):
            code = int(hashlib.md5(word.encode()).hexdigest()[:8], 16) % (2 * self.dim)
            sums[code % self.dim] += 1 if code < self.dim else -1
        size = math.sqrt(sum(x * x for x in sums)) or 1.0
        return [float(math.floor(x * 1000.0 / size + 0.5)) for x in sums]


class CannedModel:
    """Replies by the first marker found in the last message, or in the system message."""

    def __init__(self, replies: dict[str, str | None], default: str | None = None):
        self.replies, self.default = replies, default

    def reply(self, messages: Sequence[dict[str, str]], max_tokens: int) -> str | None:
        seen = [messages[-1]["content"], messages[0]["content"]]
        for text in seen:
            for marker, answer in self.replies.items():
                if marker in text:
                    return answer
        return self.default


class HttpChatModel:
    """Any endpoint with the common chat-completions request shape. Errors give None."""

    def __init__(self, url: str, api_key: str, model: str, timeout: float = 60.0, **options):
        self.url, self.api_key, self.model, self.timeout, self.options = url, api_key, model, timeout, options

    def reply(self, messages: Sequence[dict[str, str]], max_tokens: int) -> str | None:
        body = {"model": self.model, "messages": list(messages), "max_tokens": max_tokens, "stream": False}
        try:
            data = _post(self.url, self.api_key, {**body, **self.options}, self.timeout)
            choices = data.get("choices") or []
            return (choices[0].get("message") or {}).get("content") if choices else None
        except Exception:  # a failed call is an answer of its own here
            return None


class LocalModel:
    """A causal language model from local weights, loaded on first use. Without the libraries it gives None."""

    def __init__(self, name: str, max_new_tokens: int = 300, max_input_tokens: int = 2048):
        self.name, self.max_new_tokens, self.max_input_tokens = name, max_new_tokens, max_input_tokens
        self._loaded = None

    def __getstate__(self) -> dict:
        return {**self.__dict__, "_loaded": None}

    def reply(self, messages: Sequence[dict[str, str]], max_tokens: int) -> str | None:
        try:
            import torch
            from transformers import AutoModelForCausalLM, AutoTokenizer

            if self._loaded is None:
                self._loaded = AutoTokenizer.from_pretrained(self.name), AutoModelForCausalLM.from_pretrained(self.name)
            tokenizer, model = self._loaded
            prompt = "\n".join(m["content"] for m in messages)
            inputs = tokenizer(prompt, return_tensors="pt", truncation=True, max_length=self.max_input_tokens)
            with torch.no_grad():
                out = model.generate(**inputs, max_new_tokens=min(max_tokens, self.max_new_tokens))
            return tokenizer.decode(out[0][inputs["input_ids"].shape[1] :], skip_special_tokens=False)
        except Exception:  # no libraries, no weights or no memory: the caller falls back
            return None


class FirstAvailable:
    """The first model, and the second one for good once the first has failed."""

    def __init__(self, first: ChatModel, second: ChatModel):
        self.first, self.second, self.failed = first, second, False

    def reply(self, messages: Sequence[dict[str, str]], max_tokens: int) -> str | None:
        if not self.failed:
            answer = self.first.reply(messages, max_tokens)
            if answer is not None:
                return answer
            self.failed = True
        return self.second.reply(messages, max_tokens)


class HttpEmbedder:
    """Any endpoint with the common embeddings request shape."""

    def __init__(self, url: str, api_key: str, model: str, timeout: float = 30.0):
        self.url, self.api_key, self.model, self.timeout = url, api_key, model, timeout

    def embed(self, texts: Sequence[str]) -> list[list[float]]:
        try:
            data = _post(self.url, self.api_key, {"model": self.model, "input": list(texts)}, self.timeout)
        except urllib.error.HTTPError as answer:
            if answer.code in BUSY_CODES:
                raise ServiceBusy(str(answer.code)) from answer
            raise
        return [item["embedding"] for item in data["data"]]


def _post(url: str, api_key: str, body: dict, timeout: float) -> dict:
    request = urllib.request.Request(
        url,
        data=json.dumps(body).encode(),
        headers={"Content-Type": "application/json", "Authorization": f"Bearer {api_key}"},
    )
    with urllib.request.urlopen(request, timeout=timeout) as response:
        return json.load(response)


def vectors_or_none(
    embedder: Embedder, texts: Sequence[str], pauses: Sequence[tuple[float, float]] = PAUSES, wait: Callable[[float], None] = time.sleep
) -> list[list[float]] | None:
    """Vectors of a batch, tried once more after each pause, or None."""
    for after_failure, when_busy in (*pauses, (None, None)):
        try:
            return embedder.embed(texts)
        except ServiceBusy:
            pause = when_busy
        except Exception:
            pause = after_failure
        if pause is not None:
            wait(pause)
    return None


def with_embeddings(
    df: DataFrame, embedder: Embedder, text_col: str = "content", batch: int = EMBED_BATCH, tasks: int | None = None
) -> DataFrame:
    """Rows with an `embedding` column, NULL for batches that could not be embedded.

    Only the text travels to Python and its vector back, row by row in order.
    `tasks` sets how many calls run at a time, for services slower than the scan.
    Stage the result before using it twice: a second use would embed again.
    An embedder with a `column` method is an expression; no text leaves the JVM.
    """
    if hasattr(embedder, "column"):
        return df.withColumn("embedding", embedder.column(F.col(text_col)))
    if tasks:
        df = df.repartition(tasks)

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def embed(texts: pd.Series) -> pd.Series:
        vectors: list = []
        rows = texts.tolist()
        for i in range(0, len(rows), batch):
            part = rows[i : i + batch]
            vectors.extend(vectors_or_none(embedder, part) or [None] * len(part))
        return pd.Series(vectors, dtype=object)

    return df.withColumn("embedding", embed.asNondeterministic()(F.col(text_col)))


def with_replies(df: DataFrame, model: ChatModel, messages_col: str, tokens_col: str, out: str) -> DataFrame:
    """Rows with the model's reply to their messages, NULL where the call failed or had no messages."""

    @F.pandas_udf(T.StringType())
    def ask(messages: pd.Series, tokens: pd.Series) -> pd.Series:
        answers = [
            None if text is None else model.reply(json.loads(text), int(limit))
            for text, limit in zip(messages, tokens)
        ]
        return pd.Series(answers, dtype=object)

    return df.withColumn(out, ask.asNondeterministic()(F.to_json(messages_col), F.col(tokens_col)))


def message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))
