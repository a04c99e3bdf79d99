"""The last messages of each live session, kept as streaming state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lorekeep.operators.sessions import SESSION_MESSAGES

MESSAGE = "session_id string, seq long, role string, content string"
STATE = "seqs array<long>, roles array<string>, contents array<string>"


def _last(frame: pd.DataFrame, keep: int) -> pd.DataFrame:
    return frame.sort_values("seq", kind="stable").groupby("session_id", sort=False).tail(keep)


def session_tails(messages: DataFrame, keep: int = SESSION_MESSAGES, idle: str | None = None) -> DataFrame:
    """Per session and micro-batch: its kept messages, newest state in update mode.

    Tasks drop all but the last `keep` messages per session and Arrow batch before
    the shuffle, so a very busy session sends little to its state. With `idle`,
    sessions without messages for that long are forgotten.
    """
    timeout_ms = int(pd.Timedelta(idle).total_seconds() * 1000) if idle else None

    def trim(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield _last(frame, keep)

    def update(key: tuple[str], frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        parts = []
        if state.exists:
            seqs, roles, contents = state.get
            old = {"session_id": key[0], "seq": list(seqs), "role": list(roles), "content": list(contents)}
            parts = [pd.DataFrame(old)]
        for frame in frames:
            parts = [_last(pd.concat([*parts, frame], ignore_index=True), keep)]
        kept = parts[0]
        state.update((kept["seq"].tolist(), kept["role"].tolist(), kept["content"].tolist()))
        if timeout_ms:
            state.setTimeoutDuration(timeout_ms)
        yield kept[["session_id", "seq", "role", "content"]]

    trimmed = messages.select("session_id", "seq", "role", "content").mapInPandas(trim, MESSAGE)
    return trimmed.groupBy("session_id").applyInPandasWithState(
        update,
        MESSAGE,
        STATE,
        "update",
        GroupStateTimeout.ProcessingTimeTimeout if timeout_ms else GroupStateTimeout.NoTimeout,
    )


TIMED = "session_id string, seq long, role string, content string, ts timestamp"


def _millis(ts) -> int:
    return int(pd.Timestamp(ts).tz_localize("UTC").timestamp() * 1000) if pd.Timestamp(ts).tzinfo is None else int(pd.Timestamp(ts).timestamp() * 1000)


class LiveSession(StatefulProcessor):
    """The kept messages of a session, one entry of state each, and a timer that forgets them."""

    def __init__(self, keep: int, idle_ms: int):
        self.keep, self.idle_ms = keep, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.messages = handle.getMapState("messages", "seq long", "role string, content string, ts_ms long")
        self.latest = handle.getValueState("latest", "ts_ms long")

    def handleInputRows(self, key, rows, timerValues):
        new = pd.concat(list(rows), ignore_index=True)
        new["ts_ms"] = [_millis(t) for t in new["ts"]]
        new = new.sort_values(["ts_ms", "seq"], kind="stable")
        latest = self.latest.get()[0] if self.latest.exists() else None
        held = sorted(k[0] for k in self.messages.keys()) if latest is not None else []
        for seq, role, content, at in zip(new["seq"], new["role"], new["content"], new["ts_ms"]):
            if latest is not None and at - latest > self.idle_ms:
                self.messages.clear()  # the session that was is over
                held = []
            seq, latest = int(seq), at if latest is None else max(latest, at)
            self.messages.updateValue((seq,), (role, content, int(at)))
            held = sorted({*held, seq})
            while len(held) > self.keep:
                self.messages.removeKey((held.pop(0),))
        self.latest.update((int(latest),))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(int(latest) + self.idle_ms)
        kept = sorted((k[0], v[0], v[1]) for k, v in self.messages.iterator())
        yield pd.DataFrame({"session_id": [key[0]] * len(kept), "seq": [k[0] for k in kept], "role": [k[1] for k in kept], "content": [k[2] for k in kept]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        self.messages.clear()
        self.latest.clear()
        return iter(())

    def close(self) -> None:
        pass


def live_sessions(messages: DataFrame, keep: int = SESSION_MESSAGES, idle: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Per session and micro-batch with news: its last `keep` messages, in update mode.

    `messages` is a stream of session_id, seq, role, content and ts. A message more than `idle` after the one before
    begins its session anew. State holds an entry for each kept message, so a batch writes what is new and removes
    what falls out; a timer forgets a session as soon as no message in time can continue it. Rows more than
    `late` behind the latest time seen up to the batch before last are dropped; rows without a session or time are not looked at.
    Needs the RocksDB state store (spark.sql.streaming.stateStore.providerClass), which get_session sets.
    """
    idle_ms = int(pd.Timedelta(idle).total_seconds() * 1000)
    timed = messages.where(F.col("session_id").isNotNull() & F.col("ts").isNotNull()).select("session_id", "seq", "role", "content", F.col("ts").cast("timestamp").alias("ts"))
    return timed.withWatermark("ts", late).groupBy("session_id").transformWithStateInPandas(
        LiveSession(keep, idle_ms), MESSAGE, "Update", "EventTime")
