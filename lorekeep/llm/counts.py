"""Token counts of sections: whole documents are encoded once, tokens go to sections by their characters.

Encoding section by section gives other counts, since merges don't stop at section borders. Here
the character span of each token is joined with the spans of the sections, and a token that
crosses a border goes to one section by rule: "start" (that of its first character), "end" (of
its last) or "most" (of most of its characters, the earlier of equals).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lorekeep.llm.bpe import _vocabulary, encode_text

RULES = ("start", "end", "most")


def token_spans(text: str, path: str) -> tuple[np.ndarray, np.ndarray]:
    """First character and the one after the last of each token; a character cut by tokens belongs to each of them."""
    pieces = _vocabulary(path)[0]
    sizes = np.fromiter((len(pieces[i]) for i in encode_text(text, path)), np.int64)
    if not len(sizes):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    data = np.frombuffer(text.encode(), np.uint8)
    char = np.cumsum((data & 0xC0) != 0x80) - 1
    ends = np.cumsum(sizes)
    return char[ends - sizes], char[ends - 1] + 1


def allocate(starts: np.ndarray, ends: np.ndarray, begins: np.ndarray, stops: np.ndarray, rule: str = "start") -> np.ndarray:
    """Tokens per section; sections are in order and don't overlap. Tokens outside all sections count nowhere."""
    counts = np.zeros(len(begins), np.int64)
    if not len(begins) or not len(starts):
        return counts

    def section(at: np.ndarray) -> np.ndarray:
        found = np.searchsorted(begins, at, "right") - 1
        return np.where((found >= 0) & (at < stops[found]), found, -1)

    if rule == "start":
        chosen = section(starts)
    elif rule == "end":
        chosen = section(ends - 1)
    else:
        first, last = np.searchsorted(stops, starts, "right"), np.searchsorted(begins, ends, "left")
        chosen = np.full(len(starts), -1)
        for i in range(len(starts)):
            shares = [(min(ends[i], stops[k]) - max(starts[i], begins[k]), -k) for k in range(first[i], last[i])]
            if shares:
                share, k = max(shares)
                chosen[i] = -k if share > 0 else -1
    return counts + np.bincount(chosen[chosen >= 0], minlength=len(begins))


def section_counts(docs: DataFrame, path: str, rule: str = "start", sections: str | None = None) -> DataFrame:
    """doc_id, section (from 0), start, stop (characters), n_tokens: one row per section of each document.

    `sections` names a column array<struct<start, stop>> in order of place; without it lines are sections.
    NULL texts are empty, NULL sections none. Rows with the same or a NULL id each keep theirs; further
    columns are ignored.
    """
    if rule not in RULES:
        raise ValueError(f"rule is one of {RULES}")
    id_type = docs.schema["doc_id"].dataType.simpleString()
    given = sections is not None
    cut = docs.select(docs["doc_id"], docs["text"], *([docs[sections].alias("sections")] if given else []))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, number, begins, stops, counts, room = [], [], [], [], [], 0
            for i, text in enumerate(batch["text"]):
                text = text.as_py() or ""
                if given:
                    spans = batch["sections"][i].as_py() or []
                    a, b = (np.array([s[k] for s in spans], np.int64) for k in ("start", "stop"))
                else:
                    b = np.cumsum([len(x) + 1 for x in text.split("\n")])
                    a = np.concatenate(([0], b[:-1]))
                    b[-1] -= 1
                rows.append(np.full(len(a), i))
                number.append(np.arange(len(a)))
                begins.append(a)
                stops.append(b)
                counts.append(allocate(*token_spans(text, path), a, b, rule))
                room += len(a)
                if room > 50_000 or i == batch.num_rows - 1:
                    at, no, a, b, n = map(np.concatenate, (rows, number, begins, stops, counts))
                    yield pa.RecordBatch.from_arrays(
                        [batch["doc_id"].take(pa.array(at)), pa.array(no.astype(np.int32)), pa.array(a), pa.array(b), pa.array(n)],
                        names=["doc_id", "section", "start", "stop", "n_tokens"])
                    rows, number, begins, stops, counts, room = [], [], [], [], [], 0

    return cut.mapInArrow(run, f"doc_id {id_type}, section int, start long, stop long, n_tokens long")
