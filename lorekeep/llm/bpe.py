"""Byte-level BPE over whole texts, long ones in halves.

A text beyond `block_chars` is cut into blocks that tasks encode side by side. Where the
text allows (a space between two words) a cut changes nothing. Where it does not (a long run
without such a place) the token lists of neighbouring blocks are joined as a tree: around the
join a window of tokens is encoded again, and grows until its first and last tokens are those
that stood there before. Byte-pair encoding is decided by neighbouring tokens: a list whose
neighbours all stood side by side in correct encodings is the encoding of the whole.
"""

from __future__ import annotations

import hashlib
import re
import sys
import types
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK_CHARS = 1 << 16
#: How far back from a block's end a harmless place to cut is sought.
SEEK_CHARS = 1 << 12
#: Tokens on each side of a join that are encoded again at first.
WINDOW_TOKENS = 16
#: Bytes of text whose ids a task holds as Python numbers, where one text is not longer.
PART_BYTES = 1 << 19

# Fixed values of the vocabulary file: what splits a text before the merges, and its one special token.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
SPECIAL = "<|endoftext|>"

#: Characters on which the quick encoder and the library are known to agree (the tests encode each of them).
_PLAIN = re.compile(r"[\t\n\r\x20-\x7e¡-¬®-ʯ]*")


def _once(name: str, path: str, load: Callable):
    """What `load` gives for a path, loaded once in each Python process.

    The functions of this module travel to workers by value, which need not have the package. What they load
    is kept in a module of its own, so that it neither travels nor is loaded again by the next task.
    """
    known = vars(sys.modules.setdefault("lorekeep_loaded", types.ModuleType("lorekeep_loaded")))
    if (name, path) not in known:
        known[name, path] = load(path)
    return known[name, path]


def _library(path: str):
    return _once("library", path, _load_library)


def _load_library(path: str):
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(path)
    found.no_truncation()
    found.no_padding()
    return found


def _vocabulary(path: str) -> tuple[list[bytes], object]:
    """Bytes by token id, and a quick encoder with the same merges."""
    return _once("vocabulary", path, _load_vocabulary)


def _load_vocabulary(path: str) -> tuple[list[bytes], object]:
    import tiktoken

    letters = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(b): b for b in letters}
    byte_of |= {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in byte_of.values())}
    library = _library(path)
    special = {i: t.content for i, t in library.get_added_tokens_decoder().items()}
    pieces: list[bytes] = [b""] * library.get_vocab_size()
    for token, i in library.get_vocab().items():
        pieces[i] = special[i].encode() if i in special else bytes(byte_of[c] for c in token)
    ranks = {piece: i for i, piece in enumerate(pieces) if i not in special}
    return pieces, tiktoken.Encoding("ranks", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})


def encode_text(text: str, path: str) -> list[int]:
    """The ids that the tokenizers library gives with the file at `path`, without added special tokens."""
    if _PLAIN.fullmatch(text) and SPECIAL not in text:
        return _vocabulary(path)[1].encode_ordinary(text)
    return _library(path).encode(text, add_special_tokens=False).ids


def decode_ids(ids: Sequence[int], path: str) -> str:
    """The text of the ids; special tokens are written out, bytes that are no UTF-8 become U+FFFD."""
    pieces = _vocabulary(path)[0]
    return b"".join(map(pieces.__getitem__, ids)).decode("utf-8", "replace")


def cut_blocks(text: str, block_chars: int = BLOCK_CHARS) -> list[tuple[str, bool]]:
    """The text in blocks of about `block_chars`, each with whether the cut before it needs no repair."""
    out, start, clean = [], 0, True
    while len(text) - start > block_chars:
        end, found = start + block_chars, False
        for at in range(end, max(start + 1, end - SEEK_CHARS), -1):
            if text[at] == " " and text[at - 1].isalpha() and text[at - 1].isascii() and text[at + 1 : at + 2].isalpha():
                end, found = at, True
                break
        out.append((text[start:end], clean))
        start, clean = end, found
    out.append((text[start:], clean))
    return out


def join_encodings(left: list[int], right: list[int], path: str, window: int = WINDOW_TOKENS) -> list[int]:
    """The encoding of two texts put together, from theirs."""
    if not left or not right:
        return left or right
    pieces = _vocabulary(path)[0]
    a = b = window
    while True:
        a, b = min(a, len(left)), min(b, len(right))
        middle = b"".join(map(pieces.__getitem__, [*left[-a:], *right[:b]]))
        try:
            again = encode_text(middle.decode(), path)
        except UnicodeDecodeError:  # the window begins or ends within a character
            again = []
        # Several tokens must agree, not one: they also settle how the text was split before the merges.
        keep, at_left, at_right = max(2, window // 4), a == len(left), b == len(right)
        left_ok = at_left or again[:keep] == left[len(left) - a : len(left) - a + keep]
        right_ok = at_right or again[-keep:] == right[b - keep : b]
        if (at_left and at_right) or (len(again) >= 2 * keep and left_ok and right_ok):
            return left[: len(left) - a] + again + right[b:]
        a, b = 2 * a, 2 * b


def join_tree(parts: list[tuple[list[int], bool]], path: str) -> list[int]:
    """Neighbouring encodings put together pair by pair until one is left."""
    while len(parts) > 1:
        above = []
        for i in range(0, len(parts) - 1, 2):
            (left, clean), (right, follows) = parts[i], parts[i + 1]
            above.append((left + right if follows else join_encodings(left, right, path), clean))
        parts = above + parts[len(above) * 2 :]
    return parts[0][0] if parts else []


def _parts(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """The rows of a batch in slices of about PART_BYTES of text."""
    sizes = pa.compute.fill_null(pa.compute.binary_length(batch[column]), 0)
    start, room = 0, 0
    for i, size in enumerate(sizes.to_pylist()):
        if room and room + size > PART_BYTES:
            yield batch.slice(start, i - start)
            start, room = i, 0
        room += size
    yield batch.slice(start)


def with_ids(
    docs: DataFrame,
    path: str,
    finish: Callable[[list[int]], tuple],
    schema: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    block_chars: int = BLOCK_CHARS,
) -> DataFrame:
    """One row per document: its id, then what `finish` makes of its token ids, as `schema` names it.

    NULL text counts as empty (no ids); any id, also NULL or a repeated one, keeps its own row;
    further columns are ignored. Texts up to `block_chars` are encoded where they are read; only
    longer ones are dealt out as blocks and put together again by one shuffle of their ids.
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    names = [f.split()[0] for f in schema.split(", ")]
    rows = docs.select(F.col(id_col).alias("key"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    is_long = F.length("text") > block_chars

    def arrow(keys: pa.Array, results: list[tuple], template: pa.Schema) -> pa.RecordBatch:
        columns = list(zip(*results)) if results else [[] for _ in names]
        made = [pa.array(c, template.field(n).type) for n, c in zip(names, columns)]
        return pa.RecordBatch.from_arrays([keys, *made], names=[id_col, *names])

    template = _arrow_schema(schema)

    def encode_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _parts(batch, "text"):
                yield arrow(part["key"], [finish(encode_text(t.as_py(), path)) for t in part["text"]], template)

    out = f"{id_col} {id_type}, {schema}"
    short = rows.where(~is_long).mapInArrow(encode_rows, out)

    def encode_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _parts(batch, "block"):
                ids = pa.array([encode_text(t.as_py(), path) for t in part["block"]], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays(
                    [part["row"], part["key"], part["no"], part["clean"], ids],
                    names=["row", "key", "no", "clean", "ids"],
                )

    def split_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, key, text in zip(batch["row"], batch["key"], batch["text"]):
                blocks = cut_blocks(text.as_py(), block_chars)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([row.as_py()] * len(blocks), pa.string()),
                        pa.array([key.as_py()] * len(blocks), batch["key"].type),
                        pa.array(range(len(blocks)), pa.int32()),
                        pa.array([b for b, _ in blocks], pa.string()),
                        pa.array([c for _, c in blocks], pa.bool_()),
                    ],
                    names=["row", "key", "no", "block", "clean"],
                )

    def join_blocks(key: tuple, group: pa.Table) -> pa.Table:
        group = group.sort_by("no")
        copies = group.filter(pa.compute.equal(group["no"], 0)).num_rows
        parts: dict[int, tuple[list[int], bool]] = {}
        for no, ids, clean in zip(group["no"].to_pylist(), group["ids"], group["clean"].to_pylist()):
            if no not in parts:
                parts[no] = (ids.as_py(), clean)
        result = finish(join_tree(list(parts.values()), path))
        keys = pa.chunked_array([group["key"].combine_chunks()[:1].take(pa.array([0] * copies))]).combine_chunks()
        return pa.Table.from_batches([arrow(keys, [result] * copies, template)])

    # Rows alike in id and text share their blocks: the answer is the same for each of them.
    row = F.concat_ws("-", F.col("key").cast("string"), F.sha2("text", 256))
    blocks = (
        rows.where(is_long)
        .select(row.alias("row"), "key", "text")
        .mapInArrow(split_rows, f"row string, key {id_type}, no int, block string, clean boolean")
        .repartition("row", "no")
        .mapInArrow(encode_blocks, f"row string, key {id_type}, no int, clean boolean, ids array<int>")
    )
    return short.unionByName(blocks.groupBy("row").applyInArrow(join_blocks, out))


def _arrow_schema(schema: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "array<int>": pa.list_(pa.int32())}
    return pa.schema([(f.split()[0], kinds[f.split()[1]]) for f in schema.split(", ")])


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text",
           block_chars: int = BLOCK_CHARS) -> DataFrame:
    """id, ids: the token ids of each whole text. Cases as in with_ids."""
    return with_ids(docs, path, lambda ids: (ids,), "ids array<int>", id_col, text_col, block_chars)


def decode(encoded: DataFrame, path: str, id_col: str = "doc_id") -> DataFrame:
    """id, text: the text of each list of ids. NULL ids give an empty text."""
    id_type = encoded.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pa.array([decode_ids(x.as_py() or [], path) for x in batch["ids"]], pa.string())
            yield pa.RecordBatch.from_arrays([batch[id_col], texts], names=[id_col, "text"])

    return encoded.select(id_col, "ids").mapInArrow(run, f"{id_col} {id_type}, text string")


def round_trip_digests(docs: DataFrame, path: str, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (decimal ids joined by commas), decoded_sha256 (the decoded text in UTF-8)."""

    def digests(ids: list[int]) -> tuple[int, str, str]:
        listed = ",".join(map(str, ids)).encode()
        text = decode_ids(ids, path).encode()
        return len(ids), hashlib.sha256(listed).hexdigest(), hashlib.sha256(text).hexdigest()

    return with_ids(docs, path, digests, "n_tokens long, ids_sha256 string, decoded_sha256 string",
                    block_chars=block_chars)
