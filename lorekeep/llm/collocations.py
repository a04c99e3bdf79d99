"""Phrases whose words occur together far more often than apart.

Every run of words has a 64-bit Rabin-Karp fingerprint: prefix sums of a polynomial over the
bytes give one for each word, prefix sums over the words one for each run, whatever its length.
Fingerprints are counted length by length. A run can only be frequent if both of its halves that
lack one word are, so a run is counted only where the bitmap of the frequent shorter runs holds
both. What tasks have counted travels in blocks: the leading bits of a fingerprint name its part, and a
task sends the sorted codes and counts of a part as one row, which the part's task merges as arrays. One more pass follows each task's own pointers (first word of the first occurrence) back to
the text: occurrences with equal fingerprints are compared word by word and byte by byte, and the
phrase is cut from the text once. What is counted in the end are phrases, not fingerprints.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lorekeep.llm.bytescan import _tables, mixed, text_bytes
from lorekeep.sources.collections import staged

MOST_WORDS = 5
LEAST_COUNT = 100
PER_LANG = 2000
#: A candidate goes if a longer one around it is at least so many percent as frequent.
COVERED_PERCENT = 100
#: Bytes of text that are hashed at a time. A longer text is cut between words.
SLICE_BYTES = 1 << 19
#: Fingerprints that a task sorts and counts before it passes them on.
CHUNK_RUNS = 1 << 21
#: Parts that fingerprints are counted in: so many at least, and so many for each partition of the texts.
LEAST_PARTS, PARTS_EACH = 1 << 10, 4
#: Bits of a fingerprint that are counted within its part.
CODE_BITS = 32
#: Phrases that a task holds before it passes them on.
HELD_PHRASES = 1 << 17
#: A bitmap has at least 16 places for each frequent run, and at most 2^26 (8 MB): beyond, more runs are counted for nothing.
MOST_BITS = 26

# Kinds of bytes: 0 in a word, 1 between words, 2 at the end of a piece.
_KIND = np.zeros(256, np.uint8)
_KIND[[0x20, 0x09]] = 1
_KIND[[*b".,;:!?", *range(0x0A, 0x0E)]] = 2
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LETTERS = np.random.default_rng(20240513).integers(0, 2**64, 256, dtype=np.uint64) | np.uint64(1)


@dataclass
class Words:
    """The words of a slice: where they are, their fingerprints, piece and text, and how many of them are its own."""

    data: np.ndarray
    begins: np.ndarray
    ends: np.ndarray
    prints: np.ndarray
    piece: np.ndarray
    text: np.ndarray
    own: int

    def phrase(self, at: int, n: int) -> bytes:
        return b" ".join(self.data[self.begins[i] : self.ends[i]].tobytes() for i in range(at, at + n))


def _after_words(data: np.ndarray, at: int, n: int) -> int:
    """The place after the n words that follow `at`, or the end."""
    while n and at < len(data):
        for word in (False, True):  # first what is between words, then a word
            while at < len(data):
                other = np.flatnonzero((_KIND[data[at : at + 4096]] == 0) != word)
                at += int(other[0]) if len(other) else min(4096, len(data) - at)
                if len(other):
                    break
        n -= 1
    return at


def _slices(data: np.ndarray, places: np.ndarray, most: int, size: int) -> Iterator[tuple[int, int, int, np.ndarray]]:
    """Begin, end, end with the words that runs reach into, and texts: several short texts or a part of a long one."""
    i, n = 0, len(places) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(places, places[i] + size, "right")) - 1)
        a, b = int(places[i]), int(places[j])
        if b - a <= size:
            yield a, b, b, np.arange(i, j)
        else:
            text = data[a:b]
            at = 0
            while at < len(text):
                end = _after_words(text, min(at + size, len(text)), 1) if at + size < len(text) else len(text)
                yield a + at, a + end, a + _after_words(text, end, most - 1), np.arange(i, j)
                at = end
        i = j


def words_of(column: pa.Array, most: int = MOST_WORDS, size: int = SLICE_BYTES, bits: int = 64) -> Iterator[Words]:
    """The words of all texts, slice by slice, A-Z as a-z. `bits` weakens the fingerprints of words, for tests."""
    data, places = text_bytes(column)
    for a, b, reach, rows in _slices(data, places, most, size):
        part = _LOWER[data[a:reach]]
        kind = _KIND[part]
        inside = kind == 0
        cut = np.zeros(len(part) + 1, bool)
        edges = places[rows[0] : rows[-1] + 2] - a
        cut[edges[(edges >= 0) & (edges <= len(part))]] = True
        begins = np.flatnonzero(inside & (cut[:-1] | ~np.concatenate(([False], inside[:-1]))))
        ends = np.flatnonzero(inside & (cut[1:] | ~np.concatenate((inside[1:], [False])))) + 1
        up, down = _tables(len(part) + 1)
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_LETTERS[part] * up[: len(part)], dtype=np.uint64)))
        prints = mixed((sums[ends] - sums[begins]) * down[begins] + (ends - begins).astype(np.uint64))
        if bits < 64:
            prints = prints >> np.uint64(64 - bits)
        text = np.searchsorted(places, begins + a, "right") - 1
        # Ends of pieces and of texts both only rise, so that their sum is the same within one piece alone.
        piece = np.cumsum(kind == 2)[begins] + text
        yield Words(part, begins, ends, prints, piece, text, int(np.searchsorted(begins, b - a)))


def runs_of(words: Words, lang_codes: np.ndarray, n: int) -> np.ndarray:
    """A fingerprint for the run of n words from each word on that has so many after it; also of runs across pieces."""
    up, down = _tables(len(words.prints) + 1)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(words.prints * up[: len(words.prints)], dtype=np.uint64)))
    starts = max(0, len(words.prints) - n + 1)
    whole = (sums[n:] - sums[:starts]) * down[:starts]
    return mixed(whole + lang_codes[words.text[:starts]] * np.uint64(2 * n + 1))


def _in_piece(words: Words, n: int) -> np.ndarray:
    """Which words begin a run of n words that is this slice's to count."""
    starts = max(0, len(words.prints) - n + 1)
    ok = words.piece[:starts] == words.piece[n - 1 : n - 1 + starts]
    ok[words.own :] = False
    return ok


@dataclass
class Bitmap:
    """Places of fingerprints; what is set always answers yes, what is not set seldom does."""

    bits: np.ndarray
    shift: int

    def holds(self, prints: np.ndarray) -> np.ndarray:
        at = prints >> np.uint64(self.shift)
        return (self.bits[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1


def bitmap_of(prints: DataFrame, most_bits: int = MOST_BITS) -> tuple[np.ndarray, int] | None:
    """The fingerprints of a staged table as the fields of a bitmap of at most 2^most_bits places; None if there are none."""
    count = prints.count()
    if not count:
        return None
    bits = min(most_bits, max(10, (16 * count - 1).bit_length()))
    at = prints.select(F.shiftrightunsigned("fp", 64 - bits).alias("at"))
    word = at.groupBy(F.shiftright("at", 6).alias("w")).agg(F.expr("bit_or(shiftleft(1L, cast(at & 63 AS int)))").alias("b"))
    found = word.toArrow()  # at most 2^most_bits / 64 rows
    out = np.zeros(1 << (bits - 6), np.int64)
    out[found["w"].to_numpy()] = found["b"].to_numpy()
    return out.view(np.uint64), 64 - bits


def _lang_codes(langs: pa.Array) -> tuple[list[str], np.ndarray]:
    """The language of each row and a 64-bit code for it."""
    coded = langs.dictionary_encode()
    each = np.array([int.from_bytes(hashlib.blake2b(v.encode(), digest_size=8).digest()) for v in coded.dictionary.to_pylist()], np.uint64)
    return langs.to_pylist(), each[coded.indices.to_numpy()]


def _counter(n: int, shorter, size: int, bits: int, part_bits: int):
    """A function of batches that counts the fingerprints of runs of n words whose halves are in the bitmap, one row a part and chunk."""
    edges = np.arange(1 << part_bits, dtype=np.uint64) << np.uint64(CODE_BITS)

    def rows(held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        prints = np.concatenate(held)
        prints >>= np.uint64(64 - CODE_BITS - part_bits)
        prints.sort()
        first = np.flatnonzero(np.concatenate(([True], prints[1:] != prints[:-1])))
        counts = np.diff(first, append=len(prints)).astype(np.uint32)
        prints = prints[first]
        ends = np.append(np.searchsorted(prints, edges[1:]), len(prints))
        begins = np.append(0, ends[:-1])
        codes = prints.astype(np.uint32)
        parts = np.flatnonzero(ends > begins)
        for at in range(0, len(parts), 256):
            some = parts[at : at + 256]
            yield pa.RecordBatch.from_arrays(
                [pa.array(some.astype(np.int32)), *(pa.array([x[begins[p] : ends[p]].tobytes() for p in some], pa.binary()) for x in (codes, counts))],
                ["part", "codes", "counts"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total = [], 0
        for batch in batches:
            _, codes = _lang_codes(batch["lang"])
            for words in words_of(batch["text"], n, size, bits):
                ok = _in_piece(words, n)
                if shorter is not None:
                    there = Bitmap(*shorter.value).holds(runs_of(words, codes, n - 1))
                    ok &= there[: len(ok)] & there[1 : len(ok) + 1]
                found = runs_of(words, codes, n)[ok]
                held.append(found)
                total += len(found)
                if total >= CHUNK_RUNS:
                    yield from rows(held)
                    held, total = [], 0
        if total:
            yield from rows(held)

    return count


def _frequent(least: int, part_bits: int):
    """A function of the blocks of one part that gives the leading bits of the fingerprints counted `least` times or more."""

    def merge(key: tuple, blocks: pa.Table) -> pa.Table:
        codes, counts = (np.concatenate([np.frombuffer(v.as_buffer(), np.uint32) for v in blocks[c]]) for c in ("codes", "counts"))
        order = np.argsort(codes, kind="stable")
        codes, counts = codes[order], counts[order]
        first = np.flatnonzero(np.concatenate(([True], codes[1:] != codes[:-1])))
        often = first[np.add.reduceat(counts.astype(np.int64), first) >= least]
        prints = (np.uint64(key[0].as_py()) << np.uint64(CODE_BITS)) | codes[often].astype(np.uint64)
        return pa.table({"fp": (prints << np.uint64(64 - CODE_BITS - part_bits)).view(np.int64)})

    return merge


def _word_ids(words: Words) -> np.ndarray:
    """A number for each word, equal just for equal words: equal fingerprints are compared byte by byte."""
    _, first, ids = np.unique(words.prints, return_index=True, return_inverse=True)
    model, long = first[ids], words.ends - words.begins
    same = long == long[model]
    live, step = np.flatnonzero(same & (model != np.arange(len(model)))), 0
    while len(live) and step < 64:
        equal = words.data[words.begins[live] + step] == words.data[words.begins[model[live]] + step]
        same[live[~equal]] = False
        step += 1
        live = live[equal & (long[live] > step)]
    for i in live.tolist():  # the rest of long words
        same[i] = words.phrase(i, 1) == words.phrase(int(model[i]), 1)
    others: dict[bytes, int] = {}
    for i in np.flatnonzero(~same).tolist():
        ids[i] = len(first) + others.setdefault(words.phrase(i, 1), len(others))
    return ids


def _reader(frequent: list, size: int, bits: int):
    """A function of batches that counts, by their text, the runs whose fingerprints are frequent, and all words (phrase NULL)."""

    def rows(held: dict) -> Iterator[pa.RecordBatch]:
        keys = list(held)
        for a in range(0, len(keys), 1 << 14):
            part = keys[a : a + (1 << 14)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in part], pa.string()), pa.array([None if k[1] is None else k[1].decode() for k in part], pa.string()),
                 pa.array([held[k] for k in part], pa.int64())], ["lang", "phrase", "n"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, bytes | None], int] = {}
        for batch in batches:
            langs, codes = _lang_codes(batch["lang"])
            for words in words_of(batch["text"], len(frequent), size, bits):
                for text, count in zip(*np.unique(words.text[: words.own], return_counts=True)):
                    key = (langs[text], None)
                    held[key] = held.get(key, 0) + int(count)
                ids = _word_ids(words)
                for n, known in enumerate(frequent, 1):
                    if known.value is None:
                        break
                    at = np.flatnonzero(_in_piece(words, n))
                    prints = runs_of(words, codes, n)
                    at = at[Bitmap(*known.value).holds(prints[at])]
                    if not len(at):
                        continue
                    _, first, group = np.unique(prints[at], return_index=True, return_inverse=True)
                    # The pointer of each fingerprint, and whether an occurrence has the words it points at.
                    points = at[first]
                    there = points[group]
                    same = codes[words.text[at]] == codes[words.text[there]]
                    for j in range(n):
                        same &= ids[at + j] == ids[there + j]
                    for point, count in zip(points.tolist(), np.bincount(group, weights=same, minlength=len(points)).astype(np.int64).tolist()):
                        key = (langs[words.text[point]], words.phrase(point, n))
                        held[key] = held.get(key, 0) + count
                    for i in at[~same].tolist():
                        key = (langs[words.text[i]], words.phrase(i, n))
                        held[key] = held.get(key, 0) + 1
                if len(held) >= HELD_PHRASES:
                    yield from rows(held)
                    held = {}
        yield from rows(held)

    return read


def frequent_phrases(
    docs: DataFrame, least: int = LEAST_COUNT, most_words: int = MOST_WORDS, lang_col: str = "lang", text_col: str = "text",
    slice_bytes: int = SLICE_BYTES, print_bits: int = 64, most_bits: int = MOST_BITS,
) -> DataFrame:
    """lang, phrase, n for each phrase of up to `most_words` words with `least` occurrences or more, and (lang, NULL, all words).

    Counts are exact: fingerprints only choose which runs are looked at.
    """
    spark = docs.sparkSession
    lang = F.coalesce(docs[lang_col].cast("string"), F.lit("und"))
    texts = docs.select(lang.alias("lang"), docs[text_col].cast("string").alias("text")).where(F.col("text").isNotNull())
    part_bits = (max(LEAST_PARTS, PARTS_EACH * texts.rdd.getNumPartitions()) - 1).bit_length()
    frequent: list = []
    for n in range(1, most_words + 1):
        shorter = frequent[-1] if frequent else None
        if shorter is not None and shorter.value is None:
            break
        counts = texts.mapInArrow(_counter(n, shorter, slice_bytes, print_bits, part_bits), "part int, codes binary, counts binary")
        kept = staged(counts.groupBy("part").applyInArrow(_frequent(least, part_bits), "fp long"))
        frequent.append(spark.sparkContext.broadcast(bitmap_of(kept, most_bits)))
    read = texts.mapInArrow(_reader(frequent, slice_bytes, print_bits), "lang string, phrase string, n long")
    counted = read.groupBy("lang", "phrase").agg(F.sum("n").alias("n"))
    return staged(counted.where(F.col("phrase").isNull() | (F.col("n") >= least)))


def _part(words: Column, start: Column, n: Column) -> Column:
    return F.array_join(F.slice(words, start, n), " ")


def collocations(
    docs: DataFrame, least: int = LEAST_COUNT, most_words: int = MOST_WORDS, per_lang: int = PER_LANG,
    covered_percent: int = COVERED_PERCENT, lang_col: str = "lang", text_col: str = "text", **tuning,
) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the first `per_lang` phrases of each language.

    A phrase has 2 to `most_words` words within one piece and a >= `least` occurrences. Cut after k words
    into parts with l and r occurrences it scores floor(1000 * a * n / (l * r)), n being all words of the
    language; its lowest cut counts, of equal ones that with the smallest k. Phrases inside a longer one
    that is `covered_percent` percent as frequent or more are left out. Order: score, then a, both descending,
    then the phrase by its UTF-8 bytes.

    A NULL text has no words, a NULL language counts as `und`. Rows alike each count. An empty table, or one
    without a frequent phrase, gives an empty result. Texts of any length are taken in slices; other columns
    of `docs` are not looked at.
    """
    counted = frequent_phrases(docs, least, most_words, lang_col, text_col, **tuning)
    grams = counted.where(F.col("phrase").isNotNull())
    totals = counted.where(F.col("phrase").isNull()).select("lang", F.col("n").alias("all_words"))
    words = F.split("phrase", " ", -1)
    phrases = grams.select("lang", "phrase", F.col("n").alias("a"), words.alias("words")).where(F.size("words") >= 2)
    size = F.size("words")
    cuts = phrases.select("lang", "phrase", "a", "words", F.explode(F.sequence(F.lit(1), size - 1)).alias("k")).select(
        "lang", "phrase", "a", "k",
        _part(F.col("words"), F.lit(1), F.col("k")).alias("left_part"),
        _part(F.col("words"), F.col("k") + 1, size - F.col("k")).alias("right_part"),
    )
    left = grams.select("lang", F.col("phrase").alias("left_part"), F.col("n").alias("l"))
    right = grams.select("lang", F.col("phrase").alias("right_part"), F.col("n").alias("r"))
    weighed = cuts.join(left, ["lang", "left_part"]).join(right, ["lang", "right_part"]).join(totals, "lang")
    score = F.expr(
        "(cast(1000 AS decimal(4,0)) * cast(a AS decimal(17,0)) * cast(all_words AS decimal(17,0)))"
        " div (cast(l AS decimal(19,0)) * cast(r AS decimal(19,0)))"
    )
    lowest = (
        weighed.withColumn("score", score)
        .groupBy("lang", "phrase", "a", F.col("all_words").alias("n"))
        .agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
        .select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score")
    )
    # Every shorter phrase of two words or more inside each longer one.
    inner = F.flatten(F.transform(
        F.sequence(F.lit(2), size - 1),
        lambda m: F.transform(F.sequence(F.lit(1), size - m + 1), lambda i: _part(F.col("words"), i, m)),
    ))
    around = (
        phrases.where(size >= 3)
        .select("lang", F.col("a").alias("longer"), F.explode(F.array_distinct(inner)).alias("phrase"))
        .groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    )
    covered = lowest.join(around, ["lang", "phrase"]).where(
        100 * F.col("longer").cast("decimal(20,0)") >= covered_percent * F.col("a").cast("decimal(20,0)")
    )
    left_over = lowest.join(covered.select("lang", "phrase"), ["lang", "phrase"], "left_anti")
    order = W.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = left_over.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= per_lang)
    return ranked.select("lang", F.col("rank").cast("long"), "phrase", "a", "l", "r", "n", "score")
