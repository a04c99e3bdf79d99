"""Array arithmetic over the UTF-8 bytes of many texts at once, for use inside tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Texts are taken together up to about so many bytes; a longer text is cut at a separator.
SLICE_BYTES = 1 << 20

_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
_ODD = np.uint64(0x9E3779B97F4A7C15)
_BYTE_CODES = np.random.default_rng(20240229).integers(0, 2**64, 256, dtype=np.uint64) | np.uint64(1)
_LOWER_CODES = _BYTE_CODES.copy()
_LOWER_CODES[65:91] = _BYTE_CODES[97:123]


def mixed(x: np.ndarray) -> np.ndarray:
    """64 bits spread over 64 bits, one to one."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def counted_often(codes: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """The codes that occur `least` times or more (2 at least), ascending, and how often. Sorts `codes` in place, without further copies."""
    codes.sort()
    again = codes[: 1 - least][codes[least - 1 :] == codes[: 1 - least]]
    found, more = np.unique(again, return_counts=True)
    return found, more + least - 1


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the odd base and of its inverse modulo 2^64."""
    inverse = np.uint64(pow(int(_ODD), -1, 2**64))
    up, down = np.full(n, _ODD, np.uint64), np.full(n, inverse, np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


_UP, _DOWN = _powers(1)


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _UP, _DOWN
    if len(_UP) < n:
        _UP, _DOWN = _powers(1 << int(n - 1).bit_length())
    return _UP, _DOWN


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column, and the n + 1 places where its texts begin and end. NULL is empty."""
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, places, data = column.buffers()
    places = np.frombuffer(places, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1]
    if not len(places):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    return data, places.astype(np.int64)


def _spans(data: np.ndarray, places: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
    """Begin and end in bytes, and the texts within: few short texts, or a part of one long text."""
    i, n = 0, len(places) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(places, places[i] + SLICE_BYTES, "right")) - 1)
        a, b = int(places[i]), int(places[j])
        if j > i + 1 or b - a <= SLICE_BYTES:
            yield a, b, np.arange(i, j)
        else:
            while a < b:
                end = min(b, a + SLICE_BYTES)
                while end < b and not _SEPARATOR[data[end - 1]]:
                    found = np.flatnonzero(_SEPARATOR[data[end : end + SLICE_BYTES]])
                    end = end + int(found[0]) + 1 if len(found) else min(b, end + SLICE_BYTES)
                yield a, end, np.arange(i, j)
                a = end
        i = j


def word_codes(column: pa.Array, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit code for each word `[^\\x20\\x09-\\x0D]+` of each text; n + 1 places as in text_bytes.

    Equal words have equal codes; with `lower`, A-Z count as a-z.
    """
    data, places = text_bytes(column)
    n = len(places) - 1
    codes, counts, table = [], np.zeros(n + 1, np.int64), _LOWER_CODES if lower else _BYTE_CODES
    for a, b, rows in _spans(data, places):
        part = data[a:b]
        if not len(part):
            continue
        inside = ~_SEPARATOR[part]
        cut = np.zeros(len(part) + 1, bool)
        edges = places[rows[0] : rows[-1] + 2] - a
        cut[edges[(edges >= 0) & (edges <= len(part))]] = True
        begins = np.flatnonzero(inside & (cut[:-1] | ~np.concatenate(([False], inside[:-1]))))
        ends = np.flatnonzero(inside & (cut[1:] | ~np.concatenate((inside[1:], [False])))) + 1
        up, down = _tables(len(part) + 1)
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(table[part] * up[: len(part)], dtype=np.uint64)))
        codes.append(mixed((sums[ends] - sums[begins]) * down[begins] + (ends - begins).astype(np.uint64)))
        at = np.searchsorted(places, begins + a, "right") - 1
        counts[:-1] += np.bincount(at, minlength=n)[:n]
    out = np.concatenate(codes) if codes else np.zeros(0, np.uint64)
    return out, np.concatenate(([0], np.cumsum(counts[:-1])))


def shingle_sets(column: pa.Array, words: int = 5) -> Iterator[np.ndarray]:
    """Per text the sorted distinct codes of its runs of `words` words; a shorter text is one run, none is empty.

    Words are compared with A-Z as a-z.
    """
    codes, places = word_codes(column, lower=True)
    runs = np.zeros(0, np.uint64)
    if len(codes) >= words:
        runs = codes[: len(codes) - words + 1].copy()
        for k in range(1, words):
            runs = runs * _ODD + codes[k : len(codes) - words + 1 + k]
        runs = mixed(runs)
    for a, b in zip(places[:-1].tolist(), places[1:].tolist()):
        if b - a >= words:
            yield np.unique(runs[a : b - words + 1])
        elif b > a:
            whole = np.uint64(b - a)
            for code in codes[a:b]:
                whole = _step(whole, code)
            yield mixed(np.array([whole], np.uint64))
        else:
            yield np.zeros(0, np.uint64)


def _step(whole: np.uint64, code: np.uint64) -> np.uint64:
    return np.uint64((int(whole) * int(_ODD) + int(code)) & (2**64 - 1))
