"""Removal of byte strings that occur earlier: suffixes ordered by radix passes, only as deep as the threshold.

Suffixes that agree for `threshold` bytes are repeated windows; deeper order is never needed. The
first, coarse pass does not look at every suffix: in each window the least of its 32-byte
codes is its anchor, and neighbouring windows with one anchor form a unit. Windows that agree
have equal anchors, so suffixes only need to be ordered among units that share one. Units that
are equal as a whole need no ordering either: all but the first are repeats. What is left,
different units around one anchor, is ordered by most-significant-digit passes over 8 bytes at
a time; a suffix that is alone with its digits leaves, and the groups that remain at the
threshold are exactly the repeated windows.

Anchors with more different units than a task should hold, by a count of all of them, are ordered by
passes of Spark over rows of windows instead: their units are never brought together.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lorekeep.llm.bytescan import _BYTE_CODES, _ODD, _tables, counted_often, mixed, text_bytes
from lorekeep.llm.tables import small, unused
from lorekeep.sources.collections import staged

THRESHOLD = 100
ANCHOR_BYTES = 32  # a power of two
#: Windows of a long text that are looked at together.
PIECE = 1 << 17
#: An anchor that a task has seen this often is put on the list of frequent ones; the list has at most FREQUENT entries.
SEEN, FREQUENT = 64, 1 << 16
#: Anchors that tasks hold to find frequent ones.
FLUSH = 1 << 19
#: Units that tasks hold to find equal ones among their own.
UNITS_HELD = 1 << 17
#: Units that meet in one place; a frequent anchor gets as many places as its count asks for, and at least PLACES.
PLACE_UNITS, PLACES = 1 << 10, 64
#: Units of one anchor that a task orders by itself (about ORDER_BYTES); anchors with more are left to Spark.
GROUP_UNITS = 1 << 12
#: Bytes of units that a task orders together, where one group is not larger.
ORDER_BYTES = 1 << 20
#: A per-document table is broadcast up to so many entries (some 50 MB).
BROADCAST_ENTRIES = 2_000_000

_PLACES = np.uint64((1 << 20) - 1)


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def cut_units(data: np.ndarray, threshold: int = THRESHOLD) -> tuple[np.ndarray, ...]:
    """anchor code, content code, first window and number of windows of each unit of one text."""
    anchors, contents, firsts, counts = [], [], [], []
    width = threshold - ANCHOR_BYTES + 1
    for begin in range(0, max(len(data) - threshold + 1, 0), PIECE):
        part = data[begin : begin + PIECE + threshold - 1]
        codes, step, base = _BYTE_CODES[part], 1, _ODD
        while step < ANCHOR_BYTES:
            codes = codes[:-step] * base + codes[step:]
            step, base = 2 * step, np.uint64(int(base) ** 2 & (2**64 - 1))
        codes = mixed(codes)
        # The place in the low bits makes the leftmost of equal codes the least.
        least, step = (codes & ~_PLACES) | np.arange(len(codes), dtype=np.uint64), 1
        while 2 * step <= width:
            least, step = np.minimum(least[:-step], least[step:]), 2 * step
        if step < width:
            least = np.minimum(least[: step - width], least[width - step :])
        first = np.flatnonzero(np.concatenate(([True], least[1:] != least[:-1])))
        end = np.concatenate((first[1:], [len(least)]))
        up, down = _tables(len(part) + 1)
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_BYTE_CODES[part] * up[: len(part)], dtype=np.uint64)))
        size = (end - first).astype(np.uint64)
        anchors.append(codes[(least[first] & _PLACES).astype(np.int64)])
        contents.append(mixed((sums[end + threshold - 1] - sums[first]) * down[first] + size))
        firsts.append(first + begin)
        counts.append(end - first)
    if not anchors:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(map(np.concatenate, (anchors, contents, firsts, counts)))


def repeated_windows(data: np.ndarray, starts: np.ndarray, group: np.ndarray, rank: np.ndarray,
                     threshold: int = THRESHOLD) -> np.ndarray:
    """Which suffixes (by index) agree in `threshold` bytes with one of their group that has a smaller rank.

    Most-significant-digit passes: a digit is 8 bytes; what no other suffix shares leaves after each pass.
    """
    padded = np.concatenate((data, np.zeros(8, np.uint8))).astype(np.uint64)
    words = np.zeros(len(data), np.uint64)
    for k in range(8):
        words = (words << np.uint64(8)) | padded[k : k + len(data)]
    alive, label = np.arange(len(starts)), group
    for depth in range(0, threshold, 8):
        digit = words[starts[alive] + depth]
        if threshold - depth < 8:
            digit = digit >> np.uint64(8 * (8 - threshold + depth))
        order = np.lexsort((digit, label))
        digit, label, alive = digit[order], label[order], alive[order]
        new = np.concatenate(([True], (digit[1:] != digit[:-1]) | (label[1:] != label[:-1])))
        label = np.cumsum(new) - 1
        many = np.bincount(label)[label] > 1 if len(label) else np.zeros(0, bool)
        alive, label = alive[many], label[many]
        if not len(alive):
            return alive
    order = np.lexsort((rank[alive], label))
    alive, label = alive[order], label[order]
    return np.sort(alive[np.concatenate(([False], label[1:] == label[:-1]))])


def _keyed(docs: DataFrame) -> tuple[DataFrame, bool]:
    """o, t, text: documents in the order that "earlier" means, by o and then t; and whether rows had to be told apart.

    o is the doc_id (NULL last); t only matters where ids are NULL or repeated, and then comes from the text.
    """
    ids = docs.select(docs["doc_id"].cast("long").alias("o"))
    n = ids.agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("o").alias("ids")).head()
    plain = n["rows"] == n["ids"]
    text = F.coalesce(docs["text"], F.lit(""))
    o = F.coalesce(docs["doc_id"].cast("long"), F.lit(2**63 - 1))
    return docs.select(o.alias("o"), (F.lit(0).cast("long") if plain else F.xxhash64(text)).alias("t"), text.alias("text")), not plain


def _frequent(rows: DataFrame, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """Codes of frequent anchors in order, and the places (a power of two) among which their units are dealt."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, room = [], 0

        def often() -> pa.RecordBatch:
            codes, seen = counted_often(np.concatenate(held), SEEN)
            return pa.RecordBatch.from_arrays([pa.array(_signed(codes)), pa.array(seen)], names=["h", "seen"])

        for batch in batches:
            data, places = text_bytes(batch["text"])
            for a, b in zip(places[:-1].tolist(), places[1:].tolist()):
                anchors = cut_units(data[a:b], threshold)[0]
                held.append(anchors)
                room += len(anchors)
                if room > FLUSH:
                    yield often()
                    held, room = [], 0
        if held:
            yield often()

    counted = rows.select("text").mapInArrow(run, "h long, seen long").groupBy("h").agg(F.sum("seen").alias("seen"))
    top = counted.orderBy(F.desc("seen"), "h").limit(FREQUENT).toArrow()
    codes, seen = top["h"].to_numpy().view(np.uint64), top["seen"].to_numpy()
    places = np.left_shift(1, np.ceil(np.log2(np.maximum(seen / PLACE_UNITS, PLACES))).astype(np.int64))
    order = np.argsort(codes)
    return codes[order], np.minimum(places, 1 << 30)[order]


_UNIT = "g long, u long, o long, t long, lo int, n int, kind int"
_NAMES = ["g", "u", "o", "t", "lo", "n", "kind"]


def _units(rows: DataFrame, frequent: tuple[np.ndarray, np.ndarray], threshold: int) -> DataFrame:
    """All units: g to meet by, u what they hold; kind 1 if an equal unit of the task is earlier, the places at a frequent anchor."""
    shared = rows.sparkSession.sparkContext.broadcast(frequent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often, places_of = shared.value
        held, room = [], 0

        def out() -> pa.RecordBatch:
            g, u, o, t, lo, n = (np.concatenate(c) for c in zip(*held))
            order = np.lexsort((lo, t, o, u, g))
            g, u, o, t, lo, n = (c[order] for c in (g, u, o, t, lo, n))
            known = np.concatenate(([False], (g[1:] == g[:-1]) & (u[1:] == u[:-1])))
            spread = np.zeros(len(g), np.int64)
            if len(often):
                at = np.minimum(np.searchsorted(often, g), len(often) - 1)
                spread = np.where(often[at] == g, places_of[at], 0)
            # At a frequent anchor equal units still meet, in one of its places.
            g = np.where(spread > 0, g ^ ((u & (np.maximum(spread, 1) - 1).astype(np.uint64)) + np.uint64(1)), g)
            # Units known to be repeats meet nobody.
            g = np.where(known, mixed(u ^ (lo.astype(np.uint64) * _ODD) ^ o.view(np.uint64)), g)
            columns = [_signed(g), _signed(u), o, t, lo.astype(np.int32), n.astype(np.int32),
                       np.where(known, 1, spread).astype(np.int32)]
            return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=_NAMES)

        for batch in batches:
            data, places = text_bytes(batch["text"])
            for a, b, o, t in zip(places[:-1].tolist(), places[1:].tolist(), batch["o"].to_pylist(), batch["t"].to_pylist()):
                g, u, lo, n = cut_units(data[a:b], threshold)
                if len(g):
                    held.append((g, u, np.full(len(g), o, np.int64), np.full(len(g), t, np.int64), lo, n))
                    room += len(g)
                    if room > UNITS_HELD:
                        yield out()
                        held, room = [], 0
        if held:
            yield out()

    return rows.select("o", "t", "text").mapInArrow(run, _UNIT)


def _fits(per_doc: DataFrame, entries: str) -> DataFrame:
    """Marked for broadcast where a sum over the (staged) table proves it small."""
    total = per_doc.agg(F.sum(F.size(entries) + 1)).head()[0] or 0
    return F.broadcast(per_doc) if total <= BROADCAST_ENTRIES else per_doc


def _beside_texts(units: DataFrame, rows: DataFrame) -> DataFrame:
    """o, t, text, units: the documents that hold any of `units` (g, o, t, lo, n), with those."""
    per_doc = staged(units.groupBy("o", "t").agg(F.collect_list(F.struct("g", "lo", "n")).alias("units")))
    return rows.join(_fits(per_doc, "units"), ["o", "t"])


def _ordered_in_tasks(units: DataFrame, rows: DataFrame, threshold: int) -> DataFrame:
    """o, t, lo, n: runs of repeated windows among `units` (g, o, t, lo, n) that differ but share an anchor g.

    Every g has at most GROUP_UNITS units.
    """

    def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, places = text_bytes(batch["text"])
            for i, (a, units) in enumerate(zip(places[:-1].tolist(), batch["units"])):
                units = units.as_py()
                o, t = batch["o"][i].as_py(), batch["t"][i].as_py()
                out = [data[a + x["lo"] : a + x["lo"] + x["n"] + threshold - 1].tobytes() for x in units]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([x["g"] for x in units], pa.int64()), pa.array([o] * len(units), pa.int64()),
                     pa.array([t] * len(units), pa.int64()), pa.array([x["lo"] for x in units], pa.int32()),
                     pa.array(out, pa.binary())],
                    names=["g", "o", "t", "lo", "part"])

    parts = _beside_texts(units, rows).mapInArrow(slices, "g long, o long, t long, lo int, part binary")

    def order_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def results(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            some = pa.Table.from_batches(held).combine_chunks()
            o, t, lo, g = (some[c].to_numpy() for c in ("o", "t", "lo", "g"))
            part = some["part"].combine_chunks()
            data, places = text_bytes(pa.Array.from_buffers(pa.string() if pa.types.is_binary(part.type) else pa.large_string(),
                                                            len(part), part.buffers(), offset=part.offset))
            windows = np.diff(places) - threshold + 1
            unit = np.repeat(np.arange(len(windows)), windows)
            inside = np.arange(len(unit)) - np.repeat(np.cumsum(windows) - windows, windows)
            # Earlier: smaller o, t and place in the text.
            rank = np.empty(len(unit), np.int64)
            rank[np.lexsort((lo[unit] + inside, t[unit], o[unit]))] = np.arange(len(unit))
            again = repeated_windows(data, places[unit] + inside, g[unit], rank, threshold)
            if len(again):
                run = np.concatenate(([True], (np.diff(again) != 1) | (unit[again[1:]] != unit[again[:-1]])))
                begin = again[run]
                count = np.diff(np.concatenate((np.flatnonzero(run), [len(again)])))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(o[unit[begin]]), pa.array(t[unit[begin]]),
                     pa.array((lo[unit[begin]] + inside[begin]).astype(np.int32)), pa.array(count.astype(np.int32))],
                    names=["o", "t", "lo", "n"])

        held, room = [], 0
        for batch in batches:
            g = batch["g"].to_numpy()
            if not len(g):
                continue
            edges = np.flatnonzero(np.concatenate(([True], g[1:] != g[:-1])))
            lengths = np.diff(text_bytes(pa.Array.from_buffers(pa.string(), len(g), batch["part"].buffers(), offset=batch["part"].offset))[1])
            weight = np.cumsum(lengths)
            last = held[-1]["g"][-1].as_py() if held else None
            done = 0
            for e in edges.tolist():
                # Only between groups, and only when enough windows have come together.
                so_far = room + (weight[e - 1] if e else 0) - (weight[done - 1] if done else 0)
                if so_far > ORDER_BYTES and g[e] != last:
                    if e > done:
                        held.append(batch.slice(done, e - done))
                    yield from results(held)
                    held, room, done = [], 0, e
                last = g[e]
            held.append(batch.slice(done))
            room += int(weight[-1] - (weight[done - 1] if done else 0))
        if held:
            yield from results(held)

    return parts.repartition("g").sortWithinPartitions("g").mapInArrow(order_groups, "o long, t long, lo int, n int")


def _ordered_by_spark(units: DataFrame, rows: DataFrame, threshold: int) -> DataFrame:
    """The same for anchors of any number of units: each task turns the windows of its own texts into two digits of
    half the threshold, as codes, and two passes of Spark group them, by the first digit and by both."""

    def digits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        half = threshold // 2
        for batch in batches:
            data, places = text_bytes(batch["text"])
            for i, (a, units) in enumerate(zip(places[:-1].tolist(), batch["units"])):
                lo, n = units.values.field("lo").to_numpy(), units.values.field("n").to_numpy()
                for first in range(0, len(lo), GROUP_UNITS):
                    los, ns = lo[first : first + GROUP_UNITS].astype(np.int64), n[first : first + GROUP_UNITS].astype(np.int64)
                    part = np.concatenate([data[a + x : a + x + m + threshold - 1] for x, m in zip(los.tolist(), ns.tolist())])
                    inside = np.arange(ns.sum()) - np.repeat(np.cumsum(ns) - ns, ns)
                    starts = inside + np.repeat(np.cumsum(ns + threshold - 1) - (ns + threshold - 1), ns)
                    up, down = _tables(len(part) + 1)
                    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_BYTE_CODES[part] * up[: len(part)], dtype=np.uint64)))
                    d1, d2 = (mixed((sums[y] - sums[x]) * down[x]) for x, y in
                              ((starts, starts + half), (starts + half, starts + threshold)))
                    o, t = (np.full(len(inside), batch[c][i].as_py(), np.int64) for c in ("o", "t"))
                    at = (np.repeat(los, ns) + inside).astype(np.int32)
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in (o, t, at, _signed(d1), _signed(d2))],
                                                     names=["o", "t", "lo", "d1", "d2"])

    found = staged(_beside_texts(units, rows).mapInArrow(digits, "o long, t long, lo int, d1 long, d2 long"))
    first = found.groupBy("d1").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("d1")
    found = found.join(first, "d1", "left_semi")
    least = found.groupBy("d1", "d2").agg(F.min(F.struct("o", "t", "lo")).alias("least"), F.count(F.lit(1)).alias("c")).where("c > 1")
    again = found.join(least, ["d1", "d2"]).where(F.struct("o", "t", "lo") != F.col("least"))
    return again.select("o", "t", "lo", F.lit(1).alias("n"))


def repeated_runs(rows: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """o, t, runs: the maximal runs of bytes [a, b) of each document that are covered by strings that occur earlier.

    `rows`: o, t, text, one row per (o, t), as from _keyed. Documents without such runs have no row.
    """
    frequent = _frequent(rows, threshold)
    units = _units(rows, frequent, threshold).repartition("g")
    here = W.partitionBy("g")
    often = F.col("kind") > 1
    told = (
        units.withColumn("before", F.lag("u").over(here.orderBy("u", "o", "t", "lo")))
        .withColumn("least", F.min("u").over(here)).withColumn("most", F.max("u").over(here))
        .withColumn("again", (F.col("kind") == 1) | F.coalesce(F.col("before") == F.col("u"), F.lit(False)))
        .where(F.col("again") | (F.col("least") != F.col("most")) | often)
        .select(
            # The anchor itself again, where it was dealt to places.
            F.when(often, F.col("g").bitwiseXOR(F.col("u").bitwiseAND(F.col("kind").cast("long") - 1) + 1)).otherwise(F.col("g")).alias("g"),
            "o", "t", "lo", "n", "again",
        )
    )
    told = staged(told)
    open_ = told.where("not again").select("g", "o", "t", "lo", "n")
    # Anchors with more different units than a task should order: at most one in GROUP_UNITS units.
    heavy = staged(open_.groupBy("g").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > GROUP_UNITS).select("g"))
    all_runs = told.where("again").select("o", "t", "lo", "n")
    if heavy.isEmpty():
        all_runs = all_runs.unionByName(_ordered_in_tasks(open_, rows, threshold))
    else:
        light, hot = (open_.join(small(heavy), "g", how) for how in ("left_anti", "left_semi"))
        all_runs = all_runs.unionByName(_ordered_in_tasks(light, rows, threshold)).unionByName(_ordered_by_spark(hot, rows, threshold))
    per_doc = all_runs.groupBy("o", "t").agg(F.collect_list(F.struct("lo", "n")).alias("windows"))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for windows in batch["windows"]:
                flat = windows.values
                lo, n = flat.field("lo").to_numpy().astype(np.int64), flat.field("n").to_numpy()
                order = np.argsort(lo, kind="stable")
                a, b = lo[order], np.maximum.accumulate((lo + n + threshold - 1)[order])
                new = np.concatenate(([True], a[1:] > b[:-1]))
                ends = np.concatenate((b[:-1][new[1:]], b[-1:]))
                out.append([{"a": int(x), "b": int(y)} for x, y in zip(a[new], ends)])
            kind = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch["o"], batch["t"], pa.array(out, kind)], names=["o", "t", "runs"])

    return staged(per_doc.mapInArrow(merge, "o long, t long, runs array<struct<a: long, b: long>>"))


def _with_runs(docs: DataFrame, threshold: int) -> tuple[DataFrame, list[str]]:
    """`docs` with o, t, the runs of each row (NULL: none) and its copy number among rows alike; and the added names."""
    rows, mixed_up = _keyed(docs)
    runs = repeated_runs(rows.dropDuplicates(["o", "t"]) if mixed_up else rows, threshold)
    o, t, found, copy = names = unused(docs, "o", "t", "runs", "copy")
    text = F.coalesce(docs["text"], F.lit(""))
    keyed = docs.withColumns({
        o: F.coalesce(docs["doc_id"].cast("long"), F.lit(2**63 - 1)),
        t: F.xxhash64(text) if mixed_up else F.lit(0).cast("long"),
    })
    runs = runs.select(F.col("o").alias(o), F.col("t").alias(t), F.col("runs").alias(found))
    joined = keyed.join(_fits(runs, found), [o, t], "left")
    number = F.row_number().over(W.partitionBy(o, t).orderBy(o)) if mixed_up else F.lit(1)
    return joined.withColumn(copy, number), names


def _kept(text: bytes, runs: list, copy: int, threshold: int) -> tuple[bytes, list[tuple[int, int]]]:
    if copy > 1 and len(text) >= threshold:  # every string of a further copy occurs in the first
        return b"", [(0, len(text))]
    pairs = [(r["a"], r["b"]) for r in runs or []]
    edges = [0, *[x for p in pairs for x in p], len(text)]
    return b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2])), pairs


def removal_digests(docs: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every document.

    Earlier means smaller doc_id, then earlier in the text. NULL doc_ids come last; documents that share
    an id, or have none, are in the order of a code of their text; of rows alike in both, one counts as
    first. NULL text is empty. Texts below the threshold keep everything. Further columns are ignored.
    """
    mine = docs.select(docs["doc_id"], docs["text"])
    joined, (_, _, found, copy) = _with_runs(mine, threshold)
    id_type = mine.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, runs, number in zip(batch["text"], batch[found], batch[copy]):
                data = (text.as_py() or "").encode()
                kept, pairs = _kept(data, runs.as_py(), number.as_py(), threshold)
                rows.append((len(data), len(data) - len(kept), len(pairs), hashlib.sha256(kept).hexdigest()))
            columns = list(zip(*rows)) or [[]] * 4
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], *(pa.array(c, k) for c, k in zip(columns, kinds))],
                names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return joined.select("doc_id", "text", found, copy).mapInArrow(
        run, f"doc_id {id_type}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def without_repeats(docs: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """`docs` with repeated strings cut out of `text`. All rows and columns stay; n_chars, if there, follows the text.

    A character goes if all its bytes are covered; one that is covered in part stays whole. A text that is
    not changed stays as it is, also NULL. Cases as in removal_digests.
    """
    joined, (_, _, found, copy) = _with_runs(docs, threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, runs, number in zip(batch["text"], batch[found], batch[copy]):
                whole = text.as_py()
                if whole is None or (not runs.is_valid and number.as_py() == 1):
                    out.append(whole)
                    continue
                data = whole.encode()
                _, pairs = _kept(data, runs.as_py(), number.as_py(), threshold)
                left, at = [], 0
                for a, b in pairs:
                    while a < b and data[a] & 0xC0 == 0x80:
                        a += 1
                    while b > a and b < len(data) and data[b] & 0xC0 == 0x80:
                        b -= 1
                    left.append(data[at:a])
                    at = b
                out.append(b"".join([*left, data[at:]]).decode())
            i = batch.schema.get_field_index("text")
            columns = [pa.array(out, batch.schema.field(i).type) if j == i else c for j, c in enumerate(batch.columns)]
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    names = docs.columns
    both = joined.select(*names, found, copy)
    cut = both.mapInArrow(run, both.schema).select(*names)
    return cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in names else cut
