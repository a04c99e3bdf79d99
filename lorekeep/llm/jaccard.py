"""Similarity join of documents by the Jaccard coefficient of their word n-grams, size-aware.

Documents with equal sets are one node. Nodes with few n-grams (up to a boundary) list all
subsets of the size that a partner of each size would have to share: who shares such a subset
is linked, no comparison follows. Larger nodes meet in inverted lists. A list is kept for the
part of a set that any partner must share an element with: the floor(n/5) + 1 first n-grams in
one order of all n-grams, in which those known to be frequent come last. The boundary is the
size from which on listing subsets costs more than scanning lists, by a count of both.

A list is not turned into all its pairs. First every member meets only the first of its size;
what proves to be linked forms components; then only members of different components meet, first one of each
component in a list, then eight, at last all. Before whole sets are compared, bit vectors (a bit per
residue, flipped by each n-gram) show for most pairs that they differ in too many n-grams.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lorekeep.llm.bytescan import counted_often, mixed, shingle_sets
from lorekeep.llm.components import connected_components
from lorekeep.llm.tables import small, unused
from lorekeep.sources.collections import staged

WORDS = 5
#: Frequent n-grams that are put last in the order: at most so many, 8 MB, go to the tasks.
FREQUENT = 1 << 19
#: An n-gram that a task has seen this often (in different sets) may be frequent; looked at every FLUSH n-grams.
SEEN = 3
FLUSH = 1 << 22
#: Rows of inverted lists that one row of a listed subset stands against, when the boundary is chosen.
LIST_COST = 8
LARGEST_SMALL = 12
#: Members of a component that stand for it in a list, round after round; at last all do.
MEETING = (1, 8, 2**31 - 1)
#: Words of 64 parity bits that list members carry.
PARITY_WORDS = 4


def linked_size(a: int, b: int) -> int:
    """Elements that sets of a and b elements must share for 100 * intersection >= 80 * union."""
    return -(-4 * (a + b) // 9)


def partners(n: int) -> range:
    """Sizes that a set linked with one of n elements can have."""
    return range(-(-4 * n // 5), 5 * n // 4 + 1)


def subset_count(n: int) -> int:
    return sum(comb(n, linked_size(n, m)) for m in partners(n) if linked_size(n, m) <= n)


def choose_boundary(histogram: dict[int, int], list_cost: float = LIST_COST) -> int:
    """The largest size handled by subsets: least total of rows over the documents of each size."""
    def cost(bound: int) -> float:
        return sum(c * (subset_count(n) if n <= bound else (n // 5 + 1) * list_cost) for n, c in histogram.items())

    return min(range(0, LARGEST_SMALL + 1), key=lambda bound: (cost(bound), bound))


def _signed(x) -> np.ndarray:
    return np.asarray(x, np.uint64).view(np.int64)


def signature(codes: np.ndarray) -> int:
    """64 bits that stand for a whole set. Sets of 10^10 documents share them by accident about once."""
    total = mixed(codes + np.uint64(0x51ED2701)).sum(dtype=np.uint64)
    return int(_signed(mixed(np.array([total ^ np.uint64(len(codes) * 0x9E3779B1)])))[0])


def parity_bits(codes: np.ndarray) -> bytes:
    """As many bits as elements, rounded up to a power of two: bit h is set if an odd number of codes fall on it."""
    bits = max(64, 1 << int(len(codes)).bit_length())
    return np.packbits(np.bincount((codes & np.uint64(bits - 1)).astype(np.int64), minlength=bits).astype(np.uint8) & 1,
                       bitorder="little").tobytes()


def parity_words(codes: np.ndarray) -> np.ndarray:
    """The same over a fixed number of bits, as longs that SQL can compare."""
    bits = np.bincount((codes & np.uint64(64 * PARITY_WORDS - 1)).astype(np.int64), minlength=64 * PARITY_WORDS)
    return np.packbits(bits.astype(np.uint8) & 1, bitorder="little").view(np.int64)


def least_difference(a: bytes, b: bytes) -> int:
    """At least so many elements are in one set only."""
    if len(a) < len(b):
        a, b = b, a
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    while len(x) > len(y):
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    return int(np.unpackbits(x ^ y).sum())


def _texts(docs: DataFrame) -> DataFrame:
    """k (the document's key in lookups), row (a code of the whole row), doc_id, text. Rows without an id are found by their text."""
    doc_id = docs["doc_id"].cast("long")
    return docs.select(F.coalesce(doc_id, F.xxhash64(docs["text"])).alias("k"), row_code(docs).alias("row"),
                       doc_id.alias("doc_id"), docs["text"])


def row_code(docs: DataFrame) -> Column:
    return F.xxhash64(docs["doc_id"].cast("long"), docs["text"], docs["text"].isNull())


def _described(texts: DataFrame) -> DataFrame:
    """Per document k, doc_id, n, sig, bits; and rows (h, seen) for n-grams that a task saw often."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        room = 0

        def often() -> pa.RecordBatch:
            codes = np.concatenate(list(held.values()))
            held.clear()
            codes, seen = counted_often(codes, SEEN)
            none = pa.nulls(len(codes), pa.int64())
            return pa.RecordBatch.from_arrays(
                [none, none, none, none, none, pa.nulls(len(codes), pa.binary()), pa.nulls(len(codes), pa.list_(pa.int64())),
                 pa.array(_signed(codes)), pa.array(seen)],
                names=["k", "row", "doc_id", "n", "sig", "bits", "w", "h", "seen"])

        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                sizes, sigs, bits, fixed = [], [], [], []
                for codes in shingle_sets(part["text"], WORDS):
                    sizes.append(len(codes))
                    sigs.append(signature(codes))
                    bits.append(parity_bits(codes))
                    fixed.append(parity_words(codes))
                    if len(codes) and sigs[-1] not in held:
                        held[sigs[-1]] = codes
                        room += len(codes)
                none = pa.nulls(len(sizes), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [part["k"], part["row"], part["doc_id"], pa.array(sizes, pa.int64()), pa.array(sigs, pa.int64()),
                     pa.array(bits, pa.binary()), pa.array(fixed, pa.list_(pa.int64())), none, none],
                    names=["k", "row", "doc_id", "n", "sig", "bits", "w", "h", "seen"])
                if room > FLUSH:
                    yield often()
                    held, room = {}, 0
        if held:
            yield often()

    return texts.mapInArrow(run, "k long, row long, doc_id long, n long, sig long, bits binary, w array<long>, h long, seen long")


def _list_rows(texts: DataFrame, frequent: np.ndarray, ranks: np.ndarray, bound: int) -> DataFrame:
    """h, sig, n: the elements by which a set is found, for sets above the boundary or with a partner above it."""
    shared = texts.sparkSession.sparkContext.broadcast((frequent, ranks))
    least = partners(bound + 1)[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, place = shared.value
        done: set[int] = set()
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                found, sigs, sizes, places = [], [], [], []
                for codes in shingle_sets(batch.slice(start, 256)["text"], WORDS):
                    n = len(codes)
                    if n < max(least, 1):
                        continue
                    sig = signature(codes)
                    if sig in done:
                        continue
                    done.add(sig)
                    if len(done) > 1 << 20:
                        done.clear()
                    keep = n // 5 + 1
                    if len(last):
                        at = np.minimum(np.searchsorted(last, codes), len(last) - 1)
                        late = last[at] == codes
                        light = codes[~late]
                        if len(light) < keep:
                            heavy = codes[late][np.argsort(place[at[late]], kind="stable")]
                            light = np.concatenate((light, heavy[: keep - len(light)]))
                        codes = light
                    found.append(codes[:keep])
                    sigs.append(np.full(keep, sig))
                    sizes.append(np.full(keep, n))
                    places.append(np.arange(keep))
                if found:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(_signed(np.concatenate(found))), pa.array(np.concatenate(sigs)),
                         pa.array(np.concatenate(sizes).astype(np.int32)),
                         pa.array(np.concatenate(places).astype(np.int32))], names=["h", "sig", "n", "pos"])

    return texts.select("text").mapInArrow(run, "h long, sig long, n int, pos int")


def _subset_links(texts: DataFrame, bound: int) -> DataFrame:
    """a, b: links among sets of at most `bound` elements, each to the first of those it shares a subset with."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                keys, sigs, lower = [], [], []
                for codes in shingle_sets(batch.slice(start, 256)["text"], WORDS):
                    n = len(codes)
                    if not 0 < n <= bound:
                        continue
                    sig = signature(codes)
                    for m in partners(n):
                        size = linked_size(n, m)
                        if size > min(n, m) or m > bound:
                            continue
                        tag = np.uint64(min(n, m) * 64 + max(n, m))
                        picks = np.array(list(itertools.combinations(range(n), size)))
                        keys.append(mixed(mixed(codes[picks]).sum(axis=1, dtype=np.uint64) + mixed(tag + np.zeros(1, np.uint64))))
                        sigs.append(np.full(len(picks), sig))
                        lower.append(np.full(len(picks), n <= m))
                if keys:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(_signed(np.concatenate(keys))), pa.array(np.concatenate(sigs)),
                         pa.array(np.concatenate(lower))], names=["key", "sig", "lower"])

    rows = texts.select("text").mapInArrow(run, "key long, sig long, lower boolean").distinct()
    rows = staged(rows)
    # Of the two sizes of a key, two sets of the smaller one share enough as well, two of the larger need not.
    heads = rows.groupBy("key").agg(F.min(F.when(F.col("lower"), F.col("sig"))).alias("head"), F.count(F.lit(1)).alias("c"))
    heads = heads.where("c > 1 and head is not null").select("key", "head")
    return rows.join(heads, "key").select(F.col("sig").alias("a"), F.col("head").alias("b")).where("a <> b").distinct()


def _near_enough(pairs: DataFrame, bits: DataFrame) -> DataFrame:
    """The pairs (a, na, b, nb) whose bits don't show too large a difference."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = zip(batch["na"].to_pylist(), batch["nb"].to_pylist())
            fine = [least_difference(x.as_py(), y.as_py()) <= na + nb - 2 * linked_size(na, nb)
                    for (na, nb), x, y in zip(sizes, batch["xa"], batch["xb"])]
            yield pa.RecordBatch.from_arrays([batch[c] for c in ("a", "na", "b", "nb")], names=["a", "na", "b", "nb"]).filter(
                pa.array(fine, pa.bool_()))

    with_bits = (
        pairs.join(bits.select(F.col("sig").alias("a"), F.col("bits").alias("xa")), "a")
        .join(bits.select(F.col("sig").alias("b"), F.col("bits").alias("xb")), "b")
    )
    return with_bits.select("a", "na", "b", "nb", "xa", "xb").mapInArrow(run, "a long, na long, b long, nb long")


def _open(lists: DataFrame, parts: DataFrame, nodes: DataFrame) -> DataFrame:
    """h, sig, n, pos, component, number (among its component in the list), w: members that another component may join.

    Of a member's list, the nearest in size of another component decide: they stand before and after the run of
    its own component in the order of sizes.
    """
    h = W.partitionBy("h")
    placed = lists.join(parts, lists["sig"] == parts["node"], "left").select(
        "h", "sig", "n", "pos", F.coalesce("component", "sig").alias("component"))
    placed = placed.withColumn("number", F.row_number().over(W.partitionBy("h", "component").orderBy("pos", "sig")))
    for name, order in (("below", ("n", "sig")), ("above", (F.desc("n"), F.desc("sig")))):
        near = h.orderBy(*order)
        new_run = F.when(F.lag("component").over(near) != F.col("component"), F.lag("n").over(near))
        placed = placed.withColumn("edge", new_run).withColumn(name, F.last("edge", ignorenulls=True).over(near))
    some = placed.where("5 * below >= 4 * n or 5 * n >= 4 * above").select("h", "sig", "n", "pos", "component", "number")
    return some.join(nodes.select("sig", "w"), "sig")


def _meetings(members: DataFrame) -> DataFrame:
    """a, na, b, nb: pairs of list members of different components that can be linked, b the smaller signature.

    The first element that two sets share in the order leaves room for the others: what follows it in either set
    must be as much as they have to share. A pair that fails this in all its lists cannot be linked, nor one whose
    parity bits differ more often than their elements may.
    """
    least = "cast(ceil(4 * (x.n + y.n) / 9.0 - 1e-9) as int)"
    differ = " + ".join(f"bit_count(x.w[{i}] ^ y.w[{i}])" for i in range(PARITY_WORDS))
    meets = members.alias("x").join(
        members.alias("y"),
        F.expr(
            "x.h = y.h and x.component <> y.component and x.sig > y.sig and 5 * x.n >= 4 * y.n and 5 * y.n >= 4 * x.n "
            f"and x.n - x.pos >= {least} and y.n - y.pos >= {least} and {differ} <= x.n + y.n - 2 * {least}"
        ),
    )
    return meets.select(
        F.col("x.sig").alias("a"), F.col("x.n").cast("long").alias("na"),
        F.col("y.sig").alias("b"), F.col("y.n").cast("long").alias("nb")).distinct()


def _verified(pairs: DataFrame, nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs that are linked, by their whole sets. `pairs` must be staged."""
    asked = pairs.select(F.explode(F.array("a", "b")).alias("sig"), F.xxhash64("a", "b").alias("pair"), "a", "b")
    asked = staged(asked.join(nodes.select("sig", "k"), "sig").select("k", "sig", "pair"))
    mine = texts.select("k", "text").join(small(asked), "k")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 128):
                part = batch.slice(start, 128)
                # A text asked for by several pairs comes several times in a row: its set is made once.
                texts_ = part["text"].dictionary_encode()
                made = [(signature(c), c.tobytes()) for c in shingle_sets(texts_.dictionary, WORDS)]
                rows = [(sig, pair, made[i][1]) for sig, pair, i in
                        zip(part["sig"].to_pylist(), part["pair"].to_pylist(), texts_.indices.to_pylist())
                        if i is not None and made[i][0] == sig]
                if rows:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.binary()))],
                        names=["sig", "pair", "codes"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple = (None, None, None)
        for batch in batches:
            out = []
            for pair, sig, codes in zip(batch["pair"].to_pylist(), batch["sig"].to_pylist(), batch["codes"]):
                if pair == held[0] and sig != held[1]:
                    x, y = (np.frombuffer(c, np.uint64) for c in (held[2], codes.as_py()))
                    if len(np.intersect1d(x, y, assume_unique=True)) >= linked_size(len(x), len(y)):
                        out.append((held[1], sig))
                elif pair != held[0]:
                    held = (pair, sig, codes.as_py())
            yield pa.RecordBatch.from_arrays(
                [pa.array([o[i] for o in out], pa.int64()) for i in (0, 1)], names=["a", "b"])

    whole = mine.mapInArrow(sets, "sig long, pair long, codes binary")
    return whole.repartition("pair").sortWithinPartitions("pair", "sig").mapInArrow(compare, "a long, b long")


def _grouped(docs: DataFrame) -> DataFrame:
    """row, doc_id, n_shingles, component (NULL: linked with nothing), component_id, n_links of each row."""
    texts = _texts(docs)
    described = staged(_described(texts))
    rows = described.where(F.col("n").isNotNull()).select("row", "doc_id", "n", "sig")
    nodes = described.where("n > 0").groupBy("sig").agg(
        F.min("k").alias("k"), F.min("doc_id").alias("first"), F.max("n").alias("n"), F.first("w").alias("w"))
    nodes = staged(nodes)
    bits = staged(described.where("n > 0").select("sig", "bits").dropDuplicates(["sig"]))
    often = (
        described.where(F.col("h").isNotNull()).groupBy("h").agg(F.sum("seen").alias("seen"))
        .orderBy(F.desc("seen"), "h").limit(FREQUENT).toArrow()
    )
    order = np.argsort(often["h"].to_numpy().view(np.uint64), kind="stable")
    frequent = often["h"].to_numpy().view(np.uint64)[order]
    ranks = often["seen"].to_numpy()[order]
    histogram = {r["n"]: r["count"] for r in nodes.where(F.col("n") <= 4 * LARGEST_SMALL).groupBy("n").count().collect()}
    bound = choose_boundary(histogram)
    links = staged(_subset_links(texts, bound)) if bound else None

    group, by_size = W.partitionBy("h", "size_class"), W.partitionBy("h").orderBy("n", "sig")
    # Sizes of a class differ by less than a fifth: each can be linked with each.
    lists = (
        _list_rows(texts, frequent, ranks, bound).repartition("h")
        .withColumn("size_class", F.floor(F.log(F.col("n").cast("double")) / 0.2).cast("int"))
        .withColumn("first", F.first("sig").over(group.orderBy("sig")))
        .withColumn("before", F.lag("sig").over(group.orderBy("sig")))
        .where(F.col("before").isNull() | (F.col("before") != F.col("sig")))
        # Who has no other of a fitting size in a list can't be linked by it.
        .withColumn("below", F.lag("n").over(by_size))
        .withColumn("above", F.lead("n").over(by_size))
        .where("5 * below >= 4 * n or 5 * n >= 4 * above")
        .select("h", "sig", "n", "pos", "first")
    )
    lists = staged(lists)
    sizes = nodes.select("sig", "n")
    heads = lists.where("sig <> first").groupBy(
        F.col("sig").alias("a"), F.col("n").cast("long").alias("na"), F.col("first").alias("b")).agg(F.count(F.lit(1)).alias("c"))
    heads = heads.join(sizes.select(F.col("sig").alias("b"), F.col("n").alias("nb")), "b")
    one = heads.groupBy("a", "na").agg(F.max_by(F.struct("b", "nb"), F.struct("c", "b")).alias("x"))
    pairs = staged(one.select("a", "na", "x.b", "x.nb"))
    nobody = lists.select(F.col("sig").alias("node"), F.col("sig").alias("component")).limit(0)
    parts = nobody if links is None else connected_components(links)
    tried, open_ = pairs, None
    # What has met in a step has met for good: of a merged component no other members come first in a list.
    for most in (0, *MEETING):
        if most:
            if open_ is None:
                open_ = staged(_open(lists, parts, nodes))
            pairs = staged(_meetings(open_.where(F.col("number") <= most)).join(tried.select("a", "b"), ["a", "b"], "left_anti"))
            tried = tried.unionByName(pairs)
        near = staged(_near_enough(pairs, bits))
        if near.limit(1).count() == 0:
            continue
        found = staged(_verified(near, nodes, texts))
        if found.limit(1).count():
            links = found if links is None else found.unionByName(links)
            parts, open_ = connected_components(links), None
    if links is None:
        spark = docs.sparkSession
        links = spark.createDataFrame([], "a long, b long")
    parts = connected_components(links)
    degree = links.select(F.explode(F.array("a", "b")).alias("sig")).groupBy("sig").agg(F.count(F.lit(1)).alias("n_links"))
    named = nodes.join(parts, nodes["sig"] == parts["node"], "left").select(
        "sig", "first", F.coalesce("component", "sig").alias("component"))
    names = named.groupBy("component").agg(F.min("first").alias("component_id"))
    named = named.join(names, "component").join(degree, "sig", "left").select(
        "sig", "component", "component_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
    # Rows without n-grams go their own way: their common signature is no key to meet by.
    alone = rows.where("n = 0").select(
        "row", "doc_id", F.col("n").alias("n_shingles"), F.lit(None).cast("long").alias("component"),
        F.col("doc_id").alias("component_id"), F.lit(0).cast("long").alias("n_links"))
    together = rows.where("n > 0").join(named, "sig").select(
        "row", "doc_id", F.col("n").alias("n_shingles"), "component", "component_id", "n_links")
    return together.unionByName(alone)


def linked_components(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, n_links for every document.

    Words are split at the six separators with A-Z as a-z; a text of fewer than five words is one n-gram, a NULL
    or empty one, or one without words, has none and is linked with nothing: its component is itself. Rows
    alike in text are linked whatever their id; rows with the same id each keep their row; a NULL doc_id is never
    a component's name unless no row of the component has an id. `n_links` counts the links found for the document's
    set while components were made (the tree within large groups, not each pair). Further columns are ignored.
    """
    return _grouped(docs).select("doc_id", "n_shingles", "component_id", "n_links")


def one_of_each(docs: DataFrame) -> DataFrame:
    """`docs`, all columns, with one row of each component: that of the smallest doc_id.

    Where several rows have that id, or none has an id, the row of the smallest code of id and text stays, and
    of rows alike in both the first. Documents without n-grams are linked with nothing and all stay.
    """
    found = staged(_grouped(docs).where(F.col("component").isNotNull()).select("row", "doc_id", "component"))
    best = found.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row"))["row"].alias("best"))
    gone = found.join(best, "component").where("row <> best").select("row").distinct()
    alike = found.groupBy("row").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("row")
    code, no = unused(docs, "code", "no")
    coded = docs.withColumn(code, row_code(docs))
    left = coded.join(small(staged(gone.withColumnRenamed("row", code))), code, "left_anti")
    alike = small(staged(alike.withColumnRenamed("row", code)))
    numbered = left.join(alike, code, "left_semi").withColumn(no, F.row_number().over(W.partitionBy(code).orderBy(code)))
    single = left.join(alike, code, "left_anti")
    return single.select(*docs.columns).unionByName(numbered.where(F.col(no) == 1).select(*docs.columns))
