"""Ranked lexical search by presence masks.

The terms of the searched items are a small vocabulary. Each document is kept as its postings
over it: which of these terms it holds, how often, and its length. A task takes a block of
documents and turns them into one bitmap per term. For an item the bitmaps of its terms, read
across, give every document a mask of the terms it matches; documents with one mask form a
group. What a group can score at most follows from its mask alone, so groups are weighed from
the highest such bound on and the rest is left as soon as no bound reaches the last of the
best so far. A task hands on its best documents of each item, and those meet item by item.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lorekeep.sources.collections import staged

TOP = 20
#: Items that are searched for together, and the terms they may have together (a longer item is a block of its own).
BLOCK_ITEMS, BLOCK_TERMS = 512, 1 << 16
#: Entries of a block's table of term frequencies: documents times terms (4 bytes each).
BLOCK_CELLS = 1 << 23
#: Bytes of a text that are split into terms at a time.
SLICE_BYTES = 1 << 20

# Letters, digits and every byte beyond ASCII are kept, A-Z as a-z; the rest becomes a space.
_TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def terms_of(text: str) -> Iterator[list[bytes]]:
    """The terms of a text in order, slice by slice."""
    data = text.encode()
    at = 0
    while at < len(data):
        end = min(at + SLICE_BYTES, len(data))
        while end < len(data) and _TERM_BYTES[data[end]] != 32:
            end += 1
        yield data[at:end].translate(_TERM_BYTES).split()
        at = end


def _item_blocks(items: DataFrame) -> Iterator[list[tuple]]:
    """Items with their terms, block by block; the driver holds one block."""
    block, terms = [], 0
    for row in items.toLocalIterator():
        counts = Counter(t for part in terms_of(row["text"] or "") for t in part)
        if not counts:
            continue
        if block and (len(block) >= BLOCK_ITEMS or terms + len(counts) > BLOCK_TERMS):
            yield block
            block, terms = [], 0
        block.append((row["id"], counts))
        terms += len(counts)
    if block:
        yield block


def _postings(number: dict[bytes, int]):
    """A function of batches: id, all terms of the text, and numbers and frequencies of those that are searched for."""

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 1024):
                part = batch.slice(start, 1024)
                sizes, places, terms, counts = [], [0], [], []
                for text in part["text"]:
                    held, n = Counter(), 0
                    for words in terms_of(text.as_py() or ""):
                        held.update(words)
                        n += len(words)
                    found = held.keys() & number.keys()
                    terms += [number[t] for t in found]
                    counts += [held[t] for t in found]
                    sizes.append(n)
                    places.append(len(terms))
                places = pa.array(places, pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [part["id"], pa.array(sizes, pa.int64()), pa.ListArray.from_arrays(places, pa.array(terms, pa.int32())),
                     pa.ListArray.from_arrays(places, pa.array(counts, pa.int64()))], ["id", "n", "terms", "tfs"])

    return post


def _document_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many documents of a task hold each term."""
    total = np.zeros(0, np.int64)
    for batch in batches:
        found = np.bincount(batch["terms"].flatten().to_numpy(), minlength=len(total))
        found[: len(total)] += total
        total = found
    held = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(held.astype(np.int32)), pa.array(total[held])], ["term", "df"])


class BlockSearch:
    """The best documents of each item, over blocks of documents one after the other."""

    def __init__(self, items: list[tuple[np.ndarray, np.ndarray]], weights: np.ndarray, documents: int, all_terms: int, top: int):
        """`items`: numbers of an item's terms, and how often it has them."""
        self.items, self.weights, self.top = items, weights, top
        self.documents, self.all_terms = documents, all_terms
        self.best: list[list[tuple[int, object]]] = [[] for _ in items]
        self.weighed = 0  # documents of all items whose score was worked out

    def add(self, ids: list, rank_of_id: np.ndarray, sizes: np.ndarray, rows: np.ndarray, terms: np.ndarray, tfs: np.ndarray) -> None:
        """A block: ids with their order, lengths, and postings (row, term, tf)."""
        scaled = 75 + (25 * sizes * self.documents) // self.all_terms
        share = np.zeros((len(self.weights), len(ids)), np.int32)  # of a term in a document: below 1,000,000
        share[terms, rows] = (1_000_000_000 * tfs) // (1000 * tfs + 12 * scaled[rows])
        present = np.packbits(share > 0, axis=1)
        most = share.max(axis=1, initial=0).astype(np.int64)
        for i, (numbers, times) in enumerate(self.items):
            worth = times * self.weights[numbers]
            self.best[i] = self._search(self.best[i], ids, rank_of_id, share, present[numbers], numbers, worth, most)

    def _search(self, best, ids, rank_of_id, share, bitmaps, numbers, worth, most):
        any_term = np.unpackbits(np.bitwise_or.reduce(bitmaps, axis=0), count=len(ids))
        matching = np.flatnonzero(any_term)
        if not len(matching):
            return best
        held = np.unpackbits(bitmaps, axis=1, count=len(ids))[:, matching]
        width = -(-len(numbers) // 64) * 8
        masks = np.zeros((len(matching), width), np.uint8)
        masks[:, : -(-len(numbers) // 8)] = np.packbits(held, axis=0).T
        masks = masks.view(np.uint64 if width == 8 else f"V{width}").ravel()
        order = np.argsort(masks, kind="stable")
        starts = np.flatnonzero(np.concatenate(([True], masks[order[1:]] != masks[order[:-1]])))
        bounds = held[:, order[starts]].T.astype(np.int64) @ (worth * most[numbers])
        descending = np.argsort(-bounds, kind="stable")
        sizes = np.diff(np.append(starts, len(order)))
        at = 0
        while at < len(descending):
            bar = best[-1][0] if len(best) >= self.top else 0
            # Equal to the bar may still go before it by its id; a bound of 0 is no hit.
            if bounds[descending[at]] < max(bar, 1):
                break
            end = at + 1
            some = int(sizes[descending[at]])
            while end < len(descending) and some < 4 * self.top and bounds[descending[end]] >= max(bar, 1):
                some += int(sizes[descending[end]])
                end += 1
            docs = np.concatenate([order[starts[g] : starts[g] + sizes[g]] for g in descending[at:end]])
            best = self._weigh(best, ids, rank_of_id, share, matching[docs], numbers, worth)
            at = end
        return best

    def _weigh(self, best, ids, rank_of_id, share, docs, numbers, worth):
        self.weighed += len(docs)
        scores = np.zeros(len(docs), np.int64)
        for a in range(0, len(docs), 4096):
            part = docs[a : a + 4096]
            scores[a : a + 4096] = worth @ share[np.ix_(numbers, part)].astype(np.int64)
        docs, scores = docs[scores > 0], scores[scores > 0]
        first = np.lexsort((rank_of_id[docs], -scores))[: self.top]
        found = best + [(int(scores[j]), ids[docs[j]]) for j in first]
        found.sort(key=lambda f: (-f[0], f[1] is None, 0 if f[1] is None else f[1]))
        return found[: self.top]


def _searcher(search):
    """A function of batches that gives the best documents of each item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, weights, documents, all_terms, top = search.value
        found, id_type = BlockSearch(items, weights, documents, all_terms, top), None
        rows_at_once = max(64, BLOCK_CELLS // max(1, len(weights)))
        for batch in batches:
            id_type = batch["id"].type
            for start in range(0, batch.num_rows, rows_at_once):
                part = batch.slice(start, rows_at_once)
                ids = part["id"]
                rank = np.empty(len(ids), np.int64)
                rank[pc.sort_indices(ids, null_placement="at_end").to_numpy()] = np.arange(len(ids))
                rows = np.repeat(np.arange(len(ids)), pc.list_value_length(part["terms"]).to_numpy())
                found.add(ids.to_pylist(), rank, part["n"].to_numpy(), rows, part["terms"].flatten().to_numpy(), part["tfs"].flatten().to_numpy())
        if id_type is not None:
            flat = [(i, score, doc) for i, best in enumerate(found.best) for score, doc in best]
            yield pa.RecordBatch.from_arrays(
                [pa.array([f[0] for f in flat], pa.int32()), pa.array([f[2] for f in flat], id_type), pa.array([f[1] for f in flat], pa.int64())],
                ["item", "id", "score"])

    return run


def _search_block(spark: SparkSession, texts: DataFrame, block: list[tuple], top: int, id_type: str) -> DataFrame | None:
    """item (place in the block), rank, id, score."""
    vocabulary = sorted({t for _, counts in block for t in counts})
    number = {t: i for i, t in enumerate(vocabulary)}
    posted = staged(texts.mapInArrow(_postings(number), f"id {id_type}, n long, terms array<int>, tfs array<long>"))
    counts = posted.agg(F.count_if(F.col("n") > 0).alias("documents"), F.sum("n").alias("all_terms")).head()
    if not counts["documents"]:
        return None
    per_term = posted.select("terms").mapInArrow(_document_counts, "term int, df long").groupBy("term").agg(F.sum("df").alias("df"))
    df = np.zeros(len(vocabulary), np.int64)
    for row in per_term.collect():  # a row for each term of the block
        df[row["term"]] = row["df"]
    n = counts["documents"]
    weights = np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * int(d) + 1))) for d in df], np.int64)
    items = [
        (np.array([number[t] for t in c], np.int64), np.array(list(c.values()), np.int64)) for _, c in block
    ]
    search = spark.sparkContext.broadcast((items, weights, n, counts["all_terms"], top))
    held = posted.where(F.size("terms") > 0).mapInArrow(_searcher(search), f"item int, id {id_type}, score long")
    # Tasks' lists meet in a few heaps first, so that no item waits for one task with all of them.
    some = W.partitionBy("item", "heap").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    last = W.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    heaped = held.withColumn("heap", F.pmod(F.spark_partition_id(), F.lit(64)))
    few = heaped.withColumn("r", F.row_number().over(some)).where(F.col("r") <= top)
    return few.withColumn("rank", F.row_number().over(last)).where(F.col("rank") <= top).select("item", "rank", "id", "score")


def ranked(
    docs: DataFrame, items: DataFrame, top: int = TOP, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text",
) -> DataFrame:
    """item_id, rank, doc_id, score: for each item its `top` documents of highest score above 0.

    Terms are runs of letters, digits and characters beyond ASCII, A-Z as a-z, in whole texts. With N documents
    that have terms, L terms in all, n in a document and tf of a term, a term held by df documents weighs
    w = floor(1000 * ln((2N + 2) / (2df + 1))), and a document scores, for each term of the item, repeats included,
    w * ((10^9 * tf) div (1000 * tf + 12 * m)) with m = 75 + (25 * n * N) div L, in 64-bit integers.

    Equal scores go by ascending id, a NULL id last. Documents alike are documents of their own; items alike in id
    and text are one, items alike in id alone are each ranked. A NULL or empty text has no terms: it is no hit and
    as an item has no rows. Empty tables give an empty result. Other columns are not looked at. Items are searched
    in blocks of at most 512, all documents for each block.
    """
    spark = docs.sparkSession
    doc_type, item_type = docs.schema[doc_id].dataType.simpleString(), items.schema[item_id].dataType.simpleString()
    texts = docs.select(docs[doc_id].alias("id"), docs[text].cast("string").alias("text"))
    asked = items.select(items[item_id].alias("id"), items[item_text].cast("string").alias("text")).distinct()
    out = None
    for block in _item_blocks(asked):
        hits = _search_block(spark, texts, block, top, doc_type)
        if hits is None:
            break
        names = spark.createDataFrame([(i, item) for i, (item, _) in enumerate(block)], f"item int, item_id {item_type}")
        part = hits.join(F.broadcast(names), "item").select("item_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("doc_id"), "score")
        out = part if out is None else out.unionByName(staged(part))
    return out if out is not None else spark.createDataFrame([], f"item_id {item_type}, rank int, doc_id {doc_type}, score long")
