"""A quality score from document statistics.

Statistics of the text are standardised and mapped to random Fourier features, whose inner
products approximate a Gaussian kernel. Ridge regression is fitted from normal equations that
tasks sum over their rows; an isotonic step, fitted on other rows, turns its output into a
probability. Nothing but the text of a document enters its score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorekeep.llm.bytescan import text_bytes, word_codes
from lorekeep.sources.collections import staged

FEATURES = 256
RIDGE = 1e-3
#: Tasks that sum the normal equations: so many matrices are added up at the end.
FIT_TASKS = 64
#: Steps to which raw scores are rounded before the isotonic fit; at most 4 * STEPS + 1 rows are gathered.
STEPS = 1000

_CLASSES = (
    b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b" ", b"\n", b"\t\x0b\x0c\r",
    b".", b",", b"!?", b"#*$%&", b"|<>", b"()[]{}", b"/\\@_=+~^`", b"\"':;-", bytes(range(0x80, 0xC0)),
    bytes(range(0xC0, 0x100)),
)
_CLASS_OF = np.full(256, len(_CLASSES), np.uint8)
for _i, _members in enumerate(_CLASSES):
    _CLASS_OF[list(_members)] = _i


def statistics(texts: pa.Array) -> np.ndarray:
    """One row of numbers per text. NULL is an empty text, whose row is all zero."""
    data, places = text_bytes(texts)
    n = len(places) - 1
    lengths = np.diff(places)
    shares = np.zeros((n, len(_CLASSES) + 1))
    for i in range(n):
        if lengths[i]:
            part = _CLASS_OF[data[places[i] : places[i + 1]]]
            shares[i] = np.bincount(part, minlength=len(_CLASSES) + 1) / lengths[i]
    codes, marks = word_codes(texts)
    words = np.diff(marks)
    more = np.zeros((n, 9))
    more[:, 0], more[:, 1] = np.log1p(lengths), np.log1p(words)
    more[:, 2] = lengths / np.maximum(words, 1)
    for i, text in enumerate(texts):
        if not words[i]:
            continue
        mine = codes[marks[i] : marks[i + 1]]
        more[i, 3] = len(np.unique(mine)) / len(mine)
        more[i, 4] = np.mean(mine[1:] == mine[:-1]) if len(mine) > 1 else 0
        if len(mine) >= 4:
            fours = mine[:-3] * np.uint64(7) + mine[1:-2] * np.uint64(77) + mine[2:-1] * np.uint64(777) + mine[3:]
            more[i, 5] = 1 - len(np.unique(fours)) / len(fours)
        lines = [x for x in text.as_py().split("\n") if x.strip()]
        more[i, 6] = np.log1p(len(lines))
        more[i, 7] = 1 - len(set(lines)) / max(len(lines), 1)
        more[i, 8] = np.log1p(len(mine) / max(len(lines), 1))
    return np.hstack((shares, more)).astype(np.float32)


class Projection:
    """Standardised statistics as random Fourier features, a constant one first."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, features: int = FEATURES, width: float = 1.0, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.mean, self.scale = mean, np.where(scale > 1e-9, scale, 1.0)
        self.turn = rng.normal(size=(len(mean), features)) / (width * np.sqrt(len(mean)))
        self.shift = rng.uniform(0, 2 * np.pi, features)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        # A value far outside what was seen would only turn the phase at random: it counts as the edge.
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        waves = np.cos(z @ self.turn + self.shift) * np.sqrt(2 / self.turn.shape[1])
        return np.hstack((np.ones((len(x), 1)), waves))


def isotonic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the rising step function nearest to y over ascending x (pool adjacent violators)."""
    blocks: list[list[float]] = []  # of weighted x, weighted y, weight
    for a, b, w in zip(x * weight, y * weight, weight):
        blocks.append([a, b, w])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            last = blocks.pop()
            blocks[-1] = [p + q for p, q in zip(blocks[-1], last)]
    at = np.array(blocks)
    return at[:, 0] / at[:, 2], at[:, 1] / at[:, 2]


def _matrix(batch: pa.RecordBatch, name: str = "stats") -> np.ndarray:
    if not batch.num_rows:
        return np.zeros((0, 0))
    return batch[name].flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1).astype(float)


def with_stats(docs: DataFrame) -> DataFrame:
    """doc_id, stats: the numbers of each whole text. One read of the texts, no shuffle."""
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                rows = statistics(part["text"])
                flat = pa.array(rows.ravel(), pa.float32())
                places = pa.array(np.arange(0, rows.size + 1, rows.shape[1]), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [part["doc_id"], pa.ListArray.from_arrays(places, flat)], names=["doc_id", "stats"]
                )

    return docs.select(docs["doc_id"], docs["text"]).mapInArrow(run, f"doc_id {id_type}, stats array<float>")


class QualityModel:
    def __init__(self, projection: Projection, weights: np.ndarray, knots: tuple[np.ndarray, np.ndarray]):
        self.projection, self.weights, self.knots = projection, weights, knots

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return self.projection(stats) @ self.weights

    def score(self, stats: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.raw(stats), *self.knots), 0.0, 1.0)


def fit(fitting: DataFrame, calibrating: DataFrame, ridge: float = RIDGE, tasks: int = FIT_TASKS) -> QualityModel:
    """A model from two tables of (stats, label 0/1): one for the ridge step, one for the isotonic step.

    Rows without statistics or label are left out. With no rows to fit, every score is the mean
    label known, or 0.5.
    """
    known = F.col("stats").isNotNull() & F.col("label").isNotNull()
    fitting, calibrating = fitting.where(known), calibrating.where(known)
    if fitting.limit(1).count() == 0:
        seen = calibrating.agg(F.avg("label")).head()[0]
        prior = 0.5 if seen is None else float(seen)
        width = len(statistics(pa.array([""]))[0])
        return QualityModel(Projection(np.zeros(width), np.ones(width)), np.zeros(FEATURES + 1),
                            (np.array([0.0]), np.array([prior])))
    spread = fitting.select("stats", F.col("label").cast("double").alias("label")).repartition(tasks)
    moments = spread.select(F.posexplode("stats").alias("i", "x")).groupBy("i").agg(
        F.avg("x").alias("mean"), F.stddev_pop("x").alias("scale"))
    rows = sorted(moments.collect())  # one row per statistic
    projection = Projection(np.array([r["mean"] for r in rows]), np.array([r["scale"] for r in rows]))

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((FEATURES + 1, FEATURES + 2))
        for batch in batches:
            if batch.num_rows:
                phi = projection(_matrix(batch))
                total += phi.T @ np.hstack((phi, batch["label"].to_numpy()[:, None]))
        places = pa.array(np.arange(0, total.size + 1, total.shape[1]), pa.int32())
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(FEATURES + 1), pa.int32()), pa.ListArray.from_arrays(places, pa.array(total.ravel()))],
            names=["i", "row"],
        )

    def added(key: tuple, group: pa.Table) -> pa.Table:
        whole = group["row"].combine_chunks().flatten().to_numpy().reshape(group.num_rows, -1).sum(axis=0)
        return pa.table({"i": pa.array([key[0].as_py()], pa.int32()), "row": pa.array([whole.tolist()])})

    kind = "i int, row array<double>"
    equations = spread.mapInArrow(summed, kind).groupBy("i").applyInArrow(added, kind).collect()  # FEATURES + 1 rows
    total = np.array([r["row"] for r in sorted(equations)])
    gram, target = total[:, :-1], total[:, -1]
    penalty = np.eye(len(gram)) * ridge * gram[0, 0]
    penalty[0, 0] = 0
    weights = np.linalg.solve(gram + penalty, target)
    plain = QualityModel(projection, weights, (np.array([0.0, 1.0]), np.array([0.0, 1.0])))

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                step = np.clip(np.round(plain.raw(_matrix(batch)) * STEPS), -2 * STEPS, 2 * STEPS)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(step.astype(np.int32)), batch["label"]], names=["step", "label"])

    steps = calibrating.select("stats", F.col("label").cast("double").alias("label")).mapInArrow(
        binned, "step int, label double")
    seen = sorted(steps.groupBy("step").agg(F.avg("label").alias("y"), F.count(F.lit(1)).alias("n")).collect())
    if not seen:
        return plain
    knots = isotonic(*(np.array([r[c] for r in seen], float) for c in ("step", "y", "n")))
    return QualityModel(projection, weights, (knots[0] / STEPS, knots[1]))


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every document.

    Labels of documents whose crc32(doc_id as text) mod 3 is 1 are never read for learning; of the
    others, remainder 0 fits the ridge step and remainder 2 the isotonic step. NULL and empty texts
    have the statistics of an empty text and get a score like any other; rows with the same or a NULL
    doc_id each keep their own row (NULL: not held out, never labelled). Further columns are ignored.
    """
    stats = staged(with_stats(docs))
    third = F.crc32(F.col("doc_id").cast("string")) % 3
    marked = labels.select(labels["doc_id"], labels["quality"].alias("label")).where(F.col("label").isin(0, 1))
    learned = stats.where(third != 1).join(marked, "doc_id").select("stats", "label", third.alias("third"))
    model = fit(learned.where(F.col("third") == 0), learned.where(F.col("third") == 2))
    id_type = stats.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = model.score(_matrix(batch)) if batch.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(score)], names=["doc_id", "score"])

    scored = stats.mapInArrow(run, f"doc_id {id_type}, score double")
    return scored.select(
        "doc_id",
        F.coalesce(third == 1, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )
