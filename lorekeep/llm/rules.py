"""Quality rules whose cutoffs labelled documents have vouched for. DataFrame functions only.

Each rule compares one share (symbols, repeated lines, ...) with a cutoff. Labelled documents
of quality 1 are the holdout: at a cutoff that rejects k of a stratum's n of them, the exact
binomial probability of seeing at most k if the true rate were `max_rate` is the p-value of
"this cutoff rejects more good documents than allowed". Cutoffs are tested from lenient to
strict and the last one before the first failure is taken (fixed-sequence testing needs no
further correction); over strata and rules the error level is divided (Bonferroni), and the
allowed rate is divided over the rules, so that in every stratum all rules together reject
at most `max_rate` of the good documents, with probability 1 - `error`.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lorekeep.functions.binding import let
from lorekeep.llm.tables import WORD, unused
from lorekeep.sources.collections import staged

SEPARATORS = r"[\x20\x09-\x0D]+"
WINDOW_WORDS = 8
#: Characters that count as symbols.
SYMBOLS = r"[#*$%&|<>]"


@dataclass(frozen=True)
class Rule:
    """Rejects where `share` is above the cutoff; cutoffs are tried from the most lenient on."""

    name: str
    share: str
    cutoffs: tuple[float, ...]


_SHARES = tuple(round(0.02 * k, 2) for k in range(40, 0, -1))

RULES = (
    Rule("symbols", "n_symbols / greatest(n_words, 1)", tuple(round(0.05 * k, 2) for k in range(60, 0, -1))),
    Rule("shouted", "n_marks / greatest(n_words, 1)", tuple(round(0.05 * k, 2) for k in range(40, 0, -1))),
    Rule("repeated_lines", "n_dup_lines / greatest(n_lines, 1)", _SHARES),
    Rule("repeated_words", "n_repeat_words / greatest(n_words, 1)", _SHARES),
    Rule("long_words", "word_chars / greatest(n_words, 1)", tuple(float(k) for k in range(40, 4, -1))),
)


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, SEPARATORS, -1), lambda w: w != "")


def _repeat_words(words: Column, n: int = WINDOW_WORDS) -> Column:
    """Words covered by a window of n words that occurs twice or more in the text."""

    def windows(ws: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.size(ws) - (n - 1)), lambda i: F.xxhash64(F.slice(ws, i, F.lit(n))))

    def covered(starts: Column) -> Column:
        # Starts are ascending: each adds the words that the one before has not covered.
        end = F.struct(F.lit(0).alias("to"), F.lit(0).cast("long").alias("n"))
        return F.aggregate(
            starts,
            end,
            lambda a, s: F.struct(
                (s + n).alias("to"), (a["n"] + n - F.greatest(F.lit(0), a["to"] - s)).cast("long").alias("n")
            ),
            lambda a: a["n"],
        )

    def repeated(codes: Column) -> Column:
        placed = F.array_sort(F.transform(codes, lambda c, i: F.struct(c.alias("c"), i.alias("i"))))

        def starts(p: Column) -> Column:
            here = F.transform(
                p,
                lambda x, k: F.when(
                    (F.get(p, k - 1)["c"] == x["c"]) | (F.get(p, k + 1)["c"] == x["c"]), x["i"]
                ),
            )
            return F.array_sort(F.filter(here, lambda i: i.isNotNull()))

        return let(placed, lambda p: covered(starts(p)))

    none = F.lit(0).cast("long")
    # Most texts repeat no window: they are done after one look at the distinct codes.
    found = let(
        windows(words),
        lambda codes: F.when(F.size(F.array_distinct(codes)) == F.size(codes), none).otherwise(repeated(codes)),
    )
    return F.when(F.size(words) <= n, none).otherwise(found)


def with_statistics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """`docs` with one struct `_stats` of counts. NULL text counts as a text without words."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    split = docs.withColumn("_words", words_of(text))
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(WORD))

    def counted(ls: Column) -> Column:
        n = F.size("_words")
        repeat = _repeat_words(F.col("_words"))
        return F.struct(
            n.cast("long").alias("n_words"),
            F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
            F.regexp_count(text, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
            (F.length(text) - F.length(F.replace(text, F.lit("!"), F.lit("")))).cast("long").alias("n_marks"),
            F.size(ls).cast("long").alias("n_lines"),
            (F.size(ls) - F.size(F.array_distinct(ls))).cast("long").alias("n_dup_lines"),
            repeat.alias("n_repeat_words"),
        )

    # As rows of a generator the counts are made once, whatever later filters and columns ask of them.
    return split.withColumn("_stats", F.explode(F.array(let(lines, counted)))).drop("_words")


def base_failed(n_words: Column, n_repeat_words: Column) -> Column:
    return (n_words < 20) | (100 * n_repeat_words > 30 * n_words)


def _log_gamma(x: Column) -> Column:
    """ln of the gamma function for x >= 1, by Stirling's series eight steps further on."""
    y = x + F.lit(8.0)
    series = (y - 0.5) * F.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y * y * y) + 1 / (
        1260 * y * y * y * y * y
    )
    steps = F.lit(0.0)
    for k in range(8):
        steps = steps + F.log(x + F.lit(float(k)))
    return series - steps


def binomial_tail(n: Column, k: Column, rate: float, terms: int = 4096) -> Column:
    """P(X <= k) for X of n draws at `rate`, to double precision; 1 where k is not below the mean.

    Summed downwards from k. After `terms` summands what is left is bounded by a geometric
    series, so the value is never too small.
    """
    n, k = n.cast("double"), k.cast("double")
    log_top = (
        _log_gamma(n + 1) - _log_gamma(k + 1) - _log_gamma(n - k + 1)
        + k * F.lit(math.log(rate)) + (n - k) * F.lit(math.log1p(-rate))
    )
    start = F.struct(F.lit(1.0).alias("term"), F.lit(0.0).alias("sum"))
    last = F.greatest(F.lit(0.0), k - terms)
    summed = F.aggregate(
        F.sequence(k.cast("long"), last.cast("long"), F.lit(-1).cast("long")),
        start,
        lambda a, i: F.struct(
            (a["term"] * i / (n - i + 1) * F.lit((1 - rate) / rate)).alias("term"), (a["sum"] + a["term"]).alias("sum")
        ),
    )
    ratio = last / (n - last + 1) * F.lit((1 - rate) / rate)
    total = let(summed, lambda s: s["sum"] + s["term"] / (1 - ratio))
    return F.when(k >= n * rate, F.lit(1.0)).otherwise(F.least(F.lit(1.0), F.exp(log_top) * total))


def select_cutoffs(
    labelled: DataFrame,
    rules: tuple[Rule, ...] = RULES,
    max_rate: float = 0.05,
    error: float = 0.05,
) -> DataFrame:
    """stratum, rule, cutoff: the strictest cutoffs that the labelled documents vouch for.

    `labelled`: stratum, good (boolean), and the counts of with_statistics. Strata of which too
    few good documents are known get no row: no rule applies to them. A NULL stratum is one of its own.
    """
    good = labelled.where("good")
    n_strata = max(1, good.select("stratum").distinct().count())
    grid = F.explode(
        F.array(*[
            F.struct(F.lit(r.name).alias("rule"), F.expr(r.share).cast("double").alias("share"),
                     F.array(*map(F.lit, r.cutoffs)).alias("cutoffs"))
            for r in rules
        ])
    ).alias("g")
    # A document counts at the first cutoff that rejects it; a histogram per rule, then running sums.
    first = F.aggregate("g.cutoffs", F.lit(0), lambda a, c: a + F.when(F.col("g.share") > c, 0).otherwise(1))
    hist = (
        good.select("stratum", *[c for c in labelled.columns if c not in ("stratum", "good")])
        .select("stratum", grid)
        .groupBy("stratum", "g.rule", first.alias("step"))
        .agg(F.count(F.lit(1)).alias("n_here"))
    )
    steps = F.explode(
        F.array(*[
            F.struct(F.lit(r.name).alias("rule"), F.lit(i).alias("step"), F.lit(c).alias("cutoff"))
            for r in rules for i, c in enumerate(r.cutoffs)
        ])
    ).alias("s")
    totals = hist.groupBy("stratum", "rule").agg(F.sum("n_here").alias("n"))
    same = ["stratum", "rule", "step"]
    table = (
        totals.select("stratum", "rule", "n").groupBy("stratum").agg(F.max("n").alias("n"))
        .select("stratum", "n", steps).select("stratum", "n", "s.*").alias("t")
        .join(hist.alias("h"), F.expr(" and ".join(f"t.{c} <=> h.{c}" for c in same)), "left")
        .select("t.*", F.coalesce("h.n_here", F.lit(0)).alias("n_here"))
    )
    so_far = W.partitionBy("stratum", "rule").orderBy("step").rowsBetween(W.unboundedPreceding, 0)
    rejected = table.withColumn("k", F.sum("n_here").over(so_far))
    level = error / (n_strata * len(rules))
    tested = rejected.withColumn("fails", binomial_tail(F.col("n"), F.col("k"), max_rate / len(rules)) > level)
    passed = tested.withColumn("failed", F.max("fails").over(so_far)).where(~F.col("failed"))
    return passed.groupBy("stratum", "rule").agg(F.max_by("cutoff", "step").alias("cutoff"))


def with_verdict(stats: DataFrame, cutoffs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """`stats` (stratum and counts) with `rejected`: some rule's share is above its stratum's cutoff."""
    per = cutoffs.groupBy("stratum").agg(F.map_from_entries(F.collect_list(F.struct("rule", "cutoff"))).alias("_cutoffs"))
    per = per.withColumnRenamed("stratum", "_stratum")
    joined = stats.join(per, F.col("stratum").eqNullSafe(F.col("_stratum")), "left")
    above = [F.coalesce(F.expr(r.share).cast("double") > F.col("_cutoffs")[r.name], F.lit(False)) for r in rules]
    rejected = above[0]
    for a in above[1:]:
        rejected = rejected | a
    return joined.withColumn("rejected", rejected).drop("_stratum", "_cutoffs")


COUNTS = ("n_words", "word_chars", "n_symbols", "n_marks", "n_lines", "n_dup_lines", "n_repeat_words")


def calibrate(counted: DataFrame, labels: DataFrame, **settings) -> DataFrame:
    """Cutoffs from a staged table of doc_id, stratum and counts, and labels (doc_id, quality)."""
    marked = labels.select(labels["doc_id"], (labels["quality"] == 1).alias("good"))
    tested = counted.where(~base_failed(F.col("n_words"), F.col("n_repeat_words"))).join(marked, "doc_id")
    return staged(select_cutoffs(tested.select("stratum", "good", *COUNTS), **settings))


def counted(docs: DataFrame, stratum_col: str = "lang") -> DataFrame:
    """doc_id, stratum and counts of each document. One read of the texts, no shuffle."""
    mine = docs.select(docs["doc_id"], docs["text"], docs[stratum_col].cast("string").alias("stratum"))
    return with_statistics(mine).select("doc_id", "stratum", *[F.col(f"_stats.{c}").alias(c) for c in COUNTS])


def verdicts(docs: DataFrame, labels: DataFrame, stratum_col: str = "lang") -> DataFrame:
    """doc_id, the counts, base_failed and kept of each document.

    NULL and empty texts have no words and fail the base rule. A NULL stratum is a stratum of its own.
    Rows with the same or a NULL doc_id each keep their own row; a repeated label counts again. Without
    labels no rule has a cutoff, and only the base rule rejects. Further columns are ignored.
    """
    stats = staged(counted(docs, stratum_col))
    judged = with_verdict(stats, calibrate(stats, labels))
    failed = base_failed(F.col("n_words"), F.col("n_repeat_words"))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), (~failed & ~F.col("rejected")).alias("kept"), "stratum",
    )


def keep_good(docs: DataFrame, labels: DataFrame, stratum_col: str = "lang") -> DataFrame:
    """The rows of `docs`, all columns, that neither the base rule nor a calibrated rule rejects. Cases as in verdicts."""
    cutoffs = calibrate(staged(counted(docs, stratum_col)), labels)
    inner, rows = unused(docs, "_row", "_r")[0], docs
    packed = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias(inner), docs["text"],
                         docs[stratum_col].cast("string").alias("stratum"))
    stats = with_statistics(packed).select(inner, "stratum", *[F.col(f"_stats.{c}").alias(c) for c in COUNTS])
    judged = with_verdict(stats, cutoffs)
    good = judged.where(~base_failed(F.col("n_words"), F.col("n_repeat_words")) & ~F.col("rejected"))
    return good.select(f"{inner}.*")
