"""Each operator against a brute-force version, on small tables with the odd cases in them."""

import gzip
import hashlib
import io
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lorekeep.llm import archives, bpe, counts, jaccard, licences, mixing, neighbours, quality, repeats, rules
from lorekeep.llm.queries import BYTE_BPE

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LONG = "ab" * 400 + "x" * 700
DOCS = "doc_id long, text string, lang string, source string, n_chars long, o int, runs string, size string, row int"


@pytest.fixture(scope="module")
def odd(spark):
    """NULLs in every column, empty and long texts, repeated rows, repeated ids, names that operators use themselves."""
    rng = random.Random(5)
    words = ["the", "Of", "ä", "naïve", "x1", "***", "a", "tree", "日本", "it's"]
    base = " ".join(rng.choice(words) for _ in range(120))
    texts = [None, "", " \n\t ", "one", "One", "a b c d", base, base + " end", "start " + base, base.upper(), LONG, LONG + "y",
             "\n".join(["same line here"] * 9), " ".join(rng.choice(words) for _ in range(300))]
    texts += [base[:200] + " ".join(rng.choice(words) for _ in range(30)) for _ in range(6)]
    rows = [(i, t, ["en", "de", None][i % 3], ["s1", "s2", None, "s3"][i % 4], None, 1, "r", "z", 7) for i, t in enumerate(texts)]
    rows += [rows[6], rows[6], (7, "another text of the id seven", "en", "s1", 3, None, None, None, None),
             (None, base, "en", None, 5, 1, "r", "z", 7), (None, None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, DOCS).repartition(3).cache()


def collected(df):
    return [r.asDict() for r in df.collect()]


def test_bpe_matches_the_library_and_round_trips(spark, odd):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(BYTE_BPE)
    want = Counter()
    for r in odd.collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        want[r.doc_id, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(),
             hashlib.sha256(text.encode()).hexdigest()] += 1
    for block in (1 << 16, 64):
        got = Counter(tuple(r) for r in bpe.round_trip_digests(odd, BYTE_BPE, block_chars=block).collect())
        assert got == want
    assert bpe.encode(odd.limit(0), BYTE_BPE).count() == 0


def test_bpe_halves_join_exactly():
    rng = random.Random(2)
    library = bpe._library(BYTE_BPE)
    for alphabet in ("ab", "ab ", " a\n", "'s a", "aé ñ1", " \n\ta", "12a.'", "日本 aé", "<|endoftxt>", "aaaaab"):
        for _ in range(60):
            text = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 400)))
            want = library.encode(text, add_special_tokens=False).ids
            blocks = bpe.cut_blocks(text, rng.choice([16, 50, 120]))
            parts = [bpe.encode_text(t, BYTE_BPE) for t, _ in blocks]
            tree = bpe.join_tree([(p, c) for p, (_, c) in zip(parts, blocks)], BYTE_BPE)
            assert tree == want
            whole = parts[0]
            for p, (_, clean) in zip(parts[1:], blocks[1:]):
                whole = whole + p if clean else bpe.join_encodings(whole, p, BYTE_BPE, window=4)
            assert whole == want


def shingles(text):
    low = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    w = WORD.findall(low)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) > 4 else {tuple(w)} if w else set()


def brute_components(rows):
    sets, comp = [shingles(t) for _, t in rows], list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                old, new = comp[i], comp[j]
                comp = [new if c == old else c for c in comp]
    least = defaultdict(list)
    for c, (i, _) in zip(comp, rows):
        if i is not None:
            least[c].append(i)
    return [(i, len(s), min(least[c]) if least[c] else None) for (i, _), s, c in zip(rows, sets, comp)]


def test_jaccard_components(spark, odd):
    rng = random.Random(3)
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    words = [f"w{i}" for i in range(400)]
    for k in range(12):
        base = [rng.choice(words) for _ in range(rng.choice([6, 7, 9, 12, 16, 60, 150]))]
        for _ in range(5):
            copy = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 20))):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            rows.append((100 + len(rows), " ".join(copy + [rng.choice(words)] * rng.randint(0, 2))))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.linked_components(docs).collect())
    assert got == Counter(brute_components(rows))
    assert jaccard.linked_components(docs.limit(0)).count() == 0
    left = jaccard.one_of_each(odd)
    assert left.columns == odd.columns
    kept = [r.text for r in left.collect()]
    assert sum(t is not None and "start" not in t and "naïve" in t for t in kept) >= 1 and kept.count(None) == 2


@pytest.mark.parametrize("n", [1, 4, 5, 9, 10, 12])
def test_subset_sizes(n):
    for m in jaccard.partners(n):
        k = jaccard.linked_size(n, m)
        assert 100 * k >= 80 * (n + m - k) and 100 * (k - 1) < 80 * (n + m - k + 1)
    assert jaccard.choose_boundary({3: 10, 200: 5}) >= 3


def without_earlier(rows):
    """The digests of texts without strings of 100 bytes that start earlier, by a set of all such strings."""
    seen, want = set(), []
    for i, text in rows:
        data, covered = (text or "").encode(), set()
        for s in range(len(data) - 99):
            if data[s : s + 100] in seen:
                covered.update(range(s, s + 100))
            seen.add(data[s : s + 100])
        kept = bytes(b for k, b in enumerate(data) if k not in covered)
        spans = sum(k - 1 not in covered for k in covered)
        want.append((i, len(data), len(covered), spans, hashlib.sha256(kept).hexdigest()))
    return want


def test_repeated_strings(spark, odd):
    rng = random.Random(4)
    passage = "".join(rng.choice("abcé ") for _ in range(180))
    rows = [(i, "".join(rng.choice("xyz ") for _ in range(rng.randint(0, 150))) + (passage[: rng.randint(90, 180)] if i % 2 else "")
             + "q" * rng.choice([0, 99, 100, 101, 260])) for i in range(40)] + [(90, None), (91, ""), (92, passage * 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert sorted(tuple(r) for r in repeats.removal_digests(docs).collect()) == sorted(without_earlier(rows))
    out = repeats.without_repeats(odd)
    assert out.columns == odd.columns and out.count() == odd.count()
    assert repeats.removal_digests(docs.limit(0)).count() == 0
    same = spark.createDataFrame([(1, passage), (1, passage), (None, passage)], "doc_id long, text string")
    assert sorted(r.n_removed for r in repeats.removal_digests(same).collect()) == [0] + [len(passage.encode())] * 2


def test_repeats_around_frequent_anchors(spark, monkeypatch):
    for name, value in {"GROUP_UNITS": 5, "SEEN": 2, "PLACE_UNITS": 1, "PLACES": 2, "FLUSH": 4000, "UNITS_HELD": 50}.items():
        monkeypatch.setattr(repeats, name, value)
    by_spark, passes = [], repeats._ordered_by_spark
    monkeypatch.setattr(repeats, "_ordered_by_spark", lambda *given: by_spark.append(given) or passes(*given))
    rng = random.Random(9)
    word = lambda n: "".join(rng.choice("uvwxyzé ") for _ in range(n))
    hot, other = word(230), word(160)
    rows = []
    for i in range(90):
        cut = rng.randint(0, 60)
        rows.append((i, word(rng.randint(0, 90)) + hot[cut : cut + rng.randint(95, 170)] + word(rng.randint(0, 90)) + (other if i % 7 == 0 else "")))
    rows += [(200, hot * 3), (201, None), (202, "aaaa" * 100), (203, hot[:99])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert sorted(tuple(r) for r in repeats.removal_digests(docs).collect()) == sorted(without_earlier(rows))
    assert by_spark


def test_repeats_in_a_long_text(spark):
    rng = random.Random(10)
    long = "".join(rng.choice("abcdefgh ") for _ in range(300_000))
    rows = [(1, long[131_000:131_150]), (2, long[:131_080] + long[500:900] + long[131_080:]), (3, long[250_000:])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted(tuple(r) for r in repeats.removal_digests(docs).collect()) == sorted(without_earlier(rows))


def test_radix_passes_find_what_sorting_finds():
    rng = np.random.default_rng(1)
    data = rng.integers(97, 99, 3000).astype(np.uint8)
    data[1500:2200] = data[100:800]
    starts = np.arange(len(data) - 100)
    got = repeats.repeated_windows(data, starts, np.zeros(len(starts), np.int64), starts)
    seen, want = set(), []
    for s in starts.tolist():
        w = data[s : s + 100].tobytes()
        want += [s] if w in seen else []
        seen.add(w)
    assert got.tolist() == want


def test_quality_counts(odd):
    for r in collected(rules.counted(odd.select("doc_id", "text", "lang"))):
        pass
    texts = {(r.doc_id, r.text): r for r in odd.collect()}
    got = rules.with_statistics(odd).select("doc_id", "text", "_stats.*").collect()
    assert len(got) == odd.count()
    for r in got:
        text = texts[r.doc_id, r.text].text or ""
        w = WORD.findall(text)
        windows = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        covered = {i + k for i in range(len(w) - 7) if windows[tuple(w[i : i + 8])] > 1 for k in range(8)}
        lines = [x for x in text.split("\n") if WORD.search(x)]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (
            len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered))


def test_binomial_tail_is_exact(spark):
    cases = [(50, 0), (600, 1), (2000, 9), (20000, 150), (300000, 2800)]
    df = spark.createDataFrame(cases, "n long, k long")
    for r in df.select("n", "k", rules.binomial_tail(F.col("n"), F.col("k"), 0.01).alias("p")).collect():
        logs = [math.lgamma(r.n + 1) - math.lgamma(i + 1) - math.lgamma(r.n - i + 1) + i * math.log(0.01) + (r.n - i) * math.log(0.99)
                for i in range(r.k + 1)]
        assert r.p == pytest.approx(math.fsum(map(math.exp, logs)), rel=1e-6)


def test_rules_reject_junk_only_where_labels_vouch(spark):
    good = " ".join(f"word{i}" for i in range(40))
    rows = [(i, good if i % 4 else " ".join(f"w{j}***" for j in range(40)), "en") for i in range(6000)]
    docs = spark.createDataFrame([*rows, (9001, good, "xx"), (9002, "few", "en"), (9003, None, None)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, int(i % 4 > 0)) for i in range(6000)], "doc_id long, quality int")
    by = {(r.base_failed, r.kept): r["count"] for r in rules.verdicts(docs, labels).groupBy("base_failed", "kept").count().collect()}
    assert by == {(False, True): 4501, (False, False): 1500, (True, False): 2}
    assert rules.keep_good(docs, labels).count() == 4501
    assert rules.verdicts(docs, labels.limit(0)).where("not kept").count() == 2
    assert rules.verdicts(docs.limit(0), labels).count() == 0


def test_licences(spark):
    docs = spark.createDataFrame(
        [(1, "Some text.\nReleased under the MIT License."), (2, "RELEASED under -- the mit license"), (3, None), (4, ""),
         (5, "Released under a license of our own making which is long"), (None, "Licensed under the Apache License, Version 2.0.")],
        "doc_id long, text string")
    got = {(r.doc_id, r.line, r.licence) for r in licences.licence_matches(docs).where("dice = 1").collect()}
    assert got == {(1, 2, "MIT"), (2, 1, "MIT"), (None, 1, "Apache-2.0")}
    assert licences.licence_matches(docs.limit(0)).count() == 0


def test_notice_lines_of_documents_name_their_licence(spark):
    # Written by hand: the notice lines that occur in documents, and the forms of the Creative Commons licences.
    want = {
        "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0",
        "All rights reserved.": "All-rights-reserved",
        "Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0",
        "Released under the MIT License.": "MIT",
        "Licensed under the Apache License, Version 2.0.": "Apache-2.0",
        "Licensed under CC BY 4.0.": "CC-BY-4.0",
        "CC BY-SA 4.0": "CC-BY-SA-4.0",
        "This work is licensed under CC BY-ND 4.0": "CC-BY-ND-4.0",
        "This work is licensed under CC BY-NC 4.0": "CC-BY-NC-4.0",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.": "CC-BY-NC-4.0",
        "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.": "CC-BY-ND-4.0",
        "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.": "CC-BY-NC-SA-4.0",
        "Licensed under CC BY-NC-ND 4.0.": "CC-BY-NC-ND-4.0",
    }
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select(F.explode(F.split("text", "\n")).alias("x"))
    seen = docs.where(F.length("x") < 200).where(F.col("x").rlike("(?i)licen[cs]e|rights reserved|creative commons|copyright|CC BY"))
    lines = {r.x for r in seen.distinct().collect()}
    assert lines and lines <= set(want)
    units = spark.createDataFrame([(i, x) for i, x in enumerate(want)], "doc_id long, text string")
    best = {}
    for r in licences.licence_matches(units).collect():
        best.setdefault(r.doc_id, []).append((r.dice, r.licence))
    for i, (line, licence) in enumerate(want.items()):
        top = max(d for d, _ in best[i])
        names = {n.removesuffix("-short").removesuffix("-work").removesuffix("-name") for d, n in best[i] if d == top}
        assert names == {licence}, line


def test_a_notice_names_one_licence(spark):
    gpl = "This work is licensed under the GNU General Public License, version 3."
    mit = licences.TEMPLATES["MIT-notice"]
    rows = [(1, f"A text.\n{gpl}", 9), (2, f"{gpl}\nAnd more.\nLicensed under CC BY-NC 4.0.", 9), (3, gpl, None), (3, "Released under the MIT License.", 9),
            (None, gpl, 9), (None, "All rights reserved.", 9), (4, None, 9), (5, "", 9), (6, gpl, 9), (6, gpl, 9), (7, "GNU Affero " + gpl, 9),
            (8, "Some words before " * 10 + mit[:60] + "\n" + mit[60:] + " and some words after", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, line int").withColumnRenamed("line", "dice")
    got = sorted(((r.doc_id, r.line, r.licence) for r in licences.licences_found(docs).collect()), key=repr)
    want = [(1, 2, "GPL-3.0"), (2, 1, "GPL-3.0"), (2, 3, "CC-BY-NC-4.0"), (3, 1, "GPL-3.0"), (3, 1, "MIT"), (None, 1, "GPL-3.0"),
            (None, 1, "All-rights-reserved"), (6, 1, "GPL-3.0"), (7, 1, "GPL-3.0"), (8, 1, "MIT")]
    assert got == sorted(want, key=repr)
    assert licences.licences_found(docs.limit(0)).count() == 0
    plan = licences.licence_matches(docs)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoopJoin" not in plan and "CartesianProduct" not in plan


def test_licence_texts_wrapped_in_longer_documents(spark):
    import textwrap

    from lorekeep.llm.licence_texts import TEXTS

    prose = "\n".join(" ".join(f"word{i * 9 + j}" for j in range(9)) for i in range(30))

    def at_78(text: str, mark: str = "") -> str:
        return "\n".join(mark + x for x in textwrap.wrap(text, 78))

    docs = [
        (1, f"{prose}\n{at_78(TEXTS['MIT-text'])}\n{prose}", 31, "MIT-text"),
        (2, TEXTS["MIT-permission"], 1, "MIT-permission"),
        (3, f"{prose}\n{at_78(TEXTS['GPL-3.0-header'], '# ')}\n{prose}", 31, "GPL-3.0-header"),
        (4, f"{prose}\n\n{at_78(TEXTS['BSD-3-Clause-text'], ' * ')}\n{prose}", 32, "BSD-3-Clause-text"),
        (5, f"{prose} this text is Licensed under CC BY-NC 4.0. and {prose}", 30, "CC-BY-NC-4.0-short"),
        (6, open("/usr/share/common-licenses/GPL-3").read(), 1, "GPL-3.0-title"),
        (7, f"{prose}\n{at_78(TEXTS['MIT-permission'])}\n{prose}\n{at_78(TEXTS['MIT-permission'])}", 31, "MIT-permission"),
        (8, f"{prose} 12 by 4.0 rights reserved {prose}", None, None),
    ]
    table = spark.createDataFrame([d[:2] for d in docs] + [(9, None), (9, "")], "doc_id long, text string")
    got = {}
    for r in licences.licence_matches(table).collect():
        got.setdefault(r.doc_id, []).append((r.dice, r.line, r.licence))
    for i, _, line, licence in docs:
        if licence is None:
            assert i not in got
            continue
        assert (line, licence) in {x[1:] for x in got[i] if x[0] > 0.9}, (i, got[i])
    assert sorted(x[1] for x in got[7] if x[2] == "MIT-permission") == [31, 31 + 30 + len(at_78(TEXTS["MIT-permission"]).split("\n"))]
    assert 9 not in got


def test_section_counts(odd):
    from tokenizers import Tokenizer

    library, want = Tokenizer.from_file(BYTE_BPE), Counter()
    for r in odd.collect():
        text = r.text or ""
        spans = library.encode(text, add_special_tokens=False).offsets
        ends = np.cumsum([len(x) + 1 for x in text.split("\n")])
        ends[-1] -= 1
        for k, (a, b) in enumerate(zip([0, *ends[:-1]], ends)):
            want[r.doc_id, k, int(a), int(b), sum(a <= s < b for s, _ in spans)] += 1
    assert Counter(tuple(r) for r in counts.section_counts(odd, BYTE_BPE).collect()) == want
    a, b = np.array([0, 3]), np.array([4, 9])
    assert counts.allocate(a, np.array([3, 8]), np.array([0, 4]), np.array([4, 9]), "most").tolist() == [1, 1]
    assert counts.allocate(a, np.array([3, 8]), np.array([0, 4]), np.array([4, 9]), "start").tolist() == [2, 0]


def test_quality_scores_hold_out(spark):
    rng = random.Random(1)
    rows, labels = [], []
    for i in range(900):
        bad = rng.random() < 0.3
        words = [rng.choice(["tree", "of", "river", "stone"]) + ("!!" if bad else "") for _ in range(rng.randint(20, 80))]
        rows.append((i, " ".join(words).upper() if bad else " ".join(words)))
        labels.append((i, int(not bad)))
    docs = spark.createDataFrame([*rows, (None, None), (2000, "")], "doc_id long, text string")
    marked = spark.createDataFrame(labels, "doc_id long, quality int")
    out = {r.doc_id: r for r in quality.quality_scores(docs, marked).collect()}
    truth = dict(labels)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in out.values())
    held = [i for i in truth if zlib.crc32(str(i).encode()) % 3 == 1]
    assert all(out[i].held_out == (i in set(held)) for i in truth)
    assert np.mean([out[i].predicted == truth[i] for i in held]) > 0.95
    assert quality.quality_scores(docs, marked.limit(0)).where("score = 0.5").count() == docs.count()


def test_isotonic_rises():
    x, y = neighbours_free_isotonic()
    assert (np.diff(y) > 0).all() and (np.diff(x) > 0).all()


def neighbours_free_isotonic():
    return quality.isotonic(np.arange(6.0), np.array([0, 1, 0, 1, 1, 0.5]), np.ones(6))


def test_mix_keeps_both_totals(spark, odd):
    rng = random.Random(8)
    rows = [(i, rng.randint(1, 400), ["a", "b", "c", "d", None][min(4, i % 9)]) for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, size long, source string")
    out = mixing.take_copies(docs, block_rows=128).collect()
    assert len(out) == 3000 and all(0 <= r.copies <= 2 for r in out)
    for source in {r[2] for r in rows}:
        mine = [r for r in out if r.source == source]
        assert abs(sum(r.size * r.copies for r in mine) - mine[0].target) <= 800
    again = mixing.take_copies(docs.repartition(7), block_rows=128).collect()
    assert {(r.doc_id, r.copies) for r in out} == {(r.doc_id, r.copies) for r in again}
    sizes = Counter()
    for _, n, s in rows:
        sizes[s] += n
    order = sorted((s for s in sizes if s is not None)) + [None]
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    capped, left = {}, 1.5 * sum(sizes.values())
    while True:
        free = [s for s in order if s not in capped]
        over = {s for s in free if left * weight[s] / sum(weight[t] for t in free) > 2 * sizes[s]}
        if not over:
            break
        for s in over:
            capped[s] = 2 * sizes[s]
            left -= capped[s]
    for r in out:
        total = sum(weight[t] for t in order if t not in capped)
        assert r.target == pytest.approx(capped.get(r.source, left * weight[r.source] / total))
    assert mixing.mixed(odd).count() == odd.count() and mixing.mixed(odd.limit(0)).count() == 0
    assert mixing.repeated(odd).columns == odd.columns


def test_flight_keeps_totals():
    rng = np.random.default_rng(0)
    p, size = rng.random(200), rng.integers(1, 50, 200).astype(float)
    out = mixing.cube_flight(p, size, 1)
    assert ((out == 0) | (out == 1)).sum() >= 198
    assert out.sum() == pytest.approx(p.sum()) and out @ size == pytest.approx(p @ size)


def test_archives_round_trip(spark, tmp_path):
    big = "x" * 1500
    rows = [(1, "http://a/ b", big), (2, None, big), (3, "http://c", "small"), (4, "http://d", "small"), (5, "http://e", None),
            (6, "http://f", "ü\r\n\r\nWARC/1.1\r\n" + big), (None, "http://g", big), (2, None, big)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    out = archives.pages_through_archives(spark, pages, str(tmp_path)).collect()
    assert len(out) == len(rows)
    got = Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in out)
    digest = lambda t: (len((t or "").encode()), hashlib.sha1((t or "").encode()).hexdigest())
    want = Counter((i, *digest(t), "response", None) for i, _, t in rows[2:6])
    want.update([(2, *digest(big), "response", None), (2, *digest(big), "revisit", 2), (1, *digest(big), "revisit", 2),
                 (None, *digest(big), "revisit", 2)])
    assert got == want and all(r.verified in (True, None) for r in out)


def test_arc_versions_and_lengths():
    two = archives.ARC_FIELDS[2]
    about = f"2 0 x\n{two}\n".encode()
    body = b"HTTP/1.0 200 OK\r\n\r\nhi\nhttp://no 1 2 3 4\n"
    raw = b"filedesc://f.arc 0.0.0.0 19970101000000 text/plain 200 - - 0 - %d\n" % len(about) + about
    raw += b"\nhttp://a b 1.2.3.4 19970203 text/html 200 abc - 0 f.arc %d\n" % len(body) + body + b"\n"
    found = list(archives.read_arc(io.BytesIO(gzip.decompress(gzip.compress(raw)))))
    assert [(r.version, r.fields["URL"], r.block) for r in found] == [(2, "http://a b", body)]
    assert archives.warc_date("19970203") == "1997-02-03T00:00:00Z" and archives.split_http(body)[1].startswith(b"hi")


def test_nearest(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(3000, 16)).astype(np.float32)
    x[7], x[8] = x[50], 2 * x[50]
    rows = [(i, [float(a) for a in v]) for i, v in enumerate(x)]
    rows += [(4000, None), (4001, [0.0] * 16), (4002, [float("nan")] * 16), (4003, [None] * 16), (None, [1.0] * 16), (4050, [1.0, 2.0])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    out = collected(neighbours.nearest(vectors, lambda i: i % 50 == 0))
    unit = x / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    hits = 0
    for q in range(0, 3000, 50):
        score = unit @ unit[q]
        score[q] = -2
        hits += len({r["vec_id"] for r in out if r["query_id"] == q} & set(np.argsort(-score)[:5].tolist()))
    assert hits >= 0.9 * 5 * 60 and len(out) == 300
    assert [r["vec_id"] for r in sorted(out, key=lambda r: r["rank"]) if r["query_id"] == 50][:2] == [7, 8]
    assert neighbours.nearest(vectors.limit(0), lambda i: i % 50 == 0).count() == 0
    few = vectors.where("vec_id in (0, 1, 2)")
    assert [(r["query_id"], r["rank"]) for r in collected(neighbours.nearest(few, lambda i: i % 50 == 0))] == [(0, 1), (0, 2)]


def test_nearest_in_blocks(spark):
    """Blocks and copies change nothing; ids of other types, rows alike and clashing columns do not matter."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(1500, 12))
    x[100:400] = x[100]  # one vector many times
    rows = [(i, str(i), [float(a) for a in v], 1, 2) for i, v in enumerate(x)]
    vectors = spark.createDataFrame(rows + rows[:3], "vec_id smallint, name string, embedding array<double>, part int, probes int")
    asks = lambda i: i.cast("int") % 50 == 0
    whole = collected(neighbours.nearest(vectors, asks))
    split = collected(neighbours.nearest(vectors, asks, block_rows=40, query_rows=3))
    by_name = collected(neighbours.nearest(vectors, asks, id_col="name"))
    line = lambda out: sorted((int(r["query_id"]), r["rank"], int(r["vec_id"]), r["score"]) for r in out)
    assert line(whole) == line(split) and len(whole) == 150
    assert [r[2] for r in line(whole) if r[0] == 150] == [100, 101, 102, 103, 104]
    assert [r[2] for r in line(by_name) if r[0] == 150] == [100, 101, 102, 103, 104] and len(by_name) == 150  # another sample


def test_best_in_block():
    """The k best of the parts that a query probes, against all pairs."""
    rng = np.random.default_rng(6)
    there, asked = (neighbours._unit(rng.normal(size=(n, 8))) for n in (90, 20))
    part, ids, own = np.sort(rng.integers(0, 6, 90)), rng.permutation(90), np.arange(20)
    there[3:9] = there[3]
    probes = [rng.permutation(6)[: rng.integers(1, 6)] for _ in own]
    q, c, score = neighbours.best_in_block(asked, own, probes, there, ids, part, 4)
    for i in own:
        near = [(-float(neighbours.exact_pairs(asked[i : i + 1], there[j : j + 1])[0]), ids[j]) for j in range(90) if part[j] in probes[i] and ids[j] != i]
        assert [(-s, ids[j]) for j, s in zip(c[q == i], score[q == i])] == sorted(near)[:4]


def test_parts_and_bundles():
    assert [neighbours.parts_for(n) for n in (0, 96, 191, 192, 51_282, 10**9)] == [1, 1, 1, 2, 512, 512]
    assert neighbours.blocks_of({0: 3, 1: 4, 2: 30, 4: 2}, 5, 10) == ([0, 0, 1, 2, 2], [1, 3, 1])
