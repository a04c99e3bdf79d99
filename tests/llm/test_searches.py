"""Vector near duplicates, ranked search and collocations against brute-force versions, odd cases included."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from lorekeep.llm import collocations, lexical, multiindex

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = "doc_id long, text string, lang string, source string, n int, fp string, item string, score int"


@pytest.fixture(scope="module")
def odd(spark):
    """NULLs in every column, empty and long texts, repeated rows and ids, ties, names that operators use themselves."""
    rng = random.Random(8)
    words = ["the", "Of", "ä", "naïve", "x1", "***", "a", "tree", "日本", "it's", "İ", "ſ", "of"]
    texts = [None, "", " \t", "...", "one", "One two", "a, b a. a b"]
    texts += [rng.choice([" ", "  ", "\t"]).join(rng.choice(words) + rng.choice(["", "", "", ",", ".\n", "\r"]) for _ in range(rng.randint(5, 60))) for _ in range(60)]
    texts += ["the tree of a tree " * 900, "long" * 3000 + " the tree, the tree", texts[20], texts[20], texts[20]]
    rows = [(i, t, ["en", "de", None, "und"][i % 4], None, 1, "f", "i", 7) for i, t in enumerate(texts)]
    rows += [rows[9], rows[9], (9, "another the tree", None, None, None, None, None, None), (None, "the tree", "en", "s", 1, "f", "i", 7),
             (None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, DOCS).repartition(3).cache()


def brute_collocations(rows, least, most=5, per_lang=2000):
    n, f = Counter(), defaultdict(Counter)
    for r in rows:
        lang = r.lang if r.lang is not None else "und"
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (r.text or "").translate(UPPER)):
            ws = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(ws)
            f[lang].update(" ".join(ws[i : i + k]) for k in range(1, most + 1) for i in range(len(ws) - k + 1))
    out = []
    for lang, counts in f.items():
        often = {p: c for p, c in counts.items() if c >= least}
        found = []
        for p, a in often.items():
            ws = p.split(" ")
            if len(ws) < 2 or any(100 * b >= 100 * a for q, b in often.items() if len(q) > len(p) and f" {p} " in f" {q} "):
                continue
            cuts = [(counts[" ".join(ws[:k])], counts[" ".join(ws[k:])], k) for k in range(1, len(ws))]
            score, _, left, right = min((1000 * a * n[lang] // (x * y), k, x, y) for x, y, k in cuts)
            found.append((-score, -a, p.encode(), left, right))
        for rank, (s, a, p, x, y) in enumerate(sorted(found)[:per_lang], 1):
            out.append((lang, rank, p.decode(), -a, x, y, n[lang], -s))
    return sorted(out)


def test_collocations(spark, odd):
    want = brute_collocations(odd.collect(), 4)
    assert len(want) > 100 and {w[0] for w in want} == {"en", "de", "und"}
    assert sorted(map(tuple, collocations.collocations(odd, least=4).collect())) == want
    # Slices of a few words, fingerprints that collide all the time, a bitmap that is full.
    poor = collocations.collocations(odd, least=4, slice_bytes=40, print_bits=3, most_bits=10)
    assert sorted(map(tuple, poor.collect())) == want
    few = brute_collocations(odd.collect(), 4, most=3, per_lang=5)
    assert sorted(map(tuple, collocations.collocations(odd, least=4, most_words=3, per_lang=5).collect())) == few
    assert collocations.collocations(odd.limit(0)).columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert collocations.collocations(odd.limit(0)).count() == 0 == collocations.collocations(odd, least=10**6).count()


def test_collocations_of_a_very_long_text(spark):
    rng = random.Random(3)
    text = " ".join(rng.choice(["w%d" % i for i in range(40)]) for _ in range(400_000))
    rows = spark.createDataFrame([(1, text, "en")], "doc_id int, text string, lang string")
    got = sorted(map(tuple, collocations.frequent_phrases(rows, least=300, most_words=3, slice_bytes=1 << 18).collect()), key=repr)
    ws, want = text.split(" "), Counter()
    for k in (1, 2, 3):
        want.update(" ".join(ws[i : i + k]) for i in range(len(ws) - k + 1))
    assert got == sorted([("en", p, c) for p, c in want.items() if c >= 300] + [("en", None, len(ws))], key=repr)


def test_counts_of_runs_travel_in_blocks():
    import pyarrow as pa

    text = " ".join("w%d" % (i % 50_000) for i in range(120_000))
    batch = pa.RecordBatch.from_pydict({"lang": ["en"], "text": [text]})
    rows = [r for b in collocations._counter(2, None, 1 << 19, 64, 6)(iter([batch])) for r in b.to_pylist()]
    assert len(rows) <= 64 and {r["part"] for r in rows} == set(range(64))
    merge, found = collocations._frequent(3, 6), []
    for part in range(64):
        blocks = pa.Table.from_pylist([{k: r[k] for k in ("codes", "counts")} for r in rows if r["part"] == part])
        found += merge((pa.scalar(part),), blocks)["fp"].to_pylist()
    assert len(set(found)) == len(found) == 19_999  # the runs of the third round


def test_word_ids_tell_colliding_words_apart():
    import pyarrow as pa

    texts = ["alpha beta alpha gamma", "x" * 100 + "a " + "x" * 100 + "b " + "x" * 100 + "a"]
    (words,) = collocations.words_of(pa.array(texts), bits=1)
    ids = collocations._word_ids(words)
    names = [words.phrase(i, 1) for i in range(len(ids))]
    assert all((ids[i] == ids[j]) == (names[i] == names[j]) for i in range(len(ids)) for j in range(len(ids)))


def brute_ranking(docs, items, top=20):
    terms = [TERM.findall((d.text or "").translate(UPPER)) for d in docs]
    n, total = sum(1 for t in terms if t), sum(map(len, terms))
    df = Counter(t for ts in terms for t in set(ts))
    out = []
    for item, text in {(i.item_id, i.text) for i in items}:
        scores = []
        asked = TERM.findall((text or "").translate(UPPER))
        for d, ts in zip(docs, terms):
            tf, m = Counter(ts), 75 + 25 * len(ts) * n // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * tf[t] // (1000 * tf[t] + 12 * m)) for t in asked if tf[t])
            if s > 0:
                scores.append((-s, d.doc_id is None, d.doc_id or 0, d.doc_id))
        out += [(item, r, d, -s) for r, (s, _, _, d) in enumerate(sorted(scores)[:top], 1)]
    return sorted(out, key=repr)


def test_ranked_search(spark, odd, monkeypatch):
    many = " ".join(f"term{i}" for i in range(150)) + " the tree ä the"
    items = [(1, "The tree of"), (2, "日本 naïve x1 x1"), (3, many), (4, None), (5, ""), (6, "nothing known here"), (7, "a"), (7, "tree"), (7, "tree"), (None, "it's")]
    asked = spark.createDataFrame(items, "item_id long, text string").withColumnRenamed("item_id", "item_id")
    want = brute_ranking(odd.collect(), asked.collect())
    assert len(want) > 80
    assert sorted(map(tuple, lexical.ranked(odd, asked).collect()), key=repr) == want
    assert sorted(map(tuple, lexical.ranked(odd, asked, top=2).collect()), key=repr) == brute_ranking(odd.collect(), asked.collect(), 2)
    for name, value in (("BLOCK_ITEMS", 2), ("BLOCK_TERMS", 20), ("BLOCK_CELLS", 64), ("SLICE_BYTES", 16)):
        monkeypatch.setattr(lexical, name, value)
    assert sorted(map(tuple, lexical.ranked(odd, asked).collect()), key=repr) == want
    assert lexical.ranked(odd.limit(0), asked).count() == 0 == lexical.ranked(odd, asked.limit(0)).count()
    text_ids = odd.selectExpr("cast(doc_id as string) as doc_id", "text")
    assert lexical.ranked(text_ids, asked).schema["doc_id"].dataType.simpleString() == "string"


def test_masks_leave_most_documents_unweighed():
    rng = np.random.default_rng(4)
    docs, terms = 4000, 12
    tfs = rng.integers(0, 3, (docs, terms)) * (rng.random((docs, terms)) < 0.3)
    rows, cols = np.nonzero(tfs)
    search = lexical.BlockSearch([(np.arange(terms), np.ones(terms, np.int64))], rng.integers(1000, 9000, terms), docs, docs * 20, 20)
    ids = list(range(docs))
    search.add(ids, np.arange(docs), np.full(docs, 20), rows, cols, tfs[rows, cols])
    share = np.zeros((docs, terms), np.int64)
    share[rows, cols] = 10**9 * tfs[rows, cols] // (1000 * tfs[rows, cols] + 12 * 100)
    scores = share @ search.weights
    want = sorted(((-s, i) for i, s in enumerate(scores.tolist()) if s), key=lambda x: x)[:20]
    assert search.best[0] == [(-s, i) for s, i in want]
    assert search.weighed < docs / 4


def brute_vectors(rows, least=0.98):
    good = [i for i, r in enumerate(rows) if r.vec_id is not None and r.label is not None and r.embedding
            and all(x is not None and math.isfinite(x) for x in r.embedding) and any(r.embedding)]
    links = defaultdict(set)
    for i in good:
        for j in good:
            a, b = rows[i].embedding, rows[j].embedding
            if i != j and rows[i].label == rows[j].label and len(a) == len(b):
                a, b = np.array(a) / np.abs(a).max(), np.array(b) / np.abs(b).max()
                if a @ b / math.sqrt((a @ a) * (b @ b)) >= least:
                    links[i].add(j)
    out = []
    for i, r in enumerate(rows):
        seen, todo = {i}, [i]
        while todo:
            new = links[todo.pop()] - seen
            seen |= new
            todo += new
        component = min((rows[j].vec_id for j in seen), default=None) if r.vec_id is not None else None
        out.append((r.vec_id, len(links[i]), component, r.vec_id is not None and r.vec_id == component))
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(6)
    rows = []
    for g in range(30):
        centre = rng.normal(size=8)
        for _ in range(rng.integers(1, 12)):
            rows.append((centre + rng.normal(size=8) * rng.choice([0.02, 0.06, 0.3])).tolist())
    rows += [rows[3], rows[3], rows[3], [0.0] * 8, None, [], [1.0, None] + [0.0] * 6, [math.nan] * 8, [math.inf] * 8, [1e-200] + [0.0] * 7, [1e200] + [0.0] * 7,
             [1.0, -0.0, 2.0], [1.0, 0.0, 2.0], [5.0], [2.0], [-1.0]]
    out = [(100 - i, v, i % 2 if i % 17 else None, "x", 3, "c") for i, v in enumerate(rows)]
    out += [(7, rows[0], 0, "x", 3, "c"), (7, rows[40], 0, None, None, None), (None, rows[0], 0, None, None, None)]
    return spark.createDataFrame(out, "vec_id long, embedding array<double>, label int, class string, cell int, v string").repartition(3).cache()


def test_vectors_that_nearly_agree(spark, vectors):
    want = brute_vectors(vectors.collect())
    assert sum(w[1] for w in want) > 50
    for tuning in ({"words": 3, "block_rows": 4}, {"words": 1}, {"words": 8}):
        assert sorted(map(tuple, multiindex.linked_vectors(vectors, recall=1, **tuning).collect()), key=repr) == want
    # The sample is the whole table and has few links, so the measured reach finds all of them too.
    unique = vectors.where("vec_id is not null and vec_id <> 7")
    assert sorted(map(tuple, multiindex.linked_vectors(unique).collect()), key=repr) == brute_vectors(unique.collect())
    empty = multiindex.linked_vectors(vectors.limit(0))
    assert empty.columns == ["vec_id", "n_links", "component_id", "kept"] and empty.count() == 0


def test_walks_reach_every_cell_that_can_hold_a_link():
    rng = np.random.default_rng(9)
    x = rng.normal(size=(3000, 16))
    near = x + rng.normal(size=x.shape) * 0.04
    a, b = x / np.linalg.norm(x, axis=1)[:, None], near / np.linalg.norm(near, axis=1)[:, None]
    linked = np.flatnonzero((a * b).sum(axis=1) >= 0.98)
    for recall, least_found, most_cells in ((1, 1.0, 1.0), (0.99, 0.985, 0.5)):
        grid = multiindex.fit_grid(x, 8, recall=recall)
        visits, cells = grid.visits(a), grid.cells(b)
        found = np.mean([cells[i] in visits[i] for i in linked])
        assert found >= least_found and np.mean([len(v) for v in visits]) <= most_cells * 64
        ways_a, ways_b = grid.bounds(a[:50])
        for i, v in enumerate(visits[:50]):  # nearest first
            ways = ways_a[i, v // len(grid.second)] + ways_b[i, v % len(grid.second)]
            assert (np.diff(ways) >= 0).all() and v[0] == grid.cells(a[i : i + 1])[0]
