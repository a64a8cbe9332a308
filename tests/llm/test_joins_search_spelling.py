"""Jaccard join by groups, ranked search by term owners and spelling variants against brute force."""

from __future__ import annotations

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pagequarry.llm import interpolation, jaccard_groups, queries, ranked_search, spelling

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LETTERS = re.compile("[A-Za-zÀ-ÿ]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


# Sets of shingles


def shingles(text):
    w = WORD.findall(lower(text))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def joined(rows):
    """Sorted (id, size, component) of all pairs."""
    sets = [shingles(t) for _, t in rows]
    by = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            by[x].append(i)
    label = list(range(len(rows)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i, s in enumerate(sets):
        both = Counter(j for x in s for j in by[x] if j < i)
        for j, c in both.items():
            if 100 * c >= 80 * (len(s) + len(sets[j]) - c):
                label[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(d, least.get(root(i), d))
    return sorted(((d, len(s), least.get(root(i))) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True))), key=str)


def of(spark, rows):
    found = jaccard_groups.similar_sets(spark.createDataFrame(rows, "doc_id long, text string"))
    return sorted((tuple(r) for r in found.collect()), key=str)


def test_jaccard_query_equals_brute_force(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = sorted((tuple(r) for r in queries.op11_jaccard_groups(spark, sf).collect()), key=str)
    assert got == joined(rows)
    assert sum(a != c for a, _, c in got) > 10


def planted(rng):
    vocabulary = [f"v{i}" for i in range(3000)]
    words = lambda n: rng.choices(vocabulary, k=n)
    rows = []

    def edited(base, edits):
        out = list(base)
        for at in rng.sample(range(len(out)), edits):
            out[at] = rng.choice(vocabulary)
        return out

    base, loose, passage = words(120), words(60), words(90)
    rows += [edited(base, rng.randint(0, 4)) for _ in range(60)]  # a large group of near copies, most linked to each other
    rows += [edited(loose, 2) for _ in range(40)]  # linked only now and then
    rows += [passage + words(rng.randint(8, 40)) for _ in range(40)]  # one long passage in all, near the limit
    chain = words(150)
    for _ in range(25):
        chain = chain[3:] + words(3)
        rows.append(chain)
    rows += [words(n) for n in (1, 2, 3, 4, 4, 5, 6)] + [rows[3], rows[3], rows[-4]]
    return [(i * 7 % 1009, " ".join(w)) for i, w in enumerate(rows)]


@pytest.mark.parametrize(("part", "asked"), [(256, 2048), (4, 3)])
def test_planted_groups(spark, monkeypatch, part, asked):
    monkeypatch.setattr(jaccard_groups, "PART", part)
    monkeypatch.setattr(jaccard_groups, "QUERIES", asked)
    rows = planted(random.Random(11))
    assert of(spark, rows) == joined(rows)


def test_groups_of_odd_documents(spark, odd, empty):
    rows = [(r.doc_id, r.text) for r in odd.collect()] + [(None, "w0 w1 w2 w3 w4 w5"), (None, "W0 w1  w2 w3 w4 w5"), (40, "word"), (41, "WORD\t")]
    assert of(spark, rows) == joined(rows)
    got = jaccard_groups.similar_sets(odd)
    assert got.columns == ["doc_id", "n_shingles", "component_id"] and got.count() == odd.count()
    assert jaccard_groups.similar_sets(empty).count() == 0


def test_overlap_of_links_is_bounded():
    for a in range(1, 60):
        for b in range(1, 60):
            least = next(c for c in range(0, 200) if 100 * c >= 80 * (a + b - c))
            assert jaccard_groups.least_overlap(a, b) == least


# Search


def ranked(docs, items, top=20):
    terms = [(d, Counter(TERM.findall(lower(t)))) for d, t in docs]
    n = {i: sum(c.values()) for i, (_, c) in enumerate(terms)}
    documents, total = sum(x > 0 for x in n.values()), sum(n.values())
    df = Counter(t for _, c in terms for t in c)
    out = []
    for item, text in items:
        asked, scores = Counter(TERM.findall(lower(text))), []
        for i, (d, c) in enumerate(terms):
            score = 0
            for t, times in asked.items():
                if c[t]:
                    w = math.floor(1000 * math.log((2 * documents + 2) / (2 * df[t] + 1)))
                    score += times * w * ((1_000_000_000 * c[t]) // (1000 * c[t] + 12 * (75 + 25 * n[i] * documents // total)))
            if score > 0:
                scores.append((-score, d is None, d))
        out += [(item, rank + 1, d, -s) for rank, (s, _, d) in enumerate(sorted(scores, key=lambda x: (x[0], x[1], x[2] or 0))[:top])]
    return sorted(out, key=str)


@pytest.mark.parametrize(("docs_of_block", "items_of_bundle"), [(8192, 256), (70, 7)])
def test_search_equals_brute_force(spark, sf, monkeypatch, docs_of_block, items_of_bundle):
    monkeypatch.setattr(ranked_search, "BLOCK_DOCS", docs_of_block)
    monkeypatch.setattr(ranked_search, "BUNDLE", items_of_bundle)
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    got = sorted((tuple(r) for r in queries.op12_ranked_search(spark, sf).collect()), key=str)
    assert got == ranked(docs, items)


def test_search_of_odd_documents(spark, odd, empty):
    docs = [(r.doc_id, r.text) for r in odd.collect()] + [(None, "fox fox"), (None, "lazy fox"), (77, "日本語のテキスト"), (78, "x1y x-1 Été ÉTÉ été")]
    items = [(1, "The quick fox, the LAZY dog."), (2, ""), (3, None), (4, "!!"), (5, "nowhere"), (6, "日本語のテキスト"), (7, "w1 w2 w3 w3"), (1, "fox"), (None, "x1y été")]
    table, asked = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = sorted((tuple(r) for r in ranked_search.search(table, asked, top=3).collect()), key=str)
    assert got == ranked(docs, items, top=3) and {r[0] for r in got} == {1, 6, 7, None}
    none = spark.createDataFrame([], "item_id long, text string")
    assert [ranked_search.search(empty, asked).count(), ranked_search.search(odd, none).count()] == [0, 0]
    assert ranked_search.search(odd, odd.withColumnRenamed("doc_id", "item_id")).columns == ["item_id", "rank", "doc_id", "score"]


def test_middle_of_huge_corpora():
    n = np.array([1, 10**9], np.int32)
    assert ranked_search._middle(n, 3 * 10**10, 10**13).tolist() == [75, 75 + 25 * 10**9 * 3 * 10**10 // 10**13]


# Spelling


def variants(rows):
    counts = Counter()
    for i, text in rows:
        for run in LETTERS.findall(text or ""):
            run = lower(run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}
    lacking, near = defaultdict(set), defaultdict(set)
    for w in words:
        for i in range(len(w)):
            lacking[i, w[:i] + w[i + 1 :]].add(w)
    for (_, shorter), own in lacking.items():
        for w in own:
            near[w] |= own - {w}
            if shorter in words:
                near[w].add(shorter)
                near[shorter].add(w)
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda v: (-words[v], v), default=None)
        form[w] = best if best and words[best] >= 2 * n else None
    out = set()
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, n, len(near[w]), words[form[w]] if form[w] else None))
    return out


def test_variants_equal_brute_force(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    want = variants(rows)
    assert {tuple(r) for r in queries.op13_spelling(spark, sf).collect()} == want
    assert any(root != form for _, form, root, *_ in want if form)


def test_variants_of_odd_words(spark, odd, empty, monkeypatch):
    monkeypatch.setattr(spelling, "WORDS_KEPT", 40)
    long = "a" * 70 + "bcd" * 40
    words = [long, long + "x", long[:50] + "q" + long[51:], long[:63], long[:64], long[:65], "z" * 200, "z" * 201, "z" * 199 + "y", "é" * 40_000, "é" * 39_999]
    chain = ["abcdef"] * 4 + ["abcdeg"] * 10 + ["abcdhg"] * 24 + ["abcihg"] * 60 + ["boook"] * 3 + ["booook"] * 7 + ["bo×ok", "bo÷ok", "BO×OK"] * 2 + ["booksĀ", "books5books"]
    rows = [(r.doc_id, r.text) for r in odd.collect()] + [(i, " ".join(words)) for i in range(100, 104)] + [(200 + i, w) for i, w in enumerate(chain)] + [(None, "WÖRTER wörter wörtern wörtern wörtern"), (None, "wörter"), (300, None)]
    got = [tuple(r) for r in spelling.variants(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert len(got) == len(set(got)) and set(got) == variants(rows)
    by = {r[0]: r for r in got}
    assert by["abcdef"][2] == "abcihg" and by["z" * 199 + "y"][4] == 1
    assert spelling.variants(empty).count() == 0 and spelling.variants(odd).columns == ["word", "form", "root", "n", "n_near", "form_n"]


def test_repeated_letters_count_once(spark):
    rows = [(i, "booook boook") for i in range(5)]
    assert {(r.word, r.n_near) for r in spelling.variants(spark.createDataFrame(rows, "doc_id long, text string")).collect()} == {("booook", 1), ("boook", 1)}


def test_sums_of_language_counts_pass_32_bits():
    """Three blocks that hold a word 2 ** 31 times each."""
    import pyarrow as pa

    key, count = interpolation.packed(np.array([5], np.uint64)), interpolation.packed(np.array([1 << 31], np.uint32))
    rows = {"level": [1] * 3, "bucket": [0] * 3, "block": [0, 1, 2], "part": [0] * 3, "keys": [key] * 3, "counts": [count] * 3}
    out = interpolation._sum(pa.table({k: pa.array(v, {"level": pa.int32(), "bucket": pa.int32(), "part": pa.int32(), "block": pa.int64()}.get(k, pa.binary())) for k, v in rows.items()}))
    assert sum(out.column("n_counted").to_pylist()) == 3 << 31
    words, _ = interpolation._answers(out.slice(0, 1))
    assert words[0].tolist() == [3 << 31]
