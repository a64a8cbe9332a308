"""SimHash groups, containment search and components against brute force."""

from __future__ import annotations

import random
import re

import numpy as np
import pytest
import xxhash
from pagequarry.llm import components, decontaminate, queries, simhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def fingerprint(text, n=3):
    w = words(text)
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + n]).encode(), 42) for i in range(max(1, len(w) - n + 1))]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def least_reachable(nodes, linked):
    label = {x: x for x in nodes}
    while True:
        new = {x: min(label[y] for y in nodes if linked(x, y)) for x in nodes}
        if new == label:
            return label
        label = new


def test_query_equals_brute_force(spark, sf):
    rows = queries.op6_simhash(spark, sf).collect()
    docs = {r.doc_id: fingerprint(r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    want = least_reachable(list(docs), lambda a, b: (docs[a] ^ docs[b]).bit_count() <= 3)
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in rows} == {d: (f"{f:016x}", want[d]) for d, f in docs.items()}


def test_links_of_planted_fingerprints(spark):
    """Chains of close fingerprints, one large bucket that is cut into blocks, and strangers."""
    rng = random.Random(5)
    base = rng.getrandbits(64)
    fps = {base ^ (1 << i) ^ (1 << j) for i in range(24) for j in range(32)} | {rng.getrandbits(64) for _ in range(200)}
    chain = rng.getrandbits(64)
    for _ in range(30):
        for b in rng.sample(range(64), 3):
            chain ^= 1 << b
        fps.add(chain)
    signed = [int(np.uint64(f).astype(np.int64)) for f in fps]
    table = spark.createDataFrame([(f,) for f in signed], "fp long")
    old, simhash.BUCKET = simhash.BUCKET, 512
    blocks, simhash.BLOCK = simhash.BLOCK, 300
    try:
        found = {r.node: r.component for r in components.components(simhash.links(table)).collect()}
    finally:
        simhash.BUCKET, simhash.BLOCK = old, blocks
    array = np.array(signed, np.int64).view(np.uint64)
    near = np.bitwise_count(array[:, None] ^ array[None, :]) <= 3
    label = np.array(signed)
    while True:
        new = np.array([label[near[i]].min() for i in range(len(label))])
        if (new == label).all():
            break
        label = new
    assert {f: found.get(f, f) for f in signed} == dict(zip(signed, label.tolist(), strict=True))


def test_large_buckets_go_through_blocks(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", 512)
    rng = random.Random(7)
    low = rng.getrandbits(32)
    fps = sorted({(rng.getrandbits(3) << 40) | (rng.getrandbits(12) << 50) | low for _ in range(1500)})
    signed = np.array(fps, np.uint64).view(np.int64).tolist()
    found = {r.node: r.component for r in components.components(simhash.links(spark.createDataFrame([(f,) for f in signed], "fp long"))).collect()}
    array = np.array(fps, np.uint64)
    near = np.bitwise_count(array[:, None] ^ array[None, :]) <= 3
    label = np.array(signed)
    while True:
        new = np.array([label[near[i]].min() for i in range(len(label))])
        if (new == label).all():
            break
        label = new
    assert {f: found.get(f, f) for f in signed} == dict(zip(signed, label.tolist(), strict=True))


def test_odd_documents(odd, empty):
    rows = simhash.near_duplicates(odd).collect()
    assert len(rows) == odd.count()
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, set()).add((r.fingerprint, r.component_id))
    assert by[1] == by[2] and next(iter(by[2]))[1] == 1
    assert {next(iter(by[i])) for i in (3, 4, 5)} == {("0" * 16, 3)}
    assert next(iter(by[None]))[1] is None
    assert simhash.near_duplicates(empty).count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7), (200, 205), (205, 203)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100, 200: 200, 203: 200, 205: 200}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def shingles(text, size=5):
    w = words(text)
    return {" ".join(w[i : i + size]) for i in range(len(w) - size + 1)}


def leaks(docs, items):
    out = []
    for d, t in docs:
        for i, x in items:
            size = min(5, len(words(x)))
            s = shingles(x, size) if size else set()
            both = len(s & shingles(t, size))
            if s and both >= 0.8 * len(s):
                out.append((str(d), str(i), both, len(s)))
    return sorted(out)


def test_leaks_equal_brute_force(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    got = sorted((str(r.doc_id), str(r.item_id), r.n_shared, r.n_item) for r in queries.op10_decontaminate(spark, sf).collect())
    assert got == leaks(docs, items) and got


@pytest.mark.parametrize("limit", [1 << 20, 700])
def test_leaks_of_odd_documents_by_broadcast_and_by_joins(spark, odd, empty, monkeypatch, limit):
    rng = random.Random(3)
    vocabulary = [f"v{i}" for i in range(500)]
    passage = [" ".join(rng.choices(vocabulary, k=n)) for n in (5, 9, 17, 40, 70, 200)]
    hay = lambda p: " ".join(rng.choices(vocabulary, k=4000)) + " " + p + "\n" + " ".join(rng.choices(vocabulary, k=3000))
    changed = passage[4].replace(passage[4].split()[30], "other", 1)
    rows = [(r.doc_id, r.text) for r in odd.collect()] + [(100 + i, hay(p)) for i, p in enumerate(passage)] + [(200, hay(changed)), (201, passage[3].upper())]
    items = list(enumerate(passage)) + [(50, "the quick brown"), (51, ""), (52, None), (53, "word"), (54, "lazy DOG."), (3, passage[3]), (None, passage[2])]
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", limit)
    table, asked = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = sorted((str(r.doc_id), str(r.item_id), r.n_shared, r.n_item) for r in decontaminate.find_leaks(table, asked).collect())
    assert got == leaks(rows, items)
    assert {"100", "101", "102", "103", "104", "105", "200", "201", "1", "2", "9"} == {g[0] for g in got}
    assert decontaminate.find_leaks(empty, asked).count() == 0
    assert decontaminate.find_leaks(odd, spark.createDataFrame([], "item_id long, text string")).count() == 0
    kept = decontaminate.without_leaks(odd, asked)
    assert kept.columns == odd.columns and kept.count() == odd.count() - len({1, 2, 9}) - 1


def test_short_items_are_found_inside_long_documents(spark):
    docs = spark.createDataFrame([(1, "kilo lima mike november oscar papa quebec"), (2, "lima november mike"), (3, "Lima mike")], "doc_id long, text string")
    items = spark.createDataFrame([(7, "lima mike november"), (8, "lima mike"), (9, "papa quebec romeo")], "item_id long, text string")
    assert sorted((r.doc_id, r.item_id) for r in decontaminate.find_leaks(docs, items).collect()) == [(1, 7), (1, 8), (3, 8)]
