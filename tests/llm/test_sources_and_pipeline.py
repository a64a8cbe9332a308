"""License scans, source mixing and the pipeline."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from itertools import combinations

import corpus_pipeline
import pytest
from pagequarry.llm import jaccard_groups, license_texts, licenses, mixing, queries, simhash
from pyspark.sql import functions as F


def uniform(*parts):
    return int(hashlib.md5(":".join(parts).encode()).hexdigest()[:13], 16) / 2**52


def draw(rate, doc_id):
    pieces = max(1, math.ceil(rate / 16))
    r, total = rate / pieces, 0
    for j in range(1, pieces + 1):
        u, term, c, k = uniform("copies", "2024", str(doc_id), str(j)), math.exp(-rate / pieces), 0.0, 0
        for k in range(80):
            term = math.exp(-r) if k == 0 else term * r / k
            c += term
            total += c <= u
    return total


def test_mix_equals_brute_force(spark, sf):
    docs = [(r.doc_id, r.source) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    n = Counter(s for _, s in docs)
    want = Counter({(d, i): 1 for d, s in docs for i in range(1, draw(len(docs) / (len(n) * n[s]), d) + 1)})
    got = queries.op8_source_mix(spark, sf)
    assert Counter((r.doc_id, r.copy_no) for r in got.select("doc_id", "copy_no").collect()) == want


def test_mix_reaches_weights_and_shuffles(spark):
    docs = spark.range(6000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 100 == 0, "rare").when(F.col("id") % 2 == 0, "b").otherwise("a").alias("source"), F.lit("t").alias("text"))
    rows = mixing.mix(docs, weights={"rare": 2.0, "a": 1.0, "b": 1.0}).collect()
    n = Counter(r.source for r in rows)
    assert 0.9 < n["rare"] / 3000 < 1.1 and 0.9 < n["a"] / 1500 < 1.1
    assert [r.doc_id for r in rows] != sorted(r.doc_id for r in rows)
    assert mixing.mix(docs, weights={"a": 1.0}).where("source <> 'a'").count() == 0


def test_mix_of_odd_documents(odd, empty):
    out = mixing.mix(odd.withColumn("copy_no", F.lit("clash")))
    assert set(out.columns) == {*odd.columns, "copy_no", "mix_key"} and dict(out.dtypes)["copy_no"] == "int"
    assert out.count() >= 0 and mixing.mix(empty).count() == 0


def words_of(text):
    return [x for x in re.split(r"[\W_]+", text.lower()) if x]


def brute_license(texts, text, whole=False):
    """The own licence of a text among ``texts`` by comparing every unit with every template."""
    n, df = len(texts), Counter(t for x in texts for t in set(words_of(x or "")))
    vec = lambda x: {t: (1 + math.log(k)) * (math.log(min(licenses.RARE, (1 + n) / (1 + df[t]))) + 1) for t, k in Counter(words_of(x)).items()}
    size = lambda v: math.sqrt(sum(x * x for x in v.values()))
    if not text:
        return None
    tag = re.search(licenses.SPDX, text)
    if tag:
        return (0, 0, -1.0, tag[1])
    lines = text.split("\n")
    head = next((i for i, x in enumerate(lines) if not re.search(licenses.COMMENT, x)), len(lines))
    units = {*lines, *re.split(licenses.SENTENCE, text), *re.split(licenses.PARAGRAPH, text), "\n".join(lines[:head]), text if whole else ""}
    found = []
    for name, shared, template in license_texts.templates():
        b = vec(template)
        for unit in units:
            a = vec(unit)
            cosine = round(sum(v * b.get(t, 0) for t, v in a.items()) / size(a) / size(b), 9) if a else 0
            if cosine >= licenses.SIMILARITY:
                found.append((1, shared, -cosine, name))
    return min(found, default=None)


MIT, BSD3 = license_texts.TEXTS["MIT"], license_texts.TEXTS["BSD-3-Clause"]
FILES = [
    (1, "p/LICENSE", license_texts.TEXTS["Apache-2.0"]), (2, "p/a/x.txt", "nothing"), (3, "p/a/b/y.txt", "text\nDistributed under the MIT License, as is.\nmore"),
    (4, "p/a/b/LICENSE", "Preamble that says little.\n\n" + license_texts.TEXTS["GPL-3.0"] + "\n\nEnd of terms."), (5, "p/a/b/c/z.txt", "z"), (6, "q/z.txt", "z"), (7, None, "Licensed under CC BY-NC 4.0."),
    (8, "p/a/b/w.txt", None), (9, "LICENSE-x/f.txt", "licensed fishing in this lake is a matter of the public authority"), (6, "q/z.txt", "z"),
    (10, "r/COPYING", "Copyright (c) 2020 Jane Doe\n\n" + MIT), (11, "r/s/a.py", "# Copyright 2021 X\n#\n# " + BSD3.replace("\n", "\n# ") + "\nimport os\n"),
    (12, "r/s/b.c", "int main() {}"), (13, "s/one.txt", "An aside. Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: none"),
    (14, "s/two.c", "// SPDX-License-Identifier: EPL-2.0\nint x;"), (15, "s/three.txt", "SPDX is a list of names, and Foo License is none of them"), (16, "s/three.txt", ""), (2, "p/a/x.txt", MIT.split("\n\n")[0]),
]
FILE_SCHEMA = "doc_id long, path string, text string"


def test_licenses_equal_brute_force(spark):
    rows = licenses.scan(spark.createDataFrame(FILES, FILE_SCHEMA).withColumn("own_license", F.lit("clash"))).collect()
    texts = [t for _, _, t in FILES]
    want = Counter()
    for i, path, text in FILES:
        best = brute_license(texts, text, bool(path and re.search("(^|/)(LICENSE|COPYING)[^/]*$", path)))
        want[i, path, best and best[3], best and -best[2]] += 1
    assert Counter((r.doc_id, r.path, r.own_license, r.cosine) for r in rows) == want


def test_licenses_of_headers_files_and_folders(spark):
    rows = licenses.scan(spark.createDataFrame(FILES, FILE_SCHEMA)).collect()
    assert len(rows) == len(FILES)
    got = {r.doc_id: (r.license, r.origin, r.from_folder) for r in rows if r.doc_id != 2}
    assert got[1][0] == "Apache-2.0" and got[3][:2] == ("MIT", "own") and got[4][:2] == ("GPL-3.0", "own") and got[5] == ("GPL-3.0", "inherited", "p/a/b")
    assert got[6] == (None, "none", None) and got[7][:2] == ("CC-BY-NC-4.0", "own") and got[8] == ("GPL-3.0", "inherited", "p/a/b")
    assert got[9][1] == "none" and got[10][:2] == ("MIT", "own") and got[11][:2] == ("BSD-3-Clause", "own") and got[12] == ("MIT", "inherited", "r")
    assert got[13][:2] == ("BSD-2-Clause", "own"), "a paragraph of several licences names the first"
    assert got[14][:2] == ("EPL-2.0", "own") and got[15][1] == "none" and got[16][1] == "none"
    twice = [(r.license, r.origin) for r in rows if r.doc_id == 2]
    assert sorted(twice) == [("Apache-2.0", "inherited"), ("MIT", "own")], "rows with equal id and path keep their own texts' licences"


def test_license_terms_are_weighed_by_their_frequency(spark):
    """A word that all headers carry costs no header its licence, however large the corpus; a rare one weighs by its frequency."""
    header, other, named = "Distributed and Released under the MIT License.", "license for something else altogether", "Released under the MIT License by zyx."
    for n in (8, 200, 5000):
        text = F.when(F.col("id") == 0, named).when(F.col("id") % 4 < 3, header).otherwise(other)
        files = spark.range(n).select(F.col("id").alias("doc_id"), F.lit(None).cast("string").alias("path"), text.alias("text"))
        rows = [r for r in licenses.scan(files).where("own_license is not null").collect() if r.doc_id]
        assert len(rows) == n * 3 // 4 - 1 and {r.own_license for r in rows} == {"MIT"}
        texts = [named] + [header] * (n * 3 // 4 - 1) + [other] * (n // 4)
        assert {r.cosine for r in rows} == {-brute_license(texts, header)[2]}


def test_license_tables_beyond_the_broadcast(spark):
    texts = spark.createDataFrame([(str(i), t, i % 2 == 0) for i, (_, _, t) in enumerate(FILES)], "__digest string, __text string, __whole boolean")
    found = [sorted(map(tuple, licenses.similarity(texts, license_texts.templates(), limit).collect())) for limit in (1, 10_000)]
    assert found[0] == found[1] and len(found[0]) > 5


def test_license_query_covers_all_documents(spark, sf, odd, empty):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = queries.op5_licenses(spark, sf).collect()
    assert sorted(r.doc_id for r in rows) == sorted(r.doc_id for r in docs.select("doc_id").collect())
    with_path = lambda d: d.withColumn("path", licenses.tree_path(F.col("doc_id")))
    assert licenses.scan(with_path(odd)).count() == odd.count()
    assert licenses.scan(with_path(empty)).count() == 0


def test_pipeline_stages_take_effect(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    stages = dict(corpus_pipeline.STAGES)
    good = stages["quality classifier"](spark, docs, sf).cache()
    kept = {r.doc_id for r in good.select("doc_id").collect()}
    assert good.columns == docs.columns
    bad = [d for d, q in labels.items() if q == 0]
    assert sum(d in kept for d in bad) <= 0.05 * len(bad) and sum(d in kept for d, q in labels.items() if q) >= 0.98 * sum(labels.values())
    one = stages["simhash near-dedup"](spark, good, sf).cache()
    texts = {r.text for r in one.select("text").collect()}
    assert one.count() == len(texts)
    # All pairs by brute force: texts with five words in common are compared whole.
    sets = {t: frozenset(zip(*(t.lower().split()[i:] for i in range(5)), strict=False)) for t in {r.text for r in good.select("text").collect()}}
    owners = {}
    for t, x in sets.items():
        for shingle in x:
            owners.setdefault(shingle, []).append(t)
    shared = Counter(pair for own in owners.values() if len(own) < 50 for pair in combinations(sorted(own), 2))
    near = [p for p, n in shared.items() if n >= 0.8 * len(sets[p[0]] | sets[p[1]])]
    assert len(near) > 3 and sum(not (a in texts and b in texts) for a, b in near) >= 0.9 * len(near)
    close = {t for p, n in shared.items() if n >= 0.7 * len(sets[p[0]] | sets[p[1]]) for t in p}
    alone = {t for t in sets if t not in close}
    fps = {t: simhash.fingerprint(t.encode().lower().split(), 3) for t in alone}
    apart = [t for t in alone if not any((fps[t] ^ f).bit_count() <= 3 for u, f in fps.items() if u != t)]
    assert set(apart) <= texts, "texts without a near copy stay"
    clean = stages["benchmark decontamination"](spark, one, sf).cache()
    leaked = {r.doc_id for r in queries.op10_decontaminate(spark, sf).collect()}
    assert {r.doc_id for r in clean.select("doc_id").collect()} == {r.doc_id for r in one.select("doc_id").collect()} - leaked
    mixed = stages["source mixing"](spark, clean, sf).cache()
    assert mixed.columns == docs.columns
    files = stages["token-id files"](spark, mixed, sf)
    assert sorted(r.doc_id for r in files.collect()) == sorted(r.doc_id for r in mixed.select("doc_id").collect())


@pytest.mark.parametrize("table", ["odd", "empty"])
def test_the_whole_pipeline_runs(spark, sf, tmp_path, request, table):
    docs = request.getfixturevalue(table)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{sf}/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    kept = {r.doc_id for r in docs.collect()}
    assert {r.doc_id for r in rows} <= kept and (rows or table == "empty")
    assert all(r.n_tokens >= 1 for r in rows) and [r.start for r in sorted(rows, key=lambda r: r.start)][:1] in ([0], [])


def test_pipeline_of_odd_documents(spark, odd, empty, sf):
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, odd, sf)
        assert name == "token-id files" or out.columns == odd.columns
        assert stage(spark, empty, sf).count() == 0
    ids = [r.doc_id for r in corpus_pipeline.distinct_documents(spark, odd, sf).collect()]
    assert ids.count(1) == 1 and 2 not in ids and ids.count(None) == 1


def test_pipeline_rows_with_null_and_repeated_ids(spark, odd, sf):
    """Each row stays or goes by its own text: neither a null id keeps a row nor a repeated id takes another text with it."""
    passage = max((r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()), key=len)
    a, b, c = (" ".join(f"{w}{i}" for i in range(60)) for w in ("amber", "birch", "cedar"))
    near = a.replace("amber", "Amber")
    table = lambda rows: spark.createDataFrame([(i, t, "en", "s", None, None, None, None) for i, t in rows], odd.schema)
    left = lambda stage, rows: Counter((r.doc_id, r.text) for r in stage(spark, table(rows), sf).collect())
    leaky = [(None, f"{a} {passage}"), (None, b), (5, f"{a} {passage}"), (5, b), (6, c), (6, c)]
    assert left(corpus_pipeline.unleaked_documents, leaky) == Counter([(None, b), (5, b), (6, c), (6, c)])
    assert left(corpus_pipeline.distinct_documents, [(3, a), (5, a), (5, b)]) == Counter([(3, a), (5, b)])
    assert left(corpus_pipeline.distinct_documents, [(None, near), (3, a), (None, b), (None, b), (7, c), (7, c)]) == Counter([(3, a), (None, b), (7, c)])


def test_pipeline_keeps_columns_named_like_its_own(spark, odd, sf):
    names = ("__row_number", "_row", "row", "node", "__u", "__copies", "__pieces", "copy_no", "mix_key", "__gone", "component", "id", "digest", "doc")
    own = odd.withColumns({n: F.concat(F.lit(f"{n}-"), F.coalesce("text", F.lit(""))) for n in names})
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, own, sf)
        assert out.columns == own.columns, name
        rows = out.select(*(f"`{n}`" for n in names), "text").collect()
        assert rows and all(r[n] == f"{n}-{r.text or ''}" for r in rows for n in names), name


def test_near_copies_beside_weaker_links_are_found(spark):
    """Ten texts that share most of a page, four pairs of which are near copies: the links between pairs are too weak, those within them aren't."""
    import random

    rng = random.Random(4)
    vocabulary = [f"v{i}" for i in range(4000)]
    page = rng.choices(vocabulary, k=300)
    texts = []
    for i in range(10):
        base = page + rng.choices(vocabulary, k=60) if i % 2 == 0 or i >= 8 else list(texts[-1])
        if i % 2 and i < 8:
            base[310] = f"changed{i}"
        texts.append(base)
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in jaccard_groups.similar_sets(docs).collect()} == {0: 0, 1: 0, 2: 2, 3: 2, 4: 4, 5: 4, 6: 6, 7: 6, 8: 8, 9: 9}
