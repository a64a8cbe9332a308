"""Language-model scores, language identification, quality rules, media columns."""

from __future__ import annotations

import hashlib
import zlib
from collections import Counter

import numpy as np
import pytest
from pagequarry.llm import interpolation, language, media, quality, queries
from pyspark.sql import functions as F


def test_lm_base_scores_and_gain(spark, sf):
    docs = {r.doc_id: r.text.encode().lower().split() + [b" "] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    fold = {d: zlib.crc32(str(d).encode()) % 10 for d in docs}
    c = Counter(w for d, t in docs.items() if fold[d] for w in t)
    n, v = sum(c.values()), len(c)
    rows = queries.op1_lm_scores(spark, sf).collect()
    assert len(rows) == len(docs)
    for r in rows:
        t = docs[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (fold[r.doc_id] == 0, len(t), sum(w in c for w in t), n)
        assert r.base_score == pytest.approx(sum(np.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t), rel=1e-9)
    held = [r for r in rows if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_lm_scores_by_hand(spark):
    """Scores of a small corpus recomputed with dictionaries from the learned weights."""
    texts = [(i, f"a b c a b {'d' if i % 3 else 'e f'} a") for i in range(60)]
    seen = {}
    old = interpolation.learn
    try:
        interpolation.learn = lambda rows: seen.setdefault("w", old(rows))
        rows = {r.doc_id: r for r in interpolation.score_documents(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    finally:
        interpolation.learn = old
    uni, bi = Counter(), Counter()
    token = {i: t.split() + ["$"] for i, t in texts}
    for i, t in token.items():
        if zlib.crc32(str(i).encode()) % 10:
            uni.update(t)
            bi.update(zip(["$", *t], t, strict=False))
    n, v = sum(uni.values()), len(uni)
    for i, t in token.items():
        total = 0.0
        for h, w in zip(["$", *t], t, strict=False):
            k = 1 + int(np.log2(uni[h])) if uni[h] else 0
            l2, l1, l0 = seen["w"][k]
            total += np.log10(l2 * (bi[h, w] / uni[h] if uni[h] else 0) + l1 * uni[w] / n + l0 / (v + 1))
        assert rows[i].score == pytest.approx(total, rel=1e-9)


def test_em_finds_the_mixture():
    rng = np.random.default_rng(1)
    good, bad = 50.0, 0.01
    rows = [{"class": 3, "n": 1000.0, "x2": 1000.0 * (good if rng.random() < 0.7 else bad), "x1": 1000.0 * 1.0} for _ in range(400)]
    w = interpolation.learn(rows)
    assert np.allclose(w.sum(1), 1) and 0.6 < w[3][0] < 0.8


def test_lm_odd_documents(odd, empty):
    rows = interpolation.score_documents(odd).collect()
    assert len(rows) == odd.count() and all(np.isfinite(r.score) for r in rows)
    assert {r.n_tokens for r in rows if r.doc_id in (3, 4, 5)} == {1}
    assert interpolation.score_documents(empty).count() == 0


def test_language(spark, sf, odd, empty):
    want = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = queries.op3_language(spark, sf).collect()
    held = [r for r in rows if r.held_out]
    assert {r.doc_id: r.held_out for r in rows} == {d: zlib.crc32(str(d).encode()) % 4 == 2 for d in want}
    assert sum(want[r.doc_id] == r.lang_pred for r in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in rows)
    found = language.identify(odd).collect()
    assert len(found) == odd.count()
    assert {r.lang_pred for r in found if r.doc_id in (3, 4, 5, 10)} == {"und"}
    assert language.identify(empty).count() == 0


def plain_counts(text):
    """Damped counts of hashed letter n-grams by plain loops."""
    words = "".join(c.lower()[0] if c.isalpha() else " " for c in text).split()
    if not words:
        return None
    padded, out = " " + " ".join(words) + " ", np.zeros(language.DIMENSIONS)
    for n in language.ORDERS:
        for i in range(len(padded) - n + 1):
            h = n
            for c in padded[i : i + n]:
                h = (h ^ ord(c)) * 0x9E3779B97F4A7C15 % 2**64
            out[h >> 52] += 1
    return np.log1p(out)


def test_language_equals_brute_force(spark, sf, monkeypatch):
    """Every text against every centroid by plain loops."""
    models, real = [], language.fit
    monkeypatch.setattr(language, "fit", lambda *a, **k: models.append(real(*a, **k)) or models[-1])
    docs = spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").limit(60)
    rows = {r.doc_id: r for r in language.identify(docs).collect()}
    (model,) = models
    for d in docs.collect():
        v = plain_counts(d.text)
        if v is None:
            assert (rows[d.doc_id].lang_pred, rows[d.doc_id].score, rows[d.doc_id].rejected) == ("und", 0.0, True)
            continue
        v = v * model.idf
        cosines = [float(v @ c) / np.linalg.norm(v) for c in model.centres]
        k = max(range(len(cosines)), key=lambda i: cosines[i])
        assert rows[d.doc_id].score == pytest.approx(cosines[k], abs=2e-3)
        near = [model.labels[i] for i, c in enumerate(cosines) if c > cosines[k] - 1e-4]
        assert rows[d.doc_id].lang_pred in near
        if abs(cosines[k] - model.limits[k]) > 1e-3:
            assert rows[d.doc_id].rejected == (cosines[k] < model.limits[k])


def test_language_rejects_and_breaks_ties(spark):
    texts = {"aa": "the quick brown fox jumps over the lazy dog again", "bb": "der schnelle braune fuchs springt immer wieder"}
    rows = [(i, texts[k] + f" {'x' * (i % 3)}", k, "s") for i, k in enumerate(("aa", "bb") * 40)] + [(200, "qzj wvk xqz jjq zzk", None, "s"), (201, texts["aa"], None, "s")]
    found = {r.doc_id: r for r in language.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert found[200].rejected and not found[201].rejected and found[201].lang_pred == "aa"
    same = [(i, "one text for both languages", "cc" if i % 2 else "ab", "s") for i in range(40)]
    twins = language.identify(spark.createDataFrame(same, "doc_id long, text string, lang string, source string")).collect()
    assert {r.lang_pred for r in twins} == {"ab"}, "ties go to the first language in alphabetical order"
    clash = spark.createDataFrame([(*r, 1.0, True) for r in rows], "doc_id long, text string, lang string, source string, score double, rejected boolean")
    assert language.identify(clash).count() == len(rows)


def test_samples_are_bounded_over_all_labels(spark):
    docs = spark.range(20_000).select("id", (F.col("id") % 40).cast("string").alias("lang"))
    assert 700 < language.sample(docs, "lang", 1500, total=1000).count() < 1300
    assert language.sample(docs, "lang", 10_000).count() == 20_000


def test_samples_are_drawn_by_rows(spark):
    """Null ids, one id, and one text: rows are drawn one by one."""
    for same in (F.lit(None).cast("long"), F.lit(7).cast("long")):
        docs = spark.range(30_000).select(same.alias("id"), F.lit("one text").alias("text"), F.when(F.col("id") % 10 < 8, "en").otherwise("fr").alias("lang"))
        drawn = {r.lang: r["count"] for r in language.sample(docs, "lang", 1500).groupBy("lang").count().collect()}
        assert set(drawn) == {"en", "fr"} and all(1300 < n < 1700 for n in drawn.values())


def test_dirty_labels_keep_the_frequent_languages(spark, monkeypatch):
    docs = spark.range(30_000).select("id", F.when(F.col("id") < 20_000, F.concat(F.lit("l"), F.col("id"))).when(F.col("id") < 28_000, "en").otherwise("fr").alias("lang"))
    monkeypatch.setattr(language, "LABELS", 300)
    drawn = {r.lang: r["count"] for r in language.sample(docs, "lang", 1500, total=12_000).groupBy("lang").count().collect()}
    assert {"en", "fr"} <= set(drawn) and len(drawn) <= 300 and sum(drawn.values()) < 1000


def test_languages_without_ids(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select(F.lit(None).cast("long").alias("doc_id"), "text", "lang", "source")
    many = docs.unionByName(docs).unionByName(docs).unionByName(docs)
    found = language.identify(many, bound=60).groupBy("lang_pred").count().collect()
    assert {r.lang_pred for r in found} >= {"en", "fr", "de", "es"}


def test_centroids_find_clusters():
    rng = np.random.default_rng(2)
    hubs = language.scaled(rng.normal(size=(3, 20)))
    rows = language.scaled(np.repeat(hubs, 50, axis=0) + 0.05 * rng.normal(size=(150, 20)))
    centres = language.centroids(rows, clusters=3)
    assert (hubs @ centres.T).max(1).min() > 0.98
    assert len(language.centroids(np.ones((5, 4)) / 2, clusters=3)) == 1


def test_quality(spark, sf, odd, empty):
    labels = {r.doc_id: r.quality for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    rows = queries.op9_quality(spark, "/root/testdata/sf0.01").collect()
    held = [r for r in rows if r.held_out and r.doc_id in labels]
    assert sum(labels[r.doc_id] == r.predicted for r in held) >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
    few = spark.createDataFrame([(1, 1, None), (2, None, 0), (None, 0, 1), (1, 0, 0)], "doc_id long, quality int, toxic int")
    assert quality.score_quality(odd, few).count() == odd.count()
    assert quality.score_quality(empty, few).count() == 0
    kept = quality.keep_good(odd, few.limit(0))
    assert kept.columns == odd.columns and kept.count() == odd.count()


def plain_statistics(text):
    """The statistics by plain loops over characters and words."""
    words, n = text.split(), max(1, len(text))
    per, letters = max(1, len(words)), max(1, sum(chr(b).isascii() and chr(b).isalpha() for b in text))
    low, count = text.lower().split(), lambda chars: sum(b in chars for b in text)
    symbols = [c for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in ".,;:'\"!?-()|"]
    marked = sum(not w[-1:].isalnum() and w[-1] < 128 and chr(w[-1]) not in ".,;:'\"?-)" for w in words)
    return (
        np.log1p(len(text)), np.log1p(len(words)), sum(map(len, words)) / per, max(map(len, words), default=0), len(set(low)) / per, count(range(65, 91)) / letters, count(range(48, 58)) / n, count(symbols) / n,
        count(range(128, 256)) / n, count(b"\n") / per, count(b"|") / per, count(b"!") / per, marked / per, sum(a == b for a, b in zip(low, low[1:], strict=False)) / per, count(b".?") / per,
    )


def test_quality_equals_brute_force(spark, sf, monkeypatch):
    """Every text's score by a loop over the fitted rules."""
    fitted, real = [], quality.fit
    monkeypatch.setattr(quality, "fit", lambda *a, **k: fitted.append(real(*a, **k)) or fitted[-1])
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    few = docs.orderBy("doc_id").limit(80)
    rows = {r.doc_id: r for r in quality.score_quality(docs, labels).join(few.select("doc_id"), "doc_id", "left_semi").collect()}
    (rules,) = fitted
    assert rules.rules
    for d in few.collect():
        x = plain_statistics(d.text.encode())
        total = rules.intercept + sum(w for rule, w in zip(rules.rules, rules.weights, strict=True) if all((x[t.statistic] > t.value) == t.above for t in rule))
        assert rows[d.doc_id].score == pytest.approx(1 / (1 + np.exp(-total)), abs=1e-9)
        assert rows[d.doc_id].predicted == int(rows[d.doc_id].score >= 0.3)


def test_a_statistic_equal_to_a_rules_value_is_below_it(spark):
    rules = quality.Rules([(quality.Test(0, False, 0.5),), (quality.Test(0, True, 0.5),)], [2.0, -3.0], 0.0)
    row = spark.createDataFrame([(0.5,) + (0.0,) * (len(quality.COLUMNS) - 1)], quality.COLUMNS).select(rules.column().alias("s")).first()
    assert row.s == pytest.approx(1 / (1 + np.exp(-2.0)))


def test_rules_compile_to_the_same_score(spark):
    rng = np.random.default_rng(4)
    x = rng.random((300, len(quality.STATISTICS)))
    y = ((x[:, 2] > 0.5) & (x[:, 5] < 0.7)).astype(float)
    rules = quality.fit_rules(x, y)
    score = 1 / (1 + np.exp(-(rules.matrix(x) @ np.array(rules.weights) + rules.intercept)))
    assert ((score >= 0.5) == y).mean() > 0.97
    table = spark.createDataFrame(x.tolist(), [*quality.COLUMNS]).select(rules.column().alias("s"))
    assert np.allclose([r.s for r in table.collect()], score)


@pytest.mark.parametrize("kind", range(5))
@pytest.mark.parametrize("channels", (1, 2, 3, 4))
def test_unfilter_undoes_every_filter(kind, channels):
    """Rows filtered by the definition, one byte at a time."""
    rng = np.random.default_rng(kind)
    rows = rng.integers(0, 256, (7, 5 * channels)).astype(np.int64)
    lines = np.zeros((7, 5 * channels + 1), np.uint8)
    lines[:, 0] = kind
    for y in range(7):
        for x in range(rows.shape[1]):
            a, b = (rows[y, x - channels] if x >= channels else 0), (rows[y - 1, x] if y else 0)
            c = rows[y - 1, x - channels] if y and x >= channels else 0
            p = a + b - c
            paeth = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
            lines[y, x + 1] = (rows[y, x] - (0, a, b, (a + b) // 2, paeth)[kind]) % 256
    assert (media.unfilter(lines, channels) == rows).all()


def test_png_round_trip_and_damage():
    rng = np.random.default_rng(0)
    pixels = np.repeat(rng.integers(0, 256, (3, 64, 3), np.uint8), 40, axis=0)
    png = media.encode_png(pixels)
    assert (media.decode_png(png) == pixels).all()
    for at in (3, 20, len(png) // 2, len(png) - 6):
        with pytest.raises(ValueError):
            media.decode_png(png[:at] + bytes([png[at] ^ 1]) + png[at + 1 :])
    with pytest.raises(ValueError):
        media.decode_png(png[:-5])


def test_media_query(spark, sf, odd, empty):
    texts = {r.doc_id: r.text.encode() for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in queries.op2_media_columns(spark, sf).collect():
        t = texts[r.doc_id]
        p = t.ljust(max(192, -(-len(t) // 192) * 192), b" ")
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(t), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:]))
    rows = media.media_features(odd).collect()
    assert len(rows) == odd.count() and len({r.feature for r in rows if r.doc_id in (1, 2)}) == 1
    assert media.media_features(empty).count() == 0


def plain_hash(payload):
    """The cosine hash by its definition: double sums over averaged brightness."""
    grey = np.frombuffer(payload, np.uint8).reshape(-1, media.WIDTH, media.SAMPLES).mean(axis=2)
    height, n = len(grey), media.GRID
    cut = lambda i, size: slice(i * size // n, max((i + 1) * size // n, i * size // n + 1))
    grid = [[grey[cut(y, height), cut(x, media.WIDTH)].mean() for x in range(n)] for y in range(n)]
    wave = [[np.cos(np.pi / n * (x + 0.5) * u) for x in range(n)] for u in range(media.LOW)]
    low = [round(sum(wave[u][y] * sum(wave[v][x] * grid[y][x] for x in range(n)) for y in range(n)), 6) for u in range(media.LOW) for v in range(media.LOW)]
    middle = float(np.median(low[1:]))
    bits = "".join("1" if x > middle else "0" for x in low)
    return f"{int(bits, 2):016x}", min(abs(x - middle) for x in low if x != middle)


def test_media_features_equal_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").limit(25)
    stored = {r.doc_id: bytes(r.media) for r in media.encode(docs).collect()}
    rows = {r.doc_id: r for r in media.media_features(docs).collect()}
    for d in docs.collect():
        text = d.text.encode()
        payload = text.ljust(max(192, -(-len(text) // 192) * 192), b" ")
        r, png = rows[d.doc_id], stored[d.doc_id]
        assert (r.media_bytes, r.media_sha256) == (len(png), hashlib.sha256(png).hexdigest())
        body, at = b"", 8
        while at < len(png):
            size = int.from_bytes(png[at : at + 4], "big")
            body += png[at + 8 : at + 8 + size] if png[at + 4 : at + 8] == b"IDAT" else b""
            at += 12 + size
        lines, above, out = zlib.decompress(body), bytes(192), b""
        for i in range(0, len(lines), 193):
            line = lines[i + 1 : i + 193]
            above = line if lines[i] == 0 else bytes((a + b) % 256 for a, b in zip(line, above, strict=True))
            assert lines[i] in (0, 2)
            out += above
        assert out == payload
        want, gap = plain_hash(payload)
        assert r.feature == want or (gap < 1e-4 and (int(r.feature, 16) ^ int(want, 16)).bit_count() <= 2)


def test_hash_is_near_for_near_images():
    rng = np.random.default_rng(9)
    smooth = np.cumsum(np.cumsum(rng.normal(size=(64, 64)), 0), 1)
    grey = (255 * (smooth - smooth.min()) / np.ptp(smooth)).astype(np.uint8)[:, :, None]
    noisy = np.clip(grey.astype(int) + rng.integers(-6, 7, grey.shape), 0, 255).astype(np.uint8)
    a, b = int(media.cosine_hash(grey), 16), int(media.cosine_hash(noisy), 16)
    assert (a ^ b).bit_count() <= 6
