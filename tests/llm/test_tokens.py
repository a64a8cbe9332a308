"""Token counts and token files against the tokenizer library itself."""

from __future__ import annotations

import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pagequarry.llm import pieces, queries, token_counts, token_files
from tokenizers import Tokenizer

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def ids(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


def test_counts_equal_the_library(spark, sf, library):
    rows = queries.op4_token_counts(spark, sf).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert len(rows) == len(texts)
    for r in rows:
        n = len(ids(library, texts[r.doc_id]))
        assert (r.n_tokens, r.n_bytes, r.over_limit) == (n, len(texts[r.doc_id].encode()), n > 512)


def test_counts_of_odd_documents(odd, empty, library):
    rows = token_counts.count_tokens(odd, PATH).collect()
    texts = [(r.doc_id, r.text) for r in odd.collect()]
    assert sorted((str(r.doc_id), r.n_tokens) for r in rows) == sorted((str(d), len(ids(library, t))) for d, t in texts)
    assert token_counts.count_tokens(empty, PATH).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.sampled_from([*"abé ñ.,!?'s\n\t 0’²\x01\x02\x1c\x85\xa0\u2003\u3000\r\x0bß日", "\n\n", "  ", "word", "мир", "😀", "<|endoftext|>"]), max_size=30).map("".join), max_size=6))
def test_encoder_equals_the_library(texts):
    library, encoder = Tokenizer.from_file(PATH), pieces.Encoder(PATH, "H")
    got = [np.frombuffer(x, "<u2").tolist() for x in encoder.ids(texts, 0)]
    assert got == [ids(library, t) + [0] for t in texts]
    assert pieces.Encoder(PATH).lengths(texts).tolist() == [len(ids(library, t)) for t in texts]


SHAPES = {
    "paragraphs": "One paragraph.\n\nAnother one.\r\n\r\n  Indented,  twice. ",
    "tabs": "a\tb\t\tc\n\td\n",
    "emoji": "so 😀😀 good 👍🏽!",
    "cyrillic": "Съешь же ещё этих мягких французских булок, да выпей чаю.",
    "greek": "Ξεσκεπάζω την ψυχοφθόρα βδελυγμία.",
    "chinese": "我能吞下玻璃而不伤身体。\n\n第二段。",
    "special": "before<|endoftext|> behind <|endoftext|><|endoftext|>",
}


@pytest.mark.parametrize("shape", SHAPES)
def test_every_shape_of_text_is_cut_and_looked_up(library, shape):
    text = SHAPES[shape] * 3
    encoder = pieces.Encoder(PATH, "H")
    assert np.frombuffer(encoder.ids([text], 0)[0], "<u2").tolist() == ids(library, text) + [0]
    known = len(encoder.cache)
    assert known > 1
    encoder.ids([text], 0)
    assert len(encoder.cache) == known, "a second look needs no new entry"


def test_words_of_all_shapes_are_counted_for_the_table(spark):
    docs = spark.createDataFrame([(i, "\n\n".join(SHAPES.values())) for i in range(3)], "doc_id long, text string")
    found = token_counts.frequent_pieces(docs, "text", pieces.special_strings(PATH))
    assert {"булок,", "b", "paragraph.", "good", "την"} <= set(found) | {x.strip() for x in found}


def test_other_pre_tokenizers_are_refused(tmp_path):
    with pytest.raises(ValueError):
        pieces.tokenizer(public_tokenizers.path("word_bpe_49k.json"))


def test_ties_of_frequency_rank_the_smaller_id_first(spark):
    encoded = spark.createDataFrame([(1, np.array([5, 3, 9], "<u2").tobytes()), (2, np.array([3, 5, 9, 0], "<u2").tobytes())], "id long, ids binary")
    rank = token_files.id_ranks(encoded, "H", 10)
    assert np.argsort(rank).tolist()[:5] == [3, 5, 9, 0, 1]


@settings(max_examples=80, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2**32 - 1) | st.integers(0, 300), max_size=30), max_size=8))
def test_packing_round_trips(runs):
    n = np.array([len(r) for r in runs], np.int64)
    values = np.array([v for r in runs for v in r], np.uint32)
    control, data = token_files.pack(values, n)
    assert token_files.unpack(b"".join(control), b"".join(data), n, len(values)).tolist() == values.tolist()


def test_damaged_streams_are_refused():
    control, data = token_files.pack(np.array([1, 70000, 3], np.uint32), np.array([3]))
    with pytest.raises(ValueError):
        token_files.unpack(control[0], data[0][:-1], np.array([3]), 3)
    with pytest.raises(ValueError):
        token_files.unpack(b"", data[0], np.array([3]), 3)


def brute(library, rows):
    start, out = 0, []
    for doc_id, text in rows:
        x = ids(library, text) + [0]
        out.append((doc_id, start, len(x), zlib.crc32(np.array(x, "<u4").tobytes())))
        start += len(x)
    return out


def test_files_in_order_of_ids(spark, sf, library):
    texts = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect())
    got = sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in queries.op7_token_files(spark, sf).collect())
    assert got == brute(library, texts)


def test_files_of_odd_documents(odd, empty, library):
    got = token_files.round_trip(odd, PATH).collect()
    assert len(got) == odd.count()
    want = brute(library, [(r.doc_id, r.text) for r in odd.collect()])
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_crc32) for r in got) == sorted((str(d), n, c) for d, _, n, c in want)
    ordered = sorted(got, key=lambda r: r.start)
    assert [r.start for r in ordered] == [sum(x.n_tokens for x in ordered[:i]) for i in range(len(ordered))]
    assert [r.doc_id or 0 for r in ordered] == sorted(r.doc_id or 0 for r in ordered)
    assert token_files.round_trip(empty, PATH).count() == 0


def test_equal_and_null_ids_are_dealt_over_parts(spark, tmp_path):
    import public_tokenizers
    from pyspark.sql import functions as F

    docs = spark.range(3000).select(F.when(F.col("id") % 3 == 0, F.lit(7)).when(F.col("id") % 3 == 1, F.col("id")).cast("long").alias("doc_id"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"))
    path = f"file://{tmp_path}/tokens"
    token_files.write_files(docs, public_tokenizers.path("byte_bpe_50k.json"), path)
    parts = [r.n for r in spark.read.parquet(f"{path}/blocks").groupBy("part").agg(F.sum(F.size("ids")).alias("n")).collect()]
    assert sum(parts) == 3000 and max(parts) < 1300 and len(parts) >= 4
    rows = sorted(token_files.read_files(spark, path).collect(), key=lambda r: r.start)
    ids = [r.doc_id for r in rows]
    assert ids == [None] * 1000 + sorted(i for i in ids if i is not None) and [r.start for r in rows[1:]] == [r.start + r.n_tokens for r in rows[:-1]]


def test_the_step_after_encoding_empties_the_workers_encoders():
    pieces.worker_encoder(PATH, "H").ids(["some words of a text"], 0)
    assert pieces.worker_encoder.cache_info().currsize
    batch = pa.RecordBatch.from_pydict({"ids": pa.array([np.array([5, 0], "<u2").tobytes()], pa.binary())})
    (found,) = token_files._count("H", 10)(iter([batch]))
    assert found.to_pydict() == {"token": [0, 5], "n": [1, 1]}
    assert not pieces.worker_encoder.cache_info().currsize, "a worker serves later steps, which need the memory"
