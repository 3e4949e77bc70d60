import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from landgrid.llm.pieces import PieceEncoder, compose, decode_documents, encode_digest, encode_documents, entries

PATH = public_tokenizers.path("piece_bpe_32k.model")
MODEL = sentencepiece.SentencePieceProcessor(model_file=PATH)


@pytest.mark.parametrize("chunk", [100, 1 << 14])
def test_ids_equal_the_library(docs, chunk):
    got = encode_documents(docs, PATH, chunk).collect()
    assert len(got) == docs.count()
    for r in got:
        assert np.frombuffer(r.ids, "<u4").tolist() == MODEL.encode(r.text or ""), r.text[:50]


def test_chunks_without_spaces(spark):
    rng = random.Random(4)
    texts = ["".join(rng.choices(["the", "ing", "a", "b", "é", "\n", "ion", "1", "."] + [" "] * k, k=rng.randrange(40, 300))) for k in (0, 0, 0, 1, 3) for _ in range(8)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    for r in encode_documents(docs, PATH, 64).collect():
        assert np.frombuffer(r.ids, "<u4").tolist() == MODEL.encode(r.text)


def test_hard_texts_above_a_chunk(spark):
    rng = random.Random(9)
    cjk = "".join(chr(rng.randrange(0x4E00, 0x9FA0)) for _ in range(3000)) + "。中国人民" * 3000
    texts = [
        cjk, "a" * 20_000, "".join(rng.choices("abcdefghij", k=20_000)), " " * 20_000, "\n" * 20_000, "\u2581 x" * 9000, "\0\U0001f600é" * 7000,
        "x" + " " * 17_000 + "y\n" + "= " * 9000, "中国人的" * 250_000,
    ]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(8)
    for r in encode_documents(docs, PATH).collect():
        assert np.frombuffer(r.ids, "<u4").tolist() == MODEL.encode(r.text), r.text[:20]
    digests = {r.doc_id: r for r in encode_digest(docs.union(docs), PATH).collect()}
    assert [digests[i].exact for i in range(len(texts))] == ["\u2581" not in t for t in texts]


def test_decoding_equals_the_library():
    encoder = PieceEncoder(PATH)
    rng = random.Random(2)
    for size in (0, 1, 5, 300):
        for low in (0, 3, 259):
            ids = [rng.randrange(low, 32_000 if low != 3 else 259) for _ in range(size)]
            assert encoder.decode(np.array(ids, "<u4").tobytes()) == MODEL.decode(ids)


def test_very_long_text(spark):
    docs = spark.createDataFrame([(1, "The quick brown fox, number 7,\n" * 160_000)], "doc_id long, text string")
    row = encode_digest(docs, PATH).first()
    assert row.exact and row.ids_crc32 == zlib.crc32(np.array(MODEL.encode(docs.first().text), "<u4").tobytes())


def test_products_are_associative_and_found_in_parallel():
    rng = np.random.default_rng(1)
    for _ in range(20):
        sizes = [1, *rng.integers(1, 5, rng.integers(1, 9)).tolist()]
        ms = [np.where(rng.random((a, b)) < 0.8, 0.0, -np.inf) for a, b in zip(sizes, sizes[1:], strict=False)]
        whole = ms[0]
        for m in ms[1:]:
            whole = compose(whole, m)
        for final in np.flatnonzero(whole[0] == 0):
            states = entries(ms, int(final))
            assert all(m[a, b] == 0 for m, a, b in zip(ms, [0, *states], states, strict=False))


def test_round_trip_of_edge_cases(docs, empty):
    rows = encode_digest(docs, PATH).collect()
    assert len(rows) == docs.count() and all(r.exact for r in rows)
    assert encode_digest(empty, PATH).count() == 0
    texts = {r.doc_id: r.text or "" for r in docs.collect() if r.doc_id is not None}
    assert all(r.decoded_crc32 == zlib.crc32(texts[r.doc_id].encode()) for r in rows if r.doc_id is not None)
    assert decode_documents(encode_documents(docs, PATH), PATH).columns == [*docs.columns, "ids", "decoded"]
