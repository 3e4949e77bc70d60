import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from landgrid.llm.tokenfile import EliasFano, UnitEncoder, open_segment, pack_segment, read_token_files, write_token_files

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.mark.parametrize("values", [[], [0], [5, 5, 5], [0, 1, 1_000_000], list(range(0, 3000, 3)), sorted(random.Random(1).choices(range(10**6), k=4000))])
def test_elias_fano(values):
    ef = EliasFano.build(np.array(values, np.int64), stride=64)
    assert ef.values().tolist() == values
    assert [ef.select(i) for i in range(0, len(values), 3)] == values[::3]
    for b in range(len(ef.samples)):
        assert ef.block(b).tolist() == values[64 * b : 64 * (b + 1)]


def test_segment_round_trip():
    for top in (70, 70_000):
        ids = np.arange(top, dtype=np.uint32)
        ef, back = open_segment(pack_segment(ids, np.array([1, 1, top])))
        assert back.tolist() == ids.tolist() and ef.values().tolist() == [1, 1, top]


def test_units_equal_whole_texts():
    plain, units = Tokenizer.from_file(PATH), UnitEncoder(PATH)
    rng = random.Random(2)
    alphabet = ["a", "b", " ", "  ", "\n", "\t", "'s", "é", "9", "#", " ", "　", "don't", "<|endoftext|>", "\x85", "\xa0", "\x1c", "²", "ß", "'", "'ll", "\x00", "\xad", "¼", "µ", "\r\n"] + ["x", " ", "s"] * 3
    for _ in range(4000):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randrange(16)))
        assert units(text) == np.array(plain.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def test_very_long_text():
    text = "A very long text, <|endoftext|> and all. " * 130_000
    assert UnitEncoder(PATH)(text) == np.array(Tokenizer.from_file(PATH).encode(text, add_special_tokens=False).ids, "<u4").tobytes()
    assert UnitEncoder(PATH)("a<|endoftext|>b") == np.array([64, 50256, 65], "<u4").tobytes()


def test_files_hold_all_documents_in_order(spark, docs, empty, tmp_path):
    plain = Tokenizer.from_file(PATH)
    docs = docs.unionByName(spark.createDataFrame([(77, "a<|endoftext|>b")], "doc_id long, text string"), allowMissingColumns=True)
    write_token_files(docs, str(tmp_path / "a"), PATH)
    got = read_token_files(spark, str(tmp_path / "a")).orderBy("start").collect()
    want = {}
    for r in docs.select("doc_id", "text").collect():
        ids = np.array([*plain.encode(r.text or "", add_special_tokens=False).ids, 0], "<u4")
        want.setdefault(r.doc_id, []).append((len(ids), zlib.crc32(ids.tobytes())))
    assert [r.doc_id for r in got] == sorted((r.doc_id for r in got), key=lambda d: (d is not None, d))
    start = 0
    for r in got:
        assert r.start == start
        want[r.doc_id].remove((r.n_tokens, r.ids_crc32))
        start += r.n_tokens
    assert not any(want.values())
    write_token_files(empty, str(tmp_path / "b"), PATH)
    assert read_token_files(spark, str(tmp_path / "b")).count() == 0
