import math
import re
import zlib

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from landgrid.llm import langid
from landgrid.llm.langid import UNDETERMINED, Limits, Model, Predictor, fit, held_out, keep_identified, op9_language_id, predict


ROWS = [(0, "der", "de", 5), (0, "the", "en", 5), (0, "the", "de", 1), (3, " th", "en", 5), (3, "er ", "de", 3), (3, "ers", "en", 2), (1, "z", "de", 5), (1, "é", "en", 1)]
TABLE = pa.table(dict(zip(("order", "unit", "lang", "n"), map(list, zip(*ROWS)))))
TOTALS = {(o, l): (9, 3) for o in (0, 1, 3) for l in ("de", "en")}


def plain_scores(word):
    """Word-first backoff of one word, written out."""
    def logs(order, unit):
        n = {l: next((r[3] for r in ROWS if r[:3] == (order, unit, l)), 0) for l in ("de", "en")}
        return normal([math.log((n[l] + 0.5) / (9 + 0.5 * 3)) for l in ("de", "en")])

    def normal(xs):
        whole = math.log(sum(map(math.exp, xs)))
        return [x - whole for x in xs]

    known = {r[:2] for r in ROWS}
    if (0, word) in known:
        return logs(0, word)
    padded = f" {word} "
    for order in (3, 1):
        found = [logs(order, padded[i : i + order]) for i in range(len(padded) - order + 1) if (order, padded[i : i + order]) in known]
        if found:
            return normal([sum(x) / len(found) for x in zip(*found)])
    return None


def plain_verdict(text):
    words = re.findall(r"[^\W\d_]+", (text or "").lower())
    scores = [x for w in words if (x := plain_scores(w))]
    if not any(c.isalpha() for w in words for c in w):
        return UNDETERMINED, 0.0
    if not scores:
        return "en", 0.5
    total = [sum(x) for x in zip(*scores)]
    best = total.index(max(total))
    return ("de", "en")[best], 1 / sum(math.exp(x - total[best]) for x in total)


def test_known_words_come_first_then_shorter_grams(monkeypatch):
    model = Model(["de", "en"], TABLE, TOTALS, "en")
    texts = [None, "", " \n", "12 !", "qqq", "²", "der", "the", "than", "xyz", "Der/THE 7z-ers", "others bier é", "der the " * 50, "don't zé_er " * 30, "the der qqq zz", "the " * 9]
    for slice_chars, group in ((langid.SLICE, langid.GROUP_TOKENS), (5, 3)):
        monkeypatch.setattr(langid, "SLICE", slice_chars)
        monkeypatch.setattr(langid, "GROUP_TOKENS", group)
        monkeypatch.setattr(langid, "KEPT_TOKENS", group)
        for (lang, score), text in zip(Predictor(model)(texts), texts, strict=True):
            expected = plain_verdict(text)
            assert (lang, score) == (expected[0], pytest.approx(expected[1], abs=1e-5)), text


def test_very_long_text():
    model = Model(["de", "en"], TABLE, TOTALS, "en")
    text = "the " * 1_300_000 + "der"
    assert Predictor(model)([text]) == [("en", pytest.approx(1.0))]


def test_held_out_accuracy(spark):
    truth = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
    rows = op9_language_id(spark, "/root/testdata/sf0.01").join(truth, "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    out = [r for r in rows if r.held_out]
    assert len(out) > 150 and sum(r.lang == r.lang_pred for r in out) >= 0.98 * len(out)
    assert all(0 <= r.score <= 1 for r in rows)


def test_every_row_is_predicted(docs, empty):
    rows = predict(docs, fit(docs, Limits(sample_docs=10, least=1))).collect()
    assert len(rows) == docs.count()
    assert {r.lang_pred for r in rows if r.doc_id in (4, 5, 6, 9)} == {UNDETERMINED}
    assert predict(empty, fit(empty)).count() == 0
    assert [r.lang_pred for r in predict(docs, fit(empty)).select("lang_pred").distinct().collect()] == [UNDETERMINED]
    assert docs.where("doc_id IS NULL").select(held_out()).first()[0] is False


def test_rejected_documents_go(docs):
    kept = keep_identified(docs)
    assert kept.columns == docs.columns
    assert kept.where(F.col("doc_id").isin(4, 5, 6, 9)).count() == 0 and kept.where("doc_id >= 100").count() == 20
