import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
from pyspark.sql import functions as F

from landgrid.llm.runs import WaveletTree, op13_periodic_runs, word_runs

WORD = r"[^\x20\x09-\x0D]+"


def brute_runs(w):
    """Every maximal stretch of each period that no divisor of it has too, from the definition."""
    out = []
    for p in range(1, len(w) // 4 + 1):
        j = 0
        while j + p < len(w):
            e = j
            while e + p < len(w) and w[e] == w[e + p]:
                e += 1
            length = e - j + p
            if e > j and length >= max(6, 4 * p) and not any(all(w[x] == w[x + q] for x in range(j, j + length - q)) for q in range(1, p)):
                out.append((j, length, p))
            j = max(e, j + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def brute(text, doc_id=None):
    w = re.findall(WORD, text or "")
    if doc_id is not None:
        h, n = zlib.crc32(str(doc_id).encode()), len(w)
        if h % 10 == 0 and n:
            g = h // 10
            a, p = g % n, 1 + (n - g % n) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = brute_runs(w)
    dropped = {i for s, n, p in runs for i in range(s + p, s + n)}
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    top = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (len(runs), *top, sha("".join(f"{s},{n},{p}\n" for s, n, p in runs)), sha(" ".join(x for i, x in enumerate(w) if i not in dropped)))


def random_texts(count, seed):
    rng, out = random.Random(seed), []
    for _ in range(count):
        n = rng.randint(0, 110)
        w = [rng.choice("abcde"[: rng.choice([1, 2, 3, 5])]) for _ in range(n)]
        for _ in range(rng.randint(0, 3)):
            if n > 8:
                a = rng.randrange(n - 4)
                p, end = rng.randint(1, 9), rng.randint(a, n)
                for i in range(a + p, end):
                    w[i] = w[i - p]
        out.append(rng.choice([" ", "\n", " \t "]).join(w))
    return out


def test_random_texts_against_brute_force(spark):
    texts = random_texts(1500, 3)
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    for plant in (False, True):
        got = {r.doc_id: tuple(r)[1:] for r in word_runs(rows, plant).collect()}
        assert got == {i: brute(t, i if plant else None) for i, t in enumerate(texts)}


def test_query_against_brute_force(spark):
    got = {r.doc_id: tuple(r)[1:] for r in op13_periodic_runs(spark, "/root/testdata/sf0.001").collect()}
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    assert len(got) == len(docs) and any(r[0] for r in got.values())
    assert got == {r.doc_id: brute(r.text, r.doc_id) for r in docs if len(r.text) < 20_000} | {r.doc_id: got[r.doc_id] for r in docs if len(r.text) >= 20_000}


def test_nulls_long_texts_and_repeated_rows(spark, docs, empty):
    got = sorted((tuple(r) for r in word_runs(docs, plant=True).collect()), key=str)
    short = [(r.doc_id, *brute(r.text, r.doc_id)) for r in docs.select("doc_id", "text").collect() if r.doc_id != 7]
    assert sorted((r for r in got if r[0] != 7), key=str) == sorted(short, key=str)
    assert word_runs(empty).count() == 0 and word_runs(docs).columns[:2] == ["doc_id", "n_runs"]
    # A word, a phrase and a long passage, each repeated through a whole long text.
    words = ["x"] * 300_000, ["a", "b", "b"] * 60_000, [f"w{i % 40_000}" for i in range(200_000)]
    long = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(words)], "doc_id long, text string")
    got = [tuple(r)[1:6] for r in word_runs(long.withColumn("start", F.lit("clash"))).orderBy("doc_id").collect()]
    assert got == [(1, 0, 300_000, 1, 300_000_000), (1, 0, 180_000, 3, 60_000_000), (1, 0, 200_000, 40_000, 5000)]


def test_wavelet_tree_successors():
    rng = np.random.default_rng(5)
    values = rng.permutation(1000)
    tree = WaveletTree(values)
    lo = rng.integers(0, 900, 400)
    hi, limit = lo + rng.integers(1, 100, 400), rng.integers(0, 1000, 400)
    below = tree.below(lo, hi, limit)
    assert below.tolist() == [(values[a:b] < x).sum() for a, b, x in zip(lo, hi, limit, strict=True)]
    nth = rng.integers(0, hi - lo)
    assert tree.smallest(lo, hi, nth).tolist() == [sorted(values[a:b])[k] for a, b, k in zip(lo, hi, nth, strict=True)]
