import math
import random
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from landgrid.llm.lexical import OP12_SQL, Limits, Trie, op12_lexical_search, search
from tests.compare import connect

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
LOWER = {c: c + 32 for c in range(65, 91)}


def brute(docs, items, k=10):
    """Every document's score for every item, from the contract; rows of docs are ``(doc_id, text)``."""
    split = [(i, re.findall(TERM, (t or "").translate(LOWER))) for i, t in docs]
    split = [(i, t) for i, t in split if t]
    n_docs, words = len(split), sum(len(t) for _, t in split)
    df = Counter(t for _, terms in split for t in set(terms))
    out = []
    for item, text in items:
        asked, scored = re.findall(TERM, (text or "").translate(LOWER)), []
        for name, terms in split:
            tf, m = Counter(terms), 25 + 75 * len(terms) * n_docs // words
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * tf[t] // (1000 * tf[t] + 8 * m)) for t in asked)
            if score > 0:
                scored.append((-score, name is None, name, score))
        out += [(item, rank, name, score) for rank, (_, _, name, score) in enumerate(sorted(scored, key=lambda x: (x[0], x[1], x[2] or 0))[:k], 1)]
    return sorted(out, key=str)


def got(rows):
    return sorted((tuple(r) for r in rows.collect()), key=str)


def test_query_against_sql(spark):
    con = connect("/root/testdata/sf0.01")
    assert got(op12_lexical_search(spark, "/root/testdata/sf0.01")) == sorted(con.sql(OP12_SQL).fetchall(), key=str)


def test_random_texts_with_ties_and_copies(spark):
    rng = random.Random(8)
    text = lambda n: " ".join(rng.choice(["alpha", "Beta", "gamma", "DELTA", "épée", "straße", "日本", "x9", "the", "the", "the", "of"]) for _ in range(n))
    texts = [text(rng.randint(1, 12)) for _ in range(120)]
    docs = [(i, rng.choice(texts)) for i in range(700)] + [(5, texts[0])] * 40 + [(None, texts[1]), (None, texts[1]), (900, None), (901, ""), (902, "--- !!")]
    items = [(i, text(rng.randint(1, 8))) for i in range(12)] + [(3, "the of"), (None, "alpha"), (50, None), (51, ""), (52, "nowhere"), (53, "alpha-ALPHA alpha"), (53, "alpha-ALPHA alpha")]
    frames = spark.createDataFrame(docs, "doc_id long, text string").withColumn("score", F.lit(1)), spark.createDataFrame(items, "item_id long, text string").withColumn("rank", F.lit("x"))
    want = brute(docs, items)
    for limits in (Limits(), Limits(block_bytes=60, tree_docs=50, leaf_docs=2), Limits(tree_terms=40, leaf_docs=1)):
        assert got(search(frames[0].repartition(5), frames[1], 10, limits)) == want


def test_odd_rows(spark, docs, empty):
    items = spark.createDataFrame([(1, "The Quick fox"), (2, "Fuchs über word3"), (3, "10 only times")], "item_id long, text string")
    assert got(search(docs, items)) == brute([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()], [(r.item_id, r.text) for r in items.collect()])
    assert search(empty, items).count() == 0 and search(docs, items.where("false")).count() == 0
    assert search(docs.where("text IS NULL"), items).count() == 0


def test_bounds_hold_below_every_node():
    rng = np.random.default_rng(3)
    docs = []
    for i in range(400):
        terms = np.flatnonzero(rng.random(40) < 1 / (1 + np.arange(40) / 4))
        docs.append((i, int(rng.integers(25, 200)), terms, rng.integers(1, 6, len(terms))))
    tree = Trie(docs, 10, 4)
    terms, weights = np.arange(0, 40, 3), rng.integers(1, 99, 14)
    score = lambda node: int(tree.bounds(np.array([node]), terms, weights)[0])
    seen = []

    def check(node):
        if node not in tree.children:
            seen.extend(tree.ids[node])
            return score(node)
        below = max(check(c) for c in tree.children[node].tolist())
        assert below <= score(node)
        return below

    check(tree.root)
    assert sorted(seen) == list(range(400))
