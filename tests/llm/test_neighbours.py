import math

import numpy as np
from pyspark.sql import functions as F

from landgrid.llm.neighbours import Plan, Tree, lifted, op10_ann, search

QUERY = "vec_id % 20 = 0"


def brute(vectors, k):
    ids, matrix = np.array([v for v, _ in vectors]), np.array([x for _, x in vectors], float)
    out = {}
    for q in sorted({i for i in ids.tolist() if i % 20 == 0}):
        keep = ids != q
        s = (matrix[keep] * matrix[ids == q][0]).sum(axis=1)
        out[q] = ids[keep][np.lexsort((ids[keep], -s))[:k]].tolist()
    return out


def test_best_bin_first_visits_every_leaf_once():
    points = np.random.default_rng(0).normal(size=(500, 8))
    tree = Tree(lifted(points, 10.0), 30, 1)
    assert sorted(tree.visits(np.zeros(9), tree.leaves)) == list(range(tree.leaves))
    assert set(tree.leaf(lifted(points, 10.0)).tolist()) <= set(range(tree.leaves))


def test_recall_and_exact_scores(spark):
    vectors = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").select("vec_id", "embedding").collect()
    want, by_id = brute(vectors, 20), {v.vec_id: np.array(v.embedding, float) for v in vectors}
    got = {}
    for r in op10_ann(spark, "/root/testdata/sf0.01").collect():
        got.setdefault(r.query_id, {})[r["rank"]] = r.vec_id
        assert abs(r.score - by_id[r.query_id] @ by_id[r.vec_id]) < 1e-12
    assert set(got) == set(want) and all(sorted(x) == list(range(1, 21)) for x in got.values())
    assert np.mean([len(set(got[q].values()) & set(want[q])) / 20 for q in want]) >= 0.9


def test_ties_copies_and_odd_vectors(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [1.0, 2.0, 0.5]) for i in range(300)] + [(i, rng.normal(size=3).tolist()) for i in range(300, 340)]
    odd = [(1000, None), (1001, [0.0, 0.0, 0.0]), (1002, [1.0, None, 2.0]), (1003, [math.nan, 1.0, 1.0]), (1004, [math.inf, 1.0, 1.0]), (None, [1.0, 1.0, 1.0]), (1020, [1.0, 2.0]), (1040, [3.0]), (1041, [-2.0])]
    frame = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>").withColumn("leaf", F.lit("x")).withColumn("vector", F.lit(1))
    plan = Plan(recall=1.0, block_rows=50)
    got = {}
    for r in search(frame, F.expr(QUERY), 20, plan).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert got == brute(rows, 20) | {1040: [1041]}  # each length by itself


def test_few_or_no_rows(spark):
    frame = spark.createDataFrame([(20, [1.0, 0.0]), (21, [0.5, 0.5]), (40, [0.0, 2.0])], "vec_id long, embedding array<float>")
    assert [(r.query_id, r["rank"], r.vec_id) for r in search(frame, F.expr(QUERY)).orderBy("query_id", "rank").collect()] == [(20, 1, 21), (20, 2, 40), (40, 1, 21), (40, 2, 20)]
    assert search(frame.where("vec_id < 0"), F.expr(QUERY)).count() == 0


def test_queries_in_small_leaves_get_all_their_rows(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [1.0, 0.0, 0.0, 0.0]) for i in range(3000)] + [(3000 + i, [0.0, *(x / np.linalg.norm(x)).tolist()]) for i, x in enumerate(rng.normal(size=(12, 3)))]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for plan in (Plan(), Plan(chunk_queries=1, block_rows=200)):
        got = search(frame, F.expr("vec_id IN (1000, 2000, 3000, 3004, 3011)"), 20, plan).groupBy("query_id").agg(F.countDistinct("vec_id").alias("n")).collect()
        assert {r.query_id: r["n"] for r in got} == dict.fromkeys((1000, 2000, 3000, 3004, 3011), 20)


def test_repeated_query_rows_get_an_answer_each(spark):
    rng = np.random.default_rng(6)
    rows = [(i, rng.normal(size=4).tolist()) for i in range(100)]
    again, other = rows[20], (40, rng.normal(size=4).tolist())
    frame = spark.createDataFrame([*rows, again, again, other], "vec_id long, embedding array<double>")
    got = search(frame, F.expr(QUERY), 20, Plan(recall=1.0)).collect()

    def near(vector, name):
        pairs = sorted((-float((np.array(v) * np.array(vector)).sum()), i) for i, v in [*rows, again, again, other] if i != name)[:20]
        return [(rank, i) for rank, (_, i) in enumerate(pairs, 1)]

    want = [(q, *x) for q, v in [*[r for r in rows if r[0] % 20 == 0], again, again, other] for x in near(v, q)]
    assert sorted((r.query_id, r["rank"], r.vec_id) for r in got) == sorted(want)
