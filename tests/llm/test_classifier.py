import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from landgrid.llm.classifier import STATISTICS, Settings, classify, fit, isotonic, op11_quality_classifier, solved, statistics, summed, with_statistics


def auc(scores, good):
    rank = np.argsort(np.argsort(scores, kind="stable"), kind="stable") + 1.0
    for s in set(scores):
        rank[scores == s] = rank[scores == s].mean()
    n1, n0 = good.sum(), (~good).sum()
    return (rank[good].sum() - n1 * (n1 + 1) / 2) / n1 / n0


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_held_out_accuracy(spark, sf):
    got = op11_quality_classifier(spark, f"/root/testdata/{sf}").toPandas()
    docs = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet").select("doc_id").toPandas()
    labels = spark.read.parquet(f"/root/testdata/{sf}/labels.parquet").toPandas()
    assert sorted(got.doc_id) == sorted(docs.doc_id) and got.score.between(0, 1).all()
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in got.doc_id]).all()
    assert (got.predicted == (got.score >= 0.3)).all()
    away = got[got.held_out].merge(labels, on="doc_id")
    assert auc(away.score.to_numpy(), away.quality.to_numpy() == 1) > 0.99 and (away.predicted == away.quality).mean() > 0.98


def test_labels_of_held_out_rows_are_not_learnt(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "labels"))
    other = labels.withColumn("quality", F.expr("IF(crc32(cast(cast(doc_id AS string) AS binary)) % 5 = 0, 1 - quality, quality)"))
    one, two = ({r.doc_id: r.score for r in classify(docs, x).collect()} for x in (labels, other))
    assert one.keys() == two.keys() and all(abs(one[i] - two[i]) < 1e-9 for i in one)


def test_sums_and_weights_against_brute_force(spark):
    settings = Settings(features=32)
    rng = np.random.default_rng(1)
    data = [(rng.normal(size=len(STATISTICS)).tolist(), float(rng.integers(2)), int(rng.integers(4))) for _ in range(500)]
    rows = spark.createDataFrame(data, "stats array<double>, label double, fold int").repartition(7)
    from landgrid.llm.classifier import Features

    feature = Features(np.zeros(len(STATISTICS)), np.ones(len(STATISTICS)), 1.0, settings)
    sums = summed(rows, [feature], 4)
    z, y, fold = feature(np.array([d[0] for d in data])), np.array([d[1] for d in data]), np.array([d[2] for d in data])
    for f in range(4):
        full = np.column_stack([z, y])[fold == f]
        assert np.allclose(sums[0, f], full.T @ full)
    total = sum(sums[0, f] for f in range(4))
    w = solved(total, 1e-3)
    penalty = np.diag([1e-9] + [0.5] * 32)
    assert np.allclose(w, np.linalg.inv(z.T @ z + penalty) @ z.T @ y)
    # The random features approximate the Gaussian kernel.
    wide = Features(np.zeros(len(STATISTICS)), np.ones(len(STATISTICS)), 1.0, Settings(features=20_000))
    a, b = (np.array([d[0] for d in data])[i : i + 40] for i in (0, 40))
    exact = np.exp(-((a - b) ** 2).sum(axis=1) / (2 * len(STATISTICS)))
    assert np.abs((wide(a)[:, 1:] * wide(b)[:, 1:]).sum(axis=1) - exact).max() < 0.05


def test_isotonic_against_brute_force():
    rng = np.random.default_rng(2)
    for _ in range(200):
        n = int(rng.integers(1, 9))
        values, weights, means = np.arange(n, dtype=float), rng.integers(1, 5, n).astype(float), rng.integers(0, 4, n) / 3
        # The least squares rising fit is max over starts of min over ends of the means between.
        mean = lambda a, b: (means[a : b + 1] * weights[a : b + 1]).sum() / weights[a : b + 1].sum()
        want = [max(min(mean(a, b) for b in range(i, n)) for a in range(i + 1)) for i in range(n)]
        centres, heights = isotonic(values, weights, means)
        assert (np.diff(heights) > 0).all() and np.allclose(np.unique(np.round(want, 9)), np.round(heights, 9))
        groups = [[v for v, h in zip(values, want, strict=True) if abs(h - height) < 1e-9] for height in heights]
        assert np.allclose(centres, [np.average(g, weights=weights[np.array(g, int)]) for g in groups])


def test_odd_rows(spark, docs, empty):
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (3, 1, 0), (7, 1, None), (8, 0, 0), (9, None, 0), (None, 1, 0), (11, 0, 0), *[(100 + i, i % 2, 0) for i in range(20)]], "doc_id long, quality int, toxic int")
    got = classify(docs, labels)
    assert got.columns == ["doc_id", "held_out", "score", "predicted"]
    rows = got.collect()
    assert sorted(str(r.doc_id) for r in rows) == sorted(str(r.doc_id) for r in docs.select("doc_id").collect())
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
    assert len({r.score for r in rows if r.doc_id == 8}) == 1 and {r.held_out for r in rows if r.doc_id is None} == {False}
    assert classify(empty, labels).count() == 0
    assert {r.score for r in classify(docs, labels.where("false")).collect()} == {0.5}
    assert {round(r.score, 6) for r in classify(docs, labels.withColumn("quality", F.lit(1))).collect()} == {1.0}
    assert statistics(None) == statistics("") == [0.0] * len(STATISTICS) and len(statistics("A b!\n\n|| c.")) == len(STATISTICS)


def test_hot_ids_and_disagreeing_labels(spark):
    good, bad = "A plain sentence of words stands here.", "BUY!! NOW!! BUY!! NOW!!"
    docs = spark.createDataFrame([(5, good)] * 400 + [(6, bad)] * 300 + [(7 + i, [good, bad][i % 2] + f" {i}") for i in range(200)], "doc_id long, text string")
    labels = spark.createDataFrame([(5, 1)] * 300 + [(6, 0)] * 200 + [(7 + i, 1 - i % 2) for i in range(200)], "doc_id long, quality int")
    model = fit(with_statistics(docs), labels)
    away = np.array([statistics(good), statistics(bad)])
    high, low = model(away)
    assert high > 0.9 and low < 0.1


def test_labels_are_never_broadcast(spark, monkeypatch):
    from landgrid.llm import classifier

    plans, cut = [], classifier.cut_lineage
    monkeypatch.setattr(classifier, "cut_lineage", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or cut(df))
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "labels"))
    fit(with_statistics(docs), labels)
    assert len(plans) == 1 and "SortMergeJoin" in plans[0] and "Broadcast" not in plans[0]


def test_few_partitions_sum(spark, monkeypatch):
    from landgrid.llm import classifier

    parts, of = [], classifier.summed
    monkeypatch.setattr(classifier, "summed", lambda rows, *a: parts.append(rows.rdd.getNumPartitions()) or of(rows, *a))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        docs, labels = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "labels"))
        fit(with_statistics(docs), labels)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert parts == [spark.sparkContext.defaultParallelism]
