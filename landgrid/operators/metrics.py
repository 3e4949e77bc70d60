"""Scores of predictions. Counts are aggregated once; every metric and every threshold is read from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from landgrid.operators.tiling import first_per_key

EPS = 1e-9


def binary_counts(truth: Column, pred: Column) -> list[Column]:
    return [
        F.count_if(truth & pred).alias("tp"), F.count_if(~truth & pred).alias("fp"),
        F.count_if(truth & ~pred).alias("fn"), F.count_if(~truth & ~pred).alias("tn"),
    ]


def precision_recall(tp: str = "tp", fp: str = "fp", fn: str = "fn") -> dict[str, Column]:
    p, r = F.col(tp) / (F.col(tp) + F.col(fp) + EPS), F.col(tp) / (F.col(tp) + F.col(fn) + EPS)
    return {"precision": p, "recall": r, "f1": 2 * p * r / (p + r + EPS), "iou": F.col(tp) / (F.col(tp) + F.col(fp) + F.col(fn) + EPS)}


def threshold_counts(scored: DataFrame, keys: list[str], truth: Column, score: str, thresholds: list[int]) -> DataFrame:
    """``tp, fp, fn`` of each key and threshold (positive at ``score >= t``).

    Rows are counted once by score bin; a threshold's counts are sums over the bins from it on, so the data is not
    multiplied by the thresholds.
    """
    step = thresholds[1] - thresholds[0] if len(thresholds) > 1 else 1
    if thresholds == list(range(thresholds[0], thresholds[0] + step * len(thresholds), step)):
        of = F.least(F.greatest(F.floor((F.col(score) - thresholds[0]) / step) + 1, F.lit(0)), F.lit(len(thresholds)))
    else:
        of = F.size(F.filter(F.array(*map(F.lit, thresholds)), lambda t: t <= F.col(score)))
    bins = scored.groupBy(*keys, of.cast("int").alias("bin")).agg(F.count_if(truth).alias("pos"), F.count_if(~truth).alias("neg"))
    lists = bins.groupBy(*keys).agg(F.collect_list(F.struct("bin", "pos", "neg")).alias("bins"))
    grid = lists.select(*keys, "bins", F.posexplode(F.array(*map(F.lit, thresholds))).alias("i", "t"))
    total = lambda what, which: F.expr(f"aggregate(filter(bins, b -> {which}), 0L, (s, b) -> s + b.{what})")
    return grid.select(*keys, "t", total("pos", "b.bin > i").alias("tp"), total("neg", "b.bin > i").alias("fp"), total("pos", "b.bin <= i").alias("fn"))


def best_threshold(counts: DataFrame, keys: list[str]) -> DataFrame:
    """The threshold with the best F1 of each key, the first of equals."""
    f1 = F.round(precision_recall()["f1"], 9)
    return counts.withColumn("f1", f1).groupBy(*keys).agg(F.max_by("t", F.struct("f1", (-F.col("t")).alias("k"))).alias("t"), F.max("f1").alias("f1"))


def leave_one_out(counts: DataFrame, group: str) -> DataFrame:
    """For each group the threshold that is best on all others, with its counts on the group. Others = total minus own, by a window; no loop."""
    w = Window.partitionBy("t")
    others = counts.select(group, "t", "tp", "fp", "fn", *[(F.sum(c).over(w) - F.col(c)).alias(f"o_{c}") for c in ("tp", "fp", "fn")])
    f1 = F.round(precision_recall("o_tp", "o_fp", "o_fn")["f1"], 9)
    return first_per_key(others.withColumn("of1", f1), [group], F.desc("of1"), F.col("t")).select(group, "t", "tp", "fp", "fn")


def class_metrics(confusion: DataFrame, truth: str, pred: str) -> DataFrame:
    """Per class: tp, fp, fn and the scores; class 0 of the truth is nodata and left out."""
    c = confusion.where(F.col(truth) > 0)
    side = lambda col, n: c.groupBy(F.col(col).alias("cls")).agg(F.sum("n").alias(n), F.sum(F.when(F.col(truth) == F.col(pred), F.col("n")).otherwise(0)).alias(f"{n}_tp"))
    both = side(truth, "t").join(side(pred, "p"), "cls", "full").fillna(0).where("cls > 0")
    both = both.select("cls", F.greatest("t_tp", "p_tp").alias("tp"), (F.col("p") - F.col("p_tp")).alias("fp"), (F.col("t") - F.col("t_tp")).alias("fn"))
    return both.select("*", *[F.round(v, 6).alias(k) for k, v in precision_recall().items()])


def kappa(counts: DataFrame, a: str, b: str) -> DataFrame:
    """Overall agreement and Cohen's kappa of two labelings, from their pair counts. Class 0 counts."""
    n = counts.agg(F.sum("n").alias("n"), F.sum(F.when(F.col(a) == F.col(b), F.col("n")).otherwise(0)).alias("same"))
    left = counts.groupBy(F.col(a).alias("k")).agg(F.sum("n").alias("x"))
    right = counts.groupBy(F.col(b).alias("k")).agg(F.sum("n").alias("y"))
    chance = left.join(right, "k").agg(F.sum(F.col("x") * F.col("y")).alias("xy"))
    po, pe = F.col("same") / F.col("n"), F.col("xy") / (F.col("n") * F.col("n"))
    return n.crossJoin(F.broadcast(chance)).select(F.round(po, 6).alias("agreement"), F.round((po - pe) / (1 - pe), 6).alias("kappa"))


def instance_pairs(pixels: DataFrame, pred: str, truth: str) -> DataFrame:
    """IoU of every pair of instances that share a pixel, from their joint histogram."""
    inter = pixels.groupBy("cell_id", pred, truth).agg(F.count("*").alias("n"))
    total = lambda k: F.sum("n").over(Window.partitionBy("cell_id", k))
    pairs = inter.withColumns({"na": total(pred), "nb": total(truth)}).dropna(subset=["cell_id", pred, truth])
    return pairs.withColumn("iou", F.col("n") / (F.col("na") + F.col("nb") - F.col("n")))


def match_instances(pairs: DataFrame, pred: str, truth: str, least: float = 0.5) -> DataFrame:
    """One-to-one matches. Above one half at most one partner can exceed the limit on either side, so greedy matching is a
    filter; pairs at exactly one half, which could tie, are matched by rank from both sides."""
    good = pairs.where(F.col("iou") >= least)
    rank = lambda k, o: F.row_number().over(Window.partitionBy("cell_id", k).orderBy(F.desc("iou"), o))
    return good.withColumns({"ra": rank(pred, truth), "rb": rank(truth, pred)}).where("ra = 1 AND rb = 1").drop("ra", "rb")
