"""Evaluation queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from landgrid.operators import metrics as mt
from landgrid.operators import pixels as px
from landgrid.plans.raster import _edges
from landgrid.plans.registry import query

TS = list(range(150, 875, 25))
TSQL = f"(SELECT unnest([{', '.join(map(str, TS))}]) AS t)"


def crop() -> Column:
    return F.col("truth").isin(1, 2)



def _prf(tp: str = "tp", fp: str = "fp", fn: str = "fn") -> str:
    p, r = f"({tp} / ({tp} + {fp} + 1e-9))", f"({tp} / ({tp} + {fn} + 1e-9))"
    return f"(2 * {p} * {r} / ({p} + {r} + 1e-9))"


ROUNDED = lambda tp="tp", fp="fp", fn="fn": f"round({tp} / ({tp} + {fp} + 1e-9), 6) AS precision, round({tp} / ({tp} + {fn} + 1e-9), 6) AS recall, round({_prf(tp, fp, fn)}, 6) AS f1, round({tp} / ({tp} + {fp} + {fn} + 1e-9), 6) AS iou"


@query("L1_binary_scores", "pixels", f"""
WITH c AS (SELECT cell_id, count(*) FILTER (t AND p) AS tp, count(*) FILTER (NOT t AND p) AS fp, count(*) FILTER (t AND NOT p) AS fn, count(*) FILTER (NOT t AND NOT p) AS tn
  FROM (SELECT cell_id, truth IN (1, 2) AS t, pred IN (1, 2) AS p FROM pixels WHERE truth > 0) GROUP BY 1) SELECT cell_id, tp, fp, fn, tn, {ROUNDED()}, round((tp + tn) / (tp + fp + fn + tn), 6) AS accuracy FROM c""")
def l1(pixels: DataFrame) -> DataFrame:
    c = pixels.where("truth > 0").groupBy("cell_id").agg(*mt.binary_counts(crop(), F.col("pred").isin(1, 2)))
    return c.select("*", *[F.round(v, 6).alias(k) for k, v in mt.precision_recall().items()], F.round(F.expr("(tp + tn) / (tp + fp + fn + tn)"), 6).alias("accuracy"))


CONF = "n AS (SELECT truth, pred, count(*) AS n FROM pixels WHERE truth > 0 GROUP BY ALL)"
PER = f"""{CONF}, t AS (SELECT truth AS cls, sum(n) AS t FROM n GROUP BY 1), p AS (SELECT pred AS cls, sum(n) AS p FROM n GROUP BY 1), d AS (SELECT truth AS cls, sum(n) AS d FROM n WHERE truth = pred GROUP BY 1),
per AS (SELECT cls, CAST(coalesce(d, 0) AS BIGINT) AS tp, CAST(coalesce(p, 0) - coalesce(d, 0) AS BIGINT) AS fp, CAST(coalesce(t, 0) - coalesce(d, 0) AS BIGINT) AS fn FROM t FULL JOIN p USING (cls) LEFT JOIN d USING (cls) WHERE cls > 0)"""


def _conf(pixels: DataFrame) -> DataFrame:
    return pixels.where("truth > 0").groupBy("truth", "pred").agg(F.count("*").alias("n"))


@query("L2_class_iou", "pixels", f"WITH {PER} SELECT cls, round(tp / (tp + fp + fn + 1e-9), 6) AS iou FROM per")
def l2(pixels: DataFrame) -> DataFrame:
    return mt.class_metrics(_conf(pixels), "truth", "pred").select("cls", "iou")


@query("L3_class_f1", "pixels", f"WITH {PER} SELECT cls, tp, fp, fn, {ROUNDED()} FROM per")
def l3(pixels: DataFrame) -> DataFrame:
    return mt.class_metrics(_conf(pixels), "truth", "pred")


@query("L3_top_confusions", "pixels", f"""
WITH {CONF}, s AS (SELECT truth, pred, n / sum(n) OVER (PARTITION BY truth) AS share FROM n) SELECT truth, pred, round(share, 6) AS share, rank FROM (
SELECT *, row_number() OVER (PARTITION BY truth ORDER BY share DESC, pred) AS rank FROM s WHERE truth <> pred AND share > 0.05::DOUBLE) WHERE rank <= 3""")
def l3_top(pixels: DataFrame) -> DataFrame:
    s = _conf(pixels).withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("truth"))).where("truth <> pred AND share > 0.05D")
    rank = F.row_number().over(Window.partitionBy("truth").orderBy(F.desc("share"), "pred"))
    return s.withColumn("rank", rank).where("rank <= 3").select("truth", "pred", F.round("share", 6).alias("share"), "rank")


@query("L4_kappa", "pixels", """
WITH n AS (SELECT truth, pred, count(*) AS n FROM pixels GROUP BY ALL), a AS (SELECT truth AS k, sum(n) AS x FROM n GROUP BY 1), b AS (SELECT pred AS k, sum(n) AS y FROM n GROUP BY 1),
s AS (SELECT (SELECT sum(n) FROM n) AS n, (SELECT sum(n) FROM n WHERE truth = pred) AS same, (SELECT sum(x * y) FROM a JOIN b USING (k)) AS xy)
SELECT round(same / n, 6) AS agreement, round((same / n - xy / (n * n)) / (1 - xy / (n * n)), 6) AS kappa FROM s""")
def l4(pixels: DataFrame) -> DataFrame:
    return mt.kappa(pixels.groupBy("truth", "pred").agg(F.count("*").alias("n")), "truth", "pred")


@query("L5_merged_reevaluation", "pixels", f"""
WITH m AS (SELECT cell_id, CASE truth WHEN 2 THEN 1 ELSE truth END AS t, CASE pred WHEN 2 THEN 1 ELSE pred END AS p FROM pixels WHERE truth > 0),
c AS (SELECT count(*) FILTER (t = 1 AND p = 1) AS tp, count(*) FILTER (t <> 1 AND p = 1) AS fp, count(*) FILTER (t = 1 AND p <> 1) AS fn, round(count(*) FILTER (t = p) / count(*), 6) AS oa FROM m) SELECT oa, {ROUNDED()} FROM c""")
def l5(pixels: DataFrame) -> DataFrame:
    m = pixels.where("truth > 0").selectExpr("IF(truth = 2, 1, truth) AS t", "IF(pred = 2, 1, pred) AS p")
    c = m.agg(*mt.binary_counts(F.col("t") == 1, F.col("p") == 1), F.round(F.count_if(F.expr("t = p")) / F.count("*"), 6).alias("oa"))
    return c.select("oa", *[F.round(v, 6).alias(k) for k, v in mt.precision_recall().items()])


SWEEP = f"c AS (SELECT county, t, count(*) FILTER (truth IN (1, 2) AND prob_pm >= t) AS tp, count(*) FILTER (truth NOT IN (1, 2) AND prob_pm >= t) AS fp, count(*) FILTER (truth IN (1, 2) AND prob_pm < t) AS fn FROM pixels, {TSQL} WHERE truth > 0 GROUP BY ALL)"


def _sweep(pixels: DataFrame) -> DataFrame:
    return mt.threshold_counts(pixels.where("truth > 0"), ["county"], crop(), "prob_pm", TS)


@query("L6_threshold_sweep", "pixels", f"WITH {SWEEP} SELECT county, t, tp, fp, fn, {ROUNDED()} FROM c")
def l6(pixels: DataFrame) -> DataFrame:
    return _sweep(pixels).select("county", "t", "tp", "fp", "fn", *[F.round(v, 6).alias(k) for k, v in mt.precision_recall().items()])


@query("L7_best_threshold", "pixels", f"""
WITH {SWEEP}, g AS (SELECT t, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(fn) AS BIGINT) AS fn FROM c GROUP BY 1), f AS (SELECT t, round({_prf()}, 9) AS f1 FROM g)
SELECT max_by(t, (f1, -t)) AS t, max(f1) AS f1 FROM f""")
def l7(pixels: DataFrame) -> DataFrame:
    counts = mt.threshold_counts(pixels.where("truth > 0").withColumn("every", F.lit(1)), ["every"], crop(), "prob_pm", TS)
    return mt.best_threshold(counts, ["every"]).select("t", "f1")


@query("L8_leave_county_out", "pixels", f"""
WITH {SWEEP}, o AS (SELECT *, CAST(sum(tp) OVER w AS BIGINT) - tp AS otp, CAST(sum(fp) OVER w AS BIGINT) - fp AS ofp, CAST(sum(fn) OVER w AS BIGINT) - fn AS ofn FROM c WINDOW w AS (PARTITION BY t)),
k AS (SELECT *, row_number() OVER (PARTITION BY county ORDER BY round({_prf('otp', 'ofp', 'ofn')}, 9) DESC, t) AS rank FROM o) SELECT county, t, tp, fp, fn FROM k WHERE rank = 1""")
def l8(pixels: DataFrame) -> DataFrame:
    return mt.leave_one_out(_sweep(pixels), "county")


@query("L9_ensemble_combos", "scores", """
WITH m(combo, member) AS (VALUES ('a', 0), ('b', 1), ('ab', 0), ('ab', 1), ('all', 0), ('all', 1), ('all', 2), ('all', 3), ('all', 4), ('all', 5), ('all', 6)),
e AS (SELECT combo, vec_id, label, k % 9 AS cls, round(avg(v), 9) AS p FROM scores JOIN m ON k // 9 = member GROUP BY ALL), b AS (SELECT combo, vec_id, label, max_by(cls, (p, -cls)) AS cls FROM e GROUP BY ALL)
SELECT combo, count(*) AS n, count(*) FILTER (label % 9 = cls) AS hits FROM b GROUP BY 1""")
def l9(scores: DataFrame) -> DataFrame:
    members = {"a": [0], "b": [1], "ab": [0, 1], "all": list(range(7))}
    of = F.filter(F.array(*[F.struct(F.lit(c).alias("combo"), F.array(*map(F.lit, m)).alias("m")) for c, m in members.items()]), lambda x: F.array_contains(x["m"], F.expr("cast(k div 9 as int)")))
    rows = scores.select("vec_id", "label", (F.col("k") % 9).alias("cls"), "v", F.explode(of).alias("x"))
    e = rows.groupBy("x.combo", "vec_id", "label", "cls").agg(F.round(F.avg("v"), 9).alias("p"))
    b = e.groupBy("combo", "vec_id", "label").agg(F.max_by("cls", F.struct("p", (-F.col("cls")).alias("k"))).alias("cls"))
    return b.groupBy("combo").agg(F.count("*").alias("n"), F.count_if(F.expr("label % 9 = cls")).alias("hits"))


@query("L10_macro_by_cell", "pixels", f"""
WITH c AS (SELECT cell_id, county, count(*) FILTER (t AND p) AS tp, count(*) FILTER (NOT t AND p) AS fp, count(*) FILTER (t AND NOT p) AS fn FROM (SELECT cell_id, county, truth IN (1, 2) AS t, pred IN (1, 2) AS p FROM pixels WHERE truth > 0) GROUP BY ALL)
SELECT county, count(*) AS cells, round(avg({_prf()}), 6) AS f1 FROM c WHERE tp + fp + fn > 0 GROUP BY 1""")
def l10(pixels: DataFrame) -> DataFrame:
    c = pixels.where("truth > 0").groupBy("cell_id", "county").agg(*mt.binary_counts(crop(), F.col("pred").isin(1, 2))).where("tp + fp + fn > 0")
    return c.groupBy("county").agg(F.count("*").alias("cells"), F.round(F.avg(mt.precision_recall()["f1"]), 6).alias("f1"))


@query("L14_object_completeness", "pixels", """
WITH o AS (SELECT cell_id, inst_gt, count(*) AS n, count(*) FILTER (pred = truth) / count(*) AS recall FROM pixels WHERE truth > 0 GROUP BY ALL HAVING count(*) >= 4), t AS (SELECT unnest([0.5, 0.8, 0.9, 1.0])::DOUBLE AS t)
SELECT t, round(100 * count(*) FILTER (recall < t) / count(*), 6) AS pct_objects, round(100 * coalesce(sum(n) FILTER (recall < t), 0) / sum(n), 6) AS pct_area FROM o, t GROUP BY t""")
def l14(pixels: DataFrame) -> DataFrame:
    o = pixels.where("truth > 0").groupBy("cell_id", "inst_gt").agg(F.count("*").alias("n"), (F.count_if(F.expr("pred = truth")) / F.count("*")).alias("recall")).where("n >= 4")
    rows = o.select("*", F.explode(F.array(*map(F.lit, (0.5, 0.8, 0.9, 1.0)))).alias("t"))
    return rows.groupBy("t").agg(F.round(100 * F.count_if(F.expr("recall < t")) / F.count("*"), 6).alias("pct_objects"), F.round(100 * F.sum(F.expr("IF(recall < t, n, 0)")) / F.sum("n"), 6).alias("pct_area"))


PAIRS = """x AS (SELECT cell_id, inst_pred, inst_gt, count(*) AS n FROM pixels GROUP BY ALL), j AS (SELECT *, n / (sum(n) OVER (PARTITION BY cell_id, inst_pred) + sum(n) OVER (PARTITION BY cell_id, inst_gt) - n) AS iou FROM x)"""


@query("L15_instance_matching", "pixels", f"WITH {PAIRS} SELECT cell_id, inst_pred, inst_gt, n, round(iou, 6) AS iou FROM j WHERE iou > 0.4::DOUBLE AND iou >= 0.5::DOUBLE OR iou >= 0.5::DOUBLE")
def l15(pixels: DataFrame) -> DataFrame:
    matched = mt.match_instances(mt.instance_pairs(pixels, "inst_pred", "inst_gt"), "inst_pred", "inst_gt")
    return matched.select("cell_id", "inst_pred", "inst_gt", "n", F.round("iou", 6).alias("iou"))


@query("L16_over_under_segmentation", "pixels", f"""
WITH {PAIRS}, g AS (SELECT cell_id, inst_gt, count(*) FILTER (iou > 0.1::DOUBLE) AS k FROM j GROUP BY ALL), p AS (SELECT cell_id, inst_pred, count(*) FILTER (iou > 0.1::DOUBLE) AS k FROM j GROUP BY ALL)
SELECT cell_id, round(avg(k), 6) AS over_seg, (SELECT round(avg(k), 6) FROM p WHERE p.cell_id = g.cell_id AND k > 0) AS under_seg FROM g WHERE k > 0 GROUP BY cell_id""")
def l16(pixels: DataFrame) -> DataFrame:
    j = mt.instance_pairs(pixels, "inst_pred", "inst_gt").where("iou > 0.1D")
    # Every instance of a cell's pairs counts once: pairs over instances is the mean number of partners.
    mean = lambda k: F.round(F.count("*") / F.countDistinct(k), 6)
    return j.groupBy("cell_id").agg(mean("inst_gt").alias("over_seg"), mean("inst_pred").alias("under_seg"))


@query("L17_detection_by_size", "pixels", f"""
WITH {PAIRS}, g AS (SELECT cell_id, inst_gt, sum(n) AS size, max(iou) AS best FROM j GROUP BY ALL), s AS (SELECT unnest([0, 16, 32, 64]) AS least) SELECT CAST(least AS INT) AS least, count(*) AS objects, count(*) FILTER (best >= 0.5::DOUBLE) AS found FROM g JOIN s ON size >= least GROUP BY 1""")
def l17(pixels: DataFrame) -> DataFrame:
    g = mt.instance_pairs(pixels, "inst_pred", "inst_gt").groupBy("cell_id", "inst_gt").agg(F.first("nb").alias("size"), F.max("iou").alias("best"))
    sizes = F.filter(F.array(*map(F.lit, (0, 16, 32, 64))), lambda s: s <= F.col("size"))
    return g.select("best", F.explode(sizes).alias("least")).groupBy("least").agg(F.count("*").alias("objects"), F.count_if(F.expr("best >= 0.5D")).alias("found"))


_DISC = "(SELECT a.i AS a, b.i AS b FROM (SELECT unnest(range(-2, 3)) i) a, (SELECT unnest(range(-2, 3)) i) b WHERE a.i * a.i + b.i * b.i <= 4)"


@query("L18_boundary_f1", "pixels", f"""
WITH p AS {_edges('inst_pred')}, g AS {_edges('inst_gt')}, dp AS (SELECT DISTINCT cell_id, r + a AS r, c + b AS c FROM p, {_DISC}), dg AS (SELECT DISTINCT cell_id, r + a AS r, c + b AS c FROM g, {_DISC}),
h AS (SELECT cell_id, count(*) AS n, count(*) FILTER (EXISTS (SELECT 1 FROM dg WHERE dg.cell_id = p.cell_id AND dg.r = p.r AND dg.c = p.c)) AS hit FROM p GROUP BY 1),
k AS (SELECT cell_id, count(*) AS n, count(*) FILTER (EXISTS (SELECT 1 FROM dp WHERE dp.cell_id = g.cell_id AND dp.r = g.r AND dp.c = g.c)) AS hit FROM g GROUP BY 1)
SELECT cell_id, round(h.hit / h.n, 6) AS precision, round(k.hit / k.n, 6) AS recall FROM h JOIN k USING (cell_id)""".replace(
    "count(*) FILTER (EXISTS (SELECT 1 FROM dg WHERE dg.cell_id = p.cell_id AND dg.r = p.r AND dg.c = p.c)) AS hit FROM p GROUP BY 1", "count(dg.r) AS hit FROM p LEFT JOIN dg USING (cell_id, r, c) GROUP BY 1").replace(
    "count(*) FILTER (EXISTS (SELECT 1 FROM dp WHERE dp.cell_id = g.cell_id AND dp.r = g.r AND dp.c = g.c)) AS hit FROM g GROUP BY 1", "count(dp.r) AS hit FROM g LEFT JOIN dp USING (cell_id, r, c) GROUP BY 1"))
def l18(pixels: DataFrame) -> DataFrame:
    both = pixels.select(*px.KEY, px.differs("inst_pred").alias("p"), px.differs("inst_gt").alias("g"))
    both = px.within(both, ["p", "g"], 2)
    share = lambda mask, near: F.round(F.count_if(F.col(mask) & F.col(near)) / F.count_if(mask), 6)
    return both.groupBy("cell_id").agg(F.count_if("p").alias("np"), F.count_if("g").alias("ng"), share("p", "near_g").alias("precision"), share("g", "near_p").alias("recall")).where("np > 0 AND ng > 0").drop("np", "ng")


@query("L19_veto_relabel", "pixels", """
WITH n AS (SELECT cell_id, inst_pred, pred, count(*) AS n FROM pixels GROUP BY ALL), b AS (SELECT cell_id, inst_pred, max_by(pred, (n, -pred)) AS cls FROM n GROUP BY ALL)
SELECT cell_id, inst_pred, row_number() OVER (PARTITION BY cell_id ORDER BY inst_pred) AS new_id FROM b WHERE cls IN (1, 2)""")
def l19(pixels: DataFrame) -> DataFrame:
    kept = px.majority(pixels, ["cell_id", "inst_pred"], "pred").where("pred IN (1, 2)")
    return kept.select("cell_id", "inst_pred", F.row_number().over(Window.partitionBy("cell_id").orderBy("inst_pred")).alias("new_id"))


@query("L22_index_threshold_sweep", "pixels", """
WITH i AS (SELECT cell_id, inst_pred, avg(grn - red) AS s FROM pixels GROUP BY ALL), t AS (SELECT unnest([-50, 0, 25, 50]) AS t)
SELECT CAST(t AS INT) AS t, count(*) FILTER (s > t AND truth IN (1, 2)) AS tp, count(*) FILTER (s > t AND truth NOT IN (1, 2)) AS fp, count(*) FILTER (s <= t AND truth IN (1, 2)) AS fn FROM pixels JOIN i USING (cell_id, inst_pred), t WHERE truth > 0 GROUP BY 1""")
def l22(pixels: DataFrame) -> DataFrame:
    i = pixels.groupBy("cell_id", "inst_pred").agg(F.avg(F.col("grn") - F.col("red")).alias("s"))
    marks = F.array(*map(F.lit, (-50, 0, 25, 50)))
    sizes = pixels.where("truth > 0").groupBy("cell_id", "inst_pred").agg(F.count_if(crop()).alias("pos"), F.count_if(~crop()).alias("neg"))
    rows = sizes.join(i, ["cell_id", "inst_pred"]).select("pos", "neg", "s", F.explode(marks).alias("t"))
    at = lambda c, on: F.sum(F.when(F.col("s") > F.col("t") if on else F.col("s") <= F.col("t"), F.col(c)).otherwise(0))
    return rows.groupBy("t").agg(at("pos", True).alias("tp"), at("neg", True).alias("fp"), at("pos", False).alias("fn"))


@query("D27_route_ranking", "pixels", """
SELECT county, round(count(*) FILTER (pred = truth) / count(*), 6) AS accuracy FROM pixels WHERE truth > 0 GROUP BY 1 ORDER BY accuracy DESC, county""")
def d27(pixels: DataFrame) -> DataFrame:
    a = pixels.where("truth > 0").groupBy("county").agg(F.round(F.count_if(F.expr("pred = truth")) / F.count("*"), 6).alias("accuracy"))
    return a.orderBy(F.desc("accuracy"), "county")


@query("M6_hard_example_weights", "pixels", """
SELECT cell_id, round(1 + 2 * count(*) FILTER ((truth IN (1, 2)) <> (pred IN (1, 2))) / count(*), 6) AS weight FROM pixels WHERE truth > 0 GROUP BY 1""")
def m6w(pixels: DataFrame) -> DataFrame:
    wrong = F.count_if(crop() != F.col("pred").isin(1, 2))
    return pixels.where("truth > 0").groupBy("cell_id").agg(F.round(1 + 2 * wrong / F.count("*"), 6).alias("weight"))


@query("H6_metric_pivot", "pixels", """
SELECT cell_id, count(*) FILTER (truth = 1) AS c1, count(*) FILTER (truth = 2) AS c2, count(*) FILTER (truth = 3) AS c3 FROM pixels WHERE truth IN (1, 2, 3) GROUP BY 1""")
def h6(pixels: DataFrame) -> DataFrame:
    named = pixels.where("truth IN (1, 2, 3)").select("cell_id", F.concat(F.lit("c"), "truth").alias("k"))
    return named.groupBy("cell_id").pivot("k", ["c1", "c2", "c3"]).count().fillna(0)
