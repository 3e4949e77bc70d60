"""Queries of the neighbourhood, export and model jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from landgrid.operators import neighbourhood as nb
from landgrid.operators import pixels as px
from landgrid.operators.metrics import instance_pairs
from landgrid.plans.raster import offsets_sql, region_sql
from landgrid.plans.registry import query
from landgrid.sources import files


@query("E12_median_filter", "pixels", f"""
WITH n AS (SELECT cell_id, r - dr AS r, c - dc AS c, truth AS o FROM pixels, {offsets_sql(2)}) SELECT p.cell_id, p.r, p.c, CAST(quantile_disc(o, 0.5) AS BIGINT) AS truth FROM pixels p JOIN n USING (cell_id, r, c) GROUP BY ALL""")
def e12(pixels: DataFrame) -> DataFrame:
    return nb.median_filter(pixels, "truth")


@query("J23_sharpen", "pixels", f"""
WITH n AS (SELECT cell_id, r - dr AS r, c - dc AS c, red AS o FROM pixels, {offsets_sql(1)}), b AS (SELECT p.cell_id, p.r, p.c, any_value(red) AS red, avg(o) AS blur FROM pixels p JOIN n USING (cell_id, r, c) GROUP BY ALL)
SELECT cell_id, r, c, round(least(greatest(1.5::DOUBLE * red - 0.5::DOUBLE * blur, 0.0::DOUBLE), 255.0::DOUBLE), 6) AS red FROM b""")
def j23(pixels: DataFrame) -> DataFrame:
    return nb.sharpen(pixels, "red")


@query("J25_bilinear", "pixels", """
WITH p AS (SELECT cell_id, r // 4 AS r, c // 4 AS c, avg(prob_pm) AS prob_pm FROM pixels GROUP BY ALL), f AS (SELECT DISTINCT cell_id, a.i AS r, b.i AS c FROM p, (SELECT unnest(range(64)) i) a, (SELECT unnest(range(64)) i) b),
k AS (SELECT *, (r + 0.5::DOUBLE) / 4 - 0.5::DOUBLE AS y, (c + 0.5::DOUBLE) / 4 - 0.5::DOUBLE AS x FROM f), w AS (SELECT k.cell_id, k.r, k.c, least(greatest(CAST(floor(y) AS BIGINT) + a, 0), 15) AS pr, least(greatest(CAST(floor(x) AS BIGINT) + b, 0), 15) AS pc,
  (CASE WHEN a = 1 THEN y - floor(y) ELSE 1 - (y - floor(y)) END) * (CASE WHEN b = 1 THEN x - floor(x) ELSE 1 - (x - floor(x)) END) AS w FROM k, (SELECT unnest([0, 1]) a), (SELECT unnest([0, 1]) b))
SELECT w.cell_id, w.r, w.c, round(sum(p.prob_pm * w.w), 6) AS prob_pm FROM w JOIN p ON p.cell_id = w.cell_id AND p.r = pr AND p.c = pc GROUP BY ALL""")
def j25(pixels: DataFrame) -> DataFrame:
    return nb.bilinear(px.pool(pixels, 4, "prob_pm").select("cell_id", F.col("pr").alias("r"), F.col("pc").alias("c"), "prob_pm"), "prob_pm", 16, 4)


@query("J8_rasterise", "parcels", """
WITH g AS (SELECT parcel_id, pred_class, gx, unnest(range(CAST(ceil(y0 / 10) AS BIGINT), CAST(ceil(y1 / 10) AS BIGINT))) AS gy FROM (SELECT *, unnest(range(CAST(ceil(x0 / 10) AS BIGINT), CAST(ceil(x1 / 10) AS BIGINT))) AS gx FROM parcels))
SELECT gx, gy, max_by(pred_class, parcel_id) AS pred_class FROM g GROUP BY ALL""")
def j8(parcels: DataFrame) -> DataFrame:
    return nb.rasterise(parcels, 10, "pred_class", "parcel_id")


@query("C21_year_stack", "scores", """
SELECT vec_id, array_to_string(list(CAST(round(v, 6) AS VARCHAR) ORDER BY k) FILTER (k IN (2, 5, 60)), '|') IS NOT NULL AS present, count(*) FILTER (k IN (2, 5, 60, 99)) AS years, round(max(v) FILTER (k = 5), 6) AS second FROM scores GROUP BY 1""")
def c21(scores: DataFrame) -> DataFrame:
    stack = F.sort_array(F.collect_list(F.struct("k", "v")))
    s = scores.where("k IN (2, 5, 60, 99)").groupBy("vec_id").agg(stack.alias("stack"))
    return s.select("vec_id", F.col("stack").isNotNull().alias("present"), F.size("stack").cast("long").alias("years"), F.round(F.col("stack")[1]["v"], 6).alias("second"))


@query("C24_optional_features", "regions completed", """
WITH f AS (SELECT region_id, count(*) AS feat FROM completed WHERE dx % 2 = 0 GROUP BY 1) SELECT county, CAST(sum(coalesce(feat, 0)) AS BIGINT) AS total, count(feat) AS present FROM regions LEFT JOIN f USING (region_id) GROUP BY 1""")
def c24(regions: DataFrame, completed: DataFrame) -> DataFrame:
    f = completed.where("dx % 2 = 0").groupBy("region_id").agg(F.count("*").alias("feat"))
    return regions.join(f, "region_id", "left").groupBy("county").agg(F.sum(F.coalesce("feat", F.lit(0))).alias("total"), F.count("feat").alias("present"))


@query("J17_hole_fill", "pixels", f"""
WITH RECURSIVE near AS (SELECT DISTINCT cell_id, r - dr AS r, c - dc AS c, truth AS k FROM (SELECT * FROM pixels WHERE truth > 0), {offsets_sql(1)}),
wide AS (SELECT p.cell_id, p.r, p.c, k FROM pixels p JOIN near USING (cell_id, r, c)),
around AS (SELECT cell_id, r - dr AS r, c - dc AS c, k FROM wide, {offsets_sql(1)}),
full_ AS (SELECT cell_id, r, c, (1 + (r > 0)::INT + (r < 63)::INT) * (1 + (c > 0)::INT + (c < 63)::INT) AS n FROM pixels WHERE truth = 0),
closed AS (SELECT cell_id, r, c, min(k) AS k FROM (SELECT cell_id, r, c, k, n FROM around JOIN full_ USING (cell_id, r, c) GROUP BY ALL HAVING count(*) = n) GROUP BY ALL),
labels AS (SELECT p.cell_id, p.r, p.c, CASE WHEN truth = 0 THEN coalesce(k, 0) ELSE truth END AS truth FROM pixels p LEFT JOIN closed USING (cell_id, r, c)),
{region_sql('truth', 'truth = 0').replace('FROM pixels', 'FROM labels')},
holes AS (SELECT cell_id, r, unnest(range(a, b + 1)) AS c, region FROM spans JOIN regions USING (cell_id, u)),
sizes AS (SELECT cell_id, region, count(*) AS size FROM holes GROUP BY ALL),
rim AS (SELECT h.cell_id, region, q.truth, count(*) AS n FROM (SELECT cell_id, region, r + dr AS r, c + dc AS c FROM holes, {offsets_sql(1)} WHERE abs(dr) + abs(dc) = 1) h JOIN labels q USING (cell_id, r, c) WHERE q.truth <> 0 GROUP BY ALL),
fills AS (SELECT cell_id, region, max_by(truth, (n, -truth)) AS fill FROM rim GROUP BY ALL)
SELECT cell_id, region, size, fill FROM sizes JOIN fills USING (cell_id, region) WHERE size <= 400""")
def j17(pixels: DataFrame) -> DataFrame:
    return px.small_holes(px.closed(pixels, "truth"), "truth", 400)


@query("E9_greedy_suppression", "pixels")
def e9(pixels: DataFrame) -> DataFrame:
    masks = pixels.select(*px.KEY, F.explode(F.array(F.col("inst_pred"), F.col("inst_gt") + 100)).alias("mask"))
    sizes = masks.groupBy("cell_id", "mask").agg(F.count("*").alias("px"), F.max(F.expr("mask * 7 % 64")).alias("score"))
    both = instance_pairs(pixels, "inst_pred", "inst_gt").select("cell_id", F.col("inst_pred").alias("mask"), (F.col("inst_gt") + 100).alias("other"), "iou")
    pairs = both.union(both.select("cell_id", "other", "mask", "iou"))
    return nb.suppress(sizes, pairs)


@query("J13_seeded_growth", "pixels")
def j13(pixels: DataFrame) -> DataFrame:
    return nb.peak_instances(pixels, "inst_pred", apart=3, least=0.05, area=12)


@query("J14_boundary_seeds", "pixels")
def j14(pixels: DataFrame) -> DataFrame:
    weak = pixels.withColumn("weak", F.when(F.col("prob_pm") >= 220, 1).otherwise(0))
    return nb.hysteresis(px.components(px.closed(weak, "weak"), "weak").select(*px.KEY, "region"), pixels.where("prob_pm >= 980"))


@query("J15_full_coverage", "pixels")
def j15(pixels: DataFrame) -> DataFrame:
    some = pixels.select(*px.KEY, "truth", "inst_pred")
    own = some.where("truth IN (1, 2)").select(*px.KEY, F.col("inst_pred").alias("inst"))
    rest = px.components(some.where("truth NOT IN (0, 1, 2)"), "truth").select(*px.KEY, (F.col("region") + 1000).alias("inst"))
    named = some.select(*px.KEY).join(own.unionByName(rest), px.KEY, "left").select(*px.KEY, F.coalesce("inst", F.lit(0)).alias("inst"))
    return nb.relabel(px.fill_nearest(named, "inst"), "inst")


@query("K5_simplify_rings", "pixels")
def k5(pixels: DataFrame) -> DataFrame:
    from landgrid.operators.outlines import outlines

    return nb.simplify_rings(outlines(pixels, "inst_gt"), 1.0).select("cell_id", "inst_gt", "ring", F.size("xs").alias("vertices"))


@query("A13_annotation_export", "parcels")
def a13(parcels: DataFrame) -> DataFrame:
    return files.annotations(parcels, 512, 30).select("image", "annotation")


@query("A14_polygon_export", "parcels")
def a14(parcels: DataFrame) -> DataFrame:
    return files.normalised_polygons(parcels, 512)


@query("N6_object_classifier", "pixels")
def n6(pixels: DataFrame) -> DataFrame:
    from landgrid.operators.learners import classify_objects

    return classify_objects(pixels)


@query("N7_feature_clusters", "scores")
def n7(scores: DataFrame) -> DataFrame:
    from landgrid.operators.learners import cluster_features

    vectors = scores.groupBy("vec_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "v"))), lambda x: x["v"]).alias("features"))
    return cluster_features(vectors, 80, 7)
