"""Queries over parcels as rectangles and rings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from landgrid.functions import landuse as lu
from landgrid.functions import mercator as m
from landgrid.functions import rings as rg
from landgrid.operators import spatial as sp
from landgrid.operators import survey as sv
from landgrid.plans.registry import query
from landgrid.plans.survey import FIVE, NAMES

A = "(x1 - x0) * (y1 - y0)"
PER = "2 * (x1 - x0 + y1 - y0)"
PAIRS = """pairs AS (SELECT a.parcel_id AS u, b.parcel_id AS v, (least(a.x1, b.x1) - greatest(a.x0, b.x0)) * (least(a.y1, b.y1) - greatest(a.y0, b.y0)) AS area
  FROM parcels a JOIN parcels b ON a.parcel_id < b.parcel_id AND a.x0 < b.x1 AND b.x0 < a.x1 AND a.y0 < b.y1 AND b.y0 < a.y1 WHERE a.x1 > a.x0 AND b.x1 > b.x0)"""


def _cells(parcels: DataFrame) -> DataFrame:
    """Download cells, one for each county."""
    k = parcels.select((F.col("county")).alias("k")).distinct()
    return k.select((F.col("k") * 7).alias("cell"), F.expr("k * 487 % 19000").alias("x0"), F.expr("k * 389 % 19000").alias("y0"), F.expr("k * 487 % 19000 + 700").alias("x1"), F.expr("k * 389 % 19000 + 900").alias("y1"))


CELLS = "cells AS (SELECT k * 7 AS cell, k * 487 % 19000 AS x0, k * 389 % 19000 AS y0, k * 487 % 19000 + 700 AS x1, k * 389 % 19000 + 900 AS y1 FROM (SELECT DISTINCT county AS k FROM parcels))"


def _ring(parcels: DataFrame) -> DataFrame:
    return parcels.withColumn("ring", rg.box_ring("x0", "y0", "x1", "y1"))


@query("A2_layer_bbox", "parcels", "SELECT block_id, count(*) AS features, min_by(x0, parcel_id) AS w, min_by(y0, parcel_id) AS s, min_by(x1, parcel_id) AS e, min_by(y1, parcel_id) AS n FROM parcels GROUP BY 1")
def a2(parcels: DataFrame) -> DataFrame:
    first = F.min_by(F.struct(F.col("x0").alias("w"), F.col("y0").alias("s"), F.col("x1").alias("e"), F.col("y1").alias("n")), "parcel_id")
    return parcels.groupBy("block_id").agg(F.count("*").alias("features"), first.alias("b")).select("block_id", "features", "b.*")


@query("A3_layer_extents", "parcels", "SELECT county, min(x0) AS w, min(y0) AS s, max(x1) AS e, max(y1) AS n FROM parcels GROUP BY 1")
def a3(parcels: DataFrame) -> DataFrame:
    return parcels.groupBy("county").agg(F.min("x0").alias("w"), F.min("y0").alias("s"), F.max("x1").alias("e"), F.max("y1").alias("n"))


@query("B31_physical_area", "parcels", f"SELECT parcel_id, round({A} * pow(111320 * cos(radians(30 + county / 10)) * 0.0001::DOUBLE, 2), 6) AS m2 FROM parcels")
def b31(parcels: DataFrame) -> DataFrame:
    side = 111320 * F.cos(F.radians(30 + F.col("county") / 10)) * 0.0001
    return parcels.select("parcel_id", F.round(F.expr(A) * F.pow(side, F.lit(2)), 6).alias("m2"))


@query("B32_ring_extents", "parcels", "SELECT parcel_id, CAST(x0 AS DOUBLE) AS w, CAST(y0 AS DOUBLE) AS s, CAST(x1 AS DOUBLE) AS e, CAST(y1 AS DOUBLE) AS n FROM parcels")
def b32(parcels: DataFrame) -> DataFrame:
    return _ring(parcels).select("parcel_id", *[v.alias(k) for k, v in rg.ring_extent(F.col("ring")).items()])


@query("B33_ring_measures", "parcels", f"SELECT parcel_id, CAST({A} AS DOUBLE) AS area, CAST({PER} AS DOUBLE) AS perimeter, round({A} / ({PER}), 6) AS width, round(CAST({PER} AS DOUBLE) * ({PER}) / ({A}), 6) AS ratio, 5 AS vertices FROM parcels")
def b33(parcels: DataFrame) -> DataFrame:
    r = _ring(parcels).select("parcel_id", rg.ring_area(F.col("ring")).alias("area"), rg.ring_perimeter(F.col("ring")).alias("perimeter"), F.size("ring").alias("vertices"))
    return r.select("parcel_id", "area", "perimeter", F.round(F.expr("area / perimeter"), 6).alias("width"), F.round(F.expr("perimeter * perimeter / area"), 6).alias("ratio"), "vertices")


@query("B34_sliver_predicate", "parcels", f"SELECT parcel_id, {A} <= 0 OR ({A} / ({PER}) < 1.5::DOUBLE AND {A} < 100) AS sliver FROM parcels")
def b34(parcels: DataFrame) -> DataFrame:
    return parcels.select("parcel_id", sp.is_sliver(F.expr(A), F.expr(PER)).alias("sliver"))


@query("B35_linear_giant", "parcels", f"SELECT parcel_id, (x1 - x0) >= 40 AND CAST({PER} AS DOUBLE) * ({PER}) / ({A}) >= 100 AS giant FROM parcels")
def b35(parcels: DataFrame) -> DataFrame:
    return parcels.select("parcel_id", F.expr(f"(x1 - x0) >= 40 AND cast({PER} AS double) * ({PER}) / ({A}) >= 100").alias("giant"))


@query("B36_packed_cell_id", "parcels", "SELECT parcel_id, x0 // 50 AS gx, y0 // 50 AS gy, x0 // 50 * 100000 + (y0 // 50) % 100000 AS packed FROM parcels")
def b36(parcels: DataFrame) -> DataFrame:
    rows = parcels.select("parcel_id", F.expr("x0 div 50").alias("gx"), F.expr("y0 div 50").alias("gy"))
    return rows.withColumn("packed", F.col("gx") * 100000 + F.pmod("gy", F.lit(100000)))


@query("B38_chaikin_ring", "parcels", f"SELECT parcel_id, 9 AS vertices, round({A} - 4 * ((x1 - x0) / 4 * ((y1 - y0) / 4) / 2), 6) AS area FROM parcels")
def b38(parcels: DataFrame) -> DataFrame:
    cut = _ring(parcels).select("parcel_id", rg.chaikin(F.col("ring")).alias("ring"))
    return cut.select("parcel_id", F.size("ring").alias("vertices"), F.round(rg.ring_area(F.col("ring")), 6).alias("area"))


@query("C4_bbox_range_join", "parcels", f"WITH {CELLS} SELECT cell, parcel_id FROM cells c JOIN parcels p ON p.x0 <= c.x1 AND p.x1 >= c.x0 AND p.y0 <= c.y1 AND p.y1 >= c.y0")
def c4(parcels: DataFrame) -> DataFrame:
    pairs = sp.overlap_join(parcels.select("parcel_id", *sp.BOX), _cells(parcels), 256)
    return pairs.select(F.col("b_cell").alias("cell"), "parcel_id")


@query("C5_intersects", "parcels", f"WITH {CELLS} SELECT cell, parcel_id FROM cells c JOIN parcels p ON p.x0 < c.x1 AND p.x1 > c.x0 AND p.y0 < c.y1 AND p.y1 > c.y0")
def c5(parcels: DataFrame) -> DataFrame:
    pairs = sp.overlap_join(parcels.select("parcel_id", *sp.BOX), _cells(parcels), 256, on="x0 < b_x1 AND x1 > b_x0 AND y0 < b_y1 AND y1 > b_y0")
    return pairs.select(F.col("b_cell").alias("cell"), "parcel_id")


@query("C6_clip_class_area", "parcels", f"""
WITH {CELLS} SELECT cell, {FIVE} AS cls, CAST(sum((least(p.x1, c.x1) - greatest(p.x0, c.x0)) * (least(p.y1, c.y1) - greatest(p.y0, c.y0))) AS BIGINT) AS area
FROM cells c JOIN parcels p ON p.x0 < c.x1 AND p.x1 > c.x0 AND p.y0 < c.y1 AND p.y1 > c.y0 GROUP BY ALL""")
def c6(parcels: DataFrame) -> DataFrame:
    pairs = sp.overlap_join(parcels.select("dlbm", *sp.BOX), _cells(parcels), 256).withColumn("area", sp.overlap_area()).where("area > 0")
    return pairs.groupBy(F.col("b_cell").alias("cell"), lu.five_class("dlbm").alias("cls")).agg(F.sum("area").alias("area"))


POINTS = "pts AS (SELECT parcel_id, (x0 + x1) // 2 AS px, (y0 + y1) // 2 AS py FROM parcels)"


def _centres(parcels: DataFrame) -> DataFrame:
    return parcels.select("parcel_id", F.expr("(x0 + x1) div 2").alias("px"), F.expr("(y0 + y1) div 2").alias("py"))


@query("C7_point_in_polygon_semi", "parcels", f"WITH {CELLS}, {POINTS} SELECT parcel_id FROM pts SEMI JOIN cells ON px >= x0 AND px < x1 AND py >= y0 AND py < y1")
def c7(parcels: DataFrame) -> DataFrame:
    return sp.contains_point(_centres(parcels), _cells(parcels), 256).select("parcel_id").distinct()


@query("C8_block_ownership", "parcels", f"WITH {POINTS} SELECT parcel_id, px // 1200 AS bx, py // 1200 AS \"by\" FROM pts")
def c8(parcels: DataFrame) -> DataFrame:
    # A regular half-open lattice is an equality on the floor, so no range join is needed.
    return _centres(parcels).select("parcel_id", F.expr("px div 1200").alias("bx"), F.expr("py div 1200").alias("by"))


@query("C9_overlapping_pairs", "parcels", f"WITH {PAIRS} SELECT u, v, area FROM pairs")
def c9(parcels: DataFrame) -> DataFrame:
    return sp.overlapping_pairs(parcels).select(F.col("parcel_id").alias("u"), F.col("b_parcel_id").alias("v"), "area")


SLIVER = f"f AS (SELECT parcel_id, x0, y0, x1, y1, {A} AS area, {A} <= 0 OR ({A} / ({PER}) < 1.5::DOUBLE AND {A} < 100) AS sliver FROM parcels)"


@query("C10_sliver_neighbours", "parcels", f"""
WITH {SLIVER} SELECT a.parcel_id, b.parcel_id AS neighbour FROM f a JOIN f b ON a.sliver AND NOT b.sliver AND b.x0 <= a.x1 + 1 AND b.x1 >= a.x0 - 1 AND b.y0 <= a.y1 + 1 AND b.y1 >= a.y0 - 1""")
def c10(parcels: DataFrame) -> DataFrame:
    rows = parcels.select("parcel_id", *sp.BOX, sp.is_sliver(F.expr(A), F.expr(PER)).alias("sliver"))
    near = sp.overlap_join(rows.where("sliver"), rows.where("NOT sliver"), 128, 1)
    return near.select("parcel_id", F.col("b_parcel_id").alias("neighbour"))


@query("C11_longest_shared_side", "parcels", """
WITH n AS (SELECT a.parcel_id AS u, b.parcel_id AS v, greatest(least(a.x1, b.x1) - greatest(a.x0, b.x0), least(a.y1, b.y1) - greatest(a.y0, b.y0)) AS shared
FROM parcels a JOIN parcels b ON a.parcel_id <> b.parcel_id AND a.x1 - a.x0 <= 5 AND b.x1 - b.x0 > 5 AND b.x0 <= a.x1 AND b.x1 >= a.x0 AND b.y0 <= a.y1 AND b.y1 >= a.y0)
SELECT u AS parcel_id, max_by(v, (shared, -v)) AS neighbour, max(shared) AS shared FROM n GROUP BY 1""")
def c11(parcels: DataFrame) -> DataFrame:
    rows = parcels.select("parcel_id", *sp.BOX)
    near = sp.overlap_join(rows.where("x1 - x0 <= 5"), rows.where("x1 - x0 > 5"), 128)
    shared = F.expr("greatest(least(x1, b_x1) - greatest(x0, b_x0), least(y1, b_y1) - greatest(y0, b_y0))")
    near = near.withColumn("shared", shared)
    return near.groupBy("parcel_id").agg(F.max_by("b_parcel_id", F.struct("shared", (-F.col("b_parcel_id")).alias("k"))).alias("neighbour"), F.max("shared").alias("shared"))


@query("C12_hole_nesting", "parcels", f"""
WITH {POINTS} SELECT p.parcel_id, count(t.parcel_id) > 0 AS nested FROM parcels p LEFT JOIN pts t ON t.parcel_id <> p.parcel_id AND t.px >= p.x0 AND t.px < p.x1 AND t.py >= p.y0 AND t.py < p.y1 GROUP BY 1""")
def c12(parcels: DataFrame) -> DataFrame:
    held = sp.contains_point(_centres(parcels), parcels.select("parcel_id", *sp.BOX), 128).where("parcel_id <> b_parcel_id").select(F.col("b_parcel_id").alias("parcel_id"), F.lit(True).alias("nested")).distinct()
    return parcels.select("parcel_id").join(held, "parcel_id", "left").select("parcel_id", F.coalesce("nested", F.lit(False)).alias("nested"))


SEAM = """seam AS (SELECT a.parcel_id AS u, b.parcel_id AS v FROM (SELECT * FROM parcels WHERE least(x0 % 500, 500 - x1 % 500, y0 % 500, 500 - y1 % 500) <= 3) a
  JOIN (SELECT * FROM parcels WHERE least(x0 % 500, 500 - x1 % 500, y0 % 500, 500 - y1 % 500) <= 3) b
  ON a.parcel_id < b.parcel_id AND a.block_id <> b.block_id AND a.pred_class = b.pred_class AND b.x0 <= a.x1 + 40 AND b.x1 >= a.x0 - 40 AND b.y0 <= a.y1 + 40 AND b.y1 >= a.y0 - 40)"""


@query("C13_seam_candidates", "parcels", f"WITH {SEAM} SELECT u, v FROM seam")
def c13(parcels: DataFrame) -> DataFrame:
    return sp.seam_candidates(parcels, 500, 128, 40).select(F.col("parcel_id").alias("u"), F.col("b_parcel_id").alias("v"))


@query("K13_seam_merge", "parcels", f"""
WITH RECURSIVE {SEAM}, e AS (SELECT u, v FROM seam UNION SELECT v, u FROM seam), r AS (SELECT u AS node, u AS reach FROM e UNION SELECT r.node, e.v FROM r JOIN e ON r.reach = e.u) SELECT node, min(reach) AS root FROM r GROUP BY 1""")
def k13(parcels: DataFrame) -> DataFrame:
    links = sp.seam_candidates(parcels, 500, 128, 40)
    return sp.linked_groups(links.select(F.col("parcel_id").alias("u"), F.col("b_parcel_id").alias("v")))


@query("D17_dissolve_area", "parcels", """
WITH c AS (SELECT DISTINCT pred_class, x, unnest(range(y0, y1)) AS y FROM (SELECT pred_class, y0, y1, unnest(range(x0, x1)) AS x FROM parcels)) SELECT pred_class, count(*) AS area FROM c GROUP BY 1""")
def d17(parcels: DataFrame) -> DataFrame:
    return sp.union_area(parcels, ["pred_class"])


@query("K4_tiled_dissolve", "parcels", """
WITH c AS (SELECT DISTINCT pred_class, x, unnest(range(y0, y1)) AS y FROM (SELECT pred_class, y0, y1, unnest(range(x0, x1)) AS x FROM parcels)) SELECT pred_class, x // 1000 AS tile, count(*) AS area FROM c GROUP BY 1, 2""")
def k4(parcels: DataFrame) -> DataFrame:
    tiles = parcels.select("pred_class", "y0", "y1", "x0", "x1", F.explode(F.expr("sequence(x0 div 1000, (x1 - 1) div 1000)")).alias("tile"))
    cut = tiles.select("pred_class", "tile", F.expr("greatest(x0, tile * 1000)").alias("x0"), "y0", F.expr("least(x1, tile * 1000 + 1000)").alias("x1"), "y1")
    return sp.union_area(cut, ["pred_class", "tile"])


@query("D19_sliver_histogram", "parcels", f"""
WITH w AS (SELECT unnest([0.5, 1.0, 1.5, 2.0, 3.0])::DOUBLE AS width) SELECT width, count(*) FILTER ({A} / ({PER}) < width) AS slivers, count(*) FILTER ({A} <= 0) AS degenerate FROM parcels, w GROUP BY 1""")
def d19(parcels: DataFrame) -> DataFrame:
    widths = F.array(*map(F.lit, (0.5, 1.0, 1.5, 2.0, 3.0)))
    rows = parcels.select(F.expr(A).alias("area"), (F.expr(A) / F.expr(PER)).alias("mean"), F.explode(widths).alias("width"))
    return rows.groupBy("width").agg(F.count_if(F.expr("mean < width")).alias("slivers"), F.count_if(F.expr("area <= 0")).alias("degenerate"))


@query("D20_product_qa", "parcels", f"""
WITH {PAIRS} SELECT (SELECT count(*) FROM parcels) AS n, (SELECT count(*) FROM parcels WHERE {A} <= 0 OR ({A} / ({PER}) < 1.5::DOUBLE AND {A} < 100)) AS slivers,
  (SELECT CAST(sum({A}) AS BIGINT) FROM parcels) AS area, (SELECT CAST(coalesce(sum(area), 0) AS BIGINT) FROM pairs) AS overlap""")
def d20(parcels: DataFrame) -> DataFrame:
    one = parcels.agg(F.count("*").alias("n"), F.count_if(sp.is_sliver(F.expr(A), F.expr(PER))).alias("slivers"), F.sum(F.expr(A)).alias("area"))
    return one.crossJoin(sp.overlapping_pairs(parcels).agg(F.coalesce(F.sum("area"), F.lit(0)).alias("overlap")))


@query("D21_vertex_statistics", "parcels", """
SELECT block_id, round(avg(v), 6) AS mean, CAST(median(v) AS DOUBLE) AS median, max(v) AS most, CAST(sum(v) AS BIGINT) AS total FROM (SELECT block_id, 5 + parcel_id % 17 AS v FROM parcels) GROUP BY 1""")
def d21(parcels: DataFrame) -> DataFrame:
    v = parcels.select("block_id", F.expr("5 + parcel_id % 17").alias("v"))
    return v.groupBy("block_id").agg(F.round(F.avg("v"), 6).alias("mean"), F.median("v").alias("median"), F.max("v").alias("most"), F.sum("v").alias("total"))


@query("K2_geometry_hygiene", "parcels", f"SELECT county, count(*) AS kept FROM parcels WHERE parcel_id % 5 <> 0 AND {A} > 0 GROUP BY 1")
def k2(parcels: DataFrame) -> DataFrame:
    parts = _ring(parcels).select("county", F.when(F.col("parcel_id") % 5 != 0, F.array("ring")).alias("parts"))
    rings = parts.where("parts IS NOT NULL").select("county", F.explode("parts").alias("ring"))
    return rings.where((F.size("ring") >= 4) & (rg.ring_area(F.col("ring")) > 0)).groupBy("county").agg(F.count("*").alias("kept"))


@query("K6_clip_to_boundary", "parcels", """
SELECT parcel_id, (least(x1, 9000) - greatest(x0, 1000)) * (least(y1, 8000) - greatest(y0, 2000)) AS area, x0 >= 1000 AND x1 <= 9000 AND y0 >= 2000 AND y1 <= 8000 AS whole FROM parcels WHERE x1 > 1000 AND x0 < 9000 AND y1 > 2000 AND y0 < 8000""")
def k6(parcels: DataFrame) -> DataFrame:
    rows = parcels.withColumn("whole", F.expr("x0 >= 1000 AND x1 <= 9000 AND y0 >= 2000 AND y1 <= 8000"))
    return sp.clip(rows, 1000, 2000, 9000, 8000).select("parcel_id", F.expr(A).alias("area"), "whole")


LOST = """p AS (SELECT a.parcel_id AS u, b.parcel_id AS v, (a.x1 - a.x0) * (a.y1 - a.y0) AS aa, (b.x1 - b.x0) * (b.y1 - b.y0) AS ba, greatest(a.x0, b.x0) AS x0, greatest(a.y0, b.y0) AS y0, least(a.x1, b.x1) AS x1, least(a.y1, b.y1) AS y1
  FROM parcels a JOIN parcels b ON a.parcel_id < b.parcel_id AND a.x0 < b.x1 AND b.x0 < a.x1 AND a.y0 < b.y1 AND b.y0 < a.y1 WHERE a.x1 > a.x0 AND b.x1 > b.x0),
c AS (SELECT DISTINCT id, x, unnest(range(y0, y1)) AS y FROM (SELECT CASE WHEN aa < ba THEN u ELSE v END AS id, y0, y1, unnest(range(x0, x1)) AS x FROM p)), l AS (SELECT id, count(*) AS lost FROM c GROUP BY 1)"""


@query("K7_overlap_resolution", "parcels", f"WITH {LOST} SELECT parcel_id, (x1 - x0) * (y1 - y0) AS area, coalesce(lost, 0) AS lost FROM parcels LEFT JOIN l ON id = parcel_id")
def k7(parcels: DataFrame) -> DataFrame:
    return sp.resolve_overlaps(parcels)


@query("K8_sliver_round", "parcels", f"""
WITH {SLIVER}, n AS (SELECT a.parcel_id, max_by(b.parcel_id, (b.area, -b.parcel_id)) AS target FROM f a JOIN f b ON a.sliver AND NOT b.sliver AND b.x0 <= a.x1 + 1 AND b.x1 >= a.x0 - 1 AND b.y0 <= a.y1 + 1 AND b.y1 >= a.y0 - 1 GROUP BY 1)
SELECT parcel_id, target FROM f LEFT JOIN n USING (parcel_id) WHERE sliver""")
def k8(parcels: DataFrame) -> DataFrame:
    return sp.merge_slivers(parcels)


@query("K10_micro_holes", "parcels", f"""
WITH {POINTS}, h AS (SELECT p.parcel_id, p.block_id, {A} < 30 AS small, count(t.parcel_id) > 0 AS nested FROM parcels p LEFT JOIN pts t ON t.parcel_id <> p.parcel_id AND t.px >= p.x0 AND t.px < p.x1 AND t.py >= p.y0 AND t.py < p.y1 GROUP BY ALL)
SELECT block_id, count(*) FILTER (small AND NOT nested) AS removed, count(*) FILTER (NOT small OR nested) AS kept FROM h GROUP BY 1""")
def k10(parcels: DataFrame) -> DataFrame:
    h = c12(parcels).join(parcels.select("parcel_id", "block_id", F.expr(f"{A} < 30").alias("small")), "parcel_id")
    return h.groupBy("block_id").agg(F.count_if(F.expr("small AND NOT nested")).alias("removed"), F.count_if(F.expr("NOT small OR nested")).alias("kept"))


@query("K11_standardise", "parcels", f"""
SELECT row_number() OVER (ORDER BY parcel_id) AS gid, parcel_id, pred_class AS class_id, coalesce(name, CAST(pred_class AS VARCHAR)) AS label, coalesce(rgb, '#999999') AS rgb_hex, round(CAST({A} AS DOUBLE), 1) AS area_m2 FROM parcels LEFT JOIN (VALUES {NAMES}) d(id, name, rgb) ON pred_class = id""")
def k11(parcels: DataFrame) -> DataFrame:
    rows = _ring(parcels).select("parcel_id", F.col("pred_class").alias("class_id"), lu.class_name("pred_class").alias("label"), lu.class_colour("pred_class").alias("rgb_hex"), F.round(rg.ring_area(F.col("ring")), 1).alias("area_m2"))
    return sv.global_ids(rows, "parcel_id").select("gid", "parcel_id", "class_id", "label", "rgb_hex", "area_m2")


@query("K12_clean_report", "parcels", f"""
WITH {SLIVER}, n AS (SELECT DISTINCT a.parcel_id FROM f a JOIN f b ON a.sliver AND NOT b.sliver AND b.x0 <= a.x1 + 1 AND b.x1 >= a.x0 - 1 AND b.y0 <= a.y1 + 1 AND b.y1 >= a.y0 - 1)
SELECT 'input' AS stage, count(*) AS n FROM f UNION ALL SELECT 'slivers', count(*) FROM f WHERE sliver UNION ALL SELECT 'merged', count(*) FROM n UNION ALL SELECT 'output', (SELECT count(*) FROM f) - (SELECT count(*) FROM n)""")
def k12(parcels: DataFrame) -> DataFrame:
    merged = sp.merge_slivers(parcels).agg(F.count("*").alias("slivers"), F.count("target").alias("merged"))
    row = parcels.agg(F.count("*").alias("input")).crossJoin(merged).withColumn("output", F.col("input") - F.col("merged"))
    return row.select(F.expr("stack(4, 'input', input, 'slivers', slivers, 'merged', merged, 'output', output) AS (stage, n)"))


@query("K14_point_clip", "parcels", f"WITH {POINTS} SELECT parcel_id FROM pts WHERE px >= 1000 AND px < 9000 AND py >= 2000 AND py < 8000")
def k14(parcels: DataFrame) -> DataFrame:
    box = parcels.sparkSession.sql("SELECT 1L AS id, 1000L AS x0, 2000L AS y0, 9000L AS x1, 8000L AS y1")
    ring = box.select(rg.box_ring("x0", "y0", "x1", "y1").alias("ring"))
    return _centres(parcels).crossJoin(F.broadcast(ring)).where(rg.contains(F.col("ring"), F.col("px"), F.col("py"))).select("parcel_id")


@query("K15_download_grid", "parcels", f"WITH {CELLS}, g AS (SELECT cell, gx, unnest(range(y0 // 200, (y1 - 1) // 200 + 1)) AS gy, x1 FROM (SELECT *, unnest(range(x0 // 200, (x1 - 1) // 200 + 1)) AS gx FROM cells)) SELECT cell, gx, gy, least(gx * 200 + 200, x1) AS east FROM g")
def k15(parcels: DataFrame) -> DataFrame:
    g = _cells(parcels).select("cell", "y0", "y1", "x1", F.explode(F.expr("sequence(x0 div 200, (x1 - 1) div 200)")).alias("gx"))
    return g.select("cell", "gx", F.explode(F.expr("sequence(y0 div 200, (y1 - 1) div 200)")).alias("gy"), F.expr("least(gx * 200 + 200, x1)").alias("east"))


@query("K16_giant_diagnosis", "parcels", f"""
WITH t AS (SELECT unnest([20, 40, 100]) AS least) SELECT CAST(least AS INT) AS least, count(*) AS giants, array_to_string(list_sort(list(DISTINCT pred_class)), ',') AS classes FROM parcels, t WHERE CAST({PER} AS DOUBLE) * ({PER}) / ({A}) >= least GROUP BY 1""")
def k16(parcels: DataFrame) -> DataFrame:
    ratio = F.expr(f"cast({PER} AS double) * ({PER}) / ({A})")
    marks = F.filter(F.array(*map(F.lit, (20, 40, 100))), lambda t: ratio >= t)
    return parcels.select("pred_class", F.explode(marks).alias("least")).groupBy("least").agg(F.count("*").alias("giants"), F.array_join(F.sort_array(F.collect_set("pred_class")), ",").alias("classes"))


@query("K17_polygon_tile_plan", "parcels", f"""
WITH b AS (SELECT parcel_id, 100 + x0 / 10000 AS lon, 30 + y0 / 10000 AS lat, CASE WHEN {A} < 100 THEN 0.0005::DOUBLE WHEN {A} < 500 THEN 0.001::DOUBLE ELSE 0.0015::DOUBLE END AS buf FROM parcels),
t AS (SELECT parcel_id, CAST(floor((lon - buf + 180) / 360 * 65536.0::DOUBLE) AS BIGINT) AS xa, CAST(floor((lon + buf + 180) / 360 * 65536.0::DOUBLE) AS BIGINT) AS xb,
  CAST(floor((1 - ln(tan(radians(lat + buf)) + 1 / cos(radians(lat + buf))) / 3.141592653589793::DOUBLE) / 2 * 65536.0::DOUBLE) AS BIGINT) AS ya, CAST(floor((1 - ln(tan(radians(lat - buf)) + 1 / cos(radians(lat - buf))) / 3.141592653589793::DOUBLE) / 2 * 65536.0::DOUBLE) AS BIGINT) AS yb FROM b)
SELECT parcel_id, (xb - xa + 1) * (yb - ya + 1) AS tiles FROM t""")
def k17(parcels: DataFrame) -> DataFrame:
    area = F.expr(A)
    b = parcels.select("parcel_id", (100 + F.col("x0") / 10000).alias("lon"), (30 + F.col("y0") / 10000).alias("lat"), F.when(area < 100, 0.0005).when(area < 500, 0.001).otherwise(0.0015).alias("buf"))
    x = lambda sign: m.tile_x(F.col("lon") + sign * F.col("buf"), 16)
    y = lambda sign: m.tile_y(F.col("lat") + sign * F.col("buf"), 16)
    return b.select("parcel_id", ((x(1) - x(-1) + 1) * (y(-1) - y(1) + 1)).alias("tiles"))


@query("K19_instance_confidence", "pixels", """
SELECT cell_id, inst_pred, count(*) AS px, round(avg(prob_pm), 3) AS conf, CASE WHEN avg(prob_pm) > 500 THEN 1 ELSE 2 END AS cls FROM pixels WHERE truth > 0 GROUP BY ALL HAVING count(*) >= 60""")
def k19(pixels: DataFrame) -> DataFrame:
    g = pixels.where("truth > 0").groupBy("cell_id", "inst_pred").agg(F.count("*").alias("px"), F.avg("prob_pm").alias("mean")).where("px >= 60")
    return g.select("cell_id", "inst_pred", "px", F.round("mean", 3).alias("conf"), F.when(F.col("mean") > 500, 1).otherwise(2).alias("cls"))


@query("K1_instance_outlines", "pixels", """
WITH s AS (SELECT cell_id, inst_gt, r, c FROM pixels), e AS (SELECT s.cell_id, s.inst_gt, count(*) * 4 - sum(CASE WHEN a.r IS NOT NULL THEN 2 ELSE 0 END + CASE WHEN b.r IS NOT NULL THEN 2 ELSE 0 END) AS perimeter, count(*) AS area
FROM s LEFT JOIN s a ON a.cell_id = s.cell_id AND a.inst_gt = s.inst_gt AND a.r = s.r + 1 AND a.c = s.c LEFT JOIN s b ON b.cell_id = s.cell_id AND b.inst_gt = s.inst_gt AND b.r = s.r AND b.c = s.c + 1 GROUP BY ALL) SELECT cell_id, inst_gt, area, CAST(perimeter AS BIGINT) AS perimeter FROM e""")
def k1(pixels: DataFrame) -> DataFrame:
    from landgrid.operators.outlines import outlines

    rings = outlines(pixels, "inst_gt")
    return rings.groupBy("cell_id", "inst_gt").agg(F.round(F.sum("signed_area")).cast("long").alias("area"), F.round(F.sum("perimeter")).cast("long").alias("perimeter"))
