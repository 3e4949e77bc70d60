"""Queries over survey parcels: codes, aggregates, rankings, selections."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from landgrid.functions import landuse as lu
from landgrid.operators import survey as sv
from landgrid.operators.tiling import top_per_key
from landgrid.plans.registry import query
from landgrid.session import shared_path
from landgrid.sources import files

MAJOR = "CAST(substr(dlbm, 1, 2) AS INT)"
FIVE = f"CASE WHEN {MAJOR} BETWEEN 1 AND 4 THEN {MAJOR} WHEN {MAJOR} BETWEEN 5 AND 12 THEN 5 END"
AREA = "(x1 - x0) * (y1 - y0)"
SUM = lambda x: f"CAST(sum({x}) AS BIGINT)"


@query("A4_pruned_survey_scan", "parcels", "SELECT parcel_id, dlbm FROM parcels WHERE substr(dlbm, 3, 2) IN ('01', '03')")
def a4(parcels: DataFrame) -> DataFrame:
    return parcels.select("parcel_id", "dlbm").where(F.substring("dlbm", 3, 2).isin("01", "03"))


@query("A5_county_scan", "parcels", f"SELECT parcel_id, {FIVE} AS cls FROM parcels WHERE county = 7 AND {FIVE} IS NOT NULL")
def a5(parcels: DataFrame) -> DataFrame:
    return parcels.where("county = 7").select("parcel_id", lu.five_class("dlbm").alias("cls")).where("cls IS NOT NULL")


@query("B19_five_class", "parcels", f"SELECT parcel_id, {FIVE} AS cls FROM parcels")
def b19(parcels: DataFrame) -> DataFrame:
    return parcels.select("parcel_id", lu.five_class("dlbm").alias("cls"))


@query("B20_twelve_class", "parcels", f"SELECT parcel_id, CASE WHEN {MAJOR} BETWEEN 1 AND 12 THEN {MAJOR} END AS cls FROM parcels")
def b20(parcels: DataFrame) -> DataFrame:
    return parcels.select("parcel_id", lu.twelve_class("dlbm").alias("cls"))


@query("B21_eight_class", "parcels", f"""
SELECT parcel_id, CASE WHEN dlbm = '1202' THEN 8 WHEN {MAJOR} BETWEEN 1 AND 4 THEN {MAJOR} WHEN {MAJOR} BETWEEN 5 AND 10 THEN 5 WHEN {MAJOR} = 11 THEN 6 WHEN {MAJOR} = 12 THEN 7 END AS cls FROM parcels""")
def b21(parcels: DataFrame) -> DataFrame:
    return parcels.select("parcel_id", lu.eight_class("dlbm").alias("cls"))


NAMES = ", ".join(f"({i}, '{n}', '{c}')" for i, n, _, c in lu.CLASSES)


@query("B22_class_names", "parcels", f"""
SELECT parcel_id, coalesce(name, CAST(pred_class AS VARCHAR)) AS label, coalesce(rgb, '#999999') AS rgb FROM parcels LEFT JOIN (VALUES {NAMES}) d(id, name, rgb) ON pred_class = id""")
def b22(parcels: DataFrame) -> DataFrame:
    return parcels.select("parcel_id", lu.class_name("pred_class").alias("label"), lu.class_colour("pred_class").alias("rgb"))


@query("B23_merge_classes", "parcels", "SELECT parcel_id, CASE WHEN pred_class IN (1, 2) THEN 1 ELSE 2 END AS bin, CASE pred_class WHEN 8 THEN 6 WHEN 2 THEN 1 ELSE pred_class END AS merged FROM parcels")
def b23(parcels: DataFrame) -> DataFrame:
    return parcels.select("parcel_id", lu.binary_class("pred_class").alias("bin"), lu.merged_class("pred_class").alias("merged"))


@query("B37_dynamic_buffer", "parcels", f"SELECT parcel_id, CASE WHEN {AREA} < 100 THEN 5.0::DOUBLE WHEN {AREA} < 500 THEN 10.0::DOUBLE ELSE 15.0::DOUBLE END AS buffer FROM parcels")
def b37(parcels: DataFrame) -> DataFrame:
    area = F.expr(AREA)
    return parcels.select("parcel_id", (10.0 * F.when(area < 100, 0.5).when(area < 500, 1.0).otherwise(1.5)).alias("buffer"))


@query("B40_hex_colour", "pixels", "SELECT cell_id, r, c, '#' || lower(printf('%02x%02x%02x', red, grn, blu)) AS rgb FROM pixels")
def b40(pixels: DataFrame) -> DataFrame:
    return pixels.select("cell_id", "r", "c", lu.hex_colour("red", "grn", "blu").alias("rgb"))


@query("D5_cell_richness", "parcels", f"""
WITH k AS (SELECT x0 // 2000 AS gx, y0 // 2000 AS gy, {FIVE} AS cls FROM parcels)
SELECT gx, gy, count(DISTINCT cls) AS classes, count(*) AS polygons, count(DISTINCT cls) + max(CASE WHEN cls = 5 THEN 1 ELSE 0 END) AS score FROM k GROUP BY gx, gy HAVING count(DISTINCT cls) >= 4""")
def d5(parcels: DataFrame) -> DataFrame:
    k = parcels.select(F.expr("x0 div 2000").alias("gx"), F.expr("y0 div 2000").alias("gy"), lu.five_class("dlbm").alias("cls"))
    out = k.groupBy("gx", "gy").agg(F.countDistinct("cls").alias("classes"), F.count("*").alias("polygons"), F.max(F.when(F.col("cls") == 5, 1).otherwise(0)).alias("five"))
    return out.where("classes >= 4").select("gx", "gy", "classes", "polygons", (F.col("classes") + F.col("five")).alias("score"))


@query("D6_grid_binning", "parcels", f"""
WITH k AS (SELECT CAST(floor((x0 + x1) / 2 / 500) AS BIGINT) AS gx, CAST(floor((y0 + y1) / 2 / 500) AS BIGINT) AS gy, county, substr(dlbm, 3, 2) = '01' AS rare FROM parcels),
c AS (SELECT gx, gy, county, count(*) AS k, count(*) FILTER (rare) AS rare FROM k GROUP BY ALL)
SELECT gx, gy, {SUM('k')} AS total, {SUM('rare')} AS rare, max_by(county, (k, -county)) AS county FROM c GROUP BY gx, gy""")
def d6(parcels: DataFrame) -> DataFrame:
    return sv.grid_cells(parcels.withColumn("rare", F.substring("dlbm", 3, 2) == "01"), 500)


@query("D7_county_crop_share", "parcels", f"SELECT county, round(coalesce(sum({AREA}) FILTER ({FIVE} IN (1, 2)), 0) / greatest(sum({AREA}), 1), 6) AS share FROM parcels GROUP BY county")
def d7(parcels: DataFrame) -> DataFrame:
    area = F.expr(AREA)
    crop = F.coalesce(F.sum(F.when(lu.five_class("dlbm").isin(1, 2), area)), F.lit(0))
    return parcels.groupBy("county").agg(F.round(crop / F.greatest(F.sum(area), F.lit(1)), 6).alias("share"))


@query("D8_class_shares", "parcels", f"""
WITH s AS (SELECT block_id, {FIVE} AS cls, {SUM(AREA)} AS area FROM parcels GROUP BY ALL)
SELECT block_id, cls, area, round(100 * area / CAST(sum(area) OVER (PARTITION BY block_id) AS BIGINT), 6) AS pct FROM s""")
def d8(parcels: DataFrame) -> DataFrame:
    return sv.class_shares(parcels, "block_id", lu.five_class("dlbm"))


@query("D16_label_summary", "parcels", f"SELECT pred_class, count(*) AS n, {SUM(AREA)} AS area_m2, round({SUM(AREA)} / 1000000.0::DOUBLE, 3) AS km2 FROM parcels GROUP BY pred_class")
def d16(parcels: DataFrame) -> DataFrame:
    out = sv.with_area(parcels).groupBy("pred_class").agg(F.count("*").alias("n"), F.sum("area").alias("area_m2"))
    return out.withColumn("km2", F.round(F.col("area_m2") / 1000000.0, 3))


@query("D28_rollup_summary", "parcels", f"SELECT county, pred_class, count(*) AS n, {SUM(AREA)} AS area FROM parcels GROUP BY ROLLUP (county, pred_class)")
def d28(parcels: DataFrame) -> DataFrame:
    return sv.with_area(parcels).rollup("county", "pred_class").agg(F.count("*").alias("n"), F.sum("area").alias("area"))


@query("D18_split_instances", "parcels", "SELECT x0 // 100 AS inst, count(*) AS parts FROM parcels GROUP BY 1 HAVING count(*) > 1")
def d18(parcels: DataFrame) -> DataFrame:
    return parcels.groupBy(F.expr("x0 div 100").alias("inst")).agg(F.count("*").alias("parts")).where("parts > 1")


@query("D22_densest_window", "parcels", """
SELECT CAST(floor((x0 + x1) / 2 / 1200) AS BIGINT) AS bx, CAST(floor((y0 + y1) / 2 / 1200) AS BIGINT) AS "by", count(*) AS n FROM parcels GROUP BY 1, 2 ORDER BY n DESC, bx, "by" LIMIT 1""")
def d22(parcels: DataFrame) -> DataFrame:
    mid = lambda a: F.floor((F.col(f"{a}0") + F.col(f"{a}1")) / 2 / 1200)
    return parcels.groupBy(mid("x").alias("bx"), mid("y").alias("by")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "bx", "by").limit(1)


@query("D23_correlation", "parcels", f"SELECT county, round(corr(CAST({AREA} AS DOUBLE), CAST(prob_pm AS DOUBLE)), 6) AS r FROM parcels GROUP BY county")
def d23(parcels: DataFrame) -> DataFrame:
    return sv.with_area(parcels).groupBy("county").agg(F.round(F.corr(F.col("area").cast("double"), F.col("prob_pm").cast("double")), 6).alias("r"))


@query("D24_thirds", "parcels", f"""
WITH q AS (SELECT county, {AREA} AS area, row_number() OVER (PARTITION BY county ORDER BY prob_pm DESC, parcel_id) AS rank, count(*) OVER (PARTITION BY county) AS n FROM parcels)
SELECT county, round(avg(area) FILTER (rank <= n // 3), 6) AS top_mean, round(avg(area) FILTER (rank > n - n // 3), 6) AS bottom_mean FROM q GROUP BY county""")
def d24(parcels: DataFrame) -> DataFrame:
    w = Window.partitionBy("county")
    q = sv.with_area(parcels).withColumns({"rank": F.row_number().over(w.orderBy(F.desc("prob_pm"), "parcel_id")), "third": F.expr("count(*) OVER (PARTITION BY county) div 3"), "n": F.count("*").over(w)})
    part = lambda c: F.round(F.avg(F.when(c, F.col("area"))), 6)
    return q.groupBy("county").agg(part(F.col("rank") <= F.col("third")).alias("top_mean"), part(F.col("rank") > F.col("n") - F.col("third")).alias("bottom_mean"))


@query("E1_global_id", "parcels", "SELECT parcel_id, row_number() OVER (ORDER BY x0, y0, parcel_id) AS gid FROM parcels")
def e1(parcels: DataFrame) -> DataFrame:
    return sv.global_ids(parcels.select("parcel_id", "x0", "y0"), "x0", "y0", "parcel_id").select("parcel_id", "gid")


@query("E2_top_candidates", "parcels", """
WITH k AS (SELECT county, x0 // 500 AS gx, y0 // 500 AS gy, count(*) AS n FROM parcels GROUP BY ALL)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY county ORDER BY n DESC, gx, gy) AS rank FROM k) WHERE rank <= 30""")
def e2(parcels: DataFrame) -> DataFrame:
    k = parcels.groupBy("county", F.expr("x0 div 500").alias("gx"), F.expr("y0 div 500").alias("gy")).agg(F.count("*").alias("n"))
    return top_per_key(k, ["county"], 30, F.desc("n"), F.col("gx"), F.col("gy"))


BALANCE = f"""k AS (SELECT county, x0 // 2000 AS gx, y0 // 2000 AS gy, {FIVE} AS cls, count(*) AS n FROM parcels GROUP BY ALL),
b AS (SELECT county, gx, gy, round(min(n) / max(n), 6) AS balance FROM k GROUP BY county, gx, gy)"""


def _balance(parcels: DataFrame) -> DataFrame:
    k = parcels.groupBy("county", F.expr("x0 div 2000").alias("gx"), F.expr("y0 div 2000").alias("gy"), lu.five_class("dlbm").alias("cls")).agg(F.count("*").alias("n"))
    return k.groupBy("county", "gx", "gy").agg(F.round(F.min("n") / F.max("n"), 6).alias("balance"))


@query("E3_best_per_county", "parcels", f"""
WITH {BALANCE}, f AS (SELECT *, row_number() OVER (PARTITION BY county ORDER BY balance DESC, gx, gy) AS rank FROM b)
SELECT county, gx, gy, balance FROM f WHERE rank = 1 ORDER BY balance DESC, county LIMIT 20""")
def e3(parcels: DataFrame) -> DataFrame:
    return sv.best_balanced(_balance(parcels), 20)


@query("E4_one_per_county", "parcels", f"""
WITH {BALANCE} SELECT county, gx, gy, balance FROM (SELECT *, row_number() OVER (PARTITION BY county ORDER BY balance DESC, gx, gy) AS rank FROM b) WHERE rank = 1""")
def e4(parcels: DataFrame) -> DataFrame:
    return top_per_key(_balance(parcels), ["county"], 1, F.desc("balance"), F.col("gx"), F.col("gy")).drop("rank")


@query("E5_share_of_total", "parcels", f"""
WITH s AS (SELECT block_id, pred_class, {SUM(AREA)} AS area FROM parcels GROUP BY ALL) SELECT block_id, pred_class, round(100 * area / CAST(sum(area) OVER (PARTITION BY block_id) AS BIGINT), 3) AS area_pct FROM s""")
def e5(parcels: DataFrame) -> DataFrame:
    s = sv.with_area(parcels).groupBy("block_id", "pred_class").agg(F.sum("area").alias("area"))
    return s.select("block_id", "pred_class", F.round(100 * F.col("area") / F.sum("area").over(Window.partitionBy("block_id")), 3).alias("area_pct"))


@query("E7_tolerance_clusters", "parcels", """
WITH d AS (SELECT DISTINCT county, x0 FROM parcels), f AS (SELECT *, CASE WHEN x0 - lag(x0) OVER (PARTITION BY county ORDER BY x0) >= 40 THEN 1 ELSE 0 END AS new FROM d)
SELECT county, x0, CAST(sum(new) OVER (PARTITION BY county ORDER BY x0) AS BIGINT) AS grp FROM f""")
def e7(parcels: DataFrame) -> DataFrame:
    return sv.cluster_1d(parcels, "county", "x0", 40)


@query("E8_block_assignment", "parcels", """
WITH d AS (SELECT DISTINCT county, x0 FROM parcels), f AS (SELECT *, CASE WHEN x0 - lag(x0) OVER (PARTITION BY county ORDER BY x0) >= 40 THEN 1 ELSE 0 END AS new FROM d),
g AS (SELECT county, x0, CAST(sum(new) OVER (PARTITION BY county ORDER BY x0) AS BIGINT) AS grp FROM f) SELECT parcel_id, grp // 4 AS block_col FROM parcels JOIN g USING (county, x0)""")
def e8(parcels: DataFrame) -> DataFrame:
    g = sv.cluster_1d(parcels, "county", "x0", 40)
    return parcels.join(g, ["county", "x0"]).select("parcel_id", F.expr("grp div 4").alias("block_col"))


@query("F1_ranked_mining", "parcels", """
SELECT x0 // 500 AS gx, y0 // 500 AS gy, count(*) FILTER (substr(dlbm, 3, 2) = '01') AS rare, count(*) AS total FROM parcels GROUP BY 1, 2 HAVING count(*) >= 2 ORDER BY rare DESC, total DESC, gx, gy LIMIT 200""")
def f1(parcels: DataFrame) -> DataFrame:
    k = parcels.groupBy(F.expr("x0 div 500").alias("gx"), F.expr("y0 div 500").alias("gy")).agg(F.count_if(F.substring("dlbm", 3, 2) == "01").alias("rare"), F.count("*").alias("total"))
    return k.where("total >= 2").orderBy(F.desc("rare"), F.desc("total"), "gx", "gy").limit(200)


def _quota(c: str, earlier: str) -> str:
    return f"""q{c} AS (SELECT '{c}' AS cls, x0 // 2000 AS gx, y0 // 2000 AS gy, count(*) AS n FROM parcels WHERE substr(dlbm, 1, 2) = '{c}' {earlier} GROUP BY 2, 3 HAVING count(*) >= 2 ORDER BY n DESC, gx, gy LIMIT 30)"""


@query("F2_sequential_quota", "parcels", f"""
WITH {_quota('02', '')}, {_quota('11', 'AND (x0 // 2000, y0 // 2000) NOT IN (SELECT (gx, gy) FROM q02)')},
{_quota('12', 'AND (x0 // 2000, y0 // 2000) NOT IN (SELECT (gx, gy) FROM q02 UNION ALL SELECT (gx, gy) FROM q11)')}
SELECT * FROM q02 UNION ALL SELECT * FROM q11 UNION ALL SELECT * FROM q12""")
def f2(parcels: DataFrame) -> DataFrame:
    return sv.sequential_quota(parcels, ["02", "11", "12"], 2000, 30, 2)


@query("F3_keep_top_fraction", "parcels", """
WITH r AS (SELECT county, parcel_id, row_number() OVER (PARTITION BY county ORDER BY prob_pm DESC, parcel_id) AS rank, count(*) OVER (PARTITION BY county) AS n FROM parcels)
SELECT county, parcel_id FROM r WHERE rank <= CAST(floor(n * 0.7::DOUBLE) AS BIGINT)""")
def f3(parcels: DataFrame) -> DataFrame:
    return sv.keep_top_fraction(parcels.select("county", "parcel_id", "prob_pm"), "county", "prob_pm", 0.7, "parcel_id").select("county", "parcel_id")


@query("F4_rich_counties", "parcels", f"""
WITH s AS (SELECT county, sum({AREA}) FILTER ({FIVE} IN (1, 2)) / sum({AREA}) AS share FROM parcels GROUP BY county)
SELECT county, round(share, 6) AS share FROM s WHERE share > 0.1::DOUBLE ORDER BY share DESC, county LIMIT 35""")
def f4(parcels: DataFrame) -> DataFrame:
    area = F.expr(AREA)
    s = parcels.groupBy("county").agg((F.sum(F.when(lu.five_class("dlbm").isin(1, 2), area)) / F.sum(area)).alias("share"))
    return s.where("share > 0.1").orderBy(F.desc("share"), "county").limit(35).select("county", F.round("share", 6).alias("share"))


@query("G1_concatenate_products", "parcels", "SELECT block_id, count(*) AS n FROM parcels GROUP BY block_id")
def g1(parcels: DataFrame) -> DataFrame:
    """The parts of a product, a folder for each block, read as one table."""
    path = shared_path(parcels.sparkSession, "blocks")
    parcels.write.partitionBy("block_id").parquet(path)
    return files.read_parts(parcels.sparkSession, path).groupBy(F.col("block_id").cast("long").alias("block_id")).agg(F.count("*").alias("n"))


@query("C16_schema_lookup", "parcels", f"""
SELECT parcel_id, coalesce(name, CAST(cls AS VARCHAR)) AS label FROM (SELECT parcel_id, {MAJOR} AS cls FROM parcels) LEFT JOIN (VALUES {NAMES}) d(id, name, rgb) ON cls = id""")
def c16(parcels: DataFrame) -> DataFrame:
    dim = parcels.sparkSession.createDataFrame([(i, n) for i, n, _, _ in lu.CLASSES], "id int, name string")
    rows = parcels.select("parcel_id", F.substring("dlbm", 1, 2).cast("int").alias("cls"))
    return rows.join(F.broadcast(dim), F.col("cls") == F.col("id"), "left").select("parcel_id", F.coalesce("name", F.col("cls").cast("string")).alias("label"))


@query("C17_route_comparison", "parcels", f"""
WITH a AS (SELECT x0 // 2000 AS gx, count(*) AS n_a FROM parcels WHERE pred_class <= 3 GROUP BY 1), b AS (SELECT x0 // 2000 AS gx, count(*) AS n_b FROM parcels WHERE pred_class > 3 GROUP BY 1)
SELECT gx, n_a, n_b, n_a - n_b AS diff FROM a JOIN b USING (gx)""")
def c17(parcels: DataFrame) -> DataFrame:
    k = F.expr("x0 div 2000").alias("gx")
    a = parcels.where("pred_class <= 3").groupBy(k).agg(F.count("*").alias("n_a"))
    b = parcels.where("pred_class > 3").groupBy(k).agg(F.count("*").alias("n_b"))
    return a.join(b, "gx").withColumn("diff", F.col("n_a") - F.col("n_b"))


RECON = f"""t AS (SELECT {FIVE} AS cls, {SUM(AREA)} AS truth FROM parcels GROUP BY 1), p AS (SELECT pred_class AS cls, {SUM(AREA)} AS pred FROM parcels GROUP BY 1)"""


def _reconcile(parcels: DataFrame) -> DataFrame:
    rows = sv.with_area(parcels)
    t = rows.groupBy(lu.five_class("dlbm").alias("cls")).agg(F.sum("area").alias("truth"))
    p = rows.groupBy(F.col("pred_class").alias("cls")).agg(F.sum("area").alias("pred"))
    return t.join(p, "cls", "full").fillna(0, ["truth", "pred"])


@query("C18_area_reconciliation", "parcels", f"WITH {RECON} SELECT CAST(cls AS BIGINT) AS cls, coalesce(truth, 0) AS truth, coalesce(pred, 0) AS pred FROM t FULL JOIN p USING (cls)")
def c18(parcels: DataFrame) -> DataFrame:
    return _reconcile(parcels)


@query("L21_area_percentages", "parcels", f"""
WITH {RECON}, j AS (SELECT CAST(cls AS BIGINT) AS cls, coalesce(truth, 0) AS truth, coalesce(pred, 0) AS pred FROM t FULL JOIN p USING (cls)),
s AS (SELECT cls, 100 * truth / CAST(sum(truth) OVER () AS BIGINT) AS a, 100 * pred / CAST(sum(pred) OVER () AS BIGINT) AS b FROM j)
SELECT cls, round(a, 6) AS truth_pct, round(b, 6) AS pred_pct, round(b - a, 6) AS dpp FROM s""")
def l21(parcels: DataFrame) -> DataFrame:
    j = _reconcile(parcels)
    total = j.agg(F.sum("truth").alias("tt"), F.sum("pred").alias("tp"))
    s = j.crossJoin(F.broadcast(total)).select("cls", (100 * F.col("truth") / F.col("tt")).alias("a"), (100 * F.col("pred") / F.col("tp")).alias("b"))
    return s.select("cls", F.round("a", 6).alias("truth_pct"), F.round("b", 6).alias("pred_pct"), F.round(F.col("b") - F.col("a"), 6).alias("dpp"))


@query("C19_imagery_match", "parcels completed", f"""
WITH p AS (SELECT parcel_id, parcel_id // 8 AS region_id, {AREA} AS area FROM parcels), i AS (SELECT region_id, CAST(100 + 50 * max(dx) AS BIGINT) AS img FROM completed WHERE has_blob = 1 GROUP BY region_id)
SELECT parcel_id, round(img / area, 6) AS ratio, img / area BETWEEN 0.8::DOUBLE AND 1.5::DOUBLE AS matched FROM p LEFT JOIN i USING (region_id) WHERE img IS NOT NULL""")
def c19(parcels: DataFrame, completed: DataFrame) -> DataFrame:
    p = sv.with_area(parcels).select("parcel_id", F.expr("parcel_id div 8").alias("region_id"), "area")
    i = completed.where("has_blob = 1").groupBy("region_id").agg((F.lit(100) + 50 * F.max("dx")).alias("img"))
    ratio = F.col("img") / F.col("area")
    return p.join(i, "region_id", "left").where("img IS NOT NULL").select("parcel_id", F.round(ratio, 6).alias("ratio"), ratio.between(0.8, 1.5).alias("matched"))


@query("M3_county_split", "parcels", """
WITH c AS (SELECT county, row_number() OVER (ORDER BY md5(county || ':11'), county) AS rank FROM (SELECT DISTINCT county FROM parcels)),
k AS (SELECT county, x0 // 500 AS gx, y0 // 500 AS gy, count(*) AS n FROM parcels GROUP BY ALL),
t AS (SELECT *, row_number() OVER (PARTITION BY county ORDER BY n DESC, gx, gy) AS r FROM k),
d AS (SELECT *, row_number() OVER (PARTITION BY county ORDER BY md5(gx || ':' || gy || ':11'), gx, gy) AS pick FROM t WHERE r <= 30)
SELECT county, gx, gy, CASE WHEN rank <= 4 THEN 'test' ELSE 'train' END AS split FROM d JOIN c USING (county) WHERE rank <= 24 AND pick <= 2""")
def m3(parcels: DataFrame) -> DataFrame:
    md5 = lambda *c: F.md5(F.concat_ws(":", *c, F.lit("11")).cast("binary"))
    chosen = parcels.select("county").distinct().orderBy(md5("county"), "county").limit(24)
    chosen = chosen.withColumn("rank", F.row_number().over(Window.orderBy(md5("county"), "county")))  # over 24 counties
    k = parcels.groupBy("county", F.expr("x0 div 500").alias("gx"), F.expr("y0 div 500").alias("gy")).agg(F.count("*").alias("n"))
    best = top_per_key(k, ["county"], 30, F.desc("n"), F.col("gx"), F.col("gy"))
    picked = top_per_key(best, ["county"], 2, md5("gx", "gy"), F.col("gx"), F.col("gy"), rank="pick")
    return picked.drop("rank").join(F.broadcast(chosen), "county").select("county", "gx", "gy", F.when(F.col("rank") <= 4, "test").otherwise("train").alias("split"))


@query("M5_balanced_cells", "parcels", f"""
WITH k AS (SELECT x0 // 2000 AS gx, y0 // 2000 AS gy, {FIVE} AS cls, sum({AREA}) AS a FROM parcels GROUP BY ALL), s AS (SELECT gx, gy, cls, a / sum(a) OVER (PARTITION BY gx, gy) AS share FROM k)
SELECT gx, gy, count(*) FILTER (share >= 0.03::DOUBLE) AS classes FROM s GROUP BY gx, gy HAVING count(*) FILTER (share >= 0.03::DOUBLE) >= 4""")
def m5(parcels: DataFrame) -> DataFrame:
    k = sv.with_area(parcels).groupBy(F.expr("x0 div 2000").alias("gx"), F.expr("y0 div 2000").alias("gy"), lu.five_class("dlbm").alias("cls")).agg(F.sum("area").alias("a"))
    s = k.withColumn("share", F.col("a") / F.sum("a").over(Window.partitionBy("gx", "gy")))
    return s.groupBy("gx", "gy").agg(F.count_if(F.col("share") >= 0.03).alias("classes")).where("classes >= 4")


@query("L11_parcel_f1_by_size", "parcels", f"""
WITH p AS (SELECT {AREA} AS area, {FIVE} <= 2 AS t, pred_class <= 2 AS q FROM parcels), m AS (SELECT unnest([0, 50, 100, 200, 500, 1000]) AS mmu),
c AS (SELECT mmu, count(*) AS n, count(*) FILTER (t AND q) AS tp, count(*) FILTER (NOT t AND q) AS fp, count(*) FILTER (t AND NOT q) AS fn,
  coalesce({SUM('CASE WHEN t AND q THEN area END')}, 0) AS atp, coalesce({SUM('CASE WHEN NOT t AND q THEN area END')}, 0) AS afp, coalesce({SUM('CASE WHEN t AND NOT q THEN area END')}, 0) AS afn FROM m JOIN p ON area >= mmu GROUP BY mmu)
SELECT CAST(mmu AS INT) AS mmu, n, round(2 * tp / greatest(2 * tp + fp + fn, 1), 6) AS f1_count, round(2 * atp / greatest(2 * atp + afp + afn, 1), 6) AS f1_area, round((n - fp - fn) / n, 6) AS oa FROM c""")
def l11(parcels: DataFrame) -> DataFrame:
    p = sv.with_area(parcels).select("area", (lu.five_class("dlbm") <= 2).alias("t"), (F.col("pred_class") <= 2).alias("q"))
    # A parcel counts at every size up to its own, so thresholds are an array on the row and no join is needed.
    sizes = F.filter(F.array(*[F.lit(m) for m in (0, 50, 100, 200, 500, 1000)]), lambda m: m <= F.col("area"))
    c = p.select("*", F.explode(sizes).alias("mmu")).groupBy("mmu").agg(
        F.count("*").alias("n"), F.count_if(F.expr("t AND q")).alias("tp"), F.count_if(F.expr("NOT t AND q")).alias("fp"), F.count_if(F.expr("t AND NOT q")).alias("fn"),
        *[F.coalesce(F.sum(F.when(F.expr(e), F.col("area"))), F.lit(0)).alias(a) for e, a in (("t AND q", "atp"), ("NOT t AND q", "afp"), ("t AND NOT q", "afn"))],
    )
    f1 = lambda tp, fp, fn: F.round(2 * F.col(tp) / F.greatest(2 * F.col(tp) + F.col(fp) + F.col(fn), F.lit(1)), 6)
    return c.select("mmu", "n", f1("tp", "fp", "fn").alias("f1_count"), f1("atp", "afp", "afn").alias("f1_area"), F.round(F.expr("(n - fp - fn) / n"), 6).alias("oa"))


@query("L12_area_agreement", "parcels", f"""
WITH s AS (SELECT county, coalesce(sum({AREA}) FILTER ({FIVE} <= 2), 0) AS t, coalesce(sum({AREA}) FILTER (pred_class <= 2), 0) AS p FROM parcels GROUP BY county)
SELECT county, round(100 * least(t, p) / greatest(t, p, 1), 6) AS agreement, round(p / greatest(t, 1), 6) AS ratio FROM s""")
def l12(parcels: DataFrame) -> DataFrame:
    rows = sv.with_area(parcels)
    part = lambda c: F.coalesce(F.sum(F.when(c, F.col("area"))), F.lit(0))
    s = rows.groupBy("county").agg(part(lu.five_class("dlbm") <= 2).alias("t"), part(F.col("pred_class") <= 2).alias("p"))
    return s.select("county", F.round(100 * F.least("t", "p") / F.greatest("t", "p", F.lit(1)), 6).alias("agreement"), F.round(F.col("p") / F.greatest("t", F.lit(1)), 6).alias("ratio"))


@query("L13_rule_fusion", "parcels", f"""
WITH p AS (SELECT {AREA} AS area, {FIVE} <= 2 AS t, prob_pm >= 500 AS b, pred_class <= 2 AS k FROM parcels),
r AS (SELECT t, unnest([('binary', b), ('classes', k), ('and', b AND k), ('cond200', CASE WHEN area < 200 THEN b ELSE k END), ('cond500', CASE WHEN area < 500 THEN b ELSE k END)]::STRUCT(rule VARCHAR, q BOOLEAN)[]) AS x FROM p)
SELECT x.rule AS rule, count(*) FILTER (t AND x.q) AS tp, count(*) FILTER (NOT t AND x.q) AS fp, count(*) FILTER (t AND NOT x.q) AS fn FROM r GROUP BY 1""")
def l13(parcels: DataFrame) -> DataFrame:
    p = sv.with_area(parcels).select("area", (lu.five_class("dlbm") <= 2).alias("t"), (F.col("prob_pm") >= 500).alias("b"), (F.col("pred_class") <= 2).alias("k"))
    rules = F.expr("stack(5, 'binary', b, 'classes', k, 'and', b AND k, 'cond200', IF(area < 200, b, k), 'cond500', IF(area < 500, b, k)) AS (rule, q)")
    n = lambda e: F.count_if(F.expr(e))
    return p.select("t", rules).groupBy("rule").agg(n("t AND q").alias("tp"), n("NOT t AND q").alias("fp"), n("t AND NOT q").alias("fn"))


@query("L20_paired_delta", "parcels", """
WITH a AS (SELECT county, avg(prob_pm) FILTER (pred_class <= 3) AS a, avg(prob_pm) FILTER (pred_class > 3) AS b FROM parcels GROUP BY county) SELECT county, round(b - a, 6) AS delta FROM a""")
def l20(parcels: DataFrame) -> DataFrame:
    mean = lambda c: F.avg(F.when(c, F.col("prob_pm")))
    a = parcels.groupBy("county").agg(mean(F.col("pred_class") <= 3).alias("a"), mean(F.col("pred_class") > 3).alias("b"))
    return a.select("county", F.round(F.col("b") - F.col("a"), 6).alias("delta"))


@query("L23_tiled_vs_global", "parcels", f"""
WITH g AS (SELECT pred_class, count(*) AS n, {SUM(AREA)} AS area FROM parcels GROUP BY 1), t AS (SELECT pred_class, {SUM('n')} AS n, {SUM('area')} AS area FROM (SELECT pred_class, block_id, count(*) AS n, sum({AREA}) AS area FROM parcels GROUP BY 1, 2) GROUP BY 1)
SELECT pred_class, t.n - g.n AS dn, t.area - g.area AS darea FROM g JOIN t USING (pred_class)""")
def l23(parcels: DataFrame) -> DataFrame:
    rows = sv.with_area(parcels)
    g = rows.groupBy("pred_class").agg(F.count("*").alias("gn"), F.sum("area").alias("ga"))
    t = rows.groupBy("pred_class", "block_id").agg(F.count("*").alias("n"), F.sum("area").alias("a")).groupBy("pred_class").agg(F.sum("n").alias("tn"), F.sum("a").alias("ta"))
    return g.join(t, "pred_class").select("pred_class", (F.col("tn") - F.col("gn")).alias("dn"), (F.col("ta") - F.col("ga")).alias("darea"))


@query("M6_weighted_sampling", "parcels")
def m6(parcels: DataFrame) -> DataFrame:
    return sv.weighted_draw(parcels.withColumn("weight", 1 + F.expr("prob_pm div 100")), "parcel_id", "weight", 500, 18)
