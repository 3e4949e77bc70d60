"""Queries of sources, sinks, hand-off points, SQL functions and shared borders."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from landgrid.functions import sqlnames
from landgrid.functions.landuse import rule_table
from landgrid.operators import coverage as cv
from landgrid.operators import neighbourhood as nb
from landgrid.operators import tiling
from landgrid.plans.registry import query
from landgrid.plans.tiles import RANGES, TILES, Z
from landgrid.session import shared_path
from landgrid.sources import files
from landgrid.streaming import events as ev


@query("A1_regions_manifest", "regions", """
SELECT CAST(county AS VARCHAR) AS county, idx, w, s, e, n, CASE WHEN region_id // 4096 % 2 = 0 THEN 'train' ELSE split END AS split FROM regions""")
def a1(regions: DataFrame) -> DataFrame:
    """Manifests of up to 4096 regions, arrays and objects in turn, numbers of regions as strings; written and read."""
    one = F.struct(F.col("county").cast("string").alias("county"), F.col("idx").cast("string").alias("idx"), F.array("w", "s", "e", "n").alias("bbox"))
    of = lambda split: F.collect_list(F.when(F.col("split") == split, one)).alias(split)
    lists = regions.groupBy(F.expr("region_id div 4096").alias("part")).agg(F.to_json(F.collect_list(one)).alias("bare"), F.to_json(F.struct(of("train"), of("test"))).alias("both"))
    path = shared_path(regions.sparkSession, "manifests")
    lists.select("part", F.when(F.col("part") % 2 == 0, F.col("bare")).otherwise(F.col("both")).alias("value")).write.partitionBy("part").text(path)
    return files.read_regions(regions.sparkSession, path)


@query("A8_tile_store", "regions", f"WITH {RANGES} SELECT DISTINCT x_min AS x, y_min AS y, length('{Z}/' || x_min || '/' || y_min) AS nbytes FROM ranges WHERE x_min % 5 <> 0")
def a8(regions: DataFrame) -> DataFrame:
    """Fetched tiles streamed into the blob store and its log, then read back."""
    spark, path = regions.sparkSession, shared_path(regions.sparkSession, "tile-store")
    tiles = tiling.tile_ranges(regions, Z).select(F.col("x_min").alias("x"), F.col("y_min").alias("y"), F.lit(Z).alias("z"))
    body = F.encode(F.concat_ws("/", "z", "x", "y"), "UTF-8")
    tiles.withColumn("bytes", F.when(F.col("x") % 5 != 0, body)).write.parquet(f"{path}/fetched")
    fetched = spark.readStream.schema("x long, y long, z int, bytes binary").parquet(f"{path}/fetched")
    files.store_tiles(fetched, f"{path}/store", f"{path}/progress").awaitTermination()
    return files.stored_tiles(spark, f"{path}/store").select("x", "y", F.octet_length("bytes").cast("long").alias("nbytes"))


def flaky_client():
    """A client whose tiles of every fifth column never come, and whose other tiles come at the second try."""
    tried: set[tuple[int, int, int]] = set()

    def get(x: int, y: int, z: int) -> bytes:
        if x % 5 == 0 or (x, y, z) not in tried:
            tried.add((x, y, z))
            raise OSError("no tile")
        return f"{z}/{x}/{y}".encode()

    return get


def steady_client():
    return lambda x, y, z: b"%d,%d" % (y, x)


def _first_tiles(regions: DataFrame) -> DataFrame:
    return tiling.tile_ranges(regions, Z).select("region_id", F.col("x_min").alias("x"), F.col("y_min").alias("y"), F.lit(Z).alias("z"))


@query("A9_tile_fetch", "regions", f"WITH {RANGES} SELECT region_id, CASE WHEN x_min % 5 <> 0 THEN md5('{Z}/' || x_min || '/' || y_min) END AS digest FROM ranges")
def a9(regions: DataFrame) -> DataFrame:
    return files.fetch_tiles(_first_tiles(regions), flaky_client, 8, retries=2, base_s=0.0).select("region_id", F.md5("bytes").alias("digest"))


@query("N1_tile_fetcher", "regions", f"WITH {RANGES} SELECT region_id, y_min || ',' || x_min AS body FROM ranges")
def n1(regions: DataFrame) -> DataFrame:
    return files.fetch_tiles(_first_tiles(regions), steady_client, 8, base_s=0.0).select("region_id", F.decode("bytes", "UTF-8").alias("body"))


@query("A10_product_sink", "parcels", "SELECT county, pred_class AS class_id, count(*) AS parcels, CAST(sum((x1 - x0) * (y1 - y0)) AS BIGINT) AS area FROM parcels GROUP BY ALL")
def a10(parcels: DataFrame) -> DataFrame:
    """A product written by county and read back."""
    path = shared_path(parcels.sparkSession, "product")
    files.write_product(parcels.select(F.col("parcel_id").alias("gid"), "county", F.col("pred_class").alias("class_id"), F.expr("(x1 - x0) * (y1 - y0)").alias("area")), path)
    back = files.read_parts(parcels.sparkSession, path).withColumn("county", F.col("county").cast("long"))
    return back.groupBy("county", "class_id").agg(F.count("*").alias("parcels"), F.sum("area").alias("area"))


@query("A17_latest_artifact", "tile_events", """
WITH c AS (SELECT event_id, CAST(10 + x % 5 AS VARCHAR) AS zoom, CASE WHEN y % 2 = 0 THEN 'esri' ELSE 'google' END AS source, event_id % 7 = 0 AS landform, job_id FROM tile_events)
SELECT zoom, source, max_by('/out/' || job_id || '/z' || zoom || '_' || source || '_' || event_id || '.tif', event_id) AS path FROM c WHERE NOT landform GROUP BY ALL""")
def a17(events: DataFrame) -> DataFrame:
    name = F.format_string("/out/%d/z%d_%s_%d%s.tif", "job_id", F.col("x") % 5 + 10, F.when(F.col("y") % 2 == 0, "esri").otherwise("google"), "event_id", F.when(F.col("event_id") % 7 == 0, ".landform").otherwise(""))
    return files.latest_artifact(events.select(name.alias("path"), F.col("event_id").alias("modificationTime")))


@query("G4_key_difference", "regions", "SELECT gx, gy FROM regions WHERE split = 'train' EXCEPT SELECT gx, gy FROM regions WHERE split = 'test'")
def g4(regions: DataFrame) -> DataFrame:
    keys = lambda split: regions.where(F.col("split") == split).select("gx", "gy")
    return keys("train").distinct().join(keys("test"), ["gx", "gy"], "left_anti")


@query("I5_status_rows", "tile_events", """
SELECT job_id, count(*) FILTER (status = 'ok') AS completed, count(*) FILTER (status = 'failed') AS failed, CAST(sum(nbytes) AS BIGINT) AS bytes, max(ts) AS at FROM tile_events GROUP BY job_id""")
def i5(events: DataFrame) -> DataFrame:
    """The status rows that a stream over all events leaves behind."""
    spark, path = events.sparkSession, shared_path(events.sparkSession, "status")
    events.write.parquet(f"{path}/events")
    ev.status_stream(spark.readStream.schema(events.schema).parquet(f"{path}/events"), f"{path}/rows", f"{path}/progress", {"availableNow": True}).awaitTermination()
    return ev.status_rows(spark, f"{path}/rows")


def row_means():
    return lambda window: window.mean(axis=1)


@query("N2_window_scorer", "pixels", "SELECT cell_id * 16 + r // 16 * 4 + c // 16 AS window_id, r % 16 AS k, avg(prob_pm) AS prob FROM pixels GROUP BY ALL")
def n2(pixels: DataFrame) -> DataFrame:
    name = F.expr("cell_id * 16 + r div 16 * 4 + c div 16").alias("window_id")
    cells = F.array_sort(F.collect_list(F.struct("r", "c", F.col("prob_pm").cast("double").alias("v"))))
    windows = pixels.groupBy(name).agg(F.transform(cells, lambda x: x["v"]).alias("values"))
    return nb.score_windows(windows, row_means, 16).select("window_id", F.posexplode("probs").alias("k", "prob")).withColumn("k", F.col("k").cast("long"))


@query("N3_rule_table", "pixels", """
SELECT cell_id, CASE WHEN blu > red AND blu > grn THEN 6 WHEN grn >= red AND grn > blu THEN 4 WHEN red + grn + blu > 510 THEN 5 ELSE 0 END AS cls, count(*) AS n FROM pixels GROUP BY ALL""")
def n3(pixels: DataFrame) -> DataFrame:
    rules = [(2, "grn >= red AND grn > blu", 4), (1, "blu > red AND blu > grn", 6), (3, "red + grn + blu > 510", 5)]
    table = pixels.sparkSession.createDataFrame(rules, "rank int, condition string, cls int")
    return pixels.groupBy("cell_id", rule_table(table).alias("cls")).agg(F.count("*").alias("n"))


@query("N4_tiles_function", "regions", f"WITH {TILES} SELECT region_id, count(*) AS n, CAST(sum(x) AS BIGINT) AS sum_x, CAST(sum(y) AS BIGINT) AS sum_y FROM tiles GROUP BY region_id")
def n4(regions: DataFrame) -> DataFrame:
    sqlnames.register(regions.sparkSession)
    return regions.sparkSession.sql(f"SELECT region_id, count(*) AS n, sum(x) AS sum_x, sum(y) AS sum_y FROM {{regions}}, LATERAL tiles_of(w, s, e, n, {Z}) GROUP BY region_id", regions=regions)


@query("N4_windows_function", "pixels", "SELECT DISTINCT cell_id, unnest([0, 16, 32, 40]) AS start FROM pixels")
def n4_windows(pixels: DataFrame) -> DataFrame:
    sqlnames.register(pixels.sparkSession)
    return pixels.sparkSession.sql("SELECT cell_id, start FROM (SELECT DISTINCT cell_id FROM {pixels}), LATERAL windows_of(64, 24, 16)", pixels=pixels)


@query("N5_sql_metrics", "pixels", """
WITH k AS (SELECT county, count(*) FILTER (truth = 1 AND pred = 1)::DOUBLE AS tp, count(*) FILTER (truth <> 1 AND pred = 1)::DOUBLE AS fp, count(*) FILTER (truth = 1 AND pred <> 1)::DOUBLE AS fn FROM pixels GROUP BY 1),
q AS (SELECT *, tp / (tp + fp + 1e-9::DOUBLE) AS p, tp / (tp + fn + 1e-9::DOUBLE) AS r FROM k)
SELECT county, round(2 * p * r / (p + r + 1e-9::DOUBLE), 6) AS f1, round(100 * least(tp + fp, tp + fn) / greatest(tp + fp, tp + fn), 6) AS agreement FROM q""")
def n5(pixels: DataFrame) -> DataFrame:
    sqlnames.register(pixels.sparkSession)
    tp, fp, fn = (f"count_if(truth {a} 1 AND pred {b} 1)" for a, b in (("=", "="), ("<>", "="), ("=", "<>")))
    return pixels.sparkSession.sql(f"SELECT county, round(f, 6) AS f1, round(a, 6) AS agreement FROM (SELECT county, f1({tp}, {fp}, {fn}) AS f, area_agreement({tp} + {fp}, {tp} + {fn}) AS a FROM {{pixels}} GROUP BY county)", pixels=pixels)


@query("K3_smooth_coverage", "pixels")
def k3(pixels: DataFrame) -> DataFrame:
    return cv.face_rings(cv.smooth_arcs(pixels, "inst_gt"))


@query("K3_coverage_whole", "pixels", "SELECT cell_id, count(DISTINCT inst_gt) AS faces, CAST(count(*) AS DOUBLE) AS area FROM pixels GROUP BY 1")
def k3_whole(pixels: DataFrame) -> DataFrame:
    """The smoothed faces of a grid still add up to the grid: no gap, no overlap."""
    areas = cv.face_areas(cv.smooth_arcs(pixels, "inst_gt"))
    return areas.groupBy("cell_id").agg(F.count("*").alias("faces"), F.round(F.sum("area"), 6).alias("area"))
