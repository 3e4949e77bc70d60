"""Queries over regions, tiles and tile events."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from landgrid.functions import mercator as m
from landgrid.functions import names
from landgrid.operators import tiling
from landgrid.plans.registry import query
from landgrid.streaming import events as ev

Z = 17
PI = "3.141592653589793"


def _tx(lon: str, z: int = Z) -> str:
    return f"CAST(floor(({lon} + 180) / 360 * {float(2**z)}) AS BIGINT)"


def _ty(lat: str, z: int = Z) -> str:
    r = f"radians(least(greatest({lat}, -85.05112878::DOUBLE), 85.05112878::DOUBLE))"
    return f"CAST(floor((1 - ln(tan({r}) + 1 / cos({r})) / {PI}::DOUBLE) / 2 * {float(2**z)}) AS BIGINT)"


def _clamp(t: str, z: int = Z) -> str:
    return f"least(greatest({t}, 0), {2**z - 1})"


_X0, _Y0 = _clamp(_tx("w")), _clamp(_ty("n"))
RANGES = f"ranges AS (SELECT *, {_X0} AS x_min, {_Y0} AS y_min, greatest({_clamp(_tx('e'))}, {_X0}) AS x_max, greatest({_clamp(_ty('s'))}, {_Y0}) AS y_max FROM regions)"
TILES = f"{RANGES}, tiles AS (SELECT region_id, x, y FROM (SELECT region_id, x, unnest(range(y_min, y_max + 1)) AS y FROM (SELECT *, unnest(range(x_min, x_max + 1)) AS x FROM ranges)))"
DONE = "done AS (SELECT DISTINCT c.region_id, r.x_min + c.dx AS x, r.y_min + c.dy AS y FROM completed c JOIN ranges r USING (region_id) WHERE c.has_blob = 1)"


@query("B1_tile_x", "points", f"SELECT point_id, {_tx('lon', 8)} AS x8, {_tx('lon')} AS x17 FROM points")
def b1(points: DataFrame) -> DataFrame:
    return points.select("point_id", m.tile_x("lon", 8).alias("x8"), m.tile_x("lon", Z).alias("x17"))


@query("B2_tile_y", "points", f"SELECT point_id, {_ty('lat', 8)} AS y8, {_ty('lat')} AS y17 FROM points")
def b2(points: DataFrame) -> DataFrame:
    return points.select("point_id", m.tile_y("lat", 8).alias("y8"), m.tile_y("lat", Z).alias("y17"))


@query("B3_tile_corner", "points", f"""
WITH t AS (SELECT point_id, {_tx('lon', 12)} AS x, {_ty('lat', 12)} AS y FROM points)
SELECT point_id, round(x / 4096.0::DOUBLE * 360 - 180, 9) AS lon, round(degrees(atan(sinh({PI}::DOUBLE * (1 - 2 * y / 4096.0::DOUBLE)))), 9) AS lat FROM t""")
def b3(points: DataFrame) -> DataFrame:
    t = points.select("point_id", m.tile_x("lon", 12).alias("x"), m.tile_y("lat", 12).alias("y"))
    return t.select("point_id", F.round(m.tile_lon("x", 12), 9).alias("lon"), F.round(m.tile_lat("y", 12), 9).alias("lat"))


@query("B4_tile_range", "regions", f"WITH {RANGES} SELECT region_id, x_min, y_min, x_max, y_max FROM ranges")
def b4(regions: DataFrame) -> DataFrame:
    return tiling.tile_ranges(regions, Z).select("region_id", "x_min", "y_min", "x_max", "y_max")


@query("B5_estimate", "regions", f"""
WITH {RANGES}, t AS (SELECT *, (x_max - x_min + 1) * (y_max - y_min + 1) AS tiles FROM ranges)
SELECT region_id, tiles, (x_max - x_min + 1) * 256 AS width_px, (y_max - y_min + 1) * 256 AS height_px,
       round(tiles * 30 / 1024, 6) AS size_mb, round(greatest(tiles / 50, 1.0::DOUBLE), 6) AS seconds FROM t""")
def b5(regions: DataFrame) -> DataFrame:
    return tiling.estimate_output(tiling.tile_ranges(regions, Z))


@query("B6_bbox_validation", "regions", """
WITH b AS (SELECT region_id, CASE WHEN region_id % 7 = 0 THEN e ELSE w END AS w, CASE WHEN region_id % 11 = 0 THEN n ELSE s END AS s,
  CASE WHEN region_id % 7 = 1 THEN 200 ELSE e END AS e, CASE WHEN region_id % 11 = 1 THEN s - 1 WHEN region_id % 11 = 2 THEN 95 ELSE n END AS n FROM regions)
SELECT region_id, CASE WHEN least(w, e) < -180 OR greatest(w, e) > 180 THEN 'longitude range' WHEN least(s, n) < -90 OR greatest(s, n) > 90 THEN 'latitude range'
  WHEN w = e OR s = n THEN 'zero area' WHEN w > e THEN 'longitude order' WHEN s > n THEN 'latitude order' END AS reason FROM b""")
def b6(regions: DataFrame) -> DataFrame:
    r = F.col("region_id")
    w, s = F.when(r % 7 == 0, F.col("e")).otherwise(F.col("w")), F.when(r % 11 == 0, F.col("n")).otherwise(F.col("s"))
    e = F.when(r % 7 == 1, 200.0).otherwise(F.col("e"))
    n = F.when(r % 11 == 1, F.col("s") - 1).when(r % 11 == 2, 95.0).otherwise(F.col("n"))
    return regions.select("region_id", tiling.bbox_problem(w, s, e, n).alias("reason"))


@query("B7_tile_extent_3857", "regions", f"""
WITH {RANGES}, u AS (SELECT *, 2 * 20037508.3427892::DOUBLE / {2**Z} AS span FROM ranges)
SELECT region_id, round(x_min * span - 20037508.3427892::DOUBLE, 4) AS west, round(20037508.3427892::DOUBLE - (y_max + 1) * span, 4) AS south,
       round((x_max + 1) * span - 20037508.3427892::DOUBLE, 4) AS east, round(20037508.3427892::DOUBLE - y_min * span, 4) AS north FROM u""")
def b7(regions: DataFrame) -> DataFrame:
    span, half, c = 2 * m.HALF / 2**Z, m.HALF, F.col
    return tiling.tile_ranges(regions, Z).select(
        "region_id", F.round(c("x_min") * span - half, 4).alias("west"), F.round(half - (c("y_max") + 1) * span, 4).alias("south"),
        F.round((c("x_max") + 1) * span - half, 4).alias("east"), F.round(half - c("y_min") * span, 4).alias("north"),
    )


@query("B8_lonlat_3857", "points", f"""
SELECT point_id, round(radians(lon) * 6378137.0::DOUBLE, 4) AS mx,
  round(ln(tan({PI}::DOUBLE / 4 + radians(least(greatest(lat, -85.05112878::DOUBLE), 85.05112878::DOUBLE)) / 2)) * 6378137.0::DOUBLE, 4) AS my FROM points""")
def b8(points: DataFrame) -> DataFrame:
    return points.select("point_id", F.round(m.mercator_x("lon"), 4).alias("mx"), F.round(m.mercator_y("lat"), 4).alias("my"))


@query("B9_crop_window", "regions", f"""
WITH {RANGES}, g AS (SELECT *, 2 * 20037508.3427892::DOUBLE / {2**Z} AS span, (x_max - x_min + 1) * 256 AS width, (y_max - y_min + 1) * 256 AS height FROM ranges),
p AS (SELECT region_id, width, height,
  least(greatest(CAST(floor((radians(w) * 6378137.0::DOUBLE - (x_min * span - 20037508.3427892::DOUBLE)) / (span / 256)) AS BIGINT), 0), width) AS l,
  least(greatest(CAST(ceil((radians(e) * 6378137.0::DOUBLE - (x_min * span - 20037508.3427892::DOUBLE)) / (span / 256)) AS BIGINT), 0), width) AS r,
  least(greatest(CAST(floor((20037508.3427892::DOUBLE - y_min * span - ln(tan({PI}::DOUBLE / 4 + radians(n) / 2)) * 6378137.0::DOUBLE) / (span / 256)) AS BIGINT), 0), height) AS t,
  least(greatest(CAST(ceil((20037508.3427892::DOUBLE - y_min * span - ln(tan({PI}::DOUBLE / 4 + radians(s) / 2)) * 6378137.0::DOUBLE) / (span / 256)) AS BIGINT), 0), height) AS b FROM g)
SELECT region_id, CASE WHEN r <= l OR b <= t THEN 0 ELSE l END AS "left", CASE WHEN r <= l OR b <= t THEN 0 ELSE t END AS top,
  CASE WHEN r <= l OR b <= t THEN width ELSE r END AS "right", CASE WHEN r <= l OR b <= t THEN height ELSE b END AS bottom FROM p""")
def b9(regions: DataFrame) -> DataFrame:
    return tiling.crop_window(tiling.tile_ranges(regions, Z), Z)


@query("B10_quadkey", "points", f"""
WITH t AS (SELECT point_id, {_tx('lon', 12)} AS x, {_ty('lat', 12)} AS y FROM points)
SELECT point_id, array_to_string(list_transform(range(11, -1, -1), lambda b: CAST(((x >> CAST(b AS INT)) & 1) + 2 * ((y >> CAST(b AS INT)) & 1) AS VARCHAR)), '') AS quadkey FROM t""")
def b10(points: DataFrame) -> DataFrame:
    t = points.select("point_id", m.tile_x("lon", 12).alias("x"), m.tile_y("lat", 12).alias("y"))
    return t.select("point_id", m.quadkey(F.col("x"), F.col("y"), 12).alias("quadkey"))


@query("B11_best_zoom", "points", f"""
SELECT point_id, round(cos(radians(lat)) * (2 * {PI}::DOUBLE * 6378137.0::DOUBLE) / (256 * pow(2.0::DOUBLE, 17)), 6) AS res17,
  CAST(coalesce(list_max(list_filter(range(11, 21), lambda z: cos(radians(lat)) * (2 * {PI}::DOUBLE * 6378137.0::DOUBLE) / (256 * pow(2.0::DOUBLE, z)) >= 5.0)), 10) AS INT) AS zoom FROM points""")
def b11(points: DataFrame) -> DataFrame:
    fits = F.filter(F.sequence(F.lit(11), F.lit(20)), lambda z: m.ground_resolution("lat", z) >= 5.0)
    return points.select("point_id", F.round(m.ground_resolution("lat", 17), 6).alias("res17"), F.coalesce(F.array_max(fits), F.lit(10)).alias("zoom"))


@query("B12_tile_url", "regions", f"""
WITH {RANGES} SELECT region_id, CASE WHEN idx % 2 = 0 THEN 'https://tile.example/a/' || '{Z}/' || y_min || '/' || x_min
  ELSE 'https://mt' || ((x_min + y_min) % 4) || '.example/vt?x=' || x_min || '&y=' || y_min || '&z={Z}' END AS url FROM ranges""")
def b12(regions: DataFrame) -> DataFrame:
    rows = tiling.tile_ranges(regions, Z).withColumn("source", F.when(F.col("idx") % 2 == 0, "zyx").otherwise("xyz"))
    return rows.select("region_id", names.tile_url("source", "x_min", "y_min", Z).alias("url"))


@query("B13_source_alternate", "regions", "SELECT region_id, CASE WHEN idx % 3 = 0 THEN 'google' WHEN idx % 3 = 1 THEN 'esri' END AS alternate FROM regions")
def b13(regions: DataFrame) -> DataFrame:
    named = F.element_at(F.array(F.lit(" ESRI"), F.lit("Google"), F.lit("bing")), (F.col("idx") % 3 + 1).cast("int"))
    return regions.select("region_id", names.alternate_source(named).alias("alternate"))


@query("B14_job_key", "regions", """
SELECT region_id, sha256(concat_ws('|', CAST(gx AS VARCHAR), CAST(gy AS VARCHAR), '17', regexp_replace('src ' || (idx % 5), '[^A-Za-z0-9-]', '_', 'g'))) AS job_key FROM regions""")
def b14(regions: DataFrame) -> DataFrame:
    return regions.select("region_id", names.job_key(F.col("gx"), F.col("gy"), F.lit(17), F.concat(F.lit("src "), F.col("idx") % 5)).alias("job_key"))


@query("B15_safe_name", "regions", "SELECT region_id, regexp_replace('c ' || county || '/é', '[^A-Za-z0-9-]', '_', 'g') || '_' || idx || '_esri' AS name FROM regions")
def b15(regions: DataFrame) -> DataFrame:
    return regions.select("region_id", names.cell_name(F.concat(F.lit("c "), "county", F.lit("/é")), F.col("idx"), F.lit("esri")).alias("name"))


@query("B16_path_migration", "regions", """
SELECT region_id, '/out/' || county AS path FROM regions""")
def b16(regions: DataFrame) -> DataFrame:
    tail = F.when(F.col("idx") % 3 == 0, "/a.tif").when(F.col("idx") % 3 == 1, "/a.TIFF/b.tif").otherwise("")
    return regions.select("region_id", names.migrated_path(F.concat(F.lit("/out/"), "county", tail)).alias("path"))


@query("B17_pixel_area", "regions", """
SELECT region_id, round(((e - w) / 256 * 111320 * cos(radians((n + s) / 2))) * ((n - s) / 256 * 111320), 6) AS pixel_m2,
  round(((e - w) / 256 * 111320 * cos(radians((n + s) / 2))) * ((n - s) / 256 * 111320) * (idx * 65) / 1000000, 6) AS valid_km2 FROM regions""")
def b17(regions: DataFrame) -> DataFrame:
    px = names.pixel_area((F.col("e") - F.col("w")) / 256, (F.col("n") - F.col("s")) / 256, (F.col("n") + F.col("s")) / 2)
    return regions.select("region_id", F.round(px, 6).alias("pixel_m2"), F.round(px * (F.col("idx") * 65) / 1000000, 6).alias("valid_km2"))


@query("B18_timestamp", "tile_events", """
SELECT event_id, CASE WHEN event_id % 3 = 0 THEN make_timestamp(CAST(event_id * 1000000000 AS BIGINT)) WHEN event_id % 3 = 1 THEN CAST('2026-05-03 10:00:00' AS TIMESTAMP) END AS at FROM tile_events""")
def b18(events: DataFrame) -> DataFrame:
    text = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("epoch:"), F.col("event_id") * 1000)).when(F.col("event_id") % 3 == 1, "2026-05-03T10:00:00").otherwise("soon")
    return events.select("event_id", names.finished_at(text).alias("at"))


@query("C1_expand_tiles", "regions", f"WITH {TILES} SELECT region_id, count(*) AS n, CAST(sum(x) AS BIGINT) AS sum_x, CAST(sum(y) AS BIGINT) AS sum_y FROM tiles GROUP BY region_id")
def c1(regions: DataFrame) -> DataFrame:
    tiles = tiling.expand_tiles(tiling.tile_ranges(regions, Z))
    return tiles.groupBy("region_id").agg(F.count("*").alias("n"), F.sum("x").alias("sum_x"), F.sum("y").alias("sum_y"))


@query("C2_resume_antijoin", "regions completed", f"""
WITH {TILES}, {DONE} SELECT region_id, count(*) AS n, CAST(sum(x) AS BIGINT) AS sum_x, CAST(sum(y) AS BIGINT) AS sum_y
FROM tiles ANTI JOIN done USING (region_id, x, y) GROUP BY region_id""")
def c2(regions: DataFrame, completed: DataFrame) -> DataFrame:
    missing = tiling.missing_tiles(tiling.tile_ranges(regions, Z), completed)
    return missing.groupBy("region_id").agg(F.count("*").alias("n"), F.sum("x").alias("sum_x"), F.sum("y").alias("sum_y"))


@query("C2_cached_semijoin", "regions completed", f"WITH {TILES}, {DONE} SELECT region_id, x, y FROM tiles SEMI JOIN done USING (region_id, x, y)")
def c2_semi(regions: DataFrame, completed: DataFrame) -> DataFrame:
    return tiling.cached_tiles(tiling.tile_ranges(regions, Z), completed)


@query("C3_used_cells_antijoin", "regions", """
SELECT r.region_id, r.gx, r.gy FROM regions r WHERE r.split = 'train' AND NOT EXISTS (SELECT 1 FROM regions u WHERE u.split = 'test' AND u.gx = r.gx AND u.gy = r.gy)""")
def c3(regions: DataFrame) -> DataFrame:
    used = regions.where("split = 'test'").select("gx", "gy").distinct()
    return regions.where("split = 'train'").join(used, ["gx", "gy"], "left_anti").select("region_id", "gx", "gy")


@query("D3_region_progress", "regions completed", f"""
WITH {RANGES}, {DONE}, cached AS (SELECT region_id, count(*) AS hits FROM done JOIN ranges r USING (region_id)
  WHERE x BETWEEN r.x_min AND r.x_max AND y BETWEEN r.y_min AND r.y_max GROUP BY region_id),
p AS (SELECT region_id, (x_max - x_min + 1) * (y_max - y_min + 1) AS planned, coalesce(hits, 0) AS cached FROM ranges LEFT JOIN cached USING (region_id))
SELECT region_id, planned, cached, planned - cached AS missing, round(100 * cached / planned, 3) AS percent FROM p""")
def d3(regions: DataFrame, completed: DataFrame) -> DataFrame:
    return tiling.region_progress(tiling.tile_ranges(regions, Z), completed)


@query("M1_probe_sample", "regions", f"""
WITH {RANGES}, a AS (SELECT region_id,
  CASE WHEN x_max - x_min <= 2 THEN range(x_min, x_max + 1) ELSE [x_min, (x_min + x_max) // 2, x_max] END AS xs,
  CASE WHEN y_max - y_min <= 2 THEN range(y_min, y_max + 1) ELSE [y_min, (y_min + y_max) // 2, y_max] END AS ys FROM ranges)
SELECT region_id, x, unnest(ys) AS y FROM (SELECT region_id, unnest(xs) AS x, ys FROM a)""")
def m1(regions: DataFrame) -> DataFrame:
    return tiling.probe_tiles(tiling.tile_ranges(regions, Z)).select("region_id", "x", "y")


@query("A7_completion_log", "completed", "SELECT DISTINCT region_id, dx, dy FROM completed WHERE dx IS NOT NULL AND dy IS NOT NULL")
def a7(completed: DataFrame) -> DataFrame:
    lines = completed.select("region_id", F.concat_ws(",", "dx", "dy").alias("line"))
    return names.parse_log(lines.union(lines.select("region_id", F.lit(" "))).union(lines.select("region_id", F.lit("1;x"))))


@query("A18_skip_existing", "regions completed", "SELECT region_id FROM regions ANTI JOIN (SELECT DISTINCT region_id FROM completed) USING (region_id)")
def a18(regions: DataFrame, completed: DataFrame) -> DataFrame:
    return regions.join(completed.select("region_id").distinct(), "region_id", "left_anti").select("region_id")


@query("G2_union_tiles", "regions completed", f"""
WITH {TILES}, {DONE}, u AS (SELECT region_id, x, y, 1 AS cached FROM tiles SEMI JOIN done USING (region_id, x, y)
  UNION ALL SELECT region_id, x, y, 0 FROM tiles ANTI JOIN done USING (region_id, x, y))
SELECT region_id, count(*) AS tiles, CAST(sum(cached) AS BIGINT) AS cached FROM u GROUP BY region_id""")
def g2(regions: DataFrame, completed: DataFrame) -> DataFrame:
    ranges = tiling.tile_ranges(regions, Z)
    both = tiling.cached_tiles(ranges, completed).withColumn("cached", F.lit(1)).unionByName(tiling.missing_tiles(ranges, completed).select("region_id", "x", "y", F.lit(0).alias("cached")))
    return both.groupBy("region_id").agg(F.count("*").alias("tiles"), F.sum("cached").alias("cached"))


@query("D1_coverage", "tile_events", """
WITH c AS (SELECT job_id, count(*) AS sampled, count(*) FILTER (status = 'placeholder') AS placeholder, count(*) FILTER (status = 'failed') AS errored FROM tile_events GROUP BY job_id)
SELECT job_id, sampled, placeholder, errored, sampled - placeholder - errored AS covered,
  round(CASE WHEN errored = sampled THEN 1.0::DOUBLE ELSE (sampled - placeholder - errored) / greatest(sampled - errored, 1) END, 6) AS ratio,
  CASE WHEN errored = sampled THEN true ELSE (sampled - placeholder - errored) / greatest(sampled - errored, 1) >= 0.34::DOUBLE END AS proceed FROM c""")
def d1(events: DataFrame) -> DataFrame:
    return ev.coverage(events)


@query("D2_outcome_totals", "tile_events", """
SELECT job_id, count(*) FILTER (status = 'ok') AS wrote, count(*) FILTER (status = 'placeholder') AS skipped, count(*) FILTER (status = 'failed') AS failed FROM tile_events GROUP BY job_id""")
def d2(events: DataFrame) -> DataFrame:
    return ev.outcome_totals(events)


@query("D3_job_progress", "tile_events", """
SELECT job_id, count(*) FILTER (status = 'ok') AS completed, CAST(sum(nbytes) AS BIGINT) AS bytes,
  coalesce(array_to_string(list_sort(list(event_id) FILTER (status = 'failed')), ','), '') AS failed FROM tile_events GROUP BY job_id""")
def d3_job(events: DataFrame) -> DataFrame:
    return ev.job_totals(events)


@query("A15_summary_upsert", "tile_events", "SELECT x, max_by(status, event_id) AS status, max(event_id) AS seq FROM tile_events GROUP BY x")
def a15(events: DataFrame) -> DataFrame:
    return ev.latest_per_key(events.select("x", "status", F.col("event_id").alias("seq")), ["x"], "seq")


@query("A16_history_store", "tile_events", """
WITH k AS (SELECT job_id, x, max(event_id) AS seq, max_by(status, event_id) AS status FROM tile_events GROUP BY job_id, x) SELECT * FROM k ORDER BY seq DESC LIMIT 10""")
def a16(events: DataFrame) -> DataFrame:
    rows = events.select("job_id", "x", F.col("event_id").alias("seq"), "status")
    old, new = rows.where("seq % 2 = 0"), rows.where("seq % 2 = 1")
    return ev.history(old, new, ["job_id", "x"], "seq", 10)


@query("F7_newest_first", "tile_events", "SELECT event_id, job_id, status FROM tile_events ORDER BY event_id DESC LIMIT 10")
def f7(events: DataFrame) -> DataFrame:
    return events.select("event_id", "job_id", "status").orderBy(F.desc("event_id")).limit(10)


@query("D26_source_recommendation", "tile_events", """
WITH p AS (SELECT job_id, median(nbytes) FILTER (x % 2 = 0 AND status = 'ok') AS a, median(nbytes) FILTER (x % 2 = 1 AND status = 'ok') AS b FROM tile_events GROUP BY job_id)
SELECT job_id, CASE WHEN a IS NULL AND b IS NOT NULL THEN 'google' WHEN b IS NOT NULL AND b < a THEN 'google' ELSE 'esri' END AS source FROM p""")
def d26(events: DataFrame) -> DataFrame:
    ok = F.col("status") == "ok"
    p = events.groupBy("job_id").agg(F.median(F.when(ok & (F.col("x") % 2 == 0), F.col("nbytes"))).alias("a"), F.median(F.when(ok & (F.col("x") % 2 == 1), F.col("nbytes"))).alias("b"))
    return p.select("job_id", names.recommended("a", "b").alias("source"))


@query("I1_running_progress", "tile_events", """
WITH t AS (SELECT job_id, event_id, ts, count(*) OVER w AS fresh, sum(nbytes) OVER w AS bytes, count(*) OVER (PARTITION BY job_id) AS total,
  (epoch_us(ts) - epoch_us(min(ts) OVER (PARTITION BY job_id))) / 1000000.0::DOUBLE AS elapsed FROM tile_events WINDOW w AS (PARTITION BY job_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING))
SELECT job_id, event_id, fresh AS completed, total, round(CAST(bytes AS BIGINT) / 1000000.0::DOUBLE / greatest(elapsed, 0.01::DOUBLE), 6) AS mb_per_s,
  round(CASE WHEN fresh = total THEN 0 ELSE elapsed * (total - fresh) / greatest(fresh, 1) END, 3) AS eta_s FROM t""")
def i1(events: DataFrame) -> DataFrame:
    return ev.progress_batch(events)


@query("I2_throttled_emission", "tile_events", """
SELECT job_id, CAST(epoch_us(ts) // 250000 AS BIGINT) AS slot, max_by(event_id, (ts, event_id)) AS last_event, count(*) AS events FROM tile_events GROUP BY ALL""")
def i2(events: DataFrame) -> DataFrame:
    return ev.throttled(events)


@query("I3_tumbling_throughput", "tile_events", """
SELECT job_id, time_bucket(INTERVAL 1 MINUTE, ts) AS minute, count(*) AS n, CAST(sum(nbytes) AS BIGINT) AS bytes, count(*) FILTER (status = 'failed') AS failed FROM tile_events GROUP BY ALL""")
def i3(events: DataFrame) -> DataFrame:
    return ev.throughput(events)


@query("I4_exactly_once", "tile_events", "SELECT DISTINCT job_id, x, y FROM tile_events WHERE status = 'ok'")
def i4(events: DataFrame) -> DataFrame:
    return ev.completed_once(events)


@query("I6_lifecycle_upsert", "tile_events", """
SELECT job_id, max_by(CASE status WHEN 'ok' THEN 'in_progress' WHEN 'failed' THEN 'failed' ELSE 'completed' END, (ts, event_id)) AS state FROM tile_events GROUP BY job_id""")
def i6(events: DataFrame) -> DataFrame:
    return ev.lifecycle(events)


@query("I7_failure_run", "tile_events", """
WITH n AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY ts, event_id) - row_number() OVER (PARTITION BY job_id, status = 'failed' ORDER BY ts, event_id) AS g FROM tile_events)
SELECT job_id, min(event_id) AS first_event, count(*) AS run FROM n WHERE status = 'failed' GROUP BY job_id, g HAVING count(*) >= 3""")
def i7(events: DataFrame) -> DataFrame:
    return ev.failure_runs(events, least=3)


@query("I8_failed_side_output", "tile_events", "SELECT event_id, job_id, x, y FROM tile_events WHERE status = 'failed'")
def i8(events: DataFrame) -> DataFrame:
    return ev.failed(events)


@query("I9_late_tiles", "tile_events", """
WITH o AS (SELECT *, count(*) FILTER (status = 'ok') OVER (PARTITION BY job_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS done,
    ts - lag(ts) OVER (PARTITION BY job_id ORDER BY ts, event_id) > INTERVAL 9 HOUR AS gap FROM tile_events),
  g AS (SELECT *, count(*) FILTER (gap) OVER (PARTITION BY job_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS gaps FROM o),
  r AS (SELECT job_id, event_id, CASE WHEN done >= 250 THEN 'done' WHEN gaps > 0 THEN 'idle' END AS reason FROM g)
SELECT job_id, event_id, reason IS NOT NULL AS late, reason FROM r""")
def i9(events: DataFrame) -> DataFrame:
    return ev.late_tiles(events, total=250, idle_minutes=9 * 60)


@query("I10_cancel_recount", "completed", "SELECT region_id, count(*) AS completed FROM completed WHERE has_blob = 1 GROUP BY region_id")
def i10(completed: DataFrame) -> DataFrame:
    return completed.where("has_blob = 1").groupBy("region_id").agg(F.count("*").alias("completed"))


@query("I11_polling_monitor", "tile_events", """
WITH b AS (SELECT time_bucket(INTERVAL 1 HOUR, ts) AS hour, count(*) FILTER (status = 'ok') AS ok FROM tile_events GROUP BY 1)
SELECT hour, CAST(sum(ok) OVER w AS BIGINT) AS successes, ok - coalesce(lag(ok) OVER w, 0) AS delta, sum(ok) OVER w >= 500 AS reached FROM b WINDOW w AS (ORDER BY hour)""")
def i11(events: DataFrame) -> DataFrame:
    return ev.monitor(events, target=500)


@query("H5_ndjson_log", "log_lines", """
WITH j AS (SELECT run_id, seq, line::JSON ->> 'type' AS type, CAST(line::JSON ->> 'n' AS BIGINT) AS n FROM log_lines WHERE line LIKE '{%')
SELECT run_id, max(n) FILTER (type = 'done') AS last_done, min(n) FILTER (type = 'error') AS first_error, max(n) FILTER (type = 'stage') AS last_stage FROM j GROUP BY run_id""")
def h5(lines: DataFrame) -> DataFrame:
    return ev.run_log(lines)


@query("D4_layer_extents", "regions", "SELECT county, min(w) AS w, min(s) AS s, max(e) AS e, max(n) AS n, count(*) AS layer_count FROM regions GROUP BY county")
def d4(regions: DataFrame) -> DataFrame:
    return regions.groupBy("county").agg(F.min("w").alias("w"), F.min("s").alias("s"), F.max("e").alias("e"), F.max("n").alias("n"), F.count("*").alias("layer_count"))


@query("F5_nested_prefixes", "regions", """
WITH r AS (SELECT region_id, row_number() OVER (ORDER BY md5(region_id || ':7'), region_id) AS rank FROM regions)
SELECT region_id, rank <= 100 AS in_100, rank <= 250 AS in_250, rank <= 1000 AS in_1000 FROM r WHERE rank <= 1000""")
def f5(regions: DataFrame) -> DataFrame:
    draw = F.md5(F.concat(F.col("region_id"), F.lit(":7")).cast("binary"))
    top = regions.select("region_id", draw.alias("draw")).orderBy("draw", "region_id").limit(1000)
    rank = F.row_number().over(Window.orderBy("draw", "region_id"))  # over the thousand rows that are left
    return top.withColumn("rank", rank).select("region_id", *[(F.col("rank") <= n).alias(f"in_{n}") for n in (100, 250, 1000)])


@query("F6_even_stride", "regions", """
WITH r AS (SELECT county, region_id, row_number() OVER (PARTITION BY county ORDER BY region_id) - 1 AS p, count(*) OVER (PARTITION BY county) AS n FROM regions)
SELECT county, region_id FROM r WHERE p % greatest(n // 10, 1) = 0 AND p // greatest(n // 10, 1) < 10""")
def f6(regions: DataFrame) -> DataFrame:
    w = Window.partitionBy("county")
    rows = regions.select("county", "region_id", (F.row_number().over(w.orderBy("region_id")) - 1).alias("p"), F.expr("greatest(count(*) OVER (PARTITION BY county) div 10, 1)").alias("step"))
    return rows.where("p % step = 0 AND p div step < 10").select("county", "region_id")


@query("M2_county_holdout", "regions", """
WITH c AS (SELECT county, row_number() OVER (ORDER BY md5(county || ':42'), county) AS rank FROM (SELECT DISTINCT county FROM regions)),
r AS (SELECT county, region_id, row_number() OVER (PARTITION BY county ORDER BY md5(region_id || ':42'), region_id) AS rank FROM regions)
SELECT r.county, r.region_id FROM r JOIN c USING (county) WHERE c.rank <= 12 AND r.rank <= 10""")
def m2(regions: DataFrame) -> DataFrame:
    return names.county_holdout(regions, 42, 12, 10)


@query("M4_reserved_resplit", "regions", """
WITH usable AS (SELECT DISTINCT county FROM regions WHERE county NOT IN (SELECT county FROM regions WHERE split = 'test')),
c AS (SELECT county, row_number() OVER (ORDER BY md5(county || ':15'), county) AS rank FROM usable),
r AS (SELECT county, region_id, row_number() OVER (PARTITION BY county ORDER BY md5(region_id || ':15'), region_id) AS rank FROM regions)
SELECT r.county, r.region_id FROM r JOIN c USING (county) WHERE c.rank <= 40 AND r.rank <= 2""")
def m4(regions: DataFrame) -> DataFrame:
    reserved = regions.where("split = 'test'").select("county").distinct()
    return names.county_holdout(regions.join(reserved, "county", "left_anti"), 15, 40, 2)


@query("M8_leakage_check", "regions", """
WITH t AS (SELECT DISTINCT gx, gy FROM regions WHERE split = 'test'), r AS (SELECT DISTINCT county FROM regions WHERE split = 'train')
SELECT (SELECT count(DISTINCT county) FROM regions SEMI JOIN r USING (county) WHERE split = 'test') AS shared_counties,
  (SELECT count(*) FROM regions SEMI JOIN t USING (gx, gy) WHERE split = 'train') AS shared_cells""")
def m8(regions: DataFrame) -> DataFrame:
    train, test = regions.where("split = 'train'"), regions.where("split = 'test'")
    counties = test.join(train.select("county").distinct(), "county", "left_semi").agg(F.countDistinct("county").alias("shared_counties"))
    return counties.crossJoin(train.join(test.select("gx", "gy").distinct(), ["gx", "gy"], "left_semi").agg(F.count("*").alias("shared_cells")))


@query("C22_county_difference", "regions", "SELECT DISTINCT county FROM regions WHERE split = 'train' EXCEPT SELECT county FROM regions WHERE split = 'test'")
def c22(regions: DataFrame) -> DataFrame:
    county = lambda s: regions.where(F.col("split") == s).select("county").distinct()
    return county("train").exceptAll(county("test"))


@query("G3_common_cells", "regions", "SELECT gx FROM regions WHERE county < 20 INTERSECT SELECT gx FROM regions WHERE county >= 20")
def g3(regions: DataFrame) -> DataFrame:
    return regions.where("county < 20").select("gx").intersect(regions.where("county >= 20").select("gx"))


@query("G5_repeat_rare", "regions", "SELECT region_id, unnest(range(CASE WHEN county < 3 THEN 4 ELSE 1 END)) AS copy FROM regions")
def g5(regions: DataFrame) -> DataFrame:
    return regions.select("region_id", F.explode(F.expr("sequence(0L, IF(county < 3, 3L, 0L))")).alias("copy"))


@query("A19_manifest_merge", "regions", """
SELECT DISTINCT 'r' || region_id % 500 AS name, 'train' AS split FROM regions WHERE split = 'train'
UNION ALL SELECT DISTINCT 'r' || region_id % 500, 'test' FROM regions WHERE split = 'test' AND county < 3""")
def a19(regions: DataFrame) -> DataFrame:
    named = regions.select(F.concat(F.lit("r"), F.col("region_id") % 500).alias("name"), "split", "county")
    return names.merge_manifests(named.where("county < 3"), named.where("county >= 3"))


@query("A12_split_manifest", "regions", """
SELECT split, array_to_string(list_sort(list(DISTINCT county)), ',') AS counties, count(*) AS cells FROM regions GROUP BY split""")
def a12(regions: DataFrame) -> DataFrame:
    return regions.groupBy("split").agg(F.array_join(F.sort_array(F.collect_set("county")), ",").alias("counties"), F.count("*").alias("cells"))


@query("H7_name_parts", "regions", "SELECT region_id, split_part(county || '_' || idx, '_', 1) AS county_name, CAST(split_part(county || '_' || idx, '_', 2) AS BIGINT) AS number FROM regions")
def h7(regions: DataFrame) -> DataFrame:
    name = F.concat_ws("_", "county", "idx")
    return regions.select("region_id", F.split_part(name, F.lit("_"), F.lit(1)).alias("county_name"), F.split_part(name, F.lit("_"), F.lit(2)).cast("long").alias("number"))


@query("C20_source_fallback", "regions completed", """
WITH p AS (SELECT region_id, max(has_blob) AS primary_blob FROM completed WHERE dx < 4 GROUP BY region_id), q AS (SELECT region_id, max(has_blob) AS second_blob FROM completed WHERE dx >= 4 GROUP BY region_id)
SELECT region_id, coalesce(second_blob, primary_blob) AS blob, second_blob IS NULL AS duplicated FROM regions JOIN p USING (region_id) LEFT JOIN q USING (region_id)""")
def c20(regions: DataFrame, completed: DataFrame) -> DataFrame:
    first = completed.where("dx < 4").groupBy("region_id").agg(F.max("has_blob").alias("primary_blob"))
    second = completed.where("dx >= 4").groupBy("region_id").agg(F.max("has_blob").alias("second_blob"))
    rows = regions.select("region_id").join(first, "region_id").join(second, "region_id", "left")
    return rows.select("region_id", F.coalesce("second_blob", "primary_blob").alias("blob"), F.col("second_blob").isNull().alias("duplicated"))
