"""Tile arithmetic, probes, validation and resumption on small literals."""

import random

from pyspark.sql import functions as F

from landgrid.functions import mercator as m
from landgrid.functions import names
from landgrid.operators import tiling


def test_known_tiles(spark):
    p = spark.createDataFrame([("origin", 0.0, 0.0), ("beijing", 116.4, 39.9), ("north", 0.0, 89.9), ("west", -180.0, 0.0)], "name string, lon double, lat double")
    rows = {r.name: r for r in p.select("name", m.tile_x("lon", 10).alias("x"), m.tile_y("lat", 10).alias("y")).collect()}
    assert (rows["origin"].x, rows["origin"].y) == (512, 512)
    assert rows["beijing"].x == 843 and rows["north"].y in (-1, 0) and rows["west"].x == 0


def test_round_trip_within_a_tile(spark):
    rng = random.Random(20)
    p = spark.createDataFrame([(rng.uniform(-172, 172), rng.uniform(-74, 74)) for _ in range(200)], "lon double, lat double")
    for z in (6, 11, 15, 19):
        t = p.select("lon", "lat", m.tile_x("lon", z).alias("x"), m.tile_y("lat", z).alias("y"))
        bad = t.where((F.abs(F.col("lon") - m.tile_lon("x", z)) > 360 / 2**z) | (F.col("lat") > m.tile_lat("y", z) + 1e-9) | (F.col("lat") < m.tile_lat(F.col("y") + 1, z) - 1e-9))
        assert bad.count() == 0


def test_count_equals_expansion(spark):
    boxes = spark.createDataFrame([(1, 12.5, 41.0, 19.75, 48.5), (2, -77.0, -12.25, -61.5, 8.0), (3, 139.2, 34.9, 141.6, 36.3), (4, 2.5, 2.5, 1.0, 1.0)], "region_id int, w double, s double, e double, n double")
    ranges = tiling.tile_ranges(boxes, 7)
    want = {r.region_id: r.n for r in ranges.select("region_id", tiling.tile_count().alias("n")).collect()}
    got = {r.region_id: r["count"] for r in tiling.expand_tiles(ranges).groupBy("region_id").count().collect()}
    assert got == want and min(want.values()) >= 1


def test_probes(spark):
    ranges = spark.createDataFrame([(1, 0, 0, 100, 100), (2, 5, 5, 6, 6), (3, 7, 7, 7, 7)], "region_id int, x_min long, y_min long, x_max long, y_max long")
    probes = tiling.probe_tiles(ranges).select("region_id", "x", "y").collect()
    count = {k: sum(r.region_id == k for r in probes) for k in (1, 2, 3)}
    assert count == {1: 9, 2: 4, 3: 1} and len(set(probes)) == len(probes)


def test_bbox_reasons_in_order(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(nan, 0.0, 1.0, 1.0), (0.0, 0.0, inf, 1.0), (-181.0, 0.0, 1.0, 1.0), (0.0, -91.0, 1.0, 1.0), (0.0, 0.0, 0.0, 1.0), (2.0, 0.0, 1.0, 1.0), (0.0, 2.0, 1.0, 1.0), (0.0, 0.0, 1.0, 1.0), (None, 0.0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "w double, s double, e double, n double").coalesce(1)
    got = [r[0] for r in df.select(tiling.bbox_problem(*map(F.col, "wsen"))).collect()]
    assert got == ["not finite", "not finite", "longitude range", "latitude range", "zero area", "longitude order", "latitude order", None, "not finite"]


def test_paths_and_times(spark):
    df = spark.createDataFrame([("/o/a.tif", "epoch:60"), ("/o/a.tif/b.TIFF", "2026-05-03T10:00:00"), ("/o/plain", "never"), (None, None)], "p string, t string").coalesce(1)
    rows = df.select(names.migrated_path(F.col("p")), F.unix_timestamp(names.finished_at(F.col("t")))).collect()
    assert [r[0] for r in rows] == ["/o", "/o", "/o/plain", None] and [r[1] for r in rows][::2] == [60, None]


def test_resume_keeps_only_missing(spark):
    ranges = spark.createDataFrame([(1, 10, 20, 11, 21)], "region_id long, x_min long, y_min long, x_max long, y_max long")
    log = spark.createDataFrame([(1, 0, 0, 1), (1, 1, 1, 0), (1, 5, 5, 1)], "region_id long, dx long, dy long, has_blob int")
    assert sorted((r.x, r.y) for r in tiling.missing_tiles(ranges, log).collect()) == [(10, 21), (11, 20), (11, 21)]
    assert [(r.x, r.y) for r in tiling.cached_tiles(ranges, log).collect()] == [(10, 20)]
    r = tiling.region_progress(ranges, log).first()
    assert (r.planned, r.cached, r.missing, r.percent) == (4, 1, 3, 25.0)
