import numpy as np

from landgrid.fixtures import fixture
from landgrid.operators import neighbourhood as nb
from landgrid.operators import outlines, pixels, spatial, survey
from landgrid.functions import rings
from pyspark.sql import functions as F


def test_overlaps_do_not_depend_on_the_grid(spark):
    parcels = fixture(spark, "/root/testdata/sf0.01", "parcels")
    for g in (50, 128):
        r = spatial.overlapping_pairs(parcels, g).agg(F.count("*"), F.sum("area")).first()
        assert tuple(r) == (3672, 354619)


def test_resolution_removes_every_overlap(spark):
    boxes = spark.createDataFrame([(1, 0, 0, 10, 10), (2, 5, 0, 12, 5), (3, 6, 0, 8, 20), (4, 100, 0, 101, 1)], "parcel_id long, x0 long, y0 long, x1 long, y1 long")
    kept = {r.parcel_id: r.area - r.lost for r in spatial.resolve_overlaps(boxes).collect()}
    assert sum(kept.values()) == spatial.union_area(boxes.withColumn("k", F.lit(1)), ["k"]).first().area
    assert kept[1] == 100 and kept[4] == 1


def test_outlines_keep_area_and_holes(spark):
    rows = [(1, r, c, 2 if r == c == 2 else 1) for r in range(5) for c in range(5)]
    rings_ = outlines.outlines(spark.createDataFrame(rows, "cell_id long, r long, c long, inst long"), "inst").collect()
    areas = {}
    for r in rings_:
        areas.setdefault(r.inst, []).append(r.signed_area)
    assert sorted(areas[1]) == [-1.0, 25.0] and areas[2] == [1.0]


def test_ring_measures(spark):
    r = spark.sql("SELECT array(named_struct('x', 0D, 'y', 0D), named_struct('x', 4D, 'y', 0D), named_struct('x', 0D, 'y', 3D), named_struct('x', 0D, 'y', 0D)) AS ring")
    ring = F.col("ring")
    assert tuple(r.select(rings.ring_area(ring), rings.ring_perimeter(ring), rings.contains(ring, F.lit(1.0), F.lit(1.0)), rings.contains(ring, F.lit(3.0), F.lit(3.0))).first()) == (6.0, 12.0, True, False)


def test_components_by_both_connectivities(spark):
    grid = ["110", "001", "101"]
    df = spark.createDataFrame([(1, r, c, int(v)) for r, row in enumerate(grid) for c, v in enumerate(row)], "cell_id long, r long, c long, v long")
    assert pixels.components(df, "v").select("region").distinct().count() == 3
    assert pixels.components(df, "v", diagonal=True).select("region").distinct().count() == 2


def test_simplified_points():
    line = np.array([[0, 0], [1, 0.1], [2, 0], [3, 5], [4, 0]], float)
    assert nb.simplify_points(line, 0.5).tolist() == [[0, 0], [2, 0], [3, 5], [4, 0]]


def test_greedy_suppression(spark):
    masks = spark.createDataFrame([(1, 1, 9, 100), (1, 2, 8, 100), (1, 3, 7, 100), (1, 4, 99, 10)], "cell_id long, mask long, score int, px int")
    pairs = spark.createDataFrame([(1, 1, 2, 0.6), (1, 2, 1, 0.6), (1, 2, 3, 0.9), (1, 3, 2, 0.9)], "cell_id long, mask long, other long, iou double")
    assert sorted(r["mask"] for r in nb.suppress(masks, pairs).collect()) == [1, 3]


def test_draws_follow_the_weights(spark):
    rows = spark.createDataFrame([(i, 1 if i else 99) for i in range(11)], "id long, w long")
    got = survey.weighted_draw(rows.withColumnRenamed("id", "key"), "key", "w", 1000, 5).groupBy("key").count().collect()
    assert sum(r["count"] for r in got) == 1000 and {r.key: r["count"] for r in got}[0] > 850


def test_windows_are_scored(spark):
    rows = spark.createDataFrame([(1, [1.0, 2.0, 3.0, 4.0])], "window_id long, values array<double>")
    assert nb.score_windows(rows, lambda: lambda a: a * 2, 2).first().probs == [2.0, 4.0, 6.0, 8.0]


def test_top_fraction_of_each_key(spark):
    rows = [(k, (i * 37) % 11 if i % 7 else None, i) for i in range(200) for k in ([0, 1, None][i % 3],)]
    frame = spark.createDataFrame(rows, "k long, score long, id long")
    want = []
    for k in (0, 1, None):
        own = sorted((r for r in rows if r[0] == k), key=lambda r: (r[1] is None, -(r[1] or 0), r[2]))
        want += own[: int(len(own) * 0.7)]
    assert sorted(map(str, map(tuple, survey.keep_top_fraction(frame, "k", "score", 0.7, "id").collect()))) == sorted(map(str, want))


def test_sizes_in_the_plan_of_groups_stay_those_of_the_rows(spark):
    links = spark.range(300).select(F.col("id").alias("u"), (F.col("id") + 1).alias("v"))
    groups = spatial.linked_groups(links)
    assert {r.root for r in groups.collect()} == {0}
    assert groups._jdf.queryExecution().optimizedPlan().stats().sizeInBytes() < 10**6


def test_slivers_take_the_largest_neighbour_without_sorting_pairs(spark):
    rows = [(1, 0, 0, 1, 9), (2, 1, 0, 50, 40), (3, -49, 0, 0, 40), (4, 0, 9, 20, 40), (5, 500, 0, 501, 9), (6, 501, 0, 3_000_000_000, 1_000_000_000), (7, 400, 0, 500, 9), (8, 900_000, -7, 900_001, -4)]
    parcels = spark.createDataFrame(rows[:4] + rows[7:], "parcel_id long, x0 long, y0 long, x1 long, y1 long")
    found = spatial.merge_slivers(parcels)
    assert {r.parcel_id: r.target for r in found.collect()} == {1: 2, 8: None}
    assert "SortAggregate" not in found._jdf.queryExecution().executedPlan().toString()
    far = spark.createDataFrame(rows[4:7], "parcel_id long, x0 long, y0 long, x1 long, y1 long")
    assert {r.parcel_id: r.target for r in spatial.merge_slivers(far, g=1 << 31).collect()} == {5: 6}  # 3e18 square units
