"""Plans that hold at any size: pixels are spread over tasks, never broadcast, and not shuffled for work within a cell."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from landgrid import fixtures
from landgrid.operators import pixels as px
from landgrid.plans.registry import QUERIES, load
from tests.compare import connect

load()
SF = "/root/testdata/sf0.01"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_pixels_are_spread_over_tasks(spark, monkeypatch):
    monkeypatch.setattr(fixtures, "CELLS", 16)
    pixels = fixtures.fixture(spark, SF, "pixels")
    assert pixels.rdd.getNumPartitions() == 7
    assert pixels.groupBy(F.spark_partition_id()).count().count() > 3


@pytest.mark.parametrize("name", [
    "C14_truth_join", "C15_coarse_fine", "J1_tile_mosaic", "J22_edge_agreement", "J6_pool_and_index", "L17_detection_by_size", "L16_over_under_segmentation", "L18_boundary_f1", "J25_bilinear",
])
def test_no_join_of_pixels(spark, name):
    text = plan(QUERIES[name](spark, SF))
    assert "SortMergeJoin" not in text and "HashJoin" not in text


@pytest.mark.parametrize("name", ["J5_plain_average", "J21_symmetry_average", "M7_random_pixels", "J4_hann_blend", "J26_thin_weights", "J11_boundary_distance"])
def test_work_within_cells_shuffles_no_pixels(spark, name, monkeypatch):
    monkeypatch.setattr(fixtures, "CELLS", 16)
    text = plan(QUERIES[name](spark, SF))
    assert text.count("Exchange hashpartitioning") == 1  # the suppliers


def test_joins_of_derived_pixels_are_not_broadcast(spark):
    pixels = fixtures.fixture(spark, SF, "pixels")
    assert "BroadcastHashJoin" not in plan(pixels.join(pixels.select(*px.KEY, F.col("pred").alias("other")), px.KEY))


def test_within_against_brute_force(spark):
    points = [(1, r, c) for r in range(9) for c in range(7)] + [(2, 0, 0)]
    marked = lambda r, c: (r * 7 + c) % 11 == 0
    rows = spark.createDataFrame([(i, r, c, marked(r, c), (r + c) % 9 == 4) for i, r, c in points], "cell_id long, r long, c long, p boolean, g boolean")
    for radius in (1, 2, 3):
        for row in px.within(rows, ["p", "g"], radius).collect():
            near = [(r, c) for i, r, c in points if i == row.cell_id and (r - row.r) ** 2 + (c - row.c) ** 2 <= radius * radius]
            assert row.near_p == any(marked(r, c) for r, c in near) and row.near_g == any((r + c) % 9 == 4 for r, c in near)


def test_downsample_reads_the_rows_of_the_sql(spark):
    from landgrid.plans.registry import ORACLE
    from tests.compare import differences

    assert differences(QUERIES["F8_preview_downsample"](spark, SF), connect(SF), ORACLE["F8_preview_downsample"]) == ""


def test_full_coverage_fills_once(spark):
    assert "FlatMapGroupsInPandas" not in plan(QUERIES["J15_full_coverage"](spark, SF))  # it is written before it is read twice


def test_median_against_plain_python(spark, monkeypatch):
    monkeypatch.setattr(fixtures, "CELLS", 16)
    text = plan(QUERIES["E12_median_filter"](spark, SF))
    assert text.count("Exchange hashpartitioning") == 1 and "Pandas" not in text
    from landgrid.operators.neighbourhood import median_filter

    values = {(r, c): (r * 7 + c * 5) % 11 for r in range(8) for c in range(6) if (r, c) != (3, 2)}  # a pixel is missing
    rows = spark.createDataFrame([(1, r, c, v) for (r, c), v in values.items()], "cell_id long, r long, c long, v long")
    for row in median_filter(rows, "v").collect():
        near = sorted(v for (r, c), v in values.items() if abs(r - row.r) <= 2 and abs(c - row.c) <= 2)
        assert row.v == near[(len(near) - 1) // 2]
