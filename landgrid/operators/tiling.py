"""Tile plans of regions, resumption against finished work, and progress."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from landgrid.functions.mercator import HALF, clamp_tile, mercator_x, mercator_y, tile_x, tile_y


def tile_ranges(regions: DataFrame, z: int) -> DataFrame:
    """Add the inclusive tile range of each box ``w, s, e, n``: clamped to the grid, a maximum never below its minimum."""
    x0, y0 = clamp_tile(tile_x("w", z), z), clamp_tile(tile_y("n", z), z)
    return regions.withColumns({
        "x_min": x0, "y_min": y0,
        "x_max": F.greatest(clamp_tile(tile_x("e", z), z), x0), "y_max": F.greatest(clamp_tile(tile_y("s", z), z), y0),
    })


def tile_count() -> Column:
    return (F.col("x_max") - F.col("x_min") + 1) * (F.col("y_max") - F.col("y_min") + 1)


def expand_tiles(ranges: DataFrame) -> DataFrame:
    """One row for each tile ``x, y`` of each range."""
    rows = ranges.withColumn("y", F.explode(F.sequence("y_min", "y_max")))
    return rows.withColumn("x", F.explode(F.sequence("x_min", "x_max")))


def finished_tiles(ranges: DataFrame, log: DataFrame) -> DataFrame:
    """Logged tiles ``(region_id, x, y)`` that have bytes; the log holds offsets within the region's range."""
    done = log.where("has_blob = 1").join(ranges.select("region_id", "x_min", "y_min"), "region_id")
    return done.select("region_id", (F.col("x_min") + F.col("dx")).alias("x"), (F.col("y_min") + F.col("dy")).alias("y")).distinct()


def missing_tiles(ranges: DataFrame, log: DataFrame) -> DataFrame:
    """Planned tiles that are not finished. Plan and log meet on the rows of regions: finished columns of a row are subtracted as
    a set, so no single tile is shuffled."""
    done = log.where("has_blob = 1").groupBy("region_id", "dy").agg(F.collect_set("dx").alias("done"))
    rows = ranges.withColumn("y", F.explode(F.sequence("y_min", "y_max"))).withColumn("dy", F.col("y") - F.col("y_min"))
    left = F.sequence(F.lit(0).cast("long"), F.col("x_max") - F.col("x_min"))
    open_ = F.when(F.col("done").isNull(), left).otherwise(F.array_except(left, F.col("done")))
    rows = rows.join(done, ["region_id", "dy"], "left").withColumn("dx", F.explode(open_))
    return rows.withColumn("x", F.col("x_min") + F.col("dx")).select(*ranges.columns, "y", "x")


def cached_tiles(ranges: DataFrame, log: DataFrame) -> DataFrame:
    """Finished tiles that are planned. The range test replaces a join with the expanded plan."""
    done = finished_tiles(ranges, log).join(ranges.select("region_id", "x_min", "x_max", "y_min", "y_max"), "region_id")
    return done.where("x BETWEEN x_min AND x_max AND y BETWEEN y_min AND y_max").select("region_id", "x", "y")


def region_progress(ranges: DataFrame, log: DataFrame) -> DataFrame:
    """Planned, cached and missing tiles and the percentage done of every region."""
    cached = cached_tiles(ranges, log).groupBy("region_id").agg(F.count("*").alias("cached"))
    rows = ranges.select("region_id", tile_count().alias("planned")).join(cached, "region_id", "left")
    done = F.coalesce("cached", F.lit(0))
    return rows.select("region_id", "planned", done.alias("cached"), (F.col("planned") - done).alias("missing"), F.round(100 * done / F.col("planned"), 3).alias("percent"))


def probe_tiles(ranges: DataFrame) -> DataFrame:
    """A 3 by 3 sample of each range: lowest, middle and highest of each axis, every tile of an axis of up to three."""

    def axis(a: str) -> Column:
        lo, hi = F.col(f"{a}_min"), F.col(f"{a}_max")
        return F.when(hi - lo <= 2, F.sequence(lo, hi)).otherwise(F.array_distinct(F.array(lo, F.floor((lo + hi) / 2), hi)))

    return ranges.withColumn("x", F.explode(axis("x"))).withColumn("y", F.explode(axis("y")))


def estimate_output(ranges: DataFrame) -> DataFrame:
    """Tiles, image size in pixels, megabytes (30 KB a tile) and seconds (50 tiles a second, one at least)."""
    n = tile_count()
    return ranges.select(
        "region_id", n.alias("tiles"),
        ((F.col("x_max") - F.col("x_min") + 1) * 256).alias("width_px"), ((F.col("y_max") - F.col("y_min") + 1) * 256).alias("height_px"),
        F.round(n * 30 / 1024, 6).alias("size_mb"), F.round(F.greatest(n / 50, F.lit(1.0)), 6).alias("seconds"),
    )


def bbox_problem(w: Column, s: Column, e: Column, n: Column) -> Column:
    """The first rule that a box breaks, null if none."""
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))
    return (
        F.when(~(finite(w) & finite(s) & finite(e) & finite(n)), "not finite")
        .when((F.least(w, e) < -180) | (F.greatest(w, e) > 180), "longitude range")
        .when((F.least(s, n) < -90) | (F.greatest(s, n) > 90), "latitude range")
        .when((w == e) | (s == n), "zero area")
        .when(w > e, "longitude order")
        .when(s > n, "latitude order")
    )


def crop_window(ranges: DataFrame, z: int) -> DataFrame:
    """Pixel window of each box in its mosaic: minima floored, maxima ceiled, within the image; the whole image if degenerate."""
    span = 2 * HALF / 2**z
    west, north = F.col("x_min") * span - HALF, HALF - F.col("y_min") * span
    wide, high = (F.col("x_max") - F.col("x_min") + 1) * 256, (F.col("y_max") - F.col("y_min") + 1) * 256
    px = span / 256
    inside = lambda v, most: F.least(F.greatest(v, F.lit(0).cast("long")), most)
    rows = ranges.select(
        "region_id", wide.alias("width"), high.alias("height"),
        inside(F.floor((mercator_x("w") - west) / px), wide).alias("left"), inside(F.ceil((mercator_x("e") - west) / px), wide).alias("right"),
        inside(F.floor((north - mercator_y("n")) / px), high).alias("top"), inside(F.ceil((north - mercator_y("s")) / px), high).alias("bottom"),
    )
    bad = (F.col("right") <= F.col("left")) | (F.col("bottom") <= F.col("top"))
    zero = F.lit(0).cast("long")
    return rows.select("region_id", F.when(bad, zero).otherwise(F.col("left")).alias("left"), F.when(bad, zero).otherwise(F.col("top")).alias("top"), F.when(bad, F.col("width")).otherwise(F.col("right")).alias("right"), F.when(bad, F.col("height")).otherwise(F.col("bottom")).alias("bottom"))


def first_per_key(rows: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key in the given order."""
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__n = 1").drop("__n")


def top_per_key(rows: DataFrame, keys: list[str], k: int, *order: Column, rank: str = "rank") -> DataFrame:
    """The first ``k`` rows of each key, with their rank."""
    return rows.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(rank) <= k)


