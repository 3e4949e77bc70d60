"""Text, key and small relational helpers around regions and jobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def tile_url(source: str, x: str, y: str, z: int) -> Column:
    """Address of a tile: path order z/y/x, or numbered servers with a query string."""
    server = F.pmod(F.col(x) + F.col(y), F.lit(4))
    return F.when(F.col(source) == "zyx", F.concat(F.lit(f"https://tile.example/a/{z}/"), y, F.lit("/"), x)).otherwise(
        F.concat(F.lit("https://mt"), server, F.lit(".example/vt?x="), x, F.lit("&y="), y, F.lit(f"&z={z}"))
    )


def alternate_source(source: Column) -> Column:
    """The other imagery source, null for an unknown one. Case and surrounding blanks don't matter."""
    name = F.lower(F.trim(source))
    return F.when(name == "esri", "google").when(name == "google", "esri")


def safe(text: Column) -> Column:
    return F.regexp_replace(text, "[^A-Za-z0-9-]", "_")


def job_key(*parts: Column) -> Column:
    """Stable key of a job: the hash of its parts as text, the last one made safe for a file name."""
    return F.sha2(F.concat_ws("|", *[p.cast("string") for p in parts[:-1]], safe(parts[-1])), 256)


def cell_name(county: Column, idx: Column, source: Column) -> Column:
    return F.concat_ws("_", safe(county), idx.cast("string"), source)


def migrated_path(path: Column) -> Column:
    """A path without the raster files it ends in, however many."""
    return F.regexp_replace(path, r"(?i)(/[^/]*\.tiff?)+$", "")


def pixel_area(rx: Column, ry: Column, lat: Column) -> Column:
    """Square metres of a pixel of rx by ry degrees at a latitude."""
    return (rx * 111320 * F.cos(F.radians(lat))) * (ry * 111320)


def finished_at(text: Column) -> Column:
    """``epoch:N`` (seconds) or an ISO time as a timestamp, else null."""
    seconds = F.regexp_extract(text, r"^epoch:(\d+)$", 1).try_cast("long")
    return F.coalesce(F.timestamp_seconds(seconds), text.try_cast("timestamp"))


def parse_log(lines: DataFrame) -> DataFrame:
    """``(region_id, line)`` with ``x,y`` lines -> distinct ``(region_id, dx, dy)``; other lines are ignored."""
    part = lambda i: F.regexp_extract("line", r"^\s*(\d+)\s*,\s*(\d+)\s*$", i).try_cast("long")
    return lines.select("region_id", part(1).alias("dx"), part(2).alias("dy")).where("dx IS NOT NULL").distinct()


def recommended(first: str, second: str) -> Column:
    """The source with the lower latency: the first on a tie or without any, the other if one is missing."""
    a, b = F.col(first), F.col(second)
    return F.when(a.isNull() & b.isNotNull(), "google").when(b < a, "google").otherwise("esri")


def county_holdout(regions: DataFrame, seed: int, counties: int, cells: int) -> DataFrame:
    """Up to ``cells`` regions of each of ``counties`` counties, both in the order of a seeded hash."""
    draw = lambda c: F.md5(F.concat(F.col(c), F.lit(f":{seed}")).cast("binary"))
    chosen = regions.select("county").distinct().orderBy(draw("county"), "county").limit(counties)
    rank = F.row_number().over(Window.partitionBy("county").orderBy(draw("region_id"), "region_id"))
    return regions.join(F.broadcast(chosen), "county").withColumn("rank", rank).where(F.col("rank") <= cells).select("county", "region_id")


def merge_manifests(base: DataFrame, extra: DataFrame) -> DataFrame:
    """Train names of both, test names of the base only."""
    train = base.where("split = 'train'").unionByName(extra.where("split = 'train'"))
    return train.select("name", "split").distinct().unionByName(base.where("split = 'test'").select("name", "split").distinct())
