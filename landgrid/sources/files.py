"""Sources and sinks: manifests, vector layers, tile blobs, products, exports."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

REGION = "county string, idx string, bbox array<double>"
GEOGRAPHIC = (4326, 4979)


def read_regions(spark: SparkSession, path: str) -> DataFrame:
    """``(county, idx, w, s, e, n, split)`` of a manifest that is an array of regions or an object with ``train`` and ``test``.

    ``idx`` may be a number or a numeric string. A bare array is all ``train``; other keys of the object are ignored.
    """
    text = spark.read.text(path, wholetext=True)
    bare = F.from_json("value", f"array<struct<{_ddl(REGION)}>>")
    both = F.from_json("value", f"struct<train: array<struct<{_ddl(REGION)}>>, test: array<struct<{_ddl(REGION)}>>>")
    is_array = F.col("value").rlike(r"^\s*\[")
    rows = text.select(F.when(is_array, bare).otherwise(both["train"]).alias("train"), F.when(~is_array, both["test"]).alias("test"))
    parts = rows.select(F.explode(F.array(F.struct(F.lit("train").alias("split"), F.col("train").alias("r")), F.struct(F.lit("test").alias("split"), F.col("test").alias("r")))).alias("p"))
    each = parts.select("p.split", F.explode("p.r").alias("r"))
    box = F.col("r.bbox")
    return each.select("r.county", F.trim("r.idx").try_cast("double").cast("long").alias("idx"), *[box[i].alias(c) for i, c in enumerate("wsen")], "split")


def _ddl(columns: str) -> str:
    return ", ".join(c.strip().replace(" ", ": ", 1) for c in columns.split(", "))


def read_geojson(spark: SparkSession, path: str) -> DataFrame:
    """One row ``(path, layer_count, w, s, e, n)`` for each GeoJSON file: its features and the box of the first geometry only."""
    text = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    kind = F.get_json_object("value", "$.type")
    features = F.from_json(F.get_json_object("value", "$.features"), "array<struct<geometry: string>>")
    first = F.when(kind == "FeatureCollection", features[0]["geometry"]).when(kind == "Feature", F.get_json_object("value", "$.geometry")).otherwise(F.col("value"))
    numbers = F.regexp_extract_all(first, F.lit(r"\[\s*(-?[0-9.eE+-]+)\s*,\s*(-?[0-9.eE+-]+)"), F.lit(0))
    axis = lambda i: F.transform(numbers, lambda p: F.regexp_extract(p, r"\[\s*(-?[0-9.eE+-]+)\s*,\s*(-?[0-9.eE+-]+)", i).cast("double"))
    count = F.when(kind == "FeatureCollection", F.size(features)).otherwise(1)
    return text.select("path", count.alias("layer_count"), F.array_min(axis(1)).alias("w"), F.array_min(axis(2)).alias("s"), F.array_max(axis(1)).alias("e"), F.array_max(axis(2)).alias("n"))


def geoparquet_box(metadata: str, rows: DataFrame, extents: tuple[str, str, str, str] = ("w", "s", "e", "n")) -> tuple[float, ...]:
    """The box of a layer: from its ``geo`` metadata if that holds one, else the extents over all rows.

    Raises ValueError without a primary column or with a coordinate system that is not geographic.
    """
    geo = json.loads(metadata or "{}")
    column = geo.get("columns", {}).get(geo.get("primary_column"))
    if column is None:
        raise ValueError("no primary geometry column")
    code = ((column.get("crs") or {}).get("id") or {}).get("code")
    if code is not None and int(code) not in GEOGRAPHIC:
        raise ValueError(f"coordinate system {code} is not geographic")
    if len(column.get("bbox") or []) == 4:
        return tuple(column["bbox"])
    w, s, e, n = extents
    r = rows.agg(F.min(w), F.min(s), F.max(e), F.max(n)).first()
    return tuple(r)


def fetch_tiles(tiles: DataFrame, open_client: Callable[[], Callable[[int, int, int], bytes]], concurrency: int, retries: int = 3, base_s: float = 0.2) -> DataFrame:
    """``tiles(x, y, z)`` with a column ``bytes`` by an injected client: up to ``concurrency`` tasks, ``retries`` tries with
    doubling pauses, null after the last or if the client can't start."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        try:
            client = open_client()
        except Exception:  # any client may be injected; without one every tile is failed, not the job
            client = None
        for f in frames:
            yield f.assign(bytes=[_try(client, x, y, z, retries, base_s) for x, y, z in zip(f.x, f.y, f.z, strict=True)])

    schema = ", ".join(f"`{n}` {t}" for n, t in tiles.dtypes) + ", bytes binary"
    return tiles.repartition(concurrency).mapInPandas(run, schema)


def _try(client: Callable | None, x: int, y: int, z: int, retries: int, base_s: float) -> bytes | None:
    for attempt in range(retries if client else 0):
        try:
            return client(int(x), int(y), int(z))
        except Exception:  # the injected client's own errors mean a failed try
            if attempt + 1 < retries:
                time.sleep(base_s * 2**attempt)
    return None


def store_tiles(fetched: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append a stream of fetched tiles to ``path/blobs``, then to ``path/log``, so that a logged tile always has its bytes."""

    def append(batch: DataFrame, number: int) -> None:
        done = batch.where("bytes IS NOT NULL")
        done.write.mode("overwrite").parquet(f"{path}/blobs/batch={number}")
        done.select("x", "y", "z").write.mode("overwrite").parquet(f"{path}/log/batch={number}")

    return fetched.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stored_tiles(spark: SparkSession, path: str) -> DataFrame:
    """Logged tiles that have bytes; a logged tile without is not returned, so it is fetched again."""
    blobs = spark.read.parquet(f"{path}/blobs").select("x", "y", "z", "bytes")
    return blobs.join(spark.read.parquet(f"{path}/log").select("x", "y", "z").distinct(), ["x", "y", "z"], "left_semi").dropDuplicates(["x", "y", "z"])


def write_product(parcels: DataFrame, path: str) -> None:
    """A product partitioned by county, sorted inside files so that row-group statistics prune; a large county has several files."""
    parcels.repartitionByRange("county", "gid").sortWithinPartitions("county", "gid").write.mode("overwrite").partitionBy("county").parquet(path)


def read_parts(spark: SparkSession, path: str) -> DataFrame:
    """The parts of a product under ``path`` as one table; parts that can't be read are skipped."""
    return spark.read.option("ignoreCorruptFiles", "true").option("ignoreMissingFiles", "true").parquet(path)


def latest_artifact(catalog: DataFrame) -> DataFrame:
    """The newest raster of each zoom and source in a file catalog ``(path, modificationTime)``; landform rasters don't count."""
    part = lambda i: F.regexp_extract("path", r"z(\d+)_([a-z]+)[^/]*\.tiff?$", i)
    rows = catalog.where(~F.col("path").contains(".landform.")).select(part(1).alias("zoom"), part(2).alias("source"), "path", "modificationTime").where("zoom <> ''")
    return rows.groupBy("zoom", "source").agg(F.max_by("path", F.struct("modificationTime", "path")).alias("path"))


def clipped_ring() -> Column:
    """Corner points of a clipped box ``x0..y1`` in the window's own coordinates."""
    return F.array(*[F.struct((F.col(x) - F.col("wx")).alias("x"), (F.col(y) - F.col("wy")).alias("y")) for x, y in (("x0", "y0"), ("x1", "y0"), ("x1", "y1"), ("x0", "y1"))])


def window_clips(parcels: DataFrame, size: int) -> DataFrame:
    """Each parcel cut to the square windows that it touches, with the window's corner ``wx, wy``."""
    span = lambda a, b: F.explode(F.expr(f"sequence({a} div {size}, ({b} - 1) div {size})"))
    rows = parcels.withColumn("kx", span("x0", "x1")).withColumn("ky", span("y0", "y1")).withColumns({"wx": F.col("kx") * size, "wy": F.col("ky") * size})
    cut = {"x0": F.greatest("x0", "wx"), "y0": F.greatest("y0", "wy"), "x1": F.least("x1", F.col("wx") + size), "y1": F.least("y1", F.col("wy") + size)}
    return rows.withColumns(cut)


def annotations(parcels: DataFrame, size: int, min_area: int) -> DataFrame:
    """Instance annotations by window: ``(image, annotation)`` with a JSON of segment, box, area and class; small cuts go, and so do empty windows."""
    rows = window_clips(parcels, size).withColumn("area", F.expr("(x1 - x0) * (y1 - y0)")).where(F.col("area") >= min_area)
    flat = F.flatten(F.transform(clipped_ring(), lambda p: F.array(p["x"], p["y"])))
    box = F.array(F.col("x0") - F.col("wx"), F.col("y0") - F.col("wy"), F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"))
    body = F.struct(F.array(flat).alias("segmentation"), box.alias("bbox"), "area", F.col("pred_class").alias("category_id"))
    return rows.select(F.concat_ws("_", "kx", "ky").alias("image"), "area", F.to_json(body).alias("annotation"))


def normalised_polygons(parcels: DataFrame, size: int, min_area: int = 20) -> DataFrame:
    """``(image, line)``: class and corner coordinates as shares of the window, five decimals, cuts under ``min_area`` left out."""
    rows = window_clips(parcels, size).where(F.expr("(x1 - x0) * (y1 - y0)") >= min_area)
    share = lambda v: F.format_string("%.5f", F.least(F.greatest(v / size, F.lit(0.0)), F.lit(1.0)))
    corners = F.flatten(F.transform(clipped_ring(), lambda p: F.array(share(p["x"]), share(p["y"]))))
    return rows.select(F.concat_ws("_", "kx", "ky").alias("image"), F.concat_ws(" ", (F.col("pred_class") - 1).cast("string"), F.array_join(corners, " ")).alias("line"))
