import json

import pytest

from landgrid.sources import files


def test_regions_manifests(spark, tmp_path):
    a = [{"county": "marsh", "idx": "12", "bbox": [30, 4, 31.5, 5]}, {"county": "pine", "idx": 3.0, "bbox": [40.25, 1, 41, 2]}]
    (tmp_path / "array.json").write_text(json.dumps(a))
    (tmp_path / "split.json").write_text(json.dumps({"train": a[:1], "test": a[1:], "more": 1}))
    rows = sorted(tuple(r) for r in files.read_regions(spark, str(tmp_path / "array.json")).collect())
    assert rows == [("marsh", 12, 30.0, 4.0, 31.5, 5.0, "train"), ("pine", 3, 40.25, 1.0, 41.0, 2.0, "train")]
    assert sorted((r.county, r.split) for r in files.read_regions(spark, str(tmp_path / "split.json")).collect()) == [("marsh", "train"), ("pine", "test")]


def test_geojson_layers(spark, tmp_path):
    ring = [[7, 51], [9, 51.5], [8.25, 53], [6.5, 52], [7, 51]]
    (tmp_path / "a.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": [{"type": "Feature", "geometry": {"type": "Polygon", "coordinates": [ring]}}]}))
    points = [{"type": "Feature", "geometry": {"type": "Point", "coordinates": [5 + 3 * k, 2 * k - 4]}} for k in (0, 1)]
    (tmp_path / "b.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": points}))
    rows = {r.path[-9]: r for r in files.read_geojson(spark, str(tmp_path)).collect()}
    assert tuple(rows["a"])[1:] == (1, 6.5, 51.0, 9.0, 53.0)
    assert tuple(rows["b"])[1:] == (2, 5.0, -4.0, 5.0, -4.0)


def test_geoparquet_metadata(spark):
    rows = spark.createDataFrame([(6.5, 1.0, 8.0, 3.5), (6.0, 1.5, 7.0, 5.0)], "w double, s double, e double, n double")
    geo = lambda **k: json.dumps({"primary_column": "geometry", "columns": {"geometry": k}})
    assert files.geoparquet_box(geo(bbox=[11, -3, 14.5, 6]), rows) == (11, -3, 14.5, 6)
    assert files.geoparquet_box(geo(crs={"id": {"code": 4326}}), rows) == (6.0, 1.0, 8.0, 5.0)
    for bad in ("{}", geo(crs={"id": {"code": 3857}})):
        with pytest.raises(ValueError):
            files.geoparquet_box(bad, rows)


def opens():
    seen: dict = {}

    def client(x, y, z):
        seen[x] = seen.get(x, 0) + 1
        if x == 2 or (x == 1 and seen[x] == 1):
            raise OSError("no")
        return b"%d" % x

    return client


def fails():
    raise OSError("no client")


def test_fetch_retries_and_gives_up(spark):
    tiles = spark.createDataFrame([(x, 0, 1) for x in range(4)], "x long, y long, z int")
    got = {r.x: r.bytes for r in files.fetch_tiles(tiles, opens, 2, retries=2, base_s=0.0).collect()}
    assert {k: v and bytes(v) for k, v in got.items()} == {0: b"0", 1: b"1", 2: None, 3: b"3"}
    assert all(r.bytes is None for r in files.fetch_tiles(tiles, fails, 2, base_s=0.0).collect())
    assert files.fetch_tiles(tiles.where("x > 9"), opens, 2).count() == 0


def test_tile_store(spark, tmp_path):
    rows = spark.createDataFrame([(1, 1, 5, b"a"), (2, 1, 5, None), (1, 1, 5, b"a")], "x long, y long, z int, bytes binary")
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    files.store_tiles(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert [(r.x, bytes(r.bytes)) for r in files.stored_tiles(spark, str(tmp_path / "out")).collect()] == [(1, b"a")]


def test_product_and_catalog(spark, tmp_path):
    df = spark.createDataFrame([(1, 7), (2, 7), (3, 8)], "gid long, county int")
    files.write_product(df, str(tmp_path / "p"))
    assert spark.read.parquet(str(tmp_path / "p")).where("county = 7").count() == 2
    names = [("/a/z17_esri.tif", 1), ("/a/x_z17_esri_2.tif", 2), ("/a/z17_esri.landform.tif", 9), ("/a/z18_google.tif", 1), ("/a/none.tif", 3)]
    got = files.latest_artifact(spark.createDataFrame(names, "path string, modificationTime long")).collect()
    assert sorted((r.zoom, r.source, r.path) for r in got) == [("17", "esri", "/a/x_z17_esri_2.tif"), ("18", "google", "/a/z18_google.tif")]
