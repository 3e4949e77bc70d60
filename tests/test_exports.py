"""Exports against plain Python, and jobs without SQL by what must hold of their results."""

import json
from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from landgrid.fixtures import fixture
from landgrid.plans.registry import QUERIES, load
from landgrid.sources import files

load()
SF = "/root/testdata/sf0.001"


def cuts(parcels, size):
    """Every box cut to the windows it reaches into, in the window's coordinates."""
    for p in parcels:
        for kx in range(p.x0 // size, (p.x1 - 1) // size + 1):
            for ky in range(p.y0 // size, (p.y1 - 1) // size + 1):
                x0, x1 = max(p.x0, kx * size) - kx * size, min(p.x1, kx * size + size) - kx * size
                y0, y1 = max(p.y0, ky * size) - ky * size, min(p.y1, ky * size + size) - ky * size
                yield p, f"{kx}_{ky}", (x0, y0, x1, y1)


def test_annotations_against_plain_python(spark):
    parcels = fixture(spark, SF, "parcels").where("x1 > x0 AND y1 > y0")
    want = []
    for p, image, (x0, y0, x1, y1) in cuts(parcels.collect(), 512):
        area = (x1 - x0) * (y1 - y0)
        if area >= 30:
            want.append((image, {"segmentation": [[x0, y0, x1, y0, x1, y1, x0, y1]], "bbox": [x0, y0, x1 - x0, y1 - y0], "area": area, "category_id": p.pred_class}))
    got = [(r.image, json.loads(r.annotation)) for r in files.annotations(parcels, 512, 30).collect()]
    assert len(got) > 1000 and sorted(map(str, got)) == sorted(map(str, want))


def test_polygon_lines_against_plain_python(spark):
    parcels = fixture(spark, SF, "parcels").where("x1 > x0 AND y1 > y0")
    want = []
    for p, image, (x0, y0, x1, y1) in cuts(parcels.collect(), 512):
        if (x1 - x0) * (y1 - y0) >= 20:
            want.append((image, " ".join([str(p.pred_class - 1), *[f"{v / 512:.5f}" for v in (x0, y0, x1, y0, x1, y1, x0, y1)]])))
    got = [tuple(r) for r in files.normalised_polygons(parcels, 512).collect()]
    # Shares of 512 end in at most nine places, so halves in the sixth are rounded either way.
    near = lambda rows: sorted((i, *[round(float(v), 4) for v in line.split()]) for i, line in rows)
    assert np.allclose([r[1:] for r in near(got)], [r[1:] for r in near(want)], atol=2e-4) and [r[0] for r in near(got)] == [r[0] for r in near(want)]


def test_full_coverage_keeps_instances_and_fills_all(spark):
    pixels = {(r.cell_id, r.r, r.c): r for r in fixture(spark, SF, "pixels").collect()}
    labels = {(r.cell_id, r.r, r.c): r["inst"] for r in QUERIES["J15_full_coverage"](spark, SF).collect()}
    assert labels.keys() == pixels.keys() and min(labels.values()) == 1
    of_cell, of_instance = defaultdict(set), defaultdict(set)
    for k, label in labels.items():
        of_cell[k[0]].add(label)
        if pixels[k].truth in (1, 2):
            of_instance[k[0], pixels[k].inst_pred].add(label)
    assert all(found == set(range(1, len(found) + 1)) for found in of_cell.values())
    assert all(len(found) == 1 for found in of_instance.values())
    assert len({(k[0], *found) for k, found in of_instance.items()}) == len(of_instance)


def test_object_classifier_beats_the_majority(spark):
    rows = QUERIES["N6_object_classifier"](spark, SF).toPandas()
    truth = fixture(spark, SF, "pixels").where("truth > 0").groupBy("cell_id", "inst_pred").agg(F.mode("truth").alias("truth")).toPandas()
    both = rows.merge(truth, on=["cell_id", "inst_pred"])
    assert rows.prob.between(0, 1).all() and (rows.crop == (rows.prob > 0.5)).all() and len(rows) == len(rows[["cell_id", "inst_pred"]].drop_duplicates())
    crop = both.truth.isin([1, 2])
    fitted = both.cell_id % 2 == 0
    sure = both[fitted].groupby(crop[fitted]).prob.mean()
    assert sure[True] > 0.5 > sure[False]  # it has learnt its own cells


def test_clusters_are_tighter_than_the_whole(spark):
    scores = fixture(spark, SF, "scores").toPandas().pivot(index="vec_id", columns="k", values="v")
    found = QUERIES["N7_feature_clusters"](spark, SF).toPandas().set_index("vec_id").cluster
    assert sorted(found.index) == sorted(scores.index) and 40 <= found.nunique() <= 80
    means = scores.groupby(found.loc[scores.index].to_numpy()).transform("mean")
    assert ((scores - means) ** 2).to_numpy().sum() < 0.8 * ((scores - scores.mean()) ** 2).to_numpy().sum()
