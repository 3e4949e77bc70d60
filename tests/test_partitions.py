"""Planar partitions against brute force on quarters of unit squares, and by their invariants on rings in any direction."""

import math
import random
from collections import defaultdict
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from landgrid.operators import faces as fc
from landgrid.operators import overlay as ov
from landgrid.plans import partitions as pt
from landgrid.session import written

SCHEMA = "pid long, rings array<array<struct<x: long, y: long>>>"
QUARTERS = ((2, 1), (2, 3), (1, 2), (3, 2))


def box(x, y, w, h):
    return [(x, y), (x + w, y), (x + w, y + h), (x, y + h), (x, y)]


def frame(spark, polygons, scale=1):
    rows = [(i, [[{"x": scale * x, "y": scale * y} for x, y in r] for r in rings]) for i, rings in polygons]
    return spark.createDataFrame(rows, SCHEMA)


def partition(spark, polygons, scale=1, g=ov.GRID):
    polygons = frame(spark, polygons, scale)
    ranks = polygons.select("pid", F.col("pid").alias("id"), F.col("pid").alias("rank"))
    return written(ov.owned(ov.sided(written(ov.noded(ov.ring_edges(polygons), g)), g), ranks))


def inside(rings, x, y):
    """Crossing number with exact fractions."""
    odd = False
    for r in rings:
        for (ax, ay), (bx, by) in zip(r, r[1:], strict=False):
            if (ay > y) != (by > y) and x < ax + Fraction((bx - ax) * (y - ay), by - ay):
                odd = not odd
    return odd


def octilinear(count, seed, reach=60):
    rng, out = random.Random(seed), []
    for i in range(count):
        x, y, w = rng.randint(-reach, reach), rng.randint(-reach, reach), rng.randint(2, 15)
        kind = rng.randrange(4)
        if kind == 0:
            out.append((i, [box(x, y, 2 * w, w + 2)]))
        elif kind == 1:
            out.append((i, [box(x, y, 2 * w + 4, 2 * w + 4), box(x + 2, y + 2, w, w)[:: rng.choice([1, -1])]]))
        elif kind == 2:
            out.append((i, [[(x, y - w), (x + w, y), (x, y + w), (x - w, y), (x, y - w)]]))
        else:
            out.append((i, [[(x, y), (x + 2 * w, y), (x + 2 * w, y + w), (x + w, y + w), (x + w, y + 2 * w), (x, y + 2 * w), (x, y)]]))
    return out


def owners(polygons):
    """The highest polygon that holds each quarter, in quarter units."""
    out = {}
    for i, rings in polygons:
        xs, ys = [p[0] for p in rings[0]], [p[1] for p in rings[0]]
        for x in range(min(xs), max(xs)):
            for y in range(min(ys), max(ys)):
                for a, b in QUARTERS:
                    if inside(rings, Fraction(4 * x + a, 4), Fraction(4 * y + b, 4)):
                        out[4 * x + a, 4 * y + b] = i
    return out


def neighbours(q):
    """The quarters that share a side with this one, with the side's length in units."""
    x, y = q[0] // 4 * 4, q[1] // 4 * 4
    a, b = q[0] - x, q[1] - y
    across = {(2, 1): (x + 2, y - 1), (2, 3): (x + 2, y + 5), (1, 2): (x - 1, y + 2), (3, 2): (x + 5, y + 2)}[a, b]
    sides = [(x + 1, y + 2), (x + 3, y + 2)] if a == 2 else [(x + 2, y + 1), (x + 2, y + 3)]
    return [(across, 1.0), *[(s, math.sqrt(0.5)) for s in sides]]


def faces_of(own, empty):
    """Connected faces of the quarters in ``empty``."""
    left, out = set(empty), []
    while left:
        todo = [left.pop()]
        face = set(todo)
        while todo:
            for n, _ in neighbours(todo.pop()):
                if n in left:
                    left.discard(n)
                    face.add(n)
                    todo.append(n)
        out.append(face)
    return out


def gaps_of(own):
    xs, ys = [q[0] for q in own], [q[1] for q in own]
    empty = {(4 * x + a, 4 * y + b) for x in range(min(xs) // 4 - 1, max(xs) // 4 + 2) for y in range(min(ys) // 4 - 1, max(ys) // 4 + 2) for a, b in QUARTERS if (4 * x + a, 4 * y + b) not in own}
    outside = (min(xs) // 4 * 4 - 2, min(ys) // 4 * 4 - 3)
    return [f for f in faces_of(own, empty) if outside not in f]


@pytest.mark.parametrize("g", [8, 1000])
def test_owners_unions_and_overlaps_against_brute_force(spark, g):
    polygons = octilinear(45, 1)
    shapes = frame(spark, polygons, 2)
    pieces = written(ov.noded(ov.ring_edges(shapes), g))
    sides = written(ov.sided(pieces, g))
    own = owners(polygons)
    want = defaultdict(float)
    for i in own.values():
        want[i] += 0.25
    got = ov.face_sizes(ov.owned(sides, shapes.select("pid", F.col("pid").alias("id"), F.col("pid").alias("rank")))).collect()
    assert {r.id: r.area / 4 for r in got} == want
    one = {i: set(owners([(i, rings)])) for i, rings in polygons}
    union = ov.face_sizes(ov.united(sides, shapes.select("pid", (F.col("pid") % 3).alias("id")))).collect()
    assert {r.id: r.area / 4 for r in union} == {k: len(set().union(*[q for i, q in one.items() if i % 3 == k])) / 4 for k in range(3)}
    pairs = {(r.pid, r.other): r.area / 4 for r in ov.pair_areas(sides, F.lit(True), F.lit(True)).collect()}
    assert pairs == {(i, j): len(a & b) / 4 for i, a in one.items() for j, b in one.items() if i != j and a & b}


@pytest.mark.parametrize("g", [8, 64])
def test_overlaps_without_an_overlay(spark, g):
    polygons = octilinear(45, 1) + [(100, [box(-70, -70, 160, 160), box(-20, -20, 30, 30)[::-1]])]
    one = {i: set(owners([(i, rings)])) for i, rings in polygons}
    found = {(r.pid, r.other): r.area / 4 for r in ov.overlaps(ov.ring_edges(frame(spark, polygons, 2)), g).collect()}
    assert found == {(i, j): len(a & b) / 4 for i, a in one.items() for j, b in one.items() if i < j and a & b}


def test_overlaps_are_exact_and_neighbours_have_none(spark):
    slant = [(0, [[(0, 0), (300, 0), (300, 100), (0, 0)]]), (1, [[(0, 0), (30, 10), (300, 100), (0, 100), (0, 0)]]), (2, [[(10, 0), (20, 0), (20, 7), (10, 0)]])]
    found = {(r.pid, r.other): r.area for r in ov.overlaps(ov.ring_edges(frame(spark, slant)), 8).collect()}
    # 0 and 1 share a border on which 1 has a corner more; 2 leaves 0 where 7 * (x - 10) / 10 is above x / 3, at x = 210 / 11
    assert found == {(0, 2): pytest.approx(35 - (20 - 210 / 11) * (7 - 20 / 3) / 2), (1, 2): pytest.approx((20 - 210 / 11) * (7 - 20 / 3) / 2)}


def stars(count, seed):
    rng, out = random.Random(seed), []
    for i in range(count):
        x, y, n = rng.randint(-300, 300), rng.randint(-300, 300), rng.randint(3, 9)
        ring = [(x + round(r * math.cos(a)), y + round(r * math.sin(a))) for k in range(n) for a, r in [(2 * math.pi * (k + rng.random() * 0.6) / n, rng.uniform(20, 140))]]
        out.append((i, [[*ring, ring[0]]]))
    return out


def test_rings_in_any_direction(spark):
    polygons = stars(30, 4)
    results = []
    for g in (32, 500):
        pieces = written(ov.noded(ov.ring_edges(frame(spark, polygons)), g))
        sides = ov.sided(pieces, g)
        part = ov.owned(sides, pieces.select("pid").distinct().select("pid", F.col("pid").alias("id"), F.col("pid").alias("rank")))
        results.append((sorted(map(tuple, pieces.collect())), sorted(map(tuple, part.collect()), key=str)))
    assert results[0] == results[1]  # cells decide nothing
    segments = {r[1:5] for r in results[0][0]}
    cross = lambda ax, ay, bx, by: ax * by - ay * bx
    for s in segments:  # no two pieces cross, and no end lies inside another piece
        for t in segments:
            if s < t and s[0] <= t[2] and t[0] <= s[2]:
                d = [cross(s[2] - s[0], s[3] - s[1], t[k] - s[0], t[k + 1] - s[1]) for k in (0, 2)] + [cross(t[2] - t[0], t[3] - t[1], s[k] - t[0], s[k + 1] - t[1]) for k in (0, 2)]
                assert not (d[0] * d[1] < 0 and d[2] * d[3] < 0)
    border = [(s, max(abs(s[2] - s[0]), abs(s[3] - s[1]))) for s in segments]
    owner, rng, part = 0, random.Random(2), results[0][1]
    for _ in range(300):  # far from all borders the owner is the highest star there
        x, y = Fraction(2 * rng.randint(-300, 300) + 1, 2), Fraction(2 * rng.randint(-300, 300) + 1, 2)
        if any(s[0] - 2 <= x <= s[2] + 2 and abs(cross(s[2] - s[0], s[3] - s[1], x - s[0], y - s[1])) < 2 * n for s, n in border):
            continue
        held = {i for i, rings in polygons if inside(rings, x, y)}
        below = [p for p in part if p[0] <= x < p[2] and cross(p[2] - p[0], p[3] - p[1], x - p[0], y - p[1]) > 0]
        near = max(below, key=lambda p: p[1] + Fraction((p[3] - p[1]), (p[2] - p[0])) * (x - p[0]), default=None)
        assert (near[4] if near else None) == (max(held) if held else None)
        owner += bool(held)
    assert owner > 20


def test_cycles_go_out_when_they_are_done(spark, monkeypatch):
    rows, want, rng = [], {}, random.Random(3)
    names, sizes = iter(rng.sample(range(1000), 156)), []
    for n in (1, 2, 2, 3, 5, 8, 35, 100):
        walk = [next(names) for _ in range(n)]
        least = walk.index(min(walk))
        rows += zip(walk, walk[1:] + walk[:1], strict=True)
        want |= {h: (walk[least], (least - i) % n) for i, h in enumerate(walk)}
    monkeypatch.setattr(fc, "written", lambda df: sizes.append((out := written(df)).count()) or out)
    assert {r.h: (r.loop, r.dist) for r in fc.cycles(spark.createDataFrame(rows, "h long, ptr long")).collect()} == want
    assert sizes[0] == 156 and sizes[-1] < 156  # the last round does without the short cycles


def test_clean_looks_for_gaps_once(spark, monkeypatch):
    polygons = octilinear(30, 7, 30) + [(100, [box(200, 200, 40, 40), box(210, 210, 5, 5)])]
    part, seen, find = partition(spark, polygons, 2), [], fc.gap_halves
    filled, first = fc.fill_gaps(part)
    again, second = fc.fill_gaps(filled, least=0.0, below=120.0, alone=True)
    monkeypatch.setattr(fc, "merge_slivers", lambda partition, *a, **k: (partition, fc.Report()))
    monkeypatch.setattr(fc, "gap_halves", lambda *a: seen.append(a) or find(*a))
    out, report = fc.clean(part, hole_area=120.0)
    assert sorted(map(tuple, out.collect()), key=str) == sorted(map(tuple, again.collect()), key=str)
    assert [(r.changed, r.changed_area) for r in report.orderBy("stage").collect()[2:]] == [(first.filled, first.area), (second.filled, second.area)]
    assert len(seen) == 1


def test_gaps_are_filled_by_the_longest_border(spark):
    polygons = octilinear(60, 7, 30) + [(100, [box(200, 200, 40, 8)]), (101, [box(200, 232, 40, 8)]), (102, [box(200, 208, 8, 24)]), (103, [box(232, 208, 8, 24)]), (104, [box(216, 216, 5, 5)])]
    own = owners(polygons)
    gaps = gaps_of(own)
    assert len(gaps) > 3
    part = partition(spark, polygons, 2)
    for least, below, alone in ((1.0, None, False), (0.0, 9.0, False), (0.0, 30.0, True)):
        want, given, area = dict(own), 0, 0.0
        for face in gaps:
            length = defaultdict(float)
            for q in face:
                for n, side in neighbours(q):
                    if n in own:
                        length[own[n]] += side
            if len(face) / 4 < least or (below is not None and len(face) / 4 >= below) or (alone and len(length) > 1):
                continue
            most = max(length.values())
            new = min(i for i, n in length.items() if n > most - 1e-9)
            want |= dict.fromkeys(face, new)
            given, area = given + 1, area + len(face) / 4
        filled, report = fc.fill_gaps(part, None, 4 * least, None if below is None else 4 * below, alone)
        sizes = defaultdict(float)
        for i in want.values():
            sizes[i] += 0.25
        assert {r.id: r.area / 4 for r in ov.face_sizes(filled).collect()} == sizes
        assert (report.filled, report.area / 4) == (given, area) and report.found >= given


def test_gaps_within_a_boundary(spark):
    polygons = [(-1, [box(0, 0, 100, 60)]), (1, [box(0, 0, 60, 60)]), (2, [box(70, 20, 30, 40)])]
    part = partition(spark, polygons)
    filled, report = fc.fill_gaps(part, gap=-1)
    assert report.filled == 1 and report.area == 100 * 60 - 3600 - 1200
    assert {r.id: r.area for r in ov.face_sizes(filled).collect()} == {1: 3600.0, 2: 2400.0}  # 60 and 70 of border to the gap, 70 to the outside
    thin = partition(spark, [(-1, [box(0, 0, 100, 60)]), (1, [box(0, 0, 60, 60)]), (3, [box(60, 0, 1, 30)]), (4, [box(100, 0, 20, 20)])])
    cleaned, report = fc.clean(thin, gap=-1)
    assert {r.id: r.area for r in ov.face_sizes(cleaned).collect()} == {1: 6000.0, 4: 400.0}
    assert [(r.step, r.parcels, r.slivers, r.changed) for r in report.collect()] == [("input", 3, 1, 0), ("slivers", 2, 0, 1), ("gaps", 2, 0, 1), ("holes", 2, 0, 0)]


def test_slivers_go_to_the_largest_neighbour_round_by_round(spark):
    polygons = [(1, [box(0, 0, 50, 50), box(10, 10, 5, 5)]), (2, [box(50, 0, 1, 50)]), (3, [box(51, 0, 1, 50)]), (4, [box(0, 50, 30, 30)]), (5, [box(30, 50, 1, 20)]), (6, [box(300, 300, 1, 2)]), (7, [box(400, 300, 1, 40)])]
    part = partition(spark, polygons)
    merged, report = fc.merge_slivers(part, 1.5, 100.0, 3.0)
    sizes = {r.id: r.area for r in ov.face_sizes(merged).collect()}
    assert sizes == {1: 2475.0 + 50 + 50 + 20, 4: 900.0, 7: 40.0}  # 2, then 3; 5 touches 1 and 4; 6 is tiny and alone, 7 is not
    assert [(r["slivers"], r["merged"], r["dropped"]) for r in report.rounds] == [(5, 2, 1), (2, 1, 0), (1, 0, 0)]
    kept, report = fc.merge_slivers(part, 1.5, 100.0, 3.0, giant_points=5)
    assert {r.id for r in ov.face_sizes(kept).collect()} == {1, 3, 4, 7}  # 2 and 5 have only giants beside them, then 3 has nobody
    assert report.rounds[0]["dropped"] == 3


def test_no_sliver_with_a_neighbour_is_left(spark):
    part = partition(spark, octilinear(80, 11, 35), 2)
    before = sum(r.area for r in ov.face_sizes(part).collect())
    merged, report = fc.merge_slivers(part, 2.5, 160.0, 0.0)
    sizes = {r.id: r for r in ov.face_sizes(merged).collect()}
    assert sum(r.area for r in sizes.values()) == before and report.filled > 3
    thin = {i for i, r in sizes.items() if r.area / r.perimeter < 2.5 and r.area < 160}
    assert not [r for r in ov.shared_borders(merged).collect() if r.id in thin and r.other not in thin]


def test_rings_close_and_keep_the_area(spark):
    part = partition(spark, octilinear(60, 13, 40), 2)
    areas = defaultdict(float)
    for r in fc.rings(part).collect():
        points = [(p.x, p.y) for p in r.points]
        assert points[0] == points[-1] and len(points) == len({*points}) + 1 or len(points) > len({*points})
        shoelace = sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(points, points[1:], strict=False)) / 2
        assert shoelace == r.area and (r.area > 0) == (r.ring == 0 or r.area > 0)
        areas[r.id] += r.area
    assert areas == {r.id: r.area for r in ov.face_sizes(part).collect()}


def test_nothing_degenerate_and_empty(spark):
    odd = [(1, None), (2, []), (3, [None, [{"x": 0, "y": 0}, {"x": 5, "y": 0}, {"x": 0, "y": 0}]]), (4, [[{"x": 0, "y": 0}, None, {"x": 4, "y": 0}, {"x": 4, "y": 0}, {"x": 4, "y": 4}, {"x": 0, "y": 0}]])]
    shapes = spark.createDataFrame(odd, SCHEMA)
    pieces = written(ov.noded(ov.ring_edges(shapes)))
    assert {r.pid for r in pieces.select("pid").distinct().collect()} == {4}
    none = partition(spark, [(1, [[]])])
    assert none.count() == 0 and fc.fill_gaps(none)[0].count() == 0 and fc.rings(none).count() == 0
    report = fc.clean(none)[1].collect()
    assert [r.step for r in report] == ["input", "slivers", "gaps", "holes"] and {r.parcels for r in report} == {0}


def test_seams_join_parcels_of_a_class(spark):
    shapes = spark.createDataFrame([(1, 0, 5), (2, 1, 5), (3, 1, 6), (4, 2, 5)], "parcel_id long, block_id long, pred_class long")
    part = partition(spark, [(1, [box(0, 0, 10, 10)]), (2, [box(10, 0, 10, 10)]), (3, [box(0, 10, 10, 10)]), (4, [box(20, 2, 5, 5)])])
    assert sorted(map(tuple, pt._seams(part, shapes).collect())) == [(1, 2), (2, 4)]


def test_annotations_of_clipped_rings(spark):
    """A holed square over four windows: every part's flattened rings have its area, and its shares are of the window."""
    polygons = [(1, [box(60, 60, 80, 80), box(90, 90, 20, 20)]), (-1, [box(0, 0, 100, 100)]), (-2, [box(100, 0, 100, 100)]), (-3, [box(0, 100, 100, 100)]), (-4, [box(100, 100, 100, 100)])]
    sides = ov.sided(written(ov.noded(ov.ring_edges(frame(spark, polygons)))))
    parts = ov.intersections(sides, F.expr("pid > 0"), F.expr("pid < 0"))
    found = fc.annotations(parts, F.expr("IF(id.other % 2 = 0, 100, 0)"), F.expr("IF(id.other < -2, 100, 0)"), 100.0, 10.0).collect()
    assert {r.id.other for r in found} == {-1, -2, -3, -4}
    for r in found:
        area = 0.0
        for flat in r.segmentation:
            points = list(zip(flat[::2], flat[1::2], strict=True))
            area += sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(points, points[1:] + points[:1], strict=True)) / 2
        assert area == r.area == 1500.0
        assert r.bbox == [{-1: 60.0, -3: 60.0}.get(r.id.other, 0.0), {-1: 60.0, -2: 60.0}.get(r.id.other, 0.0), 40.0, 40.0]
        shares = [float(v) for v in r.line.split()]
        assert len(shares) >= 6 and all(0 <= v <= 1 for v in shares) and all(len(v.split(".")[1]) == 5 for v in r.line.split())


def test_windows_cut_every_polygon_by_itself(spark):
    """Quarters of each polygon in each window, edges along window lines included; every part is closed and meets no other polygon."""
    polygons = [*octilinear(60, 3), (100, [box(-20, -20, 40, 40)]), (101, [box(-40, 0, 20, 20), box(-36, 4, 4, 12)])]
    edges = ov.ring_edges(frame(spark, polygons, 2))
    got, ends = defaultdict(int), defaultdict(int)
    for r in ov.windowed(edges, ["pid"], 40).collect():
        assert all(40 * r.cx <= x <= 40 * r.cx + 40 and 40 * r.cy <= y <= 40 * r.cy + 40 for x, y in ((r.ax, r.ay), (r.bx, r.by)))
        got[r.pid, r.cx, r.cy] += r.ax * r.by - r.bx * r.ay
        ends[r.pid, r.cx, r.cy, r.ax, r.ay] += 1
        ends[r.pid, r.cx, r.cy, r.bx, r.by] -= 1
    want = defaultdict(int)
    for i, rings in polygons:
        xs, ys = [x for x, _ in rings[0]], [y for _, y in rings[0]]
        for x in range(min(xs), max(xs)):
            for y in range(min(ys), max(ys)):
                for a, b in QUARTERS:
                    if inside(rings, x + Fraction(a, 4), y + Fraction(b, 4)):
                        want[i, x // 20, y // 20] += 2
    assert not any(ends.values()) and dict(got) == dict(want) and len(want) > 150


def test_windows_of_slanted_edges_add_up(spark):
    """Cuts off the grid are rounded alike on both sides of a line, so parts add up to the polygon within what rounding moves."""
    rng = random.Random(8)
    polygons = [(i, [[(p := (rng.randint(-300, 300), rng.randint(-300, 300))), (p[0] + rng.randint(50, 300), p[1] + rng.randint(-40, 40)), (p[0] + rng.randint(0, 50), p[1] + rng.randint(60, 300)), p]]) for i in range(40)]
    edges = ov.ring_edges(frame(spark, polygons))
    whole = {r.pid: r.a for r in edges.groupBy("pid").agg(F.sum(F.expr(ov.DOUBLED)).alias("a")).collect()}
    parts = ov.windowed(edges, ["pid"], 70).groupBy("pid", "cx", "cy").agg(F.sum(F.expr(ov.DOUBLED)).alias("a")).collect()
    for pid, area in whole.items():
        own = [r.a for r in parts if r.pid == pid]
        assert min(own) >= -70 and abs(sum(own) - area) <= 2 * 600 and len(own) > 3


def test_extents_of_all_kinds_of_geometry(spark):
    texts = [
        ('{"type":"Point","coordinates":[1.5,-2e1]}', (1.5, -20.0, 1.5, -20.0)), ('{"type": "MultiPoint", "coordinates": [[1, 2], [ -3.25 , 4 ]]}', (-3.25, 2.0, 1.0, 4.0)),
        ('{"type":"LineString","coordinates":[[1,2,900],[3,4,-900]]}', (1.0, 2.0, 3.0, 4.0)), ('{"type":"Polygon","coordinates":[[[0,0],[5,0],[5,6],[0,0]],[[1,1],[2,1],[2,2],[1,1]]]}', (0.0, 0.0, 5.0, 6.0)),
        ('{"type":"GeometryCollection","geometries":[{"type":"GeometryCollection","geometries":[{"type":"Point","coordinates":[9,9]}]},{"type":"Point","coordinates":[-9,1]}]}', (-9.0, 1.0, 9.0, 9.0)),
        ('{"type":"GeometryCollection","geometries":[]}', None), ('{"type":"Circle","coordinates":[1,2]}', None), (None, None), ("no json", None),
    ]
    from landgrid.functions.rings import geometry_extent

    got = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(texts)], "i long, t string").select("i", geometry_extent(F.col("t")).alias("box")).collect()
    assert {r.i: r.box and tuple(r.box) for r in got} == {i: w for i, (_, w) in enumerate(texts)}


def test_sides_and_owners_move_by_cell_only(spark):
    pieces = written(ov.noded(ov.ring_edges(frame(spark, octilinear(20, 3), 2))))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = ov.foremost(ov.sided(pieces))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "HashAggregate" in text.split("SortMergeJoin")[0] and "Exchange" not in text.split("SortMergeJoin")[0]
