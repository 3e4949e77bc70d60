"""Overlay of arbitrary rings on an integer grid: a planar partition as a table of border pieces with the faces on both sides.

Polygons come as directed edges ``(pid, ax, ay, bx, by)`` with the interior on the left, outer rings and holes alike.
``noded`` rounds all crossings to the grid by snap rounding, after which pieces meet in their end points only; ``sided`` finds
the polygons that cover either side of every piece; an owner rule makes that a partition
``(x1, y1, x2, y2, left_id, right_id)``, null for no owner, from which areas, shared borders, unions and rings follow by
grouping. Everything is dealt by grid cells of size ``g`` and computed in whole numbers, so cells agree on their common
borders and results don't depend on ``g``. Candidates follow the density of edges in a cell, not the size of a polygon.
Coordinates stay below 10^8 and lines below 10^5 units, so that products fit 64 bits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from landgrid.session import written

PIECE = ("x1", "y1", "x2", "y2")
CELL = ("kx", "ky")
GRID = 8


def ring_edges(polygons: DataFrame) -> DataFrame:
    """``polygons(pid, rings array<array<struct<x, y>>>)``, closed rings, the outer ring first -> edges, turned so that the
    interior is on the left. Null polygons, rings and points, rings without an area and repeated points give no edges."""
    # Points are picked within the generator: filters on a ring would pick them anew for each of its points.
    rings = polygons.select("pid", F.posexplode(F.expr("transform(filter(rings, r -> r IS NOT NULL), r -> filter(r, p -> p IS NOT NULL AND p.x IS NOT NULL AND p.y IS NOT NULL))")).alias("no", "ring")).where("size(ring) > 3")
    doubled = F.expr("aggregate(sequence(1, size(ring) - 1), 0L, (s, i) -> s + cast(ring[i - 1].x * ring[i].y - ring[i].x * ring[i - 1].y AS bigint))")
    turned = rings.withColumn("doubled", doubled).where("doubled <> 0").withColumn("ring", F.when((F.col("doubled") > 0) == (F.col("no") == 0), F.col("ring")).otherwise(F.reverse("ring")))
    steps = F.expr("transform(sequence(1, size(ring) - 1), i -> struct(ring[i - 1].x AS ax, ring[i - 1].y AS ay, ring[i].x AS bx, ring[i].y AS by))")
    return turned.select("pid", F.explode(steps).alias("e")).select("pid", *[F.col(f"e.{c}").cast("long").alias(c) for c in ("ax", "ay", "bx", "by")]).where("ax <> bx OR ay <> by")


def lined(edges: DataFrame, sign: Column) -> DataFrame:
    """Edges as lines ``x1, y1, x2, y2`` from the lower to the higher end point by (x, y), with ``sign`` turned if they are."""
    forward = F.expr("ax < bx OR (ax = bx AND ay < by)")
    pick = lambda a, b: F.when(forward, F.col(a)).otherwise(F.col(b))
    return edges.select("pid", pick("ax", "bx").alias("x1"), pick("ay", "by").alias("y1"), pick("bx", "ax").alias("x2"), pick("by", "ay").alias("y2"), F.when(forward, sign).otherwise(-sign).alias("sign"))


def celled(lines: DataFrame, g: int) -> DataFrame:
    """Lines in every grid cell ``kx, ky`` that they come near; the number of cells grows with the length only."""
    cell = lambda v: f"cast(floor(({v}) / {g}) AS bigint)"
    columns = lines.withColumn("kx", F.explode(F.expr(f"sequence({cell('x1')}, {cell('x2')})")))
    at = lambda x: f"y1 + (y2 - y1) / cast(nullif(x2 - x1, 0) AS double) * (greatest(least({x}, x2), x1) - x1)"
    lo, hi = at(f"kx * {g} - 1"), at(f"(kx + 1) * {g}")
    low, high = (f"IF(x1 = x2, {end}, {pick}({lo}, {hi}))" for end, pick in (("y1", "least"), ("y2", "greatest")))
    return columns.withColumn("ky", F.explode(F.expr(f"sequence({cell(f'{low} - 2')}, {cell(f'{high} + 2')})")))


def crossings(lines: DataFrame, g: int) -> DataFrame:
    """Points ``(px, py)`` where two lines cross within both, rounded to the grid (halves up)."""
    dealt = celled(lines, g)
    other = dealt.select(*[F.col(c).alias(f"o_{c}") for c in PIECE], *CELL)
    once = "struct(x1, y1, x2, y2) < struct(o_x1, o_y1, o_x2, o_y2)"
    near = "o_x1 <= x2 AND o_x2 >= x1 AND least(o_y1, o_y2) <= greatest(y1, y2) AND greatest(o_y1, o_y2) >= least(y1, y2)"
    turn = "(x2 - x1) * (o_y2 - o_y1) - (y2 - y1) * (o_x2 - o_x1)"
    s = "(o_x1 - x1) * (o_y2 - o_y1) - (o_y1 - y1) * (o_x2 - o_x1)"
    t = "(o_x1 - x1) * (y2 - y1) - (o_y1 - y1) * (x2 - x1)"
    # The condition of the join is kept short, as it is evaluated for all pairs of a cell; the rest follows for those that are left.
    pairs = dealt.join(other, [*CELL]).where(f"{near} AND {turn} <> 0 AND {once}")
    pairs = pairs.select(*PIECE, F.explode(F.expr(f"array(struct({turn} AS turn, {s} AS s, {t} AS t))")).alias("e")).select(*PIECE, "e.*")
    inside = lambda v: f"{v} * signum(turn) > 0 AND {v} * signum(turn) < abs(turn)"
    at = lambda a, b: F.expr(f"{a} + cast(floor((2 * cast(s AS double) * ({b} - {a}) + turn) / (2 * cast(nullif(turn, 0) AS double))) AS bigint)")
    return pairs.where(f"{inside('s')} AND {inside('t')}").select(at("x1", "x2").alias("px"), at("y1", "y2").alias("py")).distinct()


def noded(edges: DataFrame, g: int = GRID) -> DataFrame:
    """``(pid, x1, y1, x2, y2, net)``: the edges cut by snap rounding into pieces that meet in end points only.

    Grid points that are an end or a rounded crossing are hot; each line runs through the hot points in whose unit square it
    comes (lower sides belong to a square, upper ones don't), in order. ``net`` is how often the polygon lies left of the
    piece, seen from the lower end, less how often right; pieces with 0 are gone.
    """
    rows = written(lined(edges, F.lit(1)))
    lines = written(rows.select(*PIECE).distinct())
    ends = lines.select(F.col("x1").alias("px"), F.col("y1").alias("py")).union(lines.select("x2", "y2"))
    hot = written(ends.union(crossings(lines, g)).distinct())  # true sizes for the plan; it is read once for each line's cells
    hot = hot.withColumns({"kx": F.expr(f"cast(floor(px / {g}) AS bigint)"), "ky": F.expr(f"cast(floor(py / {g}) AS bigint)")})
    off, reach = "((x2 - x1) * (py - y1) - (y2 - y1) * (px - x1))", "((x2 - x1) + abs(y2 - y1))"
    through = f"2 * abs{off} < {reach} OR (2 * {off} = {reach} AND y2 <= y1) OR (2 * {off} = -{reach} AND y2 > y1)"
    met = celled(lines, g).join(hot, [*CELL]).where(f"px BETWEEN x1 AND x2 AND py BETWEEN least(y1, y2) AND greatest(y1, y2) AND ({through})")
    # A point is in one cell, so a line meets it once.
    along = Window.partitionBy(*PIECE).orderBy("px", F.expr("IF(y2 < y1, -py, py)"))
    step = met.select(*PIECE, "px", "py").select(*PIECE, F.col("px").alias("ax"), F.col("py").alias("ay"), F.lead("px").over(along).alias("bx"), F.lead("py").over(along).alias("by")).where("bx IS NOT NULL")
    cut = rows.join(step.hint("merge"), [*PIECE]).select("pid", "sign", "ax", "ay", "bx", "by")
    return lined(cut, F.col("sign")).groupBy("pid", *PIECE).agg(F.sum("sign").alias("net")).where("net <> 0")


def corners(pieces: DataFrame, g: int) -> DataFrame:
    """``(pid, kx, ky, w)``: how often each polygon winds around the lower left corner of a cell, where it does.

    Corners lie a quarter below and left of the grid point, so no piece ends on the line between them. Pieces that
    cross a cell row's lower line are counted by column and summed from the left.
    """
    rows = F.expr(f"sequence(cast(floor(least(y1, y2) / {g}) AS bigint) + 1, cast(floor(greatest(y1, y2) / {g}) AS bigint))")
    some = pieces.where(f"floor(y1 / {g}) <> floor(y2 / {g})").withColumn("ky", F.explode(rows))
    column = F.expr(f"cast(floor(({FOUR_X.format(g=g)} + abs(y2 - y1)) / ({4 * g} * nullif(abs(y2 - y1), 0))) AS bigint)")
    events = some.withColumn("kx", column).groupBy("pid", "ky", "kx").agg(F.sum(F.expr("-net * cast(signum(y2 - y1) AS bigint)")).alias("turn"))
    along = Window.partitionBy("pid", "ky").orderBy("kx")
    sums = events.select("pid", "ky", "kx", F.sum("turn").over(along).alias("w"), F.lead("kx").over(along).alias("next")).where("w <> 0 AND next IS NOT NULL")
    return sums.select("pid", "ky", "w", F.explode(F.expr("sequence(kx + 1, next)")).alias("kx"))


#: Four times |y2 - y1| times the x where a piece crosses the lower line of cell row ky.
FOUR_X = "(4 * x1 * abs(y2 - y1) + (4 * ky * {g} - 1 - 4 * y1) * (x2 - x1) * cast(signum(y2 - y1) AS bigint))"


def windings(segments: DataFrame, pieces: DataFrame, g: int = GRID) -> DataFrame:
    """``(x1, y1, x2, y2, pid, w)``: how often the polygons of ``pieces`` wind around a point just right of the middle of each of
    ``segments`` (seen from its lower end; below it, if it isn't upright), where they do. Segments don't cross pieces."""
    return turns(segments, pieces, g).groupBy(*PIECE, "pid").agg(F.sum("w").alias("w")).where("w <> 0")


#: The middle of a segment, twice, and its cell.
MIDDLE = {"mx": "x1 + x2", "my": "y1 + y2", "kx": "cast(floor((x1 + x2) / {g2}) AS bigint)", "ky": "cast(floor((y1 + y2) / {g2}) AS bigint)"}


def turns(segments: DataFrame, pieces: DataFrame, g: int) -> DataFrame:
    """The summands of ``windings``, ``(x1, y1, x2, y2, kx, ky, pid, w, own)``, in any number of rows for a segment and a polygon; ``own``
    is the polygon's ``net`` if the segment is itself a piece of it.

    From the corner of the middle's cell a path runs right along the cell's lower line, then up; the pieces that it crosses
    are those of the cell alone. Corners and pieces come from one table by one join on cells: what is then grouped by cell and segment
    is already where it belongs.
    """
    asked = segments.select(*[F.col(c).alias(f"s_{c}") for c in PIECE], *[F.expr(v.format(g2=2 * g)).alias(k) for k, v in MIDDLE.items()])
    none = [F.lit(None).cast("long").alias(c) for c in PIECE]
    held = celled(pieces, g).select("pid", *PIECE, F.col("net").cast("long").alias("net"), *CELL).unionByName(corners(pieces, g).select("pid", *none, F.col("w").alias("net"), *CELL))
    x = FOUR_X.format(g=g)
    crosses = f"least(y1, y2) < ky * {g} AND greatest(y1, y2) >= ky * {g} AND {x} >= (4 * kx * {g} - 1) * abs(y2 - y1)"
    # What doesn't depend on the segment is worked out once, after the rows have moved: where a piece crosses the lower line (a corner
    # always counts), and twice x2 - x1 times its y at 0 and that of the line.
    known = {"steep": "IF(x1 IS NULL, 0, 2 * abs(y2 - y1))", "at": f"IF(x1 IS NULL, 0, IF({crosses}, {x}, NULL))", "turn": "IF(x1 IS NULL, net, -net * cast(signum(y2 - y1) AS bigint))"}
    known |= {"dx": "x2 - x1", "dy": "y2 - y1", "base": "2 * y1 * (x2 - x1) - 2 * x1 * (y2 - y1)", "low": f"(4 * ky * {g} - 1) * (x2 - x1) + IF(y2 > y1, 0, 1)"}
    met = asked.join(held.repartition(*CELL).withColumns({k: F.expr(v) for k, v in known.items()}), [*CELL])
    same, under = "x1 = s_x1 AND y1 = s_y1 AND x2 = s_x2 AND y2 = s_y2", "2 * x1 <= mx AND mx < 2 * x2 AND base + dy * mx < my * dx AND 2 * (base + dy * mx) >= low"
    met = met.where(f"at <= mx * steep OR {under} OR {same}")
    w = F.expr(f"IF(at <= mx * steep, turn, 0) + IF({under}, net, 0)")
    return met.select(*[F.col(f"s_{c}").alias(c) for c in PIECE], *CELL, "pid", w.alias("w"), F.expr(f"IF({same}, net, 0)").alias("own"))


def sided(pieces: DataFrame, g: int = GRID) -> DataFrame:
    """``(x1, y1, x2, y2, kx, ky, pid, in_left, in_right)`` for every piece, with the cell of its middle, and each polygon that covers a
    side of it. Rows are dealt by cell."""
    around = turns(pieces.select(*PIECE).distinct(), pieces, g)
    both = around.groupBy(*PIECE, *CELL, "pid").agg(F.sum(F.expr("w + own")).alias("l"), F.sum("w").alias("r"))
    return both.select(*PIECE, *CELL, "pid", (F.col("l") > 0).alias("in_left"), (F.col("r") > 0).alias("in_right")).where("in_left OR in_right")


def owned(sides: DataFrame, owners: DataFrame) -> DataFrame:
    """The partition in which a face belongs to the covering polygon of the highest ``rank``: ``owners(pid, id, rank)`` gives every
    polygon its owner's ``id`` (null: none). Ranks are distinct or belong to one owner."""
    best = lambda side: F.max(F.when(F.col(f"in_{side}"), F.struct("rank", "id")))["id"].alias(f"{side}_id")
    faces = sides.join(owners, "pid").groupBy(*PIECE).agg(best("left"), best("right"))
    return faces.where(~F.col("left_id").eqNullSafe(F.col("right_id")))


def foremost(sides: DataFrame) -> DataFrame:
    """``owned`` where ``pid``, a number, is itself the rank and the owner: neither a join nor, as for structs, a sort is needed."""
    best = lambda side: F.max(F.when(F.col(f"in_{side}"), F.col("pid"))).alias(f"{side}_id")
    faces = sides.groupBy(*PIECE, *CELL).agg(best("left"), best("right"))  # within a cell, so nothing moves
    return faces.where(~F.col("left_id").eqNullSafe(F.col("right_id"))).drop(*CELL)


def united(sides: DataFrame, keys: DataFrame) -> DataFrame:
    """The union of the polygons of each key, ``keys(pid, id)``, by itself: a partition for every id, in one table. Unions of
    different ids may overlap, so pieces can repeat."""
    faces = sides.join(keys, "pid").groupBy(*PIECE, "id").agg(F.bool_or("in_left").alias("l"), F.bool_or("in_right").alias("r")).where("l <> r")
    side = lambda c: F.when(F.col(c), F.col("id"))
    return faces.select(*PIECE, side("l").alias("left_id"), side("r").alias("right_id"))


def half_edges(partition: DataFrame) -> DataFrame:
    """``(id, other, ax, ay, bx, by)``: every piece once for either side, directed so that the face of ``id`` is on its left."""
    left = partition.select(F.col("left_id").alias("id"), F.col("right_id").alias("other"), F.col("x1").alias("ax"), F.col("y1").alias("ay"), F.col("x2").alias("bx"), F.col("y2").alias("by"))
    right = partition.select(F.col("right_id").alias("id"), F.col("left_id").alias("other"), F.col("x2").alias("ax"), F.col("y2").alias("ay"), F.col("x1").alias("bx"), F.col("y1").alias("by"))
    return left.unionByName(right)


LENGTH = "sqrt(cast((bx - ax) * (bx - ax) + (by - ay) * (by - ay) AS double))"
DOUBLED = "ax * by - bx * ay"


def face_sizes(partition: DataFrame) -> DataFrame:
    """``(id, area, perimeter, points)`` of every owner."""
    faces = half_edges(partition).where("id IS NOT NULL")
    return faces.groupBy("id").agg((F.sum(F.expr(DOUBLED)) / 2).alias("area"), F.sum(F.expr(LENGTH)).alias("perimeter"), F.count("*").alias("points"))


def shared_borders(partition: DataFrame) -> DataFrame:
    """``(id, other, length)`` for owners next to each other, in both directions."""
    return half_edges(partition).where("id IS NOT NULL AND other IS NOT NULL").groupBy("id", "other").agg(F.sum(F.expr(LENGTH)).alias("length"))


def relabelled(partition: DataFrame, names: DataFrame) -> DataFrame:
    """The partition with owners renamed by ``names(id, new)``, ``id`` being unique; a null ``new`` gives up the face. Other
    owners stay, and borders within an owner vanish."""
    for side in ("left_id", "right_id"):
        named = names.select(F.col("id").alias(side), "new", F.lit(True).alias("found"))
        partition = partition.join(named, side, "left").withColumn(side, F.when(F.col("found"), F.col("new")).otherwise(F.col(side))).drop("new", "found")
    return partition.select(*PIECE, "left_id", "right_id").where(~F.col("left_id").eqNullSafe(F.col("right_id")))


def pair_areas(sides: DataFrame, a: Column, b: Column) -> DataFrame:
    """``(pid, other, area)`` of every polygon with ``a`` and every other one with ``b`` that overlap. Only polygons that cover the
    same side of a piece meet."""
    one = sides.where(a)
    two = sides.where(b).select(*PIECE, F.col("pid").alias("other"), F.col("in_left").alias("o_left"), F.col("in_right").alias("o_right"))
    both = F.expr("(x1 * y2 - x2 * y1) * (IF(in_left AND o_left, 1, 0) - IF(in_right AND o_right, 1, 0))")
    met = one.join(two, [*PIECE]).where("pid <> other").groupBy("pid", "other").agg(F.sum(both).alias("doubled"))
    return met.where("doubled <> 0").select("pid", "other", (F.col("doubled") / 2).alias("area"))


def overlaps(edges: DataFrame, g: int = 64) -> DataFrame:
    """Edges of polygons -> ``(pid, other, area)`` of every two that overlap, ``pid < other``, without an overlay. Rings of one polygon
    don't overlap each other; ground under a millionth of a square unit is none.

    In a grid cell the winding number of a polygon is that at the cell's corner (see ``corners``), and changes where one of its pieces
    crosses the cell's lower line, and above a piece. So it is a sum of grounds above lines, and what two polygons share is a sum
    over two lines each of the ground above both. Lines are cut to cells in doubles, not rounded to the grid; a large polygon has
    in a cell only its lines there.
    """
    lines = written(lined(edges, F.lit(1)).withColumnRenamed("sign", "net"))
    spot = {"left": F.expr(f"kx * {g} - 0.25D"), "low": F.expr(f"ky * {g} - 0.25D")}
    at = "(x1 + ({y} - y1) * (x2 - x1) / (y2 - y1))"
    foot, head = at.format(y="low"), at.format(y=f"(low + {g})")
    l = f"IF(y1 = y2, greatest(x1, left), greatest(x1, left, least({foot}, {head})))"  # noqa: E741
    r = f"IF(y1 = y2, least(x2, left + {g}), least(x2, left + {g}, greatest({foot}, {head})))"
    near = celled(lines, g).withColumns(spot).withColumns({"l": F.expr(f"IF(x1 = x2 OR y1 = y2 AND NOT (y1 > low AND y1 < low + {g}), NULL, {l})"), "r": F.expr(r), "foot": F.expr(f"IF((y1 < low) <> (y2 < low), {foot}, NULL)")})
    height = "y1 + (y2 - y1) * ({x} - x1) / (x2 - x1) - low"
    above = f"IF(l < r, struct(l, r, {height.format(x='l')} AS ly, {height.format(x='r')} AS ry, net AS w), NULL)"
    beside = f"IF(foot >= left AND foot < left + {g}, struct(foot AS l, left + {g} AS r, 0D AS ly, 0D AS ry, -net * cast(signum(y2 - y1) AS int) AS w), NULL)"
    local = near.select("pid", *CELL, F.explode(F.expr(f"filter(array({above}, {beside}), e -> e IS NOT NULL)")).alias("e")).select("pid", *CELL, "e.*")
    start = corners(lines, g).withColumns(spot).select("pid", *CELL, F.col("left").alias("l"), F.expr(f"left + {g}").alias("r"), F.lit(0.0).alias("ly"), F.lit(0.0).alias("ry"), "w")
    extent = lines.groupBy("pid").agg(F.min("x1").alias("west"), F.max("x2").alias("east"), F.min(F.least("y1", "y2")).alias("south"), F.max(F.greatest("y1", "y2")).alias("north"))
    terms = written(local.unionByName(start).join(extent, "pid"))
    other = terms.select(*CELL, *[F.col(c).alias("other" if c == "pid" else f"o_{c}") for c in terms.columns if c not in CELL])
    meet = "west < o_east AND o_west < east AND south < o_north AND o_south < north"
    pairs = terms.join(other, [*CELL]).where(f"pid < other AND {meet} AND l < o_r AND o_l < r")
    pairs = pairs.withColumns({"p": F.greatest("l", "o_l"), "q": F.least("r", "o_r")})
    y = lambda o, x: f"{o}ly + ({o}ry - {o}ly) * ({x} - {o}l) / ({o}r - {o}l)"
    pairs = pairs.withColumns({"a": F.expr(y("", "p")), "b": F.expr(y("o_", "p")), "c": F.expr(y("", "q")), "d": F.expr(y("o_", "q"))})
    apart = "IF((a - b) * (c - d) >= 0, (q - p) * (abs(a - b) + abs(c - d)) / 4, (q - p) * ((a - b) * (a - b) + (c - d) * (c - d)) / (4 * (abs(a - b) + abs(c - d))))"
    ground = F.expr(f"w * o_w * ((q - p) * ({g} - (a + b + c + d) / 4) - {apart})")
    return pairs.groupBy("pid", "other").agg(F.sum(ground).alias("area")).where("area > 1e-6")


def intersections(sides: DataFrame, a: Column, b: Column) -> DataFrame:
    """The ground that every polygon with ``a`` shares with each one with ``b``, as a partition for each pair, in one table: ``left_id``
    and ``right_id`` are ``struct<pid, other>``. Parts of different pairs may overlap."""
    two = sides.where(b).select(*PIECE, F.col("pid").alias("other"), F.col("in_left").alias("o_left"), F.col("in_right").alias("o_right"))
    met = sides.where(a).join(two, [*PIECE]).where("pid <> other")
    name = F.struct("pid", "other")
    side = lambda c: F.when(F.col(f"in_{c}") & F.col(f"o_{c}"), name).alias(f"{c}_id")
    return met.select(*PIECE, side("left"), side("right")).where("(left_id IS NULL) <> (right_id IS NULL)")


def covering(points: DataFrame, pieces: DataFrame, g: int = GRID) -> DataFrame:
    """``points(px, py)`` off all borders -> ``(px, py, pid)`` for every polygon that holds one."""
    at = points.select(F.col("px").alias("x1"), F.col("py").alias("y1"), F.col("px").alias("x2"), F.col("py").alias("y2")).distinct()
    return windings(at, pieces, g).where("w > 0").select(F.col("x1").alias("px"), F.col("y1").alias("py"), "pid")


def strips(edges: DataFrame, keys: list[str], axis: str, size: int) -> DataFrame:
    """Directed edges ``(*keys, ax, ay, bx, by)``, closed round the ground on their left for every key, cut to the strips between
    multiples of ``size`` along ``axis`` -> the same with ``c<axis>``, the strip's number, closed for every key and strip.

    An edge is cut where it crosses a line (rounded to the grid, halves up); one along a line belongs to the strip on its left.
    What a strip then lacks runs along its lines: between ends that edges leave open there, in order.
    """
    other = "y" if axis == "x" else "x"
    p, q, u, v = f"a{axis}", f"b{axis}", f"a{other}", f"b{other}"
    at = f"{u} + cast(floor((2 * ({v} - {u}) * (k * {size} - {p}) * signum({q} - {p}) + abs({q} - {p})) / (2 * abs(cast({q} - {p} AS double)))) AS bigint)"
    lines = f"filter(sequence(cast(floor({p} / {size}) AS bigint), cast(floor({q} / {size}) AS bigint)), k -> (k * {size} - {p}) * ({q} - k * {size}) > 0)"
    route = f"concat(array(struct({p} AS p, {u} AS u)), transform({lines}, k -> struct(k * {size} AS p, {at} AS u)), array(struct({q} AS p, {v} AS u)))"
    steps = "transform(sequence(1, size(route) - 1), i -> struct(route[i - 1].p AS p, route[i - 1].u AS u, route[i].p AS q, route[i].u AS v))"
    within = f"greatest({p}, {q}) <= (floor(least({p}, {q}) / {size}) + 1) * {size}"  # most edges cross no line
    left = "v > u" if axis == "x" else "v < u"  # along a line: whether the ground is on its lower side
    strip = F.expr(f"cast(floor(least(p, q) / {size}) AS bigint) - IF(p = q AND p % {size} = 0 AND {left}, 1, 0)").alias("strip")
    routed = edges.withColumn("route", F.expr(f"IF({within}, NULL, {route})"))
    each = F.expr(f"IF(route IS NULL, array(struct({p} AS p, {u} AS u, {q} AS q, {v} AS v)), {steps})")
    cut = routed.select(*keys, F.explode(each).alias("e")).select(*keys, "e.*").select(*keys, "p", "u", "q", "v", strip)
    ends = cut.where(f"p % {size} = 0 OR q % {size} = 0").select(*keys, "strip", F.explode(F.expr("array(struct(q AS line, v AS at, 1 AS turn), struct(p AS line, u AS at, -1 AS turn))")).alias("e")).select(*keys, "strip", "e.*")
    ends = ends.where(f"line % {size} = 0").groupBy(*keys, "strip", "line", "at").agg(F.sum("turn").alias("turn")).where("turn <> 0")
    along = Window.partitionBy(*keys, "strip", "line").orderBy("at")
    open_ = ends.withColumns({"flow": F.sum("turn").over(along), "next": F.lead("at").over(along)}).where("flow <> 0 AND next IS NOT NULL")
    open_ = open_.withColumn("n", F.explode(F.expr("array_repeat(1, cast(abs(flow) AS int))")))
    rim = open_.select(*keys, F.col("line").alias("p"), F.expr("IF(flow > 0, at, next)").alias("u"), F.col("line").alias("q"), F.expr("IF(flow > 0, next, at)").alias("v"), "strip")
    names = {"p": p, "u": u, "q": q, "v": v}
    both = cut.unionByName(rim).where("p <> q OR u <> v").withColumnsRenamed(names)
    return both.select(*keys, F.col("strip").alias(f"c{axis}"), "ax", "ay", "bx", "by")


def windowed(edges: DataFrame, keys: list[str], size: int) -> DataFrame:
    """Edges as in ``strips`` cut to the square windows ``cx, cy`` of a grid of ``size``: the closed edges of every key in every window
    that it reaches into. Keys don't meet each other, so the work follows the edges and the lines that they cross."""
    return strips(written(strips(edges, keys, "x", size)), [*keys, "cx"], "y", size)


def faces_apart(halves: DataFrame) -> DataFrame:
    """Half edges ``(id, ax, ay, bx, by)`` as a partition for each ``id``, in one table; faces of different ids may overlap."""
    return halves.select(F.col("ax").alias("x1"), F.col("ay").alias("y1"), F.col("bx").alias("x2"), F.col("by").alias("y2"), F.col("id").alias("left_id"), F.lit(None).cast(halves.schema["id"].dataType).alias("right_id"))
