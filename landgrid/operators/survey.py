"""Aggregates, rankings and selections over parcels of a land survey."""

from __future__ import annotations

from math import isqrt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from landgrid.operators.tiling import top_per_key
from landgrid.session import cut_lineage

AREA = "(x1 - x0) * (y1 - y0)"


def with_area(parcels: DataFrame) -> DataFrame:
    return parcels.withColumn("area", F.expr(AREA))


def grid_cells(parcels: DataFrame, size: int) -> DataFrame:
    """Parcels by grid cell of their centre: how many, how many rare ones (``rare``), and the commonest county, ties to the smaller."""
    gx, gy = F.floor((F.col("x0") + F.col("x1")) / 2 / size), F.floor((F.col("y0") + F.col("y1")) / 2 / size)
    counts = parcels.groupBy(gx.alias("gx"), gy.alias("gy"), "county").agg(F.count("*").alias("k"), F.count_if("rare").alias("rare"))
    best = F.max_by("county", F.struct("k", (-F.col("county")).alias("c")))
    return counts.groupBy("gx", "gy").agg(F.sum("k").alias("total"), F.sum("rare").alias("rare"), best.alias("county"))


def sequential_quota(parcels: DataFrame, classes: list[str], size: int, most: int, least: int) -> DataFrame:
    """For each class in turn the cells with the most parcels of it, at least ``least`` and up to ``most`` cells; a cell
    taken for an earlier class is left out later. The loop is over the few classes."""
    cell = [F.floor(F.col("x0") / size).alias("gx"), F.floor(F.col("y0") / size).alias("gy")]
    taken = None
    for c in classes:
        counts = parcels.where(F.substring("dlbm", 1, 2) == c).groupBy(*cell).agg(F.count("*").alias("n")).where(F.col("n") >= least)
        if taken is not None:
            counts = counts.join(taken.select("gx", "gy"), ["gx", "gy"], "left_anti")
        top = counts.orderBy(F.desc("n"), "gx", "gy").limit(most).select(F.lit(c).alias("cls"), "gx", "gy", "n")
        taken = top if taken is None else taken.unionByName(top)
    return taken


def class_shares(parcels: DataFrame, key: str, cls: Column) -> DataFrame:
    """Area of each class of a key and its percentage of the key's area."""
    sums = with_area(parcels).groupBy(key, cls.alias("cls")).agg(F.sum("area").alias("area"))
    return sums.withColumn("pct", F.round(100 * F.col("area") / F.sum("area").over(Window.partitionBy(key)), 6))


def cluster_1d(values: DataFrame, key: str, value: str, tolerance: int) -> DataFrame:
    """Distinct values of a key with the number of their group: a new one begins where the gap to the value before is ``tolerance`` or more."""
    w = Window.partitionBy(key).orderBy(value)
    rows = values.select(key, value).distinct()
    gap = F.col(value) - F.lag(value).over(w)
    rows = rows.withColumn("new", F.when(gap >= tolerance, 1).otherwise(0))
    return rows.withColumn("grp", F.sum("new").over(w)).drop("new")


def global_ids(rows: DataFrame, *order: str) -> DataFrame:
    """Ids 1..n in the given order without a single-partition window: rows are dealt into ranges of the whole order, as many
    as there are shuffle partitions, numbered as they lie there, and shifted by the counts of the ranges before.

    The numbered rows are written once, so that ids and counts come from the same ranges."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    dealt = cut_lineage(dealt.withColumn("__place", F.monotonically_increasing_id()))  # range number above bit 33, place below
    numbered = dealt.withColumn("__part", F.shiftright("__place", 33))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # over one row for each range
    starts = numbered.groupBy("__part").agg(F.count("*").alias("__n")).select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    gid = F.col("__start") + F.col("__place").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return numbered.join(F.broadcast(starts), "__part").withColumn("gid", gid).drop("__part", "__start", "__place")


def best_balanced(cells: DataFrame, k: int) -> DataFrame:
    """The most balanced cell of each county, then the k best of all."""
    best = top_per_key(cells, ["county"], 1, F.desc("balance"), F.col("gx"), F.col("gy"))
    return best.drop("rank").orderBy(F.desc("balance"), "county").limit(k)


def keep_top_fraction(rows: DataFrame, key: str, score: str, fraction: float, id_col: str) -> DataFrame:
    """The best ``int(n * fraction)`` rows of each key by score (null last), ties by id. Ranks are differences of global ids in the order of
    keys, so no task sorts a whole key."""
    ordered = rows.withColumns({"__none": F.col(score).isNull(), "__down": -F.col(score)})
    ranked = global_ids(ordered, key, "__none", "__down", id_col)
    ends = ranked.groupBy(F.col(key).alias("__key")).agg(F.min("gid").alias("__first"), F.count("*").alias("__n"))
    kept = ranked.join(ends, F.col(key).eqNullSafe(F.col("__key"))).where(F.col("gid") - F.col("__first") < F.floor(F.col("__n") * fraction))
    return kept.select(*rows.columns)


def weighted_draw(rows: DataFrame, id_col: str, weight: str, draws: int, seed: int) -> DataFrame:
    """``draws`` rows drawn with replacement by integer weight: hash draws over the cumulative weight.

    The cumulative weight is in two levels, groups by a hash of the id, as many as the square root of the rows, and rows
    within. Draws and group starts, then draws and row starts, are merged in the order of their positions: a draw takes the
    last start before it. Rows without weight are never drawn.
    """
    rows = cut_lineage(rows.select(id_col, F.col(weight).cast("long").alias("own")).where("own > 0"))
    groups = max(1, isqrt(rows.count()))
    rows = rows.withColumn("grp", F.pmod(F.xxhash64(id_col), F.lit(groups)))
    starts = rows.groupBy("grp").agg(F.sum("own").alias("w")).withColumn("start", F.sum("w").over(Window.orderBy("grp")) - F.col("w"))
    starts = cut_lineage(starts)
    total = starts.agg(F.sum("w")).first()[0]
    if not total:
        return rows.select(F.lit(0).cast("long").alias("draw"), id_col)
    salts = max(1, draws // 100_000)
    picks = rows.sparkSession.range(draws).select(F.col("id").alias("draw"), F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(total)).alias("at"))
    picks = picks.withColumn("salt", F.pmod("draw", F.lit(salts)))
    marks = starts.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    line = marks.select("salt", F.col("start").alias("at"), F.lit(None).cast("long").alias("draw"), "grp", "start")
    line = line.unionByName(picks.select("salt", "at", "draw", F.lit(None).cast("long").alias("grp"), F.lit(None).cast("long").alias("start")))
    last = Window.partitionBy("salt").orderBy("at", F.col("draw").isNotNull())
    found = line.select("draw", "at", F.last("grp", True).over(last).alias("grp"), F.last("start", True).over(last).alias("start")).where("draw IS NOT NULL")
    upto = F.sum("own").over(Window.partitionBy("grp").orderBy(id_col).rowsBetween(Window.unboundedPreceding, 0))
    spans = rows.select("grp", (upto - F.col("own")).alias("at"), F.lit(None).cast("long").alias("draw"), id_col)
    line = spans.unionByName(found.select("grp", (F.col("at") - F.col("start")).alias("at"), "draw", F.lit(None).cast(rows.schema[id_col].dataType).alias(id_col)))
    last = Window.partitionBy("grp").orderBy("at", F.col("draw").isNotNull())
    return line.select("draw", F.last(id_col, True).over(last).alias(id_col)).where("draw IS NOT NULL")
