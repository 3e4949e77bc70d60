"""Mixing sources to target weights by weighted fair queueing."""

from __future__ import annotations

from math import isqrt

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from landgrid.session import cut_lineage, table

WORDS = r"size(split(trim(BOTH ' \t\n\u000b\u000c\r' FROM text), '[ \\t-\\r]+'))"


def word_count():
    """Words of ``text``; none in a null, empty or blank one."""
    blank = F.expr(r"trim(BOTH ' \t\n\u000b\u000c\r' FROM text)") == ""
    return F.when(F.col("text").isNull() | blank, 0).otherwise(F.expr(WORDS)).cast("long")


def source_targets(sized: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: int = 2) -> DataFrame:
    """``sized(source, size)`` -> ``(source, source_size, target, budget)``; the budget is the sum of the targets.

    Sources in code point order, null last, weigh ``weights`` over and over and share ``share`` times all sizes. A
    target stops at ``most`` times its source's size; what is over is shared again by weight. The level at which that
    ends is found in closed form: sources in the order in which they reach their stop, with running sums.
    """
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    every = Window.partitionBy()
    place = F.row_number().over(Window.partitionBy().orderBy(F.col("source").isNull(), "source")) - 1
    sources = sources.withColumn("place", place).withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights)) + 1).cast("long"))
    sources = sources.withColumn("stop", most * F.col("source_size"))
    order = Window.partitionBy().orderBy(F.col("stop") / F.col("weight"), "place")
    sources = sources.select(
        "*",
        F.sum("source_size").over(every).alias("all_size"),
        (F.sum("weight").over(every) - F.sum("weight").over(order.rowsBetween(Window.unboundedPreceding, -1))).alias("open_w"),
        F.coalesce(F.sum("stop").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("closed"),
        F.sum("weight").over(every).alias("all_w"),
        F.row_number().over(order).alias("turn"),
    )
    level = (share * F.col("all_size") - F.col("closed")) / F.coalesce("open_w", "all_w")
    sources = sources.withColumn("level", level)
    # The first source, in that order, whose stop is not below the level at its turn: it and all later ones get the level.
    turn = F.struct("turn", "level")
    sources = sources.withColumn("final", F.min(F.when(F.col("stop") / F.col("weight") >= F.col("level"), turn)).over(every)["level"])
    target = F.when(F.col("weight") * F.col("final") < F.col("stop"), F.col("weight") * F.col("final")).otherwise(F.col("stop").cast("double"))
    budget = F.least(share * F.col("all_size"), F.sum("stop").over(every).cast("double"))
    return sources.select("source", "source_size", target.alias("target"), budget.alias("budget"))


def mix(docs: DataFrame, seed: int = 42, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: int = 2) -> DataFrame:
    """``docs(doc_id, text, source, ...)`` -> ``(doc_id, size, source, source_size, target, times, taken, finish, text_hash)``, a row for each row.

    Each source is a queue of its documents in an order shuffled by a hash, gone through up to ``most`` times. A
    document's virtual finish time is the number of the source's words up to its end, divided by the source's target.
    In the order of that time over all sources, documents are taken whole until the sum of the targets is used up;
    ``times`` says how often. Documents without words are never taken. Documents with equal finish times stand or fall
    together. The order is drawn by doc_id and text, so rows that share an id, or have none, are dealt over all ranges.
    Repeated rows queue one after another; null sources are one source; an empty table gives no rows, and columns of
    ``docs`` but doc_id, text and source are not read.

    Running sums are taken within ranges of the shuffled order (and of the finish time), as many as the square root of the
    rows, and carried on over the sums of the ranges, so that a source with a third of all rows is dealt over many tasks.
    """
    sized = cut_lineage(docs.select("doc_id", "source", word_count().alias("size"), F.md5("text").alias("text_hash")))
    targets = cut_lineage(source_targets(sized, weights, share, most))
    ranges = max(1, isqrt(sized.count()))
    draw = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.coalesce("text_hash", F.lit("null"))))
    cut = F.conv(F.substring("draw", 1, 8), 16, 10).cast("long")
    queued = sized.where("size > 0").withColumn("draw", draw).withColumn("range", F.floor(cut * ranges / 2**32))
    before = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    carried = queued.groupBy("source", "range").agg(F.sum("size").alias("range_size")).withColumn("carried", F.coalesce(F.sum("range_size").over(before), F.lit(0)))
    within = Window.partitionBy("source", "range").orderBy("draw", "doc_id", "size", "text_hash").rowsBetween(Window.unboundedPreceding, 0)
    queued = queued.withColumn("upto", F.sum("size").over(within))
    same = lambda a, b: a["source"].eqNullSafe(b["source"])
    table_of = carried.join(targets, same(carried, targets)).select(carried["source"].alias("s"), F.col("range").alias("r"), "carried", "source_size", "target")
    queued = queued.join(table_of, F.col("source").eqNullSafe(F.col("s")) & (F.col("range") == F.col("r")))
    upto = F.col("carried") + F.col("upto")
    rounds = F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda e: (upto + e * F.col("source_size")) / F.col("target"))
    queued = cut_lineage(queued.select("doc_id", "source", "size", "text_hash", rounds.alias("finish")))

    budget = targets.agg(F.max("budget").alias("b")).first()["b"] or 0.0
    turns = queued.select("size", F.explode("finish").alias("finish")).withColumn("range", F.floor(F.col("finish") * ranges))
    spans = turns.groupBy("range").agg(F.sum("size").alias("span"))
    spans = spans.withColumn("carried", F.coalesce(F.sum("span").over(Window.partitionBy().orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    edge = spans.where(F.col("carried") <= budget).orderBy(F.desc("range")).first()
    last = -1.0
    if edge is not None:
        close = turns.where(F.col("range") == edge["range"]).groupBy("finish").agg(F.sum("size").alias("size"))
        running = F.sum("size").over(Window.partitionBy().orderBy("finish").rowsBetween(Window.unboundedPreceding, 0))
        close = close.withColumn("upto", running + edge["carried"])
        inside = close.where(F.col("upto") <= budget).agg(F.max("finish").alias("f")).first()["f"]
        last = inside if inside is not None else (turns.where(F.col("range") < edge["range"]).agg(F.max("finish").alias("f")).first()["f"] or -1.0)
    times = F.size(F.filter("finish", lambda f: f <= last)).cast("long")
    mixed = queued.select("doc_id", "source", "size", "text_hash", times.alias("times"), F.element_at("finish", 1).alias("finish"))
    empty = sized.where("size = 0").select("doc_id", "source", "size", "text_hash", F.lit(0).cast("long").alias("times"), F.lit(None).cast("double").alias("finish"))
    mixed = mixed.unionByName(empty)
    return mixed.join(targets, same(mixed, targets)).select("doc_id", "size", mixed["source"], "source_size", "target", "times", (F.col("times") * F.col("size")).alias("taken"), "finish", "text_hash")


def take_mixed(docs: DataFrame, **how) -> DataFrame:
    """The documents of ``mix(docs, **how)`` themselves, each as often as it is taken, with the columns of ``docs``.

    Rows alike in doc_id, source and text are taken equally often: as often as the first of them in the queue.
    """
    key = [F.xxhash64("doc_id", "source", "text_hash").alias("k1"), F.crc32(F.concat_ws(":", "doc_id", "source", "text_hash")).alias("k2")]
    times = mix(docs, **how).where("times > 0").groupBy(*key).agg(F.max("times").cast("int").alias("times"))
    rows = docs.select(F.struct(*docs.columns).alias("row"), "doc_id", "source", F.md5("text").alias("text_hash")).select("row", *key)
    return rows.join(times, ["k1", "k2"]).select("row", F.explode(F.array_repeat(F.lit(1), F.col("times")))).select("row.*")


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``mix`` of all rows of ``documents``."""
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


OP2_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) END AS BIGINT) AS size,
         md5(concat_ws(':', '42', coalesce(CAST(doc_id AS VARCHAR), 'null'), coalesce(md5(text), 'null'))) AS draw
  FROM documents
), sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source
), weighed AS (
  SELECT source, source_size, 2 * source_size AS stop, place,
         CAST(CASE place % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS BIGINT) AS weight
  FROM (SELECT *, row_number() OVER (ORDER BY source IS NULL, source COLLATE C) - 1 AS place FROM sources) s
), levels AS (
  SELECT *, row_number() OVER o AS turn, sum(source_size) OVER () AS all_size,
         (CAST(1.5 AS DOUBLE) * CAST(sum(source_size) OVER () AS BIGINT) - CAST(coalesce(sum(stop) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT))
           / CAST(sum(weight) OVER () - coalesce(sum(weight) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS level
  FROM weighed WINDOW o AS (ORDER BY CAST(stop AS DOUBLE) / weight, place)
), final AS (
  SELECT min_by(level, turn) AS level FROM levels WHERE CAST(stop AS DOUBLE) / weight >= level
), targets AS (
  SELECT source, source_size, CASE WHEN weight * final.level < stop THEN weight * final.level ELSE CAST(stop AS DOUBLE) END AS target
  FROM weighed LEFT JOIN final ON true
), budget AS (SELECT least(CAST(1.5 AS DOUBLE) * sum(source_size), CAST(2 * sum(source_size) AS DOUBLE)) AS budget FROM sources
), queued AS (
  SELECT d.doc_id, d.source, d.size, t.source_size, t.target,
         CAST(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.draw, d.doc_id, d.size ROWS UNBOUNDED PRECEDING) AS BIGINT) AS upto
  FROM sized d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source WHERE d.size > 0
), turns AS (
  SELECT size, upto / target AS finish FROM queued UNION ALL SELECT size, (upto + source_size) / target FROM queued
), running AS (
  SELECT finish, sum(size) OVER (ORDER BY finish) AS upto FROM turns
), cut AS (SELECT coalesce(max(finish), -1) AS last FROM running, budget WHERE upto <= budget)
SELECT doc_id, size, source_size, target,
       size * (CASE WHEN upto / target <= last THEN 1 ELSE 0 END + CASE WHEN (upto + source_size) / target <= last THEN 1 ELSE 0 END) AS taken
FROM queued, cut
UNION ALL
SELECT d.doc_id, d.size, t.source_size, t.target, CAST(0 AS BIGINT) FROM sized d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source WHERE d.size = 0
"""
