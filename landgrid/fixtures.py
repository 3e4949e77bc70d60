"""Domain tables derived from the generic star schema, as DataFrames and as the same SQL for an oracle.

The views feed every query of ``landgrid.plans``. Arithmetic is on integers, so both engines agree exactly.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from landgrid.session import table

# DIV is integer division in Spark; DuckDB's is //. RANGE64 is a table with i = 0..63.
_SQL = {
    "points": """SELECT c_custkey AS point_id, CAST(c_custkey * 7919 % 360000 AS DOUBLE) / 1000 - 180 AS lon,
       CAST(c_custkey * 104729 % 170000 AS DOUBLE) / 1000 - 85 AS lat FROM customer""",
    "regions": """SELECT o_orderkey AS region_id, o_custkey % 40 AS county, o_orderkey % 1000 AS idx,
       o_orderkey % 97 AS gx, o_orderkey % 89 AS gy,
       CAST(5000 + o_orderkey % 97 AS DOUBLE) / 50 AS w, CAST(1500 + o_orderkey % 89 AS DOUBLE) / 50 AS s,
       CAST(5001 + o_orderkey % 97 AS DOUBLE) / 50 AS e, CAST(1501 + o_orderkey % 89 AS DOUBLE) / 50 AS n,
       CASE WHEN o_custkey % 40 < 6 THEN 'test' ELSE 'train' END AS split FROM orders""",
    "completed": """SELECT l_orderkey AS region_id, CAST(l_linenumber % 9 AS BIGINT) AS dx, l_partkey % 9 AS dy,
       max(CASE WHEN l_quantity > 5 THEN 1 ELSE 0 END) AS has_blob
       FROM lineitem GROUP BY l_orderkey, CAST(l_linenumber % 9 AS BIGINT), l_partkey % 9""",
    "tile_events": """SELECT event_id, user_id % 20 AS job_id, CAST(ts AS TIMESTAMP) AS ts, event_id % 16 AS x, (event_id DIV 16) % 16 AS y, 10 AS z,
       CASE event_type WHEN 'error' THEN 'failed' WHEN 'signup' THEN 'placeholder' ELSE 'ok' END AS status,
       CASE WHEN event_type = 'error' THEN 0 ELSE CAST(round(value * 100) AS BIGINT) END AS nbytes FROM events""",
    "parcels": """SELECT parcel_id, county, block_id, x0, y0, x1, y1, dlbm, pred_class, prob_pm FROM (
       SELECT p.*, row_number() OVER (PARTITION BY parcel_id ORDER BY x0, y0, x1, y1, dlbm, pred_class, prob_pm, county, block_id) AS rn FROM (
       SELECT l_orderkey * 8 + l_linenumber AS parcel_id, l_suppkey % 40 AS county, l_suppkey % 16 AS block_id,
         l_orderkey * 13 % 20000 AS x0, (l_partkey * 7 + l_orderkey * 3) % 20000 AS y0,
         l_orderkey * 13 % 20000 + CAST(l_quantity AS BIGINT) AS x1,
         (l_partkey * 7 + l_orderkey * 3) % 20000 + 1 + (l_orderkey * l_linenumber) % 30 AS y1,
         lpad(CAST(1 + l_partkey % 12 AS VARCHAR(2)), 2, '0') || lpad(CAST(l_linenumber % 8 AS VARCHAR(2)), 2, '0') AS dlbm,
         1 + l_orderkey % 7 AS pred_class, CAST(round(l_discount * 10000) AS BIGINT) AS prob_pm
       FROM lineitem) p) q WHERE rn = 1""",
    "pixels": """SELECT s.s_suppkey AS cell_id, s.s_nationkey AS county, a.i AS r, b.i AS c,
       ((a.i DIV 8) * 3 + (b.i DIV 8) * 5 + s.s_suppkey) % 8 AS truth,
       CASE WHEN (a.i * 7 + b.i * 11 + s.s_suppkey) % 9 = 0
            THEN (((a.i DIV 8) * 3 + (b.i DIV 8) * 5 + s.s_suppkey) % 8 + 1) % 8
            ELSE ((a.i DIV 8) * 3 + (b.i DIV 8) * 5 + s.s_suppkey) % 8 END AS pred,
       (a.i * 31 + b.i * 17 + s.s_suppkey * 13) % 1001 AS prob_pm,
       (a.i * 5 + b.i * 3 + s.s_suppkey) % 256 AS red, (a.i * 2 + b.i * 7 + s.s_suppkey) % 256 AS grn,
       (a.i * 3 + b.i * 2 + s.s_suppkey) % 256 AS blu,
       CASE WHEN (a.i DIV 16 + b.i DIV 16 + s.s_suppkey) % 5 = 0 THEN 0 ELSE 255 END AS alpha,
       1 + (a.i DIV 8) * 8 + b.i DIV 8 AS inst_pred, 1 + ((a.i + 2) DIV 8) * 9 + (b.i + 1) DIV 8 AS inst_gt
       FROM supplier s CROSS JOIN RANGE64 a CROSS JOIN RANGE64 b""",
    "scores": """SELECT vec_id, label, k, CAST(embedding[k + 1] AS DOUBLE) AS v FROM embeddings, (SELECT unnest(range(63)) k)""",
    "log_lines": """SELECT user_id % 50 AS run_id, event_id AS seq,
       CASE WHEN event_type = 'error' THEN 'noise ' || props
            ELSE '{"type":"' || CASE event_type WHEN 'purchase' THEN 'done' WHEN 'signup' THEN 'progress' ELSE 'stage' END
                 || '","n":' || CAST(event_id AS VARCHAR(20)) || '}' END AS line FROM events""",
}
#: Rings that aren't boxes: box, angle (concave), box with a hole, diamond and triangle, with sides of 4, 8 or 12. Planes of
#: 2,600 units, each for 480,000 ids, keep the density the same at every scale.
_SQL["shapes"] = f"""SELECT parcel_id, county, block_id, pred_class, kind, x0, y0, w, CASE WHEN kind >= 3 THEN w ELSE h END AS h FROM (
       SELECT parcel_id, county, block_id, pred_class, parcel_id % 5 AS kind, 2 * (x0 DIV 16) AS x0, 2 * (y0 DIV 16) + 2600 * (parcel_id DIV 480000) AS y0,
         4 * (1 + (x1 - x0) % 3) AS w, 4 * (1 + (y1 - y0) % 3) AS h FROM ({_SQL["parcels"]}) p) s"""
#: Cells in a partition of ``pixels``, about a million pixels.
CELLS = 256
_TABLES = {
    "points": ["customer"], "regions": ["orders"], "completed": ["lineitem"], "tile_events": ["events"],
    "parcels": ["lineitem"], "shapes": ["lineitem"], "pixels": ["supplier"], "scores": ["embeddings"], "log_lines": ["events"],
}


def fixture(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One derived table as a lazy DataFrame over the parquet tables of ``sf_dir``."""
    if name == "scores":
        rows = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.posexplode(F.slice("embedding", 1, 63)).alias("k", "v"))
        return rows.select("vec_id", "label", F.col("k").cast("long").alias("k"), F.col("v").cast("double").alias("v"))
    sql = _SQL[name].replace("{", "{{").replace("}", "}}")  # spark.sql reads single braces as the tables below
    for t in _TABLES[name]:
        sql = sql.replace(f"FROM {t}", f"FROM {{{t}}}")
    frames = {t: table(spark, sf_dir, t) for t in _TABLES[name]}
    if name == "pixels":
        # A range, unlike an exploded array, tells the plan that rows multiply, so no join broadcasts pixels.
        sql = sql.replace("RANGE64", "{range64}")
        frames |= {"supplier": spread(frames["supplier"], "s_suppkey"), "range64": F.broadcast(spark.range(64).withColumnRenamed("id", "i"))}
    return spark.sql(sql, **frames)


def spread(cells: DataFrame, key: str) -> DataFrame:
    """``cells`` dealt by ``key`` into one partition for every ``CELLS`` rows. A few bytes of each become 4,096 pixels, so that the
    file's own partitions would leave all of them to one task; and what a partition holds is whole cells, so that windows
    and groups within a cell need no shuffle."""
    return cells.repartition(cells.count() // CELLS + 1, key)


def oracle(views: str, sql: str) -> str:
    """``sql`` for DuckDB with the named views (separated by blanks) as CTEs in front."""
    ctes = ", ".join(f"{v} AS ({_SQL[v].replace(' DIV ', ' // ').replace('RANGE64', '(SELECT unnest(range(64)) i)')})" for v in views.split())
    body = sql.strip()
    head = "WITH RECURSIVE " if body.startswith("WITH RECURSIVE ") else "WITH "
    return f"{head}{ctes}, {body[len(head):]}" if body.startswith(head) else f"{head}{ctes} {body}"
