"""Functions for SQL users, defined in SQL so that they stay inside the optimizer."""

from __future__ import annotations

from pyspark.sql import SparkSession

_X = "greatest(least(CAST(floor(({lon} + 180) / 360 * pow(2.0D, z)) AS BIGINT), CAST(pow(2.0D, z) AS BIGINT) - 1), 0L)"
_RAD = "radians(least(greatest({lat}, -85.05112878D), 85.05112878D))"
_Y = f"greatest(least(CAST(floor((1 - ln(tan({_RAD}) + 1 / cos({_RAD})) / pi()) / 2 * pow(2.0D, z)) AS BIGINT), CAST(pow(2.0D, z) AS BIGINT) - 1), 0L)"
_XA, _YA = _X.format(lon="w"), _Y.format(lat="n")
_XB, _YB = f"greatest({_X.format(lon='e')}, {_XA})", f"greatest({_Y.format(lat='s')}, {_YA})"
_P, _R = "(tp / (tp + fp + 1e-9D))", "(tp / (tp + fn + 1e-9D))"

FUNCTIONS = {
    "f1": f"(tp DOUBLE, fp DOUBLE, fn DOUBLE) RETURNS DOUBLE RETURN 2 * {_P} * {_R} / ({_P} + {_R} + 1e-9D)",
    "area_agreement": "(a DOUBLE, b DOUBLE) RETURNS DOUBLE RETURN CASE WHEN greatest(a, b) <= 0 THEN 0D ELSE 100 * least(a, b) / greatest(a, b) END",
    "tiles_of": f"""(w DOUBLE, s DOUBLE, e DOUBLE, n DOUBLE, z INT) RETURNS TABLE(x BIGINT, y BIGINT) RETURN SELECT t.x, t.y FROM (SELECT explode(flatten(transform(
        sequence({_XA}, {_XB}), i -> transform(sequence({_YA}, {_YB}), j -> named_struct('x', i, 'y', j))))) AS t)""",
    "windows_of": """(length INT, size INT, stride INT) RETURNS TABLE(start INT) RETURN
        SELECT explode(array_distinct(concat(sequence(0, greatest(length - size, 0), stride), array(greatest(length - size, 0)))))""",
}


def register(spark: SparkSession) -> None:
    """Temporary functions ``f1``, ``area_agreement``, ``tiles_of`` (tiles of a box) and ``windows_of`` (starts of windows, the last flush)."""
    for name, body in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}{body}")
