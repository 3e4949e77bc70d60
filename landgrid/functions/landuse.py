"""Column expressions on land-use codes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Class names and colours of the parcel product.
CLASSES = [
    (1, "cropland", "Cropland", "#ffd37f"), (2, "orchard", "Orchard", "#a87000"), (3, "forest", "Forest", "#267300"), (4, "grass", "Grassland", "#98e600"),
    (5, "built", "Built-up", "#e60000"), (6, "water", "Water", "#005ce6"), (7, "bare", "Bare land", "#b2b2b2"),
]


def five_class(code: str) -> Column:
    """Major groups 01-04 are classes 1-4, 05-12 are class 5; anything else is null."""
    major = F.substring(code, 1, 2).try_cast("int")
    return F.when(major.between(1, 4), major).when(major.between(5, 12), 5)


def twelve_class(code: str) -> Column:
    """The first two digits as a number if within 1..12."""
    major = F.substring(code, 1, 2).try_cast("int")
    return F.when(major.between(1, 12), major)


def eight_class(code: str) -> Column:
    """Eight classes; codes are padded to four digits first, and 1202 is class 8 before its group is looked at."""
    full = F.lpad(code, 4, "0")
    major = F.substring(full, 1, 2).try_cast("int")
    return F.when(full == "1202", 8).when(major.between(1, 4), major).when(major.between(5, 10), 5).when(major == 11, 6).when(major == 12, 7)


def binary_class(c: str) -> Column:
    return F.when(F.col(c).isin(1, 2), 1).otherwise(2)


def merged_class(c: str) -> Column:
    """Class 8 counts as 6 and class 2 as 1."""
    return F.when(F.col(c) == 8, 6).when(F.col(c) == 2, 1).otherwise(F.col(c))


def class_name(c: str) -> Column:
    """Display name of a class, its number as text if unknown."""
    out = F.lit(None).cast("string")
    for i, name, _, _ in reversed(CLASSES):
        out = F.when(F.col(c) == i, name).otherwise(out)
    return F.coalesce(out, F.col(c).cast("string"))


def class_colour(c: str) -> Column:
    out = F.lit("#999999")
    for i, _, _, rgb in reversed(CLASSES):
        out = F.when(F.col(c) == i, rgb).otherwise(out)
    return out


def hex_colour(r: str, g: str, b: str) -> Column:
    return F.format_string("#%02x%02x%02x", F.col(r).cast("int"), F.col(g).cast("int"), F.col(b).cast("int"))


def clipped(value: Column, most: float) -> Column:
    return F.least(F.greatest(value, F.lit(-most)), F.lit(most))


def spectral_indices(red: Column, green: Column, blue: Column, nir: Column) -> dict[str, Column]:
    """Vegetation and water indices of reflectances; each has its own guard against a zero denominator."""
    eps = 1e-6
    return {
        "ndvi": (nir - red) / (nir + red + eps),
        "savi": 1.5 * (nir - red) / (nir + red + 0.5 + eps),
        "evi": clipped(2.5 * (nir - red) / (nir + 6 * red - 7.5 * blue + 1 + eps), 1.5),
        "gndvi": (nir - green) / (nir + green + eps),
        "ndwi": (green - nir) / (green + nir + eps),
        "msavi": (2 * nir + 1 - F.sqrt(F.greatest((2 * nir + 1) * (2 * nir + 1) - 8 * (nir - red), F.lit(0.0)))) / 2,
    }


def colour_rule(r: Column, g: Column, b: Column, spread: Column) -> Column:
    """Class of a colour by ordered rules, the first that holds; 0 if none does."""
    bright = (r + g + b) / 3
    return (
        F.when((b > r) & (b > g) & (bright < 120), 6)
        .when((g > r) & (g > b) & (bright < 90), 3)
        .when((g >= r) & (g > b), 4)
        .when((bright > 170) & (spread < 60), 5)
        .when((r > g) & (g > b) & (bright >= 110), 1)
        .when((r > b) & (spread > 40), 7)
        .otherwise(0)
    )


def rule_table(rules: DataFrame) -> Column:
    """Class by the rules ``(rank, condition, cls)`` of a table, SQL conditions in order of rank; the first that holds counts, 0 if none does."""
    chain = F.lit(0)
    for r in rules.orderBy(F.desc("rank")).collect():
        chain = F.when(F.expr(r["condition"]), r["cls"]).otherwise(chain)
    return chain
