"""SimHash near-duplicates by multi-index hashing."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import islice

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from landgrid.llm.components import connected_components
from landgrid.session import cut_lineage, table

SEED = 42
CROWD = 512  # fingerprints that may share a segment's value before it is split by the other segment's bits
BLOCK = 1 << 15  # shingles hashed at a time, so that a very long text takes bounded memory


def fingerprint(text: str | None, width: int = 3) -> int:
    """64-bit SimHash of the word shingles of ``text`` as a signed long; no word gives 0."""
    words = text.encode().lower().split() if text else []
    if not words:
        return 0
    if len(words) <= width:
        shingles, total = iter([b" ".join(words)]), 1
    else:
        shingles, total = map(b" ".join, zip(*(words[i:] for i in range(width)), strict=False)), len(words) - width + 1
    digest, ones = partial(xxhash.xxh64_intdigest, seed=SEED), np.zeros(64, np.int64)
    for start in range(0, total, BLOCK):
        count = min(BLOCK, total - start)
        hashes = np.fromiter(map(digest, islice(shingles, count)), np.uint64, count)
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > total, bitorder="little").view(np.int64)[0])


def fingerprint_column(text: str, width: int = 3) -> Column:
    """The fingerprint of a text column. A null, empty or blank text has fingerprint 0."""

    @F.pandas_udf("long")
    def simhash(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in texts:
            yield pd.Series([fingerprint(t, width) for t in s], dtype="int64")

    return simhash(text)


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """``(doc_id, fp long)`` for every row of ``docs``."""
    return docs.select("doc_id", fingerprint_column("text", width).alias("fp"))


def segments(fp: str) -> Column:
    """The two 32-bit segments of a fingerprint as ``array<struct(seg int, value long, rest long)>``; ``rest`` is the other segment."""
    low, high = f"({fp} & 4294967295L)", f"shiftrightunsigned({fp}, 32)"
    return F.expr(f"array(struct(0 AS seg, {low} AS value, {high} AS rest), struct(1 AS seg, {high} AS value, {low} AS rest))")


def near_links(prints: DataFrame, crowd: int = CROWD) -> DataFrame:
    """``prints(fp)``, distinct -> ``(src, dst)``, all pairs of fingerprints that differ in 1 or 2 bits, each once or twice.

    Multi-index hashing: the table has a row for each of a fingerprint's two 32-bit segments. Of two fingerprints at most
    two bits apart, one segment differs in at most one bit, so each fingerprint looks up, for both segments, the ball of
    radius one around its value; of two values one bit apart only the one with the bit unset looks up the other. Complete
    distances of the matches are verified.

    A segment value that more than ``crowd`` fingerprints share is split: there the other segment differs in at most two
    bits, so one of its three parts (11, 11 and 10 bits) is equal, and the lookup is by segment value, part and its value.
    """
    table = prints.select("fp", F.explode(segments("fp")).alias("s")).select("fp", "s.*")
    balls = table.select("fp", "seg", "rest", F.explode(F.expr(
        "concat(array(struct(value AS key, 0 AS flips)), transform(filter(sequence(0, 31), i -> value & shiftleft(1L, i) = 0), i -> struct(value | shiftleft(1L, i) AS key, 1 AS flips)))"
    )).alias("ball")).select(F.col("fp").alias("src"), "seg", F.col("rest").alias("src_rest"), F.col("ball.key").alias("value"), "ball.flips")
    crowded = cut_lineage(table.groupBy("seg", "value").count().where(F.col("count") > crowd).select("seg", "value"))
    verified = "src <> dst AND bit_count(src ^ dst) <= 2 AND (flips = 1 OR src < dst)"
    rows = table.select(F.col("fp").alias("dst"), "seg", "value", "rest")
    if crowded.isEmpty():
        return balls.join(rows, ["seg", "value"]).where(verified).select("src", "dst")
    place = ["seg", "value"]
    plain = balls.join(rows.join(crowded, place, "left_anti"), place).where(verified).select("src", "dst")
    parts = lambda rest: F.expr(f"array(struct(0 AS part, {rest} & 2047 AS bits), struct(1 AS part, shiftright({rest}, 11) & 2047 AS bits), struct(2 AS part, shiftright({rest}, 22) AS bits))")
    asked = balls.join(crowded, place, "left_semi").select("src", "flips", *place, F.explode(parts("src_rest")).alias("p"))
    held = rows.join(crowded, place, "left_semi").select("dst", *place, F.explode(parts("rest")).alias("p"))
    split = asked.join(held, [*place, "p"]).where(verified).select("src", "dst")
    return plain.union(split)


def fingerprint_classes(prints: DataFrame) -> DataFrame:
    """``prints(doc_id, fp)`` -> ``(fp, root, component_id, copies)``, one row for each fingerprint."""
    classes = cut_lineage(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("copies")))
    roots = connected_components(near_links(classes))
    rooted = classes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    return rooted.join(least, "root").select("fp", "root", "component_id", "copies")


def simhash_components(docs: DataFrame) -> DataFrame:
    """``docs(doc_id, text, ...)`` -> ``(doc_id, fingerprint, component_id, copies)``, one row for each row of ``docs``.

    Equal fingerprints are one class, so copies never make pairs. ``component_id`` is the smallest doc_id that can be
    reached over links of at most two differing bits; ``copies`` counts the documents of the fingerprint. Null texts
    count as texts without words. Rows with a null doc_id get the id of their component, or null if it has none.
    Repeated rows stay repeated. Other columns of ``docs`` are not read.
    """
    prints = cut_lineage(fingerprints(docs))
    return prints.join(fingerprint_classes(prints), "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "copies"
    )


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``simhash_components`` of every row of ``documents``."""
    return simhash_components(table(spark, sf_dir, "documents"))
