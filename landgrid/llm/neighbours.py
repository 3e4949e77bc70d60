"""Approximate nearest neighbours with a hierarchical k-means tree and best-bin-first traversal."""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from math import ceil, sqrt

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from landgrid.session import cut_lineage, table


@dataclass(frozen=True)
class Plan:
    """Bounds and aims: the tree is fitted on about ``sample`` vectors, leaves aim at ``leaf_rows`` vectors and there are at
    most ``max_leaves``; ``probes`` vectors are compared with all rows to find the leaf visits that reach ``recall``;
    ``block_rows`` vectors at most are searched in one group, by about ``chunk_queries`` queries."""

    sample: int = 20_000
    leaf_rows: int = 512
    max_leaves: int = 4096
    probes: int = 128
    recall: float = 0.95
    block_rows: int = 4096
    chunk_queries: int = 4096
    seed: int = 7


class Tree:
    """Centres of a k-means tree; leaves are numbered in depth-first order."""

    def __init__(self, points: np.ndarray, leaves: int, seed: int):
        rng = np.random.default_rng(seed)
        self.branch = max(2, ceil(sqrt(leaves))) if leaves <= 1024 else max(2, ceil(leaves ** (1 / 3)))
        self.leaves = 0
        self.root = self._split(points, leaves, rng)

    def _split(self, points: np.ndarray, leaves: int, rng: np.random.Generator) -> tuple[np.ndarray, list] | int:
        if leaves <= 1 or len(np.unique(points, axis=0)) < 2:
            self.leaves += 1
            return self.leaves - 1
        k = min(self.branch, leaves, len(points))
        centres = kmeans(points, k, rng)
        side = nearest(points, centres)
        return centres, [self._split(points[side == i], max(1, round(leaves * (side == i).mean())), rng) for i in range(len(centres))]

    def leaf(self, points: np.ndarray) -> np.ndarray:
        """Leaf of every point: down the nearest centres."""
        out = np.zeros(len(points), np.int32)
        todo = [(self.root, np.arange(len(points)))]
        while todo:
            node, rows = todo.pop()
            if isinstance(node, int):
                out[rows] = node
                continue
            side = nearest(points[rows], node[0])
            todo += [(child, rows[side == i]) for i, child in enumerate(node[1]) if (side == i).any()]
        return out

    def visits(self, point: np.ndarray, most: int, rows: np.ndarray | None = None, least: int = 0) -> list[int]:
        """The first ``most`` leaves, best bin first: always the node whose centre is nearest of all seen so far.

        With ``rows``, the rows of each leaf, it goes on until the leaves visited hold ``least`` rows, or all are visited.
        """
        queue, found, count, held = [(0.0, 0, self.root)], [], 0, 0
        while queue and (len(found) < most or rows is not None and held < least):
            _, _, node = heapq.heappop(queue)
            if isinstance(node, int):
                found.append(node)
                held += 0 if rows is None else int(rows[node])
                continue
            for d, child in zip(((node[0] - point) ** 2).sum(axis=1), node[1], strict=True):
                count += 1
                heapq.heappush(queue, (float(d), count, child))
        return found


def nearest(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres**2).sum(axis=1) - 2 * points @ centres.T).argmin(axis=1)


def kmeans(points: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 12) -> np.ndarray:
    centres = points[rng.choice(len(points), k, replace=False)].copy()
    for _ in range(rounds):
        side = nearest(points, centres)
        for i in range(k):
            if (side == i).any():
                centres[i] = points[side == i].mean(axis=0)
    return centres


def lifted(vectors: np.ndarray, most: float) -> np.ndarray:
    """One more coordinate makes all vectors as long as ``most``, so that the largest inner product is the least distance."""
    return np.column_stack([vectors, np.sqrt(np.maximum(most**2 - (vectors**2).sum(axis=1), 0))])


def top(query: np.ndarray, vectors: np.ndarray, ids: np.ndarray, rough: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and inner products of the k best rows, ties to the smaller id. ``rough`` are products that may be off by rounding."""
    rows = np.arange(len(ids))
    if len(ids) > k:
        rows = np.flatnonzero(rough >= np.partition(rough, len(ids) - k)[len(ids) - k] - 1e-9 * (1 + np.abs(rough).max()))
    exact = (vectors[rows] * query).sum(axis=1)
    order = np.lexsort((ids[rows], -exact))[:k]
    return ids[rows][order], exact[order]


def usable(vectors: DataFrame) -> DataFrame:
    """``(vec_id, vector array<double>)`` without nulls, zero vectors and non-finite components."""
    v = F.col("embedding").cast("array<double>")
    odd = F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    good = vectors.select("vec_id", v.alias("vector")).where(F.col("vec_id").isNotNull() & F.col("vector").isNotNull())
    return good.where(~odd & F.exists("vector", lambda x: x != 0))


def _matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(len(column), -1)


def search(vectors: DataFrame, is_query: Column, k: int = 20, plan: Plan = Plan()) -> DataFrame:
    """``vectors(vec_id, embedding, ...)`` -> ``(query_id, rank, vec_id, score)``: for every row with ``is_query`` its k rows of
    the largest inner product, its own id left out, nearest first, ties to the smaller vec_id.

    A query visits the calibrated number of leaves, and more until they hold k rows besides those of its own id.
    Every usable row is indexed; null, zero and non-finite vectors and null ids take no part. Inner products are of vectors
    of one length, so each length is searched by itself; the lengths of a table are few. A query with fewer other rows
    gets what there is; an empty table gives no rows. Repeated rows are candidates each, and each repeated query row gets an
    answer of its own (equal ones are searched once); rows of one id with other vectors are queries of their own.
    Columns of ``vectors`` but vec_id and embedding are not read.
    """
    good = usable(vectors)
    lengths = [r["n"] for r in good.groupBy(F.size("vector").alias("n")).count().orderBy("n").collect()]
    found = [search_length(good.where(F.size("vector") == n), is_query, k, plan) for n in lengths]
    return reduce(DataFrame.union, found or [search_length(good, is_query, k, plan)])


def search_length(good: DataFrame, is_query: Column, k: int, plan: Plan) -> DataFrame:
    """``search`` among usable vectors ``(vec_id, vector)`` of one length."""
    spark = good.sparkSession
    size = good.agg(F.count("*").alias("n"), F.max(F.expr("sqrt(aggregate(vector, 0D, (s, x) -> s + x * x))")).alias("most")).first()
    schema = "query_id long, rank int, vec_id long, score double"
    if not size["n"]:
        return spark.createDataFrame([], schema)
    drawn = F.pmod(F.xxhash64(F.lit(plan.seed), "vec_id"), F.lit(1 << 30))
    sample = np.array([r[0] for r in good.where(drawn < int(min(1, plan.sample / size["n"]) * (1 << 30))).orderBy("vec_id").select("vector").collect()])
    if not len(sample):
        sample = np.array([good.orderBy("vec_id").first()["vector"]])
    most = size["most"]
    leaves = max(16, min(plan.max_leaves, ceil(size["n"] / plan.leaf_rows)))
    sent = spark.sparkContext.broadcast(tree := Tree(lifted(sample, most), leaves, plan.seed))

    def with_leaf(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                leaf = sent.value.leaf(lifted(_matrix(b.column(1)), most))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(leaf)], ["vec_id", "vector", "leaf"])

    index = cut_lineage(good.mapInArrow(with_leaf, "vec_id long, vector array<double>, leaf int"))
    visits = calibrate(index, tree, most, k, plan, size["n"])
    counts = {r["leaf"]: r["count"] for r in index.groupBy("leaf").count().collect()}
    block_of, splits, block, held = {}, {}, 0, 0  # consecutive leaves share a block; a leaf above a block's size is split
    for leaf in range(tree.leaves):
        n = counts.get(leaf, 0)
        if held and held + n > plan.block_rows:
            block, held = block + 1, 0
        block_of[leaf], splits[leaf] = block, max(1, ceil(n / plan.block_rows))
        held += n
    where = spark.sparkContext.broadcast((block_of, splits, np.array([counts.get(leaf, 0) for leaf in range(tree.leaves)])))

    def queries_to_blocks(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        block_of, splits, held = where.value
        for f in frames:
            out: list[tuple] = []
            for no, name, copies, vector, own in zip(f.query_no, f.vec_id, f.copies, f.vector, f.own, strict=True):
                goals: dict[tuple[int, int], list[int]] = {}
                for leaf in sent.value.visits(np.append(vector, 0.0), visits, held, k + own):
                    for part in range(splits[leaf]):
                        goals.setdefault((block_of[leaf], part), []).append(leaf)
                out += [(b, p, no, name, copies, vector, leaves) for (b, p), leaves in goals.items()]
            yield pd.DataFrame(out, columns=["block", "part", "query_no", "query_id", "copies", "query", "leaves"])

    def found(queries: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        if len(queries) and len(rows):
            ids, matrix, leaf = rows.vec_id.to_numpy(), np.stack(rows.vector.to_numpy()), rows.leaf.to_numpy()
            for no, name, copies, vector, leaves in zip(queries.query_no, queries.query_id, queries.copies, queries["query"], queries.leaves, strict=True):
                keep = np.flatnonzero(np.isin(leaf, leaves) & (ids != name))
                if len(keep):
                    best, scores = top(vector, matrix[keep], ids[keep], matrix[keep] @ vector, k)
                    out.append((no, name, copies, best.tolist(), scores.tolist()))
        return pd.DataFrame(out, columns=["query_no", "query_id", "copies", "ids", "scores"])

    literal = lambda d: F.from_json(F.lit("[" + ",".join(str(d[x]) for x in range(tree.leaves)) + "]"), "array<int>")
    at = F.col("leaf") + 1
    rows = index.select(
        F.element_at(literal(block_of), at).alias("block"),
        F.pmod(F.xxhash64("vec_id"), F.element_at(literal(splits), at)).cast("int").alias("part"),
        "vec_id", "vector", "leaf",
    )
    own = index.groupBy("vec_id").agg(F.count("*").alias("own"))
    asked = index.where(is_query).groupBy("vec_id", "vector").agg(F.count("*").alias("copies")).join(own, "vec_id").withColumn("query_no", F.monotonically_increasing_id())
    asked = cut_lineage(asked.mapInPandas(queries_to_blocks, "block int, part int, query_no long, query_id long, copies long, query array<double>, leaves array<int>"))
    # The queries of a group are dealt over chunks, and its rows go to each of them.
    chunks = asked.groupBy("block", "part").agg(F.ceil(F.count("*") / plan.chunk_queries).cast("int").alias("chunks"))
    asked = asked.join(chunks, ["block", "part"]).withColumn("chunk", F.pmod(F.xxhash64("query_no"), F.col("chunks")).cast("int")).drop("chunks")
    rows = rows.join(chunks, ["block", "part"]).withColumn("chunk", F.explode(F.expr("sequence(0, chunks - 1)"))).drop("chunks")
    group = ["block", "part", "chunk"]
    pieces = asked.groupBy(*group).cogroup(rows.groupBy(*group)).applyInPandas(found, "query_no long, query_id long, copies long, ids array<bigint>, scores array<double>")
    pieces = pieces.select("query_no", "query_id", "copies", F.expr("transform(arrays_zip(scores, ids), x -> struct(-x.scores as d, x.ids as v))").alias("near"))
    best = pieces.groupBy("query_no", "query_id", "copies").agg(F.expr(f"slice(array_sort(flatten(collect_list(near))), 1, {k})").alias("near"))
    each = best.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    ranked = each.select("query_id", F.posexplode("near").alias("pos", "x"))
    return ranked.select("query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("x.v").alias("vec_id"), (-F.col("x.d")).alias("score"))


def calibrate(index: DataFrame, tree: Tree, most: float, k: int, plan: Plan, n: int) -> int:
    """Leaf visits that find the share ``plan.recall`` of the k nearest of some probes, which are compared with every row."""
    spark = index.sparkSession
    drawn = F.pmod(F.xxhash64(F.lit(plan.seed + 1), "vec_id"), F.lit(1 << 30))
    probes = index.where(drawn < int(min(1, plan.probes / n) * (1 << 30)) + 1).select("vec_id", "vector").dropDuplicates(["vec_id"]).collect()
    if not probes:
        return tree.leaves
    sent = spark.sparkContext.broadcast((np.array([p["vec_id"] for p in probes]), np.array([p["vector"] for p in probes])))

    def nearest_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, queries = sent.value
        for b in batches:
            if not b.num_rows:
                continue
            ids, matrix, leaf = np.asarray(b.column(0)), _matrix(b.column(1)), np.asarray(b.column(2))
            rough, out = matrix @ queries.T, []
            for i, name in enumerate(names):
                keep = np.flatnonzero(ids != name)
                order = keep[np.argsort(-rough[keep, i], kind="stable")[:k]]
                out.append((int(name), [{"d": -float(rough[r, i]), "v": int(ids[r]), "leaf": int(leaf[r])} for r in order]))
            yield pa.RecordBatch.from_pydict({"query_id": [o[0] for o in out], "near": pa.array([o[1] for o in out], pa.list_(pa.struct([("d", pa.float64()), ("v", pa.int64()), ("leaf", pa.int32())])))})

    pieces = index.mapInArrow(nearest_of, "query_id long, near array<struct<d: double, v: bigint, leaf: int>>")
    truth = pieces.groupBy("query_id").agg(F.expr(f"transform(slice(array_sort(flatten(collect_list(near))), 1, {k}), x -> x.leaf)").alias("leaves")).collect()
    vector = {p["vec_id"]: p["vector"] for p in probes}
    place: list[int] = []
    for r in truth:
        turn = {leaf: i for i, leaf in enumerate(tree.visits(np.append(vector[r["query_id"]], 0.0), tree.leaves))}
        place += [turn[leaf] for leaf in r["leaves"]]
    if not place:
        return tree.leaves
    place.sort()
    return place[min(len(place) - 1, ceil(plan.recall * len(place)) - 1)] + 1


def op10_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)
