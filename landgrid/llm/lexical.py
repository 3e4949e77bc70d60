"""Ranked lexical search: documents' restricted term vectors in tries, searched by branch and bound."""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from math import ceil, floor, log

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from landgrid.session import shared_path, table

#: Letters and digits of ASCII (A-Z as a-z) and every byte beyond ASCII are of a term, all else parts terms.
TERM_BYTES = bytes(ord(chr(b).lower()) if chr(b).isalnum() else 0x20 for b in range(0x80)) + bytes(range(0x80, 0x100))
LAST = (1 << 63) - 1  # where a null doc_id stands among equal scores


@dataclass(frozen=True)
class Limits:
    """``block_bytes``: items are searched in blocks of about so many bytes of text; ``tree_terms`` and ``tree_docs``: a trie
    is built of so many document terms and documents at most; ``leaf_docs``: so few documents aren't parted further."""

    block_bytes: int = 8_000_000
    tree_terms: int = 2_000_000
    tree_docs: int = 20_000
    leaf_docs: int = 16


def terms_of(text: bytes | None) -> list[bytes]:
    return text.translate(TERM_BYTES).split() if text else []


def gain(counts: np.ndarray, m: np.ndarray) -> np.ndarray:
    """What a term adds to a score for each unit of its weight; grows with the count and falls with ``m``."""
    return (1_000_000_000 * counts) // (1000 * counts + 8 * m)


def shared_prefix(a: np.ndarray, b: np.ndarray) -> int:
    n = min(len(a), len(b))
    differ = a[:n] != b[:n]
    at = int(differ.argmax()) if n else 0
    return at if n and differ[at] else n


class Trie:
    """Documents as paths of their terms, the most frequent first; what stands below a node bounds its documents' scores.

    Documents with equal paths, counts and ``m`` are one entry with its ``k`` smallest ids. A node is a stretch of the entries
    in order of their paths, parted where neighbours share the shortest prefixes; it has the greatest count of each term
    below it, the least ``m`` and the least id. An entry is a node of its own, so its bound is its score.
    """

    def __init__(self, docs: list[tuple[int, int, np.ndarray, np.ndarray]], k: int, leaf: int):
        entries: dict[tuple, list] = {}
        for name, m, terms, counts in docs:
            entries.setdefault((terms.astype(">u4").tobytes(), m, counts.tobytes()), [terms, counts, []])[2].append(name)
        order = sorted(entries)
        self.ids = [heapq.nsmallest(k, entries[e][2]) for e in order]
        self.terms, self.counts = [entries[e][0] for e in order], [entries[e][1] for e in order]
        self.least_m, self.least_id = [e[1] for e in order], [x[0] for x in self.ids]
        self.children: dict[int, np.ndarray] = {}
        shared = np.array([shared_prefix(a, b) for a, b in zip(self.terms, self.terms[1:], strict=False)], np.int64)
        self.root = self._grow(0, len(order), shared, leaf)
        sizes = [len(t) for t in self.terms]
        every = np.concatenate(self.terms)
        self.width = 1 + int(every.max(initial=0))
        self.keys = np.repeat(np.arange(len(sizes)), sizes) * self.width + every
        self.most = np.concatenate(self.counts)
        self.least_m, self.least_id = np.array(self.least_m), np.array(self.least_id)
        del self.terms, self.counts

    def _grow(self, lo: int, hi: int, shared: np.ndarray, leaf: int) -> int:
        if hi - lo == 1:
            return lo
        below = list(range(lo, hi)) if hi - lo <= leaf else [self._grow(a, b, shared, leaf) for a, b in parted(lo, hi, shared, leaf)]
        terms, counts = np.concatenate([self.terms[i] for i in below]), np.concatenate([self.counts[i] for i in below])
        order = np.argsort(terms, kind="stable")
        terms = terms[order]
        first = np.flatnonzero(np.concatenate([[True], terms[1:] != terms[:-1]])) if len(terms) else np.zeros(0, np.int64)
        self.terms.append(terms[first])
        self.counts.append(np.maximum.reduceat(counts[order], first) if len(first) else counts)
        self.least_m.append(min(self.least_m[i] for i in below))
        self.least_id.append(min(self.least_id[i] for i in below))
        self.children[len(self.terms) - 1] = np.array(below)
        return len(self.terms) - 1

    def bounds(self, nodes: np.ndarray, terms: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """No document below each of ``nodes`` scores more; of an entry, its score."""
        keys = nodes[:, None] * self.width + terms
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        counts = np.where(self.keys[at] == keys, self.most[at], 0)
        return (gain(counts, self.least_m[nodes][:, None]) * weights).sum(axis=1)

    def search(self, terms: np.ndarray, weights: np.ndarray, best: list[tuple[int, int]], k: int) -> None:
        """Depth first from the highest bound; ``best``, a heap of ``(score, -id)``, has the k best so far and gets better ones."""
        known = terms < self.width
        terms, weights = terms[known], weights[known]
        if not len(terms) or not len(self.keys):
            return
        root = np.array([self.root])
        todo = [(int(self.bounds(root, terms, weights)[0]), self.root)]
        while todo:
            bound, node = todo.pop()
            if not bound or len(best) == k and (bound, -int(self.least_id[node])) <= best[0]:
                continue
            if node not in self.children:
                for name in self.ids[node]:
                    if len(best) < k:
                        heapq.heappush(best, (bound, -name))
                    elif (bound, -name) > best[0]:
                        heapq.heapreplace(best, (bound, -name))
                continue
            below = self.children[node]
            bound = self.bounds(below, terms, weights)
            hope = bound > 0 if len(best) < k else bound >= max(best[0][0], 1)
            below, bound = below[hope], bound[hope]
            order = np.argsort(bound, kind="stable")
            todo += zip(bound[order].tolist(), below[order].tolist(), strict=True)


def parted(lo: int, hi: int, shared: np.ndarray, leaf: int) -> list[tuple[int, int]]:
    """``[lo, hi)`` cut where neighbours share the least, until no part has over three quarters of it; small parts next to
    each other are put together again, up to ``leaf``."""
    size, todo, out = hi - lo, [(lo, hi)], []
    while todo:
        a, b = todo.pop()
        if 4 * (b - a) <= 3 * size:
            out.append((a, b))
            continue
        between = shared[a : b - 1]
        cuts = a + 1 + np.flatnonzero(between == between.min()) if between.min() < between.max() else np.array([(a + b) // 2])
        edges = [a, *cuts.tolist(), b]
        todo += zip(edges, edges[1:], strict=False)
    out.sort()
    merged = [out[0]]
    for a, b in out[1:]:
        if b - merged[-1][0] <= leaf:
            merged[-1] = (merged[-1][0], b)
        else:
            merged.append((a, b))
    return merged


def restricted(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """``(doc_id, n, terms array<int>, counts array<int>)`` of every document with terms: all its terms counted, and how often
    it has those of the vocabulary, by their numbers."""
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        for b in batches:
            ns, terms, counts, ends = [], [], [], [0]
            for text in b.column(1).cast(pa.binary()):
                found = terms_of(text.as_py())
                ns.append(len(found))
                for term, count in Counter(found).items():
                    if (number := known.get(term)) is not None:
                        terms.append(number)
                        counts.append(count)
                ends.append(len(terms))
            lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(x, pa.int32())) for x in (terms, counts)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ns, pa.int64()), *lists], ["doc_id", "n", "terms", "counts"]).filter(pa.array([n > 0 for n in ns], pa.bool_()))

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(rows, "doc_id long, n long, terms array<int>, counts array<int>")


def searched(vectors: DataFrame, items: list[tuple[np.ndarray, np.ndarray]], ranks: np.ndarray, docs: int, words: int, k: int, limits: Limits) -> DataFrame:
    """``(item int, doc_id, score)``: of the documents of each task the k best for each item.

    A task builds a trie of some of its documents at a time and searches all items in it, carrying the scores to beat.
    """
    sent = vectors.sparkSession.sparkContext.broadcast((items, ranks))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, ranks = sent.value
        best: list[list[tuple[int, int]]] = [[] for _ in items]
        held, size = [], 0

        def search() -> None:
            tree = Trie(held, k, limits.leaf_docs)
            for (terms, weights), found in zip(items, best, strict=True):
                tree.search(terms, weights, found, k)

        for b in batches:
            ends = np.asarray(b.column(2).offsets)
            terms, counts = ranks[np.asarray(b.column(2).values)[: ends[-1]]], np.asarray(b.column(3).values)[: ends[-1]].astype(np.int64)
            owner = np.repeat(np.arange(b.num_rows), np.diff(ends))
            order = np.lexsort((terms[ends[0] :], owner)) + ends[0]
            terms[ends[0] :], counts[ends[0] :] = terms[order], counts[order]
            for i, (name, n) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)):
                lo, hi = ends[i], ends[i + 1]
                if lo == hi:
                    continue
                held.append((LAST if name is None else name, 100 - 75 + 75 * n * docs // words, terms[lo:hi], counts[lo:hi]))
                size += hi - lo
                if size >= limits.tree_terms or len(held) >= limits.tree_docs:
                    search()
                    held, size = [], 0
        if held:
            search()
        out = [(i, None if -name == LAST else -name, score) for i, found in enumerate(best) for score, name in found]
        columns = list(zip(*out, strict=True)) or [(), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int64(), pa.int64()), strict=True)], ["item", "doc_id", "score"])

    return vectors.where("size(terms) > 0").mapInArrow(rows, "item int, doc_id long, score long")


def search_block(docs: DataFrame, items: list[tuple[object, bytes]], kind: str, k: int, limits: Limits) -> DataFrame:
    """``search`` for the items ``(item_id, text)`` of a block."""
    spark = docs.sparkSession
    asked = [Counter(terms_of(text)) for _, text in items]
    terms = sorted(set().union(*asked))
    path = shared_path(spark, "term-vectors")
    restricted(docs, {t: i for i, t in enumerate(terms)}).write.parquet(path)
    vectors = spark.read.parquet(path)
    total = vectors.agg(F.count("*").alias("docs"), F.sum("n").alias("words")).first()
    df = np.zeros(len(terms), np.int64)
    for r in vectors.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df")).collect():
        df[r["term"]] = r["df"]
    ranks = np.empty(len(terms), np.int64)
    ranks[np.lexsort((np.arange(len(terms)), -df))] = np.arange(len(terms))  # by falling frequency
    number = {t: i for i, t in enumerate(terms)}
    weight = [floor(1000 * log((2 * total["docs"] + 2) / (2 * int(d) + 1))) for d in df]
    wanted = []
    for counts in asked:
        own = sorted((int(ranks[number[t]]), weight[number[t]] * c) for t, c in counts.items())
        wanted.append((np.array([r for r, _ in own], np.int64), np.array([w for _, w in own], np.int64)))
    found = searched(vectors, wanted, ranks, total["docs"], total["words"] or 1, k, limits)
    rank = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    names = spark.createDataFrame([(i, name) for i, (name, _) in enumerate(items)], f"item int, item_id {kind}")
    return found.withColumn("rank", rank).where(F.col("rank") <= k).join(F.broadcast(names), "item").select("item_id", F.col("rank").cast("int"), "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, k: int = 10, limits: Limits = Limits()) -> DataFrame:
    """``docs(doc_id, text, ...)``, ``items(item_id, text, ...)`` -> ``(item_id, rank, doc_id, score)``: each item's k documents of
    the highest score above 0, ties to the smaller doc_id (null last).

    Every row of ``items`` is ranked by itself, also if it repeats; every row of ``docs`` is a document. Null and empty texts
    have no terms, items without terms no rows, and an empty table gives none. Other columns are not read. Items are
    searched in blocks of bounded size, each against all documents; a block's terms are what the driver holds and sends.
    """
    kind = items.schema["item_id"].dataType.simpleString()
    rows = items.where("text IS NOT NULL").select("item_id", F.encode("text", "UTF-8").alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, ceil(size / limits.block_bytes))
    of: Column = F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks))
    found = []
    for block in range(blocks):
        asked = [(r["item_id"], bytes(r["text"])) for r in rows.where(of == block).collect()]
        asked = [a for a in asked if terms_of(a[1])]
        if asked:
            found.append(search_block(docs, asked, kind, k, limits))
    return reduce(DataFrame.union, found) if found else docs.sparkSession.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``search`` of all rows of ``documents`` for every row of ``benchmark``."""
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP12_SQL = r"""
WITH words AS (
  SELECT doc_id, rid, unnest(terms) AS term FROM (
    SELECT doc_id, row_number() OVER () AS rid, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents)
), asked AS (
  SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark
), wanted AS (
  SELECT item_id, term, count(*) AS times FROM asked GROUP BY ALL
), sizes AS (
  SELECT rid, any_value(doc_id) AS doc_id, count(*) AS n FROM words GROUP BY rid
), total AS (
  SELECT CAST(count(*) AS BIGINT) AS docs, CAST(sum(n) AS BIGINT) AS words FROM sizes
), tf AS (
  SELECT rid, term, CAST(count(*) AS BIGINT) AS tf FROM words SEMI JOIN wanted USING (term) GROUP BY ALL
), weights AS (
  SELECT term, CAST(floor(1000 * ln(CAST(2 * any_value(docs) + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w FROM tf, total GROUP BY term
), scores AS (
  SELECT w.item_id, s.doc_id, s.rid, CAST(sum(w.times * g.w * ((1000000000 * t.tf) // (1000 * t.tf + 8 * (25 + (75 * s.n * docs) // words)))) AS BIGINT) AS score
  FROM wanted w JOIN tf t USING (term) JOIN weights g USING (term) JOIN sizes s USING (rid), total GROUP BY w.item_id, s.doc_id, s.rid
), ranked AS (
  SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM scores WHERE score > 0
)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 10
"""
