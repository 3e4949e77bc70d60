"""LM scoring by cross-entropy difference of matched bigram models with backoff to single words."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from math import ceil

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from landgrid.llm.langid import token_lists
from landgrid.session import cut_lineage, table, written

BROADCAST_ROWS = 500_000  # labelled ids are sent to every task only up to so many (some 20 MB); beyond, the join shuffles
KEPT_WORDS = 1 << 18  # words whose hashes a worker remembers
WIDTH = 6  # bytes of a unit's hash that travel; its bucket stands for more
GROUP = 512  # documents that travel together
TOGETHER = 1 << 18  # words of neighbouring texts whose losses are summed at once
STEP = 2048  # documents whose losses in a bucket are summed at once
START = np.uint64(0x243F6A8885A308D3)  # stands for the word before a text
FACTORS = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


@dataclass(frozen=True)
class Plan:
    """``alpha`` is added to every count. Words and word pairs in a share of ``common`` or more of all documents are counted and scored
    where the documents are; all other words in buckets of about ``bucket_words``. Tasks look for them in blocks of ``sample_docs``."""

    alpha: float = 0.1
    sample_docs: int = 10_000
    common: float = 0.001
    bucket_words: int = 4_000_000


class Words(dict):
    """64-bit hash of every word seen."""

    def __missing__(self, word: str) -> int:
        if len(self) >= KEPT_WORDS:
            self.clear()
        found = self[word] = xxhash.xxh64_intdigest(word)
        return found


def word_hashes(words: Words, text: str | None) -> np.ndarray:
    """A 64-bit hash for each word of ``text`` (lower case, between white space)."""
    parts = [np.fromiter(map(words.__getitem__, tokens), np.uint64, len(tokens)) for tokens in token_lists(text)] if text else []
    return np.concatenate(parts) if parts else np.zeros(0, np.uint64)


def pair_hashes(own: np.ndarray) -> np.ndarray:
    """A 64-bit hash for each word together with the one before it."""
    out = np.concatenate([[START], own[:-1]]) * FACTORS[0] + own if len(own) else own
    out ^= out >> np.uint64(31)
    out *= FACTORS[1]
    return out ^ out >> np.uint64(29)


@dataclass(frozen=True)
class Common:
    """Sorted hashes of the common words and pairs; for each the place of its first word in ``contexts``, -1 for a word; and the
    sorted hashes of the words that begin a common pair."""

    units: np.ndarray
    begins: np.ndarray
    contexts: np.ndarray


@dataclass(frozen=True)
class Counts:
    """Of the target and of all texts: words, words not at the end of a common pair, each common unit, the words behind each context,
    and those of them that end no common pair."""

    words: np.ndarray
    alone: np.ndarray
    units: np.ndarray
    behind: np.ndarray
    open: np.ndarray


@dataclass(frozen=True)
class Split:
    """A text's words: places of its common units (pairs, and words alone), how many words are alone, the hashes of the others,
    sorted, and the contexts of all words behind one and of those of them that are alone."""

    places: np.ndarray
    alone: int
    others: np.ndarray
    behind: np.ndarray
    open: np.ndarray


def split(own: np.ndarray, common: Common) -> Split:
    place = place_of(pair_hashes(own), common.units)
    alone = place == len(common.units)
    place[alone] = place_of(own[alone], common.units)
    context = place_of(np.concatenate([[START], own[:-1]]) if len(own) else own, common.contexts)
    behind = context < len(common.contexts)
    return Split(place[place < len(common.units)], int(alone.sum()), np.sort(own[place == len(common.units)]), context[behind], context[behind & alone])


def bucket_of(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Buckets in the order of the hashes."""
    return (hashes >> np.uint64(40)) * np.uint64(buckets) >> np.uint64(24)


def marked(docs: DataFrame, targets: DataFrame) -> DataFrame:
    """``(doc_id, text, target)``: whether a document's id is among ``targets(doc_id)``."""
    ids = targets.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id is not null").distinct().withColumn("target", F.lit(True))
    few = ids.count() <= BROADCAST_ROWS
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = rows.join(F.broadcast(ids) if few else ids, "doc_id", "left").select("doc_id", "text", F.coalesce("target", F.lit(False)).alias("target"))
    return rows if few else rows.sortWithinPartitions("doc_id", F.xxhash64("text"))  # a task that runs again finds the same order


def hashed(rows: DataFrame) -> DataFrame:
    """``rows`` with ``hashes``, the word hashes of ``text`` as bytes, in its place."""
    kept = [c for c in rows.columns if c != "text"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for b in batches:
            found = pa.array((word_hashes(words, t.as_py()).tobytes() for t in b.column("text")), pa.binary())
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), found], [*kept, "hashes"])

    schema = ", ".join([*(f"{c} {rows.schema[c].dataType.simpleString()}" for c in kept), "hashes binary"])
    return rows.mapInArrow(cut, schema)


def own_hashes(column: pa.Array) -> Iterator[np.ndarray]:
    """The word hashes of each row."""
    return (np.frombuffer(h.as_py(), np.uint64).copy() for h in column)


def block_units(docs: DataFrame, share: float, size: int) -> DataFrame:
    """``(unit, docs, begin, slack)``: words and pairs that a ``share`` or more of a block's documents hold, with how many and, for a pair,
    the hash of its first word. A block is ``size`` documents or more of a task, or all it has. ``slack`` is the most
    documents a unit not listed for the block can have there; a row of each block without a unit has it too."""

    def merged(parts: list[tuple]) -> tuple:
        if len(parts) == 1:
            return parts[0]
        units, n, begins, pair = (np.concatenate(c) for c in zip(*parts, strict=True))
        found, at, back = np.unique(units, return_index=True, return_inverse=True)
        return found, np.bincount(back, n, len(found)).astype(np.int64), begins[at], pair[at]

    def listed(block: tuple, number: int) -> pa.RecordBatch:
        slack = ceil(share * number) - 1
        units, n, begins, pair = (c[block[1] > slack] for c in block)
        columns = [pa.array(units.view(np.int64)), pa.array(n), pa.array(begins.view(np.int64), mask=~pair)]
        last = pa.RecordBatch.from_arrays([*(pa.nulls(1, pa.int64()) for _ in range(3)), pa.array([slack])], names)
        return pa.concat_batches([pa.RecordBatch.from_arrays([*columns, pa.array(np.full(len(units), slack))], names), last])

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole, open_, number, parts = None, 0, 0, []
        for b in batches:
            found, begins, pair = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)], [np.zeros(0, bool)]
            for own in own_hashes(b.column(0)):
                pairs, at = np.unique(pair_hashes(own), return_index=True)
                alone = np.unique(own)
                found += [pairs, alone]
                begins += [np.concatenate([[START], own[:-1]])[at] if len(own) else own, np.zeros(len(alone), np.uint64)]
                pair += [np.ones(len(pairs), bool), np.zeros(len(alone), bool)]
            found, at, n = np.unique(np.concatenate(found), return_index=True, return_counts=True)
            parts.append((found, n, np.concatenate(begins)[at], np.concatenate(pair)[at]))
            open_ += b.num_rows
            if open_ >= size:  # the block before is as long as it gets; what is left at the end joins the last one
                if whole is not None:
                    yield listed(whole, number)
                whole, number, open_, parts = merged(parts), open_, 0, []
        if whole is not None or parts:
            yield listed(merged(parts + ([whole] if whole is not None else [])), number + open_)

    names = ["unit", "docs", "begin", "slack"]
    return docs.select("hashes").mapInArrow(held, "unit long, docs long, begin long, slack long")


def common_units(docs: DataFrame, plan: Plan) -> Common:
    """The common units of ``docs(text)``, see ``common_among``."""
    return common_among(written(hashed(docs.select("text"))), plan)


def common_among(docs: DataFrame, plan: Plan) -> Common:
    """The words and pairs that a share of ``common`` or more of all documents hold: at most ``1 / common`` times the mean number of a
    document's words and pairs.

    Counts are exact. Each block of documents lists the units in half that share of its own documents; a unit that with the most it
    can have in all other blocks stays under the share is none. What remains is in half the share of all documents at least,
    so it is few, and is counted over all documents.
    """
    number = docs.count()
    least = max(2, ceil(plan.common * number))
    blocks = cut_lineage(block_units(docs, plan.common / 2, plan.sample_docs))
    slack = blocks.where("unit IS NULL").agg(F.sum("slack")).first()[0] or 0
    sums = blocks.where("unit IS NOT NULL").groupBy("unit").agg((F.sum("docs") - F.sum("slack")).alias("over"), F.min("begin").alias("begin"))
    found = sums.where(F.col("over") + slack >= least).select("unit", "begin").toArrow()
    units = np.asarray(found.column("unit")).view(np.uint64)
    begins = found.column("begin").combine_chunks() if found.num_rows else pa.array([], pa.int64())
    pair, begin = ~np.asarray(begins.is_null()), np.asarray(begins.fill_null(0)).view(np.uint64)
    order = np.argsort(units)
    units, pair, begin = units[order], pair[order], begin[order]
    kept = documents_with(docs, units) >= least
    units, pair, begin = units[kept], pair[kept], begin[kept]
    contexts = np.unique(begin[pair])
    return Common(units, np.where(pair, np.searchsorted(contexts, begin), -1), contexts)


def documents_with(docs: DataFrame, units: np.ndarray) -> np.ndarray:
    """For each of the sorted ``units`` the number of documents that hold it."""
    sent = docs.sparkSession.sparkContext.broadcast(units)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(len(sent.value), np.int64)
        for b in batches:
            for own in own_hashes(b.column(0)):
                place = np.unique(place_of(np.concatenate([pair_hashes(own), own]), sent.value))
                sums[place[place < len(sums)]] += 1
        at = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(sums[at])], ["place", "docs"])

    found = docs.select("hashes").mapInArrow(counted, "place long, docs long").groupBy("place").agg(F.sum("docs").alias("docs")).toArrow()
    sums = np.zeros(len(units), np.int64)
    sums[np.asarray(found.column("place"))] = np.asarray(found.column("docs"))
    return sums


def common_counts(rows: DataFrame, common: Common) -> Counts:
    """Counts over all rows; each task sends its sums for the common units and contexts."""
    sent = rows.sparkSession.sparkContext.broadcast(common)
    size, around = len(common.units), len(common.contexts)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, 2 + size + 2 * around), np.int64)
        for b in batches:
            for own, target in zip(own_hashes(b.column(0)), b.column(1).to_pylist(), strict=True):
                s = split(own, sent.value)
                at = np.concatenate([2 + s.places, 2 + size + s.behind, 2 + size + around + s.open])
                for side in (0, 1) if target else (1,):
                    np.add.at(sums[side], at, 1)
                    sums[side, :2] += len(own), s.alone
        at = np.flatnonzero(sums[1])
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(sums[0, at]), pa.array(sums[1, at])], ["place", "target", "background"])

    parts = rows.select("hashes", "target").mapInArrow(counted, "place long, target long, background long")
    found = parts.groupBy("place").agg(F.sum("target").alias("target"), F.sum("background").alias("background")).toArrow()
    sums = np.zeros((2, 2 + size + 2 * around), np.int64)
    sums[:, np.asarray(found.column("place"))] = np.asarray(found.column("target")), np.asarray(found.column("background"))
    return Counts(sums[:, 0], sums[:, 1], sums[:, 2 : 2 + size], sums[:, 2 + size : 2 + size + around], sums[:, 2 + size + around :])


def place_of(found: np.ndarray, common: np.ndarray) -> np.ndarray:
    """Place of every pair among the common ones, their number for the others."""
    if not len(common):
        return np.zeros(len(found), np.int64)
    at = np.minimum(np.searchsorted(common, found), len(common) - 1)
    return np.where(common[at] == found, at, len(common))


def changes(*columns: np.ndarray) -> np.ndarray:
    """The places where any of the columns differs from the place before, the first one included."""
    new = np.ones(len(columns[0]), bool)
    new[1:] = False
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def bucket_sums(values: np.ndarray, owner: np.ndarray, row: np.ndarray, losses: Callable) -> tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """How many ``values`` a bucket has; and each ``owner`` of each ``row``, its row, and its summed ``losses`` by the target's and by
    all counts. The upper bit of an owner says that it is a target. Long arrays are few and narrow, as a bucket has millions of words."""
    new = changes(row, owner, values)
    n = np.diff(np.append(new, len(values))).astype(np.int32)
    values, owner, row = values[new], owner[new], row[new]
    order = np.argsort(values).astype(np.int32)
    values = values[order]
    starts = changes(values)
    at = np.empty(len(values), np.int32)
    at[order] = np.repeat(np.arange(len(starts), dtype=np.int32), np.diff(np.append(starts, len(values))))
    of_all = np.add.reduceat(n[order], starts, dtype=np.int64)
    of_target = np.add.reduceat((n * (owner >> 15))[order], starts, dtype=np.int64)
    del values, order, starts, new
    first = changes(row, owner & 0x7FFF)
    t, g = np.empty(len(first)), np.empty(len(first))
    ends = np.append(first[1:], len(row))
    for i in range(0, len(first), STEP):
        low, high = first[i], ends[i : i + STEP][-1]
        k, hit = n[low:high].astype(np.int64), at[low:high]
        for out, loss in zip((t, g), losses(k, (owner[low:high] >> 15).astype(np.int64), of_target[hit], of_all[hit]), strict=True):
            out[i : i + STEP] = np.add.reduceat(loss, first[i : i + STEP] - low)
    return len(of_all), owner[first] & 0x7FFF, row[first], t, g


def score(docs: DataFrame, targets: DataFrame, plan: Plan = Plan()) -> DataFrame:
    """``docs(doc_id, text, ...)``, ``targets(doc_id)`` -> ``(doc_id, n_tokens, target_loss, background_loss, score)``, a row for each row.

    The target model is counted over the documents whose id is in ``targets``, the background model over all. Both are
    bigram models over one vocabulary, that of the whole corpus. Behind a word that begins common pairs, the next word is one
    of their ends or any other, each with the share that it has there; behind all else, and for any other, the model backs off
    to single words, counted where they end no common pair. A text's first word stands behind a mark of its own.
    Smoothing is the same, and the larger counts are scaled to the smaller total. A document is scored by the models of all other rows
    (its own counts are taken off), with losses as means per word of the whole text; ``score`` is their difference, negative
    for texts like the target's.

    Texts are cut into words once: their hashes, about twice the size of the compressed texts, are written to the shared folder and
    read by the passes that follow. Documents travel in groups of GROUP: a group sends the hashes of its words, with the documents' places, into buckets; a
    bucket has all of the corpus's counts of its words and returns a partial sum for each document. Common units, whose
    number is bounded, are counted and scored beside the documents, so no bucket has a hot word; the number of buckets grows
    with the corpus. A text without words has no tokens and null losses; without any target all ends of a context, and all
    single words, are alike to the target model; repeated rows are scored each; an empty table gives no rows. Columns of ``docs`` but doc_id and text are not read.
    """
    rows = written(hashed(marked(docs, targets)))
    common = common_among(rows, plan)
    counts = common_counts(rows, common)
    least = min((t for t in counts.words.tolist() if t), default=1)
    scale = np.array([min(1.0, least / t) if t else 1.0 for t in counts.words.tolist()])
    single = common.begins < 0
    buckets = max(1, ceil(int(counts.alone[1] - counts.units[1, single].sum()) / plan.bucket_words))
    ways = 1 + np.bincount(common.begins[~single], minlength=len(common.contexts))  # the ends of a context's pairs, and any other word
    sent = docs.sparkSession.sparkContext.broadcast((common, counts, ways))
    alpha = plan.alpha

    def losses(n: np.ndarray, target: np.ndarray, of_target: np.ndarray, of_all: np.ndarray, extra: np.ndarray | int = 0) -> tuple[np.ndarray, np.ndarray]:
        """Summed logs of the counts without the document's own, for ``n`` occurrences each; alpha and ``extra`` are added."""
        return -n * np.log(scale[0] * (of_target - n * target) + alpha + extra), -n * np.log(scale[1] * (of_all - n) + alpha + extra)

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, groups = TaskContext.get().partitionId(), 0
        common, counts, ways = sent.value

        def summed_losses(splits: list[Split], target: np.ndarray) -> np.ndarray:
            """For each text the losses of its common units and of what stands behind contexts: the target's sum and the background's."""
            sums = np.zeros((2, len(splits)))
            for name, of, more, sign in (("places", counts.units, 0, 1), ("open", counts.open, 0, 1), ("behind", counts.behind, ways - 1, -1)):
                size = max(1, of.shape[1])
                hit, n = np.unique(np.concatenate([getattr(s, name) + i * size for i, s in enumerate(splits)]), return_counts=True)
                text, hit = np.divmod(hit, size)
                extra = alpha * more[hit] if sign < 0 else 0
                for out, loss in zip(sums, losses(n, target[text], of[0, hit], of[1, hit], extra), strict=True):
                    out += sign * np.bincount(text, loss, len(splits))
            return sums.T

        for batch in batches:
            for first in range(0, batch.num_rows, GROUP):
                b = batch.slice(first, GROUP)
                sizes, entries, sums, open_, held = [], [], [], [], 0
                target = np.asarray(b.column(2).cast(pa.int64()))
                for i, own in enumerate(own_hashes(b.column(1)), 1):
                    s = split(own, common)
                    sizes.append((len(own), s.alone))
                    entries.append(s.others)
                    open_.append(s)
                    held += len(own)
                    if i == b.num_rows or held > TOGETHER:
                        sums.append(summed_losses(open_, target[i - len(open_) : i]))
                        open_, held = [], 0
                groups += 1
                yield packed(part << 32 | groups, b, sizes, entries, np.concatenate(sums))

    def packed(group: int, b: pa.RecordBatch, sizes: list[tuple[int, int]], entries: list[np.ndarray], sums: np.ndarray) -> pa.RecordBatch:
        """A row for each bucket with the group's hashes and whose they are, and one for the documents themselves."""
        flat, target = np.concatenate(entries), np.asarray(b.column(2).cast(pa.int64()))
        owner = np.repeat(np.arange(len(entries)) | target << 15, [len(e) for e in entries]).astype("<u2")
        bucket = bucket_of(flat, buckets).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        flat, owner, bucket = flat[order], owner[order], bucket[order]
        new = np.flatnonzero(np.diff(bucket, prepend=-1) != 0)
        ends = np.append(new[1:], len(flat)) if len(new) else new
        data = np.ascontiguousarray(flat.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :WIDTH])
        rows = [(int(bucket[i]), group, owner[i:j].tobytes(), data[i:j].tobytes(), None) for i, j in zip(new, ends, strict=True)]
        members = [{"doc_id": d, "n": n, "alone": m, "target": bool(t), "t": x, "g": y} for d, (n, m), t, (x, y) in zip(b.column(0).to_pylist(), sizes, target, sums.tolist(), strict=True)]
        rows.append((group % buckets, group, None, None, members))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), SENT, strict=True)], ["bucket", "grp", "owners", "hashes", "members"])

    def summed(table: pa.Table) -> pa.Table:
        """One bucket: counts of its words over the corpus, and from them the sums of each group's documents."""
        columns = [table.column(c).to_pylist() for c in ("grp", "owners", "hashes", "members")]
        sent_rows = [r for r in zip(*columns, strict=True) if r[3] is None]
        out = [(g, None, None, None, 0, m) for g, _, _, m in zip(*columns, strict=True) if m is not None]
        if sent_rows:
            data = np.frombuffer(b"".join(r[2] for r in sent_rows), np.uint8).reshape(-1, WIDTH)
            wide = np.zeros((len(data), 8), np.uint8)
            wide[:, :WIDTH] = data
            owner = np.frombuffer(b"".join(r[1] for r in sent_rows), "<u2")
            row = np.repeat(np.arange(len(sent_rows), dtype=np.int32), [len(r[1]) // 2 for r in sent_rows])
            del data, columns
            found, owner, row, t, g = bucket_sums(wide.view("<u8").ravel(), owner, row, losses)
            cut = np.append(np.flatnonzero(np.diff(row, prepend=-1) != 0), len(row)).tolist()
            each = zip(sent_rows, cut[:-1], cut[1:], strict=True)
            out += [(r[0], owner[i:j].tobytes(), t[i:j].tobytes(), g[i:j].tobytes(), found if i == 0 else 0, None) for r, i, j in each]
        return pa.table([pa.array(c, t) for c, t in zip(zip(*out, strict=True), RETURNED, strict=True)], ["grp", "owners", "t", "g", "kinds", "members"])

    def assembled(table: pa.Table) -> pa.Table:
        """One group: the sums of its documents over all buckets."""
        members = next(m for m in table.column("members").to_pylist() if m is not None)
        t, g = np.array([m["t"] for m in members]), np.array([m["g"] for m in members])
        for owners, x, y in zip(*[table.column(c).to_pylist() for c in ("owners", "t", "g")], strict=True):
            if owners is not None:
                at = np.frombuffer(owners, "<u2")
                t[at] += np.frombuffer(x)
                g[at] += np.frombuffer(y)
        kinds = np.zeros(len(members), np.int64)
        kinds[0] = sum(table.column("kinds").to_pylist())
        columns = [pa.array([m[k] for m in members], of) for k, of in (("doc_id", pa.int64()), ("n", pa.int64()), ("alone", pa.int64()), ("target", pa.bool_()))]
        return pa.table([*columns, pa.array(t), pa.array(g), pa.array(kinds)], ["doc_id", "n_tokens", "alone", "target", "t", "g", "kinds"])

    member = "members array<struct<doc_id: bigint, n: bigint, alone: bigint, target: boolean, t: double, g: double>>"
    parts = rows.select("doc_id", "hashes", "target").mapInArrow(dealt, f"bucket long, grp long, owners binary, hashes binary, {member}")
    parts = parts.groupBy("bucket").applyInArrow(summed, f"grp long, owners binary, t binary, g binary, kinds long, {member}")
    whole = parts.groupBy("grp").applyInArrow(assembled, "doc_id long, n_tokens long, alone long, target boolean, t double, g double, kinds long")
    whole = cut_lineage(whole)
    kinds = max(1, (whole.agg(F.sum("kinds")).first()[0] or 0) + int(single.sum()))
    rest = lambda i, own: F.log(float(scale[i]) * (F.lit(int(counts.alone[i])) - own) + alpha * kinds)
    mean = lambda name, i, own: F.when(F.col("n_tokens") > 0, (F.col(name) + F.col("alone") * rest(i, own)) / F.col("n_tokens"))
    own = F.when(F.col("target"), F.col("alone")).otherwise(0)
    out = whole.select("doc_id", "n_tokens", mean("t", 0, own).alias("target_loss"), mean("g", 1, F.col("alone")).alias("background_loss"))
    return out.withColumn("score", F.col("target_loss") - F.col("background_loss"))


_MEMBERS = pa.list_(pa.struct([("doc_id", pa.int64()), ("n", pa.int64()), ("alone", pa.int64()), ("target", pa.bool_()), ("t", pa.float64()), ("g", pa.float64())]))
SENT = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), _MEMBERS]
RETURNED = [pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.int64(), _MEMBERS]


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rows of ``documents``; target: those labelled of good quality."""
    return score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").where("quality = 1"))
