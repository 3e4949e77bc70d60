"""Periodic runs of words, found by internal pattern matching: dyadic blocks and range successors in a wavelet tree."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from landgrid.session import table

LEAST_LENGTH, LEAST_POWER = 6, 4  # a run has so many words, and so many times its period
BATCH_WORDS = 1 << 18  # short texts are searched together, up to so many words
DIRECT = 256  # extensions of up to so many words are compared for many candidates at once
COLUMNS = "n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


class Bits:
    """A bit vector with constant-time ranks: 64 bits a word and the ones before each word."""

    def __init__(self, ones: np.ndarray):
        packed = np.packbits(ones, bitorder="little")
        self.words = np.zeros(len(ones) // 64 + 1, np.uint64)
        self.words.view(np.uint8)[: len(packed)] = packed
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words).astype(np.int64))])
        self.zeros = len(ones) - int(self.before[-1])

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Ones before each position."""
        word, bit = at >> 6, (at & 63).astype(np.uint64)
        return self.before[word] + np.bitwise_count(self.words[word] & ((np.uint64(1) << bit) - np.uint64(1)))


class WaveletTree:
    """Wavelet tree, stored by levels, over an array of distinct numbers; answers many range queries at once."""

    def __init__(self, values: np.ndarray):
        self.height = max(1, int(values.max(initial=1)).bit_length())
        self.levels: list[Bits] = []
        for level in range(self.height - 1, -1, -1):
            ones = (values >> level & 1).astype(bool)
            self.levels.append(Bits(ones))
            values = np.concatenate([values[~ones], values[ones]])

    def below(self, lo: np.ndarray, hi: np.ndarray, limit: np.ndarray) -> np.ndarray:
        """How many of ``values[lo:hi]`` are less than ``limit``."""
        count = np.zeros(len(lo), np.int64)
        for depth, bits in enumerate(self.levels):
            lo1, hi1 = bits.rank(lo), bits.rank(hi)
            one = (limit >> (self.height - 1 - depth) & 1).astype(bool)
            count += np.where(one, (hi - hi1) - (lo - lo1), 0)
            lo, hi = np.where(one, bits.zeros + lo1, lo - lo1), np.where(one, bits.zeros + hi1, hi - hi1)
        return count

    def smallest(self, lo: np.ndarray, hi: np.ndarray, nth: np.ndarray) -> np.ndarray:
        """The ``nth`` smallest (from 0) of ``values[lo:hi]``."""
        value = np.zeros(len(lo), np.int64)
        for bits in self.levels:
            lo1, hi1 = bits.rank(lo), bits.rank(hi)
            zeros = (hi - hi1) - (lo - lo1)
            one = nth >= zeros
            value, nth = value << 1 | one, np.where(one, nth - zeros, nth)
            lo, hi = np.where(one, bits.zeros + lo1, lo - lo1), np.where(one, bits.zeros + hi1, hi - hi1)
        return value


def suffix_groups(words: np.ndarray) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray, np.ndarray]]]:
    """Suffix array of the positions whose pair of words occurs again, and for each dyadic length 2, 4, 8, ... the aligned
    blocks that occur again: their positions and their intervals ``[lo, hi)`` in that array.

    Prefixes are doubled; at each length only groups of equal blocks are sorted further, so the work follows the
    repetitions. ``words`` are numbers from 0, each text ending with one that occurs nowhere else.
    """
    n = len(words)
    pairs = words[:-1].astype(np.int64) * (int(words.max(initial=0)) + 1) + words[1:]
    order = np.argsort(pairs, kind="stable")
    equal = pairs[order][1:] == pairs[order][:-1]
    again = np.zeros(len(order), bool)
    again[1:] |= equal
    again[:-1] |= equal
    array = order[again]  # in groups of equal blocks
    new = np.concatenate([[True], ~equal])[again] if len(array) else np.zeros(0, bool)
    rank = np.full(n, -1, np.int64)  # first place of the position's group in the array
    slots, levels, length = np.arange(len(array)), [], 2
    while len(slots):
        at = array[slots]
        first = np.flatnonzero(new)
        size = np.diff(np.append(first, len(slots)))
        lo = np.repeat(slots[first], size)
        rank[at] = lo
        aligned = at & (length - 1) == 0
        levels.append((at[aligned], lo[aligned], (lo + np.repeat(size, size))[aligned]))
        # The positions of a group are sorted by what follows their block; those that nothing equals drop out.
        follow = at + length
        follow = np.where(follow < n, rank[np.minimum(follow, n - 1)], -1)
        group = np.repeat(np.arange(len(first)), size)
        by = np.lexsort((follow, group))
        array[slots] = at = at[by]
        follow, group = follow[by], group[by]
        same = (follow[1:] == follow[:-1]) & (group[1:] == group[:-1]) & (follow[1:] >= 0)
        stays = np.concatenate([same, [False]]) | np.concatenate([[False], same])
        # A block that occurs once only has no rank at its length: what begins there differs from all else.
        rank[at[~stays]] = -1
        new = np.concatenate([[True], ~same])[stays]
        slots, length = slots[stays], 2 * length
    return array, levels


def equal_ahead(words: np.ndarray, a: int, b: int, most: int) -> int:
    """How many words from ``a`` and from ``b`` on are equal, up to ``most``."""
    most = min(most, len(words) - max(a, b))
    differ = words[a : a + most] != words[b : b + most]
    at = int(differ.argmax()) if most > 0 else 0
    return at if most > 0 and differ[at] else max(most, 0)


def extended(words: np.ndarray, start: np.ndarray, end: np.ndarray, period: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Stretches ``[start, end)`` where each word equals the one ``period`` further on, made as long as they can be."""
    n, start, end = len(words), start.copy(), end.copy()
    open_ = np.arange(len(start))
    for _ in range(DIRECT):  # forwards, all candidates at once
        open_ = open_[(end + period)[open_] < n]
        open_ = open_[words[end[open_]] == words[(end + period)[open_]]]
        if not len(open_):
            break
        end[open_] += 1
    for i in open_:
        step = DIRECT
        while got := equal_ahead(words, int(end[i]), int(end[i] + period[i]), step):
            end[i] += got
            if got < step:
                break
            step *= 2
    open_ = np.arange(len(start))
    for _ in range(DIRECT):  # backwards
        open_ = open_[start[open_] > 0]
        open_ = open_[words[start[open_] - 1] == words[(start + period)[open_] - 1]]
        if not len(open_):
            break
        start[open_] -= 1
    turned = words[::-1] if len(open_) else words
    for i in open_:
        step = DIRECT
        while got := equal_ahead(turned, int(n - start[i] - period[i]), int(n - start[i]), step):
            start[i] -= got
            if got < step:
                break
            step *= 2
    return start, end


def joined(start: np.ndarray, end: np.ndarray, period: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Stretches of one period that overlap or touch, as one."""
    order = np.lexsort((start, period))
    start, end, period = start[order], end[order], period[order]
    if not len(start):
        return start, end, period
    reach = np.maximum.accumulate(end + period * (1 << 40)) - period * (1 << 40)  # the furthest end so far of that period
    first = np.concatenate([[True], (period[1:] != period[:-1]) | (start[1:] > reach[:-1])])
    at = np.flatnonzero(first)
    return start[at], np.maximum.reduceat(end, at), period[at]


def find_runs(words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(start, length, period)`` of all runs, by start, then period.

    A run of period q holds an aligned block of the length 2^k with q <= 2^k <= 2q, and has q words more before or behind
    it; the block's next occurrence there is q words away, since a nearer one would give the run a smaller period. So for
    every block that occurs again, the range successor and predecessor of its position among the occurrences give
    the candidates; neighbouring ones are progressions of one period and are joined, then compared word by word.
    """
    none = np.zeros(0, np.int64)
    if len(words) < LEAST_LENGTH:
        return none, none, none
    array, levels = suffix_groups(words)
    if not len(array):
        return none, none, none
    tree = WaveletTree(array)
    at, lo, hi = (np.concatenate([x[i] for x in levels]) for i in range(3))
    longest = np.repeat([2 << k for k in range(len(levels))], [len(x[0]) for x in levels])
    smaller = tree.below(lo, hi, at)
    found = []
    for side in (1, -1):
        has = smaller + 1 < hi - lo if side > 0 else smaller > 0
        i = np.flatnonzero(has)
        other = tree.smallest(lo[i], hi[i], smaller[i] + side)
        period = np.abs(other - at[i])
        good = (2 * period >= longest[i]) & (period < longest[i])
        i, period = i[good], period[good]
        start = at[i] if side > 0 else at[i] - period
        found.append((start, start + longest[i], period))
    start, end, period = joined(*(np.concatenate(x) for x in zip(*found, strict=True)))
    start, end = extended(words, start, end, period)
    start, end, period = np.unique(np.stack([start, end, period], 1), axis=0).T if len(start) else (none, none, none)
    length = end - start + period
    long = (length >= LEAST_LENGTH) & (length >= LEAST_POWER * period)
    start, length, period = start[long], length[long], period[long]
    least = np.array([not any((words[s : s + p] == words[s + q : s + q + p]).all() for q in parts(p)) for s, p in zip(start.tolist(), period.tolist(), strict=True)], bool)
    return start[least], length[least], period[least]


def parts(period: int) -> list[int]:
    """``period`` divided by each of its prime divisors: if a run has a smaller period, it has one of these too."""
    out, rest, d = [], period, 2
    while d * d <= rest:
        if rest % d == 0:
            out.append(period // d)
            while rest % d == 0:
                rest //= d
        d += 1
    return out + ([period // rest] if rest > 1 else [])


def planted(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """The words of a document as the query takes them: for a tenth of the ids the end becomes periodic."""
    h, n = crc32(str(doc_id).encode()), len(words)
    if doc_id is None or h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    block = words[a : a + 1 + (n - a) // (3 + g % 8)]
    return words[:a] + (block * ((n - a) // len(block) + 1))[: n - a]


def digest(words: list[bytes], start: np.ndarray, length: np.ndarray, period: np.ndarray) -> tuple:
    """A row of COLUMNS for one text and its runs."""
    runs = sorted(zip(start.tolist(), length.tolist(), period.tolist(), strict=True), key=lambda r: (r[0], r[2]))
    listed = "".join(f"{s},{n},{p}\n" for s, n, p in runs)
    best = None
    for r in runs:
        if best is None or r[1] * best[2] > best[1] * r[2]:
            best = r
    kept = words
    if runs:
        depth = np.zeros(len(words) + 1, np.int64)
        np.add.at(depth, start + period, 1)
        np.add.at(depth, start + length, -1)
        kept = [words[i] for i in np.flatnonzero(np.cumsum(depth[:-1]) == 0)]
    top = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (len(runs), *top, sha256(listed.encode()).hexdigest(), sha256(b" ".join(kept)).hexdigest())


def numbered(texts: list[list[bytes]]) -> tuple[np.ndarray, list[int]]:
    """Words of several texts as numbers in one array, equal only within a text; each text ends with a number of its own."""
    values, starts, top, size = [], [], 0, 0
    for words in texts:
        known: dict[bytes, int] = {}
        local = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))
        starts.append(size)
        values += [local + top, np.array([top + len(known)])]
        top, size = top + len(known) + 1, size + len(words) + 1
    return np.concatenate(values), starts


def batch_rows(texts: list[list[bytes]]) -> list[tuple]:
    """``digest`` of every text, searched together."""
    array, starts = numbered(texts)
    start, length, period = find_runs(array)
    cut = np.searchsorted(start, [*starts, len(array)])
    return [digest(words, start[a:b] - s, length[a:b], period[a:b]) for words, s, a, b in zip(texts, starts, cut, cut[1:], strict=False)]


def rows_of(texts: Iterator[list[bytes]]) -> Iterator[tuple]:
    held: list[list[bytes]] = []
    size = 0
    for words in texts:
        if held and size + len(words) > BATCH_WORDS:
            yield from batch_rows(held)
            held, size = [], 0
        held.append(words)
        size += len(words) + 1
    if held:
        yield from batch_rows(held)


def word_runs(docs: DataFrame, plant: bool = False) -> DataFrame:
    """``docs(doc_id, text, ...)`` -> ``(doc_id, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256)``.

    A run is a maximal stretch of words with smallest period q and at least six and 4q words. ``start``, ``length`` and
    ``period`` are of the run with the greatest exponent (ties: first start, smallest period), null without runs; the
    digests are of the list of all runs and of the text without the words that repeat a run's first period. A null or
    empty text has no words; repeated rows get a row each; an empty table gives none; columns but doc_id and text are not
    read. Each text is searched whole, in its own task's memory. With ``plant``, the ends of some texts are made
    periodic first, as decided by doc_id; a null doc_id plants nothing.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0).to_pylist()
            texts = (w if not plant else planted(w, i) for i, w in zip(ids, (t.as_buffer().to_pybytes().split() if t.is_valid else [] for t in b.column(1).cast(pa.binary())), strict=True))
            out = list(zip(*rows_of(texts), strict=True)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(list(c), t) for c, t in zip(out, types, strict=True)]], ["doc_id", *names])

    names = [c.split()[0] for c in COLUMNS.split(", ")]
    types = [pa.string() if c.endswith("string") else pa.int64() for c in COLUMNS.split(", ")]
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text")).mapInArrow(rows, f"doc_id {kind}, {COLUMNS}")


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``word_runs`` of all rows of ``documents``, with runs planted by doc_id."""
    return word_runs(table(spark, sf_dir, "documents"), plant=True)
