"""Token-id files: a concatenated id array with Elias-Fano document boundaries."""

from __future__ import annotations

import os
import re
import struct
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from landgrid.session import ensure_checkpoint_dir, table

END = 0  # id appended to every document
MAGIC, HEAD = b"EFT1", struct.Struct("<4sBBHQQQ")  # magic, id width, low bits, samples' stride, documents, ids, bytes of high bits
STRIDE = 512  # one select sample for so many documents
SEGMENT_IDS, SEGMENT_DOCS = 1 << 19, 1 << 15  # a segment is closed beyond either


class EliasFano:
    """A non-decreasing sequence: low bits stored plainly, high bits in unary, with samples for select."""

    def __init__(self, n: int, low_bits: int, low: bytes, high: bytes, samples: np.ndarray, stride: int = STRIDE):
        self.n, self.low_bits, self.low, self.high, self.samples, self.stride = n, low_bits, low, high, samples, stride

    @classmethod
    def build(cls, values: np.ndarray, stride: int = STRIDE) -> EliasFano:
        values = np.asarray(values, np.uint64)
        n, top = len(values), int(values[-1]) if len(values) else 0
        low_bits = max(0, ((top + 1) // max(n, 1)).bit_length() - 1)
        upper = (values >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        bits = np.zeros(int(upper[-1]) + 1 if n else 0, np.uint8)
        bits[upper] = 1
        lows = (values[:, None] >> np.arange(low_bits, dtype=np.uint64)) & np.uint64(1)
        low = np.packbits(lows.astype(np.uint8).ravel(), bitorder="little").tobytes()
        return cls(n, low_bits, low, np.packbits(bits, bitorder="little").tobytes(), upper[::stride].astype("<u4"), stride)

    def select(self, i: int) -> int:
        """The i-th value, found from the sample before it."""
        at, left = int(self.samples[i // self.stride]), i % self.stride
        while left:  # walk on by blocks of bits
            block = np.unpackbits(np.frombuffer(self.high, np.uint8, count=min(256, len(self.high) - (at + 1) // 8), offset=(at + 1) // 8), bitorder="little")
            block[: (at + 1) % 8] = 0
            ones = np.flatnonzero(block)
            base = (at + 1) // 8 * 8
            if len(ones) >= left:
                at, left = base + int(ones[left - 1]), 0
            else:
                at, left = base + len(block) - 1, left - len(ones)
        value = (at - i) << self.low_bits
        for b in range(self.low_bits):
            bit = i * self.low_bits + b
            value |= (self.low[bit >> 3] >> (bit & 7) & 1) << b
        return value

    def values(self) -> np.ndarray:
        """All values, block by block."""
        return np.concatenate([self.block(b) for b in range(len(self.samples))] or [np.zeros(0, np.int64)])

    def block(self, b: int) -> np.ndarray:
        """Values ``b * stride`` to ``(b + 1) * stride``, selected together: the high bits from one sample to the next are read once."""
        first = b * self.stride
        count = min(self.stride, self.n - first)
        begin = int(self.samples[b])
        stop = int(self.samples[b + 1]) if b + 1 < len(self.samples) else 8 * len(self.high)
        bits = np.unpackbits(np.frombuffer(self.high, np.uint8, (stop + 7) // 8 - begin // 8, begin // 8), bitorder="little")
        upper = np.flatnonzero(bits[begin % 8 :])[:count] + begin
        out = (upper - np.arange(first, first + count)).astype(np.int64) << self.low_bits
        if self.low_bits:
            at = first * self.low_bits
            end = at + count * self.low_bits
            lows = np.unpackbits(np.frombuffer(self.low, np.uint8, (end + 7) // 8 - at // 8, at // 8), bitorder="little")[at % 8 :]
            out |= (lows[: count * self.low_bits].reshape(count, self.low_bits).astype(np.int64) << np.arange(self.low_bits)).sum(axis=1)
        return out


def pack_segment(ids: np.ndarray, ends: np.ndarray) -> bytes:
    """File image of one segment: header, low bits, high bits, select samples, ids. ``ends`` are the documents' ends."""
    ef = EliasFano.build(ends)
    width = 2 if not len(ids) or int(ids.max()) < 1 << 16 else 4
    head = HEAD.pack(MAGIC, width, ef.low_bits, ef.stride, ef.n, len(ids), len(ef.high))
    return b"".join([head, ef.low, ef.high, ef.samples.tobytes(), ids.astype(f"<u{width}").tobytes()])


def open_segment(image: bytes) -> tuple[EliasFano, np.ndarray]:
    """Boundaries and ids of a segment's file image, without copying the ids."""
    magic, width, low_bits, stride, n, total, high_size = HEAD.unpack_from(image)
    if magic != MAGIC:
        raise ValueError("not a token segment")
    low_size, at = (n * low_bits + 7) // 8, HEAD.size
    low, at = image[at : at + low_size], at + low_size
    high, at = image[at : at + high_size], at + high_size
    count = (n + stride - 1) // stride
    samples, at = np.frombuffer(image, "<u4", count, at), at + 4 * count
    return EliasFano(n, low_bits, low, high, samples, stride), np.frombuffer(image, f"<u{width}", total, at)


# Letters, numbers and white space of Latin-1, the classes of the tokenizer's own pattern for texts within it.
LETTER, NUMBER, SPACE = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff", "0-9\xb2\xb3\xb9\xbc-\xbe", "\t\n\x0b\x0c\r \x85\xa0"
UNIT = re.compile(f" ?[{LETTER}]+|'(?:[sdmt]|ll|ve|re)| ?[{NUMBER}]+| ?[^{SPACE}{LETTER}{NUMBER}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
CACHE_UNITS = 1 << 20
LONGEST_KEPT = 64


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary: printable bytes for themselves, others from 256 on."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return {b: chr(b if b in own else next(rest)) for b in range(256)}


class UnitEncoder(dict):
    """Ids of whole texts as little-endian 32-bit integers, by the tokenizers library; keeps the ids of units seen.

    A text within Latin-1 is cut into the units that the tokenizer's pattern makes, and the library's model encodes each
    unit once. Any other text, and one with the string of an added token, is encoded by the library in one piece. The ids
    are the same either way.
    """

    def __init__(self, path: str):
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.added = re.compile("|".join(map(re.escape, added)) if added else "(?!)")  # encoded as their ids, which the library sees to
        self.tokenize, self.letters = self.tokenizer.model.tokenize, byte_letters()

    def __missing__(self, unit: str) -> bytes:
        tokens = self.tokenize(unit.encode().decode("latin-1").translate(self.letters))
        ids = array("I", [t.id for t in tokens]).tobytes()
        if len(unit) <= LONGEST_KEPT:
            if len(self) >= CACHE_UNITS:
                self.clear()
            self[unit] = ids
        return ids

    def __call__(self, text: str | None) -> bytes:
        if not text:
            return b""
        try:
            plain = text.isascii() or bool(text.encode("latin-1"))
        except UnicodeEncodeError:
            plain = False
        if not plain or self.added.search(text):
            return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        return b"".join(map(self.__getitem__, UNIT.findall(text)))


def write_token_files(docs: DataFrame, path: str, tokenizer_path: str) -> None:
    """Write ``docs(doc_id, text, ...)`` as token segments under ``path``.

    Rows are dealt by ranges of doc_id (null first; rows with the same id by a hash of their text), so that segments in the
    order of ``(part, seq)`` hold all documents in ascending order. A segment holds up to about half a million ids, or one
    longer document. A null text counts as empty; every document gets the end id.
    """

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, seq = UnitEncoder(tokenizer_path), TaskContext.get().partitionId(), 0
        ids, names, ends, held = [], [], [], 0

        def close() -> pa.RecordBatch:
            image = pack_segment(np.concatenate(ids), np.array(ends, np.int64))
            columns = [pa.array([part], pa.int32()), pa.array([seq], pa.int64()), pa.array([held], pa.int64()), pa.array([names], pa.list_(pa.int64())), pa.array([image], pa.binary())]
            return pa.RecordBatch.from_arrays(columns, ["part", "seq", "n_ids", "doc_ids", "image"])

        for batch in batches:
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                own = np.append(np.frombuffer(encode(text.as_py()), "<u4"), np.uint32(END))
                ids.append(own)
                names.append(name)
                held += len(own)
                ends.append(held)
                if held >= SEGMENT_IDS or len(names) >= SEGMENT_DOCS:
                    yield close()
                    ids, names, ends, held, seq = [], [], [], 0, seq + 1
        if names:
            yield close()

    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    dealt = docs.select(F.col("doc_id").cast("long"), "text").repartitionByRange(*order).sortWithinPartitions(*order)
    dealt.mapInArrow(segments, "part int, seq long, n_ids long, doc_ids array<bigint>, image binary").write.option("compression", "zstd").parquet(path)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """``(part, seq, doc_id, start, n_tokens, ids_crc32)`` of every document in the segments under ``path``.

    ``start`` counts the ids of all documents before: within the segment from its Elias-Fano boundaries, before it by
    sums over the segments of a part and over the parts.
    """

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part, seq, names, images = (batch.column(i) for i in range(4))
            for i in range(batch.num_rows):
                ef, ids = open_segment(images[i].as_py())
                ends = ef.values()
                starts = np.concatenate([[0], ends[:-1]])
                wide = ids.astype("<u4")
                crcs = [zlib.crc32(wide[a:b]) for a, b in zip(starts, ends, strict=True)]
                own = names[i].values
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(ef.n, part[i].as_py(), np.int32)), pa.array(np.full(ef.n, seq[i].as_py(), np.int64)), own, pa.array(starts), pa.array(ends - starts), pa.array(crcs, pa.int64())],
                    ["part", "seq", "doc_id", "inner", "n_tokens", "ids_crc32"],
                )

    files = spark.read.parquet(path)
    running = lambda w: F.coalesce(F.sum("n_ids").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = files.select("part", "seq", "n_ids")
    parts = sizes.groupBy("part").agg(F.sum("n_ids").alias("n_ids"))
    parts = parts.select("part", running(Window.partitionBy().orderBy("part")).alias("part_start"))
    starts = sizes.withColumn("within", running(Window.partitionBy("part").orderBy("seq"))).join(parts, "part")
    starts = starts.select("part", "seq", (F.col("part_start") + F.col("within")).alias("segment_start"))
    rows = files.select("part", "seq", "doc_ids", "image").mapInArrow(documents, "part int, seq long, doc_id long, inner long, n_tokens long, ids_crc32 long")
    return rows.join(starts, ["part", "seq"]).select("part", "seq", "doc_id", (F.col("segment_start") + F.col("inner")).alias("start"), "n_tokens", "ids_crc32")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new folder name below the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark)}/{name}-{spark.sql('select uuid()').first()[0]}"


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` written as token files and read back; an empty table gives no rows, columns but doc_id and text are not read."""
    import public_tokenizers

    path = shared_path(spark, "tokens")
    write_token_files(table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"))
    return read_token_files(spark, path).select("doc_id", "start", "n_tokens", "ids_crc32")
