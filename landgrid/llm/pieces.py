"""SentencePiece encoding and decoding with a max-plus parallel scan over the chunks of giant documents."""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Callable, Iterable, Iterator
from itertools import chain, filterfalse, groupby

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from landgrid.session import table

SPACE = "▁"
CHUNK = 1 << 14  # characters; longer texts are split
HALO = 64  # characters of context on either side of a chunk, more than a boundary state and its neighbours can span
SPACED = re.compile(r" *[^ ]+| +")
CACHE_CHARS = 1 << 21
GROUP_CHARS = 1 << 20
NO, YES = -np.inf, 0.0  # max-plus zero and one


class Units(dict):
    """Ids, as bytes, of short stretches of text that nothing merges into or out of; equal stretches are encoded once."""

    def __init__(self, encode: Callable[[list[str]], list[bytes]]):
        self.encode, self.chars = encode, 0

    def learn(self, units: Iterable[str]) -> None:
        """Make sure that all of ``units`` are known until the next call."""
        if self.chars > CACHE_CHARS:
            self.clear()
            self.chars = 0
        new = list(set(filterfalse(self.__contains__, units)))
        if new:
            self.update(zip(new, self.encode(new), strict=True))
            self.chars += sum(map(len, new))


class PieceEncoder:
    """Ids by the sentencepiece library, and texts back from ids.

    Tokens only ever merge into pieces of the vocabulary, so two neighbouring characters that are neighbours in no piece are
    a boundary of every encoding. That holds for a character before a space and for both sides of a newline: texts are cut
    there and equal units are encoded once.
    """

    def __init__(self, path: str):
        import sentencepiece

        self.model = model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        special = [model.is_control(i) or model.is_unknown(i) for i in range(size)]
        pieces = ["" if s else model.id_to_piece(i).replace(SPACE, " ") for i, s in enumerate(special)]
        as_byte = [bytes([int(model.id_to_piece(i)[3:5], 16)]) if model.is_byte(i) else None for i in range(size)]
        self.special = frozenset(i for i, s in enumerate(special) if s)
        self.bytes_of = [p.encode() if b is None else b for p, b in zip(pieces, as_byte, strict=True)]
        self.vocabulary = frozenset(p for p, b in zip(pieces, as_byte, strict=True) if b is None)
        self.longest = max(map(len, self.vocabulary))
        self.neighbours = frozenset(p[i : i + 2] for p in self.vocabulary for i in range(len(p) - 1))
        if any(re.search("[^ ] ", p) or "\n" in p and len(p) > 1 for p in self.vocabulary):
            raise ValueError("the vocabulary has pieces across words or lines")
        self.newline = self.plain("\n")
        self.after_space = Units(lambda words: [self._bytes(ids) if w else self.plain(" ") for w, ids in zip(words, model.encode(words, num_threads=1), strict=True)])
        self.stretches = Units(lambda units: [self._bytes(ids[2:]) for ids in model.encode([f"\n{u}" for u in units], num_threads=1)])
        self.known: dict[str, tuple[int, ...]] = {}

    @staticmethod
    def _bytes(ids: list[int] | tuple[int, ...]) -> bytes:
        return array("I", ids).tobytes()

    def _plain_ids(self, text: str) -> list[int]:
        """Ids of ``text`` without the library's prefix: nothing merges with a newline."""
        return self.model.encode("\n" + text)[2:] if text else []

    def plain(self, text: str) -> bytes:
        return self._bytes(self._plain_ids(text))

    def all_stretches(self, texts: list[str]) -> list[bytes]:
        """Ids of every text as it stands inside a longer one, between two boundaries."""
        cut: list[list[tuple[list[str], list[str]]]] = []  # by text and line: stretches, then words that follow a space
        for text in texts:
            lines = text.split("\n")
            cut.append([(SPACED.findall(line), []) if "  " in line else ((words := line.split(" "))[:1], words[1:]) for line in lines])
        self.stretches.learn(u for lines in cut for units, _ in lines for u in units)
        self.after_space.learn(chain.from_iterable(words for lines in cut for _, words in lines))
        plain, spaced = self.stretches.__getitem__, self.after_space.__getitem__
        return [self.newline.join(b"".join([*map(plain, units), *map(spaced, words)]) for units, words in lines) for lines in cut]

    def texts(self, texts: Iterable[str | None]) -> Iterator[bytes]:
        """Ids of every whole text; some texts at a time are cut into units, and their new units encoded together."""
        group, chars = [], 0
        for text in texts:
            group.append(" " + text.replace(SPACE, " ") if text else "")
            chars += len(group[-1])
            if chars >= GROUP_CHARS:
                yield from self.all_stretches(group)
                group, chars = [], 0
        yield from self.all_stretches(group)

    def decode(self, ids: bytes) -> str:
        """The text of ``ids`` (little-endian 32-bit integers), as the library decodes it."""
        numbers = np.frombuffer(ids, "<u4").tolist()
        if self.special.isdisjoint(numbers):
            out = b"".join(map(self.bytes_of.__getitem__, numbers))
            try:
                return (out[1:] if out[:1] == b" " else out).decode()
            except UnicodeDecodeError:
                pass
        return self.model.decode(numbers)

    def raw(self, text: str) -> tuple[int, ...]:
        """As ``plain``, remembered."""
        found = self.known.get(text)
        if found is None:
            if len(self.known) > 1 << 16:
                self.known = {}
            found = self.known[text] = tuple(self._plain_ids(text))
        return found

    def is_token(self, text: str) -> bool:
        return len(text) == 1 or text in self.vocabulary and len(self.raw(text)) == 1

    def compatible(self, a: str, b: str) -> bool:
        """Whether b may follow a: both stay whole when encoded together. An encoding is the only path of such steps."""
        return not a or a[-1] + b[0] not in self.neighbours or self.raw(a + b) == self.raw(a) + self.raw(b)

    def is_boundary(self, text: str, at: int) -> bool:
        return 0 < at < len(text) and text[at - 1 : at + 1] not in self.neighbours


def cut_states(encoder: PieceEncoder, text: str, at: int) -> list[tuple[int, int]]:
    """Boundary states at position ``at``: the spans (start, end) of the tokens that may hold the character before it."""
    return [
        (a, b)
        for a in range(max(0, at - encoder.longest), at)
        for b in range(at, min(len(text), a + encoder.longest) + 1)
        if encoder.is_token(text[a:b])
    ]


def reach(encoder: PieceEncoder, text: str, first: tuple[int, int], to: int) -> dict[tuple[int, int], tuple[int, int] | None]:
    """All tokens that chains of compatible tokens from ``first`` come to and that start before ``to``, each with the one before it."""
    back: dict[tuple[int, int], tuple[int, int] | None] = {first: None}
    todo = [first]
    while todo:
        a, b = todo.pop()
        if b >= to:
            continue
        for e in range(b + 1, min(len(text), b + encoder.longest) + 1):
            if (b, e) not in back and encoder.is_token(text[b:e]) and encoder.compatible(text[a:b], text[b:e]):
                back[b, e] = (a, b)
                todo.append((b, e))
    return back


def reach_all(encoder: PieceEncoder, text: str, firsts: list[tuple[int, int]], to: int) -> dict[tuple[int, int], int]:
    """All tokens that chains from any of ``firsts`` come to and that start before ``to``, each with the set of those firsts as bits."""
    masks = {state: 1 << i for i, state in enumerate(firsts)}
    ending: dict[int, list[tuple[int, int]]] = {}
    for state in firsts:
        ending.setdefault(state[1], []).append(state)
    for b in range(min(ending, default=to), to):
        before = ending.pop(b, [])
        for e in range(b + 1, min(len(text), b + encoder.longest) + 1) if before else ():
            token = text[b:e]
            if encoder.is_token(token):
                mask = 0
                for a in before:
                    if encoder.compatible(text[a[0] : b], token):
                        mask |= masks[a]
                if mask:
                    masks[b, e] = masks.get((b, e), 0) | mask
                    ending.setdefault(e, []).append((b, e))
    return masks


def resets(encoder: PieceEncoder, text: str, begin: int, end: int) -> tuple[int, int]:
    """The first and last position in [begin, end) that is a boundary of every encoding, or (-1, -1)."""
    first = next((i for i in range(max(begin, 1), end) if encoder.is_boundary(text, i)), -1)
    return (first, next(i for i in range(end - 1, 0, -1) if encoder.is_boundary(text, i))) if first >= 0 else (-1, -1)


def transfer(encoder: PieceEncoder, text: str, begin: int, end: int) -> tuple[list, list, np.ndarray]:
    """States at both ends of chunk [begin, end) of ``text`` (which has context around it) and the max-plus matrix between them.

    The text's own start is the single state (begin, begin). Where the chunk has a boundary of every encoding, the matrix is
    an outer sum of what leads to the first such place and what leads on from the last.
    """
    left = [(0, 0)] if begin == 0 else cut_states(encoder, text, begin)
    right = cut_states(encoder, text, end)
    first, last = resets(encoder, text, begin, end)
    if first < 0:
        reached = reach_all(encoder, text, left, end)
        return left, right, np.array([[YES if reached.get(r, 0) >> i & 1 else NO for r in right] for i in range(len(left))])
    ins = [YES if any(b == first for _, b in reach(encoder, text, s, first)) else NO for s in left]
    chain = reach(encoder, text, (last, last), end)
    outs = [YES if r in chain else NO for r in right]
    return left, right, np.add.outer(ins, outs)


def compose(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Max-plus product, which is associative."""
    return (a[:, :, None] + b[None, :, :]).max(axis=1)


def entries(matrices: list[np.ndarray], final: int) -> list[int]:
    """The state at the end of each chunk, given that of the last: prefixes are combined pairwise, then read from the back."""

    def prefix(ms: list[np.ndarray]) -> list[np.ndarray]:
        if len(ms) == 1:
            return ms
        pairs = prefix([compose(ms[i], ms[i + 1]) for i in range(0, len(ms) - 1, 2)] + ([ms[-1]] if len(ms) % 2 else []))
        out = [ms[0]]
        for i in range(1, len(ms)):
            out.append(pairs[i // 2] if i % 2 else pairs[-1] if i == len(ms) - 1 else compose(pairs[i // 2 - 1], ms[i]))
        return out

    heads, states = prefix(matrices), [final]
    for k in range(len(matrices) - 1, 0, -1):
        states.append(int((heads[k - 1][0] + matrices[k][:, states[-1]]).argmax()))
    return states[::-1]


def backtrace(encoder: PieceEncoder, text: str, begin: int, end: int, state: tuple[int, int], goal: tuple[int, int]) -> bytes:
    """Ids of the tokens that start in [begin, end), on the path from ``state`` to ``goal``."""

    def walk(chain: dict, at: tuple[int, int]) -> bytes:
        ids: list[tuple[int, ...]] = []
        while at is not None and chain[at] is not None:
            ids.append(encoder.raw(text[at[0] : at[1]]))
            at = chain[at]
        return np.array([i for t in reversed(ids) for i in t], "<u4").tobytes()

    first, last = resets(encoder, text, begin, end)
    if first < 0:
        return walk(reach(encoder, text, state, end), goal)
    chain = reach(encoder, text, state, first)
    head = walk(chain, next(t for t in chain if t[1] == first))
    return head + encoder.all_stretches([text[first:last]])[0] + walk(reach(encoder, text, (last, last), end), goal)


KEY = ["h", "c", "n"]


def text_key() -> list[Column]:
    """What tells texts apart: 96 bits of hashes and the length."""
    return [F.xxhash64("text").alias("h"), F.crc32(F.encode("text", "UTF-8")).alias("c"), F.length("text").alias("n")]


def is_giant(chunk: int) -> Column:
    return F.coalesce(F.length("text") > chunk, F.lit(False))


def giant_parts(docs: DataFrame, model_path: str, chunk: int) -> DataFrame:
    """``(key, k, part)``: the ids of chunk ``k`` of every distinct text of ``docs(text)`` above ``chunk`` characters, by the parallel scan.

    Every chunk, in a row of its own, yields the matrix of its boundary states; the small matrices of a text are combined
    associatively; every chunk is then traced back by itself. Chunks are dealt over all partitions.
    """

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """One pass over each text: every chunk with its context."""
        for f in frames:
            for h, c, n, body in zip(f.h, f.c, f.n, f.body, strict=True):
                for first in range(0, len(body), chunk * 64):
                    at = range(first, min(len(body), first + chunk * 64), chunk)
                    yield pd.DataFrame({
                        "h": h, "c": c, "n": n, "k": [a // chunk for a in at],
                        "body": [body[max(a - HALO, 0) : a + chunk + HALO] for a in at],
                        "begin": [min(a, HALO) for a in at],
                        "end": [min(a, HALO) + min(chunk, len(body) - a) for a in at],
                    })

    def matrices(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = PieceEncoder(model_path)
        for f in frames:
            rows = [transfer(encoder, t, b, e) for t, b, e in zip(f.body, f.begin, f.end, strict=True)]
            shift = [(k * chunk - b) for k, b in zip(f.k, f.begin, strict=True)]
            yield pd.DataFrame({
                "h": f.h, "c": f.c, "n": f.n, "k": f.k,
                "lefts": [[x + d for a in r[0] for x in a] for r, d in zip(rows, shift, strict=True)],
                "rights": [[x + d for a in r[1] for x in a] for r, d in zip(rows, shift, strict=True)],
                "cells": [(r[2] == YES).ravel().tolist() for r in rows],
            })

    def combine(rows: list[tuple]) -> pd.DataFrame:
        """The states before and after every chunk of one text, whose rows come in the order of the chunks."""
        pairs = lambda flat: list(zip(flat[::2], flat[1::2], strict=True))
        lefts, rights = [pairs(r[4]) for r in rows], [pairs(r[5]) for r in rows]
        found = [np.where(np.array(r[6], bool).reshape(len(a), len(b)), YES, NO) for r, a, b in zip(rows, lefts, rights, strict=True)]
        total = max(b for _, b in rights[-1])
        whole = found[0]
        for m in found[1:]:
            whole = compose(whole, m)
        final = next((i for i, (_, b) in enumerate(rights[-1]) if b == total and whole[0, i] == YES), None)
        if final is None:
            raise ValueError("no chain of pieces covers the text: the model is not a BPE model of pairwise compatible pieces")
        goals = [rights[k][i] for k, i in enumerate(entries(found, final))]
        before = [lefts[0][0], *goals[:-1]]
        return pd.DataFrame([(*r[:4], *s, *g) for r, s, g in zip(rows, before, goals, strict=True)], columns=[*KEY, "k", "a", "b", "x", "y"])

    def traced(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = PieceEncoder(model_path)
        for f in frames:
            ids = []
            for r in f.itertuples():
                d = r.begin - r.k * chunk
                ids.append(backtrace(encoder, r.body, r.begin, r.end, (r.a + d, r.b + d), (r.x + d, r.y + d)))
            yield pd.DataFrame({"h": f.h, "c": f.c, "n": f.n, "k": f.k, "part": ids})

    body = F.concat(F.lit(" "), F.translate("text", SPACE, " ")).alias("body")
    long_texts = docs.where(is_giant(chunk)).select(*text_key(), body).dropDuplicates(KEY)
    kind = "h bigint, c bigint, n int, k int"
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pieces = long_texts.mapInPandas(cut, f"{kind}, body string, begin int, end int").repartition(parts, *KEY, "k")
    states = pieces.mapInPandas(matrices, f"{kind}, lefts array<bigint>, rights array<bigint>, cells array<boolean>")
    path = by_text(states, combine, f"{kind}, a bigint, b bigint, x bigint, y bigint")
    return pieces.join(path, [*KEY, "k"]).mapInPandas(traced, f"{kind}, part binary")


def by_text(chunks: DataFrame, finish: Callable[[list[tuple]], pd.DataFrame], schema: str) -> DataFrame:
    """``finish`` of the rows of every text, which starts with (h, c, n, k), in the order of their chunks; a text at a time is held."""

    def streamed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = (r for f in frames for r in f.itertuples(index=False, name=None))
        done: list[pd.DataFrame] = []
        for _, group in groupby(rows, key=lambda r: r[:3]):
            done.append(finish(list(group)))
            if len(done) == 256:
                yield pd.concat(done)
                done = []
        if done:
            yield pd.concat(done)

    parts = int(chunks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return chunks.repartition(parts, *KEY).sortWithinPartitions(*KEY, "k").mapInPandas(streamed, schema)


def giant_ids(docs: DataFrame, model_path: str, chunk: int) -> DataFrame:
    """``(h, c, n, ids)`` of every distinct text of ``docs(text)`` above ``chunk`` characters."""

    def joined(rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame([(*rows[0][:3], b"".join(r[4] for r in rows))], columns=[*KEY, "ids"])

    return by_text(giant_parts(docs, model_path, chunk), joined, "h bigint, c bigint, n int, ids binary")


def encode_documents(docs: DataFrame, model_path: str, chunk: int = CHUNK) -> DataFrame:
    """``docs(text, ...)`` with a column ``ids``: the library's ids of the whole text as little-endian 32-bit integers.

    Texts of up to ``chunk`` characters are encoded in their rows, longer ones by the parallel scan over their chunks.
    Null and empty texts have no ids. An existing column ``ids`` is replaced.
    """
    docs = docs.drop("ids")

    @F.pandas_udf("binary")
    def short(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = PieceEncoder(model_path)
        for s in texts:
            yield pd.Series(list(encoder.texts(s)), dtype=object)

    row = F.struct(*docs.columns).alias("row")
    few = docs.where(~is_giant(chunk)).select(row, F.coalesce(short("text"), F.lit(b"")).alias("ids"))
    many = docs.where(is_giant(chunk)).select(row, *text_key()).join(giant_ids(docs, model_path, chunk), KEY).select("row", "ids")
    return few.union(many).select("row.*", "ids")


def decode_documents(encoded: DataFrame, model_path: str) -> DataFrame:
    """``encoded(ids, ...)`` with a column ``decoded``: the text of the ids. Null ids give null."""

    @F.pandas_udf("string")
    def decode(ids: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = PieceEncoder(model_path)
        for s in ids:
            yield s.map(lambda x: None if x is None else encoder.decode(x), na_action=None)

    return encoded.withColumn("decoded", decode("ids"))


def encode_digest(docs: DataFrame, model_path: str, chunk: int = CHUNK) -> DataFrame:
    """``docs(doc_id, text, ...)`` -> ``(doc_id, n_tokens, ids_crc32, decoded_crc32, exact)``: what encoding and decoding gives for every row.

    The same encoding as ``encode_documents``; ids are decoded where they are made and only digests leave the task. ``exact``
    says whether decoding gives the text back (a null text counts as empty; U+2581 comes back as a space). A giant text's
    decoded form is compared by length, xxhash64 and crc32, so its copies need not be carried along. Repeated rows are
    repeated, an empty table gives no rows, other columns of ``docs`` are not read.
    """
    columns = ["n_tokens", "ids_crc32", "decoded_crc32", "exact"]

    @F.pandas_udf("n_tokens long, ids_crc32 long, decoded_crc32 long, exact boolean")
    def of_texts(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        encoder = PieceEncoder(model_path)

        def digest(text: str | None, ids: bytes) -> tuple:
            decoded = encoder.decode(ids)
            return len(ids) // 4, zlib.crc32(ids), zlib.crc32(decoded.encode()), decoded == (text or "")

        for s in texts:
            yield pd.DataFrame(list(map(digest, s, encoder.texts(s))), columns=columns)

    def of_parts() -> Callable[[list[tuple]], pd.DataFrame]:
        encoders: list[PieceEncoder] = []  # made by the first text of a task

        def digest(rows: list[tuple]) -> pd.DataFrame:
            if not encoders:
                encoders.append(PieceEncoder(model_path))
            (h, c, n), ids = rows[0][:3], b"".join(r[4] for r in rows)
            decoded = encoders[0].decode(ids)
            coded = decoded.encode()
            crc, whole = zlib.crc32(coded), np.uint64(xxhash.xxh64_intdigest(coded, seed=42)).view(np.int64)
            return pd.DataFrame([(h, c, n, len(ids) // 4, zlib.crc32(ids), crc, (h, c, n) == (whole, crc, len(decoded)))], columns=[*KEY, *columns])

        return digest

    few = docs.where(~is_giant(chunk)).select("doc_id", of_texts("text").alias("d")).select("doc_id", "d.*")
    schema = "h bigint, c bigint, n int, n_tokens long, ids_crc32 long, decoded_crc32 long, exact boolean"
    giants = by_text(giant_parts(docs, model_path, chunk), of_parts(), schema)
    return few.union(docs.where(is_giant(chunk)).select("doc_id", *text_key()).join(giants, KEY).select("doc_id", *columns))


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``encode_digest`` of every row of ``documents`` with the public 32k piece model."""
    import public_tokenizers

    return encode_digest(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
