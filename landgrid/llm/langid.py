"""Language identification by word-first backoff."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from landgrid.llm.keys import document_key, keep_keys
from landgrid.session import cut_lineage, table

UNDETERMINED = "und"
WORD = re.compile(r"[^\W\d_]+")
KEPT_TOKENS = 1 << 18  # tokens whose scores a worker remembers
GROUP_TOKENS = 1 << 18  # tokens scored at a time
SLICE = 1 << 20  # characters of a text cut into tokens at a time
PRIME = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Limits:
    """Bounds of the fitted model, so that it can be sent to every task.

    About ``sample_docs`` labelled documents, chosen by a hash of their id, are counted. Words, and character n-grams of
    orders up to ``longest``, that the sample holds at least ``least`` times in all languages together make up the model.
    All documents are predicted.
    """

    sample_docs: int = 30_000
    least: int = 5
    longest: int = 5


def gram_hashes(points: np.ndarray, order: int) -> np.ndarray:
    """A 64-bit hash of the ``order`` code points from every place of ``points`` on (uint64)."""
    out = np.zeros(max(len(points) - order + 1, 0), np.uint64)
    for i in range(order):
        out = (out + points[i : len(points) - order + 1 + i]) * PRIME
        out ^= out >> np.uint64(29)
    return out


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)


class Model:
    """Per-language log frequencies of words and of character n-grams of padded words.

    A known word scores its smoothed log frequency in each language. An unseen word falls back to its n-grams of the
    longest order of which any is known, with their mean log frequency. Either is normalised over the languages.
    """

    def __init__(self, langs: list[str], rows: pa.Table, totals: dict[tuple[int, str], tuple[int, int]], prior: str):
        """``rows(order, unit, lang, n)``, order 0 for words; ``totals``: count and kinds of units by order and language."""
        self.langs, self.prior = langs, prior
        self.words: dict[str, int] = {}
        self.word_scores = np.zeros((0, len(langs)), np.float32)
        self.grams: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        column = np.asarray(rows.column("order"))
        for order in sorted(set(column.tolist()), reverse=True):
            of = rows.filter(pa.array(column == order)).combine_chunks()
            units = of.column("unit").combine_chunks().dictionary_encode()
            lang = pc.index_in(of.column("lang"), value_set=pa.array(langs))
            counts = np.zeros((len(units.dictionary), len(langs)), np.float32)
            counts[np.asarray(units.indices), np.asarray(lang)] = np.asarray(of.column("n"))
            names, scores = units.dictionary.to_pylist(), self._scores(order, counts, totals)
            if order:
                hashes = gram_hashes(code_points("".join(names)), order)[::order]
                place = np.argsort(hashes)
                self.grams[order] = hashes[place], scores[place]
            else:
                self.words, self.word_scores = {w: i for i, w in enumerate(names)}, scores

    def _scores(self, order: int, counts: np.ndarray, totals: dict[tuple[int, str], tuple[int, int]]) -> np.ndarray:
        size = np.array([totals.get((order, l), (0, 0))[0] for l in self.langs]) + 0.5 * max(totals.get((order, l), (0, 1))[1] for l in self.langs)
        return self._normal(np.log((counts + 0.5) / size))

    @staticmethod
    def _normal(scores: np.ndarray) -> np.ndarray:
        low = scores - scores.max(axis=-1, keepdims=True)
        return (low - np.log(np.exp(low).sum(axis=-1, keepdims=True))).astype(np.float32)

    def score_words(self, words: list[str]) -> np.ndarray:
        """A row of scores for every lower-case word; zeros if nothing of it is known."""
        out = np.zeros((len(words), len(self.langs)), np.float32)
        index = np.fromiter((self.words.get(w, -1) for w in words), np.int64, len(words))
        known = index >= 0
        out[known] = self.word_scores[index[known]]
        todo = np.flatnonzero(~known)
        for order, (hashes, scores) in self.grams.items():
            if not len(todo):
                break
            padded = [f" {words[i]} " for i in todo]
            points = code_points("".join(padded))
            owner = np.repeat(np.arange(len(todo)), np.fromiter(map(len, padded), np.int64, len(padded)))
            inside = np.flatnonzero(owner[: len(points) - order + 1] == owner[order - 1 :])
            wanted = gram_hashes(points, order)[inside]
            spot = np.minimum(np.searchsorted(hashes, wanted), len(hashes) - 1)
            hit = hashes[spot] == wanted
            of, spot = owner[inside[hit]], spot[hit]
            if len(of):
                first = np.flatnonzero(np.diff(of, prepend=-1))
                mean = np.add.reduceat(scores[spot], first) / np.diff(np.append(first, len(of)))[:, None]
                found = of[first]
                out[todo[found]] = self._normal(mean)
                todo = np.delete(todo, found)
        return out


class Tokens(dict):
    """Row number of every token seen; tokens not seen before get the next number and are noted in ``new``."""

    def __init__(self) -> None:
        self.new: list[str] = []

    def __missing__(self, token: str) -> int:
        self[token] = at = len(self)
        self.new.append(token)
        return at


def token_lists(text: str) -> Iterator[list[str]]:
    """The lower-case tokens between the white space of ``text``, slice by slice; a slice ends at white space."""
    if len(text) <= SLICE:
        yield text.lower().split()
        return
    start = 0
    while start < len(text):
        gap = re.compile(r"\s").search(text, start + SLICE)
        end = gap.start() if gap else len(text)
        yield text[start:end].lower().split()
        start = end


class Predictor:
    """Predicts batches of whole texts. Equal tokens are scored once and remembered."""

    def __init__(self, model: Model):
        self.model = model
        self.forget()

    def forget(self) -> None:
        self.at = Tokens()
        self.rows = np.zeros((0, len(self.model.langs)), np.float32)
        self.letters = np.zeros((0, 2), bool)  # whether a token has a letter, and whether anything of it is known

    def _score_new(self) -> None:
        """Scores of the tokens that are new: sums over their words, the runs of letters in them."""
        new, self.at.new = self.at.new, []
        if not new:
            return
        runs = [WORD.findall(t) for t in new]
        sizes = np.fromiter(map(len, runs), np.int64, len(runs))
        distinct = {w: i for i, w in enumerate(dict.fromkeys(chain.from_iterable(runs)))}
        scored = self.model.score_words(list(distinct))
        rows = np.zeros((len(new), len(self.model.langs)), np.float32)
        each = np.fromiter((distinct[w] for r in runs for w in r), np.int64, int(sizes.sum()))
        np.add.at(rows, np.repeat(np.arange(len(new)), sizes), scored[each])
        alpha = np.fromiter((any(map(str.isalpha, chain.from_iterable(r))) for r in runs), bool, len(runs))
        self.rows = np.concatenate([self.rows, rows])
        self.letters = np.concatenate([self.letters, np.column_stack([alpha, rows.any(axis=1)])])

    def __call__(self, texts: list[str | None]) -> list[tuple[str, float]]:
        total = np.zeros((len(texts), len(self.model.langs)))
        seen = np.zeros((len(texts), 2), bool)
        index: list[np.ndarray] = []
        owner: list[int] = []
        held = 0

        def add() -> None:
            nonlocal held
            self._score_new()
            starts = np.cumsum([0, *map(len, index[:-1])])
            flat = np.concatenate(index)
            np.add.at(total, owner, np.add.reduceat(self.rows[flat], starts, dtype=np.float64))
            np.logical_or.at(seen, owner, np.logical_or.reduceat(self.letters[flat], starts))
            index.clear()
            owner.clear()
            held = 0
            if len(self.at) > KEPT_TOKENS:
                self.forget()

        if self.model.langs:
            for i, text in enumerate(texts):
                for tokens in token_lists(text) if text else ():
                    if tokens:
                        index.append(np.fromiter(map(self.at.__getitem__, tokens), np.int64, len(tokens)))
                        owner.append(i)
                        held += len(tokens)
                        if held >= GROUP_TOKENS:
                            add()
            if index:
                add()
        return [self._verdict(t, *s) for t, s in zip(total, seen, strict=True)]

    def _verdict(self, total: np.ndarray, has_letter: bool, known: bool) -> tuple[str, float]:
        if not has_letter:
            return UNDETERMINED, 0.0
        if not known:
            return self.model.prior, 1.0 / len(self.model.langs)
        best = int(total.argmax())
        return self.model.langs[best], float(1.0 / np.exp(total - total[best]).sum())


def held_out() -> Column:
    """Documents kept away from training: crc32 of the id as text leaves remainder 2 by 4."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, limits: Limits = Limits()) -> Model:
    """Fit on documents with text and lang that are not held out. Counting is distributed; only the bounded model is collected."""
    labelled = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out()).select("doc_id", "lang", "text")
    eligible = labelled.count()
    share = min(1.0, limits.sample_docs / max(eligible, 1))
    draw = F.pmod(F.xxhash64(F.lit("langid"), "doc_id", "text"), F.lit(1_000_000))
    sample = labelled.where(draw < int(share * 1_000_000))
    words = cut_lineage(
        sample.select("lang", F.explode(F.expr("regexp_extract_all(lower(text), '\\\\p{L}+', 0)")).alias("unit"))
        .groupBy("lang", "unit").agg(F.count("*").alias("n"))
    )
    pad = F.concat(F.lit(" "), "unit", F.lit(" "))
    grams = words.select("lang", pad.alias("unit"), "n", F.explode(F.sequence(F.lit(1), F.lit(limits.longest))).alias("order"))
    grams = (
        grams.where(F.length("unit") >= F.col("order"))
        .select("order", "lang", F.explode(F.expr("transform(sequence(1, length(unit) - order + 1), i -> substr(unit, i, order))")).alias("unit"), "n")
        .groupBy("order", "lang", "unit").agg(F.sum("n").alias("n"))
    )
    units = cut_lineage(words.select(F.lit(0).alias("order"), "lang", "unit", "n").unionByName(grams.select("order", "lang", "unit", "n")))
    totals = {(r["order"], r["lang"]): (r["total"], r["kinds"]) for r in units.groupBy("order", "lang").agg(F.sum("n").alias("total"), F.count("*").alias("kinds")).collect()}
    chosen = units.groupBy("order", "unit").agg(F.sum("n").alias("all")).where(F.col("all") >= limits.least).select("order", "unit")
    rows = units.join(chosen, ["order", "unit"]).select("order", "unit", "lang", "n").toArrow()
    langs = sorted({l for _, l in totals})
    prior = max(langs, key=lambda l: (totals.get((0, l), (0, 0))[0], l), default=UNDETERMINED)
    return Model(langs, rows, totals, prior)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """Add ``lang_pred`` and ``score`` to every row of ``docs`` from its whole text.

    A null text and a text without letters are ``und`` with score 0. Letters of which nothing is known give the most
    frequent language with the score of a blind guess. Languages with equal scores: the first by code point. Repeated rows
    get the same prediction each; an empty table gives none, and without labelled rows all is ``und``. Existing columns of
    those names are replaced, other columns of ``docs`` stay.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang string, score double")
    def lang_of(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        predictor = Predictor(sent.value)
        for s in texts:
            yield pd.DataFrame(predictor(s.tolist()), columns=["lang", "score"])

    base = docs.drop("lang_pred", "score")
    out = base.withColumn("__lang", lang_of("text"))
    return out.select(*[out[c] for c in base.columns], F.col("__lang.lang").alias("lang_pred"), F.col("__lang.score").alias("score"))


def keep_identified(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """Rows of ``docs`` whose language is found with at least ``least`` of the weight; ``und`` goes. Columns stay as they are.

    Decisions are made on the text alone and joined back, so that Python tasks don't carry whole rows.
    """
    found = predict(docs.select("text", *document_key()), fit(docs))
    return keep_keys(docs, cut_lineage(found.where((F.col("lang_pred") != UNDETERMINED) & (F.col("score") >= least)).select("k1", "k2")))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every row of ``documents``: ``predict`` with the model that ``fit`` makes of the same table."""
    docs = table(spark, sf_dir, "documents")
    return predict(docs, fit(docs)).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
