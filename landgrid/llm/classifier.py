"""Quality classifier: random Fourier features of a text's statistics, ridge scores from summed normal equations, isotonic calibration."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import ceil, sqrt

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from landgrid.session import cut_lineage, table

#: Kinds of bytes, in the order of BYTE_KINDS; bytes beyond ASCII that begin a character are ``other``.
KINDS = ("upper", "lower", "digit", "stop", "call", "pipe", "symbol", "blank", "other", "inner")
STATISTICS = (
    "log words", "log characters", "word length", "upper share", "digit share", "stop share", "call share", "pipe share", "symbol share", "other share",
    "distinct words", "distinct pairs", "commonest word", "word after itself", "log line length", "repeated lines", "unended lines", "shouted words",
)
THRESHOLD = 0.3
SUMMED = 50_000  # rows that a partition sums, so that the sums of all partitions are small beside the rows


@dataclass(frozen=True)
class Settings:
    """``features`` random features for each of the kernel ``widths`` (times the root of the number of statistics); the width
    and the ``ridges`` (times the number of rows) are chosen by ``folds``; raw scores are calibrated in steps of 1/``steps``."""

    features: int = 256
    widths: tuple[float, ...] = (0.4, 0.8, 1.6)
    ridges: tuple[float, ...] = (1e-6, 1e-5, 1e-4, 1e-3)
    folds: int = 4
    steps: int = 1000
    salts: int = 16
    seed: int = 11


def _kind_of_byte() -> np.ndarray:
    at = {k: i for i, k in enumerate(KINDS)}
    kinds = np.full(256, at["symbol"], np.uint8)
    for b in range(256):
        c = chr(b)
        if b >= 0x80:
            kinds[b] = at["inner"] if b < 0xC0 else at["other"]
        elif c.isalpha():
            kinds[b] = at["upper"] if c.isupper() else at["lower"]
        elif c.isdigit():
            kinds[b] = at["digit"]
        elif c in ".,;:'\"()-":
            kinds[b] = at["stop"]
        elif c in "!?":
            kinds[b] = at["call"]
        elif c == "|":
            kinds[b] = at["pipe"]
        elif b <= 0x20 or b == 0x7F:
            kinds[b] = at["blank"]
    return kinds


BYTE_KINDS = _kind_of_byte()


def statistics(text: str | None) -> list[float]:
    """STATISTICS of a whole text; all 0 for a null text and one without characters."""
    if not text:
        return [0.0] * len(STATISTICS)
    n = dict(zip(KINDS, np.bincount(BYTE_KINDS[np.frombuffer(text.encode(), np.uint8)], minlength=len(KINDS)).tolist(), strict=True))
    words, chars, lines = text.split(), len(text), text.split("\n")
    seen, best = {}, 0
    for w in words:
        seen[w] = seen.get(w, 0) + 1
    best = max(seen.values(), default=0)
    full = [x for x in lines if x.strip()]
    count, shown = max(len(words), 1), max(chars - n["blank"], 1)
    return [
        np.log1p(len(words)), np.log1p(chars), shown / count,
        n["upper"] / max(n["upper"] + n["lower"], 1), n["digit"] / shown, n["stop"] / shown, n["call"] / shown, n["pipe"] / shown, n["symbol"] / shown, n["other"] / shown,
        len(seen) / count, len(set(zip(words, words[1:], strict=False))) / max(len(words) - 1, 1), best / count, sum(map(str.__eq__, words, words[1:])) / count,
        np.log1p(chars / len(lines)), 1 - len(set(full)) / max(len(full), 1), sum(x.rstrip()[-1] not in ".!?" for x in full) / max(len(full), 1), sum(map(str.isupper, words)) / count,
    ]


def with_statistics(docs: DataFrame) -> DataFrame:
    """``docs`` with ``stats array<double>`` in the place of ``text``."""

    @F.pandas_udf("array<double>")
    def of(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in texts:
            yield pd.Series([np.asarray(statistics(t), float) for t in s])

    return docs.withColumn("stats", of("text")).drop("text")


class Features:
    """Random Fourier features of a Gaussian kernel over standardised statistics, after a constant."""

    def __init__(self, mean: np.ndarray, deviation: np.ndarray, width: float, settings: Settings):
        rng = np.random.default_rng(settings.seed)
        self.mean, self.deviation = mean, np.where(deviation > 0, deviation, 1.0)
        self.directions = rng.normal(size=(len(mean), settings.features)) / (width * sqrt(len(mean)))
        self.phases = rng.uniform(0, 2 * np.pi, settings.features)

    def __call__(self, stats: np.ndarray) -> np.ndarray:
        scaled = np.clip((stats - self.mean) / self.deviation, -6, 6)
        return np.column_stack([np.ones(len(stats)), sqrt(2 / len(self.phases)) * np.cos(scaled @ self.directions + self.phases)])


@dataclass(frozen=True)
class Model:
    """``weights`` of the features, and the calibration's points, rising in both; without features every score is ``prior``."""

    features: Features | None
    weights: np.ndarray | None
    raw: np.ndarray
    calibrated: np.ndarray
    prior: float

    def __call__(self, stats: np.ndarray) -> np.ndarray:
        if self.features is None:
            return np.full(len(stats), self.prior)
        return np.interp(self.features(stats) @ self.weights, self.raw, self.calibrated)


def held_out() -> Column:
    """Documents whose labels are kept away from training: crc32 of the id as text leaves remainder 0 by 5."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def isotonic(values: np.ndarray, weights: np.ndarray, means: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rising step function nearest to ``means``, by pooling neighbours that fall; centres and heights of its steps."""
    steps: list[list[float]] = []
    for v, w, m in zip(values.tolist(), weights.tolist(), means.tolist(), strict=True):
        steps.append([v * w, w, m * w])
        while len(steps) > 1 and steps[-2][2] * steps[-1][1] >= steps[-1][2] * steps[-2][1]:
            last = steps.pop()
            steps[-1] = [a + b for a, b in zip(steps[-1], last, strict=True)]
    return np.array([s[0] / s[1] for s in steps]), np.array([s[2] / s[1] for s in steps])


def summed(rows: DataFrame, features: list[Features], folds: int) -> dict[tuple[int, int], np.ndarray]:
    """For each feature set and fold the sum of ``z z'`` over its rows' features z with the label behind them.

    Each partition sums its rows, groups of partitions their sums, and a task for each set and fold the groups' sums, always in
    the order of partitions, so that reruns agree; the driver gets one sum for each.
    """
    sent = rows.sparkSession.sparkContext.broadcast(features)
    size = 2 + len(features[0].phases)
    groups = max(1, ceil(sqrt(rows.rdd.getNumPartitions())))
    schema = "part int, kind int, fold int, sums binary"

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        part, sums = TaskContext.get().partitionId(), {}
        for b in batches:
            stats, label, fold = np.stack(b.stats.to_numpy()) if len(b) else np.zeros((0, len(STATISTICS))), b.label.to_numpy(), b.fold.to_numpy()
            for kind, feature in enumerate(sent.value):
                z = np.column_stack([feature(stats), label])
                for f in range(folds):
                    own = z[fold == f]
                    sums[kind, f] = sums.get((kind, f), np.zeros((size, size))) + own.T @ own
        yield pd.DataFrame([(part, kind, f, s.tobytes()) for (kind, f), s in sums.items()], columns=["part", "kind", "fold", "sums"])

    def total(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("part")
        out = np.zeros(size * size)
        for s in frame.sums:
            out += np.frombuffer(s)
        return frame.head(1).assign(sums=out.tobytes())

    parts = rows.select("stats", "label", "fold").mapInPandas(partial, schema).withColumn("of", F.col("part") % groups)
    grouped = parts.groupBy("of", "kind", "fold").applyInPandas(lambda f: total(f.drop(columns="of")), schema)
    whole = grouped.groupBy("kind", "fold").applyInPandas(total, schema).collect()
    return {(r["kind"], r["fold"]): np.frombuffer(r["sums"]).reshape(size, size) for r in whole}


def solved(sums: np.ndarray, ridge: float) -> np.ndarray:
    """Weights of least squared error with a penalty on all but the constant's."""
    a, b = sums[:-1, :-1], sums[:-1, -1]
    penalty = np.full(len(b), ridge * max(sums[0, 0], 1.0))
    penalty[0] = 1e-9
    return np.linalg.solve(a + np.diag(penalty), b)


def squared_error(sums: np.ndarray, weights: np.ndarray) -> float:
    w = np.append(weights, -1.0)
    return float(w @ sums @ w)


def fit(stats: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> Model:
    """Fit on the rows of ``stats(doc_id, stats)`` that aren't held out and whose id has labels (their mean counts).

    Equal statistics share a fold, so that copies don't vouch for each other. The calibration is fitted on scores by
    models that haven't seen the row's fold. Only sums and at most a few thousand calibration steps reach the driver.
    """
    known = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").where(~held_out()).groupBy("doc_id").agg(F.avg(F.least(F.greatest(F.col("quality"), F.lit(0)), F.lit(1))).alias("label"))
    known = known.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(settings.salts - 1))))
    dealt = stats.where(~held_out()).withColumn("salt", F.pmod(F.monotonically_increasing_id(), F.lit(settings.salts)).cast("int"))
    # Labels grow with the corpus, sixteenfold by salts that the plan's sizes don't show: sorted and merged, never built in the driver for a broadcast.
    rows = dealt.join(known.hint("merge"), ["doc_id", "salt"]).select("stats", "label", F.pmod(F.xxhash64("stats"), F.lit(settings.folds)).cast("int").alias("fold"))
    rows = cut_lineage(rows)
    columns = range(len(STATISTICS))
    shape = rows.agg(F.count("*").alias("n"), F.avg("label").alias("prior"), *[F.avg(F.col("stats")[i]).alias(f"m{i}") for i in columns], *[F.stddev_pop(F.col("stats")[i]).alias(f"d{i}") for i in columns]).first()
    none = np.zeros(0)
    if not shape["n"]:
        return Model(None, None, none, none, 0.5)
    mean, deviation = (np.array([shape[f"{x}{i}"] for i in columns]) for x in "md")
    features = [Features(mean, deviation, w, settings) for w in settings.widths]
    parallel = rows.sparkSession.sparkContext.defaultParallelism
    sums = summed(rows.coalesce(max(parallel, ceil(shape["n"] / SUMMED))), features, settings.folds)
    folds = range(settings.folds)
    whole = [sum(sums[kind, f] for f in folds) for kind in range(len(features))]
    errors = {(kind, r): sum(squared_error(sums[kind, f], solved(whole[kind] - sums[kind, f], r)) for f in folds) for kind in range(len(features)) for r in settings.ridges}
    kind, ridge = min(errors, key=lambda x: (errors[x], x))
    without = np.stack([solved(whole[kind] - sums[kind, f], ridge) for f in folds])
    sent = rows.sparkSession.sparkContext.broadcast((features[kind], without, settings.steps))

    @F.pandas_udf("int")
    def step_of(stats: pd.Series, fold: pd.Series) -> pd.Series:
        feature, weights, steps = sent.value
        raw = (feature(np.stack(stats.to_numpy())) * weights[fold.to_numpy()]).sum(axis=1)
        return pd.Series(np.rint(np.clip(raw, -1, 2) * steps).astype(np.int32))

    counts = rows.withColumn("step", step_of("stats", "fold")).groupBy("step").agg(F.count("*").alias("n"), F.avg("label").alias("mean")).orderBy("step").collect()
    raw, calibrated = isotonic(*(np.array([r[c] for r in counts], float) for c in ("step", "n", "mean")))
    return Model(features[kind], solved(whole[kind], ridge), raw / settings.steps, calibrated, shape["prior"])


def score(stats: DataFrame, model: Model) -> DataFrame:
    """``stats(doc_id, stats)`` -> ``(doc_id, held_out, score, predicted)``."""
    sent = stats.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def of(rows: pd.Series) -> pd.Series:
        return pd.Series(sent.value(np.stack(rows.to_numpy())))

    scored = stats.select("doc_id", held_out().alias("held_out"), of("stats").alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def classify(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """``docs(doc_id, text, ...)``, ``labels(doc_id, quality, ...)`` -> ``(doc_id, held_out, score, predicted)`` for every row of ``docs``.

    Texts become STATISTICS once, in tables without text; fitting and scoring read those. Null and empty texts have
    statistics of 0 and a score like any other; rows with a null id aren't held out and have no label. Repeated rows get the
    same score each, and labels that disagree count by their mean. Without labels all scores are 0.5; an empty table gives
    no rows. Other columns are not read.
    """
    stats = cut_lineage(with_statistics(docs.select("doc_id", "text")))
    return score(stats, fit(stats, labels, settings))


def op11_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``classify`` of all rows of ``documents`` by ``labels``."""
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
