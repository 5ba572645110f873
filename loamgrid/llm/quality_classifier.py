"""Quality classifier: random Fourier features, ridge by partition-summed normal equations, isotonic calibration.

Statistics of a whole text are standardised and mapped to ``WAVES`` cosines of random projections,
whose products approximate a Gaussian kernel. Every partition sums its normal equations per fold;
the sums are added up a tree and solved on the driver, whose share has a fixed size. Leaving a fold
out of the sums gives out-of-fold scores for free: on those, counted in fixed bins, pool-adjacent-
violators fits the calibration. All labelled rows are used, however many there are.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import settle

WAVES, RIDGE, SEED = 128, 1e-3, 11
FOLDS = 5
BINS = 1024
THRESHOLD = 0.3
_FAN_IN = 16
FEATURES = (
    "log_words", "word_bytes", "word_spread", "upper", "digit", "symbol", "exclamation", "bar", "other_punctuation",
    "distinct_words", "distinct_threes", "duplicate_lines", "log_line_bytes", "outside_ascii", "control",
)
_P = len(FEATURES)
_SYMBOL = list(b"#*$%&<>")
_OTHER = list(b".,;:?'\"()[]{}-_/\\@^`~+=")


def text_features(text: bytes) -> list[float]:
    """Statistics of a whole text given as UTF-8 bytes; all zero without words."""
    words = text.split()
    if not words:
        return [0.0] * _P
    n, size = len(words), len(text)
    byte = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    length = np.fromiter(map(len, words), np.int64, n)
    solid = int(length.sum())
    threes = n - 2
    lines = [x for x in text.split(b"\n") if x]
    share = lambda codes: float(byte[codes].sum()) / solid
    return [
        float(np.log1p(n)),
        float(np.log(solid / n)),
        float(length.std()) / (solid / n),
        share(slice(65, 91)),
        share(slice(48, 58)),
        share(_SYMBOL),
        share([33]),
        share([124]),
        share(_OTHER),
        len(set(words)) / n**0.8,
        len(set(zip(words, words[1:], words[2:]))) / threes if threes > 0 else 1.0,
        1 - len(set(lines)) / len(lines) if lines else 0.0,
        float(np.log1p(size / (len(lines) or 1))),
        share(slice(128, 256)),
        float(byte[0:9].sum() + byte[14:32].sum() + byte[127]) / size,
    ]


def features(text_col: str) -> Column:
    def run(text: pd.Series) -> pd.Series:
        return pd.Series([text_features(t.encode() if t else b"") for t in text], dtype=object)

    return F.pandas_udf(run, T.ArrayType(T.DoubleType()))(text_col)


def fold(doc_id: str) -> Column:
    """crc32 of the id as text, modulo the folds; fold 0 is held out. A null id counts as empty text."""
    return (F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % FOLDS).cast("int")


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    w: np.ndarray
    shift: np.ndarray
    beta: np.ndarray
    knots: np.ndarray
    values: np.ndarray

    def waves(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        return np.hstack([np.sqrt(2 / WAVES) * np.cos(z @ self.w + self.shift), np.ones((len(x), 1))])

    def score(self, x: np.ndarray) -> np.ndarray:
        """Calibrated probability; a thousandth of the raw score orders what one step of it joins."""
        if not len(x):
            return np.zeros(0)
        raw = self.waves(x) @ self.beta
        return np.clip(0.999 * np.interp(raw, self.knots, self.values) + 0.001 / (1 + np.exp(-4 * (raw - 0.5))), 0.0, 1.0)


def _matrix(column: pa.ListArray) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, _P)


def _summed(partials: DataFrame, size: int) -> np.ndarray:
    """The sum of binary rows of ``size`` doubles, added up a tree of tasks."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for x in batch.column(0):
                own = np.frombuffer(x.as_buffer(), np.float64)
                total = own.copy() if total is None else total + own
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["sums"])

    partials = settle(partials, "normal-equations")
    left = partials.count()
    while left > _FAN_IN:
        left = -(-left // _FAN_IN)
        partials = settle(partials.repartition(left).mapInArrow(add, "sums binary"), "normal-equations")
    rows = partials.collect()  # at most _FAN_IN of a fixed size
    return sum((np.frombuffer(r.sums, np.float64) for r in rows), np.zeros(size))


def _isotonic(bins: np.ndarray, n: np.ndarray, ones: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators over bin centres: knots and non-decreasing values."""
    blocks: list[list[float]] = []  # weight, ones, first, last
    for x, w, y in zip(bins.tolist(), n.tolist(), ones.tolist()):
        blocks.append([w, y, x, x])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][0] >= blocks[-1][1] * blocks[-2][0]:
            w2, y2, _, last = blocks.pop()
            blocks[-1] = [blocks[-1][0] + w2, blocks[-1][1] + y2, blocks[-1][2], last]
    knots = [k for w, y, a, b in blocks for k in (a, b)]
    return np.array(knots), np.array([v for w, y, a, b in blocks for v in (y / w, y / w)])


def fit(feats: DataFrame, labels: DataFrame) -> Model:
    """Fit on all rows of ``feats`` (``doc_id, f``) that have a label and aren't held out.

    ``labels`` has ``doc_id`` and ``quality``; null ids and labels are left out, an id with several
    labels counts once per label. Without any labelled row the score is 0.5, with one class its share.
    """
    known = labels.select("doc_id", F.col("quality").cast("double").alias("y")).where("doc_id is not null and y is not null")
    rows = settle(feats.join(known, "doc_id").select(fold("doc_id").alias("fold"), "f", "y").where("fold <> 0"), "labelled")
    parts = [F.count("*").alias("n"), F.avg("y").alias("y")]
    for i in range(_P):
        parts += [F.avg(F.get("f", F.lit(i))).alias(f"m{i}"), F.stddev_pop(F.get("f", F.lit(i))).alias(f"d{i}")]
    s = rows.agg(*parts).first()
    rng = np.random.default_rng(SEED)
    w, shift = rng.normal(0, 1 / np.sqrt(_P), (_P, WAVES)), rng.uniform(0, 2 * np.pi, WAVES)
    size = WAVES + 1
    if not s.n or s.y in (0.0, 1.0):
        value = 0.5 if not s.n else s.y
        return Model(np.zeros(_P), np.ones(_P), w, shift, np.zeros(size), np.array([0.0, 1.0]), np.array([value, value]))
    model = Model(np.array([s[f"m{i}"] for i in range(_P)]), np.array([max(s[f"d{i}"], 1e-3) for i in range(_P)]), w, shift, np.zeros(size), np.zeros(0), np.zeros(0))

    def equations(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((FOLDS, size, size + 1))
        for batch in batches:
            z, y, k = model.waves(_matrix(batch.column("f"))), batch.column("y").to_numpy(), batch.column("fold").to_numpy()
            for i in range(1, FOLDS):
                own = k == i
                sums[i] += z[own].T @ np.column_stack([z[own], y[own]])
        if sums.any():
            yield pa.RecordBatch.from_arrays([pa.array([sums.tobytes()], pa.binary())], ["sums"])

    sums = _summed(rows.mapInArrow(equations, "sums binary"), FOLDS * size * (size + 1)).reshape(FOLDS, size, size + 1)
    whole = sums.sum(axis=0)

    def solve(m: np.ndarray) -> np.ndarray:
        n = max(m[-1, size - 1], 1.0)  # the last wave is the constant
        return np.linalg.solve(m[:, :size] / n + RIDGE / WAVES * np.eye(size), m[:, size] / n)

    model.beta = solve(whole)
    others = [model.beta, *[solve(whole - sums[i]) if (whole - sums[i]).any() else model.beta for i in range(1, FOLDS)]]

    def bins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, ones = np.zeros(BINS, np.int64), np.zeros(BINS)
        for batch in batches:
            z, y, k = model.waves(_matrix(batch.column("f"))), batch.column("y").to_numpy(), batch.column("fold").to_numpy()
            for i in range(1, FOLDS):
                own = k == i
                at = np.clip(((z[own] @ others[i] + 0.5) * BINS / 2).astype(int), 0, BINS - 1)
                n += np.bincount(at, minlength=BINS)
                ones += np.bincount(at, y[own], minlength=BINS)
        used = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(n[used]), pa.array(ones[used])], ["bin", "n", "ones"])

    counted = rows.mapInArrow(bins, "bin bigint, n bigint, ones double").groupBy("bin").agg(F.sum("n").alias("n"), F.sum("ones").alias("ones")).orderBy("bin").collect()  # at most BINS rows
    at, n, ones = (np.array([r[c] for r in counted]) for c in ("bin", "n", "ones"))
    model.knots, model.values = _isotonic((at + 0.5) * 2 / BINS - 0.5, n, ones)
    return model


def score(model: Model, f: Column | str) -> Column:
    """The score of an array of features."""

    def run(f: pd.Series) -> pd.Series:
        return pd.Series(model.score(np.stack(f.to_list())) if len(f) else [], dtype="float64")

    return F.pandas_udf(run, T.DoubleType())(f)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: ``doc_id, held_out, score, predicted``.

    Only the text is scored, null as empty; fitting uses labels of ids whose crc32 modulo 5 isn't 0.
    A null ``doc_id`` counts as held out; repeated rows get equal scores; empty tables give no rows.
    """
    feats = settle(docs.select("doc_id", features("text").alias("f")), "text-features")
    model = fit(feats, labels)
    out = feats.select("doc_id", (fold("doc_id") == 0).alias("held_out"), score(model, "f").alias("score"))
    return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def keep_good(docs: DataFrame, labelled: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` predicted good, with their columns as they are.

    The fit is on ``labelled`` (``doc_id``, ``text``), which may hold more than ``docs``: what earlier
    stages have rejected is still what a bad document looks like. Null and empty texts are scored like any other; repeated rows get equal scores; rows of null
    ``doc_id`` are scored, not learned from; without labels the score is 0.5 and all rows stay; an
    empty table stays empty; other columns of any name are kept and not looked at."""
    # statistics are taken where the texts lie: a join for the labelled ones alone would shuffle every text
    model = fit(settle(labelled.select("doc_id", features("text").alias("f")), "text-features"), labels)
    return docs.where(score(model, features("text")) >= THRESHOLD)
