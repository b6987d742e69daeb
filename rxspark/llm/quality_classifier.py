"""Quality classifier: ridge regression on random Fourier features of document statistics, calibrated by isotonic steps.

Statistics (shares of byte classes, word and line figures) come from the whole text in one pass. Scaled to unit
variance, they are mapped to FEATURES cosines with fixed random directions, which approximate a Gaussian kernel. Every
task adds up its part of the normal equations; their sum is a matrix of fixed size, solved on the driver. Three quarters
of the labelled rows (by hash of the id) fit the regression, the rest calibrates it: pooled adjacent violators over
scores counted in bins, joined by straight lines; a small share of the raw score keeps the order inside steps.

Defined cases: null and empty texts have zero statistics and are scored like others. Rows without label or id do not
teach; a label that repeats counts once, the larger one. Without two classes among the labels every score is the share
of ones (0.5 without labels). Repeated rows are answered each time. Output columns replace input columns of the same name.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rxspark.llm import common as C

FEATURES = 256
RIDGE = 1e-3  # times the number of rows
BINS = 1000  # per unit of raw score
SEED = 2

_CLASSES = ("lower", "upper", "digit", "space", "line", "stop", "mark", "other", "high")
_CLASS = np.full(256, 7)
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58], _CLASS[128:] = 0, 1, 2, 8
_CLASS[[9, 11, 12, 13, 32]], _CLASS[10] = 3, 4
_CLASS[[ord(c) for c in ".,;:!?'\"()-"]] = 5
_CLASS[[ord(c) for c in "#*$%&|<>"]] = 6
_LINE = np.zeros(256, bool)
_LINE[10] = True
NAMES = [
    *(f"share_{c}" for c in _CLASSES), "log_bytes", "log_words", "word_bytes", "distinct_words", "capital_words", "marked_words",
    "log_lines", "distinct_lines", "distinct_pairs",
]


def _distinct(row: np.ndarray, value: np.ndarray, rows: int) -> np.ndarray:
    order = np.lexsort((value, row))
    r, v = row[order], value[order]
    new = np.ones(len(r), bool)
    new[1:] = (r[1:] != r[:-1]) | (v[1:] != v[:-1])
    return np.bincount(r[new], minlength=rows)


def statistics(column: pa.Array) -> np.ndarray:
    """One row of NAMES for every text."""
    data, begin = C.text_bytes(column)
    rows, size = len(column), np.maximum(np.diff(begin), 1)
    out = np.zeros((rows, len(NAMES)))
    owner = np.repeat(np.arange(rows), np.diff(begin))
    n = len(_CLASSES)
    out[:, :n] = np.bincount(owner * n + _CLASS[data], minlength=rows * n).reshape(rows, n) / size[:, None]
    start, end, row = C.words_of(data, begin)
    words = np.bincount(row, minlength=rows)
    some = np.maximum(words, 1)
    rolling = C.RollingHash(C.LOWER[data], 11)
    hashes = rolling(start, end)
    lines_from, lines_to, line_row = C.words_of(data, begin, _LINE)
    lines = np.bincount(line_row, minlength=rows)
    count = lambda r: np.bincount(r, minlength=rows) / some
    kind = _CLASS[data]
    pair = row[1:] == row[:-1]
    pairs = np.maximum(words - 1, 1)
    with_next = C.mix(hashes[:-1] * np.uint64(3) + hashes[1:])[pair] if len(hashes) > 1 else hashes[:0]
    out[:, n:] = np.stack([
        np.log1p(np.diff(begin)), np.log1p(words), np.bincount(row, end - start, rows) / some / 10,
        _distinct(row, hashes, rows) / some, count(row[(kind[start] == 1) & (kind[np.minimum(start + 1, end - 1)] == 1)]), count(row[kind[end - 1] == 6]),
        np.log1p(lines), _distinct(line_row, rolling(lines_from, lines_to), rows) / np.maximum(lines, 1),
        _distinct(row[:-1][pair] if len(row) > 1 else row[:0], with_next, rows) / pairs,
    ], axis=1)
    return out


def _statistics(batches):
    for part in C.slices(batches):
        x = statistics(part.column("text"))
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel()))
        yield pa.RecordBatch.from_arrays([part.column("row"), lists], names=["row", "stats"])


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    directions: np.ndarray
    offsets: np.ndarray
    weights: np.ndarray
    knots: np.ndarray
    values: np.ndarray

    def cosines(self, x: np.ndarray) -> np.ndarray:
        z = np.sqrt(2 / len(self.offsets)) * np.cos((x - self.mean) / self.scale @ self.directions + self.offsets)
        return np.concatenate([z, np.ones((len(x), 1))], axis=1)

    def raw(self, x: np.ndarray) -> np.ndarray:
        return np.clip(self.cosines(x) @ self.weights, -1, 2)

    def score(self, x: np.ndarray) -> np.ndarray:
        raw = self.raw(x)
        if not len(self.knots):
            return np.full(len(x), self.values[0])
        return 0.999 * np.interp(raw, self.knots, self.values) + 0.001 * (raw + 1) / 3


def _matrix(lists: pa.Array) -> np.ndarray:
    return lists.flatten().to_numpy().reshape(len(lists), -1)


def _normal(shared):
    schema = pa.schema([("i", pa.int32()), ("sums", pa.list_(pa.float64()))])

    def run(batches):
        model: Model = shared.value
        total = None
        for part in batches:
            if part.num_rows:
                z = model.cosines(_matrix(part.column("stats")))
                z = np.concatenate([z, part.column("label").to_numpy()[:, None]], axis=1)
                total = z.T @ z if total is None else total + z.T @ z
        if total is not None:
            yield C.batch(schema, np.arange(len(total), dtype=np.int32), pa.array(list(total), pa.list_(pa.float64())))

    return run


def _binned(shared):
    def run(batches):
        for part in batches:
            raw = shared.value.raw(_matrix(part.column("stats")))
            yield pa.RecordBatch.from_arrays([pa.array(np.round(raw * BINS).astype(np.int32)), part.column("label")], names=["bin", "label"])

    return run


def pooled(bins: np.ndarray, n: np.ndarray, ones: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Isotonic means over sorted bins: centre and mean of every pooled block."""
    blocks: list[list[float]] = []
    for x, count, total in zip(bins, n, ones, strict=True):
        blocks.append([x * count, count, total])
        while len(blocks) > 1 and blocks[-2][2] * blocks[-1][1] >= blocks[-1][2] * blocks[-2][1]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last, strict=True)]
    b = np.array(blocks)
    return b[:, 0] / b[:, 1], b[:, 2] / b[:, 1]


def fit(stats: DataFrame, labels: DataFrame, seed: int = SEED) -> Model:
    """``stats`` has ``id`` and ``stats``; ``labels`` has ``id`` and ``label`` (0 or 1)."""
    spark = stats.sparkSession
    known = labels.filter("id IS NOT NULL AND label IS NOT NULL").groupBy("id").agg(F.max("label").cast("double").alias("label"))
    rows = C.stored(stats.join(known, "id").select("id", "stats", "label"), "labelled")
    size = len(NAMES)
    share = rows.agg(F.avg("label").alias("ones"), F.count("*").alias("n")).first()
    random = np.random.default_rng(seed)
    model = Model(
        np.zeros(size), np.ones(size), random.normal(0, 1 / np.sqrt(size), (size, FEATURES)), random.uniform(0, 2 * np.pi, FEATURES),
        np.zeros(FEATURES + 1), np.zeros(0), np.array([0.5 if share["ones"] is None else share["ones"]]),
    )
    if share["ones"] in (None, 0.0, 1.0):
        return model
    teach = F.pmod(F.xxhash64("id"), F.lit(4)) != 0
    moments = rows.select(F.posexplode("stats").alias("i", "x")).groupBy("i").agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s")).collect()
    for r in moments:  # one row per statistic
        model.mean[r["i"]], model.scale[r["i"]] = r["m"], r["s"] if r["s"] > 1e-9 else 1.0
    sums = (
        rows.filter(teach)
        .mapInArrow(_normal(spark.sparkContext.broadcast(model)), "i int, sums array<double>")
        .select("i", F.posexplode("sums").alias("j", "x"))
        .groupBy("i", "j")
        .agg(F.sum("x").alias("x"))
        .toPandas()  # (FEATURES + 2) squared numbers
    )
    if not len(sums):
        return model
    full = np.zeros((FEATURES + 2, FEATURES + 2))
    full[sums["i"], sums["j"]] = sums["x"]
    n = full[FEATURES, FEATURES]
    penalty = np.diag(np.r_[np.full(FEATURES, RIDGE * n), 1e-9])
    model.weights = np.linalg.solve(full[:-1, :-1] + penalty, full[:-1, -1])
    bins = lambda part: (
        part.mapInArrow(_binned(spark.sparkContext.broadcast(model)), "bin int, label double")
        .groupBy("bin").agg(F.count("*").alias("n"), F.sum("label").alias("ones")).orderBy("bin").toPandas()  # 3 * BINS + 1 rows at most
    )
    held = bins(rows.filter(~teach))
    if not len(held) or held["ones"].sum() in (0, held["n"].sum()):
        held = bins(rows)
    knots, model.values = pooled(held["bin"].to_numpy(float), held["n"].to_numpy(float), held["ones"].to_numpy(float))
    model.knots = knots / BINS
    return model


def with_statistics(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``docs`` (its ``keep`` columns; all by default) with ``stats``, the statistics in the order of NAMES."""
    keep = [c for c in (docs.columns if keep is None else keep) if c != "stats"]
    packed = docs.select(F.struct(F.lit(0).alias("_"), *keep).alias("row"), F.col(text).alias("text"))
    done = packed.mapInArrow(_statistics, f"row {packed.schema['row'].dataType.simpleString()}, stats array<double>")
    return done.select(*(F.col("row").getField(c).alias(c) for c in keep), "stats")


def score(stats: DataFrame, model: Model) -> DataFrame:
    """``stats`` with ``score``, the calibrated chance of label 1."""
    shared = stats.sparkSession.sparkContext.broadcast(model)  # of fixed size

    @F.pandas_udf("double")
    def scored(x):
        import pandas as pd

        return pd.Series(shared.value.score(np.stack(x.to_numpy())) if len(x) else np.zeros(0))

    return stats.withColumn("score", scored("stats"))
