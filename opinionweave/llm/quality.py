"""Quality classifier: random Fourier features, ridge regression from summed normal equations, isotonic calibration."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.lineage import written
from .common import text_bytes

FEATURES = 16
_CLASSES = np.zeros(256, np.int64)
for _group, _bytes in enumerate((b" \t\v\f\r", b"\n", bytes(range(48, 58)), bytes(range(97, 123)), bytes(range(65, 91)),
                                 bytes(range(128, 256)), b".,;:'\"-?()"), start=1):
    _CLASSES[list(_bytes)] = _group


def statistics(text: bytes) -> list[float]:
    """Length, letter, symbol, word and line statistics of one text; all 0 for an empty one."""
    n = len(text)
    if not n:
        return [0.0] * FEATURES
    other, blank, line, digit, small, large, wide, mark = np.bincount(
        _CLASSES[np.frombuffer(text, np.uint8)], minlength=8
    )[:8] / n
    words, lines = text.split(), text.split(b"\n")
    count = max(1, len(words))
    lengths = np.fromiter(map(len, words), np.float64, len(words)) if words else np.zeros(1)
    return [
        np.log1p(n), np.log1p(len(words)), lengths.mean(), lengths.std(), len(set(words)) / count,
        len(set(lines)) / len(lines), np.log1p(n / len(lines)), other, blank, line, digit, small, large, wide, mark,
        np.log1p(lengths.max()),
    ]


def document_statistics(docs: DataFrame, keep: dict[str, Column], text_col: str = "text") -> DataFrame:
    """The columns of ``keep`` and the array ``stats`` of every row's whole text."""
    slim = docs.select(*[c.alias(k) for k, c in keep.items()], text_bytes(text_col).alias("_text"))
    schema = slim.drop("_text").schema.add("stats", T.ArrayType(T.DoubleType()))

    names = list(keep)

    def run(batches):
        for batch in batches:
            rows = [statistics(t) for t in batch.column(len(names)).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[: len(names)], pa.array(rows, pa.list_(pa.float64()))], [*names, "stats"]
            )

    return slim.mapInArrow(run, schema)


class Fourier:
    """cos(Wx + b) of standardised statistics: inner products approach a Gaussian kernel of the given width."""

    def __init__(self, mean, spread, size: int, width: float, seed: int):
        rng = np.random.default_rng(seed)
        self.mean, self.spread = np.asarray(mean), np.maximum(np.asarray(spread), 1e-9)
        self.w = rng.normal(0, 1 / width, (FEATURES, size))
        self.b = rng.uniform(0, 2 * np.pi, size)

    def __call__(self, stats: np.ndarray) -> np.ndarray:
        z = np.clip((stats - self.mean) / self.spread, -8, 8)
        return np.hstack([np.ones((len(z), 1)), np.sqrt(2 / len(self.b)) * np.cos(z @ self.w + self.b)])


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy().reshape(-1, FEATURES) if len(column) else np.empty((0, FEATURES))


def normal_equations(rows: DataFrame, features: Fourier) -> tuple[np.ndarray, np.ndarray]:
    """X'X and X'y, summed in each partition, then over partitions; their size does not depend on the rows."""
    n = len(features.b) + 1
    upper = np.triu_indices(n)

    def run(batches):
        gram, right = np.zeros((n, n)), np.zeros(n)
        for batch in batches:
            x, y = features(_matrix(batch.column(0))), batch.column(1).to_numpy()
            gram += x.T @ x
            right += x.T @ y
        cell = np.concatenate([upper[0] * n + upper[1], n * n + np.arange(n)])
        value = np.concatenate([gram[upper], right])
        yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(value)], ["cell", "value"])

    sums = rows.select("stats", F.col("label").cast("double").alias("y")).mapInArrow(run, "cell bigint, value double")
    got = sums.groupBy("cell").agg(F.sum("value").alias("value")).toPandas()
    flat = np.zeros(n * n + n)
    flat[got["cell"].to_numpy(np.int64)] = got["value"].to_numpy(np.float64)
    gram = flat[: n * n].reshape(n, n)
    return gram + np.triu(gram, 1).T, flat[n * n :]


def isotonic(x: np.ndarray, hits: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators over ordered bins: knots and rising shares of label 1."""
    blocks: list[list[float]] = []  # first x, last x, hits, rows
    for at, h, n in zip(x, hits, rows, strict=True):
        blocks.append([at, at, h, n])
        while len(blocks) > 1 and blocks[-2][2] * blocks[-1][3] >= blocks[-1][2] * blocks[-2][3]:
            last = blocks.pop()
            blocks[-1] = [blocks[-1][0], last[1], blocks[-1][2] + last[2], blocks[-1][3] + last[3]]
    knots = np.array([k for b in blocks for k in b[:2]])
    return knots, np.array([b[2] / b[3] for b in blocks for _ in range(2)])


def _scored(stats: DataFrame, features: Fourier, weights: np.ndarray, knots=None, levels=None) -> DataFrame:
    names = [c for c in stats.columns if c != "stats"]

    def run(batches):
        for batch in batches:
            raw = features(_matrix(batch.column(batch.num_columns - 1))) @ weights
            if knots is not None:
                raw = np.interp(raw, knots, levels)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(raw)], [*names, "score"])

    return stats.select(*names, "stats").mapInArrow(run, stats.select(*names).schema.add("score", "double"))


def quality_scores(
    docs: DataFrame, labels: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text",
    label_col: str = "quality", size: int = 128, width: float = 4.0, ridge: float = 1e-3, bins: int = 2000,
    seed: int = 7,
) -> DataFrame:
    """Calibrated quality of every text: id, ``held_out`` and ``score`` from 0 to 1.

    One row per row of ``docs``, repeated rows included. Every labelled row that is not held out is learned from;
    rows without id, without label or with a label other than 0 and 1 are not. Null and empty texts have all
    statistics 0 and get the score of that point. Without any labelled row the score is 0.5 everywhere; an empty
    table gives no rows. Only the id and text columns are read, so other names cannot clash. The text is read once;
    its 16 statistics are written to the shared folder, and what reaches the driver has a fixed size: moments,
    normal equations and ``bins`` calibration bins.
    """
    stats = written(document_statistics(docs, {"_id": F.col(id_col), "held_out": held_out}, text_col), "quality")
    marks = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("label")).filter("label in (0, 1)")
    train = stats.filter("not held_out").join(marks, "_id").select("stats", "label")
    cells = [F.col("stats")[i] for i in range(FEATURES)]
    moments = train.agg(
        F.count("*").alias("n"), F.array(*[F.avg(c) for c in cells]).alias("mean"),
        F.array(*[F.coalesce(F.stddev_pop(c), F.lit(0.0)) for c in cells]).alias("spread"),
    ).first()
    if not moments["n"]:
        return stats.select(F.col("_id").alias(id_col), "held_out", F.lit(0.5).alias("score"))
    features = Fourier(moments["mean"], moments["spread"], size, width, seed)
    gram, right = normal_equations(train, features)
    weights = np.linalg.solve(gram / moments["n"] + ridge * np.eye(len(gram)), right / moments["n"])
    raw = _scored(train, features, weights)
    at = F.round(F.least(F.greatest("score", F.lit(-1.0)), F.lit(2.0)) * bins / 3).alias("at")
    curve = raw.groupBy(at).agg(F.sum("label").alias("hits"), F.count("*").alias("n")).toPandas().sort_values("at")
    knots, levels = isotonic(
        curve["at"].to_numpy(np.float64) * 3 / bins, curve["hits"].to_numpy(np.float64), curve["n"].to_numpy(np.float64)
    )
    return _scored(stats, features, weights, knots, levels).withColumnRenamed("_id", id_col)
