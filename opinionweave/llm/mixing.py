"""Mixing to target weights: soft domain membership, then nonnegative document rates by projected gradient.

A classifier learned from the labelled table gives every document a posterior over domains. Rates r >= 0 are sought
for which the expected tokens of every domain, A r with A[d, i] = tokens of i times its posterior of d, match the
targets: least squares in the metric of (A A')^-1 over the rows in use. A step needs one sum over the documents; a document's own rate follows from its row and the residuals of the steps so far, so no rate is
ever stored, shuffled or sent to the driver.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import written
from .common import WORDS_ONLY, shared, text_bytes, unclaimed
from .quality import statistics

BUCKETS = 1 << 17
# Domains of the labelled table and the share of tokens that each shall have.
TARGETS = {"clean": 0.92, "low": 0.07, "toxic": 0.01}


def labelled_domain() -> Column:
    """Domain of a row of ``labels``; null where a mark is missing."""
    return F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 0, "low").when(F.col("quality") == 1, "clean")


def features(text: bytes) -> tuple[int, np.ndarray]:
    """Number of words of a text, and buckets of its distinct words and of its rounded statistics."""
    words = text.translate(WORDS_ONLY).split()
    keys = set(words)
    if text:
        keys.update(b"\0%d:%d:%d" % (scale, k, round(scale * x)) for k, x in enumerate(statistics(text)) for scale in (3, 10, 30))
    # hashing a short word costs less than finding it in a large table
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, keys), np.uint64, len(keys))
    return len(words), np.unique(hashes % np.uint64(BUCKETS)).astype(np.int64)


class Domains:
    """Naive Bayes over the presence of buckets: log ratios of a domain's counts to those expected of it, shrunk to 0."""

    def __init__(self, names: list[str], rows: np.ndarray, counts: np.ndarray, strength: float, least_evidence: float):
        """rows: labelled documents per domain; counts: documents with each bucket, per domain."""
        self.names = names
        share = counts.sum(axis=0) / max(1, rows.sum())
        expected = np.outer(rows, share)
        ratio = np.log((counts + strength) / (expected + strength))
        # likelihood-ratio test of bucket against domain: what chance may have brought about has no weight
        cells = [(counts, expected), (rows[:, None] - counts, rows[:, None] - expected),
                 (counts.sum(axis=0) - counts, counts.sum(axis=0) - expected),
                 (rows.sum() - rows[:, None] - counts.sum(axis=0) + counts, rows.sum() - rows[:, None] - counts.sum(axis=0) + expected)]
        test = 2 * sum(np.where(o > 0, o * np.log(np.maximum(o, 1e-9) / np.maximum(e, 1e-9)), 0.0) for o, e in cells)
        absent = np.log((rows[:, None] - counts + strength) / (rows[:, None] - expected + strength))
        ratio, absent = (np.where(test >= least_evidence, x, 0.0) for x in (ratio, absent))
        self.weights, self.base = (ratio - absent).T.astype(np.float32), absent.sum(axis=1)
        self.prior = np.log((rows + 1) / (rows.sum() + len(names)))
        self.heat = 1.0

    def logits(self, buckets: np.ndarray) -> np.ndarray:
        return self.base + self.weights[buckets].sum(axis=0, dtype=np.float64)


def _posterior(logits: np.ndarray, prior: np.ndarray, heat: float) -> np.ndarray:
    z = heat * logits + prior
    p = np.exp(z - z.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)


def _for_calibration() -> Column:
    return F.pmod(F.xxhash64("_mark", F.lit(1)), F.lit(5)) == 0


def train(docs: DataFrame, labels: DataFrame, domain: Column, id_col: str, text_col: str, names: list[str], sample: int, strength: float, least_evidence: float):
    """(model, sampled labels). At most ``sample`` labelled rows are learned from: those whose ids hash lowest."""
    marks = labels.select(F.col(id_col).alias("_mark"), domain.alias("domain")).filter(F.col("domain").isin(names) & F.col("_mark").isNotNull())
    chosen = written(marks.orderBy(F.xxhash64("_mark"), "_mark", "domain").limit(sample), "labelled")
    # a fifth of them is left for the calibration
    learned = chosen.filter(~_for_calibration())
    # `sample` rows at most
    known = docs.select(F.col(id_col).alias("_id"), text_bytes(text_col).alias("_text")).join(F.broadcast(learned), F.col("_id") == F.col("_mark"))

    def run(batches):
        counts, rows = np.zeros((len(names), BUCKETS), np.int64), np.zeros(len(names), np.int64)
        for batch in batches:
            for text, name in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                d = names.index(name)
                rows[d] += 1
                counts[d, features(text)[1]] += 1
        d, b = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays([
            pa.array(np.r_[d, np.arange(len(names))]), pa.array(np.r_[b, np.full(len(names), -1)]), pa.array(np.r_[counts[d, b], rows]),
        ], ["domain", "bucket", "n"])

    sums = known.select("_text", "domain").mapInArrow(run, "domain bigint, bucket bigint, n bigint")
    got = sums.groupBy("domain", "bucket").agg(F.sum("n").alias("n")).toArrow()
    d, b, n = (got.column(c).to_numpy().astype(np.int64) for c in ("domain", "bucket", "n"))
    rows, counts = np.zeros(len(names)), np.zeros((len(names), BUCKETS))
    rows[d[b < 0]] = n[b < 0]
    counts[d[b >= 0], b[b >= 0]] = n[b >= 0]
    return Domains(names, rows, counts, strength, least_evidence), chosen


def _rates(a: np.ndarray, low: np.ndarray, steps: list[np.ndarray]) -> np.ndarray:
    r = np.ones(len(a))
    for g in steps:
        r = np.maximum(low, r - a @ g)
    return r


def _cells(batch: pa.RecordBatch, column: int, n: int) -> np.ndarray:
    return batch.column(column).flatten().to_numpy(zero_copy_only=False).reshape(-1, n)


def _expected(batch: pa.RecordBatch, prior: np.ndarray, heat: float, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Expected tokens per domain, and least rate, of the rows of a batch that ends with n_tokens and log ratios."""
    p = _posterior(_cells(batch, batch.num_columns - 1, len(prior)), prior, heat)
    return p * batch.column(batch.num_columns - 2).to_numpy()[:, None], least[p.argmax(axis=1)]


def solve(scored: DataFrame, prior: np.ndarray, heat: float, targets: np.ndarray, least: np.ndarray, rounds: int, tolerance: float) -> list[np.ndarray]:
    """Steps of the projected gradient over the expected tokens per domain of all rows.

    The metric comes from the rows whose rate is above 0; a step that does not bring the sums nearer is halved.
    """
    n, total = len(targets), max(1.0, targets.sum())

    def sums(steps):
        def run(batches):
            reached, gram = np.zeros(n), np.zeros((n, n))
            for batch in batches:
                a, low = _expected(batch, prior, heat, least)
                r = _rates(a, low, steps)
                reached += r @ a
                gram += a[r > 0].T @ a[r > 0]
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(n + n * n)), pa.array(np.r_[reached, gram.ravel()])], ["k", "v"])

        got = scored.select("n_tokens", "_logits").mapInArrow(run, "k bigint, v double").groupBy("k").agg(F.sum("v").alias("v")).toPandas().sort_values("k")
        v = got["v"].to_numpy(np.float64)
        return (v[:n], v[n:].reshape(n, n)) if len(v) else (np.zeros(n), np.zeros((n, n)))

    steps: list[np.ndarray] = []
    (reached, gram), scale = sums(steps), 1.0
    for _ in range(rounds):
        off = np.abs(reached - targets).max() / total
        if off <= tolerance or scale < 0.01:
            break
        trial = [*steps, scale * np.linalg.pinv(gram, rcond=1e-9) @ (reached - targets)]
        near, near_gram = sums(trial)
        if np.abs(near - targets).max() / total < 0.99 * off:
            steps, reached, gram, scale = trial, near, near_gram, min(1.0, 2 * scale)
        else:
            scale /= 2
    return steps


def mixing_rates(
    docs: DataFrame, labels: DataFrame, keep: dict[str, Column] | None = None, targets: dict[str, float] = TARGETS, domain: Column | None = None,
    id_col: str = "doc_id", text_col: str = "text", sample: int = 20_000, strength: float = 1.0, least_evidence: float = 15.0, rounds: int = 60, tolerance: float = 1e-4,
    least: dict[str, float] | None = None,
) -> DataFrame:
    """Per input row the columns of ``keep`` (the id), ``n_tokens``, ``p_<domain>`` per domain and ``rate``.

    The rate says how often a document is taken so that the expected tokens of every domain come to its target
    share of all tokens, as nearly as rates of 0 or more allow, and for documents whose most likely domain (the first
    of equals) is in ``least`` rates of that value, 1 at most, or more; rates start at 1. Labels without id or mark are not
    learned from; an id with several labels counts once for each. Null and empty texts have no tokens, the prior as
    posterior and rate 1. Without labels posteriors are equal. Repeated rows count each. Shares are scaled to sum to
    1. An empty table gives no rows. Names in ``keep`` that the operator uses itself are a ValueError before any job.
    ``sample`` bounds the labelled rows learned from; everything else covers all rows.
    """
    keep = {id_col: F.col(id_col)} if keep is None else keep
    names = sorted(targets)
    unclaimed(keep, "_id", "_text", "_logits", "_p", "n_tokens", "rate", *[f"p_{x}" for x in names])
    model, chosen = train(docs, labels, labelled_domain() if domain is None else domain, id_col, text_col, names, sample, strength, least_evidence)
    get, n, held = shared(docs.sparkSession, model), len(names), list(keep)
    slim = docs.select(*[c.alias(k) for k, c in keep.items()], F.col(id_col).alias("_id"), text_bytes(text_col).alias("_text"))

    def run(batches):
        domains = get()
        for batch in batches:
            pairs = [features(t) for t in batch.column(len(held) + 1).to_pylist()]
            rows = np.array([domains.logits(b) for _, b in pairs]).reshape(-1, n)
            yield pa.RecordBatch.from_arrays([
                *batch.columns[: len(held) + 1], pa.array([t for t, _ in pairs], pa.int64()), pa.array(list(rows), pa.list_(pa.float64())),
            ], [*held, "_id", "n_tokens", "_logits"])

    schema = slim.drop("_text").schema.add("n_tokens", "long")
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in schema)}, _logits array<double>"
    scored = written(slim.mapInArrow(run, schema), "domains")
    heat, prior = _calibrate(scored, chosen, names, model.prior), model.prior

    tokens = scored.agg(F.coalesce(F.sum("n_tokens"), F.lit(0))).first()[0]
    shares = np.array([targets[x] for x in names], np.float64)
    low = np.array([(least or {}).get(x, 0.0) for x in names])
    steps = solve(scored, prior, heat, shares / shares.sum() * tokens, low, rounds, tolerance)

    def rated(batches):
        for batch in batches:
            p = _posterior(_cells(batch, batch.num_columns - 1, n), prior, heat)
            r = _rates(*_expected(batch, prior, heat, low), steps)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(list(p), pa.list_(pa.float64())), pa.array(r)], [*held, "n_tokens", "_p", "rate"]
            )

    rows = scored.select(*[F.col(f"`{c}`") for c in held], "n_tokens", "_logits")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "_logits")
    out = rows.mapInArrow(rated, f"{fields}, _p array<double>, rate double")
    return out.select(*[F.col(f"`{c}`") for c in held], "n_tokens", *[F.col("_p")[i].alias(f"p_{x}") for i, x in enumerate(names)], "rate")


def _calibrate(scored: DataFrame, chosen: DataFrame, names: list[str], prior: np.ndarray) -> float:
    """The scale of the log ratios with the least log loss on labelled rows not learned from; words of a text are not independent."""
    grid = [0.05, 0.1, 0.2, 0.3, 0.5, 0.7, 1.0, 1.5]
    known = scored.join(F.broadcast(chosen.filter(_for_calibration())), F.col("_id") == F.col("_mark")).select("domain", "_logits")

    def run(batches):
        loss = np.zeros(len(grid))
        for batch in batches:
            z, at = _cells(batch, 1, len(names)), [names.index(x) for x in batch.column(0).to_pylist()]
            for k, heat in enumerate(grid):
                p = _posterior(z, prior, heat)
                loss[k] -= np.log(np.maximum(p[np.arange(len(p)), at], 1e-12)).sum()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(grid))), pa.array(loss)], ["k", "v"])

    got = known.mapInArrow(run, "k bigint, v double").groupBy("k").agg(F.sum("v").alias("v")).orderBy("v", F.desc("k")).first()
    return grid[got["k"]] if got else 1.0
