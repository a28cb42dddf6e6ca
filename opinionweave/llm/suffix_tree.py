"""LM scoring with a probabilistic suffix tree, beside a smoothed unigram base.

A text is its lower-cased words, joined by one blank, then an end symbol; symbols are UTF-8 bytes. Counts of all
windows of ``depth`` + 1 symbols over the whole training part are summed by Spark. A context of up to ``depth``
symbols is a candidate when it makes up ``min_share`` of all symbols. It is retained, with its suffixes, when its next-symbol
distribution diverges from that of its longest proper suffix: count times divergence, the log likelihood that the
context gains on the training part, has to reach ``min_evidence``. Distributions are smoothed towards those of the suffix. For scoring the tree becomes an automaton whose state after each symbol knows
the longest retained context; texts are cut into pieces that start ``depth`` symbols early and run side by side.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import written
from .common import shared, text_bytes

END = 0xFF  # no byte of UTF-8; also stands before the first symbol
PIECE = 512
#: Distinct words, or symbols of text, that a task holds before it hands counts on.
WORDS_HELD, SYMBOLS_HELD = 200_000, 1 << 20
#: Windows of several stretches that a task sums before it hands them on, and rows of a batch of them.
WINDOWS_HELD, BATCH = 1 << 21, 1 << 17
ROWS = 500


def _symbols(texts: list[bytes], depth: int) -> np.ndarray:
    """All texts in one array, ``depth`` end symbols before each and after the last."""
    pad = bytes([END]) * depth
    return np.frombuffer(pad + pad.join(texts) + pad, np.uint8)


def _windows(texts: list[bytes], depth: int) -> tuple[np.ndarray, np.ndarray]:
    s = _symbols(texts, depth)
    code = np.zeros(len(s) - depth, np.int64)
    for k in range(depth + 1):
        code = (code << 8) | s[k : len(s) - depth + k]
    nxt, before = s[depth:], s[depth - 1 : -1]
    real = code[(nxt != END) | (before != END)]
    empty = sum(not t for t in texts)
    codes, counts = np.unique(real, return_counts=True)
    if empty:
        codes, counts = np.append(codes, int.from_bytes(bytes([END]) * (depth + 1))), np.append(counts, empty)
    return codes, counts


def _summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """The distinct codes of all parts, sorted, and the sums of their counts."""
    codes, counts = (np.concatenate(x) for x in zip(*parts, strict=True))
    parts.clear()
    if codes.max(initial=0) >> 56 or codes.min(initial=0) < 0:
        order = np.argsort(codes)
        codes, counts = codes[order], counts[order]
    else:  # numbers sort much faster than their places: counts go into the free byte, large ones in several pieces
        codes <<= 8
        codes = codes.view(np.uint64)
        large = np.repeat(codes, counts // 255) | np.uint64(255)
        counts %= 255
        codes |= counts.view(np.uint64)
        del counts
        codes = np.concatenate([codes, large])
        codes.sort()
        counts = (codes & np.uint64(255)).view(np.int64)
        codes >>= np.uint64(8)
        codes = codes.view(np.int64)
    first = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]][: len(codes)])
    return codes[first], np.add.reduceat(counts, first) if len(first) else counts


def corpus_counts(docs: DataFrame, learn: Column, depth: int, text_col: str = "text") -> DataFrame:
    """(word, code, n): counts of words (code -1; the end is the empty word) and of windows (null word)."""

    def run(batches):
        words, held, size, parts = Counter(), [], 0, []

        def rows(found):
            return pa.RecordBatch.from_arrays([
                pa.array(list(found), pa.binary()), pa.repeat(pa.scalar(-1, pa.int64()), len(found)), pa.array(list(found.values()), pa.int64()),
            ], ["word", "code", "n"])

        def windows(last):
            if held:
                parts.append(_windows(held, depth))
                held.clear()
            if not parts or not last and sum(len(codes) for codes, _ in parts) < WINDOWS_HELD:
                return
            parts[:] = [_summed(parts)]
            codes, counts = parts[0]
            # few windows are new: the sums are held on, for at least a quarter of the room
            if last or 4 * len(codes) > 3 * WINDOWS_HELD:
                parts.clear()
                for i in range(0, len(codes), BATCH):
                    some = codes[i : i + BATCH]
                    yield pa.RecordBatch.from_arrays([pa.nulls(len(some), pa.binary()), pa.array(some), pa.array(counts[i : i + BATCH])], ["word", "code", "n"])

        for batch in (b.slice(i, ROWS) for b in batches for i in range(0, b.num_rows, ROWS)):
            for text in batch.column(0).to_pylist():
                found = text.lower().split()
                words.update(found)
                words[b""] += 1
                held.append(b" ".join(found))
                size += len(held[-1])
                if size >= SYMBOLS_HELD:
                    yield from windows(last=False)
                    size = 0
                if len(words) >= WORDS_HELD:
                    yield rows(words)
                    words.clear()
        yield from windows(last=True)
        yield rows(words)

    slim = docs.filter(learn).select(text_bytes(text_col).alias("text"))
    return slim.mapInArrow(run, "word binary, code bigint, n bigint").groupBy("word", "code").agg(F.sum("n").alias("n"))


class SuffixTree:
    """Retained contexts as an automaton over symbols; ``step`` and ``cost`` are indexed by state and symbol."""

    def __init__(self, rows, depth: int, min_evidence: float):
        """rows: (context length, context code, symbol, count) of candidates, the empty context among them."""
        self.depth = depth
        table = np.asarray(rows, np.int64).reshape(-1, 4)
        seen = sorted({*table[table[:, 0] == 0, 2].tolist(), END})
        self.number = np.full(256, len(seen), np.int64)  # the last number: symbols never seen
        self.number[seen] = np.arange(len(seen))
        size = len(seen) + 1
        table = table[np.lexsort((table[:, 1], table[:, 0]))]
        first = np.flatnonzero(np.r_[True, (table[1:, :2] != table[:-1, :2]).any(axis=1)]) if len(table) else np.empty(0, np.int64)
        part = {
            int(c).to_bytes(int(d)): slice(i, j)
            for (d, c), i, j in zip(table[first, :2], first.tolist(), np.r_[first, len(table)][1:].tolist(), strict=True)
        }

        def counted(c: bytes) -> np.ndarray:
            n = np.zeros(size)
            if c in part:
                np.add.at(n, self.number[table[part[c], 2]], table[part[c], 3])
            return n

        kept: set[bytes] = {b""}
        for c, own in part.items():  # an extension may tell nothing while the next one does: all are tested
            if not c:
                continue
            q, n = counted(c[1:]), table[own, 3].astype(float)
            gain = np.sum(n * np.log(n / n.sum() * (q.sum() / q[self.number[table[own, 2]]])))
            if gain >= min_evidence:
                kept |= {c[i:] for i in range(len(c))}
        n = counted(b"")
        smooth = {b"": (n + 0.5) / (n.sum() + 0.5 * size)}
        for c in sorted(kept - {b""}, key=len):
            n = counted(c)
            some = np.count_nonzero(n)
            smooth[c] = ((n + some * smooth[c[1:]]) / (n.sum() + some)).astype(np.float32)
        states = sorted(kept | {c[:i] for c in kept for i in range(len(c))}, key=lambda c: (len(c), c))
        at = {c: i for i, c in enumerate(states)}
        longer: dict[bytes, list[bytes]] = {}
        for c in states[1:]:
            longer.setdefault(c[:-1], []).append(c)
        self.step = np.zeros((len(states), size), np.int32)
        self.cost = np.zeros((len(states), size), np.float32)
        for c, i in at.items():
            if c:
                self.step[i] = self.step[at[c[1:]]]
            self.cost[i] = np.log10(smooth[c]) if c in kept else self.cost[at[c[1:]]]
            for d in longer.get(c, ()):
                self.step[i, self.number[d[-1]]] = at[d]
        self.states = states

    def log10(self, texts: list[bytes]) -> np.ndarray:
        """log10 probability of each text with its end."""
        if not texts:
            return np.empty(0)
        depth, size = self.depth, self.step.shape[1]
        s = _symbols(texts, depth)
        start = np.cumsum([depth] + [len(t) + depth for t in texts])[:-1]
        stop = start + np.fromiter(map(len, texts), np.int64, len(texts)) + 1
        n = -len(s) % PIECE
        grid = np.ascontiguousarray(self.number[np.concatenate([s, np.full(n, END, np.uint8)])].reshape(-1, PIECE).T)
        step, cost = self.step.ravel(), self.cost.ravel()
        end = int(self.number[END])
        state = np.zeros(grid.shape[1], np.int64)
        for row in grid[PIECE - depth :]:  # the end of the piece before
            state = step[state * size + np.concatenate([[end], row[:-1]])].astype(np.int64)
        out = np.empty(grid.shape, np.float32)
        for k, row in enumerate(grid):
            at = state * size + row
            out[k] = cost[at]
            state = step[at].astype(np.int64)
        total = np.concatenate([[0.0], np.cumsum(out.T.ravel(), dtype=np.float64)])
        return total[stop] - total[start]


def _candidates(codes: DataFrame, depth: int, min_share: float) -> np.ndarray:
    """Counts of all contexts with at least ``min_share`` of the symbols: depth / min_share contexts at most."""
    tails = [F.struct(F.lit(d).alias("d"), F.col("code").bitwiseAND(F.lit((1 << 8 * (d + 1)) - 1)).alias("code")) for d in range(depth + 1)]
    each = codes.select(F.explode(F.array(*tails)).alias("x"), "n").select("x.d", "x.code", "n")
    sums = each.groupBy("d", "code").agg(F.sum("n").alias("n"))
    sums = written(sums.select("d", F.shiftright("code", 8).alias("context"), F.col("code").bitwiseAND(F.lit(255)).alias("symbol"), "n"), "windows")
    total = sums.filter("d = 0").agg(F.sum("n")).first()[0] or 0
    large = sums.groupBy("d", "context").agg(F.sum("n").alias("all")).filter(F.col("all") >= min_share * total)
    got = sums.join(large.select("d", "context"), ["d", "context"], "left_semi").select("d", "context", "symbol", "n")
    return np.stack([c.to_numpy() for c in got.toArrow().columns], axis=1).astype(np.int64)


def lm_scores(
    docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text", depth: int = 6,
    min_share: float = 4e-6, min_evidence: float = 4.0, frequent_words: int = 400_000,
) -> DataFrame:
    """Base and suffix-tree log10 probability of every text.

    Per input row: id, ``held_out``, ``n_tokens`` (words and the end), ``n_known`` (tokens seen in training),
    ``train_tokens``, ``base_score``, ``score``. All rows that are not held out are counted, each once per row.
    Null and empty texts are the end alone. With nothing to learn from the base is uniform (V = 0) and the tree is
    its empty root. Repeated rows give repeated rows; an empty table gives none; other columns are not read.

    Word counts stay distributed. Words with at least 1 / ``frequent_words`` of all tokens, so that many at most,
    go to the tasks, and so do the retained contexts, ``depth`` / ``min_share`` at most; the rarer words of each
    row are joined to their counts by shuffle. The choice of path changes no figure.
    """
    counts = written(corpus_counts(docs, ~held_out, depth, text_col), "counts")
    vocabulary = counts.filter("code = -1").select("word", "n")
    n_all, distinct = vocabulary.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    common = vocabulary.filter(F.col("n") * frequent_words >= n_all).toArrow().combine_chunks()
    rows = _candidates(counts.filter("code >= 0").select("code", "n"), depth, min_share)
    tree = shared(docs.sparkSession, SuffixTree(rows, depth, min_evidence))
    common_words, common_n = common.column("word").combine_chunks(), common.column("n").to_numpy()
    bottom = n_all + 0.1 * (distinct + 1)

    def run(batches):
        model = tree()
        for whole in (b.slice(i, ROWS) for b in batches for i in range(0, b.num_rows, ROWS)):
            texts, start = whole.column(1).to_pylist(), 0
            while start < len(texts):
                stop, size = start, 0
                while stop < len(texts) and size < SYMBOLS_HELD:
                    size += len(texts[stop])
                    stop += 1
                ids: dict[bytes, int] = {b"": 0}
                split = [t.lower().split() for t in texts[start:stop]]
                numbers = [np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, len(words)) for words in split]
                distinct_words = pa.array(list(ids), pa.binary())
                where = pc.index_in(distinct_words, value_set=common_words) if len(common_words) else pa.nulls(len(ids), pa.int32())
                place = where.fill_null(-1).to_numpy(zero_copy_only=False)
                c = np.where(place >= 0, common_n[place] if len(common_n) else 0, 0)
                logs, rare = np.where(c > 0, np.log10((c + 0.1) / bottom), 0.0), c == 0
                base, known, rest, rest_n = [], [], [], []
                listed = distinct_words.to_pylist()
                for own in numbers:
                    own = np.append(own, 0)
                    base.append(float(logs[own].sum()))
                    known.append(int((c[own] > 0).sum()))
                    w, times = np.unique(own[rare[own]], return_counts=True)
                    rest.append([listed[i] for i in w])
                    rest_n.append(times.tolist())
                score = model.log10([b" ".join(words) for words in split])
                part = whole.slice(start, stop - start)
                yield pa.RecordBatch.from_arrays([
                    part.column(0), part.column(2), pa.array([len(x) + 1 for x in numbers], pa.int64()),
                    pa.array(known, pa.int64()), pa.array(base, pa.float64()), pa.array(score, pa.float64()),
                    pa.array(rest, pa.list_(pa.binary())), pa.array(rest_n, pa.list_(pa.int64())),
                ], ["_id", "held_out", "n_tokens", "known", "base", "score", "words", "times"])
                start = stop

    slim = docs.select(F.col(id_col).alias("_id"), text_bytes(text_col).alias("text"), held_out.alias("held_out"))
    schema = (
        f"_id {docs.schema[id_col].dataType.simpleString()}, held_out boolean, n_tokens bigint, known bigint, "
        "base double, score double, words array<binary>, times array<bigint>"
    )
    # the row number becomes fixed when the table is written
    scored = written(slim.mapInArrow(run, schema).withColumn("_row", F.monotonically_increasing_id()), "scored")
    rare = scored.select("_row", F.explode(F.arrays_zip("words", "times")).alias("x")).select("_row", "x.words", "x.times")
    seen = vocabulary.filter(F.col("n") * frequent_words < n_all).withColumnRenamed("word", "words")
    c = F.coalesce("n", F.lit(0))
    sums = rare.join(seen, "words", "left").groupBy("_row").agg(
        F.sum(F.col("times") * F.log10((c + 0.1) / F.lit(float(bottom)))).alias("more"),
        F.sum(F.when(c > 0, F.col("times")).otherwise(0)).alias("more_known"),
    )
    return scored.drop("words", "times").join(sums, "_row", "left").select(
        F.col("_id").alias(id_col), "held_out", "n_tokens",
        (F.col("known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        F.lit(int(n_all)).cast("bigint").alias("train_tokens"),
        (F.col("base") + F.coalesce("more", F.lit(0.0))).alias("base_score"), "score",
    )
