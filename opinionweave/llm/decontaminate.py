"""Benchmark decontamination: CGK embedding, bit-sampling LSH over item-sized windows, exact edit verification.

Symbols are words. A CGK walk reads a window and writes symbols; after each one it steps on when
a random bit of (step, symbol) says so, so that few edits leave most of two outputs equal. The first 2 n symbols count:
in so many steps a walk about reaches the end of its n words, and what follows is filling. A repetition samples
``bits`` output places; windows and items that agree on all of them in one repetition become candidates, and a
semi-global edit distance decides. A window is hashed only if it holds enough of the word pairs of items of its size:
each edit breaks two pairs at most, so no window within the bound is passed over.
"""

from __future__ import annotations

from collections import defaultdict
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORDS_ONLY, shared, text_bytes

#: Bytes of item text searched for in one pass over the documents.
BLOCK_BYTES = 32 << 20
#: Windows walked side by side.
WINDOWS = 512


def edits(item: np.ndarray, region: np.ndarray) -> tuple[int, int]:
    """Least word edits from the item to a stretch of the region, and the end of the first such stretch."""
    row, ramp = np.zeros(len(region) + 1, np.int64), np.arange(len(region) + 1)
    for k, w in enumerate(item, start=1):
        best = np.empty_like(row)
        best[0] = k
        best[1:] = np.minimum(row[:-1] + (region != w), row[1:] + 1)
        row = np.minimum.accumulate(best - ramp) + ramp
    return int(row.min()), int(row.argmin())


class Matcher:
    def __init__(self, items: list[tuple[object, bytes]], max_edit: float, bits: int, repetitions: int, seed: int):
        split = [(key, text.translate(WORDS_ONLY).split()) for key, text in items]
        split = [(key, words) for key, words in split if len(words) > 1]
        self.keys = [key for key, _ in split]
        self.vocabulary = {w: i for i, w in enumerate(dict.fromkeys(w for _, words in split for w in words))}
        self.items = [np.array([self.vocabulary[w] for w in words], np.int64) for _, words in split]
        self.max_edit, size = max_edit, len(self.vocabulary) + 1
        pairs = [x[:-1] * size + x[1:] for x in self.items]
        self.pairs = np.unique(np.concatenate(pairs)) if pairs else np.empty(0, np.int64)
        #: per size how often each pair occurs in an item, at most
        self.of_size: dict[int, np.ndarray] = {}
        for x, p in zip(self.items, pairs, strict=True):
            most = self.of_size.setdefault(len(x), np.zeros(len(self.pairs), np.int64))
            own, times = np.unique(np.searchsorted(self.pairs, p), return_counts=True)
            most[own] = np.maximum(most[own], times)
        self.longest = max(map(len, self.items), default=0)
        self.fewest = min((max(1, n - 1 - 2 * self.allowed(n)) for n in self.of_size), default=1)
        rng = np.random.default_rng(seed)
        # one more symbol: everything outside the vocabulary and after the end
        self.walk = rng.integers(0, 2, (2 * self.longest, size, repetitions), dtype=np.int8)
        self.places = rng.random((bits, repetitions))
        self.odd = rng.integers(1, 1 << 62, (bits + 1, repetitions)) * 2 + 1
        lengths = np.array([len(x) for x in self.items], np.int64)
        keys = self.sketch(self._padded(self.items), lengths) if self.items else np.empty((0, repetitions), np.int64)
        self.order = np.argsort(keys, axis=0, kind="stable")
        self.sorted = np.take_along_axis(keys, self.order, axis=0)

    def allowed(self, n: int) -> int:
        return int(self.max_edit * n)

    def _padded(self, windows: list[np.ndarray]) -> np.ndarray:
        out = np.full((len(windows), self.longest), len(self.vocabulary), np.int64)
        for i, w in enumerate(windows):
            out[i, : len(w)] = w
        return out

    def sketch(self, windows: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Key of every window and repetition: its size and the sampled symbols of its walk."""
        out = []
        repetitions = self.walk.shape[2]
        which = np.arange(repetitions)
        for start in range(0, len(windows), WINDOWS):
            part, n = windows[start : start + WINDOWS], lengths[start : start + WINDOWS]
            wide = np.hstack([part, np.full((len(part), 1), len(self.vocabulary), np.int64)])
            rows = np.arange(len(part))[:, None]
            at = np.zeros((len(part), repetitions), np.int64)
            sampled = np.floor(self.places[None] * (2 * n)[:, None, None]).astype(np.int64)
            key = n[:, None] * self.odd[-1]
            for step in range(2 * int(n.max())):
                symbol = wide[rows, at]
                for b in range(len(self.places)):
                    hit = sampled[:, b] == step
                    if hit.any():
                        key[hit] += ((symbol + 1) * self.odd[b])[hit]
                at = np.minimum(at + self.walk[step][symbol, which], self.longest)
            out.append(key)
        return np.vstack(out) if out else np.empty((0, repetitions), np.int64)

    def windows(self, words: np.ndarray) -> list[tuple[int, int]]:
        """(start, size) of all windows that hold enough word pairs of items of that size.

        Windows do not compete: one beside a passage may hold more pairs, of other items or of a fragment.
        """
        size = len(self.vocabulary) + 1
        inside = words < len(self.vocabulary)
        at = np.flatnonzero(inside[:-1] & inside[1:])
        code = words[at] * size + words[at + 1]
        spot = np.minimum(np.searchsorted(self.pairs, code), max(0, len(self.pairs) - 1))
        true = self.pairs[spot] == code if len(self.pairs) else np.zeros(len(at), bool)
        at, spot = at[true], spot[true]
        if len(at) < self.fewest:
            return []
        out = []
        for n, most in self.of_size.items():
            need = max(1, n - 1 - 2 * self.allowed(n))
            mine = most[spot] > 0
            places, pairs = at[mine], spot[mine]
            if len(places) < need:
                continue
            first, last = places[: len(places) - need + 1], places[need - 1 :]
            good = last - first <= n - 2
            if not good.any():
                continue
            starts = np.unique(np.concatenate([np.arange(max(0, b - n + 2), a + 1) for a, b in zip(first[good], last[good], strict=True)]))
            begin, end = np.searchsorted(places, starts, "left"), np.searchsorted(places, starts + n - 2, "right")
            held = np.array([self._held(pairs[a:b], most) for a, b in zip(begin, end, strict=True)])
            out += [(int(p), n) for p in starts[held >= need]]
        return out

    @staticmethod
    def _held(pairs: np.ndarray, most: np.ndarray) -> int:
        """Word pairs of a window, each as often as an item has it."""
        own, times = np.unique(pairs, return_counts=True)
        return int(np.minimum(times, most[own]).sum())

    def candidates(self, rows: list[np.ndarray], lengths: list[int]):
        """(window, item) numbers that share a key in some repetition."""
        keys = self.sketch(self._padded(rows), np.array(lengths, np.int64))
        found = set()
        for r in range(keys.shape[1]):
            low = np.searchsorted(self.sorted[:, r], keys[:, r], "left")
            high = np.searchsorted(self.sorted[:, r], keys[:, r], "right")
            for w in np.flatnonzero(high > low):
                found.update((int(w), int(self.order[k, r])) for k in range(low[w], high[w]))
        return found

    def matches(self, texts: list[bytes]):
        """(row, item key, edits, first word, words) of every text and item: the closest stretch, the first of equals."""
        unknown = len(self.vocabulary)
        held, where = [], []
        all_words = []
        for row, text in enumerate(texts):
            found = text.translate(WORDS_ONLY).split()
            words = np.fromiter(map(self.vocabulary.get, found, repeat(unknown)), np.int64, len(found))
            all_words.append(words)
            if len(words) > 1:
                for start, n in self.windows(words):
                    held.append(words[start : start + n])
                    where.append((row, start, n))
        if not held:
            return
        groups = defaultdict(list)
        for w, item in self.candidates(held, [n for _, _, n in where]):
            groups[where[w][0], item].append(where[w][1])
        for (row, item), starts in sorted(groups.items()):
            words, x = all_words[row], self.items[item]
            slack, best = self.allowed(len(x)), None
            starts.sort()
            cuts = [0, *(i for i in range(1, len(starts)) if starts[i] - starts[i - 1] > len(x)), len(starts)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                low = max(0, starts[a] - slack)
                region = words[low : starts[b - 1] + len(x) + slack]
                far, end = edits(x, region)
                if far <= slack and (best is None or far < best[0]):
                    back, length = edits(x[::-1], region[:end][::-1])
                    best = (far, low + end - length, length) if back == far else (far, low, end)
            if best:
                yield row, self.keys[item], *best


def _blocks(benchmark: DataFrame, item_col: str, text_col: str):
    """Items in blocks of bounded size, read one partition after the other."""
    block, size = [], 0
    for key, text in benchmark.filter(F.col(text_col).isNotNull()).select(item_col, text_bytes(text_col)).toLocalIterator():
        block.append((key, bytes(text)))
        size += len(text)
        if size >= BLOCK_BYTES:
            yield block
            block, size = [], 0
    yield block


def benchmark_leaks(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
    item_text_col: str = "text", max_edit: float = 0.2, bits: int = 2, repetitions: int = 48, seed: int = 11,
) -> DataFrame:
    """(id, item, edits, first_word, n_words): documents that hold a benchmark item with at most ``max_edit`` edits a word.

    Words are lower-cased runs of letters, digits and non-ASCII. One row per input row and item, with the closest
    stretch of the document, the first of equals; repeated rows and repeated items each give theirs. An item under
    two words, empty or null, is not searched for; null and empty texts hold nothing; a null id is returned as it
    is. No table being empty is an error. Other columns are not read. Whole texts are walked. ``repetitions`` are set
    so that a pair of outputs that differ in 70 % of their places is found with 99 %. Items go to the tasks in
    blocks of ``BLOCK_BYTES``, each a pass over the documents, so no side must fit in memory.
    """
    kind, item_kind = docs.schema[id_col].dataType.simpleString(), benchmark.schema[item_col].dataType.simpleString()
    slim = docs.select(F.col(id_col), text_bytes(text_col).alias("_text"))
    names = [id_col, item_col, "edits", "first_word", "n_words"]
    schema = f"`{id_col}` {kind}, `{item_col}` {item_kind}, edits bigint, first_word bigint, n_words bigint"
    item_type = pa.int64() if item_kind in ("bigint", "int") else None
    out = None
    for block in _blocks(benchmark, item_col, item_text_col):
        get = shared(docs.sparkSession, Matcher(block, max_edit, bits, repetitions, seed))

        def run(batches, get=get):
            matcher = get()
            for batch in batches:
                found = list(matcher.matches(batch.column(1).to_pylist()))
                columns = list(zip(*found, strict=True)) if found else [[]] * 5
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).take(pa.array(list(columns[0]), pa.int64())), pa.array(list(columns[1]), item_type),
                    *(pa.array(list(c), pa.int64()) for c in columns[2:]),
                ], names)

        part = slim.mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
    return out
