"""Phrase collocations per language, counted by tries of phrases that may be frequent.

Every word of a language is a 64-bit hash; hashes are checked to be distinct over the corpus. Three scans, each with
counts that tasks sum before the shuffle:

1. words, and beside them the phrases that hold 1 / ``head`` or more of some stretch of text. A phrase with that share of
   the corpus holds it in some stretch, too, and those whose summed stretches reach it, at most ``head`` a length, are
   frequent for sure. They make up a double-array trie that goes to all tasks.
2. one state per text position starts at the root, and all advance together, one word a level; accepting states are
   counted by ``bincount`` and the tasks' counts are summed. Two-word phrases beside the trie are counted by shuffle if
   both words may be frequent: bitmaps of fixed size mark the hashes of the frequent ones, so none is missed (Apriori).
3. three-word phrases beside the trie whose two halves may be frequent, likewise.

Scans 2 and 3 hand on the counts of a stretch packed by bucket of the phrase's hash, a row per bucket, so that the many
phrases met once are no rows of their own. Buckets grow in number with the corpus and not in size; a frequent phrase
stands in its bucket once per stretch. One task sums a bucket after the other.

So trie, bitmaps and driver hold bounded data at any size of the corpus, and which way a phrase takes changes no figure.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import written
from ..plans.ranking import top_n_per_key
from ..plans.skew import salted_join
from .common import bitmap_of, shared, shared_bits, text_bytes

#: Lower-cases A-Z; what ends a piece becomes a full stop.
PIECES = bytes(46 if c in b".,;:!?\n\x0b\x0c\r" else c + 32 if 65 <= c <= 90 else c for c in range(256))
END = b"."
LONGEST = 3
#: Phrases a length in the trie, and places of a bitmap, as powers of two.
HEAD, BITS = 18, 26
#: Positions, and distinct words, of the texts that are counted at once.
STRETCH, WORDS_HELD = 1 << 21, 1 << 19
#: Words of the corpus per bucket and per partition of packed counts, as powers of two; most partitions; bytes of a batch.
BUCKET, PARTITION, MOST_PARTITIONS, BATCH = 18, 20, 1 << 14, 1 << 22


class Numbered(dict):
    """Numbers, from 1, of the words of one language in a pool."""

    def __init__(self, pool: Pool, lang: str):
        super().__init__({END: 0})
        self.pool, self.lang, self.salt = pool, lang, lang.encode() + b"\0"

    def __missing__(self, word: bytes) -> int:
        pool = self.pool
        h = xxhash.xxh3_64_intdigest(self.salt + word, pool.seed)
        pool.hashes.append(h - (1 << 64) if h >> 63 else h)
        self[word] = number = len(pool.hashes) - 1
        return number


class Pool:
    """Words met in a stretch of text."""

    def __init__(self, seed: int):
        self.seed = seed
        self.hashes, self.langs = array("q", [0]), {}

    def numbers(self, lang: str | None, text: bytes) -> np.ndarray:
        lang = "und" if lang is None else lang
        if lang not in self.langs:
            self.langs[lang] = Numbered(self, lang)
        words = text.translate(PIECES).replace(END, b" . ").split()
        words.append(END)
        return np.fromiter(map(self.langs[lang].__getitem__, words), np.int32, len(words))

    def words(self) -> Iterator[tuple[str, np.ndarray, list[bytes]]]:
        """Language, numbers and words of every language in the pool."""
        for lang, own in self.langs.items():
            numbers = np.fromiter(own.values(), np.int64, len(own))[1:]
            yield lang, numbers, list(own)[1:]


def _stretches(batches, seed: int) -> Iterator[tuple[np.ndarray, Pool]]:
    """Texts as word numbers with 0 at the ends of pieces, in stretches of about as many positions."""
    pool, held, size = Pool(seed), [], 0
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            held.append(pool.numbers(lang, text))
            size += len(held[-1])
            if size >= STRETCH or len(pool.hashes) > WORDS_HELD:
                numbers, held = np.concatenate(held), []
                yield numbers, pool
                del numbers
                pool, size = Pool(seed), 0
    if held:
        yield np.concatenate(held), pool


def _phrases(numbers: np.ndarray, length: int, able: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct phrases of a stretch, a row of numbers each, and their counts; ``able`` marks the starts that count."""
    parts = [numbers[k : len(numbers) - length + 1 + k] for k in range(length)] if len(numbers) >= length else [numbers[:0]] * length
    whole = np.logical_and.reduce([p != 0 for p in parts])
    if able is not None:
        whole &= able[: len(whole)]
    bits = int(numbers.max(initial=1)).bit_length()
    if length * bits > 63:  # one text with very many words
        return np.unique(np.stack([p[whole] for p in parts], axis=1), axis=0, return_counts=True)
    code = np.zeros(len(whole), np.int64)
    for p in parts:
        code = code << bits | p
    code = code[whole]
    code.sort()
    first = np.flatnonzero(np.r_[True, code[1:] != code[:-1]][: len(code)])
    counts, code = np.diff(np.r_[first, len(code)]), code[first]
    out = np.empty((len(code), length), numbers.dtype)
    for k in range(length):
        out[:, k] = code >> bits * (length - 1 - k) & (1 << bits) - 1
    return out, counts


def _rows(hashes: np.ndarray, phrases: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
    """(h1, h2, h3, n): phrases by their words' hashes, null past the end."""
    columns = [pa.array(hashes[phrases[:, k]]) if k < phrases.shape[1] else pa.nulls(len(counts), pa.int64()) for k in range(LONGEST)]
    return pa.RecordBatch.from_arrays([*columns, pa.array(counts)], ["h1", "h2", "h3", "n"])


COUNTS = "h1 bigint, h2 bigint, h3 bigint, n bigint"
PACKED = "bucket bigint, phrases binary, counts binary"
MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)


def _packed(phrases: np.ndarray, counts: np.ndarray, buckets: int, hashes: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
    """Distinct phrases of one length, a row of hashes each, and their counts, in a row per bucket that has any.

    With ``hashes``, phrases are rows of places in it and become hashes batch by batch, not all at once.
    """
    length = phrases.shape[1]
    spelt = (lambda x: x) if hashes is None else hashes.__getitem__
    bucket = np.zeros(len(phrases), np.uint64)
    for k in range(length):
        bucket += spelt(phrases[:, k]).astype(np.uint64) * MULTIPLIERS[k]
    bucket >>= np.uint64(32)
    bucket *= np.uint64(buckets)
    bucket >>= np.uint64(32)
    bucket = bucket.astype(np.uint32)
    order = np.argsort(bucket, kind="stable")
    bucket = bucket[order]
    start = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]][: len(bucket)])
    stop = np.r_[start[1:], len(bucket)]
    at = 0
    while at < len(start):
        end = max(at + 1, int(np.searchsorted(stop, start[at] + BATCH // (8 * length))))
        low, high = start[at], stop[end - 1]
        edges, some = np.r_[start[at:end], high] - low, order[low:high]
        cells = [
            pa.Array.from_buffers(pa.binary(), end - at, [None, pa.py_buffer((edges * width).astype(np.int32)), pa.py_buffer(data.tobytes())])
            for data, width in ((spelt(phrases[some]), 8 * length), (counts[some].astype(np.uint32), 4))
        ]
        yield pa.RecordBatch.from_arrays([pa.array(bucket[start[at:end]].astype(np.int64) * (LONGEST + 1) + length), *cells], ["bucket", "phrases", "counts"])
        at = end


def _merged(length: int, phrases: list[bytes], counts: list[bytes], least: int) -> pa.RecordBatch:
    """The phrases of one bucket that have ``least`` occurrences or more in sum."""
    rows = np.frombuffer(b"".join(phrases), np.int64).reshape(-1, length)
    n = np.frombuffer(b"".join(counts), np.uint32).astype(np.int64)
    order = np.lexsort(rows.T)
    rows = rows[order]
    first = np.flatnonzero(np.r_[True, (rows[1:] != rows[:-1]).any(axis=1)])
    n = np.add.reduceat(n[order], first)
    enough = n >= least
    rows = rows[first[enough]]
    columns = [pa.array(np.ascontiguousarray(rows[:, k])) if k < length else pa.nulls(len(rows), pa.int64()) for k in range(LONGEST)]
    return pa.RecordBatch.from_arrays([*columns, pa.array(n[enough])], ["h1", "h2", "h3", "a"])


def _summed_buckets(packed: DataFrame, least: int, words: int) -> DataFrame:
    """(h1, h2, h3, a) of the phrases with ``least`` occurrences or more; ``words``: those of the corpus."""

    def run(batches):
        at, phrases, counts = None, [], []
        for batch in batches:
            for bucket, some, n in zip(*(batch.column(k) for k in range(3)), strict=True):
                if bucket.as_py() != at:
                    if at is not None:
                        yield _merged(at % (LONGEST + 1), phrases, counts, least)
                    at, phrases, counts = bucket.as_py(), [], []
                phrases.append(some.as_py())
                counts.append(n.as_py())
        if at is not None:
            yield _merged(at % (LONGEST + 1), phrases, counts, least)

    parts = min(MOST_PARTITIONS, 1 + (words >> PARTITION))
    return packed.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(run, "h1 bigint, h2 bigint, h3 bigint, a bigint")


def _first_scan(slim: DataFrame, seed: int, head: int) -> DataFrame:
    """Word counts (with ``lang`` and ``word``), and counts of phrases that hold 1 / 2^head of a stretch (without)."""

    def run(batches):
        for numbers, pool in _stretches(batches, seed):
            hashes, n = np.array(pool.hashes), np.bincount(numbers, minlength=len(pool.hashes))
            for lang, own, words in pool.words():
                out, langs = _rows(hashes, own[:, None], n[own]), pa.repeat(pa.scalar(lang, pa.string()), len(own))
                yield pa.RecordBatch.from_arrays([*out.columns, langs, pa.array(words, pa.binary())], [*out.schema.names, "lang", "word"])
            for length in range(2, LONGEST + 1):
                phrases, counts = _phrases(numbers, length)
                # one occurrence is no sign of a frequent phrase in a short stretch
                heavy = counts >= max(2, -(-len(numbers) >> head))
                out = _rows(hashes, phrases[heavy], counts[heavy])
                none = [pa.nulls(out.num_rows, t) for t in (pa.string(), pa.binary())]
                yield pa.RecordBatch.from_arrays([*out.columns, *none], [*out.schema.names, "lang", "word"])

    return slim.mapInArrow(run, COUNTS + ", lang string, word binary")


class DoubleArray:
    """Trie over word hashes: the child of state s by symbol c is at base[s] + c where ``check`` there names s."""

    def __init__(self, phrases: np.ndarray):
        """``phrases``: a row of hashes each, padded by 0."""
        self.symbols = np.unique(phrases[phrases != 0])
        code = np.where(phrases != 0, np.searchsorted(self.symbols, phrases) + 1, 0)
        order = np.lexsort(code.T[::-1])
        code, self.phrases = code[order], phrases[order]
        prefixes = {(): 0}
        children: list[list[int]] = [[]]
        for row in code.tolist():
            at = ()
            for c in row:
                if c == 0:
                    break
                if (*at, c) not in prefixes:
                    prefixes[*at, c] = len(children)
                    children[prefixes[at]].append(c)
                    children.append([])
                at = (*at, c)
        self._place(prefixes, children)
        accepting = [prefixes[tuple(c for c in row if c)] for row in code.tolist()]
        self.accepts = np.full(len(self.check), -1, np.int32)
        self.accepts[self.slot[accepting]] = np.arange(len(accepting))
        del self.slot

    def _place(self, prefixes: dict, children: list[list[int]]) -> None:
        """Give every node a base so that no two children share a slot; nodes with many children first."""
        size = max(64, 2 * len(children) + 2 * len(self.symbols))
        free = np.ones(size, bool)
        free[0] = False  # the root
        bases, rng = np.zeros(len(children), np.int64), np.random.default_rng(0)
        for node in sorted((i for i, c in enumerate(children) if c), key=lambda i: -len(children[i])):
            own = np.asarray(children[node])
            while True:
                for base in rng.integers(0, size - own[-1], 64).tolist() if own[-1] < size else ():
                    if free[own + base].all():
                        break
                else:
                    free, size = np.r_[free, np.ones(size, bool)], 2 * size
                    continue
                break
            free[own + base] = False
            bases[node] = base
        self.slot, parent = np.zeros(len(children), np.int64), np.zeros(len(children), np.int64)
        for path, node in prefixes.items():  # parents come before their children
            if path:
                parent[node] = prefixes[path[:-1]]
                self.slot[node] = bases[parent[node]] + path[-1]
        self.base, self.check = np.zeros(size, np.int32), np.full(size, -1, np.int32)
        self.base[self.slot] = bases
        self.check[self.slot[1:]] = self.slot[parent[1:]]

    def codes(self, hashes: np.ndarray) -> np.ndarray:
        """Symbols of hashes; 0 for a hash in no phrase."""
        if not len(self.symbols):
            return np.zeros(len(hashes), np.int64)
        at = np.minimum(np.searchsorted(self.symbols, hashes), len(self.symbols) - 1)
        return np.where(self.symbols[at] == hashes, at + 1, 0)

    def states(self, hashes: np.ndarray, numbers: np.ndarray) -> Iterator[np.ndarray]:
        """Per level, the phrase of the trie that ends there for every position, or -1."""
        symbols = np.r_[self.codes(hashes).astype(np.int32)[numbers], np.zeros(LONGEST, np.int32)]
        state = np.zeros(len(numbers), np.int32)
        for level in range(LONGEST):
            state = self.advance(state, symbols[level : len(numbers) + level])
            yield np.where(state >= 0, self.accepts[state], np.int32(-1))

    def advance(self, state: np.ndarray, symbols: np.ndarray) -> np.ndarray:
        """The next state of each position, or -1."""
        to = np.minimum(self.base[np.maximum(state, 0)] + symbols, len(self.check) - 1)
        return np.where((state >= 0) & (symbols > 0) & (self.check[to] == state), to, -1).astype(np.int32)


def _pair_place(a, b):
    """Hash of two words' hashes, the same for arrays and for columns."""
    if isinstance(a, np.ndarray):
        turned = a.view(np.uint64) << np.uint64(7) | a.view(np.uint64) >> np.uint64(57)
        return turned.view(np.int64) ^ b
    return F.shiftleft(a, 7).bitwiseXOR(F.shiftrightunsigned(a, 57)).bitwiseXOR(b)


def _trie_scan(slim: DataFrame, seed: int, trie, may_be, buckets: int) -> DataFrame:
    """Packed counts of the phrases in the trie, and of two-word phrases beside it whose words may be frequent."""

    def run(batches):
        tree, marked = trie(), may_be()
        for numbers, pool in _stretches(batches, seed):
            hashes, counts = np.array(pool.hashes), np.zeros(len(tree.phrases), np.int64)
            able = marked(hashes)[numbers]
            able[:-1] &= able[1:]
            able[-1:] = False
            for level, accepted in enumerate(tree.states(hashes, numbers)):
                counts += np.bincount(accepted[accepted >= 0], minlength=len(counts))
                if level == 1:
                    able &= accepted < 0
            del accepted
            for length in range(2, LONGEST + 1):
                met = np.flatnonzero((counts > 0) & ((tree.phrases != 0).sum(axis=1) == length))
                yield from _packed(tree.phrases[met, :length], counts[met], buckets)
            phrases, n = _phrases(numbers, 2, able)
            del numbers, pool, able  # a task holds one stretch at a time
            yield from _packed(phrases, n, buckets, hashes)
            del phrases, n

    return slim.mapInArrow(run, PACKED)


def _rest_scan(slim: DataFrame, seed: int, trie, may_be, buckets: int) -> DataFrame:
    """Packed counts of three-word phrases beside the trie whose first two and last two words may be frequent phrases."""

    def run(batches):
        tree, marked = trie(), may_be()
        for numbers, pool in _stretches(batches, seed):
            hashes = np.array(pool.hashes)
            h = hashes[numbers]
            able = np.r_[marked(_pair_place(h[:-1], h[1:])), False]
            del h
            able[:-1] &= able[1:]
            for accepted in tree.states(hashes, numbers):
                pass
            able &= accepted < 0
            del accepted
            phrases, n = _phrases(numbers, 3, able)
            del numbers, pool, able  # a task holds one stretch at a time
            yield from _packed(phrases, n, buckets, hashes)
            del phrases, n

    return slim.mapInArrow(run, PACKED)


def _summed(rows: DataFrame, least: int) -> DataFrame:
    return rows.groupBy("h1", "h2", "h3").agg(F.sum("n").alias("a")).filter(F.col("a") >= least)


def _score(a: Column, left: Column, right: Column) -> Column:
    """floor(1000000 a a / (l r)) in decimals: counts of up to 15 digits."""
    wide = [x.cast("decimal(15,0)") for x in (a, a, left, right)]
    return F.call_function("div", (wide[0] * wide[1]) * F.lit(1_000_000).cast("decimal(7,0)"), wide[2] * wide[3])


def phrase_collocations(
    docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = 10, first: int = 2000, cover: int = 50,
    head: int = HEAD, bits: int = BITS,
) -> DataFrame:
    """The ``first`` collocations of every language: lang, rank, phrase, a, l, r, n, score.

    Texts are lower-cased (A-Z), cut into pieces at ``. , ; : ! ?`` and line ends, and pieces into words at blanks and
    tabs. Phrases are two or three words in a piece with ``least`` occurrences or more, all counted. A phrase is scored
    by its weakest cut, floor(10^6 a a / (l r)); ties go to the first. A phrase that a longer one holds, which has
    ``cover`` percent of its occurrences or more, is left out. Order: score and ``a`` descending, then phrase. A null
    language counts as ``und``; null, empty and repeated texts count as they are, and a language without phrases
    has no rows, like an empty table. Other columns are not read.
    """
    spark = docs.sparkSession
    slim = docs.select(F.col(lang_col).cast("string").alias("lang"), text_bytes(text_col).alias("text"))
    for seed in range(8):
        counts = written(_first_scan(slim, seed, head), "words")
        name = F.struct("lang", "word")
        words = counts.filter("word is not null").groupBy("h1").agg(F.sum("n").alias("f"), F.min(name).alias("name"), F.max(name).alias("other"))
        words = written(words, "vocabulary")
        if words.filter("h1 = 0 or name <> other").isEmpty():  # else two words share a hash: another seed
            break
    else:
        raise ValueError("no seed tells the words apart")
    totals = words.groupBy(F.col("name.lang").alias("lang")).agg(F.sum("f").alias("n"))
    frequent = words.filter(F.col("f") >= least)
    all_words = totals.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    heavy = _summed(counts.filter("word is null"), max(least, -(-all_words >> head)))
    got = heavy.select("h1", "h2", F.coalesce("h3", F.lit(0)).alias("h3")).toPandas().to_numpy(np.int64).reshape(-1, LONGEST)
    trie = shared(spark, DoubleArray(got))
    may_be = shared_bits(spark, bitmap_of(frequent, F.col("h1"), bits), bits)
    buckets = 1 + (all_words >> BUCKET)
    second = written(_summed_buckets(_trie_scan(slim, seed, trie, may_be, buckets), least, all_words), "phrases")
    twos = second.filter("h3 is null").select("h1", "h2", "a")
    may_be = shared_bits(spark, bitmap_of(twos, _pair_place(F.col("h1"), F.col("h2")), bits), bits)
    rest = _summed_buckets(_rest_scan(slim, seed, trie, may_be, buckets), least, all_words)
    threes = written(second.filter("h3 is not null").unionByName(rest).select("h1", "h2", "h3", "a"), "phrases")

    def word(side: str) -> DataFrame:
        return frequent.select(F.col("h1").alias(f"h{side}"), F.col("f").alias(f"f{side}"), F.col("name.word").alias(f"w{side}"), F.col("name.lang").alias(f"lang{side}"))

    pairs = salted_join(salted_join(twos, word("1"), ["h1"], ["h2"], sparse=True), word("2"), ["h2"], ["h1"], sparse=True)
    inside = threes.select(F.explode(F.array(F.struct("h1", "h2"), F.struct(F.col("h2").alias("h1"), F.col("h3").alias("h2")))).alias("x"), "a")
    most = inside.groupBy("x.h1", "x.h2").agg(F.max("a").alias("longer"))
    pairs = pairs.join(most, ["h1", "h2"], "left").filter(F.coalesce(F.col("longer") * 100 < F.col("a") * cover, F.lit(True)))
    scored = pairs.select(
        F.col("lang1").alias("lang"), F.concat_ws(" ", F.col("w1").cast("string"), F.col("w2").cast("string")).alias("phrase"), "a",
        F.col("f1").alias("l"), F.col("f2").alias("r"), _score(F.col("a"), F.col("f1"), F.col("f2")).alias("score"),
    )
    sides = [("1", ["h2", "h3"]), ("2", ["h1", "h3"]), ("3", ["h1", "h2"])]
    triples = threes
    for side, others in sides:
        triples = salted_join(triples, word(side), [f"h{side}"], others, sparse=True)
    triples = triples.join(twos.select("h1", "h2", F.col("a").alias("f12")), ["h1", "h2"])
    triples = triples.join(twos.select(F.col("h1").alias("h2"), F.col("h2").alias("h3"), F.col("a").alias("f23")), ["h2", "h3"])
    cuts = [F.struct(_score(F.col("a"), F.col(x), F.col(y)).alias("score"), F.lit(k).alias("k"), F.col(x).alias("l"), F.col(y).alias("r")) for k, x, y in ((1, "f1", "f23"), (2, "f12", "f3"))]
    cut = triples.withColumn("cut", F.least(*cuts))
    more = cut.select(
        F.col("lang1").alias("lang"), F.concat_ws(" ", *[F.col(f"w{k}").cast("string") for k in "123"]).alias("phrase"), "a", "cut.l", "cut.r", "cut.score"
    )
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase").asc()]
    ranked = top_n_per_key(scored.unionByName(more), ["lang"], order, first, "rank", ["phrase"])
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("bigint"), "phrase", "a", "l", "r", "n", "score")
