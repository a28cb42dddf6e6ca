"""Language identification: word frequencies first, shorter and shorter character n-grams for unseen words."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import written
from .common import LETTERS_ONLY, shared, text_bytes, unclaimed

UNKNOWN = "und"
ENTRIES_HELD = 300_000
LONGEST = 4
#: Characters of a word that its n-grams are taken from; longer strings are cut into such pieces.
WORD_PIECE = 40


def word_counts(docs: DataFrame, learn: Column, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, word, n) over the whole texts that are learned from; words are runs of letters and other non-ASCII."""

    def run(batches):
        held: dict[str, Counter] = {}

        def rows():
            langs = [k for k, c in held.items() for _ in c]
            words = [w for c in held.values() for w in c]
            counts = [n for c in held.values() for n in c.values()]
            held.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array(langs, pa.string()), pa.array(words, pa.binary()), pa.array(counts, pa.int64())], ["lang", "word", "n"]
            )

        for batch in batches:
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held.setdefault(lang, Counter()).update(text.translate(LETTERS_ONLY).split())
                if sum(map(len, held.values())) >= ENTRIES_HELD:
                    yield rows()
        yield rows()

    slim = docs.filter(learn & F.col(lang_col).isNotNull()).select(
        text_bytes(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")
    )
    return slim.mapInArrow(run, "lang string, word binary, n bigint").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def gram_counts(words: DataFrame) -> DataFrame:
    """(lang, gram, n): character n-grams of 1 to LONGEST characters over the distinct words."""

    def run(batches):
        held: dict[str, Counter] = {}
        for batch in batches:
            for lang, word in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                text = word.decode("utf-8", "replace").lower()
                own = held.setdefault(lang, Counter())
                for at in range(0, len(text), WORD_PIECE):
                    padded = f"^{text[at : at + WORD_PIECE]}$"
                    own.update([padded[i : i + n] for n in range(1, LONGEST + 1) for i in range(len(padded) - n + 1)])
            if sum(map(len, held.values())) >= ENTRIES_HELD:
                yield _gram_rows(held)
        yield _gram_rows(held)

    slim = words.select("lang", "word")
    return slim.mapInArrow(run, "lang string, gram string, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def _gram_rows(held: dict[str, Counter]) -> pa.RecordBatch:
    out = pa.RecordBatch.from_arrays([
        pa.array([k for k, c in held.items() for _ in c], pa.string()), pa.array([g for c in held.values() for g in c], pa.string()),
        pa.array([n for c in held.values() for n in c.values()], pa.int64()),
    ], ["lang", "gram", "n"])
    held.clear()
    return out


class Backoff:
    """log10 frequency of words and n-grams per language."""

    def __init__(self, langs: list[str], words: dict[bytes, np.ndarray], grams: dict[str, np.ndarray], discount: float):
        """Counts per language; discount: log10 lost with every step to a shorter n-gram."""
        self.langs, n = langs, len(langs)
        everything = sum(words.values(), np.zeros(n))
        self.words = pa.array(list(words), pa.binary())
        table = np.array(list(words.values())).reshape(len(words), n)
        self.word_logs = np.log10((table + 0.5) / (everything + 0.5))
        totals = {k: sum((v for g, v in grams.items() if len(g) == k), np.zeros(n)) for k in range(1, LONGEST + 1)}
        self.grams = {g: i for i, g in enumerate(grams)}
        self.gram_logs = np.array([
            np.log10((v + 0.5) / (totals[len(g)] + 0.5)) - discount * (LONGEST - len(g)) for g, v in grams.items()
        ]).reshape(len(grams), n)

    def _places(self, word: bytes) -> list[int]:
        """The longest known n-gram that starts at each place of a word."""
        text, out, known = word.decode("utf-8", "replace").lower(), [], self.grams
        for at in range(0, len(text), WORD_PIECE):
            padded = f"^{text[at : at + WORD_PIECE]}$"
            for i in range(len(padded) - 1):
                for k in range(LONGEST, 0, -1):
                    if (found := known.get(padded[i : i + k])) is not None:
                        out.append(found)
                        break
        return out

    def unseen(self, words: list[bytes]) -> np.ndarray:
        """Mean over the places of each word; 0 where no n-gram is known."""
        places = [self._places(w) for w in words]
        sizes = np.fromiter(map(len, places), np.int64, len(places))
        out = np.zeros((len(words), len(self.langs)))
        if sizes.sum():
            flat = np.concatenate([np.array(p, np.int64) for p in places if p])
            starts = (np.cumsum(sizes) - sizes)[sizes > 0]
            out[sizes > 0] = np.add.reduceat(self.gram_logs[flat], starts, axis=0) / sizes[sizes > 0, None]
        return out

    def tables(self, distinct: list[bytes]) -> np.ndarray:
        """Scores of distinct words, one row each."""
        out = np.zeros((len(distinct), len(self.langs)))
        places = pc.index_in(pa.array(distinct, pa.binary()), value_set=self.words) if len(self.words) else pa.nulls(len(distinct), pa.int32())
        place = places.fill_null(-1).to_numpy(zero_copy_only=False)
        out[place >= 0] = self.word_logs[place[place >= 0]]
        new = np.flatnonzero(place < 0)
        out[new] = self.unseen([distinct[i] for i in new])
        return out


def _posterior(total: np.ndarray, n: int) -> tuple[int, float]:
    """Best language, and its share when scores per word count for at most 30 words."""
    mean = total / n * min(n, 30) * np.log(10)
    shares = np.exp(mean - mean.max())
    best = int(np.argmax(total))
    return best, float(shares[best] / shares.sum())


def train(docs: DataFrame, learn: Column, text_col: str = "text", lang_col: str = "lang", known_words: int = 50_000,
          known_grams: int = 100_000, discount: float = 0.4) -> Backoff:
    """Counts are taken over all rows that may be learned from. A word is known when a language gives it 1 /
    ``known_words`` of that language's words or more, an n-gram likewise: so many per language at most."""
    counts = written(word_counts(docs, learn, text_col, lang_col), "words")
    grams = written(gram_counts(counts), "grams")

    def frequent(rows: DataFrame, key: str, groups: list[str], share: int) -> list:
        """Keys that are frequent in one language, with their counts in all."""
        totals = rows.groupBy(*groups).agg(F.sum("n").alias("all"))
        keys = rows.join(totals, groups).filter(F.col("n") * share >= F.col("all")).select(key).distinct()
        return rows.join(keys, key, "left_semi").select(key, "lang", "n").collect()

    langs = sorted(r["lang"] for r in counts.select("lang").distinct().collect())
    at = {lang: i for i, lang in enumerate(langs)}
    grams = grams.withColumn("size", F.length("gram"))
    out: list[dict] = []
    for rows in (frequent(counts, "word", ["lang"], known_words), frequent(grams, "gram", ["lang", "size"], known_grams)):
        table: dict = {}
        for key, lang, n in rows:
            table.setdefault(bytes(key) if isinstance(key, bytearray) else key, np.zeros(len(langs)))[at[lang]] = n
        out.append(table)
    return Backoff(langs, out[0], out[1], discount)


def predict(docs: DataFrame, model: Backoff, keep: dict[str, Column], text_col: str = "text") -> DataFrame:
    """The columns of ``keep``, ``lang_pred`` and ``score`` of every row; ``keep`` with these names is a ValueError."""
    unclaimed(keep, "_text", "lang_pred", "score")
    get = shared(docs.sparkSession, model)
    slim = docs.select(*[c.alias(k) for k, c in keep.items()], text_bytes(text_col).alias("_text"))
    names = list(keep)
    schema = slim.drop("_text").schema.add("lang_pred", "string").add("score", "double")

    def run(batches):
        backoff = get()
        cache: dict[bytes, int] = {}
        tables = np.empty((0, len(backoff.langs)))
        for batch in batches:
            if len(cache) > ENTRIES_HELD:
                cache, tables = {}, tables[:0]
            langs, scores = [], []
            texts = batch.column(len(names)).to_pylist()
            numbers = [
                np.fromiter((cache.setdefault(w, len(cache)) for w in words), np.int64, len(words))
                for words in (t.translate(LETTERS_ONLY).split() for t in texts)
            ]
            if len(cache) > len(tables):
                tables = np.vstack([tables, backoff.tables(list(cache)[len(tables) :])])
            for text, own in zip(texts, numbers, strict=True):
                if not backoff.langs or not len(own) or not any(map(str.isalpha, text.decode("utf-8", "replace"))):
                    langs.append(UNKNOWN)
                    scores.append(0.0)
                else:
                    best, share = _posterior(tables[own].sum(axis=0), len(own))
                    langs.append(backoff.langs[best])
                    scores.append(share)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[: len(names)], pa.array(langs, pa.string()), pa.array(scores, pa.float64())],
                [*names, "lang_pred", "score"],
            )

    return slim.mapInArrow(run, schema)


def identify_languages(docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Per input row: id, ``held_out``, ``lang_pred``, ``score`` (0 to 1).

    Learns from rows that are not held out and have a language. A null or letterless text, and any text when there
    is nothing to learn from, is ``und`` with score 0. Ties go to the language first in the alphabet. Repeated rows
    give repeated rows, an empty table none. Whole texts are read; other columns are not.
    """
    model = train(docs, ~held_out, text_col, lang_col)
    return predict(docs, model, {id_col: F.col(id_col), "held_out": held_out}, text_col)
