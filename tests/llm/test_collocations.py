"""Phrase collocations against plain counts."""

import random
import re
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from opinionweave.llm import collocations


def plain_collocations(rows, least=10, first=2000, cover=50):
    counts, totals = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", lower):
            words = [w for w in re.split("[ \t]+", piece) if w]
            totals[lang] += len(words)
            for k in (1, 2, 3):
                for i in range(len(words) - k + 1):
                    counts[lang, *words[i : i + k]] += 1
    candidates = {p: a for p, a in counts.items() if len(p) > 2 and a >= least}
    longer = Counter()
    for (lang, *w), a in candidates.items():
        if len(w) == 3:
            for part in ((lang, *w[:2]), (lang, *w[1:])):
                longer[part] = max(longer[part], a)
    out = {}
    for (lang, *w), a in candidates.items():
        if len(w) == 3 or 100 * longer[lang, *w] < cover * a:
            cuts = [(10**6 * a * a // (counts[lang, *w[:k]] * counts[lang, *w[k:]]), k) for k in range(1, len(w))]
            score, k = min(cuts)
            out.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), counts[lang, *w[:k]], counts[lang, *w[k:]]))
    return {
        (lang, rank, p.decode(), -a, left, right, totals[lang], -s)
        for lang, found in out.items() for rank, (s, a, p, left, right) in enumerate(sorted(found)[:first], 1)
    }


def corpus(seed, n=120):
    rng = random.Random(seed)
    words = ["the", "of", "New", "york", "City", "é", "ça", "l'eau", "\x1c", "a\x0bb", *(f"w{i}" for i in range(60))]
    rows = []
    for _ in range(n):
        parts = []
        for _ in range(rng.randint(0, 60)):
            parts.append(words[int(len(words) * rng.random() ** 3)] + rng.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", "; "]))
            if rng.random() < 0.1:
                parts.append("new york city ")
        rows.append((rng.choice(["en", "fr", "und", None]), "".join(parts)))
    return rows + [("en", None), ("en", ""), (None, " .\n. "), ("de", "one word"), ("xx", "a a a a a a a a a a a a a A")]


def frame(spark, rows):
    return spark.createDataFrame(rows, "lang string, text string").repartition(3)


def listed(df):
    return [tuple(r) for r in df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()]


@pytest.mark.parametrize(("head", "bits", "stretch"), [(18, 26, 1 << 22), (6, 16, 200), (0, 15, 500)])
def test_collocations(spark, monkeypatch, head, bits, stretch):
    """Most phrases in the trie, few, and hardly any, with bitmaps that mark too much."""
    monkeypatch.setattr(collocations, "STRETCH", stretch)
    rows = corpus(1)
    got, want = listed(collocations.phrase_collocations(frame(spark, rows), head=head, bits=bits)), plain_collocations(rows)
    assert set(got) == want and len(got) == len(want) and {"en", "fr", "und", "xx"} == {r[0] for r in got}


def test_first_and_cover(spark):
    rows = corpus(2)
    got = listed(collocations.phrase_collocations(frame(spark, rows), least=5, first=7, cover=80))
    assert set(got) == plain_collocations(rows, 5, 7, 80)


def test_scores_past_64_bits(spark):
    big = spark.createDataFrame([(10**12, 3 * 10**12, 10**13)], "a bigint, l bigint, r bigint")
    assert big.select(collocations._score(F.col("a"), F.col("l"), F.col("r"))).first()[0] == 10**30 // (3 * 10**25)


def test_trie_accepts_just_its_phrases():
    rng = np.random.default_rng(4)
    words = np.unique(rng.integers(-(2**62), 2**62, 500))
    phrases = {tuple(words[rng.zipf(1.3, k) % len(words)]) for k in rng.integers(2, 4, 4000)}
    trie = collocations.DoubleArray(np.asarray([[*p, 0][:3] for p in phrases], np.int64))
    text = words[rng.zipf(1.3, 5000) % len(words)]
    symbols = np.r_[trie.codes(text), 0, 0]
    state = np.zeros(len(text), np.int64)
    for level in range(3):
        state = trie.advance(state, symbols[level : len(text) + level])
        for i in range(len(text) - level):
            path = tuple(text[i : i + level + 1])
            accepted = trie.accepts[state[i]] if state[i] >= 0 else -1
            assert (accepted >= 0) == (path in phrases)
            assert accepted < 0 or tuple(x for x in trie.phrases[accepted] if x) == path


def test_counts_by_bucket(spark, monkeypatch):
    """Many buckets and partitions give the same counts as one, and batches keep to their size."""
    monkeypatch.setattr(collocations, "BUCKET", 4)
    monkeypatch.setattr(collocations, "PARTITION", 7)
    rows = corpus(3)
    assert set(listed(collocations.phrase_collocations(frame(spark, rows), head=3))) == plain_collocations(rows)


def test_packed_counts_add_up():
    rng = np.random.default_rng(5)
    whole, packed = Counter(), {}
    for length in (2, 3, 2):
        phrases = np.unique(rng.integers(-(2**62), 2**62, (40, length))[rng.integers(0, 40, 60)], axis=0)
        counts = rng.integers(1, 9, len(phrases))
        whole.update(dict(zip(map(tuple, phrases.tolist()), counts.tolist(), strict=True)))
        for batch in collocations._packed(phrases, counts, 7):
            assert batch.nbytes < 2 * collocations.BATCH
            for bucket, some, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                packed.setdefault(bucket, []).append((some, n))
    got = {}
    for bucket, cells in packed.items():
        out = collocations._merged(bucket % 4, [x for x, _ in cells], [n for _, n in cells], 3)
        got |= {tuple(v for v in (r["h1"], r["h2"], r["h3"]) if v is not None): r["a"] for r in out.to_pylist()}
    assert len(packed) > 7 and got == {p: n for p, n in whole.items() if n >= 3}
    assert not list(collocations._packed(np.empty((0, 2), np.int64), np.empty(0, np.int64), 7))


def test_many_words_in_one_text():
    numbers = np.array([1, 2**30, 5, 0, 1, 2**30, 5, 7])
    phrases, counts = collocations._phrases(numbers, 3)
    assert dict(zip(map(tuple, phrases.tolist()), counts.tolist(), strict=True)) == {(1, 2**30, 5): 2, (2**30, 5, 7): 1}


def test_odd_rows(odd_docs, no_docs):
    got = collocations.phrase_collocations(odd_docs.withColumns({"a": odd_docs["doc_id"], "rank": odd_docs["text"]})).collect()
    assert len(got) == 977 and {r["a"] for r in got} == {61, 62} and {r["n"] for r in got} == {60_000 + 4 + 3 + 1 + 1}
    assert collocations.phrase_collocations(no_docs).collect() == []


def test_a_scan_holds_little_beside_its_stretch():
    """Bytes a position of the last scan, with every phrase met once and beside the trie."""
    rng = random.Random(12)
    n = 300_000
    vocabulary = [f"w{i}" for i in range(20_000)]
    batch = pa.table({"lang": ["en"] * 30, "text": [" ".join(rng.choices(vocabulary, k=n // 30)).encode() for _ in range(30)]}).to_batches()
    tree = collocations.DoubleArray(np.empty((0, 3), np.int64))

    class Slim:
        def mapInArrow(self, run, schema):  # noqa: N802
            return run

    run = collocations._rest_scan(Slim(), 0, lambda: tree, lambda: lambda h: np.ones(len(h), bool), 10)
    tracemalloc.start()
    counted = sum(len(c.as_py()) // 4 for b in run(batch) for c in b.column(2))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert 0.99 * n < counted <= n
    assert peak < 100 * n
