"""License scan, quality, LM scoring and language ID against plain versions and held-out accuracy."""

import math
import random
import re
import zlib
from collections import Counter

import pyarrow as pa
from pyspark.sql import functions as F

from opinionweave.llm import language, licenses, quality, suffix_tree
from opinionweave.llm.common import remainder

LABELS = "doc_id bigint, quality int, toxic int"


def invented(rng, parts, n):
    return " ".join("".join(rng.choice(parts) for _ in range(rng.randint(1, 3))) for _ in range(n))


def plain_base(text):
    words = re.findall(r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    hits = [
        (i, label) for phrase, label in licenses.PHRASES for p in [phrase.split()]
        for i in range(len(words) - len(p) + 1) if words[i : i + len(p)] == p
    ]
    return len(words), len(hits), min((i for i, _ in hits), default=None), max((i for i, _ in hits), default=None), ",".join(sorted({x for _, x in hits}))


def test_license_base_columns(docs_of):
    rng = random.Random(1)
    vocabulary = "mit license apache general public the under MIT. License gnu É2 x".split()
    texts = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 60))) for _ in range(200)] + [None, ""]
    got = {r["doc_id"]: r for r in licenses.scan_licenses(docs_of(texts)).collect()}
    for i, t in enumerate(texts):
        r = got[i]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == plain_base(t)


def test_license_phrases_inside_templates(docs_of):
    """A phrase counts after any number of the words that precede it in a template, and so do nested phrases."""
    texts = []
    for template, _ in licenses.TEMPLATES:
        words = template.split()
        for phrase, _ in licenses.PHRASES:
            n = len(phrase.split())
            texts += [" ".join([*words[start : i + n], "x"]) for i in range(len(words)) if words[i : i + n] == phrase.split() for start in range(i + 1)]
            texts += [template] * (phrase in template)
    texts += ["Licensed under the Apache License, Version 2.0", "released under the MIT license", "GNU General Public License version 3"]
    assert len(texts) > 40
    got = {r["doc_id"]: r for r in licenses.scan_licenses(docs_of(texts)).collect()}
    for i, t in enumerate(texts):
        r = got[i]
        assert r["n_base"] == 1 and (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == plain_base(t)
    nested = licenses.Scanner((("x a b c d", "t"),), (("a b c", "long"), ("b c", "short")), 3, 0.6, 12).scan(b"x a b c d b c")
    assert nested[1:5] == (3, 1, 5, "long,short")


def test_license_statistics_are_longest_fragments():
    """The automaton's lengths against all substrings of the templates."""
    rng = random.Random(2)
    words = "a b c d".split()
    templates = [(" ".join(rng.choice(words) for _ in range(9)), "x") for _ in range(3)]
    scanner = licenses.Scanner(templates, (), 3, 0.6, 12)
    parts = {tuple(t.split()[i:j]) for t, _ in templates for i in range(9) for j in range(i + 1, 10)}
    for _ in range(30):
        text = [rng.choice([*words, "z"]) for _ in range(40)]
        found = {i: n for i, _, n in scanner.statistics([w.encode() for w in text])}
        for i in range(len(text)):
            longest = max((n for n in range(1, i + 2) if tuple(text[i + 1 - n : i + 1]) in parts), default=0)
            assert found.get(i, 0) == (longest if longest > 1 else 0)


def test_license_spans(docs_of):
    bsd = next(t for t, x in licenses.TEMPLATES if x == "bsd").split()
    cut = " ".join([*bsd[:7], "also", "perhaps", *bsd[9:]])
    rows = licenses.scan_licenses(docs_of([f"some words {cut} more", " ".join(bsd[:6]), "Licensed under CC BY-NC 4.0."])).orderBy("doc_id").collect()
    assert [r["labels"] for r in rows] == ["bsd", "", "cc-by-nc"]
    assert rows[0]["spans"][0]["first"] == 2 and 0.8 < rows[0]["score"] < 1 and rows[0]["n_base"] == 0


def test_quality_held_out(spark, docs_of):
    rng = random.Random(3)
    rows, marks = [], []
    for i in range(400):
        good = rng.random() < 0.7
        text = invented(rng, ["ta", "re", "mi", "no"], rng.randint(5, 80))
        rows.append((i, text if good else text.upper().replace(" ", "!! ")))
        marks.append((i, int(good), 0))
    labels = spark.createDataFrame(marks, LABELS)
    got = quality.quality_scores(docs_of(rows), labels, remainder(5) == 0).join(labels, "doc_id").collect()
    assert len(got) == 400 and all(0 <= r["score"] <= 1 for r in got)
    held = [r for r in got if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)
    assert sum((r["score"] >= 0.5) == r["quality"] for r in held) >= 0.97 * len(held)


def test_isotonic_is_rising():
    knots, levels = quality.isotonic([0, 1, 2, 3], [3, 1, 2, 4], [4, 4, 4, 4])
    assert list(knots) == [0, 2, 3, 3] and list(levels) == [0.5, 0.5, 1.0, 1.0]


def plain_lm(rows, held):
    split = {i: [*(t or "").encode().lower().split(), b"\0end"] for i, t in rows}
    counts = Counter(w for i, _ in rows if not held(i) for w in split[i])
    n, v = sum(counts.values()), len(counts)
    score = lambda w: math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1)))
    return n, {i: (len(w), sum(counts[x] > 0 for x in w), sum(map(score, w))) for i, w in split.items()}


def test_lm_base_and_tree(docs_of):
    rng = random.Random(4)
    rows = [(i, invented(rng, ["ba", "ce", "di", "É"], rng.randint(0, 60))) for i in range(150)] + [(150, None), (151, "never seen words qqq")]
    held = lambda i: zlib.crc32(str(i).encode()) % 10 == 0
    n, want = plain_lm(rows, held)
    for frequent in (400_000, 5):  # all words sent to the tasks; nearly all joined
        got = suffix_tree.lm_scores(docs_of(rows), remainder(10) == 0, frequent_words=frequent).collect()
        for r in got:
            tokens, known, base = want[r["doc_id"]]
            assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (tokens, known, n)
            assert abs(r["base_score"] - base) < 1e-9 * max(1, abs(base))
        out = [r for r in got if r["held_out"]]
        # the tree knows syllables, the base only words
        assert sum(r["score"] for r in out) > sum(r["base_score"] for r in out)


def test_tree_is_a_distribution():
    """Probabilities of all next symbols sum to 1, and the automaton agrees with the longest kept context."""
    texts = [b"abab abba", b"abaab", b"", b"bb"]
    depth = 3
    codes, counts = suffix_tree._windows(texts, depth)
    rows = Counter()
    for code, c in zip(codes.tolist(), counts.tolist(), strict=True):
        for d in range(depth + 1):
            tail = code & ((1 << 8 * (d + 1)) - 1)
            rows[d, tail >> 8, tail & 255] += c
    tree = suffix_tree.SuffixTree([(*k, c) for k, c in rows.items()], depth, 0.02)
    assert abs((10.0 ** tree.cost.astype(float)).sum(axis=1) - 1).max() < 1e-5
    at = {s: i for i, s in enumerate(tree.states)}
    for text in [*texts, b"abzab", b"a" * 2000]:
        total, past = 0.0, bytes([255]) * depth
        for c in text + b"\xff":
            state = next(past[i:] for i in range(len(past) + 1) if past[i:] in at)
            total += float(tree.cost[at[state], tree.number[c]])
            past = (past + bytes([c]))[-depth:]
        assert abs(tree.log10([text])[0] - total) < 1e-3


def test_language_held_out(docs_of):
    rng = random.Random(5)
    parts = {"aa": ["the", "ing", "th", "er"], "bb": ["le", "eau", "qu", "ai"], "cc": ["ung", "sch", "ei", "ü"]}
    rows = [(i, invented(rng, parts[x], rng.randint(3, 40)), x) for i, x in enumerate(rng.choice(list(parts)) for _ in range(300))]
    rows += [(300, None, "aa"), (301, "12 34 !", "aa"), (302, "", None), (303, "theeringth", None)]
    got = {r["doc_id"]: r for r in language.identify_languages(docs_of(rows), remainder(3) == 1).collect()}
    held = [i for i, _, _ in rows[:300] if got[i]["held_out"]]
    assert sum(got[i]["lang_pred"] == rows[i][2] for i in held) >= 0.97 * len(held)
    assert [got[i]["lang_pred"] for i in (300, 301, 302, 303)] == ["und", "und", "und", "aa"]
    assert all(0 <= r["score"] <= 1 for r in got.values())


def test_backoff_uses_shorter_grams():
    import numpy as np

    grams = {"^": np.array([1.0, 1.0]), "a": np.array([9.0, 1.0]), "b": np.array([1.0, 9.0]), "ab": np.array([1.0, 1.0])}
    model = language.Backoff(["x", "y"], {b"known": np.array([5.0, 1.0])}, grams, 0.4)
    assert list(np.argmax(model.unseen([b"aaaa", b"bbbb"]), axis=1)) == [0, 1]
    assert np.argmax(model.tables([b"known"])[0]) == 0


def test_odd_rows(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(4, 1, 0), (5, 0, 0), (4, None, 0), (None, 1, 1)], LABELS)
    nothing = spark.createDataFrame([], LABELS)
    operators = [
        lambda d: licenses.scan_licenses(d),
        lambda d: quality.quality_scores(d, labels, remainder(5) == 0),
        lambda d: quality.quality_scores(d, nothing, remainder(5) == 0),
        lambda d: suffix_tree.lm_scores(d, remainder(10) == 0),
        lambda d: suffix_tree.lm_scores(d, F.lit(True)),
        lambda d: language.identify_languages(d, remainder(3) == 1),
        lambda d: language.identify_languages(d, F.lit(True)),
    ]
    for run in operators:
        assert len(run(odd_docs).collect()) == 10
        assert run(no_docs).collect() == []


class Captured:
    """Stands for a table; keeps the function that tasks would run."""

    def __getattr__(self, name):
        return lambda *args: self

    def mapInArrow(self, run, schema):  # noqa: N802
        self.run = run
        return self


def test_windows_are_summed_before_they_are_handed_on(spark, monkeypatch):
    rng = random.Random(13)
    texts = [invented(rng, ["ba", "ce", "di", "É"], 40).encode() for _ in range(200)] + [b""]
    want = dict(zip(*(x.tolist() for x in suffix_tree._windows([b" ".join(t.lower().split()) for t in texts], 6)), strict=True))
    batches = pa.table({"text": texts}).to_batches(max_chunksize=50)
    monkeypatch.setattr(suffix_tree, "SYMBOLS_HELD", 500)

    def rows():
        docs = Captured()
        suffix_tree.corpus_counts(docs, F.lit(True), 6)
        return [(c, n) for b in docs.run(batches) for w, c, n in zip(*(x.to_pylist() for x in b.columns), strict=True) if w is None]

    assert sorted(rows()) == sorted(want.items())
    monkeypatch.setattr(suffix_tree, "WINDOWS_HELD", 300)  # handed on several times
    counts = Counter()
    for code, n in rows():
        counts[code] += n
    assert counts == want
