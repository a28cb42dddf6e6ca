"""Ranked search against a score of every document for every item."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from opinionweave.llm import impact_search

RUNS = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def terms(text):
    return RUNS.findall((text or "").encode().lower())


def plain_search(docs, items, k=10):
    counts = [(i, Counter(terms(t))) for i, t in docs]
    counts = [(i, c, c.total()) for i, c in counts if c]
    n_docs, tokens = len(counts), sum(n for *_, n in counts)
    df = Counter(t for _, c, _ in counts for t in c)
    asked = {}
    for item, text in items:
        asked.setdefault(item, set()).update(terms(text))
    out = set()
    for item, own in asked.items():
        scored = []
        for i, c, n in counts:
            m = 10 + (90 * n * n_docs) // tokens
            score = sum(
                math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t in own if c[t]
            )
            if score > 0:
                scored.append((-score, i is None, i or 0, i))
        out |= {(item, rank, i, -s) for rank, (s, _, _, i) in enumerate(sorted(scored)[:k], 1)}
    return out


def collection(seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(300)] + ["É", "the", "x9"]
    pick = lambda n: " ".join(words[int(len(words) * rng.random() ** 2)] for _ in range(n))
    docs = [(i, pick(rng.choice([1, 5, 40, 200]))) for i in range(300)]
    docs += [(400 + i, docs[7][1].upper()) for i in range(25)] + [(500, None), (501, "?!"), (7, docs[7][1]), (None, docs[7][1] + " w3")]
    items = [(i, docs[rng.randrange(300)][1] + "; " + pick(3)) for i in range(20)] + [(30, None), (31, "never seen"), (32, "W7,w8"), (32, "w9"), (None, "the É")]
    rng.shuffle(docs)
    return docs, items


@pytest.mark.parametrize("block", [1 << 18, 50])
def test_ranked_search(spark, docs_of, monkeypatch, block):
    """Small buckets and chunks, and queries in one block or in many."""
    monkeypatch.setattr(impact_search, "BUCKET", 16)
    monkeypatch.setattr(impact_search, "CHUNK", 40)
    docs, items = collection(1)
    asked = spark.createDataFrame(items, "item_id bigint, text string")
    got = impact_search.ranked_search(docs_of(docs).repartition(3), asked, block_terms=block).collect()
    want = plain_search(docs, items)
    assert {(r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in got} == want and len(got) == len(want)
    fewer = impact_search.ranked_search(docs_of(docs), asked, k=2).collect()
    assert {(r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in fewer} == {x for x in want if x[1] <= 2}


def test_bounds_pass_over_rows():
    """Bars rise in the first buckets, so that few of the later rows are scored, and all of the best are found."""
    rng = np.random.default_rng(3)
    docs = [(np.sort(rng.choice(400, 12, replace=False)), rng.integers(1, 10**6 if i < 300 else 10**4, 12)) for i in range(6000)]
    block = impact_search.Block([{"item": 0, "terms": [{"term": t, "weight": 100 * t + 1} for t in range(0, 400, 9)]}], 10)
    sizes = np.full(len(docs), 12)
    found = list(block.search(sizes, np.concatenate([t for t, _ in docs]), np.concatenate([x for _, x in docs])))
    best = sorted((s for _, _, score in found for s in score.tolist()), reverse=True)[:10]
    every = sorted((sum((100 * t + 1) * x for t, x in zip(ts.tolist(), xs.tolist()) if t % 9 == 0) for ts, xs in docs), reverse=True)[:10]
    assert best == every and block.scored < 1500


def test_odd_rows(spark, odd_docs, no_docs):
    items = spark.createDataFrame([(1, "MIT w5"), (2, ""), (2, None), (3, "é")], "item_id bigint, text string").withColumns({"rank": F.lit(1), "score": F.lit("x")})
    got = impact_search.ranked_search(odd_docs, items).collect()
    assert {r["item_id"] for r in got} == {1, 3} and [r["doc_id"] for r in got if r["item_id"] == 3] == [7]
    assert sorted(r["doc_id"] for r in got if r["item_id"] == 1) == [4, 4, 5]
    assert impact_search.ranked_search(no_docs, items).collect() == []
    assert impact_search.ranked_search(odd_docs, items.limit(0)).collect() == []
    named = impact_search.ranked_search(odd_docs.withColumn("doc_id", F.concat(F.lit("d"), "doc_id")), items.withColumn("item_id", F.col("item_id").cast("string")))
    assert {(r["item_id"], r["doc_id"]) for r in named.collect()} == {("1", "d4"), ("1", "d5"), ("3", "d7")}
