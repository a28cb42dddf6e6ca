import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from opinionweave.operators import text, vector_index, vectors


def shingle_set(t, size=5):
    words = " ".join(t.lower().split()).split(" ")
    return {tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))}


def jaccard(a, b):
    return len(a & b) / len(a | b)


@pytest.fixture(scope="module")
def corpus():
    rnd = random.Random(11)
    vocabulary = [f"w{i}" for i in range(400)]
    docs, i = [], 0
    for _ in range(25):
        base = [rnd.choice(vocabulary) for _ in range(rnd.randint(1, 150))]
        for _ in range(rnd.randint(1, 5)):
            copy = list(base)
            for _ in range(rnd.randint(0, max(1, len(base) // 30))):
                copy[rnd.randrange(len(copy))] = rnd.choice(vocabulary)
            docs.append((i, " ".join(copy)))
            i += 1
    docs += [(i + k, "Sama  persis\nsekali kata") for k in range(30)] + [(i + 30 + k, "sama persis sekali kata") for k in range(10)]
    rnd.shuffle(docs)
    return docs


def all_links(docs, size=5):
    """Smallest id of every text's component, by all pairs."""
    sets = {i: shingle_set(t, size) for i, t in docs}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in sets:
        for j in sets:
            if j < i and jaccard(sets[i], sets[j]) >= 0.8:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i in sets}


@pytest.mark.parametrize(("small", "chunk"), [(16, 256), (1, 3)])
def test_near_duplicates_are_all_links(spark, corpus, small, chunk):
    df = spark.createDataFrame(corpus, "doc_id long, text string")
    out = {r.doc_id: r.canonical_id for r in text.near_duplicates(df, spread=4, small=small, chunk=chunk).collect()}
    assert out == all_links(corpus)
    if small == 1:
        assert out == {r.doc_id: r.canonical_id for r in text.near_duplicates(df.repartition(7), shingle_size=5, small=2, chunk=2).collect()}


def test_links_between_others_than_the_first(spark):
    """Chains in which neighbours are linked and the ends are not, all in the buckets of one passage."""
    rnd = random.Random(5)
    docs = []
    for c in range(6):
        words = [f"p{i}" for i in range(80)] + [f"c{c}x{i}" for i in range(6)]
        for step in range(12):
            words[rnd.randrange(80, 86)] = f"c{c}s{step}"
            if step % 3 == 0:
                words[rnd.randrange(0, 80)] = f"c{c}t{step}"
            docs.append((1000 * rnd.randrange(1000) + len(docs), " ".join(words)))
    want = all_links(docs)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert {r.doc_id: r.canonical_id for r in text.near_duplicates(df, small=3, chunk=5).collect()} == want
    assert 1 < len(set(want.values())) < len(docs)


def test_unlike_texts_that_share_a_passage(spark):
    """Texts with a common passage and little else: bounds leave no pairs, no links."""
    common = " ".join(f"c{i}" for i in range(60))
    rows = [(i, common + " " + " ".join(f"t{i}x{j}" for j in range(200))) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert all(r.doc_id == r.canonical_id for r in text.near_duplicates(df).collect())
    sets = df.select(F.col("doc_id").alias("id"), text.shingles(F.col("text")).alias("s"))
    assert text.prefix_keys(sets, 0.8).count() == 0


def test_short_and_empty_texts(spark):
    df = spark.createDataFrame(
        [(1, "a"), (2, "a b"), (3, "a b c"), (4, ""), (5, ""), (6, None), (7, None)], "doc_id long, text string"
    )
    out = {r.doc_id: r.canonical_id for r in text.near_duplicates(df).collect()}
    assert out == {1: 1, 2: 2, 3: 3, 4: 4, 5: 4, 6: 6, 7: 7}


def test_missing_vectors(spark):
    rows = [(1, [1.0, 0.0]), (2, None), (3, [0.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    topics = spark.createDataFrame([(10, [1.0, 0.1]), (20, [0.0, 1.0])], "topic long, embedding array<double>")
    assert {r.vec_id: r.topic for r in vectors.nearest_centroid(df, topics).collect()} == {1: 10, 2: None, 3: 20}
    top = vectors.cosine_topk(df, topics, 5, query_id="topic")
    assert top.count() == 4 and top.filter("vec_id = 2").count() == 0


def test_exact_duplicates(spark):
    df = spark.createDataFrame([(1, "A  b", "en"), (2, "a b ", "en"), (3, "a b", "fr")], "doc_id long, text string, lang string")
    assert {(r.lang, r.kept_id, r.copies) for r in text.exact_duplicates(df).collect()} == {("en", 1, 2), ("fr", 3, 1)}


@pytest.fixture(scope="module")
def vecs():
    rnd = np.random.default_rng(2)
    base = rnd.normal(size=(200, 8))
    base[7] = base[3]
    base[9] = 0
    return base, rnd.normal(size=(12, 8))


def frame(spark, m, name):
    return spark.createDataFrame([(i, [float(x) for x in row]) for i, row in enumerate(m)], f"{name} long, embedding array<double>").repartition(3)


def sims(a, b):
    unit = lambda m: np.divide(m, np.linalg.norm(m, axis=1, keepdims=True), out=np.zeros_like(m), where=np.linalg.norm(m, axis=1, keepdims=True) > 0)
    return np.round(unit(a) @ unit(b).T, 6)


@pytest.mark.parametrize("block", [8192, 3])
def test_topk(spark, vecs, monkeypatch, block):
    monkeypatch.setattr(vector_index, "BLOCK_ROWS", block)
    monkeypatch.setattr(vector_index, "CHUNK_ROWS", 4 * block)
    base, q = vecs
    out = vectors.cosine_topk(frame(spark, base, "vec_id"), frame(spark, q, "query_id"), 5).collect()
    s = sims(base, q)
    want = {(j, r + 1): i for j in range(len(q)) for r, i in enumerate(sorted(range(len(base)), key=lambda i: (-s[i, j], i))[:5])}
    assert {(r.query_id, r.rank): r.vec_id for r in out} == want


def clustered(n=3000, seed=3):
    rnd = np.random.default_rng(seed)
    middle = rnd.normal(size=(40, 16))
    return middle[rnd.integers(40, size=n) * (rnd.random(n) < 0.7)] + 0.4 * rnd.normal(size=(n, 16))


def test_index_recall(spark):
    """A few of many cells find nearly all of the nearest; all cells find them all. One cell holds a third of the rows."""
    m = clustered()
    base = frame(spark, m, "vec_id")
    asked = base.filter("vec_id % 50 = 0").withColumnRenamed("vec_id", "query_id").repartition(2)
    index = vector_index.build_index(base, cells=32, sample=800)
    assert {r.id for r in index.chunks.select(F.explode("ids").alias("id")).collect()} == set(range(len(m)))
    exact = vector_index.cosine_topk(base, asked, 10)
    s = sims(m, m[::50])
    want = {(50 * j, r + 1): i for j in range(s.shape[1]) for r, i in enumerate(sorted(range(len(m)), key=lambda i: (-s[i, j], i))[:10])}
    assert {(r.query_id, r.rank): r.vec_id for r in exact.collect()} == want
    some = vector_index.index_topk(index, asked, 10, probes=6)
    measured = vector_index.recall(some, exact).first()
    assert (measured["queries"], measured["wanted"]) == (60, 600) and 0.9 <= measured["recall"] <= 1
    every = vector_index.index_topk(index, asked, 10, probes=32).collect()
    assert {(r.query_id, r.rank): r.vec_id for r in every} == want


def test_index_odd_rows(spark):
    rows = [(1, [1.0, 0.0]), (2, None), (3, [0.0, 0.0]), (4, [2.0, 0.0]), (4, [0.0, 1.0])]
    base = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    asked = spark.createDataFrame([(7, [3.0, 0.0]), (8, None)], "query_id long, embedding array<double>")
    index = vector_index.build_index(base, cells=4)
    for found in (vector_index.cosine_topk(base, asked, 3), vector_index.index_topk(index, asked, 3, probes=4)):
        assert [(r.query_id, r.vec_id, r.similarity) for r in found.orderBy("rank").collect()] == [(7, 1, 1.0), (7, 4, 1.0), (7, 3, 0.0)]
    nothing = vector_index.build_index(base.limit(0))
    assert vector_index.index_topk(nothing, asked, 3).collect() == [] and vector_index.cosine_topk(base.limit(0), asked, 3).collect() == []


@pytest.mark.parametrize("block", [8192, 3])
def test_nearest_centroid(spark, vecs, monkeypatch, block):
    monkeypatch.setattr(vectors, "BLOCK_ROWS", block)
    monkeypatch.setattr(vectors, "CELLS", 20 * block)
    base, q = vecs
    out = vectors.nearest_centroid(frame(spark, base, "vec_id"), frame(spark, q, "topic"))
    assert {r.vec_id: r.topic for r in out.collect()} == dict(enumerate(sims(base, q).argmax(axis=1)))


def test_centroids(spark, vecs):
    base, _ = vecs
    df = frame(spark, base, "vec_id").withColumn("topic", F.col("vec_id") % 3)
    for r in vectors.centroids(df).collect():
        assert r.embedding == pytest.approx(base[r.topic :: 3].mean(axis=0)) and r.volume == len(base[r.topic :: 3])


def test_rollup(spark):
    tree = spark.createDataFrame([("r", None), ("a", "r"), ("b", "r"), ("c", "a"), ("d", "c"), ("z", None)], "topic string, parent string")
    vol = spark.createDataFrame([("a", 1), ("c", 10), ("d", 100), ("b", 1000)], "topic string, volume long")
    got = {r.topic: (r.volume, r.subtree_volume) for r in vectors.topic_rollup(tree, vol).collect()}
    assert got == {"r": (0, 1111), "a": (1, 111), "b": (1000, 1000), "c": (10, 110), "d": (100, 100), "z": (0, 0)}
    chain = spark.createDataFrame([(i, i - 1 if i else None) for i in range(300)] + [(1000, 999)], "topic long, parent long")
    sums = {r.topic: r.subtree_volume for r in vectors.topic_rollup(chain, chain.select("topic", F.lit(1).alias("volume"))).collect()}
    assert sums == {i: 300 - i for i in range(300)} | {1000: 1}
    loop = spark.createDataFrame([("a", "b"), ("b", "a")], "topic string, parent string")
    with pytest.raises(ValueError, match="cycle"):
        vectors.topic_rollup(loop, vol)


def test_unlinked_sets_are_not_stored(spark, monkeypatch):
    """Only sets that may link are kept and compared."""
    rnd = random.Random(8)
    docs = [(i, " ".join(f"w{rnd.randrange(10**6)}" for _ in range(80))) for i in range(60)]
    docs += [(100 + i, t + " more") for i, t in docs[:3]] + [(5, "another text under an id that repeats"), (200, "another text under an id that repeats too")]
    rows, lists = {}, {}

    def spy(df, name):
        out = written(df, name)
        rows[name] = out.count()
        lists[name] = rows[name] if any(kind.startswith("array") for _, kind in out.dtypes) else 0
        return out

    written = text.written
    monkeypatch.setattr(text, "written", spy)
    out = text.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), spread=2).collect()
    assert {(r.doc_id, r.canonical_id) for r in out if r.doc_id >= 100} == {(100, 0), (101, 1), (102, 2), (200, 200)}
    assert len(out) == len(docs) and rows["hashes"] == len(docs)
    assert max(lists.values()) <= 8
