"""Jaccard join, decontamination, mixing and the pipeline against plain versions."""

import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from opinionweave.llm import decontaminate, language, mixing, ngram_join
from opinionweave.plans.components import components

SF = "/root/testdata/sf0.001"


def plain_components(rows):
    sets = []
    for _, t in rows:
        w = (t or "").lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    root, links = list(range(len(rows))), [0] * len(rows)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                links[i] += 1
                links[j] += 1
                root[find(i)] = find(j)
    ids = [min(rows[j][0] for j in range(len(rows)) if find(j) == find(i)) for i in range(len(rows))]
    return [(rows[i][0], len(sets[i]), ids[i], links[i]) for i in range(len(rows))]


def near_copies(seed, groups, size):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdef") for _ in range(4))
    texts = []
    for _ in range(groups):
        base = [word() for _ in range(rng.choice([1, 3, 5, 6, 9, 15, 30, 66, 70, 90, 150, 400]))]
        for _ in range(rng.randint(1, size)):
            copy = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 40))):
                at = rng.randrange(len(copy) + 1)
                copy[at : at + rng.randint(0, 1)] = [word()] * rng.randint(0, 1)
            texts.append(" ".join(copy))
    shared = [" ".join(word() for _ in range(20)) for _ in range(2)]
    texts += [" ".join([rng.choice(shared), *(word() for _ in range(12)), rng.choice(shared)]) for _ in range(20)]
    return [(i, t) for i, t in enumerate(texts)] + [(len(texts), None), (len(texts) + 1, " "), (len(texts) + 2, texts[0])]


@pytest.mark.parametrize("chunk", [ngram_join.CHUNK, 300])
def test_jaccard_components(docs_of, chunk):
    """All links and components; with a small chunk every block is cut into pairs of chunks."""
    rows = near_copies(3, 40, 7)
    got = ngram_join.jaccard_components(docs_of(rows), chunk=chunk).collect()
    assert sorted(map(tuple, got)) == sorted(plain_components(rows))


def test_signatures_meet_at_the_threshold():
    """Sets that just link share a signature, over sizes on both sides of the change of scheme."""
    rng = np.random.default_rng(1)
    for size in [2, 4, 5, 9, 10, 30, 60, 64, 65, 80, 81, 127, 128, 160, 500, 1023, 1030, 5000]:
        for _ in range(20):
            low = int(rng.integers(-(-4 * size // 5), size + 1))  # common hashes
            other = int(rng.integers(low, 5 * low // 4 - size + low + 1)) if 5 * low // 4 - size + low >= low else low
            pool = np.unique(rng.integers(0, 1 << 63, 2 * size + other + 10).astype(np.uint64) * np.uint64(2))
            rng.shuffle(pool)
            a = np.sort(pool[:size])
            b = np.sort(np.r_[a[rng.permutation(size)[:low]], pool[size : size + other - low]])
            both = len(np.intersect1d(a, b))
            if 100 * both >= 80 * (len(a) + len(b) - both) and not np.array_equal(a, b):
                assert np.intersect1d(ngram_join.signatures(a), ngram_join.signatures(b)).size


def test_components_of_chains(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100 + i, 200) for i in range(30)] + [(5, 5), (300, 301)]
    random.Random(4).shuffle(edges)
    got = dict(map(tuple, components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()))
    assert got == {**{i: 0 for i in range(61)}, **{100 + i: 100 for i in range(30)}, 200: 100, 300: 300, 301: 300}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).collect() == []


def plain_edits(item, words):
    """Least edits from the item to any stretch of the words."""
    row = [0] * (len(words) + 1)
    for i, x in enumerate(item, 1):
        row = [i, *_next(row, x, words, i)]
    return min(row)


def _next(row, x, words, i):
    left = i
    for j, w in enumerate(words, 1):
        left = min(row[j - 1] + (w != x), row[j] + 1, left + 1)
        yield left


def test_leaks(spark, docs_of):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdef") for _ in range(3))
    items = [(k, " ".join(word() for _ in range(rng.choice([6, 14, 20, 37, 59])))) for k in range(25)]
    items += [(90, None), (91, ""), (92, "single"), (93, items[0][1])]
    rows = []
    for i in range(150):
        body = [word() for _ in range(rng.randint(0, 120))]
        if i % 2:
            piece = rng.choice(items[:25])[1].split()
            for _ in range(rng.randint(0, len(piece) // 4)):
                at = rng.randrange(len(piece) + 1)
                piece[at : at + rng.randint(0, 1)] = [word()] * rng.randint(0, 1)
            at = rng.randint(0, len(body))
            body[at:at] = piece
        rows.append((i, ", ".join(body).upper() if i % 3 == 0 else " ".join(body)))
    rows += [(150, None), (151, "")]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    got = {(r["doc_id"], r["item_id"]): r for r in decontaminate.benchmark_leaks(docs_of(rows), bench).collect()}
    want = {}
    for i, t in rows:
        words = (t or "").lower().replace(",", "").split()
        for k, x in items:
            item = (x or "").split()
            if len(item) > 1 and (far := plain_edits(item, words)) <= int(0.2 * len(item)):
                want[i, k] = far
    assert set(got) <= set(want) and len(got) >= 0.97 * len(want)
    for key, r in got.items():
        assert r["edits"] == want[key]
        words = dict(rows)[key[0]].lower().replace(",", "").split()[r["first_word"] : r["first_word"] + r["n_words"]]
        assert plain_edits(dict(items)[key[1]].split(), words) == r["edits"]
    exact = [key for key, far in want.items() if far == 0]
    assert set(exact) <= set(got)


def test_leaks_beside_other_items(spark, docs_of):
    """An edited item counts right after a whole item, a fragment of another one and a fragment of itself."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdef") for _ in range(4))
    items = [[word() for _ in range(20)] for _ in range(30)]
    rows, want = [], {}
    for i in range(180):
        x, other = rng.sample(range(30), 2)
        before = [items[other], items[other][12:], items[x][12:]][i % 3]
        edited = [word() if at in (12, 14, 16, 18) else w for at, w in enumerate(items[x])]
        words = [word() for _ in range(30)] + before + edited + [word() for _ in range(30)]
        rows.append((i, " ".join(words)))
        want |= {(i, k): far for k, item in enumerate(items) if (far := plain_edits(item, words)) <= 4}
    bench = spark.createDataFrame([(k, " ".join(x)) for k, x in enumerate(items)], "item_id bigint, text string")
    got = {(r["doc_id"], r["item_id"]): r["edits"] for r in decontaminate.benchmark_leaks(docs_of(rows), bench).collect()}
    for kind in range(3):
        expected = {key for key in want if key[0] % 3 == kind}
        assert len(expected) >= 60 and len(expected & set(got)) >= 0.97 * len(expected)
    assert got.items() <= want.items()


def test_mixing_reaches_targets(spark, docs_of):
    rng = random.Random(6)
    kinds = {"clean": ["lorem", "ipsum", "dolor"], "toxic": ["grr", "argh"], "low": ["buy", "now"]}
    rows, marks = [], []
    for i in range(300):
        kind = rng.choice(["clean"] * 6 + ["toxic", "low"])
        words = [rng.choice(["the", "a", "of", "in"]) for _ in range(rng.randint(20, 60))]
        rows.append((i, " ".join(words + rng.sample(kinds[kind], 2))))
        if i % 2:
            marks.append((i, int(kind != "low"), int(kind == "toxic")))
    labels = spark.createDataFrame(marks, "doc_id bigint, quality int, toxic int")
    targets = {"clean": 0.85, "low": 0.1, "toxic": 0.05}
    got = mixing.mixing_rates(docs_of(rows), labels, targets=targets).toPandas()
    total = got["n_tokens"].sum()
    assert len(got) == 300 and got["rate"].min() >= 0
    for name, share in targets.items():
        assert abs((got["rate"] * got["n_tokens"] * got[f"p_{name}"]).sum() / total - share) < 0.01
    assert np.allclose(got[[f"p_{x}" for x in targets]].sum(axis=1), 1)


def test_copies_meet_the_rates(spark, docs_of, tmp_path):
    """Copies come to the rates in sum, a rate below one half is not 0, and what is most likely clean stays."""
    import corpus_pipeline

    for rate in (0.0, 0.3, 0.5, 1.0, 1.7, 3.2):
        number = F.xxhash64(F.col("id"), F.lit("text"))
        got = spark.range(20_000).select(corpus_pipeline.copies(F.lit(rate), number).alias("n")).agg(F.avg("n"), F.min("n"), F.max("n")).first()
        assert abs(got[0] - rate) < 0.015 and got[1] == int(rate) and got[2] <= int(rate) + 1
    rng = random.Random(9)
    kinds = {"clean": ["lorem", "ipsum", "dolor"], "toxic": ["grr", "argh"], "low": ["buy", "now"]}
    rows, marks, kind_of = [], [], {}
    for i in range(600):
        kind_of[i] = kind = rng.choice(["clean"] * 6 + ["toxic", "low"])
        sure = rng.random() < 0.8  # the others have nothing but their prior
        words = [rng.choice(["the", "a", "of", "in"]) for _ in range(rng.randint(20, 300))]
        rows.append((i, " ".join(words + (rng.sample(kinds[kind], 2) if sure else []))))
        if i % 2:
            marks.append((i, int(kind != "low"), int(kind == "toxic")))
    docs, labels = docs_of(rows), spark.createDataFrame(marks, "doc_id bigint, quality int, toxic int")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    rated = {r["doc_id"]: r for r in mixing.mixing_rates(docs, labels, least={"clean": 1.0}).collect()}
    clean = {i for i, r in rated.items() if r["p_clean"] >= max(r["p_low"], r["p_toxic"])}
    assert any(rated[i]["p_clean"] < 0.8 for i in clean) and all(rated[i]["rate"] >= 1 for i in clean)
    out = {r["doc_id"]: r for r in corpus_pipeline.mixed(spark, docs, str(tmp_path)).collect()}
    assert clean <= set(out) and all(abs(r["rate"] - rated[i]["rate"]) < 1e-9 and -1 < r["copies"] - r["rate"] < 1 for i, r in out.items())
    solved, taken = (sum(n * rated[i]["n_tokens"] for i, n in what) for what in (((i, r["rate"]) for i, r in rated.items()), ((i, r["copies"]) for i, r in out.items())))
    assert abs(taken - solved) < 0.05 * solved


def test_odd_rows(spark, odd_docs, no_docs):
    bench = spark.createDataFrame([(1, "mit license"), (2, None)], "item_id bigint, text string")
    labels = spark.createDataFrame([(4, 1, 0), (5, 0, None), (None, 1, 1)], "doc_id bigint, quality int, toxic int")
    nothing = labels.limit(0)
    got = ngram_join.jaccard_components(odd_docs).collect()
    assert len(got) == 10 and sorted((r["component_id"], r["n_links"]) for r in got if r["doc_id"] == 4) == [(4, 1), (4, 1)]
    assert ngram_join.jaccard_components(no_docs).collect() == []
    assert len(decontaminate.benchmark_leaks(odd_docs, bench).collect()) == 2
    assert decontaminate.benchmark_leaks(odd_docs, bench.limit(0)).collect() == decontaminate.benchmark_leaks(no_docs, bench).collect() == []
    for marks in (labels, nothing):
        assert len(mixing.mixing_rates(odd_docs, marks).collect()) == 10
    assert mixing.mixing_rates(no_docs, labels).collect() == []


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not present")
def test_pipeline_on_planted_rows(spark, tmp_path, docs_of):
    """Each stage drops what it is there for, keeps the columns and leaves clean documents alone."""
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    item = spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").first()["text"]
    rng = random.Random(7)
    fresh = lambda n: " ".join("".join(rng.choice(["lo", "rem", "ip", "sum"]) for _ in range(4)) for _ in range(n))
    clean, other = fresh(120), fresh(100)
    two = " ".join("changed" if i in (30, 90) else w for i, w in enumerate(clean.split()))
    planted = docs_of([
        (1_000_000, clean), (1_000_001, clean), (1_000_002, two), (1_000_003, other + " " + item), (1_000_004, "123 456"),
        (1_000_005, fresh(60).replace(" ", ". ")), (1_000_006, None),
    ])
    work = docs.unionByName(planted)
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "line_dedup", "ngram_jaccard_join", "benchmark_decontamination", "mixing"]
    left = {}
    for name, stage in corpus_pipeline.STAGES:
        work = stage(spark, work, SF)
        if name != "mixing":
            assert work.columns == docs.columns and work.schema["doc_id"].dataType == docs.schema["doc_id"].dataType
        work.write.parquet(str(tmp_path / name))
        work = spark.read.parquet(str(tmp_path / name))
        left[name] = {r["doc_id"] for r in work.select("doc_id").collect() if r["doc_id"] >= 1_000_000}
    assert left["language_id"] == {1_000_000, 1_000_001, 1_000_002, 1_000_003, 1_000_005}
    assert left["line_dedup"] == {1_000_000, 1_000_002, 1_000_003, 1_000_005}
    assert left["ngram_jaccard_join"] == {1_000_000, 1_000_003, 1_000_005}
    assert left["benchmark_decontamination"] == {1_000_000, 1_000_005}
    assert work.columns == [*docs.columns, "rate", "copies"] and work.filter(F.col("copies") < 1).count() == 0
    assert corpus_pipeline.run(spark, SF).columns == work.columns


def test_pipeline_of_nothing(spark, no_docs):
    import corpus_pipeline

    for _, stage in corpus_pipeline.STAGES:
        if os.path.isdir(SF):
            assert stage(spark, no_docs, SF).collect() == []


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not present")
def test_pipeline_with_clashing_columns(spark, docs_of, tmp_path):
    """Columns with names that the operators use come through all stages with their values."""
    import corpus_pipeline

    names = ["score", "lang_pred", "kept", "n_lines", "_id", "_row", "n_tokens", "rate", "copies", "others", "odd name", "_text"]
    rng = random.Random(9)
    texts = [" ".join("".join(rng.choice(["ta", "re", "mi"]) for _ in range(4)) for _ in range(40)) for _ in range(12)]
    work = docs_of([*texts, texts[0], None]).withColumns({n: F.concat(F.lit(f"{n} "), "doc_id") for n in names})
    for name, stage in corpus_pipeline.STAGES:
        before, work = work, stage(spark, work, SF)
        if name != "mixing":
            assert work.schema.names == before.schema.names and [f.dataType for f in work.schema] == [f.dataType for f in before.schema]
        work.write.parquet(str(tmp_path / name))
        work = spark.read.parquet(str(tmp_path / name))
    rows = work.collect()
    own = [n for n in names if n not in ("rate", "copies")]
    assert {r["doc_id"] for r in rows} <= set(range(12)) and len(rows) > 6
    assert all(r[n] == f"{n} {r['doc_id']}" for r in rows for n in own) and all(r["copies"] >= 1 for r in rows)
    assert work.columns == ["doc_id", "text", "lang", "source", "n_chars", *own, "rate", "copies"]


def test_names_the_operators_use(docs_of):
    docs = docs_of(["a text"])
    with pytest.raises(ValueError, match="Score"):
        language.predict(docs, None, {"Score": F.col("doc_id")})
    with pytest.raises(ValueError, match="rate"):
        mixing.mixing_rates(docs, docs, {"rate": F.col("doc_id")})
