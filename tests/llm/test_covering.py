"""SimHash near-duplicates against all pairs."""

import random

import pytest
import xxhash

from opinionweave.llm import covering
from opinionweave.plans.components import components


def plain_print(text, size=3):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    runs = [b" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))]
    hashes = [xxhash.xxh64_intdigest(r, seed=42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def roots_of(prints, radius):
    root = {p: p for p in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for p in prints:
        for q in prints:
            if q < p and (p ^ q).bit_count() <= radius:
                a, b = find(p), find(q)
                root[max(a, b)] = min(a, b)
    return {p: find(p) for p in prints}


def signed(p):
    return p - (1 << 64) if p >> 63 else p


def test_masks_cover_every_pair():
    for radius in (1, 2):
        family = [m % (1 << 64) for m in covering.masks(radius)]
        assert len(family) == 2 ** (radius + 1) - 1
        places = [1 << p for p in range(64)]
        assert all(any(not m & (a | b) for m in family) for a in places for b in (places if radius == 2 else [a]))


def test_fingerprint():
    rng = random.Random(1)
    texts = ["", " \t\x0b", "One", "one two", "A b C", "é È ü", *(" ".join(rng.choice("abcdefgh") for _ in range(n)) for n in (4, 5, 40, 3000))]
    assert [covering.simhash(t.encode()) for t in texts] == [plain_print(t) for t in texts]
    assert covering.simhash(b"a b c d", 2) == plain_print("a b c d", 2)


@pytest.mark.parametrize("radius", [1, 2])
@pytest.mark.parametrize("small", [2, 32])
def test_links_connect_like_all_pairs(spark, radius, small):
    """Random prints, chains of near ones and one dense ball, with buckets compared in pairs and by variants."""
    rng = random.Random(radius)
    prints = {rng.getrandbits(64) for _ in range(60)} | {0, (1 << 64) - 1, 1 << 63}
    for start in list(prints)[:12]:
        p = start
        for _ in range(rng.randint(1, 8)):
            for _ in range(rng.randint(1, 3)):
                p ^= 1 << rng.randrange(64)
            prints.add(p)
    centre = rng.getrandbits(64)
    prints |= {centre ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 4))) for _ in range(150)}
    frame = spark.createDataFrame([(signed(p),) for p in prints], "fp bigint")
    edges = covering.links_within(frame, radius, small)
    assert all(((r["a"] ^ r["b"]) % (1 << 64)).bit_count() <= radius for r in edges.collect())
    got = {r["node"]: r["root"] for r in components(edges).collect()}
    want = roots_of(prints, radius)
    same = {}
    for p in prints:
        same.setdefault(want[p], set()).add(got.get(signed(p), signed(p)))
    assert all(len(x) == 1 for x in same.values()) and len({min(x) for x in same.values()}) == len(same)


def test_simhash_components(docs_of):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdef") for _ in range(4))
    rows = [(1, None), (2, ""), (3, "A b"), (4, "a B")]
    for i in range(30):
        base = [word() for _ in range(rng.choice([2, 8, 200, 900]))]
        for k in range(rng.randint(1, 6)):
            copy = list(base)
            copy[rng.randrange(len(copy))] = word() if k else copy[0]
            rows.append((100 * i + 10 + k, " ".join(copy)))
    rng.shuffle(rows)
    prints = {i: plain_print(t) for i, t in rows}
    roots = roots_of(set(prints.values()), 2)
    first = {}
    for i, p in prints.items():
        first[roots[p]] = min(i, first.get(roots[p], i))
    got = covering.simhash_components(docs_of(rows)).collect()
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in got} == {i: (f"{p:016x}", first[roots[p]]) for i, p in prints.items()}
    assert len({r["component_id"] for r in got}) < len(rows)


def test_odd_rows(odd_docs, no_docs):
    got = covering.simhash_components(odd_docs).collect()
    assert len(got) == 10 and {r["component_id"] for r in got if r["fingerprint"] == "0" * 16} == {1}
    assert [r["component_id"] for r in got if r["doc_id"] == 4] == [4, 4]
    assert covering.simhash_components(no_docs).collect() == []
    with pytest.raises(ValueError, match="radius"):
        covering.simhash_components(odd_docs, radius=3)
