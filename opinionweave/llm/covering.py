"""SimHash near-duplicates by covering locality-sensitive hashing.

Fingerprints within ``radius`` r differ in at most r of 64 places. Every place gets a code, a vector of r + 1 bits that
is not zero; the mask of v, any other such vector, keeps the places whose code has an odd overlap with v. The codes of
r places leave a v that is orthogonal to them all, so the mask of that v drops every differing place: each pair within
the radius shares a masked value in one of the 2^(r+1) - 1 tables, with certainty. Codes are dealt evenly, so a mask
keeps about 37 of 64 places at r = 2.

Distinct fingerprints are the rows of the tables. Buckets of up to ``small`` are compared pair by pair. In larger ones,
whose fingerprints agree in all places the mask keeps, everyone hands out its variants: within distance 2 of each other
are just those that have a variant with one flipped place, or none, in common. So a bucket of any size takes linear
work, every group of equal variants is bounded by the places, and no link is left out.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.components import components
from ..plans.lineage import written
from ..plans.skew import salted_join
from .common import text_bytes

SHINGLE, SEED, BITS = 3, 42, 64
SMALL = 32
#: Hashes whose bits are counted at once.
HELD = 1 << 16


def simhash(text: bytes, size: int = SHINGLE) -> int:
    """64-bit fingerprint: a bit is set if it is set in more than half of the shingles' hashes; 0 without words."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= size:
        return xxhash.xxh64_intdigest(joined, SEED)
    length = np.fromiter(map(len, words), np.int64, len(words)) + 1
    stop = np.cumsum(length) - 1
    start = (stop - length + 1)[: len(words) - size + 1].tolist()
    digest, total, n = xxhash.xxh64_intdigest, np.zeros(BITS, np.int64), len(start)
    stop = stop[size - 1 :].tolist()
    for at in range(0, n, HELD):
        h = np.fromiter((digest(joined[a:b], SEED) for a, b in zip(start[at : at + HELD], stop[at : at + HELD])), "<u8", min(HELD, n - at))
        total += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * total > n, bitorder="little").view("<u8")[0])


def masks(radius: int) -> list[int]:
    """The 2^(radius+1) - 1 masks, as signed 64-bit numbers; the codes of the places follow each other in turn."""
    codes = [1 + place % (2 ** (radius + 1) - 1) for place in range(BITS)]
    out = []
    for v in range(1, 2 ** (radius + 1)):
        mask = sum(1 << place for place, c in enumerate(codes) if (c & v).bit_count() % 2)
        out.append(mask - (1 << BITS) if mask >> (BITS - 1) else mask)
    return out


def _fingerprints(docs: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            prints = np.fromiter((simhash(t, size) for t in batch.column(1).to_pylist()), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints.view(np.int64))], ["_id", "fp"])

    slim = docs.select(F.col(id_col).alias("_id"), text_bytes(text_col).alias("text"))
    return slim.mapInArrow(run, f"_id {docs.schema[id_col].dataType.simpleString()}, fp bigint")


def _distance(a: str, b: str) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b)))


def links_within(prints: DataFrame, radius: int = 2, small: int = SMALL) -> DataFrame:
    """(a, b): links that connect exactly the fingerprints (column ``fp``, distinct) that chains of pairs within ``radius`` connect.

    ``radius`` may be 1 or 2.
    """
    if radius not in (1, 2):
        raise ValueError("radius must be 1 or 2")
    family = masks(radius)
    tables = [F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for t, m in enumerate(family)]
    keys = prints.select("fp", F.explode(F.array(*tables)).alias("x")).select("x.t", "x.key", "fp")
    sizes = keys.groupBy("t", "key").agg(F.count("*").alias("c"), F.min("fp").alias("a"), F.max("fp").alias("b")).filter("c > 1")
    sizes = written(sizes, "buckets")
    twos = sizes.filter("c = 2").select("a", "b").filter(_distance("a", "b") <= radius)
    many = written(salted_join(keys, sizes.filter("c > 2").select("t", "key", "c"), ["t", "key"], ["fp"], sparse=True), "members")
    # at most ``small`` of them in a list
    few = many.filter(F.col("c") <= small).groupBy("t", "key").agg(F.collect_list("fp").alias("all"))
    firsts = few.select(F.posexplode("all").alias("p", "a"), "all")
    pairs = firsts.select("a", F.explode(F.slice("all", F.col("p") + 2, F.lit(small))).alias("b")).filter(_distance("a", "b") <= radius)
    # places that the mask of a table drops, as numbers with that place set
    free = F.create_map(*[
        x for t, m in enumerate(family)
        for x in (F.lit(t), F.array(F.lit(0), *[F.lit(1 << p if p < BITS - 1 else -(1 << p)).cast("bigint") for p in range(BITS) if not m >> p & 1]))
    ])
    large = many.filter(F.col("c") > small)
    if radius == 1:
        # neighbours at distance 1: a variant of the one is the other itself
        variants = large.select("fp", F.explode(F.transform(free[F.col("t")], lambda p: F.struct((p != 0).alias("flipped"), F.col("fp").bitwiseXOR(p).alias("v")))).alias("x"))
        own, flipped = variants.filter("not x.flipped"), variants.filter("x.flipped and x.v < fp")
        hubs = flipped.select(F.col("fp").alias("b"), F.col("x.v").alias("a")).join(own.select(F.col("fp").alias("a")).distinct(), "a", "left_semi").select("a", "b")
    else:
        variants = large.select("t", "fp", F.explode(F.transform(free[F.col("t")], lambda p: F.col("fp").bitwiseXOR(p))).alias("v"))
        met = variants.groupBy("t", "v").agg(F.min("fp").alias("a"), F.sort_array(F.collect_list("fp")).alias("all")).filter(F.size("all") > 1)
        hubs = met.select("a", F.explode(F.slice("all", 2, BITS + 1)).alias("b"))
    return twos.unionByName(pairs).unionByName(hubs).distinct()


def simhash_components(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 2, size: int = SHINGLE, small: int = SMALL
) -> DataFrame:
    """Components of texts whose 64-bit fingerprints differ in at most ``radius`` places.

    Per input row: id, ``fingerprint`` (16 lowercase hex digits) and ``component_id``, the smallest id that links lead to,
    itself included. Words are lower-cased (A-Z) and split at blanks, shingles of ``size`` words count as often as they
    occur, a text of fewer words is one shingle; null, empty and blank texts have fingerprint 0 and link like any
    other. Repeated rows give repeated rows; a null id is a component id only where all ids of the component are
    null. An empty table gives no rows; other columns are not read.
    """
    prints = written(_fingerprints(docs, id_col, text_col, size), "prints")
    classes = written(prints.groupBy("fp").agg(F.min("_id").alias("first")), "classes")
    roots = components(links_within(classes.select("fp"), radius, small)).withColumnRenamed("node", "fp")
    placed = written(classes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp")), "placed")
    smallest = placed.groupBy("root").agg(F.min("first").alias("component_id"))
    named = salted_join(placed, smallest, ["root"], ["fp"], sparse=True).select("fp", "component_id")
    return salted_join(prints, named, ["fp"], ["_id"], sparse=True).select(
        F.col("_id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )
