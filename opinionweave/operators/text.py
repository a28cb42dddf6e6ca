"""Exact and near-duplicate removal of mention texts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import bind
from ..plans.components import components
from ..plans.lineage import written
from ..plans.skew import salted_join


def normalised(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def exact_duplicates(docs: DataFrame, row_id: str = "doc_id", text: str = "text", within: Sequence[str] = ("lang",)) -> DataFrame:
    """One row per distinct normalised text: the kept (smallest) id and its copies."""
    return (
        docs.groupBy(*within, F.sha2(normalised(F.col(text)), 256).alias("text_hash"))
        .agg(F.min(row_id).alias("kept_id"), F.count(F.lit(1)).alias("copies"))
    )


def shingles(text: Column, size: int = 5) -> Column:
    """Set of 64-bit hashes of the runs of ``size`` words over the whole text; a shorter text is one run."""

    def runs(words: Column) -> Column:
        starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.size(words) - size))
        return F.transform(starts, lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(size)]))

    # the text is split and its words are hashed once, not once per shingle; a place past the end changes no hash
    words = F.transform(F.split(normalised(text), " "), lambda w: F.xxhash64(w))
    return F.when(text.isNotNull(), F.array_distinct(bind(words, runs)))


#: Rows of a prefix bucket that are all compared; of larger buckets, rows of a chunk.
SMALL, CHUNK = 16, 256


def shared_shingles(sets: DataFrame, threshold: float) -> DataFrame:
    """(id, n, places, shared): the shingles (df, h) of every set (id, s) that other sets have, too, rarest first.

    ``places`` is how many of them stand in the prefix, the first n - ceil(threshold n) + 1 in the order of frequency, where
    the unshared ones come first. A set without such a place links with nobody and has no row; whatever two sets have in
    common is in both rows. A shingle stands once in a set, so all with one shingle are few beside all shingles.
    """
    # an id may have several sets, told apart by k; sets are bound and exploded by the outer form so that they are built
    # once, not for every use and for the filters that Spark puts before an explode
    whole = sets.select("id", bind(F.col("s"), lambda s: F.struct(F.size(s).alias("n"), F.xxhash64(s).alias("k"), s.alias("s"))).alias("x"))
    each = whole.select("id", "x.n", "x.k", F.explode_outer("x.s").alias("h")).filter("h is not null")
    counted = each.withColumn("df", F.count(F.lit(1)).over(Window.partitionBy("h"))).filter("df > 1")
    listed = counted.groupBy("id", "n", "k").agg(F.collect_list(F.struct("df", "h")).alias("all"))

    def able(shared: Column) -> Column:
        # no more shared shingles may be passed over than the prefix has places beside the unshared ones
        places = F.col("n") - F.ceil(F.col("n") * threshold - 1e-9) + 1 - (F.col("n") - F.size(shared))
        return F.when(places > 0, F.array(F.struct(places.cast("int").alias("places"), shared.alias("shared"))))

    placed = listed.select("id", "n", F.explode_outer(bind(F.sort_array("all"), able)).alias("x")).filter("x is not null")
    return placed.select("id", "n", "x.places", "x.shared")


def prefix_keys(sets: DataFrame, threshold: float) -> DataFrame:
    """(h, id, n, left): prefix shingles of every set (id, s), rarest first, that other sets have, too.

    Linked sets share a shingle of both prefixes. ``left`` counts the shared shingles from this one on, which bounds the
    overlap of two sets that meet here first.
    """
    return _prefixes(shared_shingles(sets, threshold))


def _prefixes(known: DataFrame) -> DataFrame:
    return known.select(
        "id", "n", F.size("shared").alias("m"), F.posexplode(F.slice("shared", F.lit(1), F.col("places"))).alias("p", "x")
    ).select("x.h", "id", "n", (F.col("m") - F.col("p")).alias("left"))


def _able(a: str, b: str, threshold: float) -> Column:
    """Sizes and shared shingles of two sets that meet in a bucket leave a similarity of ``threshold`` possible."""
    n, left = (F.col(f"{a}.n"), F.col(f"{b}.n")), F.least(F.col(f"{a}.left"), F.col(f"{b}.left"))
    return (left >= (n[0] + n[1]) * (threshold / (1 + threshold)) - 1e-9) & (F.least(*n) >= F.greatest(*n) * threshold - 1e-9)


def _verified(pairs: DataFrame, known: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) whose sets have a Jaccard similarity of ``threshold`` or more; a set may be in very many of them.

    Two sets have in common what their shared shingles have in common.
    """
    left, right = (known.select(F.col("id").alias(x), F.col("n").alias(f"n{x}"), F.col("shared.h").alias(f"s{x}")) for x in "ab")
    both = salted_join(salted_join(pairs, left, ["a"], ["b"], sparse=True), right, ["b"], ["a"], sparse=True)
    common = F.size(F.array_intersect("sa", "sb"))
    return both.filter(common / (F.col("na") + F.col("nb") - common) >= threshold).select("a", "b")


def near_duplicates(
    docs: DataFrame, row_id: str = "doc_id", text: str = "text", threshold: float = 0.8, shingle_size: int = 5, spread: int | None = None,
    small: int = SMALL, chunk: int = CHUNK,
) -> DataFrame:
    """(row_id, canonical_id): the smallest id among the texts that links lead to, with every link counted.

    Texts are linked if their word shingles have a Jaccard similarity of ``threshold`` or more. Pairs come from a
    self-join on prefix shingles with bounds on sizes and overlap, and are verified. Buckets of up to ``small`` sets give
    all their pairs. In a larger one everyone first meets the bucket's first set; after that only pairs of sets in
    different components are left to test, so a group of copies of any size costs linear work. Those pairs are made
    chunk by chunk, so no task holds a bucket. Exact copies are collapsed first. A row without text is nobody's
    copy. ``spread`` redistributes the texts over that many tasks first where the input has fewer file splits.
    """
    base = docs.select(F.col(row_id).alias("id"), F.col(text).alias("t"))
    if spread and base.rdd.getNumPartitions() < spread:
        base = base.repartition(spread, "id")
    no_text = F.concat(F.lit("no text "), F.col("id").cast("string"))
    hashes = written(base.select("id", F.coalesce(F.sha2(normalised(F.col("t")), 256), no_text).alias("h")), "hashes")
    firsts = hashes.groupBy("h").agg(F.min("id").alias("first_id"))
    copies = salted_join(hashes, firsts, ["h"], ["id"], sparse=True).select("id", "first_id")
    # a group of copies may be huge: only its first id is joined back to a text
    unique = base.filter("t is not null").join(firsts.select(F.col("first_id").alias("id")), "id", "left_semi")
    sets = unique.select("id", shingles(F.col("t"), shingle_size).alias("s"))
    known = written(shared_shingles(sets, threshold), "shared")
    keys = written(_prefixes(known), "prefixes")
    member = F.struct("id", "n", "left")
    buckets = written(keys.groupBy("h").agg(F.count(F.lit(1)).alias("c"), F.min(member).alias("x")).filter("c > 1"), "buckets")
    sized = salted_join(keys, buckets, ["h"], ["id"], sparse=True).select("h", "c", "x", member.alias("y"))
    few = sized.filter(F.col("c") <= small).groupBy("h").agg(F.sort_array(F.collect_list("y")).alias("all"))
    listed = few.select(F.posexplode("all").alias("p", "x"), "all").select("x", F.explode(F.slice("all", F.col("p") + 2, F.lit(small))).alias("y"))
    met = listed.unionByName(sized.filter((F.col("c") > small) & (F.col("x.id") != F.col("y.id"))).select("x", "y"))
    tested = met.filter(_able("x", "y", threshold)).select(F.col("x.id").alias("a"), F.col("y.id").alias("b")).distinct()
    roots = components(written(_verified(tested, known, threshold), "links"))
    # large buckets that hold several components
    large = salted_join(keys, buckets.filter(F.col("c") > small).select("h"), ["h"], ["id"], sparse=True)
    placed = large.join(roots.withColumnRenamed("node", "id"), "id", "left").withColumn("root", F.coalesce("root", "id"))
    placed = written(placed, "placed")
    per_root = placed.groupBy("h", "root").agg(F.count(F.lit(1)).alias("c"))
    mixed = per_root.groupBy("h").agg(F.max_by("root", F.struct("c", "root")).alias("main"), F.sum("c").alias("c"), F.max("c").alias("most")).filter("c > most")
    chunks = lambda c: F.ceil(c / F.lit(chunk)).cast("bigint")
    mixed = mixed.select("h", "main", chunks(F.col("c")).alias("kj"), chunks(F.col("c") - F.col("most")).alias("ki"))
    spread_out = salted_join(placed, mixed, ["h"], ["id"], sparse=True).withColumn("v", F.struct("id", "n", "left", "root"))
    each = lambda k, name: F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(k) - 1)).alias(name)
    own = lambda k, name: F.pmod(F.xxhash64("id"), k).alias(name)
    # of two components at least one is not the bucket's largest
    others = spread_out.filter("root <> main").select("h", own("ki", "i"), each("kj", "j"), F.col("v").alias("x"))
    anyone = spread_out.select("h", each("ki", "i"), own("kj", "j"), F.col("v").alias("y"))
    cross = others.join(anyone, ["h", "i", "j"]).filter("x.root <> y.root").filter(_able("x", "y", threshold))
    cross = cross.select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b")).distinct()
    more = _verified(cross, known, threshold)
    rooted = placed.select("id", "root").distinct()
    between = more.join(rooted.select(F.col("id").alias("a"), F.col("root").alias("ra")), "a").join(rooted.select(F.col("id").alias("b"), F.col("root").alias("rb")), "b")
    merged = components(written(between.select(F.col("ra").alias("a"), F.col("rb").alias("b")), "merged")).select(F.col("node").alias("old"), F.col("root").alias("new"))
    named = copies.join(roots.withColumnRenamed("node", "first_id"), "first_id", "left").withColumn("old", F.coalesce("root", "first_id"))
    return named.join(merged, "old", "left").select(F.col("id").alias(row_id), F.coalesce("new", "old").alias("canonical_id"))
