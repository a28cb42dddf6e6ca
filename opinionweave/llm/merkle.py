"""Document fingerprints: a Merkle tree over the sections, paragraphs and blocks of a text, in SQL functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK, SECTION = 64, 8


def leaves(text: Column, block: int = BLOCK) -> Column:
    """Per paragraph (line) the hashes of its blocks of ``block`` code points; an empty paragraph has none."""
    pattern = F.lit(f"(?s).{{1,{block}}}")
    return F.transform(
        F.split(text, "\n", -1),
        lambda p: F.transform(F.regexp_extract_all(p, pattern, F.lit(0)), lambda x: F.substring(F.md5(x), 1, 16)),
    )


def fingerprint(tree: Column, section: int = SECTION) -> Column:
    """root/sections/paragraphs of the leaf hashes: roots are equal exactly when texts are, up to hash collisions.

    A paragraph hashes its leaves, a section ``section`` paragraphs, the root all sections. The last part keeps eight
    digits of every leaf, so that two fingerprints show where their texts differ.
    """
    paragraphs = F.transform(tree, lambda p: F.md5(F.concat_ws("", p)))
    sections = F.transform(
        F.sequence(F.lit(0), F.size(tree) - 1, F.lit(section)),
        lambda i: F.md5(F.concat_ws("", F.slice(paragraphs, i + 1, F.lit(section)))),
    )
    short = F.transform(tree, lambda p: F.concat_ws(".", F.transform(p, lambda x: F.substring(x, 1, 8))))
    return F.concat_ws(
        "/", F.sha2(F.concat_ws("", sections), 256),
        F.concat_ws(",", F.transform(sections, lambda s: F.substring(s, 1, 16))), F.concat_ws(",", short),
    )


def likeness(a: Column, b: Column) -> Column:
    """Shared distinct leaves of two trees, twice, over the leaves of both; 1 for equal trees."""
    x, y = F.flatten(a), F.flatten(b)
    both = F.size(F.array_distinct(x)) + F.size(F.array_distinct(y))
    return F.when(a == b, 1.0).otherwise(F.coalesce(F.try_divide(2.0 * F.size(F.array_intersect(x, y)), both), F.lit(0.0)))


def differing_paragraphs(a: Column, b: Column) -> Column:
    """Numbers, from 0, of the paragraphs in which two fingerprints differ; sections that are equal are skipped."""

    def part(fp, n):
        return F.split(F.split_part(fp, F.lit("/"), F.lit(n)), ",", -1)

    (sa, sb), (pa, pb) = (part(a, 2), part(b, 2)), (part(a, 3), part(b, 3))
    places = F.sequence(F.lit(0), F.greatest(F.size(pa), F.size(pb)) - 1)
    at = lambda xs, i: F.get(xs, i)
    return F.filter(places, lambda i: ~at(sa, F.floor(i / SECTION).cast("int")).eqNullSafe(at(sb, F.floor(i / SECTION).cast("int")))
                    & ~at(pa, i).eqNullSafe(at(pb, i)))


def _bucket(id_col: str, bounds: list[int]) -> Column:
    """How many bounds lie below the id, by binary search; -1 for a null id."""
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(max(1, len(bounds).bit_length())))])
    array = F.array(*[F.lit(b).cast("bigint") for b in bounds]) if bounds else F.array().cast("array<bigint>")
    found = F.aggregate(
        steps, F.lit(0), lambda n, s: F.when(F.get(array, n + s - 1) < F.col(id_col), n + s).otherwise(n)
    )
    return F.when(F.col(id_col).isNull(), -1).otherwise(found)


def with_next_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text, next_text): the following text in descending order of the ids, the first one after the last.

    Rows are dealt by ranges of the id, so there is one shuffle of the texts and no global sort. The first text of
    every range is found from the keys alone and handed to the range before it.
    """
    spark = docs.sparkSession
    slim = docs.select(
        F.col(id_col).cast("bigint").alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")
    )
    parts = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    quantiles = slim.agg(F.percentile_approx("_id", [i / parts for i in range(1, parts)], 20 * parts)).first()[0]
    bounds = sorted(set(quantiles or []))
    # ascending order of these is descending order of the ids; equal ids are ordered by their texts
    keyed = slim.withColumn("_b", _bucket("_id", bounds)).withColumn("_k", F.bitwise_not("_id"))
    heads = keyed.groupBy("_b").agg(F.min("_k").alias("_k"))  # one row per range
    first = keyed.join(F.broadcast(heads.withColumnsRenamed({"_b": "_hb", "_k": "_hk"})), F.col("_b").eqNullSafe(F.col("_hb")) & F.col("_k").eqNullSafe(F.col("_hk")))
    first = first.groupBy("_b").agg(F.min("text").alias("head"))
    ranges = Window.orderBy(F.desc("_b"))  # over one row per range
    after = first.select("_b", F.coalesce(F.lead("head").over(ranges), F.first("head").over(ranges)).alias("head"))
    own = Window.partitionBy("_b").orderBy(F.col("_k").asc_nulls_last(), "text")
    ordered = keyed.withColumn("next_text", F.lead("text").over(own))
    return ordered.join(after, "_b").select(
        F.col("_id").alias(id_col), "text", F.coalesce("next_text", "head").alias("next_text")
    )


def document_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprint of every text and of its edit, and their likeness.

    The edit replaces the last third of the code points by the first as many of the next text in descending order of
    ids. Per input row: id (integer), ``n_chars``, ``edited_sha256``, ``fingerprint``, ``edited_fingerprint``,
    ``near_edited``, ``near_next`` and ``edited_paragraphs``, the numbers of the paragraphs that differ. A null text
    is empty; a null id comes last; rows with equal ids are ordered by text, so repeated rows follow each other; a
    single row is followed by itself; an empty table gives no rows. Other columns are not read. A text is one row
    whatever its length.
    """
    both = with_next_text(docs, id_col, text_col)
    n, cut = F.length("text"), F.floor(F.length("text") / 3).cast("int")
    edited = both.select(
        id_col, n.cast("bigint").alias("n_chars"), leaves(F.col("text")).alias("tree"),
        leaves(F.col("next_text")).alias("next_tree"),
        F.concat(F.substring("text", F.lit(1), n - cut), F.substring("next_text", F.lit(1), cut)).alias("edited"),
    )
    trees = edited.withColumn("edited_tree", leaves(F.col("edited")))
    return trees.select(
        id_col, "n_chars", F.sha2("edited", 256).alias("edited_sha256"),
        fingerprint(F.col("tree")).alias("fingerprint"), fingerprint(F.col("edited_tree")).alias("edited_fingerprint"),
        likeness(F.col("tree"), F.col("edited_tree")).alias("near_edited"),
        likeness(F.col("tree"), F.col("next_tree")).alias("near_next"),
    ).withColumn("edited_paragraphs", differing_paragraphs(F.col("fingerprint"), F.col("edited_fingerprint")))
