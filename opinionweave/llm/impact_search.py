"""Ranked lexical search by buckets of impact vectors of like length (LEMP).

A document is a sparse vector of integer impacts over the terms that queries hold, a query one of integer weights, a
score their product. Vectors are sorted by length and cut into buckets, longest first. A query keeps the k-th best score
so far as its bar. Cauchy-Schwarz passes over a bucket whose longest vector times the query's length stays below the bar;
inside, the query's largest coordinates are multiplied out and Cauchy-Schwarz bounds the rest, and only documents whose
bound reaches the bar are scored in whole, in integers. Bounds are doubles with room for their error, so whatever could
reach the bar is scored.

Nothing passes through the driver but a bitmap of fixed size, which marks the hashes of the terms of all queries, so that
documents keep no others. Documents are packed into chunks, queries into blocks, and each chunk meets each block by a join.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import written
from ..plans.ranking import top_n_per_key
from .common import WORDS_ONLY, bitmap_of, shared_bits, text_bytes

#: Documents of a bucket, and of a chunk; terms of a chunk at most, but for a single longer document.
BUCKET, CHUNK, CHUNK_TERMS = 1024, 4096, 1 << 20
#: Terms of a block of queries, about.
BLOCK_TERMS = 1 << 18
#: Largest coordinates of a query that bound a document.
FOCUS = 6
WORDS_HELD = 400_000
BITS = 24


class Hashes(dict):
    """Signed 64-bit hashes of words, remembered."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > WORDS_HELD:
            self.clear()
        h = xxhash.xxh3_64_intdigest(word)
        self[word] = h = h - (1 << 64) if h >> 63 else h
        return h


def _terms(rows: DataFrame, bits=None) -> DataFrame:
    """(_id, n, terms, times): tokens of a text, and the hashes of its distinct terms that the bitmap marks, with counts."""

    def run(batches):
        hashes, marked = Hashes(), bits() if bits else None
        for batch in filter(len, batches):
            sizes, kept, times, offsets = [], [], [], [0]
            for text in batch.column(1).to_pylist():
                count = Counter(text.translate(WORDS_ONLY).split())
                sizes.append(count.total())
                h = np.fromiter(map(hashes.__getitem__, count), np.int64, len(count))
                c = np.fromiter(count.values(), np.int64, len(count))
                if marked is not None:
                    held = marked(h)
                    h, c = h[held], c[held]
                kept.append(h)
                times.append(c)
                offsets.append(offsets[-1] + len(h))
            at = pa.array(offsets, pa.int32())
            flat = [pa.ListArray.from_arrays(at, pa.array(np.concatenate(x))) for x in (kept, times)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), *flat], ["_id", "n", "terms", "times"])

    kind = rows.schema["_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"_id {kind}, n bigint, terms array<bigint>, times array<bigint>")


def _packed_chunks(vectors: DataFrame) -> DataFrame:
    """Rows of (_id, terms, impacts) in their order, packed into chunks of bounded size."""

    def run(batches):
        for batch in batches:
            sizes = pc.list_value_length(batch.column(1)).to_numpy(zero_copy_only=False)
            upto, start = np.r_[0, np.cumsum(sizes)], 0
            while start < batch.num_rows:
                stop = max(start + 1, min(start + CHUNK, int(np.searchsorted(upto, upto[start] + CHUNK_TERMS, "right")) - 1))
                part = batch.slice(start, stop - start)
                ids = pa.ListArray.from_arrays(pa.array([0, stop - start], pa.int32()), part.column(0))
                numbers = [np.diff(upto[start : stop + 1]), *(part.column(c).flatten().to_numpy(zero_copy_only=False) for c in (1, 2))]
                yield pa.RecordBatch.from_arrays(
                    [ids, *(pa.array([x.astype(np.int64).tobytes()], pa.binary()) for x in numbers)], ["ids", "sizes", "terms", "impacts"]
                )
                start = stop

    kind = vectors.schema["_id"].dataType.simpleString()
    return vectors.select("_id", "terms", "impacts").mapInArrow(run, f"ids array<{kind}>, sizes binary, terms binary, impacts binary")


class Block:
    """Queries of a block: weights over their terms and, by query, the best rows so far."""

    def __init__(self, queries: list[dict], k: int):
        self.k = k
        self.ids = [q["item"] for q in queries]
        self.alphabet = np.unique(np.concatenate([np.asarray([t["term"] for t in q["terms"]], np.int64) for q in queries]))
        self.terms, self.weights, self.length = [], [], []
        for q in queries:
            weights = np.asarray([t["weight"] for t in q["terms"]], np.int64)
            by = np.argsort(-weights, kind="stable")
            self.terms.append(np.searchsorted(self.alphabet, np.asarray([t["term"] for t in q["terms"]], np.int64))[by])
            self.weights.append(weights[by])
            self.length.append(float(np.sqrt((weights.astype(float) ** 2).sum())))
        self.best = [np.empty(0, np.int64)] * len(queries)
        self.scored = 0

    def bar(self, q: int) -> int:
        """The score a row must reach to matter."""
        return int(self.best[q][0]) if len(self.best[q]) == self.k else 1

    def search(self, sizes: np.ndarray, terms: np.ndarray, impacts: np.ndarray):
        """Yield (query, rows, scores) of rows that reach the bar, bucket by bucket, longest vectors first."""
        owner = np.repeat(np.arange(len(sizes)), sizes)
        place = np.minimum(np.searchsorted(self.alphabet, terms), len(self.alphabet) - 1)
        held = self.alphabet[place] == terms
        owner, place, impacts = owner[held], place[held], impacts[held]
        squares = np.bincount(owner, impacts.astype(float) ** 2, minlength=len(sizes))
        order = np.argsort(-squares, kind="stable")
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        by = np.argsort(rank[owner], kind="stable")
        owner, place, impacts = rank[owner][by], place[by], impacts[by]
        squares = squares[order]
        weight = np.zeros(len(self.alphabet), np.int64)
        for low in range(0, len(sizes), BUCKET):
            high = min(low + BUCKET, len(sizes))
            if squares[low] == 0:
                return
            a, b = np.searchsorted(owner, [low, high])
            rows, cols, x = owner[a:b] - low, place[a:b], impacts[a:b]
            first = np.searchsorted(rows, np.arange(high - low + 1))
            lists = np.argsort(cols, kind="stable")
            starts = np.searchsorted(cols[lists], np.arange(len(self.alphabet) + 1))
            longest, sq = float(np.sqrt(squares[low])), squares[low:high]
            for q in range(len(self.ids)):
                bar = self.bar(q) * (1 - 1e-9)
                if self.length[q] * longest < bar:
                    continue
                near, rest = np.zeros(high - low), sq.copy()
                for t, w in zip(self.terms[q][:FOCUS], self.weights[q][:FOCUS]):
                    at = lists[starts[t] : starts[t + 1]]
                    near[rows[at]] += float(w) * x[at]
                    rest[rows[at]] -= x[at].astype(float) ** 2
                tail = float(np.sqrt((self.weights[q][FOCUS:].astype(float) ** 2).sum()))
                bound = near + tail * np.sqrt(np.maximum(rest, 0) + 1e-9 * sq)
                able = np.flatnonzero(bound >= bar)
                if not len(able):
                    continue
                weight[self.terms[q]] = self.weights[q]
                length = first[able + 1] - first[able]
                at = np.arange(length.sum()) + np.repeat(first[able] - np.r_[0, np.cumsum(length)[:-1]], length)
                score = np.zeros(len(able), np.int64)
                np.add.at(score, np.repeat(np.arange(len(able)), length), weight[cols[at]] * x[at])
                weight[self.terms[q]] = 0
                self.scored += len(able)
                good = score >= self.bar(q)
                if good.any():
                    able, score = able[good], score[good]
                    self.best[q] = np.sort(np.concatenate([self.best[q], score]))[-self.k :]
                    yield q, order[able + low], score


def _found(pairs: DataFrame, k: int, item_kind: str, id_kind: str) -> DataFrame:
    """(item_id, doc_id, score): the k best of every chunk, by score and id, of those that no earlier chunk of the task beats."""

    def run(batches):
        blocks: dict[int, Block] = {}
        for batch in batches:
            for i in range(batch.num_rows):
                number = batch.column("block")[i].as_py()
                if number not in blocks:
                    blocks[number] = Block(batch.column("queries")[i].as_py(), k)
                block = blocks[number]
                numbers = [np.frombuffer(batch.column(c)[i].as_buffer(), np.int64) for c in ("sizes", "terms", "impacts")]
                found = list(block.search(*numbers))
                if not found:
                    continue
                query = np.concatenate([np.full(len(rows), q) for q, rows, _ in found])
                score = np.concatenate([s for _, _, s in found])
                ids = batch.column("ids")[i].values.take(pa.array(np.concatenate([rows for _, rows, _ in found])))
                hit = pa.table({"q": query, "s": score, "id": ids})
                hit = hit.filter(pa.array(score >= np.asarray([block.bar(q) for q in range(len(block.ids))])[query]))
                hit = hit.take(pc.sort_indices(hit, [("q", "ascending"), ("s", "descending"), ("id", "ascending")]))
                q = hit["q"].to_numpy()
                start = np.flatnonzero(np.r_[True, q[1:] != q[:-1]])
                place = np.arange(len(q)) - np.repeat(start, np.diff(np.r_[start, len(q)]))
                hit = hit.filter(pa.array(place < k))
                items = pa.array([block.ids[x] for x in hit["q"].to_pylist()], type=batch.column("queries").type.value_type.field("item").type)
                yield pa.RecordBatch.from_arrays([items, hit["id"].combine_chunks(), hit["s"].combine_chunks()], ["item_id", "doc_id", "score"])

    return pairs.mapInArrow(run, f"item_id {item_kind}, doc_id {id_kind}, score bigint")


def ranked_search(
    docs: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text",
    item_col: str = "item_id", item_text_col: str = "text", block_terms: int = BLOCK_TERMS,
) -> DataFrame:
    """The ``k`` best documents of every item: item id, ``rank`` from 1, document id, ``score``.

    Terms are runs of ASCII letters (A-Z lower-cased), digits and other characters beyond ASCII. A term t of weight
    floor(1000 ln((2 N + 2) / (2 df + 1))) adds its weight times (10^9 tf) div (1000 tf + 8 m), where m = 10 + (90 n N) div L.
    Only scores above 0 count, so documents and items without terms (null, empty) have no rows; ties go to the smaller
    id, a null id last. Repeated document rows are documents of their own. Rows of one item id are one item, with the
    terms of all; a null item id is an item, too. Empty tables give none; other columns are not read. Terms are told
    apart by 64-bit hashes.
    """
    spark = docs.sparkSession
    asked = _terms(items.select(F.col(item_col).alias("_id"), text_bytes(item_text_col).alias("text")))
    wanted = written(asked.select(F.col("_id").alias("item"), F.explode("terms").alias("term")).distinct(), "query-terms")
    marked = shared_bits(spark, bitmap_of(wanted.select("term").distinct(), F.col("term"), BITS), BITS)
    vectors = written(_terms(docs.select(F.col(id_col).alias("_id"), text_bytes(text_col).alias("text")), marked).filter("n > 0"), "vectors")
    n_docs, tokens = vectors.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = vectors.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    weigh = F.floor(F.lit(1000.0) * F.log(F.lit(2.0 * n_docs + 2) / (2.0 * F.col("df") + 1))).cast("bigint")
    weighted = wanted.join(df, "term").select("item", F.struct("term", weigh.alias("weight")).alias("x"))
    queries = weighted.groupBy("item").agg(F.sort_array(F.collect_list("x")).alias("terms"))
    queries = written(queries.withColumn("size", F.size("terms").cast("bigint")), "queries")
    blocks = max(1, -(-(queries.agg(F.sum("size")).first()[0] or 0) // block_terms))
    in_blocks = queries.groupBy(F.pmod(F.xxhash64("item"), F.lit(blocks)).alias("block")).agg(F.collect_list(F.struct("item", "terms")).alias("queries"))
    m = F.lit(10).cast("bigint") + F.expr(f"(bigint(90) * n * bigint({n_docs})) div bigint({max(1, tokens)})")
    impact = F.expr("transform(times, tf -> (bigint(1000000000) * tf) div (bigint(1000) * tf + bigint(8) * m))")
    ready = vectors.filter("size(terms) > 0").withColumn("m", m).withColumn("impacts", impact)
    length = F.aggregate("impacts", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    # longest first in every task: bars rise early, and no rows move for it
    chunks = _packed_chunks(ready.withColumn("length", length).sortWithinPartitions(F.col("length").desc()))
    dealt = chunks.withColumn("block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(blocks - 1).cast("bigint"))))
    kinds = items.schema[item_col].dataType.simpleString(), docs.schema[id_col].dataType.simpleString()
    found = written(_found(dealt.join(in_blocks, "block"), k, *kinds), "found")
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    ranked = top_n_per_key(found, ["item_id"], order, k, "rank", ["doc_id"])
    return ranked.select(F.col("item_id").alias(item_col), F.col("rank").cast("int"), F.col("doc_id").alias(id_col), "score")
