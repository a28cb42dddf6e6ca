"""N-gram Jaccard join of texts: T-occurrence search (DivideSkip) in blocks that hold every possible partner.

Sets of word shingles are 64-bit hashes. Equal sets are one class from the start. Classes are routed to blocks: two
sets that link share a signature, classes that share signatures are connected, and a connected block is searched
on its own. In a block each set asks the inverted lists for the larger sets with the overlap T that it needs: the
short lists are merged and counted, whoever has T minus the number of long lists is probed in the long ones by
binary search. Blocks of many shingles are cut into chunks, and every pair of chunks is a task.

Signatures. Sets of up to 32 shingles: the T = 2 prefix filter, exactly: the smallest n - ceil(0.8 n) + 2 hashes of
linked sets have two in common, and every pair of them is a signature. Larger sets: the least of the set's hashes in
each of 108 orders, three orders to a signature. Linked sets agree in an order with a chance of 0.8 or more and in one
of the 36 signatures but for a chance below 1e-11. Only one set of every class has signatures; texts never move:
the sets that a block needs are built in a second scan, which a bitmap of the wanted rows cuts short.

Only sets whose sizes are within a quarter can link, so a block is searched by bands of sizes: every task takes one
band and the next.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.components import components
from ..plans.lineage import written
from .common import bitmap_of, shared_bits, text_bytes

SHINGLE = 5
SHORT = 32
#: Signatures of a larger set, and orders in each.
BANDS, ROWS = 36, 3
#: Places of the bitmaps of wanted rows and sets, 2^27: 16 MB each at any size of the input.
BITS = 27
#: Shingles of one chunk of a block, 8 bytes each.
CHUNK = 1 << 20
WORDS_HELD = 400_000
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_ORDERS = np.random.default_rng(5).integers(0, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Sorted hashes of the distinct shingles of a text."""

    def __init__(self, size: int = SHINGLE):
        self.size, self.seen = size, {}

    def __call__(self, text: bytes) -> np.ndarray:
        words = text.lower().split()
        if len(self.seen) > WORDS_HELD:
            self.seen.clear()
        for w in words:
            if w not in self.seen:
                self.seen[w] = xxhash.xxh3_64_intdigest(w)
        n = len(words)
        if not n:
            return np.empty(0, np.uint64)
        h = np.fromiter(map(self.seen.__getitem__, words), np.uint64, n)
        size = min(self.size, n)
        out = np.full(n - size + 1, size, np.uint64)
        for k in range(size):
            out = _mix(out) + h[k : n - size + 1 + k]
        return np.unique(_mix(out))


def identity(shingles: np.ndarray) -> int:
    return int(np.int64(np.uint64(xxhash.xxh3_64_intdigest(shingles.tobytes()))))


def signatures(s: np.ndarray) -> np.ndarray:
    """Sorted hashes of a set to the keys one of which every linked set shares."""
    n, out = len(s), []
    if 2 <= n <= SHORT * 5 // 4:
        head = s[: n - (4 * n + 4) // 5 + 2]
        i, j = np.triu_indices(len(head), 1)
        out.append(_mix(head[i]) + head[j])
    if n > SHORT:
        least = np.full(BANDS * ROWS, ~np.uint64(0))
        for k in range(0, n, 4096):
            least = np.minimum(least, (s[k : k + 4096, None] * _ORDERS).min(axis=0))
        key = np.arange(BANDS, dtype=np.uint64)
        for column in least.reshape(BANDS, ROWS).T:
            key = _mix(key) + column
        out.append(_mix(key))
    return np.unique(np.concatenate(out)).view(np.int64) if out else np.empty(0, np.int64)


def set_table(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(_id, n, node, sigs): size, identity and signatures of every row's set."""
    slim = docs.select(F.col(id_col).alias("_id"), text_bytes(text_col).alias("text"))

    def run(batches):
        shingler = Shingler()
        for batch in batches:
            sets = [shingler(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([identity(s) for s in sets], pa.int64()),
                pa.array([signatures(s) for s in sets], pa.list_(pa.int64())),
            ], ["_id", "n", "node", "sigs"])

    kind = docs.schema[id_col].dataType.simpleString()
    return slim.mapInArrow(run, f"_id {kind}, n bigint, node bigint, sigs array<bigint>")


def block_links(sets: list[np.ndarray], first_band: np.ndarray, chunk: np.ndarray, copies: np.ndarray, cross: bool) -> tuple[np.ndarray, np.ndarray]:
    """Root and number of linked rows of every set among these.

    ``first_band`` marks the sets of the lower band; links among the others belong to the next task. With ``cross`` only
    links between chunks count. Sets come in ascending size. DivideSkip: of the lists of a set, the longest T / (0.01 log2 M + 1) are long.
    """
    n = len(sets)
    sizes = np.fromiter(map(len, sets), np.int64, n)
    owner = np.repeat(np.arange(n), sizes)
    flat = np.concatenate(sets)
    order = np.argsort(flat, kind="stable")
    lists, values = owner[order], flat[order]
    first = np.flatnonzero(np.r_[True, values[1:] != values[:-1]])
    stop = np.repeat(np.r_[first[1:], len(values)], np.diff(np.r_[first, len(values)]))
    place = np.empty(len(flat), np.int64)
    place[order] = np.arange(len(flat))
    offset = np.r_[0, np.cumsum(sizes)]
    root, links = np.arange(n), np.zeros(n, np.int64)

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for q in np.flatnonzero(first_band):  # the lower band has the smaller sets
        size = int(sizes[q])
        most = int(np.searchsorted(sizes, size * 5 // 4, "right"))
        at = place[offset[q] : offset[q + 1]]
        begin, end = at + 1, stop[at]
        length = end - begin
        full = length > 0
        need = (4 * size + 4) // 5
        if most <= q + 1 or np.count_nonzero(full) < need:
            continue
        begin, end, length = begin[full], end[full], length[full]
        by = np.argsort(length, kind="stable")
        n_long = min(need - 1, int(need / (0.01 * np.log2(length.max() + 1) + 1)))
        short, long = by[: len(by) - n_long], by[len(by) - n_long :]
        lengths = length[short]
        if not len(short):
            continue
        run = np.arange(lengths.sum()) + np.repeat(begin[short] - np.r_[0, np.cumsum(lengths)[:-1]], lengths)
        merged = lists[run]
        count = np.bincount(merged[merged < most] - q, minlength=most - q)
        found = np.flatnonzero(count >= max(1, need - n_long))
        if cross:
            found = found[chunk[found + q] != chunk[q]]
        hits = count[found]
        found = found + q
        for done, k in enumerate(long):  # shortest of the long lists first
            if not len(found):
                break
            part = lists[begin[k] : end[k]]
            spot = np.searchsorted(part, found)
            hits = hits + (part[np.minimum(spot, len(part) - 1)] == found)
            able = hits + (len(long) - done - 1) >= need
            found, hits = found[able], hits[able]
        true = 100 * hits >= 80 * (size + sizes[found] - hits)
        for c in found[true]:
            x, y = find(q), find(c)
            root[max(x, y)] = min(x, y)
        links[q] += copies[found[true]].sum()
        links[found[true]] += copies[q]
    return np.array([find(x) for x in range(n)], np.int64), links


def _search(rows: DataFrame) -> DataFrame:
    """(node, root, links) of every task's sets; rows of a task stand together in one partition."""

    def solve(key, held):
        best = {}
        for node, shingles, low, chunk, copies in held:
            best.setdefault(node, (np.frombuffer(shingles, np.uint64), chunk, copies, low))
        nodes = sorted(best, key=lambda x: (len(best[x][0]), x))
        root, links = block_links(
            [best[x][0] for x in nodes], np.array([best[x][3] for x in nodes], bool), np.array([best[x][1] for x in nodes]),
            np.array([best[x][2] for x in nodes]), key[2] != key[3],
        )
        return pa.RecordBatch.from_arrays(
            [pa.array(nodes, pa.int64()), pa.array([nodes[r] for r in root], pa.int64()), pa.array(links)], ["node", "root", "links"]
        )

    def run(batches):
        key, held = None, []
        for batch in batches:
            for *task, node, shingles, low, chunk, copies in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if task != key:
                    if held:
                        yield solve(key, held)
                    key, held = task, []
                held.append((node, shingles, low, chunk, copies))
        if held:
            yield solve(key, held)

    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartition(parts, "block", "band", "i", "j").sortWithinPartitions("block", "band", "i", "j")
    return dealt.select("block", "band", "i", "j", "node", "shingles", "low", "chunk", "copies").mapInArrow(run, "node bigint, root bigint, links bigint")


def _sets_of(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rows of ``wanted`` with the set of their representative's text.

    Rows whose id is no representative's are left out before their set is built, sets that are not wanted before the
    shuffle; what shares a place of a bitmap with a wanted one is left out by the join.
    """
    spark = docs.sparkSession
    ids = shared_bits(spark, bitmap_of(wanted, F.xxhash64("rep"), BITS), BITS)
    nodes = shared_bits(spark, bitmap_of(wanted, F.col("node"), BITS), BITS)
    slim = docs.select(F.xxhash64(id_col).alias("key"), text_bytes(text_col).alias("text"))

    def run(batches):
        shingler, by_id, by_node, sent = Shingler(), ids(), nodes(), set()
        for batch in batches:
            found = {}
            for text in batch.column(1).filter(pa.array(by_id(batch.column(0).to_numpy()))):
                held = shingler(text.as_py())
                node = identity(held)
                # a row may repeat an id with another text, or a text of this task
                if node not in sent and by_node(np.array([node]))[0]:
                    found[node] = held.tobytes()
            sent.update(found)
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int64()), pa.array(list(found.values()), pa.binary())], ["node", "shingles"])

    return slim.mapInArrow(run, "node bigint, shingles binary").join(wanted.select("node", "tasks", "copies"), "node")


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK) -> DataFrame:
    """Components of texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

    Per input row: id, ``n_shingles``, ``component_id`` (the smallest id that links lead to, itself included) and
    ``n_links`` (rows linked directly). Words are lower-cased (A-Z) and split at blanks; a text of one to four words
    is one shingle; a null, empty or blank text has none and links with nothing. Repeated rows link like any equal
    texts; a null id never is a component id unless all ids of the component are null. An empty table gives no rows;
    other columns are not read. Nothing is capped: a block of any size is searched, in chunks.
    """
    sets = written(set_table(docs, id_col, text_col), "sets")
    # one row per distinct set; all its copies have the same signatures
    classes = written(sets.filter("n > 0").groupBy("node").agg(
        F.min("_id").alias("rep"), F.count("*").alias("copies"), F.min("n").alias("n"), F.first("sigs").alias("sigs"),
    ), "distinct")
    keys = classes.select("node", F.explode("sigs").alias("sig"))
    classes = classes.drop("sigs")
    shared = keys.groupBy("sig").agg(F.min("node").alias("low"), F.max("node").alias("high")).filter("low < high").select("sig", "low")
    blocks = components(keys.join(shared, "sig").filter("node <> low").select(F.col("node").alias("a"), F.col("low").alias("b")))
    members = written(blocks.withColumnRenamed("root", "block").join(classes, "node"), "members")
    # bands of sizes a quarter apart: a set meets the sets of its own band and of the next
    banded = members.withColumn("own", F.floor(F.log("n") / F.lit(np.log(1.25)) - 1e-9).cast("bigint"))
    lower = banded.select("block", F.col("own").alias("band")).distinct()
    each = banded.select("*", F.explode(F.array("own", F.col("own") - 1)).alias("band")).join(lower, ["block", "band"])
    weight = each.groupBy("block", "band").agg(F.ceil(F.sum("n") / F.lit(chunk)).cast("bigint").alias("k"))
    task = F.struct("block", "band", "k", (F.col("own") == F.col("band")).alias("low"), F.pmod(F.xxhash64("node"), "k").alias("chunk"))
    wanted = written(each.join(weight, ["block", "band"]).groupBy("node", "rep", "copies").agg(F.collect_list(task).alias("tasks")), "wanted")
    found = _sets_of(docs, wanted, id_col, text_col).select("node", "copies", "shingles", F.explode("tasks").alias("t")).select("*", "t.*")
    other = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("k") - 1)).alias("other")
    tasks = found.select("*", other).withColumns({"i": F.least("chunk", "other"), "j": F.greatest("chunk", "other")})
    links = written(_search(tasks), "links")
    roots = components(links.filter("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b")))
    per_node = links.groupBy("node").agg(F.sum("links").alias("links"))
    placed = classes.join(roots, "node", "left").join(per_node, "node", "left").withColumn("root", F.coalesce("root", "node"))
    placed = written(placed, "classes")
    smallest = placed.groupBy("root").agg(F.min("rep").alias("component_id"))
    named = placed.join(smallest, "root").select("node", "component_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    return sets.drop("sigs").join(named, "node", "left").select(
        F.col("_id").alias(id_col), F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("_id")).alias("component_id"),
        F.when(F.col("n") > 0, F.col("n_links")).otherwise(F.lit(0)).cast("bigint").alias("n_links"),
    )
