"""Nearest vectors by blocks, exact or through an inverted file over coarse cells.

Vectors are packed into chunks of bounded size and queries into blocks, both by Spark; chunks meet blocks by an equi-join
and a task multiplies one by one. Nothing but the cells' centres passes through the driver.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import written
from ..plans.ranking import top_n_per_key
from ..plans.skew import salted_join

#: Vectors of a chunk, and queries of a block.
CHUNK_ROWS, BLOCK_ROWS = 4096, 512


def _unit(m):
    import numpy as np

    norm = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, norm, out=np.zeros_like(m), where=norm > 0)


def packed(vectors: DataFrame, row_id: str, vector: str, rows: int, by_cell: bool = False) -> DataFrame:
    """(cell, ids, units): rows with a vector, packed as unit vectors; with ``by_cell``, out of rows that stand together by cell."""
    kind = vectors.schema[row_id].dataType.simpleString()

    def pack(batches):
        import numpy as np
        import pandas as pd

        for pdf in batches:
            cells = pdf["cell"].to_numpy()
            cut = np.flatnonzero(np.r_[True, cells[1:] != cells[:-1]]) if len(pdf) else []
            for a, b in zip(cut, [*cut[1:], len(pdf)], strict=True):
                for i in range(a, b, rows):
                    part = pdf.iloc[i : min(i + rows, b)]
                    m = _unit(np.vstack(part[vector].to_numpy()).astype(float))
                    yield pd.DataFrame({"cell": [cells[a]], "ids": [part[row_id].to_numpy()], "units": [m.tobytes()]})

    known = vectors.filter(F.col(vector).isNotNull()).select(row_id, vector, F.col("cell") if by_cell else F.lit(0).alias("cell"))
    return known.mapInPandas(pack, f"cell int, ids array<{kind}>, units binary")


def _best_of_pairs(pairs: DataFrame, k: int, query_id: str, row_id: str, query_kind: str, row_kind: str, digits: int) -> DataFrame:
    """The k best rows of every chunk for every query of the block beside it, ties by row id."""

    def search(batches):
        import numpy as np
        import pandas as pd

        for pdf in batches:
            for ids, units, queries, block in zip(pdf["ids"], pdf["units"], pdf["queries"], pdf["block"], strict=True):
                base = np.frombuffer(units).reshape(len(ids), -1)
                sims = np.round(base @ np.frombuffer(block).reshape(len(queries), -1).T, digits)
                keep = min(k, len(ids))
                bar = np.partition(sims, len(ids) - keep, axis=0)[len(ids) - keep]
                row, query = np.nonzero(sims >= bar)
                found = pd.DataFrame({"_q": query, row_id: np.asarray(ids)[row], "similarity": sims[row, query]})
                found = found.sort_values(["_q", "similarity", row_id], ascending=[True, False, True]).groupby("_q").head(k)
                yield pd.DataFrame({query_id: np.asarray(queries)[found["_q"]], row_id: found[row_id], "similarity": found["similarity"]})

    return pairs.select("ids", "units", "queries", "block").mapInPandas(search, f"{query_id} {query_kind}, {row_id} {row_kind}, similarity double")


def _meet(chunks: DataFrame, blocks: DataFrame, k: int, query_id: str, row_id: str, query_kind: str, row_kind: str, digits: int, salts: int = 16) -> DataFrame:
    named = blocks.select("cell", F.col("ids").alias("queries"), F.col("units").alias("block"))
    # the chunks of a cell are dealt to many tasks, and its blocks go to each of them
    spread = chunks.withColumn("first", F.col("ids")[0])
    found = _best_of_pairs(salted_join(spread, named, ["cell"], ["first"], salts), k, query_id, row_id, query_kind, row_kind, digits)
    # each chunk hands on k rows a query at most
    return top_n_per_key(found, [query_id], [F.col("similarity").desc(), F.col(row_id).asc()], k, "rank", spread_by=[row_id])


def cosine_topk(
    base: DataFrame, queries: DataFrame, k: int, base_id: str = "vec_id", query_id: str = "query_id", vector: str = "embedding", digits: int = 6,
) -> DataFrame:
    """Exact k nearest base vectors per query by cosine (ties by base id): query, base id, similarity, rank.

    Every chunk of the base is multiplied with every block of queries; both are bounded, and each pair hands on its own
    k best, so memory does not grow with either side. Rows without a vector take no part; a zero vector is 0 to all.
    """
    chunks = packed(base, base_id, vector, CHUNK_ROWS)
    kinds = queries.schema[query_id].dataType.simpleString(), base.schema[base_id].dataType.simpleString()
    parts = int(base.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return _meet(chunks, packed(queries, query_id, vector, BLOCK_ROWS), k, query_id, base_id, *kinds, digits, max(16, parts))


@dataclass
class InvertedFile:
    """Vectors in cells: ``chunks`` of (cell, ids, units), and the unit ``centres`` of the cells, a row each."""

    chunks: DataFrame
    centres: list[list[float]]
    row_id: str
    vector: str


def _cells_of(vectors: DataFrame, centres: list[list[float]], vector: str, probes: int) -> DataFrame:
    """The rows with their ``probes`` nearest cells, a row each."""

    def assign(batches):
        import numpy as np

        c = np.asarray(centres)
        for pdf in batches:
            if len(pdf):
                sims = _unit(np.vstack(pdf[vector].to_numpy()).astype(float)) @ c.T
                near = np.argsort(-sims, axis=1, kind="stable")[:, :probes]
                pdf = pdf.loc[np.repeat(pdf.index, near.shape[1])].assign(cell=near.ravel())
                yield pdf

    known = vectors.filter(F.col(vector).isNotNull())
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in known.schema) + ", cell int"
    return known.mapInPandas(assign, schema)


def build_index(
    vectors: DataFrame, cells: int = 64, row_id: str = "vec_id", vector: str = "embedding", sample: int = 65_536, rounds: int = 8,
) -> InvertedFile:
    """Put every vector into the nearest of ``cells`` cells, in chunks of bounded size, written to the shared folder.

    The centres are spherical k-means of at most ``sample`` vectors, those whose ids hash lowest; that bound and the
    number of cells are all that passes through the driver. Every vector is indexed, a cell may hold any number.
    """
    import numpy as np

    known = vectors.filter(F.col(vector).isNotNull()).select(row_id, vector)
    some = known.orderBy(F.xxhash64(row_id), row_id).limit(sample).select(vector).toPandas()[vector]
    centres = np.zeros((0, 1))
    if len(some):
        m = _unit(np.vstack(some.to_numpy()).astype(float))
        centres = m[:cells].copy()
        for _ in range(rounds):
            near = (m @ centres.T).argmax(axis=1)
            sums = np.zeros_like(centres)
            np.add.at(sums, near, m)
            moved = np.linalg.norm(sums, axis=1) > 0
            centres[moved] = _unit(sums)[moved]
    listed = centres.tolist()
    placed = _cells_of(known, listed, vector, 1) if listed else known.withColumn("cell", F.lit(0))
    # a hot cell is dealt to many tasks; rows of a cell stand together inside a task
    parts = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = placed.repartition(parts, "cell", F.pmod(F.xxhash64(row_id), F.lit(16))).sortWithinPartitions("cell")
    return InvertedFile(written(packed(dealt, row_id, vector, CHUNK_ROWS, by_cell=True), "index"), listed, row_id, vector)


def index_topk(index: InvertedFile, queries: DataFrame, k: int, probes: int = 8, query_id: str = "query_id", digits: int = 6) -> DataFrame:
    """k nearest indexed vectors per query among the ``probes`` cells nearest to it: query, row id, similarity, rank.

    With as many probes as cells the result is exact. Queries are dealt to their cells by a join, none is collected.
    """
    kinds = queries.schema[query_id].dataType.simpleString(), index.chunks.schema["ids"].dataType.elementType.simpleString()
    asked = queries.select(query_id, index.vector)
    placed = _cells_of(asked, index.centres, index.vector, probes) if index.centres else asked.withColumn("cell", F.lit(0))
    parts = int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = placed.repartition(parts, "cell", F.pmod(F.xxhash64(query_id), F.lit(16))).sortWithinPartitions("cell")
    blocks = packed(dealt, query_id, index.vector, BLOCK_ROWS, by_cell=True)
    return _meet(index.chunks, blocks, k, query_id, index.row_id, *kinds, digits)


def recall(found: DataFrame, exact: DataFrame, query_id: str = "query_id", row_id: str = "vec_id") -> DataFrame:
    """One row: ``queries``, rows of the exact result (``wanted``), and the share of them that are found (``recall``)."""
    hit = found.select(query_id, row_id, F.lit(1).alias("_hit"))
    return exact.join(hit, [query_id, row_id], "left").agg(
        F.count_distinct(query_id).alias("queries"), F.count(F.lit(1)).alias("wanted"),
        (F.count("_hit") / F.count(F.lit(1))).alias("recall"),
    )
