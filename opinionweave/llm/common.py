"""Helpers the operators of this package share."""

from __future__ import annotations

from collections.abc import Callable, Iterable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Lower-cases A-Z and turns every other ASCII byte that is no digit or letter into a blank.
WORDS_ONLY = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)
#: The same without the digits.
LETTERS_ONLY = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(n: int, id_col: str = "doc_id") -> Column:
    """Fold of a row: crc32 of its id as text, modulo n; a missing id counts as empty text."""
    return (F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % n).cast("int")


def text_bytes(col: str = "text") -> Column:
    """The whole text as UTF-8 bytes; null is empty."""
    return F.coalesce(F.col(col), F.lit("")).cast("binary")


def unclaimed(names: Iterable[str], *own: str) -> None:
    """Raise where a name, in whatever case, is one that an operator uses itself."""
    if clash := sorted({n for n in names if n.lower() in {o.lower() for o in own}}):
        raise ValueError(f"names the operator uses itself: {', '.join(clash)}")


def shared(spark: SparkSession, model) -> Callable[[], object]:
    """Send a model of bounded size to the executors once; what is returned gives it back inside a task."""
    kind, state = type(model), spark.sparkContext.broadcast(vars(model))

    def get():
        out = kind.__new__(kind)
        vars(out).update(state.value)
        return out

    return get



def bitmap_of(rows: DataFrame, hashed: Column, bits: int) -> DataFrame:
    """(part, map): a bitmap of 2^``bits`` places that marks the low bits of the hashes, in parts of 32,768 places."""
    place = hashed.bitwiseAND(F.lit((1 << bits) - 1))
    marked = rows.select(F.shiftright(place, 15).alias("part"), place.bitwiseAND(F.lit(32767)).alias("place"))
    return marked.groupBy("part").agg(F.bitmap_construct_agg("place").alias("map"))


class Marked:
    """Which hashes the bitmap marks; others may share a place with one that it does."""

    def __init__(self, parts: list, bits: int):
        self.mask, self.map = (1 << bits) - 1, np.zeros(max(1, 1 << bits >> 3), np.uint8)
        for part, places in parts:
            self.map[part * 4096 : part * 4096 + len(places)] = np.frombuffer(places, np.uint8)[: len(self.map)]

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        place = hashes & self.mask
        return (self.map[place >> 3] >> (place & 7).astype(np.uint8) & 1).astype(bool)


def shared_bits(spark: SparkSession, parts: DataFrame, bits: int) -> Callable[[], Marked]:
    """The bitmap, of a size that ``bits`` alone sets, inside the tasks."""
    return shared(spark, Marked([(r[0], bytes(r[1])) for r in parts.collect()], bits))
