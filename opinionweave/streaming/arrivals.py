"""Which row of a key came first, over all batches of a stream."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import fresh_path, remove_path
from ..plans.ranking import latest_per_key
from ..plans.skew import null_safe_join


def with_new_keys(rows: DataFrame, keys: Sequence[Column]) -> DataFrame:
    """(k0, k1, ..., row): every row of the stream, and one without ``row`` for each key that comes for the first time.

    The keys seen so far are state of the stream: one entry a key in the state store, whatever the rows hold. They stay;
    for more keys than memory holds, set the RocksDB state store in the session. A null key is a key.
    """
    names = [f"k{i}" for i in range(len(keys))]
    every = rows.select(*[k.alias(n) for k, n in zip(keys, names, strict=True)], F.struct(*rows.columns).alias("row"))
    new = every.select(*names).dropDuplicates(names)
    return every.unionByName(new.withColumn("row", F.lit(None).cast(every.schema["row"].dataType)))


def first_rows(staged: DataFrame, order: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(first arrivals, repeats) among the rows of a batch of ``with_new_keys``, kept with a number ``_row``.

    Of the rows of a new key the least in ``order`` is the first, missing values before others, then by hash.
    """
    names = [c for c in staged.columns if c not in ("row", "_row")]
    rows = staged.filter("row is not null")
    ranked = rows.select(*names, *[F.col(f"row.{o}").alias(f"o{i}") for i, o in enumerate(order)], F.xxhash64("row").alias("hash"), "_row")
    by = [*(F.col(f"o{i}") for i in range(len(order))), F.col("hash"), F.col("_row")]
    # one row a key goes into the join, however often a key repeats
    first = null_safe_join(latest_per_key(ranked, names, by), staged.filter("row is null").select(*names), names).select("_row")
    return rows.join(first, "_row", "left_semi").select("row.*"), rows.join(first, "_row", "left_anti").select("row.*")


def each_batch(
    stream: DataFrame, keys: Sequence[Column], order: Sequence[str], checkpoint: str,
    write: Callable[[DataFrame, DataFrame, int], None], spread: int | None = None,
):
    """Start a stream that hands ``write`` the first arrivals and the repeats of every micro-batch, and its number.

    A batch that is run again hands on the same rows. ``spread`` redistributes a batch over that many tasks.
    """
    spark = stream.sparkSession

    def run(batch: DataFrame, number: int) -> None:
        # read several times, while the state of the stream must advance once
        staged = fresh_path(spark, "batch")
        (batch.repartition(spread) if spread else batch).withColumn("_row", F.monotonically_increasing_id()).write.parquet(staged)
        write(*first_rows(batch.sparkSession.read.parquet(staged), order), number)
        remove_path(spark, staged)

    return (
        with_new_keys(stream, keys).writeStream.outputMode("append").foreachBatch(run)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
