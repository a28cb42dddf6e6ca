"""Mention streams: removal of repeats, weekly signals and sliding windows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import half_even
from ..sources.sinks import overwrite_partitions
from .arrivals import each_batch


def event_time(df: DataFrame, column: str = "published_at") -> DataFrame:
    """Watermarks need a zoned timestamp; files may carry one without a zone."""
    return df.withColumn(column, F.col(column).cast("timestamp"))


def dedup_mentions(
    mentions: DataFrame,
    keys: Sequence[str] = ("project_id", "connector", "external_id"),
    time: str = "published_at",
    delay: str = "1 day",
) -> DataFrame:
    """First arrival per key; state is dropped once the watermark has passed."""
    return event_time(mentions, time).withWatermark(time, delay).dropDuplicatesWithinWatermark(list(keys))


def ingest_mentions(
    mentions: DataFrame,
    path: str,
    checkpoint: str,
    keys: Sequence[str] = ("project_id", "connector", "external_id"),
    order: Sequence[str] = ("published_at",),
):
    """Start a stream that stores the whole row of the first arrival per key, over all batches.

    Unlike ``dedup_mentions`` it forgets no key, and which row of a batch is kept does not depend on the partitions.
    The table is partitioned by batch number, so a batch that is run again replaces itself.
    """

    def write(first: DataFrame, repeats: DataFrame, number: int) -> None:
        overwrite_partitions(first.withColumn("batch", F.lit(number)), path, ["batch"])

    return each_batch(mentions, [F.col(k) for k in keys], order, checkpoint, write)


def author_sessions(
    mentions: DataFrame,
    keys: Sequence[str] = ("project_id", "author"),
    time: str = "published_at",
    gap: str = "1 day",
    delay: str = "1 day",
) -> DataFrame:
    """Sessions per author: mentions with less than ``gap`` between one and the next; a session appears once it is closed.

    ``session_end`` is the last mention; mentions later than the watermark are left out.
    """
    return (
        event_time(mentions, time)
        .withWatermark(time, delay)
        .groupBy(F.session_window(time, gap).alias("w"), *keys)
        .agg(
            F.count(F.lit(1)).alias("mentions"), F.max(time).alias("session_end"), F.sum("engagement").alias("engagement"),
            F.avg("sentiment").alias("mean_sentiment"),
        )
        .select(*keys, F.col("w.start").alias("session_start"), "session_end", "mentions", "engagement", "mean_sentiment")
    )


def weekly_signals(
    mentions: DataFrame,
    keys: Sequence[str] = ("project_id", "source"),
    time: str = "published_at",
    delay: str = "1 day",
    length: str = "7 days",
) -> DataFrame:
    """Volume and mean sentiment per tumbling period; a period appears once it is closed."""
    return (
        event_time(mentions, time)
        .withWatermark(time, delay)
        .groupBy(F.window(time, length).alias("w"), *keys)
        .agg(F.count(F.lit(1)).alias("volume"), F.avg("sentiment").alias("mean_sentiment"))
        .select(
            F.col("w.start").cast("date").alias("period_start"), F.col("w.end").cast("date").alias("period_end"),
            *keys, "volume", "mean_sentiment",
        )
    )


def sliding_counts(
    mentions: DataFrame,
    keys: Sequence[str] = ("project_id", "narrative"),
    time: str = "published_at",
    delay: str = "1 day",
    length: str = "7 days",
    step: str = "1 day",
) -> DataFrame:
    """Mentions per sliding window and narrative."""
    return (
        event_time(mentions, time)
        .withWatermark(time, delay)
        .groupBy(F.window(time, length, step).alias("w"), *keys)
        .agg(F.count(F.lit(1)).alias("n"))
        .select(F.col("w.end").cast("date").alias("window_end"), *keys, "n")
    )


def momentum_of_windows(
    windows: DataFrame, keys: Sequence[str] = ("project_id",), item: str = "narrative", days: int = 7
) -> DataFrame:
    """Share of each closed window and its change against the window ``days`` earlier (batch)."""
    totals = windows.groupBy(*keys, "window_end").agg(F.sum("n").alias("t"))
    rows = windows.join(totals, [*keys, "window_end"]).withColumn("_share", 100 * F.col("n") / F.col("t"))
    # one row per closed window: a series as long as the calendar, not as the mentions
    rows = rows.withColumn("_d", F.datediff("window_end", F.lit("1970-01-01")))
    earlier = F.max("_share").over(W.partitionBy(*keys, item).orderBy("_d").rangeBetween(-days, -days))
    return rows.select(
        *keys, "window_end", item, "n",
        half_even(F.col("_share"), 2).alias("volume_pct"),
        half_even(F.col("_share") - earlier, 2).alias("momentum_7d"),
    )


def run_available(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Process what is there, then stop; output and offsets stay in the given folders."""
    query = (
        stream.writeStream.format("parquet").outputMode(mode)
        .option("path", path).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
