"""Trends, timelines, province tables, alerts and brief facts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import constants as C
from ..functions.scalars import half_even, index_z
from ..plans.asof import asof_join
from ..plans.ranking import last_periods, top_n_per_key
from ..sources.tables import national
from .index import latest_snapshots


def trend(
    snapshots: DataFrame, metrics: Sequence[str], limit: int = 12, keys: Sequence[str] = ("project_id",)
) -> DataFrame:
    """National rows of the newest ``limit`` periods of each metric, oldest first."""
    rows = snapshots.filter(F.col("metric").isin(list(metrics)))
    if {"province_code", "segment"} <= set(snapshots.columns):
        rows = national(rows)
    return last_periods(rows, [*keys, "metric"], "period_end", limit).orderBy(*keys, "period_end", "metric")


def trend_pivot(
    trend_rows: DataFrame, metrics: Sequence[str], keys: Sequence[str] = ("project_id",), latest_by: str = "created_at"
) -> DataFrame:
    """One row per period, one column per metric; the later duplicate wins."""
    order = F.col(latest_by) if latest_by in trend_rows.columns else F.col("source")
    return trend_rows.groupBy(*keys, "period_end").pivot("metric", list(metrics)).agg(
        F.max_by("value", order)
    )


def distinct_periods(snapshots: DataFrame, keys: Sequence[str] = ("project_id", "metric")) -> DataFrame:
    return snapshots.groupBy(*keys).agg(F.countDistinct("period_end").alias("periods"))


def timeline(events: DataFrame, limit: int = 20, keys: Sequence[str] = ("project_id",), row_id: str = "event_id") -> DataFrame:
    """Newest events per project, shown oldest first. Order in time is not cause."""
    newest = top_n_per_key(events, keys, [F.col("occurred_at").desc(), F.col(row_id).desc()], limit, spread_by=[row_id])
    return newest.orderBy(*keys, "occurred_at", row_id)


def trend_at_events(
    trend_rows: DataFrame, events: DataFrame, keys: Sequence[str] = ("project_id",), time: str = "occurred_at", period: str = "period_end",
    rows_per_slice: int = 500_000,
) -> DataFrame:
    """Events with the newest value of the trend at or before them and its change against the period before.

    ``trend_rows``: keys, ``period``, value; one series per key. Columns ``period``, ``value`` and ``change``
    come after those of the events. Order in time is not cause.
    """
    series = period_deltas(trend_rows, list(keys), period=period).withColumnRenamed("delta", "change")
    return asof_join(events, series, keys, time, period, [period, "value", "change"], rows_per_slice)


def province_table(
    snapshots: DataFrame,
    metrics: Sequence[str] = ("poi", "trust", "approval"),
    lead: str = "poi",
    min_n: int = C.MIN_EFFECTIVE_N,
    confidence: float = 0.95,
) -> DataFrame:
    """Latest value of each metric per province, ranked, with margin and gate."""
    rows = snapshots.filter(F.col("province_code").isNotNull() & F.col("metric").isin(list(metrics)))
    latest = latest_snapshots(rows, ["project_id", "province_code", "metric"])
    wide = latest.groupBy("project_id", "province_code").pivot("metric", list(metrics)).agg(
        F.max("value").alias("value"), F.max("effective_n").alias("n")
    )
    n = F.col(f"{lead}_n")
    enough = F.coalesce(n >= min_n, F.lit(False))
    out = wide.select(
        "project_id",
        "province_code",
        *[F.when(F.coalesce(F.col(f"{m}_n") >= min_n, F.lit(False)), half_even(F.col(f"{m}_value"), 2)).alias(m) for m in metrics],
        n.alias("effective_n"),
        F.when(enough, half_even(F.lit(index_z(confidence) * 50.0) / F.sqrt(n), 2)).alias("margin"),
        (~enough).alias("insufficient_data"),
        F.when(~enough, "NONE").when(n > 400, "HIGH").otherwise("MEDIUM").alias("confidence_label"),
    )
    # provinces of one project: a bounded list
    w = W.partitionBy("project_id").orderBy(F.col(lead).desc_nulls_last(), F.col("province_code"))
    return out.withColumn("rank", F.row_number().over(w))


def largest_drops(
    values: DataFrame, keys: Sequence[str], item: str, delta: str, top: int = 3
) -> DataFrame:
    """Items with the largest fall per key (ties by item name)."""
    fallen = values.filter(F.col(delta) < 0)
    return top_n_per_key(fallen, keys, [F.col(delta).asc(), F.col(item).asc()], top, "rank", spread_by=[item])


def period_deltas(
    snapshots: DataFrame, keys: Sequence[str], value: str = "value", period: str = "period_end"
) -> DataFrame:
    """Difference to the previous period of the same key (keys name one series each)."""
    w = W.partitionBy(*keys).orderBy(period)
    return snapshots.withColumn("delta", F.col(value) - F.lag(value).over(w))


def alerts(
    facts: DataFrame,
    keys: Sequence[str] = ("project_id",),
    momentum_pp: float = 10.0,
    flat_pp: float = 1.0,
    low_quality: int = 100,
    coverage: float = 0.8,
) -> DataFrame:
    """Rule alerts on a row of facts per key, one row per alert.

    Reads narrative_momentum, trust_delta, approval_delta, low_quality_count and
    sample_coverage (a missing fact never alerts).
    """
    rules: Mapping[str, tuple] = {
        "NARRATIVE_MOMENTUM": ("high", F.col("narrative_momentum") >= momentum_pp),
        "TRUST_DOWN_APPROVAL_FLAT": (
            "med", (F.col("trust_delta") < -flat_pp) & (F.abs("approval_delta") <= flat_pp)
        ),
        "LOW_QUALITY_RESPONSES": ("med", F.col("low_quality_count") >= low_quality),
        "SAMPLE_BELOW_TARGET": ("low", F.col("sample_coverage") < coverage),
    }
    fired = F.array_compact(
        F.array(*[
            F.when(cond, F.struct(F.lit(name).alias("alert"), F.lit(level).alias("severity")))
            for name, (level, cond) in rules.items()
        ])
    )
    return facts.select(*keys, F.inline(fired))


