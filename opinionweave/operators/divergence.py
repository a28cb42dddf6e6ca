"""Comparison of survey, social and media readings of the same question."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import constants as C
from ..functions.scalars import codes, half_even, lookup
from ..sources.tables import national
from .index import latest_snapshots

FIXED_LIMITATIONS = ("QUALITATIVE_CONTRIBUTIONS", "SOCIAL_NOT_WEIGHTABLE")


def signal_readings(snapshots: DataFrame) -> DataFrame:
    """Latest national reading of each source's own metric."""
    if {"province_code", "segment"} <= set(snapshots.columns):
        snapshots = national(snapshots)
    metric_of = lookup({s: m for s, m, _, _ in C.SOURCE_META}, F.col("source"))
    rows = snapshots.filter(F.col("metric") == metric_of)
    latest = latest_snapshots(rows, ["project_id", "metric", "source"], tie=())
    return latest.select(
        "project_id",
        "source",
        F.col("value").cast("double").alias("value"),
        F.coalesce("effective_n", F.lit(0)).alias("n"),
        lookup({s: b for s, _, b, _ in C.SOURCE_META}, F.col("source")).alias("known_bias"),
    )


def signal_divergence(
    readings: DataFrame,
    keys: Sequence[str] = ("project_id",),
    strict_presence: bool = False,
) -> DataFrame:
    """Gap between the highest and lowest reading with candidate explanations.

    Missing survey or social readings count as 0 and missing media as their mean;
    ``strict_presence`` judges a rule only when its readings exist.
    """
    order = lookup({s: i for s, _, _, i in C.SOURCE_META}, F.col("source"))
    rows = readings.withColumn("_o", order)
    at = lambda s: F.max(F.when(F.col("source") == s, F.col("value")))
    g = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_readings"),
        F.min_by("source", F.struct("value", "_o")).alias("lowest"),
        F.max_by("source", F.struct(F.col("value"), -F.col("_o"))).alias("highest"),
        F.min("value").alias("_lo"),
        F.max("value").alias("_hi"),
        at("SURVEY").alias("_s"),
        at("SOCIAL").alias("_so"),
        at("MEDIA").alias("_m"),
        F.min(F.when(F.col("source") == "SURVEY", F.col("n"))).alias("_n"),
        F.array_sort(
            F.collect_list(F.struct("value", "_o", "source", "n", "known_bias"))
        ).alias("_list"),
    )
    s = F.coalesce("_s", F.lit(0.0))
    so = F.coalesce("_so", F.lit(0.0))
    m = F.coalesce(F.col("_m"), (s + so) / 2)
    both = F.col("_s").isNotNull() & F.col("_so").isNotNull() if strict_presence else F.lit(True)
    media = both & F.col("_m").isNotNull() if strict_presence else F.lit(True)
    enough = F.col("n_readings") >= 2
    gap = half_even(F.col("_hi") - F.col("_lo"), 1)
    return g.select(
        *keys,
        "n_readings",
        F.when(enough, gap).alias("gap"),
        F.when(enough, F.col("lowest")).alias("lowest"),
        F.when(enough, F.col("highest")).alias("highest"),
        F.when(enough, gap >= C.NOTABLE_GAP).alias("is_notable"),
        F.when(
            enough,
            codes(
                ("SELF_SELECTION", both & (so < s - 10)),
                ("DEMOGRAPHIC", both & (F.abs(s - so) > 10)),
                ("TIMING", F.lit(True)),
                ("MEDIA_FRAMING", media & (F.least(s, so) < m) & (m < F.greatest(s, so))),
            ),
        ).alias("explanations"),
        F.when(
            enough,
            codes(
                *[(x, F.lit(True)) for x in FIXED_LIMITATIONS],
                ("SMALL_SURVEY", F.col("_n") < C.SMALL_SURVEY_N),
            ),
        ).alias("limitations"),
        F.transform(
            "_list", lambda r: F.struct(r["source"].alias("source"), r["value"].alias("value"), r["n"].alias("n"), r["known_bias"].alias("known_bias"))
        ).alias("readings"),
        codes(("TOO_FEW_READINGS", ~enough)).alias("violations"),
    )
