"""Composite opinion index, its change, weight previews and weight updates."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import constants as C
from ..functions.scalars import (
    clamp, codes, half_even, index_z, literal_map, map_total, natural_id,
)
from ..plans.ranking import latest_per_key
from ..sources.tables import national

METHOD = "WEIGHTED_MEAN_OF_DIMENSIONS"


def latest_snapshots(
    snapshots: DataFrame, keys: Sequence[str] = ("project_id", "metric"), tie: Sequence[str] = ("source",)
) -> DataFrame:
    """Newest snapshot per key; ``tie`` columns (ascending) settle equal periods."""
    order = [F.col("period_end").desc()]
    for name in ("created_at", "id"):
        if name in snapshots.columns:
            order.append(F.col(name).desc())
    order += [F.col(t).asc() for t in tie if t in snapshots.columns]
    return latest_per_key(snapshots, keys, order)


def latest_index(snapshots: DataFrame) -> DataFrame:
    """Newest national index per project."""
    rows = snapshots.filter(F.col("metric") == "poi")
    if {"province_code", "segment"} <= set(snapshots.columns):
        rows = national(rows)
    return latest_snapshots(rows, ["project_id"])


def index_dimensions(
    snapshots: DataFrame,
    projects: DataFrame | None = None,
    weights: Mapping[str, float] = C.DEFAULT_INDEX_WEIGHTS,
) -> DataFrame:
    """Latest national snapshot of each weighted dimension, joined with its weight.

    ``projects`` (project_id, poi_weights map) gives the weights per project;
    without it the same weights apply to all. Dimensions with weight <= 0 and
    metrics outside the six known ones are left out.
    """
    if {"province_code", "segment"} <= set(snapshots.columns):
        snapshots = national(snapshots)
    known = snapshots.filter(F.col("metric").isin(list(C.DEFAULT_INDEX_WEIGHTS)))
    latest = latest_snapshots(known)
    if projects is None:
        weighted = latest.withColumn("weight", F.try_element_at(literal_map(dict(weights)), F.col("metric")))
    else:
        per_dim = projects.select("project_id", F.explode("poi_weights").alias("metric", "weight"))
        weighted = latest.join(per_dim, ["project_id", "metric"])
    return weighted.filter(F.col("weight") > 0).select(
        "project_id",
        F.col("metric").alias("key"),
        F.col("value").cast("double").alias("score"),
        F.col("weight").cast("double").alias("weight"),
        "source",
        "effective_n",
    )


def effective_sample_size(weights: DataFrame, keys: Sequence[str], weight: str = "weight") -> DataFrame:
    """Kish effective n per key; 0 when all weights are zero."""
    w = F.col(weight).cast("double")
    return weights.groupBy(*keys).agg(
        F.sum(w).alias("_s1"), F.sum(w * w).alias("_s2"), F.count(F.lit(1)).alias("n")
    ).select(
        *keys, "n",
        F.when(F.col("_s2") > 0, F.col("_s1") * F.col("_s1") / F.col("_s2")).otherwise(0.0).alias("kish_n"),
    )


def opinion_index(
    dims: DataFrame,
    keys: Sequence[str] = ("project_id",),
    confidence: float = 0.95,
    respondent_weights: DataFrame | None = None,
    min_n: int = C.MIN_EFFECTIVE_N,
    strict: bool = False,
) -> DataFrame:
    """Weighted index with interval, source mix and limitations, one row per key.

    ``dims``: keys, key, score, weight, source, effective_n. ``respondent_weights``
    (keys, weight) switches effective n to Kish. The interval covers only the
    probabilistic share. Invalid input gives NULL value and ``violations``
    (an error with ``strict``).
    """
    survey = F.col("source") == C.PROBABILITY_SOURCE
    w = F.col("weight")
    per_source = [F.sum(F.when(F.col("source") == s, w)).alias(f"_w_{s}") for s in C.SOURCES]
    agg = dims.groupBy(*keys).agg(
        F.sum(F.col("score") * w).alias("_sw"),
        F.sum(w).alias("_w"),
        F.count_if(survey).alias("_survey_dims"),
        F.min(F.when(survey & (F.col("effective_n") != 0), F.col("effective_n"))).alias("_n_min"),
        F.count_if(~F.coalesce(F.col("score").between(0, 100), F.lit(False))).alias("_bad_score"),
        F.count_if(F.coalesce(w < 0, F.lit(True))).alias("_bad_weight"),
        F.count_if(~F.coalesce(F.col("source").isin(*C.SOURCES), F.lit(False))).alias("_bad_source"),
        *per_source,
    )
    if respondent_weights is not None:
        kish = effective_sample_size(respondent_weights, keys).select(
            *keys, F.floor("kish_n").cast("int").alias("_kish")
        )
        agg = agg.join(kish, list(keys), "left")
    else:
        agg = agg.withColumn("_kish", F.lit(None).cast("int"))

    n_eff = F.when(F.col("_survey_dims") > 0, F.coalesce("_kish", "_n_min")).cast("int")
    share = lambda s: F.col(f"_w_{s}") / F.col("_w")
    survey_share = F.coalesce(share(C.PROBABILITY_SOURCE), F.lit(0.0))
    mix = F.map_from_entries(
        F.array_compact(
            F.array(*[
                F.when(F.col(f"_w_{s}").isNotNull(), F.struct(F.lit(s), half_even(share(s), 4)))
                for s in C.SOURCES
            ])
        )
    )
    others = codes(*[(s, F.col(f"_w_{s}").isNotNull()) for s in sorted(C.SOURCES) if s != C.PROBABILITY_SOURCE])
    violations = codes(
        ("NO_WEIGHT", F.coalesce(F.col("_w"), F.lit(0.0)) <= 0),
        ("SCORE_RANGE", F.col("_bad_score") > 0),
        ("NEGATIVE_WEIGHT", F.col("_bad_weight") > 0),
        ("UNKNOWN_SOURCE", F.col("_bad_source") > 0),
    )
    out = agg.withColumn("violations", violations)
    ok = F.size("violations") == 0
    if strict:
        ok = F.when(ok, F.lit(True)).otherwise(
            F.raise_error(F.array_join("violations", ",")).cast("boolean")
        )
    out = (
        out.withColumn("_ok", ok)
        .withColumn("_value", F.when(F.col("_ok"), F.try_divide("_sw", "_w")))
        .withColumn("_share", F.when(F.col("_ok"), survey_share))
        .withColumn("effective_n", F.when(F.col("_ok"), n_eff))
        .withColumn(
            "_margin",
            F.when(
                F.col("effective_n") > 0,
                F.lit(index_z(confidence) * 50.0) / F.sqrt("effective_n") * F.col("_share"),
            ),
        )
        .withColumn("ci_low", half_even(clamp(F.col("_value") - F.col("_margin"), 0.0, 100.0), 2))
        .withColumn("ci_high", half_even(clamp(F.col("_value") + F.col("_margin"), 0.0, 100.0), 2))
    )
    partial = F.col("_share") < 1 - 1e-12
    return out.select(
        *keys,
        half_even(F.col("_value"), 2).alias("value"),
        "ci_low",
        "ci_high",
        "effective_n",
        F.lit(METHOD).alias("method"),
        F.when(F.col("_ok"), mix).alias("source_mix"),
        half_even(F.col("_share"), 3).alias("generalisable_share"),
        codes(
            ("NON_PROBABILITY_SHARE", partial),
            ("BELOW_MIN_N", F.col("effective_n") < min_n),
            ("NO_CI", F.col("ci_low").isNull()),
        ).alias("limitations"),
        F.when(partial, half_even((1 - F.col("_share")) * 100, 0).cast("int")).alias("non_probability_pct"),
        F.when(partial, others).alias("non_probability_sources"),
        "violations",
    )


def publication_gate(
    df: DataFrame,
    value: str = "value",
    n: str = "effective_n",
    interval: Sequence[str] = ("ci_low", "ci_high"),
    min_n: int = C.MIN_EFFECTIVE_N,
) -> DataFrame:
    """Withhold the number and its interval when effective n is missing or too small."""
    enough = F.coalesce(F.col(n) >= min_n, F.lit(False))
    hide = [value, *[c for c in interval if c in df.columns]]
    out = df.withColumn("insufficient_data", ~enough)
    for name in hide:
        out = out.withColumn(name, F.when(enough, F.col(name)))
    return out


def index_change(series: DataFrame, keys: Sequence[str] = ("project_id",), period: str = "period_end") -> DataFrame:
    """Change against the previous period of the same key."""
    w = W.partitionBy(*keys).orderBy(period)
    prev = F.lag(F.struct("value", "ci_low", "ci_high")).over(w)
    out = series.withColumn("_p", prev)
    delta = half_even(F.col("value") - F.col("_p.value"), 2)
    apart = (F.col("ci_low") > F.col("_p.ci_high")) | (F.col("ci_high") < F.col("_p.ci_low"))
    bounds = (
        F.col("ci_low").isNotNull() & F.col("ci_high").isNotNull()
        & F.col("_p.ci_low").isNotNull() & F.col("_p.ci_high").isNotNull()
    )
    return (
        out.filter(F.col("_p.value").isNotNull() & F.col("value").isNotNull())
        .withColumn("previous_value", F.col("_p.value"))
        .withColumn("delta", delta)
        .withColumn(
            "direction",
            F.when(F.col("delta") > 0, "UP").when(F.col("delta") < 0, "DOWN").otherwise("EQUAL"),
        )
        .withColumn("intervals_separated", bounds & F.coalesce(apart, F.lit(False)))
        .drop("_p")
    )


def weighted_index_preview(
    dims: DataFrame,
    candidates: Mapping[str, Mapping[str, float]],
    keys: Sequence[str] = ("project_id",),
) -> DataFrame:
    """Index value under many candidate weight vectors; zero total weight divides by one."""
    grid = F.array(*[
        F.struct(F.lit(name).alias("candidate"), literal_map(dict(weights)).alias("weights"))
        for name, weights in candidates.items()
    ])
    rows = dims.select(*keys, "key", "score", F.explode(grid).alias("g"))
    w = F.coalesce(F.try_element_at(F.col("g.weights"), F.col("key")), F.lit(0.0))
    total = F.sum("_w")
    return (
        rows.select(*keys, F.col("g.candidate").alias("candidate"), "score", w.alias("_w"))
        .groupBy(*keys, "candidate")
        .agg(
            half_even(
                F.sum(F.col("score") * F.col("_w")) / F.when(total == 0, 1.0).otherwise(total), 2
            ).alias("value")
        )
    )


def set_index_weights(
    projects: DataFrame, updates: DataFrame, actor: str, at: Column
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(projects with new weights, audit rows, rejected updates).

    ``updates``: project_id, new_weights. Missing weights, a total <= 0, an unknown
    project and several updates of one project are rejected. The audit keeps old
    and new weights.
    """
    weights = F.col("new_weights")
    total = map_total(weights)
    missing = weights.isNull() | F.exists(F.map_values(weights), lambda x: x.isNull())
    times = updates.groupBy("project_id").agg(F.count(F.lit(1)).alias("_times"))
    seen = updates.join(times, "project_id", "left").join(
        projects.select("project_id", "org_id", F.col("poi_weights").alias("old_weights")),
        "project_id", "left",
    ).withColumn(
        "violations", codes(
            ("MISSING_WEIGHTS", missing), ("TOTAL_NOT_POSITIVE", total <= 0), ("UNKNOWN_PROJECT", F.col("org_id").isNull()),
            ("REPEATED_PROJECT", F.coalesce(F.col("_times") > 1, F.lit(False))),
        )
    )
    good = seen.filter(F.size("violations") == 0)
    changed = (
        projects.join(good.select("project_id", "new_weights"), "project_id", "left")
        .withColumn("poi_weights", F.coalesce("new_weights", "poi_weights"))
        .drop("new_weights")
    )
    audit = good.select(
        natural_id(F.lit("poi_weights:update"), F.col("project_id"), at).alias("id"),
        "org_id",
        F.lit(actor).alias("actor_id"),
        F.lit("poi_weights:update").alias("action"),
        F.lit("projects").alias("entity"),
        F.col("project_id").cast("string").alias("entity_id"),
        F.to_json(F.struct(F.col("old_weights").alias("old"), F.col("new_weights").alias("new"))).alias("metadata"),
        at.alias("at"),
    )
    return changed, audit, seen.filter(F.size("violations") > 0).select("project_id", "new_weights", "violations")
