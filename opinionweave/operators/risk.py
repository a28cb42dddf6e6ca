"""Risk score with bands and contributors, and polarization of segments."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import constants as C
from ..functions.scalars import codes, half_even, lookup


def risk_band(score: Column) -> Column:
    """Band of a score; it is rounded first, values over 100 are Critical."""
    s = half_even(score, 0)
    out = None
    for upper, name in C.RISK_BANDS[:-1]:
        out = F.when(s <= upper, name) if out is None else out.when(s <= upper, name)
    return F.when(score.isNotNull(), out.otherwise(C.RISK_BANDS[-1][1]))


def risk_score(
    components: DataFrame,
    keys: Sequence[str] = ("project_id",),
    weights: Mapping[str, float] = C.RISK_WEIGHTS,
    top: int = 3,
) -> DataFrame:
    """Weighted risk per key with its band and largest contributors.

    ``components``: keys, component, value (0..100). Components without a weight
    are ignored; a missing weighted component withholds the score. Ties keep the
    order of ``weights``. The largest of repeated components counts, and both repeats
    and values outside 0..100 are reported. At most ``len(weights)`` rows per key are gathered.
    """
    total = sum(weights.values())
    names = list(weights)
    w = lookup(dict(weights), F.col("component"))
    rank = lookup({n: i for i, n in enumerate(names)}, F.col("component"))
    rows = components.withColumn("_w", w).withColumn("_o", rank).withColumn("_c", F.col("value") * F.col("_w") / total)
    # one value per component, so a group never holds more than the weight table
    one = rows.filter(F.col("_w").isNotNull() & F.col("value").isNotNull()).groupBy(*keys, "component").agg(
        F.max("_c").alias("_c"), F.max("_o").alias("_o")
    )
    present = one.groupBy(*keys).agg(
        F.sum("_c").alias("_sum"),
        F.sort_array(
            F.collect_list(F.struct(F.col("_c"), (-F.col("_o")).alias("_no"), F.col("component"))), asc=False
        ).alias("_all"),
        F.collect_set("component").alias("_have"),
    )
    weighted = rows.filter(F.col("_w").isNotNull()).groupBy(*keys, "component").agg(
        F.count(F.lit(1)).alias("_n"), F.bool_or(~F.coalesce(F.col("value").between(0, 100), F.lit(True))).alias("_bad")
    )
    faults = weighted.groupBy(*keys).agg(F.bool_or(F.col("_n") > 1).alias("_repeated"), F.bool_or("_bad").alias("_outside"))
    everyone = components.select(*keys).distinct().join(faults, list(keys), "left")
    out = everyone.join(present, list(keys), "left").withColumn(
        "missing",
        F.array_except(
            F.array(*[F.lit(n) for n in names]), F.coalesce("_have", F.array().cast("array<string>"))
        ),
    )
    ok = F.size("missing") == 0
    score = F.when(ok, half_even(F.col("_sum"), 0).cast("int"))
    return out.select(
        *keys,
        score.alias("score"),
        risk_band(score).alias("band"),
        F.when(
            ok,
            F.transform(
                F.slice("_all", 1, top),
                lambda x: F.struct(x["component"].alias("component"), half_even(x["_c"], 2).alias("contribution")),
            ),
        ).alias("top_contributors"),
        codes(
            ("MISSING_COMPONENTS", ~ok), ("REPEATED_COMPONENT", F.coalesce(F.col("_repeated"), F.lit(False))),
            ("VALUE_OUT_OF_RANGE", F.coalesce(F.col("_outside"), F.lit(False))),
        ).alias("violations"),
        "missing",
    )


def polarization(
    segments: DataFrame, keys: Sequence[str] = ("project_id",), position: str = "sentiment", size: str = "size_pct"
) -> DataFrame:
    """Size-weighted spread and bimodality of segment positions (-100..100)."""
    p, s = F.col(position).cast("double"), F.col(size).cast("double")
    means = segments.groupBy(*keys).agg(F.sum(s).alias("_t"), F.sum(p * s).alias("_ps"), F.count(F.lit(1)).alias("n_segments"))
    means = means.withColumn("_mean", F.try_divide("_ps", "_t"))
    g = (
        segments.join(means, list(keys))
        .groupBy(*keys)
        .agg(
            F.first("n_segments").alias("n_segments"),
            F.first("_t").alias("_t"),
            F.sum(s * (p - F.col("_mean")) * (p - F.col("_mean"))).alias("_ss"),
            F.sum(F.when(F.abs(p) > 40, s).otherwise(0.0)).alias("_poles"),
            F.sum(F.when(F.abs(p) <= 20, s).otherwise(0.0)).alias("_middle"),
        )
    )
    ok = (F.col("n_segments") >= 2) & (F.col("_t") > 0)
    per = lambda c: F.when(ok, F.col(c) / F.col("_t"))
    sd, pole, middle = F.sqrt(per("_ss")), per("_poles"), per("_middle")
    return g.select(
        *keys,
        half_even(F.when(ok, F.least(F.lit(100.0), sd * 0.6 + pole * 60)), 0).cast("int").alias("polarization_score"),
        F.when(ok, F.when((pole > 0.45) & (middle < 0.25), "polarised").when(middle > 0.5, "consensus").otherwise("fragmented")).alias("state"),
        half_even(pole, 3).alias("pole_mass"),
        half_even(middle, 3).alias("middle_mass"),
        half_even(sd, 2).alias("spread"),
        F.lit("SIZE_WEIGHTED_BIMODALITY").alias("method"),
        codes(
            ("TOO_FEW_SEGMENTS", F.col("n_segments") < 2), ("NO_SIZE", ~F.coalesce(F.col("_t") > 0, F.lit(False)))
        ).alias("violations"),
    )
