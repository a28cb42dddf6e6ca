"""Scenario forecasts: many projects and scenarios at once."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import constants as C
from ..functions.scalars import codes, half_even, lookup

Driver = tuple[str, float, str, float]


def split_scenarios(
    scenarios: DataFrame, drivers: Sequence[Driver] = C.DRIVERS
) -> tuple[DataFrame, DataFrame]:
    """(non-zero inputs with their driver values, inputs that name an unknown driver)."""
    used = scenarios.filter(F.col("input") != 0)
    known = F.col("driver").isin([d[0] for d in drivers])
    good = used.filter(known).select(
        "*",
        lookup({d[0]: d[1] for d in drivers}, F.col("driver")).alias("coefficient"),
        lookup({d[0]: d[2] for d in drivers}, F.col("driver")).alias("unit"),
        lookup({d[0]: d[3] for d in drivers}, F.col("driver")).alias("uncertainty_per_unit"),
    )
    unknown = used.filter(~F.coalesce(known, F.lit(False))).withColumn("violation", F.lit("UNKNOWN_DRIVER"))
    return good, unknown


def driver_contributions(scenarios: DataFrame, drivers: Sequence[Driver] = C.DRIVERS) -> DataFrame:
    """Effect of each non-zero input at the full horizon."""
    good, _ = split_scenarios(scenarios, drivers)
    return good.withColumn(
        "effect_at_max_horizon", half_even(F.col("coefficient") * F.col("input"), 2)
    ).drop("coefficient", "uncertainty_per_unit")


def scenario_forecast(
    baselines: DataFrame,
    scenarios: DataFrame,
    keys: Sequence[str] = ("project_id",),
    spread: Mapping[int, float] = C.SPREAD,
    drivers: Sequence[Driver] = C.DRIVERS,
    pi_level: float = 0.80,
) -> DataFrame:
    """Expected value and interval per key, scenario and horizon.

    ``baselines``: keys, baseline. ``scenarios``: keys, scenario, driver, input; a
    scenario whose inputs are all zero (or NULL driver) is a plain projection. The
    interval widens with every input and never narrows. A scenario with an unknown
    driver gives NULL numbers and a violation.
    """
    known = F.col("driver").isin([d[0] for d in drivers])
    active = F.coalesce(F.col("input"), F.lit(0.0)) != 0
    coefficient = lookup({d[0]: d[1] for d in drivers}, F.col("driver"))
    uncertainty = lookup({d[0]: d[3] for d in drivers}, F.col("driver"))
    effects = scenarios.groupBy(*keys, "scenario").agg(
        F.coalesce(F.sum(F.when(active & known, coefficient * F.col("input"))), F.lit(0.0)).alias("_effect"),
        F.coalesce(F.sum(F.when(active & known, uncertainty * F.abs("input"))), F.lit(0.0)).alias("_extra"),
        F.coalesce(F.bool_or(active), F.lit(False)).alias("is_simulation"),
        F.count_if(active & ~F.coalesce(known, F.lit(False))).alias("_unknown"),
    )
    last = max(spread)
    horizons = F.array(*[
        F.struct(F.lit(h).alias("horizon_days"), F.lit(float(spread[h])).alias("s"), F.lit(min(1.0, h / last)).alias("r"))
        for h in sorted(spread)
    ])
    rows = (
        baselines.join(effects, list(keys))
        .select(*keys, "baseline", "scenario", "_effect", "_extra", "is_simulation", "_unknown", F.inline(horizons))
        .withColumn("_ok", (F.col("_unknown") == 0) & F.col("baseline").between(0, 100))
        .withColumn("_e", F.when(F.col("_ok"), F.col("baseline") + F.col("_effect") * F.col("r")))
        .withColumn("_w", F.col("s") + F.col("_extra") * F.col("r"))
    )
    # only the outer bound is clamped on each side, so an inverted interval stays visible
    low = F.when(F.col("_e").isNotNull(), F.greatest(F.lit(0.0), F.col("_e") - F.col("_w")))
    high = F.when(F.col("_e").isNotNull(), F.least(F.lit(100.0), F.col("_e") + F.col("_w")))
    return rows.select(
        *keys,
        "scenario",
        "horizon_days",
        half_even(F.col("_e"), 1).alias("expected"),
        half_even(low, 1).alias("pi_low"),
        half_even(high, 1).alias("pi_high"),
        F.lit(pi_level).alias("pi_level"),
        "is_simulation",
        codes(
            ("SIMULATION_NOT_PREDICTION", F.col("is_simulation")),
            ("NOT_VALID_UNDER_SHOCKS", F.lit(True)),
            ("UNSEEN_EVENTS_NOT_COVERED", F.lit(True)),
        ).alias("limitations"),
        codes(
            ("UNKNOWN_DRIVER", F.col("_unknown") > 0),
            ("BASELINE_RANGE", ~F.coalesce(F.col("baseline").between(0, 100), F.lit(False))),
            ("INTERVAL_INVERTED", low > high),
        ).alias("violations"),
    )


