"""Sample sizing, margins and stratum balance."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import constants as C
from ..functions.scalars import codes, half_even, index_z, lookup


def sample_size_plan(designs: DataFrame) -> DataFrame:
    """Recommended n per design row.

    Reads population, confidence, margin_of_error, expected_proportion, method,
    design_effect, expected_response_rate (missing columns take the defaults).
    Invalid designs keep NULL sizes and list their ``violations``.
    """
    defaults = {
        "population": F.lit(None).cast("long"),
        "confidence": F.lit(0.95),
        "margin_of_error": F.lit(0.03),
        "expected_proportion": F.lit(0.5),
        "method": F.lit("MULTISTAGE"),
        "design_effect": F.lit(None).cast("double"),
        "expected_response_rate": F.lit(1.0),
    }
    d = designs
    for name, value in defaults.items():
        d = d.withColumn(name, value) if name not in d.columns else d
    e, p, rr = F.col("margin_of_error"), F.col("expected_proportion"), F.col("expected_response_rate")
    d = d.withColumn("z", lookup(C.Z_SAMPLING, F.col("confidence").cast("double")))
    d = d.withColumn(
        "violations",
        codes(
            ("MARGIN_RANGE", ~((e > 0) & (e < 1))),
            ("PROPORTION_RANGE", ~p.between(0, 1)),
            ("RESPONSE_RATE_RANGE", ~((rr > 0) & (rr <= 1))),
            ("UNKNOWN_CONFIDENCE", F.col("z").isNull()),
            ("UNKNOWN_METHOD", ~F.col("method").isin(*C.DESIGN_EFFECT)),
        ),
    )
    ok = F.size("violations") == 0
    has_pop = F.coalesce(F.col("population") > 0, F.lit(False))
    n0 = F.when(ok, F.col("z") * F.col("z") * p * (1 - p) / (e * e))
    d = d.withColumn("_n0", n0).withColumn(
        "_n0", F.when(has_pop, F.col("_n0") / (1 + (F.col("_n0") - 1) / F.col("population"))).otherwise(F.col("_n0"))
    )
    d = d.withColumn("base_n", F.ceil("_n0").cast("long")).withColumn(
        "design_effect", F.coalesce("design_effect", lookup(C.DESIGN_EFFECT, F.col("method")))
    )
    # ceil on a value free of the last binary digits' noise would differ from the formula; keep it plain
    d = d.withColumn("recommended_n", F.ceil(F.col("base_n") * F.col("design_effect") / rr).cast("long"))
    warnings = codes(
        ("NON_PROBABILITY", F.col("method").isin(*C.NON_PROBABILITY_METHODS)),
        ("CONSERVATIVE_PROPORTION", p == 0.5),
        ("OVER_TENTH_OF_POPULATION", has_pop & (F.col("recommended_n") > F.col("population") * 0.1)),
        ("LOW_RESPONSE_RATE", rr < 0.5),
    )
    return (
        d.withColumn("finite_population_correction", ok & has_pop)
        .withColumn("warnings", F.when(ok, warnings))
        .drop("_n0")
    )


def margin_of_error(
    achieved: DataFrame, n: str = "n", confidence: float = 0.95, p: float = 0.5, deff: float = 1.0
) -> DataFrame:
    """Margin reached with n respondents; n <= 0 gives NULL and a violation."""
    z = index_z(confidence)
    return achieved.withColumn(
        "margin", F.when(F.col(n) > 0, z * F.sqrt(F.lit(deff * p * (1 - p)) / F.col(n)))
    ).withColumn("violations", codes(("N_NOT_POSITIVE", ~F.coalesce(F.col(n) > 0, F.lit(False)))))


def stratum_balance(
    respondents: DataFrame,
    census: DataFrame | Mapping[str, float],
    stratum: str,
    keys: Sequence[str] = ("survey_id",),
    target_n: int | str | None = None,
    tolerance_pp: float = 3.0,
) -> tuple[DataFrame, DataFrame]:
    """(stratum rows, report row per key): sample composition against the census.

    ``census``: stratum, census_share and at least one of the keys, or a mapping
    of shares that holds for all keys. Respondents outside the census count only
    in the total. ``target_n`` is a number or a column of the respondents.
    """
    keys = list(keys)
    if isinstance(target_n, str):
        target = F.max(target_n).cast("long")
    else:
        target = F.max(F.lit(target_n)).cast("long")
    counts = respondents.groupBy(*keys, stratum).agg(F.count(F.lit(1)).alias("achieved"), target.alias("_t"))
    totals = counts.groupBy(*keys).agg(F.sum("achieved").alias("achieved_n"), F.max("_t").alias("target_n"))
    if isinstance(census, Mapping):
        # shares that hold for all keys: a fixed table of strata
        strata = F.array(*[
            F.struct(F.lit(name).alias(stratum), F.lit(float(share)).alias("census_share"))
            for name, share in census.items()
        ])
        frame = totals.select("*", F.inline(strata))
    else:
        shared = [k for k in keys if k in census.columns]
        if not shared:
            raise ValueError("census needs at least one of the keys; pass a mapping for common shares")
        frame = totals.join(census.select(*shared, stratum, "census_share"), shared)
    rows = frame.join(counts.drop("_t"), [*keys, stratum], "left").withColumn(
        "achieved", F.coalesce("achieved", F.lit(0)).cast("long")
    )
    share = F.when(F.col("achieved_n") > 0, F.col("achieved") / F.col("achieved_n")).otherwise(0.0)
    rows = rows.withColumn("_got", share).withColumn("_dev", (F.col("_got") - F.col("census_share")) * 100)
    strata_out = rows.select(
        *keys,
        stratum,
        "achieved",
        half_even(F.col("_got"), 4).alias("achieved_share"),
        half_even(F.col("census_share"), 4).alias("census_share"),
        half_even(F.col("_dev"), 2).alias("deviation_pp"),
        half_even(F.when(F.col("_got") > 0, F.col("census_share") / F.col("_got")), 4).alias("weight"),
        (F.abs("_dev") > tolerance_pp).alias("flag"),
    )
    top = F.max(F.abs("_dev"))
    empty = F.array_sort(F.collect_set(F.when(F.col("achieved") == 0, F.col(stratum))))
    report = (
        rows.groupBy(*keys)
        .agg(
            F.first("achieved_n").alias("achieved_n"),
            F.first("target_n").alias("target_n"),
            top.alias("_max"),
            empty.alias("empty_strata"),
        )
        .select(
            *keys,
            "achieved_n",
            "target_n",
            F.when(F.col("target_n") > 0, half_even(F.col("achieved_n") / F.col("target_n"), 4))
            .otherwise(0.0).alias("response_rate"),
            half_even(F.col("_max"), 2).alias("max_deviation_pp"),
            "empty_strata",
            codes(
                ("EMPTY_STRATA", F.size("empty_strata") > 0),
                ("DEVIATION_OVER_TOLERANCE", F.col("_max") > tolerance_pp),
                ("BELOW_TARGET", F.col("achieved_n") < F.col("target_n") * 0.8),
            ).alias("warnings"),
        )
    )
    return strata_out, report


def strata_in_order(strata: DataFrame, stratum: str, keys: Sequence[str] = ("survey_id",)) -> DataFrame:
    """Stratum rows with their place in the report, by name (UTF-8 byte order, a missing name first).

    Strata come from the census, one row each, so a key has as many rows as there are categories.
    """
    w = W.partitionBy(*keys).orderBy(F.col(stratum).asc_nulls_first())
    return strata.withColumn("position", F.row_number().over(w)).orderBy(*keys, "position")
