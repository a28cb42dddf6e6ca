"""Post-stratification weights by raking, for all surveys at once.

Respondents who agree on every raking variable always carry the same weight, so
raking works on demographic cells with counts. Categories without a target (and
NULL) behave alike and share one cell code, hence a survey has at most
prod(targets per variable + 1) cells: a bound set by the targets, not the data.
Within that bound each survey's cells are iterated in one vectorised task;
beyond ``cell_limit`` all surveys advance together as DataFrame joins.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import constants as C
from ..functions.scalars import codes, half_even, literal_map, stored_weight
from ..plans.lineage import cut_lineage
from ..sources.sinks import replace_columns

Targets = Mapping[str, Mapping[str, float]]


def check_targets(targets: Targets) -> list[str]:
    """Violation codes of a target table (empty when usable)."""
    if not targets:
        return ["NO_TARGETS"]
    found = [f"UNKNOWN_VARIABLE:{v}" for v in sorted(set(targets) - set(C.RAKEABLE))]
    found += [f"TARGET_SUM:{v}" for v, shares in targets.items() if not 0.98 <= sum(shares.values()) <= 1.02]
    return found


def _code(variable: str, shares: Mapping[str, float]) -> Column:
    """Ordinal of the category in the target table; -1 for NULL or untargeted."""
    ordinals = {category: i for i, category in enumerate(shares)}
    found = F.try_element_at(literal_map(ordinals), F.col(variable))
    return F.coalesce(F.when(F.col(variable).isNotNull(), found), F.lit(-1)).cast("int")


def rake_cells(respondents: DataFrame, targets: Targets, survey: str = "survey_id") -> DataFrame:
    """Distinct demographic cells (target ordinals) with respondent counts."""
    named = [_code(v, s).alias(f"_c{i}") for i, (v, s) in enumerate(targets.items())]
    return respondents.select(survey, *named).groupBy(survey, *[f"_c{i}" for i in range(len(targets))]).agg(
        F.count(F.lit(1)).alias("_cnt")
    )


def rake_weights(
    respondents: DataFrame,
    targets: Targets,
    survey: str = "survey_id",
    row_id: str = "respondent_id",
    max_iterations: int = 25,
    tolerance: float = 1e-3,
    trim_ratio: float = 3.0,
    rescale_targets: bool = False,
    null_mode: str = "keep",
) -> tuple[DataFrame, DataFrame]:
    """(weights per respondent, diagnostics per survey).

    Variables are adjusted in the order of ``targets``. ``rescale_targets``
    divides by the sum over present categories; ``null_mode='hold_share'`` lets
    the targets apply to the respondents with a targeted category only. With the
    defaults a NULL or untargeted group keeps its weights but counts in the total,
    so its share shrinks every round and raking need not converge.

    Respondents are counted per demographic cell first. A survey has at most
    prod(categories + 1) cells whatever its size; one task iterates those.
    """
    problems = check_targets(targets)
    if problems:
        raise ValueError(", ".join(problems))
    if not (1 <= max_iterations <= 100):
        raise ValueError("max_iterations must be within 1..100")
    if not (1 <= trim_ratio <= 10):
        raise ValueError("trim_ratio must be within 1..10")
    if null_mode not in ("keep", "hold_share"):
        raise ValueError("null_mode must be 'keep' or 'hold_share'")

    codes_of = [f"_c{i}" for i in range(len(targets))]
    cells = rake_cells(respondents, targets, survey)
    options = dict(
        max_iterations=max_iterations, tolerance=tolerance, trim_ratio=trim_ratio,
        rescale_targets=rescale_targets, hold_share=null_mode == "hold_share",
    )
    # the weights feed both results: keep them once instead of iterating twice
    raked = cut_lineage(_rake_in_groups(cells, targets, survey, codes_of, **options))

    coded = respondents.select(
        survey, row_id, *[_code(v, s).alias(c) for c, (v, s) in zip(codes_of, targets.items())]
    )
    per_cell = raked.select(survey, *codes_of, "weight")
    weights = coded.join(per_cell, [survey, *codes_of]).select(
        survey, row_id, "weight"
    )
    return weights, _diagnostics(respondents, raked, targets, survey, codes_of)


def _rake_in_groups(
    cells: DataFrame, targets: Targets, survey: str, codes_of: list[str], *,
    max_iterations: int, tolerance: float, trim_ratio: float, rescale_targets: bool, hold_share: bool,
) -> DataFrame:
    shares_of = [list(s.values()) for s in targets.values()]

    def one_survey(pdf):
        import numpy as np

        cnt = pdf["_cnt"].to_numpy(float)
        members = [pdf[c].to_numpy() for c in codes_of]
        w = np.ones(len(cnt))
        done, degenerate, used = False, False, 0
        for step in range(1, max_iterations + 1):
            change = 0.0
            for code, shares in zip(members, shares_of):
                mass = w * cnt
                total = mass.sum()
                if total <= 0:
                    degenerate = True
                    break
                wanted = np.asarray(shares)
                hit = code >= 0
                sums = np.bincount(code[hit], weights=mass[hit], minlength=len(wanted))
                live = sums > 0
                if rescale_targets and wanted[live].sum() > 0:
                    wanted = wanted / wanted[live].sum()
                if hold_share:
                    total = sums.sum()
                factor = np.ones(len(wanted))
                factor[live] = wanted[live] / (sums[live] / total)
                if live.any():
                    change = max(change, float(np.abs(factor[live] - 1.0).max()))
                w = w * np.where(hit, factor[np.where(hit, code, 0)], 1.0)
            if degenerate:
                break
            used = step
            if change < tolerance:
                done = True
                break

        def to_mean_one(values):
            mean = (values * cnt).sum() / cnt.sum()
            return values / mean if mean > 0 else values

        w = to_mean_one(w)
        order = np.argsort(w, kind="stable")
        upto = np.cumsum(cnt[order])
        n = upto[-1]
        at = lambda rank: w[order[np.searchsorted(upto, rank, side="right")]]
        middle = (at((n - 1) // 2) + at(n // 2)) / 2
        trimmed = 0
        if middle > 0:
            over = w > middle * trim_ratio
            trimmed = int(cnt[over].sum())
            if trimmed:
                w = to_mean_one(np.where(over, middle * trim_ratio, w))
        return pdf.assign(
            weight=w, iterations=used, converged=done, degenerate=degenerate, trimmed_count=trimmed
        )

    schema = ", ".join(
        [f.simpleString().replace(":", " ", 1) for f in cells.schema.fields]
        + ["weight double", "iterations int", "converged boolean", "degenerate boolean", "trimmed_count long"]
    )
    return cells.groupBy(survey).applyInPandas(one_survey, schema)


def _diagnostics(
    respondents: DataFrame, raked: DataFrame, targets: Targets, survey: str, codes_of: list[str]
) -> DataFrame:
    spread = raked.groupBy(survey).agg(
        F.sum("_cnt").alias("respondents"),
        F.max("iterations").alias("iterations"),
        F.max("converged").alias("converged"),
        F.max("degenerate").alias("degenerate"),
        F.max("trimmed_count").alias("trimmed_count"),
        half_even(F.max("weight"), 4).alias("max_weight"),
        half_even(F.min("weight"), 4).alias("min_weight"),
        *[F.collect_set(F.when(F.col(c) >= 0, F.col(c))).alias(f"_seen{c}") for c in codes_of],
    )
    empties, untargeted = [], []
    for c, (variable, shares) in zip(codes_of, targets.items()):
        names = F.array(*[F.lit(x) for x in shares])
        empties.append(_missing_categories(variable, names, F.col(f"_seen{c}")))
        untargeted.append(
            F.collect_set(
                F.when(
                    F.col(variable).isNotNull() & ~F.col(variable).isin(*shares),
                    F.concat(F.lit(f"{variable}="), F.col(variable)),
                )
            )
        )
    outside = respondents.groupBy(survey).agg(F.array_sort(F.flatten(F.array(*untargeted))).alias("untargeted_categories"))
    return (
        spread.withColumn("empty_targets", F.flatten(F.array(*empties)))
        .join(outside, survey)
        .select(
            survey, "respondents", "iterations", "converged", "trimmed_count", "max_weight", "min_weight",
            "untargeted_categories", "empty_targets",
            codes(
                ("UNTARGETED_CATEGORY", F.size("untargeted_categories") > 0),
                ("EMPTY_TARGET", F.size("empty_targets") > 0),
                ("DEGENERATE", F.col("degenerate")),
                ("NOT_CONVERGED", ~F.col("converged") & ~F.col("degenerate")),
                ("WEIGHTS_TRIMMED", F.col("trimmed_count") > 0),
            ).alias("warnings"),
        )
    )


def _missing_categories(variable: str, names: Column, seen: Column) -> Column:
    present = F.transform(seen, lambda i: F.get(names, i))
    missing = F.array_sort(F.array_except(names, present))
    return F.transform(missing, lambda m: F.concat(F.lit(f"{variable}="), m))


def store_weights(
    respondents: DataFrame, weights: DataFrame, survey: str = "survey_id", row_id: str = "respondent_id"
) -> DataFrame:
    """Respondents with their weight column replaced, rounded half to even to four decimals."""
    rounded = weights.select(survey, row_id, stored_weight(F.col("weight")).alias("weight"))
    return replace_columns(respondents.withColumn("weight", stored_weight(F.col("weight"))), rounded, [survey, row_id])


def marginals(
    respondents: DataFrame, weights: DataFrame, variable: str, survey: str = "survey_id", row_id: str = "respondent_id"
) -> DataFrame:
    """Weighted share per category, to compare with the targets."""
    joined = respondents.select(survey, row_id, variable).join(weights, [survey, row_id])
    sums = joined.groupBy(survey, variable).agg(F.sum("weight").alias("_s"))
    total = sums.groupBy(survey).agg(F.sum("_s").alias("_t"))
    return sums.join(total, survey).select(survey, variable, (F.col("_s") / F.col("_t")).alias("weighted_share"))
