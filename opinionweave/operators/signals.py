"""Scores from items, snapshots, mentions, narratives and group comparisons."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import constants as C
from ..functions.scalars import chi_square_tail, half_even, index_z
from ..plans.ranking import top_n_per_key


# --- survey items -------------------------------------------------------------
def scored_items(responses: DataFrame, questions: DataFrame) -> DataFrame:
    """Answers of items that feed a dimension, reverse-scored and rescaled to 0..100."""
    items = questions.filter(F.col("poi_dimension").isNotNull()).select(
        "question_id", "poi_dimension", "reverse_scored", "scale_points"
    )
    v = F.col("value_num").cast("double")
    turned = F.when(F.col("reverse_scored"), F.col("scale_points") + 1 - v).otherwise(v)
    return (
        responses.filter(F.col("value_num").isNotNull())
        .join(items, "question_id")
        .select(
            "respondent_id", "poi_dimension", "question_id",
            ((turned - 1) / (F.col("scale_points") - 1) * 100).alias("score"),
        )
    )


def person_scores(
    responses: DataFrame, questions: DataFrame, dimensions: Sequence[str] = tuple(C.DEFAULT_INDEX_WEIGHTS)
) -> DataFrame:
    """One row per respondent with sum and count of item scores for every dimension.

    Answers leave their partition as one partial row per respondent, already in
    the partitioning that the join with the respondents needs.
    """
    of = lambda d: F.col("poi_dimension") == d
    aggs = []
    for d in dimensions:
        aggs += [F.sum(F.when(of(d), F.col("score"))).alias(f"_s_{d}"), F.count_if(of(d)).alias(f"_n_{d}")]
    return scored_items(responses, questions).groupBy("respondent_id").agg(*aggs)


def _by_dimension(joined: DataFrame, columns: Sequence[str], dimensions: Sequence[str], name: str) -> DataFrame:
    """Wide person scores as one row per answered dimension."""
    rows = F.array_compact(F.array(*[
        F.when(
            F.col(f"_n_{d}") > 0,
            F.struct(F.lit(d).alias(name), F.col(f"_s_{d}").alias("_sum"), F.col(f"_n_{d}").alias("_n")),
        )
        for d in dimensions
    ]))
    return joined.select(*columns, F.inline(rows))


def item_scores(
    respondents: DataFrame, responses: DataFrame, questions: DataFrame, keys: Sequence[str] = ("survey_id",),
    dimensions: Sequence[str] = tuple(C.DEFAULT_INDEX_WEIGHTS),
) -> DataFrame:
    """Respondent-weighted mean score per dimension."""
    w = F.col("weight").cast("double")
    joined = respondents.select(*keys, "respondent_id", "weight").join(
        person_scores(responses, questions, dimensions), "respondent_id"
    )
    rows = _by_dimension(joined, [*keys, "weight"], dimensions, "poi_dimension")
    return rows.groupBy(*keys, "poi_dimension").agg(
        (F.sum(w * F.col("_sum")) / F.sum(w * F.col("_n"))).alias("score"),
        F.count(F.lit(1)).alias("respondents"),
        F.sum("_n").alias("answers"),
    )


def produce_snapshots(
    respondents: DataFrame,
    responses: DataFrame,
    questions: DataFrame,
    keys: Sequence[str] = ("survey_id",),
    province: str = "province_code",
    segment: str = "age_band",
    confidence: float = 0.95,
    min_n: int = C.MIN_EFFECTIVE_N,
    dimensions: Sequence[str] = tuple(C.DEFAULT_INDEX_WEIGHTS),
) -> DataFrame:
    """Metric snapshots: national, per province and per segment, with Kish n and margin.

    A NULL province and segment is the whole sample. Values with too small an
    effective n are kept and flagged, the publication gate withholds them later.
    """
    joined = respondents.select(
        *keys, "respondent_id", F.col("weight").cast("double").alias("w"),
        F.col(province).alias("province_code"), F.col(segment).alias("segment"),
    ).join(person_scores(responses, questions, dimensions), "respondent_id")
    rows = _by_dimension(joined, [*keys, "province_code", "segment", "w"], dimensions, "metric")
    fixed = [*keys, "metric"]
    sets = rows.groupingSets(
        [
            [F.col(c) for c in fixed],
            [F.col(c) for c in [*fixed, "province_code"]],
            [F.col(c) for c in [*fixed, "segment"]],
        ],
        *fixed, "province_code", "segment",
    ).agg(
        (F.sum(F.col("w") * F.col("_sum")) / F.sum(F.col("w") * F.col("_n"))).alias("_value"),
        F.sum("w").alias("_s1"),
        F.sum(F.col("w") * F.col("w")).alias("_s2"),
        F.grouping_id().alias("_level"),
    )
    # a respondent without a segment is part of the totals, not a segment of its own
    named = F.when(F.col("_level") == 3, True).when(
        F.col("_level") == 1, F.col("province_code").isNotNull()
    ).otherwise(F.col("segment").isNotNull())
    n = F.floor(F.col("_s1") * F.col("_s1") / F.col("_s2")).cast("int")
    margin = F.lit(index_z(confidence) * 50.0) / F.sqrt(n)
    return sets.filter(named).select(
        *fixed,
        "province_code",
        "segment",
        F.lit(C.PROBABILITY_SOURCE).alias("source"),
        F.lit("VERIFIED_ITEM_AGGREGATE").alias("method"),
        half_even(F.col("_value"), 3).alias("value"),
        half_even(F.greatest(F.lit(0.0), F.col("_value") - margin), 3).alias("ci_low"),
        half_even(F.least(F.lit(100.0), F.col("_value") + margin), 3).alias("ci_high"),
        n.alias("effective_n"),
        (n < min_n).alias("below_min_n"),
    )


# --- mentions ---------------------------------------------------------------
def mention_stats(mentions: DataFrame, keys: Sequence[str] = ("project_id", "source")) -> DataFrame:
    """Volume, mean sentiment and engagement-weighted sentiment."""
    s, e = F.col("sentiment").cast("double"), F.col("engagement").cast("double")
    known = s.isNotNull()
    return mentions.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("volume"),
        F.avg(s).alias("mean_sentiment"),
        F.try_divide(F.sum(F.when(known, s * e)), F.sum(F.when(known, e))).alias("engagement_sentiment"),
        F.sum("engagement").alias("engagement"),
    )


def emotion_means(mentions: DataFrame, keys: Sequence[str] = ("project_id", "source")) -> DataFrame:
    """Mean of each emotion over the mentions that carry it."""
    return (
        mentions.select(*keys, F.explode("emotion").alias("emotion", "intensity"))
        .groupBy(*keys, "emotion")
        .agg(F.avg("intensity").alias("mean_intensity"), F.count(F.lit(1)).alias("mentions"))
    )


def narrative_momentum(mentions: DataFrame, keys: Sequence[str] = ("project_id",), days: int = 7) -> DataFrame:
    """Per day and narrative: share of the last ``days`` days and change against the days before.

    Mentions are first reduced to daily counts; all windows run on those.
    """
    daily = mentions.groupBy(
        *keys, F.col("published_at").cast("date").alias("day"), "narrative"
    ).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("source") == "MEDIA").alias("media"),
        F.sum("sentiment").alias("sent"),
    )
    return momentum_from_daily(daily, keys, days)


def momentum_from_daily(daily: DataFrame, keys: Sequence[str], days: int = 7) -> DataFrame:
    """Momentum out of daily counts (keys, day, narrative, n, media, sent).

    A row for every day of the project on which the narrative has mentions in the last ``days`` days or the ``days``
    before. A daily count enters its window on its day, passes to the window before after ``days`` days and leaves
    that after as many more: three steps a count, summed in order, hold both windows until the next step.
    """
    day_no = F.datediff("day", F.lit("1970-01-01"))
    totals = daily.groupBy(*keys, "day").agg(
        F.sum("n").alias("all_n"), F.sum(F.when(F.col("narrative").isNull(), F.col("n")).otherwise(0)).alias("none_n")
    ).withColumn("d", day_no)
    wt = W.partitionBy(*keys).orderBy("d")
    now, before = wt.rangeBetween(-days + 1, 0), wt.rangeBetween(-2 * days + 1, -days)
    totals = totals.select(
        *keys, "day", "d",
        F.sum("all_n").over(now).alias("t_now"),
        F.sum("all_n").over(before).alias("t_prev"),
        F.sum("none_n").over(now).alias("none_now"),
    )
    amounts = ("n", "media", "sent", "rated")
    counted = daily.filter(F.col("narrative").isNotNull() & F.col("day").isNotNull()).select(
        *keys, "narrative", day_no.alias("d"), "n", "media", F.coalesce("sent", F.lit(0.0)).alias("sent"),
        F.when(F.col("sent").isNotNull(), F.col("n")).otherwise(0).alias("rated"),
    )
    nothing = [F.lit(0).alias(f"{c}_now") for c in amounts]
    enters = F.struct(F.col("d").alias("at"), *[F.col(c).alias(f"{c}_now") for c in amounts], F.lit(0).alias("n_prev"))
    passes = F.struct((F.col("d") + days).alias("at"), *[(-F.col(c)).alias(f"{c}_now") for c in amounts], F.col("n").alias("n_prev"))
    leaves = F.struct((F.col("d") + 2 * days).alias("at"), *nothing, (-F.col("n")).alias("n_prev"))
    moved = [*[f"{c}_now" for c in amounts], "n_prev"]
    steps = counted.select(*keys, "narrative", F.inline(F.array(enters, passes, leaves))).groupBy(*keys, "narrative", "at").agg(
        *[F.sum(c).alias(c) for c in moved]
    )
    wn = W.partitionBy(*keys, "narrative").orderBy("at")
    upto = wn.rowsBetween(W.unboundedPreceding, W.currentRow)
    held = steps.select(*keys, "narrative", "at", F.lead("at").over(wn).alias("next"), *[F.sum(c).over(upto).alias(c) for c in moved])
    held = held.filter("n_now > 0 or n_prev > 0").select(
        *keys, "narrative", *moved, F.explode(F.sequence(F.col("at"), F.col("next") - 1)).alias("d")
    )
    share_now = F.try_divide("n_now", "t_now") * 100
    share_prev = F.try_divide("n_prev", "t_prev") * 100
    return held.join(totals, [*keys, "d"]).select(
        *keys, "day", "narrative",
        half_even(share_now, 2).alias("volume_pct"),
        half_even(share_now - share_prev, 2).alias("momentum_7d"),
        half_even(F.when(F.col("rated_now") > 0, F.try_divide("sent_now", "n_now")), 3).alias("sentiment"),
        F.col("media_now").alias("media_pickup"),
        half_even(F.try_divide("none_now", "t_now") * 100, 2).alias("unclustered_pct"),
    )


def issue_shares(
    counts: DataFrame, keys: Sequence[str] = ("project_id",), issue: str = "issue", period: str = "period_end",
    fast_pp: float = 5.0, stable_pp: float = 1.5,
) -> DataFrame:
    """Share of each issue per period, change in pp and a momentum label.

    ``counts``: keys, period, issue, n. The change is against the issue's previous
    period; the first period of an issue has none and is NEW.
    """
    totals = counts.groupBy(*keys, period).agg(F.sum("n").alias("_t"))
    rows = counts.join(totals, [*keys, period]).withColumn("_share", 100 * F.col("n") / F.col("_t"))
    w = W.partitionBy(*keys, issue).orderBy(period)
    delta = F.col("_share") - F.lag("_share").over(w)
    d = F.col("delta_pp")
    return (
        rows.withColumn("delta_pp", half_even(delta, 2))
        .withColumn("share_pct", half_even(F.col("_share"), 2))
        .withColumn(
            "momentum",
            F.when(d.isNull(), "NEW").when(d >= fast_pp, "RISING_FAST").when(d > stable_pp, "RISING")
            .when(d >= -stable_pp, "STABLE").otherwise("FALLING"),
        )
        .select(*keys, period, issue, "n", "share_pct", "delta_pp", "momentum")
    )


def influence_shares(
    mentions: DataFrame, keys: Sequence[str] = ("project_id",), author: str = "author_hash", top: int = 10
) -> DataFrame:
    """Authors with the largest share of engagement: an estimate of reach, not of control."""
    per_author = mentions.groupBy(*keys, author).agg(
        F.sum("engagement").alias("engagement"), F.count(F.lit(1)).alias("mentions")
    )
    totals = mentions.groupBy(*keys).agg(F.sum("engagement").alias("_t"))
    best = top_n_per_key(per_author, keys, [F.col("engagement").desc(), F.col(author).asc()], top, "rank", spread_by=[author])
    return best.join(totals, list(keys)).select(
        *keys, "rank", author, "engagement", "mentions",
        half_even(F.try_divide("engagement", "_t") * 100, 4).alias("engagement_share_pct"),
        F.lit("ESTIMATE_NOT_CONTROL").alias("limitation"),
    )


# --- comparisons ------------------------------------------------------------
def diff_in_diff(
    rows: DataFrame, treated: str, post: str, outcome: str, keys: Sequence[str] = ("project_id",)
) -> DataFrame:
    """(treated post - pre) - (control post - pre) per key."""
    t, p, y = F.col(treated), F.col(post), F.col(outcome)
    cells = rows.groupBy(*keys).agg(
        F.avg(F.when(t & p, y)).alias("treated_post"),
        F.avg(F.when(t & ~p, y)).alias("treated_pre"),
        F.avg(F.when(~t & p, y)).alias("control_post"),
        F.avg(F.when(~t & ~p, y)).alias("control_pre"),
        F.count_if(t).alias("n_treated"),
        F.count_if(~t).alias("n_control"),
    )
    effect = (F.col("treated_post") - F.col("treated_pre")) - (F.col("control_post") - F.col("control_pre"))
    return cells.withColumn("effect", effect).withColumn("design", F.lit("difference-in-differences"))


def segment_profile(
    members: DataFrame, keys: Sequence[str] = ("project_id",), segment: str = "segment", weight: str = "weight"
) -> DataFrame:
    """Weighted size, sentiment and trust per segment, given memberships."""
    w = F.col(weight).cast("double")
    g = members.filter(F.col(segment).isNotNull()).groupBy(*keys, segment).agg(
        F.sum(w).alias("_w"),
        F.count(F.lit(1)).alias("n"),
        (F.sum(w * F.col("sentiment")) / F.sum(F.when(F.col("sentiment").isNotNull(), w))).alias("sentiment"),
        (F.sum(w * F.col("trust")) / F.sum(F.when(F.col("trust").isNotNull(), w))).alias("trust"),
    )
    totals = g.groupBy(*keys).agg(F.sum("_w").alias("_t"))
    return g.join(totals, list(keys)).select(
        *keys, segment, "n",
        half_even(F.col("_w") / F.col("_t") * 100, 2).alias("size_pct"),
        half_even(F.col("sentiment"), 2).alias("sentiment"),
        half_even(F.col("trust"), 2).alias("trust"),
    )


def crosstab(
    rows: DataFrame, row: str, column: str, keys: Sequence[str] = ("project_id",), weight: str = "weight"
) -> DataFrame:
    """Weighted contingency table with expected counts and each cell's part of chi-square."""
    cells = (
        rows.filter(F.col(row).isNotNull() & F.col(column).isNotNull())
        .groupBy(*keys, row, column)
        .agg(F.sum(F.col(weight).cast("double")).alias("observed"))
    )
    # windows over table cells only, never over respondents
    rw, cw, aw = W.partitionBy(*keys, row), W.partitionBy(*keys, column), W.partitionBy(*keys)
    expected = F.sum("observed").over(rw) * F.sum("observed").over(cw) / F.sum("observed").over(aw)
    return cells.withColumn("expected", expected).withColumn(
        "chi2_part", (F.col("observed") - F.col("expected")) * (F.col("observed") - F.col("expected")) / F.col("expected")
    )


def crosstab_test(table: DataFrame, row: str, column: str, keys: Sequence[str] = ("project_id",)) -> DataFrame:
    """Chi-square, degrees of freedom, p-value and Cramer's V of a full contingency table.

    Cells that do not occur add their expected count to chi-square.
    """
    g = table.groupBy(*keys).agg(
        F.sum("chi2_part").alias("_part"),
        F.sum("expected").alias("_seen"),
        F.sum("observed").alias("n"),
        F.countDistinct(row).alias("r"),
        F.countDistinct(column).alias("c"),
    )
    chi2 = F.col("_part") + (F.col("n") - F.col("_seen"))
    smaller = F.least(F.col("r"), F.col("c")) - 1
    dof = ((F.col("r") - 1) * (F.col("c") - 1)).cast("int")
    return g.select(
        *keys, "n",
        chi2.alias("chi2"),
        dof.alias("dof"),
        chi_square_tail(chi2, dof).alias("p_value"),
        F.when(smaller > 0, F.sqrt(chi2 / (F.col("n") * smaller))).alias("cramers_v"),
    )
