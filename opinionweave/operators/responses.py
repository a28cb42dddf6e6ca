"""Response quality, dataset quality, batch ingest, duplicate and quota flags.

Flags never remove a respondent; that decision stays with a person.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import constants as C
from ..functions.scalars import codes, half_even
from ..plans.lineage import cut_lineage
from ..plans.quantiles import median_of_integers
from ..plans.ranking import group_rank, latest_per_key, ordered_slices
from ..plans.skew import salted_join
from ..sources.ingest import split_documents


def median_duration(respondents: DataFrame, survey: str = "survey_id") -> DataFrame:
    """Exact interpolated median of known durations per survey."""
    return median_of_integers(respondents, [survey], "duration_sec", "median_duration_sec")


def running_median(
    respondents: DataFrame,
    survey: str = "survey_id",
    arrival: Sequence[str] = ("completed_at", "respondent_id"),
    value: str = "duration_sec",
    name: str = "running_median_sec",
    rows_per_slice: int = 500_000,
) -> DataFrame:
    """Median of all known values that had arrived so far, the row itself included.

    A row without a value sees the median of those before it. A survey is cut into arrival slices. Each slice gets the value counts of all
    earlier slices, so it can be solved on its own; the result equals one pass
    over the whole survey. ``arrival`` must be a total order.
    """
    sliced = ordered_slices(
        respondents.select(survey, *arrival, value), [survey], list(arrival), rows_per_slice
    )
    counts = sliced.filter(F.col(value).isNotNull()).groupBy(survey, "_slice", value).agg(F.count(F.lit(1)).alias("_c"))
    by_value = W.partitionBy(survey, value).orderBy("_slice")
    ends = sliced.groupBy(survey).agg(F.max("_slice").alias("_last"))
    # counts of a value hold from the next slice on, until a slice changes them
    history = (
        counts.withColumn("_upto", F.sum("_c").over(by_value))
        .withColumn("_next", F.lead("_slice").over(by_value))
        .join(ends, survey)
        .filter(F.col("_slice") < F.col("_last"))
        .select(
            F.col(survey).alias("_survey"), F.col(value).alias("_value"), F.col("_upto").alias("_c"),
            F.explode(F.sequence(F.col("_slice") + 1, F.coalesce("_next", "_last"))).alias("_at"),
        )
    )

    def solve(rows, before):
        import numpy as np

        rows = rows.sort_values(list(arrival), kind="stable", na_position="first")
        known = rows[value].notna().to_numpy()
        x = rows[value].to_numpy()[known].astype(float)
        base_values = before["_value"].to_numpy(float)
        universe = np.unique(np.concatenate([x, base_values]))
        if not len(universe):
            rows[name] = None
            return rows[[survey, *arrival, name]]
        base = np.zeros(len(universe), dtype=np.int64)
        np.add.at(base, np.searchsorted(universe, base_values), before["_c"].to_numpy(np.int64))
        base_upto = np.concatenate([[0], np.cumsum(base)])
        code = np.searchsorted(universe, x)
        levels = max(1, int(len(universe) - 1).bit_length())
        end = np.cumsum(known)
        n = base_upto[-1] + end
        size = len(rows)

        def kth(rank):
            """k-th smallest of (base + first i rows) for every i, bit by bit from the top."""
            rank = rank.copy()
            left = np.zeros(size, dtype=np.int64)
            right = end.copy()
            node = np.zeros(size, dtype=np.int64)
            order = code
            for level in range(levels - 1, -1, -1):
                bit = (order >> level) & 1
                zeros = np.concatenate([[0], np.cumsum(bit == 0)])
                low_rows = zeros[right] - zeros[left]
                mid = np.minimum(node + (1 << level), len(universe))
                low_base = base_upto[mid] - base_upto[np.minimum(node, len(universe))]
                low = low_rows + low_base
                up = rank >= low
                ones_at = zeros[-1]
                left = np.where(up, ones_at + left - zeros[left], zeros[left])
                right = np.where(up, ones_at + right - zeros[right], zeros[right])
                rank = np.where(up, rank - low, rank)
                node = np.where(up, node + (1 << level), node)
                order = np.concatenate([order[bit == 0], order[bit == 1]])
            return universe[np.minimum(node, len(universe) - 1)]

        some = n > 0
        middle = (kth(np.maximum(n - 1, 0) // 2) + kth(np.minimum(n // 2, np.maximum(n - 1, 0)))) / 2.0
        rows[name] = np.where(some, middle, np.nan)
        rows[name] = rows[name].astype(object).where(some, None)
        return rows[[survey, *arrival, name]]

    fields = {f.name: f.dataType.simpleString() for f in sliced.schema.fields}
    schema = ", ".join(f"{c} {fields[c]}" for c in [survey, *arrival]) + f", {name} double"
    return (
        sliced.groupBy(survey, "_slice").cogroup(history.groupBy("_survey", "_at")).applyInPandas(
            lambda rows, before: solve(rows, before), schema
        )
    )


def response_quality(
    respondents: DataFrame,
    responses: DataFrame,
    questions: DataFrame | None = None,
    item_types: Sequence[str] | None = None,
    trap_pairs: Sequence[tuple] = (),
    scale_points: int = 5,
    speeding_ratio: float = 0.35,
    median_mode: str = "survey",
    null_duration: str = "zero",
    survey: str = "survey_id",
    medians: DataFrame | None = None,
) -> DataFrame:
    """Score 0..100, flags and reasons per respondent.

    All numeric answers count as scale items unless ``item_types`` names question
    types. ``median_mode='running'`` compares with the respondents present so
    far; ``medians`` (survey, median_duration_sec) supplies them ready made. A missing duration counts as 0 (``null_duration='zero'``) or is not
    judged ('skip').
    """
    answers = responses.filter(F.col("value_num").isNotNull())
    scale = F.lit(True)
    if item_types is not None:
        types = questions.select("question_id", "type")
        answers = answers.join(types, "question_id", "left")
        scale = F.coalesce(F.col("type").isin(list(item_types)), F.lit(False))
    v = F.col("value_num").cast("double")
    pair_items = sorted({q for pair in trap_pairs for q in pair})
    stats = answers.groupBy("respondent_id").agg(
        F.count_if(scale).alias("scale_items"),
        F.stddev_pop(F.when(scale, v)).alias("_sd"),
        F.min(F.when(scale, v)).alias("_lo"),
        F.max(F.when(scale, v)).alias("_hi"),
        *[F.max(F.when(F.col("question_id") == q, v)).alias(f"_q{i}") for i, q in enumerate(pair_items)],
    )
    if median_mode == "running":
        med = running_median(respondents, survey).select(
            survey, "respondent_id", F.col("running_median_sec").alias("_med")
        )
        base = respondents.join(med, [survey, "respondent_id"], "left")
    else:
        med = median_duration(respondents, survey) if medians is None else medians
        base = respondents.join(med.withColumnRenamed("median_duration_sec", "_med"), survey, "left")
    rows = base.join(stats, "respondent_id", "left")
    at = {q: F.col(f"_q{i}") for i, q in enumerate(pair_items)}
    odd = F.lit(False)
    for a, b in trap_pairs:
        odd = odd | F.coalesce(F.abs(at[a] + at[b] - (scale_points + 1)) > 2, F.lit(False))
    return rows.select(survey, "respondent_id", *quality_columns(odd, speeding_ratio, null_duration))


def quality_columns(odd: Column, speeding_ratio: float = 0.35, null_duration: str = "zero") -> list[Column]:
    """Score ladder over duration_sec, _med, scale_items, _lo, _hi and _sd of a respondent row."""
    median = F.coalesce("_med", F.lit(0.0))
    duration = F.coalesce("duration_sec", F.lit(0)) if null_duration == "zero" else F.col("duration_sec")
    items = F.coalesce("scale_items", F.lit(0))
    holds = lambda c: F.coalesce(c, F.lit(False))
    speeding = holds((median > 0) & (duration < median * speeding_ratio))
    flat = holds((items >= 6) & (F.col("_lo") == F.col("_hi")))
    low = holds((items >= 6) & (F.col("_lo") != F.col("_hi")) & (F.col("_sd") < 0.25))
    score = (
        F.lit(100) - F.when(speeding, 30).otherwise(0) - F.when(flat, 35).when(low, 10).otherwise(0)
        - F.when(odd, 20).otherwise(0)
    )
    flags = [("SPEEDING", speeding), ("STRAIGHT_LINING", flat), ("INCONSISTENT", odd)]
    return [
        items.alias("scale_items"),
        median.alias("median_duration_sec"),
        F.greatest(F.lit(0), score).alias("quality_score"),
        codes(*flags).alias("quality_flags"),
        codes(flags[0], flags[1], ("LOW_VARIATION", low), flags[2]).alias("reasons"),
    ]


def flag_short_durations(respondents: DataFrame, threshold_sec: int) -> DataFrame:
    """Set the SPEEDING flag below a fixed number of seconds."""
    return respondents.withColumn(
        "quality_flags", codes(("SPEEDING", F.col("duration_sec") < threshold_sec))
    )


def answer_vectors(responses: DataFrame) -> DataFrame:
    """Hash of a respondent's whole answer set (bounded by the questionnaire length): numbers, texts and JSON answers."""
    values = [c for c in ("value_num", "value_text", "value_json") if c in responses.columns]
    answers = F.sort_array(F.collect_list(F.struct("question_id", *values)))
    return responses.groupBy("respondent_id").agg(F.unhex(F.sha2(F.to_json(answers), 256)).alias("vector"))


def duplicate_suspects(respondents: DataFrame, responses: DataFrame, survey: str = "survey_id") -> DataFrame:
    """Respondents whose whole answer vector occurs more than once in their survey.

    Counts are combined before the shuffle; the join back spreads a vector held
    by very many respondents over several tasks.
    """
    # used twice; kept as 32 bytes per respondent instead of reading all answers again
    vectors = cut_lineage(
        respondents.select(survey, "respondent_id").join(answer_vectors(responses), "respondent_id")
    )
    repeated = (
        vectors.groupBy(survey, "vector").agg(F.count(F.lit(1)).alias("copies")).filter(F.col("copies") > 1)
    )
    return salted_join(vectors, repeated, [survey, "vector"], ["respondent_id"]).select(
        survey, "respondent_id", "copies", F.lit("DUPLICATE_SUSPECT").alias("flag")
    )


def out_of_quota(
    respondents: DataFrame,
    quotas: DataFrame,
    stratum: str,
    keys: Sequence[str] = ("survey_id",),
    arrival: Sequence[str] = ("completed_at", "respondent_id"),
) -> DataFrame:
    """Respondents who arrived after their stratum's quota was full.

    ``quotas``: keys, stratum, quota. Ranks are exact inside strata of any size.
    """
    cols = [*keys, stratum, *arrival]
    ranked = group_rank(
        respondents.select(*cols).filter(F.col(stratum).isNotNull()), [*keys, stratum], list(arrival), "arrival_rank"
    )
    return salted_join(ranked, quotas, [*keys, stratum], list(arrival)).filter(
        F.col("arrival_rank") > F.col("quota")
    ).withColumn("flag", F.lit("OUT_OF_QUOTA"))


def dataset_quality_counts(
    quality: DataFrame,
    completeness: DataFrame,
    suspects: DataFrame,
    survey: str = "survey_id",
) -> DataFrame:
    """Counts per survey that the dataset score needs.

    ``completeness``: survey, respondent_id, is_complete, metadata_filled (0..1).
    """
    marked = (
        completeness.join(quality.select("respondent_id", "quality_flags"), "respondent_id", "left")
        .join(suspects.select("respondent_id", F.lit(True).alias("_dup")), "respondent_id", "left")
    )
    flags = F.coalesce("quality_flags", F.array().cast("array<string>"))
    return marked.groupBy(survey).agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if("is_complete").alias("complete"),
        F.count_if(F.coalesce("_dup", F.lit(False))).alias("duplicates"),
        F.count_if(F.size(flags) > 0).alias("flagged"),
        F.count_if(F.array_contains(flags, "INCONSISTENT")).alias("inconsistent"),
        F.avg("metadata_filled").alias("metadata_fields_filled"),
    )


def dataset_quality(counts: DataFrame) -> DataFrame:
    """Six part scores and the weighted overall score per row of counts.

    Reads total, complete, duplicates, flagged, inconsistent,
    max_stratum_deviation_pp and metadata_fields_filled.
    """
    def pct(n: str) -> Column:
        return F.when(F.col("total") > 0, half_even(100 * F.col(n) / F.col("total"), 0)).otherwise(0.0)

    parts = {
        "completeness": pct("complete"),
        "duplicate": 100 - pct("duplicates"),
        "response_qual": 100 - pct("flagged"),
        "consistency": 100 - pct("inconsistent"),
        "sample_balance": F.greatest(F.lit(0.0), half_even(100 - F.col("max_stratum_deviation_pp") * 5, 0)),
        "metadata_score": half_even(F.col("metadata_fields_filled") * 100, 0),
    }
    out = counts
    for name, col in parts.items():
        out = out.withColumn(name, col.cast("int"))
    overall = sum((F.col(n) * w for n, w in C.DATASET_WEIGHTS.items()), F.lit(0.0))
    return out.withColumn("overall", half_even(overall / sum(C.DATASET_WEIGHTS.values()), 0).cast("int"))


def scored_respondents(people: DataFrame, medians: DataFrame) -> DataFrame:
    """Respondents with score and flags out of their ``answers`` and the medians (survey_id, _med) of their surveys.

    All answers of a respondent sit in one row, so they are summed up inside it, without a shuffle.
    """
    columns = [c for c in people.columns if c != "answers"]
    values = F.array_compact(F.transform("answers", lambda a: a["value_num"]))
    mean = F.aggregate("_v", F.lit(0.0), lambda s, x: s + x) / F.col("scale_items")
    squares = F.aggregate("_v", F.lit(0.0), lambda s, x: s + (x - F.col("_mean")) * (x - F.col("_mean")))
    scored = (
        people.withColumn("_v", values)
        .withColumn("scale_items", F.size("_v"))
        .withColumn("_mean", F.when(F.col("scale_items") > 0, mean))
        .withColumn("_sd", F.when(F.col("scale_items") > 0, F.sqrt(squares / F.col("scale_items"))))
        .withColumn("_lo", F.array_min("_v"))
        .withColumn("_hi", F.array_max("_v"))
        .join(medians, "survey_id", "left")
    )
    return scored.select(*columns, *quality_columns(F.lit(False))).drop("scale_items", "median_duration_sec", "reasons")


def ingest_batch(
    docs: DataFrame, stored_respondents: DataFrame | None = None, spread: int | None = None
) -> dict[str, DataFrame]:
    """Nested documents -> accepted respondents (scored), responses and rejects.

    A repeated (survey, anon_code) keeps its first completed document and rejects
    the others whole; a repeated answer to one question keeps the first given.
    ``stored_respondents`` (already on file) also reject repeats and add their
    durations to the survey median. All answers of a respondent sit in one
    document, so they are checked and summed up inside the row, without a shuffle.
    ``spread`` redistributes the documents over that many tasks first, for batches
    that arrive in fewer files than there are cores.
    """
    numbered = cut_lineage(
        (docs.repartition(spread) if spread else docs)
        # numbers follow the content among equal keys, so a batch that is run again keeps the same documents
        .withColumn("_hash", F.xxhash64(*docs.columns))
        .withColumn("_doc", F.monotonically_increasing_id())
        .withColumn("anon_code", F.col("respondent.anon_code"))
    )
    key = ["survey_id", "anon_code"]
    # the rank sees only keys and times, not the answers
    first = latest_per_key(numbered, key, [F.col("completed_at"), F.col("_hash"), F.col("_doc")]).select("_doc", *key)
    if stored_respondents is not None:
        first = first.join(stored_respondents.select(*key), key, "left_anti")
    marked = cut_lineage(numbered.join(first.select("_doc", F.lit(True).alias("_kept")), "_doc", "left"))
    rejected = marked.filter(F.col("_kept").isNull()).select(*docs.columns, "anon_code")
    kept, good, bad = split_documents(marked.filter("_kept"))

    durations = kept.select("survey_id", "duration_sec")
    if stored_respondents is not None:
        durations = durations.unionByName(stored_respondents.select("survey_id", "duration_sec"))
    medians = median_duration(durations).withColumnRenamed("median_duration_sec", "_med")
    return {
        "respondents": scored_respondents(kept, medians),
        "responses": good,
        "rejected_documents": rejected,
        "rejected_responses": bad,
    }
