"""Sampling, raking, response-quality and item-score queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import constants as C
from ..functions.scalars import lookup
from ..operators import index, raking, reporting, responses, sampling, signals
from ..sources.views import QUESTION_COUNT, Views
from .base_sql import he, hei, joined, with_views
from .index_queries import flat
from .registry import query

KEYS = ["project_id", "survey_id"]


# --- sampling -----------------------------------------------------------------
def designs(v: Views) -> DataFrame:
    """One design per nation: population counted from the customer frame."""
    k = F.col("n_nationkey")
    methods = {i: m for i, m in enumerate(C.DESIGN_EFFECT)}
    frame = v.raw("customer").groupBy("c_nationkey").agg((F.count(F.lit(1)) * 1000).alias("population"))
    return (
        frame.join(v.raw("nation"), F.col("c_nationkey") == k)
        .select(
            F.col("n_name").alias("province_code"),
            F.when(k % 5 != 0, F.col("population")).alias("population"),
            F.when(k % 3 == 0, 0.95).when(k % 3 == 1, 0.90).otherwise(F.when(k % 2 == 0, 0.99).otherwise(0.97)).alias("confidence"),
            ((k % 4 + 2) / F.lit(100.0)).alias("margin_of_error"),
            F.when(k % 7 == 0, 0.3).otherwise(0.5).alias("expected_proportion"),
            lookup(methods, (k % 6).cast("int")).alias("method"),
            ((k % 7 + 4) / F.lit(10.0)).alias("expected_response_rate"),
        )
    )


_METHOD_CASE = "CASE n_nationkey % 6 " + " ".join(f"WHEN {i} THEN '{m}'" for i, m in enumerate(C.DESIGN_EFFECT)) + " END"
_DEFF_CASE = "CASE method " + " ".join(f"WHEN '{m}' THEN CAST({d} AS DOUBLE)" for m, d in C.DESIGN_EFFECT.items()) + " END"


@query(
    "sample_size_plan",
    f"""WITH f AS (SELECT n_name AS province_code, n_nationkey AS k, CASE WHEN n_nationkey % 5 <> 0 THEN count(*)*1000 END AS population,
        CASE WHEN n_nationkey % 3 = 0 THEN CAST(1.96 AS DOUBLE) WHEN n_nationkey % 3 = 1 THEN CAST(1.6449 AS DOUBLE)
             WHEN n_nationkey % 2 = 0 THEN CAST(2.5758 AS DOUBLE) END AS z,
        (n_nationkey % 4 + 2)/CAST(100 AS DOUBLE) AS e, CASE WHEN n_nationkey % 7 = 0 THEN CAST(0.3 AS DOUBLE) ELSE CAST(0.5 AS DOUBLE) END AS p,
        {_METHOD_CASE} AS method, (n_nationkey % 7 + 4)/CAST(10 AS DOUBLE) AS rr
      FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name, n_nationkey),
    a AS (SELECT *, z*z*p*(1 - p)/(e*e) AS n00 FROM f),
    b AS (SELECT *, CASE WHEN population > 0 THEN n00/(1 + (n00 - 1)/population) ELSE n00 END AS n0 FROM a),
    d AS (SELECT *, CAST(ceil(n0) AS BIGINT) AS base_n, {_DEFF_CASE} AS design_effect FROM b),
    r AS (SELECT *, CAST(ceil(base_n*design_effect/rr) AS BIGINT) AS recommended_n FROM d)
    SELECT province_code, method, base_n, design_effect, recommended_n, z IS NOT NULL AND coalesce(population > 0, FALSE) AS finite_population_correction,
      CASE WHEN z IS NOT NULL THEN {joined(('NON_PROBABILITY', "method IN ('QUOTA', 'PURPOSIVE')"), ('CONSERVATIVE_PROPORTION', 'p = 0.5'), ('OVER_TENTH_OF_POPULATION', 'recommended_n > population*CAST(0.1 AS DOUBLE)'), ('LOW_RESPONSE_RATE', 'rr < 0.5'))} END AS warnings,
      CASE WHEN z IS NULL THEN 'UNKNOWN_CONFIDENCE' ELSE '' END AS violations FROM r""",
)
def sample_size_plan(v: Views) -> DataFrame:
    out = sampling.sample_size_plan(designs(v))
    return flat(out, "warnings", "violations").select(
        "province_code", "method", "base_n", "design_effect", "recommended_n", "finite_population_correction", "warnings", "violations"
    )


@query(
    "margin_by_province",
    with_views("respondents") + """ SELECT survey_id, province_code, count(*) AS n,
      round(CAST(1.96 AS DOUBLE)*sqrt(CAST(0.25 AS DOUBLE)/count(*)), 6) AS margin FROM respondents GROUP BY 1, 2""",
)
def margin_by_province(v: Views) -> DataFrame:
    counts = v.respondents().groupBy("survey_id", "province_code").agg(F.count(F.lit(1)).alias("n"))
    return sampling.margin_of_error(counts).select("survey_id", "province_code", "n", F.round("margin", 6).alias("margin"))


_BALANCE_STEPS = """,
    tot AS (SELECT project_id, survey_id, count(*) AS t FROM respondents GROUP BY 1, 2),
    got AS (SELECT project_id, survey_id, age_band, count(*) AS c FROM respondents GROUP BY 1, 2, 3),
    b AS (SELECT tot.project_id, tot.survey_id, census.age_band, coalesce(c, 0) AS achieved, coalesce(c, 0)/CAST(t AS DOUBLE) AS got, census_share, t
          FROM tot JOIN census USING (project_id) LEFT JOIN got ON got.survey_id = tot.survey_id AND got.project_id = tot.project_id AND got.age_band = census.age_band)"""
_BALANCE = with_views("respondents", "census") + _BALANCE_STEPS


@query(
    "stratum_balance",
    _BALANCE + f""" SELECT project_id, survey_id, age_band, achieved, {he('got', 4)} AS achieved_share, {he('census_share', 4)} AS census_share,
      {he('(got - census_share)*100', 2)} AS deviation_pp, {he('CASE WHEN got > 0 THEN census_share/got END', 4)} AS weight,
      abs((got - census_share)*100) > 3 AS flag FROM b""",
)
def stratum_balance(v: Views) -> DataFrame:
    rows, _ = sampling.stratum_balance(v.respondents(), v.census(), "age_band", KEYS, target_n=450)
    return rows


@query(
    "strata_in_order",
    _BALANCE + f""" SELECT project_id, survey_id, CAST(row_number() OVER (PARTITION BY project_id, survey_id ORDER BY age_band NULLS FIRST) AS INTEGER) AS position,
      age_band, achieved, {he('(got - census_share)*100', 2)} AS deviation_pp FROM b""",
)
def strata_in_order(v: Views) -> DataFrame:
    rows, _ = sampling.stratum_balance(v.respondents(), v.census(), "age_band", KEYS, target_n=450)
    return sampling.strata_in_order(rows, "age_band", KEYS).select(*KEYS, "position", "age_band", "achieved", "deviation_pp")


@query(
    "balance_report",
    _BALANCE + f""", r AS (SELECT project_id, survey_id, any_value(t) AS achieved_n, CAST(450 AS BIGINT) AS target_n, max(abs((got - census_share)*100)) AS mx, count_if(achieved = 0) AS e FROM b GROUP BY 1, 2)
      SELECT project_id, survey_id, achieved_n, target_n, {he('achieved_n/CAST(450 AS DOUBLE)', 4)} AS response_rate, {he('mx', 2)} AS max_deviation_pp,
      {joined(('EMPTY_STRATA', 'e > 0'), ('DEVIATION_OVER_TOLERANCE', 'mx > 3'), ('BELOW_TARGET', 'achieved_n < 360'))} AS warnings FROM r""",
)
def balance_report(v: Views) -> DataFrame:
    _, report = sampling.stratum_balance(v.respondents(), v.census(), "age_band", KEYS, target_n=450)
    return flat(report, "warnings").drop("empty_strata")


@query(
    "kish_ess",
    with_views("respondents") + """ SELECT survey_id, count(*) AS n, round(sum(weight)*sum(weight)/sum(weight*weight), 6) AS kish_n
      FROM respondents GROUP BY 1""",
)
def kish_ess(v: Views) -> DataFrame:
    return index.effective_sample_size(v.respondents(), ["survey_id"]).select("survey_id", "n", F.round("kish_n", 6).alias("kish_n"))


# --- raking ---------------------------------------------------------------------
GENDER = {"F": 0.5, "O": 0.3, "P": 0.2}
URBAN = {"1-URGENT": 0.3, "2-HIGH": 0.25, "3-MEDIUM": 0.2, "4-NOT SPECIFIED": 0.15, "5-LOW": 0.1}
AGE = {s: 0.2 for s in ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")}
TARGETS = {"gender": GENDER, "urbanicity": URBAN}
SLOW_TARGETS = {"gender": GENDER, "age_band": AGE}


def raking_sql(targets: dict, select: str, iterations: int = 25, tolerance: float = 0.001, trim: float = 3.0) -> str:
    """Raking written out step by step, finished surveys frozen; ends in relation ``final`` and ``diag``."""
    variables = list(targets)
    cols = ", ".join(variables)
    parts = [with_views("respondents")]
    for i, (var, shares) in enumerate(targets.items()):
        rows = ", ".join(f"('{c}', CAST({s} AS DOUBLE))" for c, s in shares.items())
        parts.append(f"tg{i}(cat, share) AS (VALUES {rows})")
    parts.append(
        f"c_0 AS MATERIALIZED (SELECT survey_id, {cols}, count(*) AS cnt, CAST(1 AS DOUBLE) AS w, TRUE AS active, 0 AS used, FALSE AS done "
        f"FROM respondents GROUP BY survey_id, {cols})"
    )
    prev = "c_0"
    for it in range(1, iterations + 1):
        changes = []
        for i, var in enumerate(variables):
            f, nxt = f"f_{it}_{i}", f"s_{it}_{i}"
            parts.append(
                f"{f} AS MATERIALIZED (SELECT survey_id, cat, share/(s/t) AS fac FROM "
                f"(SELECT survey_id, {var} AS cat, sum(w*cnt) AS s FROM {prev} WHERE active GROUP BY 1, 2) a "
                f"JOIN (SELECT survey_id, sum(w*cnt) AS t FROM {prev} WHERE active GROUP BY 1) b USING (survey_id) JOIN tg{i} USING (cat) WHERE s > 0)"
            )
            parts.append(
                f"{nxt} AS MATERIALIZED (SELECT p.* REPLACE (p.w*coalesce(f.fac, CAST(1 AS DOUBLE)) AS w) FROM {prev} p "
                f"LEFT JOIN {f} f ON f.survey_id = p.survey_id AND f.cat = p.{var})"
            )
            changes.append(f"SELECT survey_id, abs(fac - 1) AS d FROM {f}")
            prev = nxt
        parts.append(f"m_{it} AS MATERIALIZED (SELECT survey_id, max(d) AS mc FROM ({' UNION ALL '.join(changes)}) u GROUP BY 1)")
        parts.append(
            f"c_{it} AS MATERIALIZED (SELECT p.* REPLACE (CASE WHEN p.active THEN {it} ELSE p.used END AS used, "
            f"p.done OR coalesce(m.mc < {tolerance}, FALSE) AS done, p.active AND NOT coalesce(m.mc < {tolerance}, FALSE) AS active) "
            f"FROM {prev} p LEFT JOIN m_{it} m USING (survey_id))"
        )
        prev = f"c_{it}"
    parts.append(
        f"n1 AS MATERIALIZED (SELECT p.* REPLACE (p.w/(SELECT sum(q.w*q.cnt)/sum(q.cnt) FROM {prev} q WHERE q.survey_id = p.survey_id) AS w) FROM {prev} p)"
    )
    parts.append(
        "md AS MATERIALIZED (SELECT survey_id, quantile_cont(w, 0.5) AS med FROM n1, range(cnt) r GROUP BY 1)"
    )
    parts.append(
        f"tr AS MATERIALIZED (SELECT n1.*, med, w > med*{trim} AS over FROM n1 JOIN md USING (survey_id))"
    )
    parts.append(
        f"cap AS MATERIALIZED (SELECT * REPLACE (CASE WHEN over THEN med*{trim} ELSE w END AS w) FROM tr)"
    )
    parts.append(
        "final AS MATERIALIZED (SELECT p.* REPLACE (p.w/(SELECT sum(q.w*q.cnt)/sum(q.cnt) FROM cap q WHERE q.survey_id = p.survey_id) AS w) FROM cap p)"
    )
    parts.append(
        "diag AS (SELECT survey_id, CAST(sum(cnt) AS BIGINT) AS respondents, max(used) AS iterations, bool_or(done) AS converged, "
        "CAST(sum(CASE WHEN over THEN cnt ELSE 0 END) AS BIGINT) AS trimmed_count, "
        f"{he('max(w)', 4)} AS max_weight, {he('min(w)', 4)} AS min_weight FROM final GROUP BY 1)"
    )
    return ",\n".join(parts) + "\n" + select


def _cell_weights(v: Views, targets: dict) -> DataFrame:
    people = v.respondents()
    weights, _ = raking.rake_weights(people, targets)
    cells = list(targets)
    return (
        people.select("survey_id", "respondent_id", *cells).join(weights, ["survey_id", "respondent_id"])
        .groupBy("survey_id", *cells)
        .agg(F.count(F.lit(1)).alias("respondents"), F.round(F.avg("weight"), 6).alias("weight"))
    )


@query("rake_weights", raking_sql(TARGETS, "SELECT survey_id, gender, urbanicity, cnt AS respondents, round(w, 6) AS weight FROM final"))
def rake_weights(v: Views) -> DataFrame:
    return _cell_weights(v, TARGETS)


@query("rake_diagnostics", raking_sql(TARGETS, "SELECT * FROM diag"))
def rake_diagnostics(v: Views) -> DataFrame:
    _, diag = raking.rake_weights(v.respondents(), TARGETS)
    return diag.drop("untargeted_categories", "empty_targets", "warnings")


@query("rake_not_converged", raking_sql(SLOW_TARGETS, "SELECT *, concat_ws(',', CASE WHEN NOT converged THEN 'NOT_CONVERGED' END, CASE WHEN trimmed_count > 0 THEN 'WEIGHTS_TRIMMED' END) AS warnings FROM diag"))
def rake_not_converged(v: Views) -> DataFrame:
    _, diag = raking.rake_weights(v.respondents(), SLOW_TARGETS)
    return flat(diag, "warnings").drop("untargeted_categories", "empty_targets")


@query(
    "rake_marginals",
    raking_sql(TARGETS, "SELECT survey_id, gender, round(sum(w*cnt)/any_value(t), 6) AS weighted_share FROM final JOIN (SELECT survey_id, sum(w*cnt) AS t FROM final GROUP BY 1) x USING (survey_id) GROUP BY 1, 2"),
)
def rake_marginals(v: Views) -> DataFrame:
    weights, _ = raking.rake_weights(v.respondents(), TARGETS)
    return raking.marginals(v.respondents(), weights, "gender").withColumn("weighted_share", F.round("weighted_share", 6))


@query(
    "rake_store_weights",
    raking_sql(TARGETS, f"SELECT r.survey_id, r.gender, r.urbanicity, count(*) AS respondents, {he('any_value(w)', 4)} AS weight FROM respondents r "
               "JOIN final f ON f.survey_id = r.survey_id AND f.gender = r.gender AND f.urbanicity = r.urbanicity GROUP BY 1, 2, 3"),
)
def rake_store_weights(v: Views) -> DataFrame:
    weights, _ = raking.rake_weights(v.respondents(), TARGETS)
    stored = raking.store_weights(v.respondents(), weights)
    return stored.groupBy("survey_id", "gender", "urbanicity").agg(
        F.count(F.lit(1)).alias("respondents"), F.max("weight").cast("double").alias("weight")
    )


GAP_TARGETS = {"gender": {"F": 0.5, "O": 0.4, "X": 0.1}}


@query(
    "rake_coverage_warnings",
    with_views("respondents") + """, g AS (SELECT survey_id, gender FROM respondents GROUP BY 1, 2)
    SELECT survey_id, string_agg('gender=' || gender, ',' ORDER BY gender) FILTER (gender NOT IN ('F', 'O', 'X')) AS untargeted_categories,
           concat_ws(',', CASE WHEN bool_or(gender = 'F') THEN NULL ELSE 'gender=F' END, CASE WHEN bool_or(gender = 'O') THEN NULL ELSE 'gender=O' END, CASE WHEN bool_or(gender = 'X') THEN NULL ELSE 'gender=X' END) AS empty_targets FROM g GROUP BY 1""",
)
def rake_coverage_warnings(v: Views) -> DataFrame:
    _, diag = raking.rake_weights(v.respondents(), GAP_TARGETS)
    return flat(diag, "untargeted_categories", "empty_targets").select("survey_id", "untargeted_categories", "empty_targets")


# --- response quality -------------------------------------------------------------
@query(
    "median_duration",
    with_views("respondents") + " SELECT survey_id, quantile_cont(duration_sec, 0.5) AS median_duration_sec FROM respondents GROUP BY 1",
)
def median_duration(v: Views) -> DataFrame:
    return responses.median_duration(v.respondents())


@query(
    "running_median",
    with_views("respondents") + """ SELECT survey_id, respondent_id, quantile_cont(duration_sec, 0.5) OVER
      (PARTITION BY survey_id ORDER BY completed_at, respondent_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS running_median_sec FROM respondents""",
)
def running_median(v: Views) -> DataFrame:
    return responses.running_median(v.respondents()).select("survey_id", "respondent_id", "running_median_sec")


@query(
    "straight_lining",
    with_views("respondents", "responses") + """ SELECT survey_id, count(*) AS respondents, CAST(count_if(flat) AS BIGINT) AS straight_liners FROM respondents JOIN
      (SELECT respondent_id, count(*) >= 6 AND min(value_num) = max(value_num) AS flat FROM responses GROUP BY 1) x USING (respondent_id) GROUP BY 1""",
)
def straight_lining(v: Views) -> DataFrame:
    quality = responses.response_quality(v.respondents(), v.responses())
    return quality.groupBy("survey_id").agg(
        F.count(F.lit(1)).alias("respondents"),
        F.count_if(F.array_contains("quality_flags", "STRAIGHT_LINING")).alias("straight_liners"),
    )


TRAPS = [(1, 2), (3, 4)]


def _quality_sql(median: str) -> str:
    return with_views("respondents", "responses") + f""",
    st AS (SELECT respondent_id, count(*) AS k, min(value_num) AS lo, max(value_num) AS hi, stddev_pop(value_num) AS sd,
             max(CASE WHEN question_id = 1 THEN value_num END) AS q1, max(CASE WHEN question_id = 2 THEN value_num END) AS q2,
             max(CASE WHEN question_id = 3 THEN value_num END) AS q3, max(CASE WHEN question_id = 4 THEN value_num END) AS q4 FROM responses GROUP BY 1),
    md AS ({median}),
    j AS (SELECT r.survey_id, respondent_id, md.med, st.*, coalesce(med > 0 AND coalesce(duration_sec, 0) < med*CAST(0.35 AS DOUBLE), FALSE) AS speed,
             k >= 6 AND lo = hi AS flat, k >= 6 AND lo <> hi AND sd < 0.25 AS low, abs(q1 + q2 - 6) > 2 OR abs(q3 + q4 - 6) > 2 AS odd
          FROM respondents r JOIN st USING (respondent_id) JOIN md USING (MDKEY))
    SELECT survey_id, respondent_id, med AS median_duration_sec,
      CAST(greatest(0, 100 - CASE WHEN speed THEN 30 ELSE 0 END - CASE WHEN flat THEN 35 WHEN low THEN 10 ELSE 0 END - CASE WHEN odd THEN 20 ELSE 0 END) AS INTEGER) AS quality_score,
      {joined(('SPEEDING', 'speed'), ('STRAIGHT_LINING', 'flat'), ('INCONSISTENT', 'odd'))} AS quality_flags FROM j"""


@query(
    "response_quality",
    _quality_sql("SELECT survey_id, quantile_cont(duration_sec, 0.5) AS med FROM respondents GROUP BY 1").replace("MDKEY", "survey_id"),
)
def response_quality(v: Views) -> DataFrame:
    out = responses.response_quality(v.respondents(), v.responses(), trap_pairs=TRAPS)
    return flat(out, "quality_flags").select("survey_id", "respondent_id", "median_duration_sec", "quality_score", "quality_flags")


@query(
    "response_quality_running",
    _quality_sql(
        "SELECT respondent_id, quantile_cont(duration_sec, 0.5) OVER (PARTITION BY survey_id ORDER BY completed_at, respondent_id "
        "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS med FROM respondents"
    ).replace("MDKEY", "respondent_id"),
)
def response_quality_running(v: Views) -> DataFrame:
    out = responses.response_quality(v.respondents(), v.responses(), trap_pairs=TRAPS, median_mode="running")
    return flat(out, "quality_flags").select("survey_id", "respondent_id", "median_duration_sec", "quality_score", "quality_flags")


@query(
    "short_durations",
    with_views("respondents") + " SELECT survey_id, CAST(count_if(duration_sec < 100) AS BIGINT) AS flagged FROM respondents GROUP BY 1",
)
def short_durations(v: Views) -> DataFrame:
    return responses.flag_short_durations(v.respondents(), 100).groupBy("survey_id").agg(
        F.count_if(F.array_contains("quality_flags", "SPEEDING")).alias("flagged")
    )


_VECTOR_SQL = """, vec AS (SELECT survey_id, respondent_id, vector, count(*) OVER (PARTITION BY survey_id, vector) AS copies FROM
  (SELECT respondent_id, string_agg(question_id || ':' || value_num, '|' ORDER BY question_id) AS vector FROM responses GROUP BY 1) a
  JOIN respondents USING (respondent_id))"""


@query(
    "duplicate_suspect",
    with_views("respondents", "responses") + _VECTOR_SQL + " SELECT survey_id, respondent_id, copies FROM vec WHERE copies > 1",
)
def duplicate_suspect(v: Views) -> DataFrame:
    return responses.duplicate_suspects(v.respondents(), v.responses()).select("survey_id", "respondent_id", "copies")


@query(
    "out_of_quota",
    with_views("respondents", "census") + """, r AS (SELECT project_id, survey_id, age_band, respondent_id, row_number() OVER
      (PARTITION BY survey_id, age_band ORDER BY completed_at, respondent_id) AS arrival_rank FROM respondents WHERE age_band IS NOT NULL)
    SELECT survey_id, age_band, respondent_id, arrival_rank FROM r JOIN census USING (project_id, age_band) WHERE arrival_rank > floor(census_share*400)""",
)
def out_of_quota(v: Views) -> DataFrame:
    people = v.respondents()
    surveys = people.select("project_id", "survey_id").distinct()
    quotas = surveys.join(v.census(), "project_id").select(
        "survey_id", "age_band", F.floor(F.col("census_share") * 400).alias("quota")
    )
    return responses.out_of_quota(people, quotas, "age_band").select(
        "survey_id", "age_band", "respondent_id", F.col("arrival_rank").cast("long").alias("arrival_rank")
    )


@query(
    "dataset_quality",
    _quality_sql("SELECT survey_id, quantile_cont(duration_sec, 0.5) AS med FROM respondents GROUP BY 1").replace("MDKEY", "survey_id")
    .replace("WITH respondents AS", with_views("census") + ",\nrespondents AS", 1)
    .replace("SELECT survey_id, respondent_id, med AS", ", q AS (SELECT survey_id, respondent_id, med AS", 1)
    + ")" + _VECTOR_SQL + _BALANCE_STEPS
    + f""", dv AS (SELECT survey_id, {he('max(abs((got - census_share)*100))', 2)} AS mx FROM b GROUP BY 1),
    c AS (SELECT r.survey_id, count(*) AS total, count_if(r.age_band IS NOT NULL AND a.k = 8) AS complete, count_if(vec.copies > 1) AS duplicates,
            count_if(q.quality_flags <> '') AS flagged, count_if(contains(q.quality_flags, 'INCONSISTENT')) AS inconsistent,
            avg(((CASE WHEN r.age_band IS NULL THEN 0 ELSE 1 END) + (CASE WHEN r.gender IS NULL THEN 0 ELSE 1 END) + (CASE WHEN r.province_code IS NULL THEN 0 ELSE 1 END))/CAST(3 AS DOUBLE)) AS filled
          FROM respondents r JOIN (SELECT respondent_id, count(*) AS k FROM responses GROUP BY 1) a USING (respondent_id) JOIN q USING (respondent_id) JOIN vec USING (respondent_id) GROUP BY 1),
    p AS (SELECT survey_id, total, {hei('100*complete/CAST(total AS DOUBLE)')} AS completeness, 100 - {hei('100*duplicates/CAST(total AS DOUBLE)')} AS duplicate,
            100 - {hei('100*flagged/CAST(total AS DOUBLE)')} AS response_qual, 100 - {hei('100*inconsistent/CAST(total AS DOUBLE)')} AS consistency,
            greatest(0, {hei('100 - mx*5')}) AS sample_balance, {hei('filled*100')} AS metadata_score FROM c JOIN dv USING (survey_id))
    SELECT *, {hei('(completeness + duplicate + response_qual*CAST(1.5 AS DOUBLE) + consistency + sample_balance*2 + metadata_score*CAST(0.5 AS DOUBLE))/7')} AS overall FROM p""",
)
def dataset_quality(v: Views) -> DataFrame:
    people, answers = v.respondents(), v.responses()
    quality = responses.response_quality(people, answers, trap_pairs=TRAPS)
    suspects = responses.duplicate_suspects(people, answers)
    answered = answers.filter(F.col("value_num").isNotNull()).groupBy("respondent_id").agg(F.count(F.lit(1)).alias("k"))
    filled = sum(F.when(F.col(c).isNotNull(), 1).otherwise(0) for c in ("age_band", "gender", "province_code")) / F.lit(3.0)
    complete = people.join(answered, "respondent_id", "left").select(
        "survey_id", "respondent_id",
        (F.col("age_band").isNotNull() & (F.coalesce("k", F.lit(0)) == QUESTION_COUNT)).alias("is_complete"),
        filled.alias("metadata_filled"),
    )
    counts = responses.dataset_quality_counts(quality, complete, suspects)
    _, report = sampling.stratum_balance(people, v.census(), "age_band", KEYS)
    deviation = report.select("survey_id", F.col("max_deviation_pp").alias("max_stratum_deviation_pp"))
    return responses.dataset_quality(counts.join(deviation, "survey_id")).select(
        "survey_id", "total", *C.DATASET_WEIGHTS, "overall"
    )


# --- scores and snapshots from items ---------------------------------------------
_SCORES = with_views("respondents", "responses", "questions") + """,
    it AS (SELECT respondent_id, poi_dimension, ((CASE WHEN reverse_scored THEN 6 - value_num ELSE value_num END) - 1)/4*100 AS score
           FROM responses JOIN questions USING (question_id)),
    pp AS (SELECT respondent_id, poi_dimension, sum(score) AS ss, count(*) AS nn FROM it GROUP BY 1, 2)"""


@query(
    "item_scores",
    _SCORES + """ SELECT survey_id, poi_dimension, round(sum(weight*ss)/sum(weight*nn), 6) AS score, count(*) AS respondents, CAST(sum(nn) AS BIGINT) AS answers
      FROM respondents JOIN pp USING (respondent_id) GROUP BY 1, 2""",
)
def item_scores(v: Views) -> DataFrame:
    return signals.item_scores(v.respondents(), v.responses(), v.questions()).withColumn("score", F.round("score", 6))


_SNAP = _SCORES + f""",
    gs AS (SELECT survey_id, project_id, poi_dimension AS metric, province_code, age_band AS segment, sum(weight*ss)/sum(weight*nn) AS val,
             CAST(floor(sum(weight)*sum(weight)/sum(weight*weight)) AS INTEGER) AS effective_n, grouping(province_code) AS gp, grouping(age_band) AS ga
           FROM respondents JOIN pp USING (respondent_id)
           GROUP BY GROUPING SETS ((survey_id, project_id, poi_dimension), (survey_id, project_id, poi_dimension, province_code), (survey_id, project_id, poi_dimension, age_band))),
    sn AS (SELECT project_id, survey_id, metric, province_code, segment, {he('val', 3)} AS value,
             {he('greatest(0, val - 98/sqrt(effective_n))', 3)} AS ci_low, {he('least(100, val + 98/sqrt(effective_n))', 3)} AS ci_high, effective_n
           FROM gs WHERE (gp = 1 AND ga = 1) OR (gp = 0 AND province_code IS NOT NULL) OR (ga = 0 AND segment IS NOT NULL))"""


@query("snapshots_grouping_sets", _SNAP + " SELECT * FROM sn")
def snapshots_grouping_sets(v: Views) -> DataFrame:
    return signals.produce_snapshots(v.respondents(), v.responses(), v.questions(), KEYS).select(
        "project_id", "survey_id", "metric", "province_code", "segment", "value", "ci_low", "ci_high", "effective_n"
    )


@query(
    "province_table",
    _SNAP + f""", lt AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY project_id, province_code, metric ORDER BY survey_id DESC) AS rn
        FROM sn WHERE province_code IS NOT NULL AND metric IN ('trust', 'approval')) x WHERE rn = 1),
    wd AS (SELECT project_id, province_code, max(CASE WHEN metric = 'trust' THEN value END) AS tv, max(CASE WHEN metric = 'trust' THEN effective_n END) AS tn,
             max(CASE WHEN metric = 'approval' THEN value END) AS av, max(CASE WHEN metric = 'approval' THEN effective_n END) AS an FROM lt GROUP BY 1, 2),
    gt AS (SELECT project_id, province_code, CASE WHEN tn >= 60 THEN {he('tv', 2)} END AS trust, CASE WHEN an >= 60 THEN {he('av', 2)} END AS approval,
             tn AS effective_n, CASE WHEN tn >= 60 THEN {he('98/sqrt(tn)', 2)} END AS margin, NOT coalesce(tn >= 60, FALSE) AS insufficient_data,
             CASE WHEN NOT coalesce(tn >= 60, FALSE) THEN 'NONE' WHEN tn > 400 THEN 'HIGH' ELSE 'MEDIUM' END AS confidence_label FROM wd)
    SELECT *, CAST(row_number() OVER (PARTITION BY project_id ORDER BY trust DESC NULLS LAST, province_code) AS INTEGER) AS rank FROM gt""",
)
def province_table(v: Views) -> DataFrame:
    snaps = signals.produce_snapshots(v.respondents(), v.responses(), v.questions(), KEYS).withColumn(
        "period_end", F.make_date(F.col("survey_id") % 100 + 1994, F.lit(12), F.lit(31))
    )
    # a lower gate than the default, so that both sides of it occur at small scale
    return reporting.province_table(snaps, ("trust", "approval"), "trust", min_n=60)


@query(
    "segment_profile",
    _SCORES + f""", mb AS (SELECT r.project_id, r.age_band AS segment, r.weight, s.ss/s.nn AS sentiment, t.ss/t.nn AS trust FROM respondents r
        JOIN pp s ON s.respondent_id = r.respondent_id AND s.poi_dimension = 'sentiment' JOIN pp t ON t.respondent_id = r.respondent_id AND t.poi_dimension = 'trust' WHERE r.age_band IS NOT NULL),
    g AS (SELECT project_id, segment, sum(weight) AS w, count(*) AS n, sum(weight*sentiment)/sum(weight) AS sentiment, sum(weight*trust)/sum(weight) AS trust FROM mb GROUP BY 1, 2)
    SELECT project_id, segment, n, {he('w/sum(w) OVER (PARTITION BY project_id)*100', 2)} AS size_pct, {he('sentiment', 2)} AS sentiment, {he('trust', 2)} AS trust FROM g""",
)
def segment_profile(v: Views) -> DataFrame:
    scores = signals.person_scores(v.responses(), v.questions(), ["sentiment", "trust"])
    members = v.respondents().withColumnRenamed("age_band", "segment").join(scores, "respondent_id").select(
        "project_id", "segment", "weight",
        *[(F.col(f"_s_{d}") / F.col(f"_n_{d}")).alias(d) for d in ("sentiment", "trust")],
    )
    return signals.segment_profile(members)


_CROSS = with_views("respondents") + """, ct AS (SELECT project_id, gender, age_band, sum(weight) AS o FROM respondents WHERE age_band IS NOT NULL GROUP BY 1, 2, 3),
    ce AS (SELECT *, sum(o) OVER (PARTITION BY project_id, gender)*sum(o) OVER (PARTITION BY project_id, age_band)/sum(o) OVER (PARTITION BY project_id) AS e FROM ct)"""


@query(
    "crosstab",
    _CROSS + " SELECT project_id, gender, age_band, round(o, 6) AS observed, round(e, 6) AS expected, round((o - e)*(o - e)/e, 6) AS chi2_part FROM ce",
)
def crosstab(v: Views) -> DataFrame:
    table = signals.crosstab(v.respondents(), "gender", "age_band")
    return table.select("project_id", "gender", "age_band", *[F.round(c, 6).alias(c) for c in ("observed", "expected", "chi2_part")])


@query(
    "crosstab_chi2_stat",
    _CROSS + """, g AS (SELECT project_id, sum(o) AS n, sum((o - e)*(o - e)/e) + sum(o) - sum(e) AS chi2, count(DISTINCT gender) AS r, count(DISTINCT age_band) AS c FROM ce GROUP BY 1)
    SELECT project_id, round(n, 6) AS n, round(chi2, 6) AS chi2, CAST((r - 1)*(c - 1) AS INTEGER) AS dof, round(sqrt(chi2/(n*(least(r, c) - 1))), 6) AS cramers_v FROM g""",
)
def crosstab_chi2_stat(v: Views) -> DataFrame:
    test = signals.crosstab_test(signals.crosstab(v.respondents(), "gender", "age_band"), "gender", "age_band")
    return test.select("project_id", F.round("n", 6).alias("n"), F.round("chi2", 6).alias("chi2"), "dof", F.round("cramers_v", 6).alias("cramers_v"))


@query(
    "crosstab_p_value",
    _CROSS + """, g AS (SELECT project_id, sum((o - e)*(o - e)/e) + sum(o) - sum(e) AS chi2, (count(DISTINCT gender) - 1)*(count(DISTINCT age_band) - 1) AS dof FROM ce GROUP BY 1),
    h AS (SELECT project_id, chi2/2 AS x, dof/CAST(2 AS DOUBLE) AS a FROM g)
    SELECT project_id, round(CASE WHEN x >= 200 THEN 0 ELSE greatest(0, 1 - list_sum(list_transform(range(401), lambda n: exp((a + n)*ln(x) - x - lgamma(a + n + 1))))) END, 6) AS p_value FROM h""",
)
def crosstab_p_value(v: Views) -> DataFrame:
    test = signals.crosstab_test(signals.crosstab(v.respondents(), "gender", "age_band"), "gender", "age_band")
    return test.select("project_id", F.round("p_value", 6).alias("p_value"))
