"""Index, trend, divergence, forecast and risk queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import constants as C
from ..functions.scalars import half_even
from ..operators import divergence, forecast, index, reporting, risk
from ..sources.views import Views
from .base_sql import he, hei, joined, with_views
from .registry import query


def flat(df: DataFrame, *names: str) -> DataFrame:
    """Code arrays as comma-joined text."""
    for name in names:
        df = df.withColumn(name, F.array_join(name, ","))
    return df


def index_sql(keys: str, dims: str) -> str:
    """Index statement over a ``dims`` relation with the given keys."""
    return f""",
dims AS ({dims}),
g AS (SELECT {keys}, sum(score*weight)/sum(weight) AS v,
             sum(CASE WHEN source = 'SURVEY' THEN weight ELSE CAST(0 AS DOUBLE) END)/sum(weight) AS share,
             min(CASE WHEN source = 'SURVEY' AND effective_n <> 0 THEN effective_n END) AS n
      FROM dims GROUP BY {keys}),
m AS (SELECT *, CAST(98 AS DOUBLE)/sqrt(n)*share AS margin FROM g),
idx AS (SELECT {keys}, {he('v', 2)} AS value,
       CASE WHEN n > 0 THEN {he('greatest(CAST(0 AS DOUBLE), v - margin)', 2)} END AS ci_low,
       CASE WHEN n > 0 THEN {he('least(CAST(100 AS DOUBLE), v + margin)', 2)} END AS ci_high,
       n AS effective_n, {he('share', 3)} AS generalisable_share,
       {joined(('NON_PROBABILITY_SHARE', 'share < 1 - 1e-12'), ('BELOW_MIN_N', 'n < 250'), ('NO_CI', 'n IS NULL OR n <= 0'))} AS limitations
  FROM m)"""


LATEST_DIMS = """SELECT project_id, value AS score, weight, source, effective_n FROM latest JOIN weights USING (metric)"""
PERIOD_DIMS = """SELECT project_id, period_end, value AS score, weight, source, effective_n FROM snapshots JOIN weights USING (metric)"""
INDEX_COLUMNS = ["value", "ci_low", "ci_high", "effective_n", "generalisable_share", "limitations"]


def period_index(v: Views) -> DataFrame:
    """Index of every period: all dimensions measured in that week."""
    snaps = v.snapshots().withColumn("weight", index.literal_map(C.DEFAULT_INDEX_WEIGHTS)[F.col("metric")])
    dims = snaps.filter(F.col("weight") > 0).select(
        "project_id", "period_end", F.col("metric").alias("key"), F.col("value").alias("score"), "weight", "source", "effective_n"
    )
    return index.opinion_index(dims, ["project_id", "period_end"])


@query("opinion_index", with_views("latest", "weights") + index_sql("project_id", LATEST_DIMS) + " SELECT * FROM idx")
def opinion_index(v: Views) -> DataFrame:
    dims = index.index_dimensions(v.snapshots())
    return flat(index.opinion_index(dims), "limitations").select("project_id", *INDEX_COLUMNS)


def project_weights(v: Views) -> DataFrame:
    """Each project doubles the weight of one dimension and leaves out another, by its number."""
    names = sorted(C.DEFAULT_INDEX_WEIGHTS)
    n, p = len(names), F.col("project_id")
    weights = F.create_map(*[
        x for i, k in enumerate(names)
        for x in (F.lit(k), F.when(p % n == i, 2 * C.DEFAULT_INDEX_WEIGHTS[k]).when((p + 1) % n == i, 0.0).otherwise(C.DEFAULT_INDEX_WEIGHTS[k]))
    ])
    return v.snapshots().select("project_id").distinct().select("project_id", weights.alias("poi_weights"))


_OWN_DIMS = """SELECT project_id, value AS score, source, effective_n, w AS weight FROM (
    SELECT l.*, CASE WHEN project_id % 6 = i THEN 2*weight WHEN (project_id + 1) % 6 = i THEN 0 ELSE weight END AS w
    FROM latest l JOIN (SELECT metric, weight, row_number() OVER (ORDER BY metric) - 1 AS i FROM weights) x USING (metric)) y WHERE w > 0"""


@query("opinion_index_own_weights", with_views("latest", "weights") + index_sql("project_id", _OWN_DIMS) + " SELECT * FROM idx")
def opinion_index_own_weights(v: Views) -> DataFrame:
    dims = index.index_dimensions(v.snapshots(), project_weights(v))
    return flat(index.opinion_index(dims), "limitations").select("project_id", *INDEX_COLUMNS)


@query(
    "current_index",
    with_views("latest", "weights") + index_sql("project_id", LATEST_DIMS)
    + f""", mx AS (SELECT project_id, string_agg(source || '=' || share, ',' ORDER BY source) AS source_mix FROM
          (SELECT project_id, source, {he('sum(weight)/any_value(t)', 4)} AS share FROM dims
           JOIN (SELECT project_id, sum(weight) AS t FROM dims GROUP BY 1) x USING (project_id) GROUP BY 1, 2) y GROUP BY 1)
      SELECT project_id, CASE WHEN effective_n >= 250 THEN value END AS value, CASE WHEN effective_n >= 250 THEN ci_low END AS ci_low,
          CASE WHEN effective_n >= 250 THEN ci_high END AS ci_high, effective_n, NOT coalesce(effective_n >= 250, FALSE) AS insufficient_data,
          generalisable_share, source_mix, 'WEIGHTED_MEAN_OF_DIMENSIONS' AS method, limitations FROM idx JOIN mx USING (project_id)""",
)
def current_index(v: Views) -> DataFrame:
    """Current index per project as it may be shown: gated, with source mix and method."""
    gated = index.publication_gate(index.opinion_index(index.index_dimensions(v.snapshots())))
    mix = F.array_sort(F.transform(F.map_entries("source_mix"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))))
    return flat(gated.withColumn("source_mix", mix), "source_mix", "limitations").select(
        "project_id", "value", "ci_low", "ci_high", "effective_n", "insufficient_data",
        "generalisable_share", "source_mix", "method", "limitations",
    )


@query(
    "opinion_index_kish",
    with_views("latest", "weights", "respondents") + index_sql("project_id", LATEST_DIMS).replace(
        "m AS (", "k AS (SELECT project_id, CAST(floor(sum(weight)*sum(weight)/sum(weight*weight)) AS INTEGER) AS kn "
        "FROM respondents GROUP BY 1),\nm AS ("
    ).replace("m AS (SELECT *, CAST(98 AS DOUBLE)/sqrt(n)*share AS margin FROM g)",
              "m AS (SELECT project_id, v, share, coalesce(kn, n) AS n, CAST(98 AS DOUBLE)/sqrt(coalesce(kn, n))*share AS margin "
              "FROM g LEFT JOIN k USING (project_id))")
    + " SELECT * FROM idx",
)
def opinion_index_kish(v: Views) -> DataFrame:
    dims = index.index_dimensions(v.snapshots())
    out = index.opinion_index(dims, respondent_weights=v.respondents().select(F.col("project_id").cast("long"), "weight"))
    return flat(out, "limitations").select("project_id", *INDEX_COLUMNS)


@query(
    "publication_gate",
    with_views("snapshots", "weights") + index_sql("project_id, period_end", PERIOD_DIMS)
    + """ SELECT project_id, period_end, CASE WHEN effective_n >= 250 THEN value END AS value,
          CASE WHEN effective_n >= 250 THEN ci_low END AS ci_low, CASE WHEN effective_n >= 250 THEN ci_high END AS ci_high,
          effective_n, NOT coalesce(effective_n >= 250, FALSE) AS insufficient_data, limitations FROM idx""",
)
def publication_gate(v: Views) -> DataFrame:
    gated = index.publication_gate(period_index(v))
    return flat(gated, "limitations").select(
        "project_id", "period_end", "value", "ci_low", "ci_high", "effective_n", "insufficient_data", "limitations"
    )


@query(
    "index_change",
    with_views("snapshots", "weights") + index_sql("project_id, period_end", PERIOD_DIMS)
    + f""", p AS (SELECT *, lag(value) OVER w AS pv, lag(ci_low) OVER w AS pl, lag(ci_high) OVER w AS ph
             FROM idx WINDOW w AS (PARTITION BY project_id ORDER BY period_end)),
      d AS (SELECT *, {he('value - pv', 2)} AS delta FROM p WHERE pv IS NOT NULL)
      SELECT project_id, period_end, value, pv AS previous_value, delta,
             CASE WHEN delta > 0 THEN 'UP' WHEN delta < 0 THEN 'DOWN' ELSE 'EQUAL' END AS direction,
             coalesce(ci_low > ph OR ci_high < pl, FALSE) AS intervals_separated FROM d""",
)
def index_change(v: Views) -> DataFrame:
    return index.index_change(period_index(v)).select(
        "project_id", "period_end", "value", "previous_value", "delta", "direction", "intervals_separated"
    )


@query(
    "source_mix",
    with_views("latest", "weights") + f""", dims AS ({LATEST_DIMS})
    SELECT project_id, source, {he('sum(weight)/any_value(t)', 4)} AS share
    FROM dims JOIN (SELECT project_id, sum(weight) AS t FROM dims GROUP BY 1) x USING (project_id) GROUP BY 1, 2""",
)
def source_mix(v: Views) -> DataFrame:
    out = index.opinion_index(index.index_dimensions(v.snapshots()))
    return out.select("project_id", F.explode("source_mix").alias("source", "share"))


@query(
    "latest_snapshot",
    with_views("latest") + " SELECT project_id, metric, source, period_end, round(value, 6) AS value, effective_n FROM latest",
)
def latest_snapshot(v: Views) -> DataFrame:
    return index.latest_snapshots(v.snapshots()).select(
        "project_id", "metric", "source", "period_end", F.round("value", 6).alias("value"), "effective_n"
    )


@query(
    "latest_index",
    with_views("snapshots", "weights") + index_sql("project_id, period_end", PERIOD_DIMS)
    + """ SELECT project_id, period_end, value, ci_low, ci_high, effective_n FROM
          (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY period_end DESC) AS rn FROM idx) x WHERE rn = 1""",
)
def latest_index(v: Views) -> DataFrame:
    stored = period_index(v).withColumn("metric", F.lit("poi"))
    return index.latest_index(stored).select("project_id", "period_end", "value", "ci_low", "ci_high", "effective_n")


@query(
    "latest_per_source",
    with_views("positive") + """ SELECT project_id, source, round(value, 6) AS value, effective_n AS n FROM
      (SELECT *, row_number() OVER (PARTITION BY project_id, metric, source ORDER BY period_end DESC) AS rn FROM positive) x WHERE rn = 1""",
)
def latest_per_source(v: Views) -> DataFrame:
    return divergence.signal_readings(v.positive_readings()).select(
        "project_id", "source", F.round("value", 6).alias("value"), "n"
    )


@query(
    "weight_preview_grid",
    with_views("latest") + f""", grid(candidate, metric, w) AS (VALUES
      ('equal','sentiment',CAST(1 AS DOUBLE)),('equal','approval',1),('equal','trust',1),('equal','satisfaction',1),('equal','issue_perception',1),
      ('trust_only','trust',1),('none','trust',0)),
    r AS (SELECT project_id, c.candidate, l.value AS score, coalesce(g.w, CAST(0 AS DOUBLE)) AS w
          FROM latest l CROSS JOIN (SELECT DISTINCT candidate FROM grid) c LEFT JOIN grid g ON g.candidate = c.candidate AND g.metric = l.metric)
    SELECT project_id, candidate, {he('sum(score*w)/CASE WHEN sum(w) = 0 THEN CAST(1 AS DOUBLE) ELSE sum(w) END', 2)} AS value FROM r GROUP BY 1, 2""",
)
def weight_preview_grid(v: Views) -> DataFrame:
    dims = index.index_dimensions(v.snapshots())
    five = ["sentiment", "approval", "trust", "satisfaction", "issue_perception"]
    return index.weighted_index_preview(
        dims, {"equal": {d: 1.0 for d in five}, "trust_only": {"trust": 1.0}, "none": {"trust": 0.0}}
    )


TREND_SQL = with_views("snapshots") + """, t AS (SELECT * FROM
  (SELECT *, dense_rank() OVER (PARTITION BY project_id, metric ORDER BY period_end DESC) AS dr FROM snapshots
   WHERE metric IN ('trust', 'approval', 'sentiment')) x WHERE dr <= 3)"""
TREND_METRICS = ["trust", "approval", "sentiment"]


@query("trend_last_n", TREND_SQL + " SELECT project_id, metric, source, period_end, round(value, 6) AS value FROM t")
def trend_last_n(v: Views) -> DataFrame:
    return reporting.trend(v.snapshots(), TREND_METRICS, 3).select(
        "project_id", "metric", "source", "period_end", F.round("value", 6).alias("value")
    )


@query(
    "trend_pivot",
    TREND_SQL + """ SELECT project_id, period_end, round(max(CASE WHEN metric = 'trust' THEN value END), 6) AS trust,
      round(max(CASE WHEN metric = 'approval' THEN value END), 6) AS approval,
      round(max(CASE WHEN metric = 'sentiment' THEN value END), 6) AS sentiment FROM t GROUP BY 1, 2""",
)
def trend_pivot(v: Views) -> DataFrame:
    wide = reporting.trend_pivot(reporting.trend(v.snapshots(), TREND_METRICS, 3), TREND_METRICS)
    return wide.select("project_id", "period_end", *[F.round(m, 6).alias(m) for m in TREND_METRICS])


@query(
    "distinct_periods",
    with_views("snapshots") + " SELECT project_id, metric, count(DISTINCT period_end) AS periods FROM snapshots GROUP BY 1, 2",
)
def distinct_periods(v: Views) -> DataFrame:
    return reporting.distinct_periods(v.snapshots())


@query(
    "timeline_last_n",
    with_views("ev") + """ SELECT project_id, event_id, ts AS occurred_at, value FROM
      (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY ts DESC, event_id DESC) AS rn FROM ev WHERE event_type = 'error') x
      WHERE rn <= 20""",
)
def timeline_last_n(v: Views) -> DataFrame:
    return reporting.timeline(v.timeline(), 20).select(
        "project_id", "event_id", F.col("occurred_at").cast("timestamp_ntz").alias("occurred_at"), "value"
    )


@query(
    "signal_divergence",
    with_views("positive") + f""", r AS (SELECT *, CASE source WHEN 'SURVEY' THEN 0 WHEN 'SOCIAL' THEN 1 WHEN 'MEDIA' THEN 2 ELSE 3 END AS o FROM
      (SELECT *, row_number() OVER (PARTITION BY project_id, metric, source ORDER BY period_end DESC) AS rn FROM positive) x WHERE rn = 1),
    g AS (SELECT project_id, count(*) AS n_readings, max(value) - min(value) AS raw_gap,
            arg_min(source, value*1000 + o) AS lowest, arg_max(source, value*1000 - o) AS highest,
            coalesce(max(CASE WHEN source = 'SURVEY' THEN value END), 0) AS s, coalesce(max(CASE WHEN source = 'SOCIAL' THEN value END), 0) AS so,
            max(CASE WHEN source = 'MEDIA' THEN value END) AS m0, min(CASE WHEN source = 'SURVEY' THEN effective_n END) AS n
          FROM r GROUP BY 1),
    h AS (SELECT *, coalesce(m0, (s + so)/2) AS m, {he('raw_gap', 1)} AS gap FROM g)
    SELECT project_id, n_readings, gap, lowest, highest, gap >= 15 AS is_notable,
      {joined(('SELF_SELECTION', 'so < s - 10'), ('DEMOGRAPHIC', 'abs(s - so) > 10'), ('TIMING', 'TRUE'), ('MEDIA_FRAMING', 'least(s, so) < m AND m < greatest(s, so)'))} AS explanations,
      {joined(('QUALITATIVE_CONTRIBUTIONS', 'TRUE'), ('SOCIAL_NOT_WEIGHTABLE', 'TRUE'), ('SMALL_SURVEY', 'n < 400'))} AS limitations FROM h""",
)
def signal_divergence(v: Views) -> DataFrame:
    out = divergence.signal_divergence(divergence.signal_readings(v.positive_readings()))
    return flat(out, "explanations", "limitations").select(
        "project_id", "n_readings", "gap", "lowest", "highest", "is_notable", "explanations", "limitations"
    )


# three scenarios per project; the inputs grow with the project number
SCENARIOS = {
    "baseline": {"food_price": 0.0},
    "price_shock": {"food_price": 5.0, "negative_coverage": 2.0},
    "campaign": {"comms_intensity": 10.0, "food_price": -1.0},
}
_SCENARIO_VALUES = ", ".join(
    f"('{s}', '{d}', CAST({x} AS DOUBLE))" for s, inputs in SCENARIOS.items() for d, x in inputs.items()
)
_DRIVER_VALUES = ", ".join(f"('{k}', CAST({c} AS DOUBLE), CAST({u} AS DOUBLE))" for k, c, _, u in C.DRIVERS)
_SPREAD_VALUES = ", ".join(f"({h}, CAST({s} AS DOUBLE))" for h, s in C.SPREAD.items())


def project_scenarios(baselines: DataFrame) -> DataFrame:
    plan = F.array(*[
        F.struct(F.lit(s).alias("scenario"), F.lit(d).alias("driver"), F.lit(x).alias("x"))
        for s, inputs in SCENARIOS.items() for d, x in inputs.items()
    ])
    return baselines.select("project_id", F.inline(plan)).select(
        "project_id", "scenario", "driver", (F.col("x") * (F.col("project_id") + 1)).alias("input")
    )


_FORECAST_BASE = with_views("latest", "weights") + index_sql("project_id", LATEST_DIMS) + f""",
sc(scenario, driver, x) AS (VALUES {_SCENARIO_VALUES}), dr(driver, c, u) AS (VALUES {_DRIVER_VALUES}), sp(h, s) AS (VALUES {_SPREAD_VALUES}),
inp AS (SELECT project_id, value, scenario, driver, c, u, x*(project_id + 1) AS input FROM idx, sc JOIN dr USING (driver))"""


@query(
    "scenario_forecast",
    _FORECAST_BASE + f""",
    e AS (SELECT project_id, any_value(value) AS b, scenario, sum(c*input) AS eff, sum(u*abs(input)) AS extra, bool_or(input <> 0) AS is_simulation FROM inp GROUP BY project_id, scenario),
    f AS (SELECT project_id, scenario, CAST(h AS INTEGER) AS horizon_days, is_simulation, b + eff*least(1, h/CAST(90 AS DOUBLE)) AS ex, s + extra*least(1, h/CAST(90 AS DOUBLE)) AS w FROM e, sp)
    SELECT project_id, scenario, horizon_days, {he('ex', 1)} AS expected, {he('greatest(0, ex - w)', 1)} AS pi_low,
           {he('least(100, ex + w)', 1)} AS pi_high, is_simulation,
           {joined(('INTERVAL_INVERTED', 'greatest(0, ex - w) > least(100, ex + w)'))} AS violations FROM f""",
)
def scenario_forecast(v: Views) -> DataFrame:
    base = index.opinion_index(index.index_dimensions(v.snapshots())).select("project_id", F.col("value").alias("baseline"))
    out = forecast.scenario_forecast(base, project_scenarios(base))
    return flat(out, "violations").select(
        "project_id", "scenario", "horizon_days", "expected", "pi_low", "pi_high", "is_simulation", "violations"
    )


@query(
    "scenario_contributions",
    _FORECAST_BASE + f" SELECT project_id, scenario, driver, input, {he('c*input', 2)} AS effect_at_max_horizon FROM inp WHERE input <> 0",
)
def scenario_contributions(v: Views) -> DataFrame:
    base = index.opinion_index(index.index_dimensions(v.snapshots())).select("project_id")
    return forecast.driver_contributions(project_scenarios(base)).select(
        "project_id", "scenario", "driver", "input", "effect_at_max_horizon"
    )


RISK_LATE = "2024-01-16"


def risk_components(v: Views) -> DataFrame:
    """Nine components on 0..100 from one pass over the mentions."""
    m = v.mentions()
    late = F.col("published_at") >= F.lit(RISK_LATE).cast("timestamp")
    neg = F.when(F.col("sentiment") < 0, 1.0).otherwise(0.0)
    share = lambda cond: 100 * F.avg(F.when(cond, 1.0).otherwise(0.0))
    fall = lambda kind: 50 + (
        F.avg(F.when((F.col("event_type") == kind) & ~late, F.col("value")))
        - F.avg(F.when((F.col("event_type") == kind) & late, F.col("value")))
    )
    raw = {
        "negative_sentiment": 100 * F.avg(neg),
        "sentiment_velocity": 50 + 100 * (F.avg(F.when(late, neg)) - F.avg(F.when(~late, neg))),
        "issue_growth": share(late),
        "narrative_polarization": share(F.abs("sentiment") > 0.5),
        "influencer_amplification": 100.0 * F.sum(F.when(F.col("engagement") >= 100, F.col("engagement")).otherwise(0)) / F.sum("engagement"),
        "media_escalation": share(F.col("source") == "MEDIA"),
        "trust_decline": fall("signup"),
        "approval_decline": fall("purchase"),
    }
    # distinct topics are counted first, so their numbers may have any size
    topics = m.select("project_id", "topic_id").filter("topic_id is not null").distinct().groupBy("project_id").agg(
        (F.count(F.lit(1)) * 10.0).alias("geographic_spread")
    )
    wide = m.groupBy("project_id").agg(*[x.alias(k) for k, x in raw.items()]).join(topics, "project_id", "left").fillna(0.0, ["geographic_spread"])
    bounded = lambda k: F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.col(k)))
    rows = F.array(*[F.struct(F.lit(k).alias("component"), bounded(k).alias("value")) for k in [*raw, "geographic_spread"]])
    return wide.select("project_id", F.inline(rows))


def _fall_sql(kind: str) -> str:
    return (
        f"50 + (avg(CASE WHEN event_type = '{kind}' AND published_at < TIMESTAMP '{RISK_LATE}' THEN value END) - "
        f"avg(CASE WHEN event_type = '{kind}' AND published_at >= TIMESTAMP '{RISK_LATE}' THEN value END))"
    )


_NEG = "CASE WHEN sentiment < 0 THEN CAST(1 AS DOUBLE) ELSE 0 END"
_LATE = f"published_at >= TIMESTAMP '{RISK_LATE}'"
_RISK_RAW = {
    "negative_sentiment": f"100*avg({_NEG})",
    "sentiment_velocity": f"50 + 100*(avg(CASE WHEN {_LATE} THEN {_NEG} END) - avg(CASE WHEN NOT ({_LATE}) THEN {_NEG} END))",
    "issue_growth": f"100*avg(CASE WHEN {_LATE} THEN CAST(1 AS DOUBLE) ELSE 0 END)",
    "narrative_polarization": "100*avg(CASE WHEN abs(sentiment) > CAST(0.5 AS DOUBLE) THEN CAST(1 AS DOUBLE) ELSE 0 END)",
    "influencer_amplification": "CAST(100 AS DOUBLE)*sum(CASE WHEN engagement >= 100 THEN engagement ELSE 0 END)/sum(engagement)",
    "geographic_spread": "count(DISTINCT topic_id)*CAST(10 AS DOUBLE)",
    "media_escalation": "100*avg(CASE WHEN source = 'MEDIA' THEN CAST(1 AS DOUBLE) ELSE 0 END)",
    "trust_decline": _fall_sql("signup"),
    "approval_decline": _fall_sql("purchase"),
}
_RISK_SQL = with_views("mentions") + ", c AS (" + " UNION ALL ".join(
    f"SELECT project_id, {i} AS o, '{k}' AS component, CAST({C.RISK_WEIGHTS[k]} AS DOUBLE) AS w, greatest(CAST(0 AS DOUBLE), least(CAST(100 AS DOUBLE), {x})) AS value "
    f"FROM mentions GROUP BY project_id"
    for i, (k, x) in enumerate(_RISK_RAW.items())
) + "), t AS (SELECT *, value*w/(SELECT sum(w)/count(DISTINCT project_id) FROM c) AS contribution FROM c)"


@query(
    "risk_score",
    _RISK_SQL + f""", s AS (SELECT project_id, {hei('sum(contribution)')} AS score FROM t GROUP BY 1)
    SELECT project_id, score, CASE WHEN score <= 20 THEN 'Low' WHEN score <= 40 THEN 'Moderate' WHEN score <= 60 THEN 'Elevated'
           WHEN score <= 80 THEN 'High' ELSE 'Critical' END AS band FROM s""",
)
def risk_score(v: Views) -> DataFrame:
    return risk.risk_score(risk_components(v)).select("project_id", "score", "band")


@query(
    "risk_top3",
    _RISK_SQL + f""" SELECT project_id, component, {he('contribution', 2)} AS contribution FROM
      (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY contribution DESC, o) AS rn FROM t) x WHERE rn <= 3""",
)
def risk_top3(v: Views) -> DataFrame:
    return risk.risk_score(risk_components(v)).select("project_id", F.inline("top_contributors"))


@query(
    "polarization",
    with_views("segments") + f""", g AS (SELECT project_id, sum(size_pct) AS t, sum(sentiment*size_pct)/sum(size_pct) AS mean FROM segments GROUP BY 1),
    q AS (SELECT project_id, sqrt(sum(size_pct*(sentiment - mean)*(sentiment - mean))/any_value(t)) AS sd,
                 sum(CASE WHEN abs(sentiment) > 40 THEN size_pct ELSE 0 END)/any_value(t) AS pole,
                 sum(CASE WHEN abs(sentiment) <= 20 THEN size_pct ELSE 0 END)/any_value(t) AS middle
          FROM segments JOIN g USING (project_id) GROUP BY 1)
    SELECT project_id, {hei('least(100, sd*CAST(0.6 AS DOUBLE) + pole*60)')} AS polarization_score,
           CASE WHEN pole > 0.45 AND middle < 0.25 THEN 'polarised' WHEN middle > 0.5 THEN 'consensus' ELSE 'fragmented' END AS state,
           {he('pole', 3)} AS pole_mass, {he('middle', 3)} AS middle_mass, {he('sd', 2)} AS spread FROM q""",
)
def polarization(v: Views) -> DataFrame:
    return risk.polarization(v.segments()).select(
        "project_id", "polarization_score", "state", "pole_mass", "middle_mass", "spread"
    )


@query(
    "trend_at_events",
    with_views("snapshots") + f""", tr AS (SELECT project_id, period_end, {he('value', 4)} AS value FROM snapshots WHERE metric = 'approval'),
    se AS (SELECT *, value - lag(value) OVER (PARTITION BY project_id ORDER BY period_end) AS change FROM tr)
    SELECT e.event_id, e.project_id, s.period_end, s.value, {he('s.change', 4)} AS change
    FROM ev e ASOF LEFT JOIN se s ON e.project_id = s.project_id AND e.ts >= CAST(s.period_end AS TIMESTAMP)""",
)
def trend_at_events(v: Views) -> DataFrame:
    series = v.snapshots().filter(F.col("metric") == "approval").select("project_id", "period_end", half_even(F.col("value"), 4).alias("value"))
    events = v.events().select("event_id", "project_id", F.col("ts").alias("occurred_at"))
    found = reporting.trend_at_events(series, events)
    return found.select("event_id", "project_id", "period_end", "value", half_even(F.col("change"), 4).alias("change"))
