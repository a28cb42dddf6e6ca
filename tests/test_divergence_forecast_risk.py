import pytest
from pyspark.sql import functions as F

from opinionweave.operators import divergence, forecast, risk

READ = "project_id int, source string, value double, n int, known_bias string"


def gap(spark, *readings, **kw):
    df = spark.createDataFrame([(1, s, float(v), n, "b") for s, v, n in readings], READ)
    return divergence.signal_divergence(df, **kw).first()


def test_divergence(spark):
    r = gap(spark, ("SURVEY", 68, 1000), ("SOCIAL", 41, 9000))
    assert r.gap == 27 and r.is_notable and (r.lowest, r.highest) == ("SOCIAL", "SURVEY")
    assert not gap(spark, ("SURVEY", 68, 1000), ("SOCIAL", 60, 9000)).is_notable
    assert gap(spark, ("SURVEY", 15, 1000), ("SOCIAL", 0, 9000)).is_notable
    one = gap(spark, ("SURVEY", 68, 1000))
    assert one.violations == ["TOO_FEW_READINGS"] and one.gap is None
    three = gap(spark, ("SURVEY", 72, 300), ("SOCIAL", 48, 9000), ("MEDIA", 60, 500))
    assert three.gap == 24 and three.explanations == ["SELF_SELECTION", "DEMOGRAPHIC", "TIMING", "MEDIA_FRAMING"]
    assert "SMALL_SURVEY" in three.limitations
    assert [x.source for x in three.readings] == ["SOCIAL", "MEDIA", "SURVEY"]


def test_divergence_missing_sources_and_ties(spark):
    loose = gap(spark, ("SURVEY", 70, 1000), ("MEDIA", 65, 10))
    assert "SELF_SELECTION" in loose.explanations and "MEDIA_FRAMING" in loose.explanations
    strict = gap(spark, ("SURVEY", 70, 1000), ("MEDIA", 65, 10), strict_presence=True)
    assert strict.explanations == ["TIMING"]
    tie = gap(spark, ("DIGITAL", 50, 1), ("SOCIAL", 50, 1), ("SURVEY", 50, 500))
    assert (tie.lowest, tie.highest, tie.gap) == ("SURVEY", "SURVEY", 0.0)


def run(spark, baseline, inputs, **kw):
    base = spark.createDataFrame([(1, float(baseline))], "project_id int, baseline double")
    sc = spark.createDataFrame([(1, "s", d, float(x)) for d, x in inputs.items()] or [(1, "s", None, None)],
                               "project_id int, scenario string, driver string, input double")
    return {r.horizon_days: r for r in forecast.scenario_forecast(base, sc, **kw).collect()}


def test_forecast_flat_without_scenario(spark):
    out = run(spark, 70, {})
    assert {r.expected for r in out.values()} == {70.0} and sorted(out) == [1, 3, 7, 14, 30, 90]
    assert not out[90].is_simulation and "SIMULATION_NOT_PREDICTION" not in out[90].limitations


def test_forecast_direction_and_width(spark):
    assert run(spark, 70, {"food_price": -3})[90].expected > 70
    shock = run(spark, 70, {"food_price": 5})
    assert shock[90].expected < 70 and shock[90].is_simulation
    assert shock[1].expected > shock[90].expected
    flat = run(spark, 70, {"food_price": 0})
    assert flat[90].expected == 70 and not flat[90].is_simulation
    for h in flat:
        assert shock[h].pi_high - shock[h].pi_low >= flat[h].pi_high - flat[h].pi_low
    hard = run(spark, 5, {"food_price": 30})
    assert all(r.pi_low >= 0 and r.pi_high <= 100 for r in hard.values() if not r.violations)
    assert hard[90].violations == ["INTERVAL_INVERTED"] and hard[90].pi_high < hard[90].pi_low


def test_forecast_drivers(spark):
    own = run(spark, 50, {"x": 10}, drivers=[("x", 1.0, "u", 0.06)])
    assert own[90].expected == 60
    bad = run(spark, 50, {"nope": 1})
    assert bad[90].violations == ["UNKNOWN_DRIVER"] and bad[90].expected is None
    sc = spark.createDataFrame([(1, "s", "food_price", 5.0), (1, "s", "nope", 1.0), (1, "s", "comms_intensity", 0.0)],
                               "project_id int, scenario string, driver string, input double")
    good, unknown = forecast.split_scenarios(sc)
    assert good.count() == 1 and unknown.first().driver == "nope"
    assert forecast.driver_contributions(sc).first().effect_at_max_horizon == -3.6


def score(spark, components, **kw):
    df = spark.createDataFrame([(1, k, float(v)) for k, v in components.items()], "project_id int, component string, value double")
    return risk.risk_score(df, **kw).first()


def test_risk(spark):
    names = list(risk.C.RISK_WEIGHTS)
    zero, full = score(spark, dict.fromkeys(names, 0)), score(spark, dict.fromkeys(names, 100))
    assert (zero.score, zero.band) == (0, "Low") and (full.score, full.band) == (100, "Critical")
    assert [c.component for c in zero.top_contributors] == names[:3]
    assert [c.component for c in full.top_contributors] == names[:3]
    assert score(spark, {"a": 80, "b": 20}, weights={"a": 0.5, "b": 0.5}).score == 50
    part = score(spark, {names[0]: 50, "extra": 99})
    assert part.score is None and part.violations == ["MISSING_COMPONENTS"] and len(part.missing) == 8


@pytest.mark.parametrize("s,band", [(0, "Low"), (20, "Low"), (21, "Moderate"), (40, "Moderate"), (41, "Elevated"), (60, "Elevated"),
                                    (61, "High"), (80, "High"), (81, "Critical"), (100, "Critical"), (150, "Critical")])
def test_bands(spark, s, band):
    assert spark.range(1).select(risk.risk_band(F.lit(float(s))).alias("b")).first().b == band


def pole(spark, *segments):
    df = spark.createDataFrame([(1, str(i), float(p), float(s)) for i, (p, s) in enumerate(segments)],
                               "project_id int, name string, sentiment double, size_pct double")
    return risk.polarization(df).first()


def test_polarization(spark):
    near = pole(spark, (5, 0.4), (3, 0.3), (8, 0.3))
    assert near.polarization_score < 30 and near.state == "consensus"
    far = pole(spark, (70, 0.45), (-60, 0.45), (0, 0.10))
    assert far.polarization_score > 50 and far.state == "polarised" and far.pole_mass == 0.9
    assert pole(spark, (50, 0.25), (-30, 0.25), (10, 0.25), (-5, 0.25)).state == "fragmented"
    assert pole(spark, (5, 1.0)).violations == ["TOO_FEW_SEGMENTS"]
    none = pole(spark, (5, 0.0), (9, 0.0))
    assert none.violations == ["NO_SIZE"] and none.polarization_score is None
