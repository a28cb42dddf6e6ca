import pytest

from opinionweave.operators import sampling


def plan(spark, **fields):
    types = {"population": "long", "method": "string"}
    schema = ", ".join(f"{k} {types.get(k, 'double')}" for k in fields) or "x int"
    return sampling.sample_size_plan(spark.createDataFrame([tuple(fields.values()) or (1,)], schema)).first()


@pytest.mark.parametrize("moe,n", [(0.05, 385), (0.03, 1068)])
def test_simple_random_sample(spark, moe, n):
    r = plan(spark, margin_of_error=moe, method="SRS")
    assert r.base_n == n and r.recommended_n == n and not r.finite_population_correction


def test_variants(spark):
    srs = plan(spark, method="SRS")
    small = plan(spark, population=2000, method="SRS")
    assert small.recommended_n < srs.recommended_n and small.finite_population_correction
    assert "OVER_TENTH_OF_POPULATION" in small.warnings
    assert plan(spark, method="MULTISTAGE").recommended_n > srs.recommended_n
    assert "NON_PROBABILITY" in plan(spark, method="QUOTA").warnings
    low = plan(spark, method="SRS", expected_response_rate=0.4)
    assert low.recommended_n > 1068 and "LOW_RESPONSE_RATE" in low.warnings
    assert plan(spark).design_effect == 1.6 and "CONSERVATIVE_PROPORTION" in plan(spark).warnings


@pytest.mark.parametrize(
    "field,value,code",
    [("margin_of_error", 0.0, "MARGIN_RANGE"), ("expected_proportion", 1.5, "PROPORTION_RANGE"),
     ("expected_response_rate", 0.0, "RESPONSE_RATE_RANGE"), ("confidence", 0.97, "UNKNOWN_CONFIDENCE")],
)
def test_invalid_designs(spark, field, value, code):
    r = plan(spark, **{field: value})
    assert r.violations == [code] and r.recommended_n is None and r.base_n is None


def test_margin_inverts_size(spark):
    df = spark.createDataFrame([(1068,), (0,)], "n long")
    out = {r.n: r for r in sampling.margin_of_error(df).collect()}
    assert out[1068].margin == pytest.approx(0.03, abs=0.001)
    assert out[0].margin is None and out[0].violations == ["N_NOT_POSITIVE"]


def test_balance(spark):
    people = spark.createDataFrame([(1, "jawa")] * 500, "survey_id int, province_code string")
    rows, report = sampling.stratum_balance(people, {"jawa": 0.6, "luar": 0.4}, "province_code", target_n=800)
    r = report.first()
    assert r.achieved_n == 500 and r.empty_strata == ["luar"] and r.response_rate == 0.625
    assert set(r.warnings) == {"EMPTY_STRATA", "DEVIATION_OVER_TOLERANCE", "BELOW_TARGET"}
    by = {x.province_code: x for x in rows.collect()}
    assert by["luar"].achieved == 0 and by["luar"].weight is None and by["luar"].deviation_pp == -40.0
    assert by["jawa"].weight == 0.6 and by["jawa"].flag


def test_strata_outside_the_census_count_in_the_total(spark):
    people = spark.createDataFrame([(1, "a")] * 3 + [(1, "zzz")], "survey_id int, s string")
    census = spark.createDataFrame([(1, "a", 1.0)], "survey_id int, s string, census_share double")
    rows, report = sampling.stratum_balance(people, census, "s")
    assert rows.first().achieved_share == 0.75 and report.first().achieved_n == 4
    assert report.first().response_rate == 0.0
