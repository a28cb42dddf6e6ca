import pytest
from pyspark.sql import functions as F

from opinionweave.functions.scalars import half_even
from opinionweave.operators import index

SCHEMA = "project_id long, key string, score double, weight double, source string, effective_n int"


def dims(spark, *rows, project=1):
    return spark.createDataFrame([(project, f"d{i}", *r) for i, r in enumerate(rows)], SCHEMA)


def one(df):
    (row,) = df.collect()
    return row.asDict(recursive=True)


SURVEY3 = [(74.0, 25.0, "SURVEY", 8940), (72.0, 25.0, "SURVEY", 8940), (71.0, 12.0, "SURVEY", 8940)]


def test_weighted_mean(spark):
    r = one(index.opinion_index(dims(spark, (80.0, 3.0, "SURVEY", 1000), (60.0, 1.0, "SURVEY", 1000))))
    assert r["value"] == 75.0 and r["limitations"] == [] and r["source_mix"] == {"SURVEY": 1.0}


def test_interval_covers_the_probabilistic_share_only(spark):
    mixed = one(index.opinion_index(dims(spark, *SURVEY3, (61.0, 20.0, "SOCIAL", 200000))))
    pure = one(index.opinion_index(dims(spark, *SURVEY3)))
    width = lambda r: r["ci_high"] - r["ci_low"]
    assert 0 < width(mixed) < 2.5 and width(mixed) < width(pure)
    assert sum(mixed["source_mix"].values()) == pytest.approx(1, abs=1e-3)
    assert mixed["generalisable_share"] < 1
    assert mixed["limitations"] == ["NON_PROBABILITY_SHARE"] and mixed["non_probability_sources"] == ["SOCIAL"]


def test_no_interval_for_social_only(spark):
    r = one(index.opinion_index(dims(spark, (61.0, 20.0, "SOCIAL", 200000))))
    assert r["ci_low"] is None and r["ci_high"] is None and r["effective_n"] is None
    assert r["limitations"] == ["NON_PROBABILITY_SHARE", "NO_CI"] and r["non_probability_pct"] == 100


def test_small_sample_is_withheld_with_its_interval(spark):
    r = one(index.publication_gate(index.opinion_index(dims(spark, (70.0, 1.0, "SURVEY", 120)))))
    assert r["insufficient_data"] and r["value"] is None and r["ci_low"] is None
    assert "BELOW_MIN_N" in r["limitations"]


@pytest.mark.parametrize("n", [None, 0])
def test_missing_n_gives_no_interval(spark, n):
    r = one(index.opinion_index(dims(spark, (70.0, 1.0, "SURVEY", n))))
    assert r["ci_low"] is None and r["limitations"] == ["NO_CI"]


@pytest.mark.parametrize(
    "row,code",
    [((140.0, 1.0, "SURVEY", 500), "SCORE_RANGE"), ((50.0, -1.0, "SURVEY", 500), "NEGATIVE_WEIGHT"), ((50.0, 0.0, "SURVEY", 500), "NO_WEIGHT"), ((None, 1.0, "SURVEY", 500), "SCORE_RANGE"), ((50.0, 1.0, "RADIO", 500), "UNKNOWN_SOURCE")],
)
def test_invalid_dimensions(spark, row, code):
    r = one(index.opinion_index(dims(spark, row)))
    assert code in r["violations"] and r["value"] is None
    with pytest.raises(Exception, match=code):
        index.opinion_index(dims(spark, row), strict=True).collect()


def test_kish_n_from_respondent_weights(spark):
    weights = spark.createDataFrame([(1, 1.0)] * 300 + [(1, 3.0)] * 100, "project_id long, weight double")
    r = one(index.opinion_index(dims(spark, *SURVEY3), respondent_weights=weights))
    assert r["effective_n"] == int(600**2 / (300 + 900))
    k = one(index.effective_sample_size(spark.createDataFrame([(1, 0.0)], "project_id long, weight double"), ["project_id"]))
    assert k["kish_n"] == 0


def test_confidence_changes_width_and_unknown_level_uses_default(spark):
    d = dims(spark, *SURVEY3)
    width = lambda c: (lambda r: r["ci_high"] - r["ci_low"])(one(index.opinion_index(d, confidence=c)))
    assert width(0.90) < width(0.95) < width(0.99) and width(0.5) == width(0.95)


def test_change(spark):
    s = spark.createDataFrame(
        [(1, "2024-01-07", 70.0, 68.0, 72.0), (1, "2024-01-14", 69.8, 67.8, 71.8), (1, "2024-01-21", 60.0, 58.0, 62.0),
         (1, "2024-01-28", 60.0, None, None)],
        "project_id long, period_end string, value double, ci_low double, ci_high double",
    )
    out = {r.period_end: r for r in index.index_change(s).collect()}
    assert out["2024-01-14"].delta == -0.2 and not out["2024-01-14"].intervals_separated and out["2024-01-14"].direction == "DOWN"
    assert out["2024-01-21"].intervals_separated
    assert out["2024-01-28"].direction == "EQUAL" and not out["2024-01-28"].intervals_separated
    assert len(out) == 3


def test_latest_dimension_joined_with_project_weights(spark):
    snaps = spark.createDataFrame(
        [(1, "trust", "SURVEY", "2024-01-07", 50.0, 300, None, None), (1, "trust", "SURVEY", "2024-01-14", 60.0, 310, None, None),
         (1, "trust", "SURVEY", "2024-02-14", 10.0, 310, "JB", None), (1, "approval", "SURVEY", "2024-01-14", 40.0, 320, None, None),
         (1, "other", "SURVEY", "2024-01-14", 99.0, 320, None, None)],
        "project_id long, metric string, source string, period_end string, value double, effective_n int, province_code string, segment string",
    )
    projects = spark.createDataFrame([(1, {"trust": 3.0, "approval": 1.0, "sentiment": 5.0, "other": 9.0})], "project_id long, poi_weights map<string,double>")
    d = index.index_dimensions(snaps, projects)
    assert {(r.key, r.score, r.weight) for r in d.collect()} == {("trust", 60.0, 3.0), ("approval", 40.0, 1.0)}
    assert one(index.opinion_index(d))["value"] == 55.0


def test_preview_zero_total(spark):
    out = {r.candidate: r.value for r in index.weighted_index_preview(dims(spark, *SURVEY3), {"a": {"d0": 1.0}, "zero": {}}).collect()}
    assert out == {"a": 74.0, "zero": 0.0}


def test_weight_update(spark):
    projects = spark.createDataFrame([(1, "o", {"trust": 1.0}), (2, "o", {"trust": 1.0})], "project_id long, org_id string, poi_weights map<string,double>")
    updates = spark.createDataFrame([(1, {"trust": 2.0}), (2, {"trust": 0.0}), (9, {"trust": 1.0})], "project_id long, new_weights map<string,double>")
    changed, audit, rejected = index.set_index_weights(projects, updates, "me", F.lit("2024-01-01").cast("timestamp"))
    assert {r.project_id: r.poi_weights for r in changed.collect()} == {1: {"trust": 2.0}, 2: {"trust": 1.0}}
    assert one(audit)["metadata"] == '{"old":{"trust":1.0},"new":{"trust":2.0}}'
    assert {r.project_id: r.violations for r in rejected.collect()} == {2: ["TOTAL_NOT_POSITIVE"], 9: ["UNKNOWN_PROJECT"]}


def test_half_even(spark):
    r = spark.range(1).select(
        half_even(F.lit(0.125), 2).alias("a"), half_even(F.lit(0.5)).alias("b"), half_even(F.lit(1.5)).alias("c"),
        half_even(F.lit(2.5) - 1e-13).alias("noise"),
    ).first()
    assert (r.a, r.b, r.c, r.noise) == (0.12, 0.0, 2.0, 2.0)


def test_weight_updates_that_cannot_be_applied(spark):
    projects = spark.createDataFrame([(1, 9, {"a": 1.0}), (2, 9, {"a": 1.0}), (3, 9, {"a": 1.0})], "project_id long, org_id long, poi_weights map<string,double>")
    updates = spark.createDataFrame(
        [(1, None), (2, {"a": 2.0}), (2, {"a": 3.0}), (3, {"a": 4.0}), (7, {"a": None})], "project_id long, new_weights map<string,double>"
    )
    changed, audit, rejected = index.set_index_weights(projects, updates, "me", F.current_timestamp())
    assert {r.project_id: r.poi_weights for r in changed.collect()} == {1: {"a": 1.0}, 2: {"a": 1.0}, 3: {"a": 4.0}}
    assert [r.entity_id for r in audit.collect()] == ["3"]
    found = sorted((r.project_id, tuple(r.violations)) for r in rejected.collect())
    assert found == [(1, ("MISSING_WEIGHTS",)), (2, ("REPEATED_PROJECT",)), (2, ("REPEATED_PROJECT",)), (7, ("MISSING_WEIGHTS", "UNKNOWN_PROJECT"))]
