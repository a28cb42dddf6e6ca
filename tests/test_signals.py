import datetime as dt
import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from opinionweave.operators import reporting, signals

PEOPLE = "survey_id int, respondent_id int, weight double, province_code string, age_band string"


@pytest.fixture(scope="module")
def survey(spark):
    people = spark.createDataFrame([(1, 1, 1.0, "JB", "y"), (1, 2, 3.0, "JB", None), (1, 3, 1.0, "DK", "y")], PEOPLE)
    answers = spark.createDataFrame(
        [(1, 1, 5.0), (2, 1, 3.0), (3, 1, 1.0), (1, 2, 1.0), (2, 2, 5.0), (3, 2, None), (1, 3, 5.0)],
        "respondent_id int, question_id int, value_num double",
    )
    questions = spark.createDataFrame(
        [(1, "trust", False, 5), (2, "trust", True, 5), (3, None, False, 5)],
        "question_id int, poi_dimension string, reverse_scored boolean, scale_points int",
    )
    return people, answers, questions


def test_item_scores(survey):
    people, answers, questions = survey
    r = signals.item_scores(people, answers, questions).first()
    # person 1: 100, 100; person 2 (weight 3): 50, 0; person 3: 0
    assert r.score == pytest.approx((200 + 3 * 50 + 0) / (2 + 6 + 1)) and r.respondents == 3 and r.answers == 5


def test_snapshots_have_totals_provinces_and_segments(survey):
    people, answers, questions = survey
    rows = signals.produce_snapshots(people, answers, questions).collect()
    got = {(r.province_code, r.segment): r for r in rows}
    assert set(got) == {(None, None), ("JB", None), ("DK", None), (None, "y")}
    assert got[(None, None)].effective_n == int(25 / 11) and got[(None, None)].below_min_n
    assert got[(None, "y")].value == pytest.approx(66.667)


def plain_momentum(rows, days):
    """Windows of every narrative counted day by day."""
    out = {}
    for day in {d for d, _ in rows}:
        now = [n for d, n in rows if day - days < d <= day]
        before = [n for d, n in rows if day - 2 * days < d <= day - days]
        for name in {n for n in now + before if n}:
            share = 100 * now.count(name) / len(now)
            out[day, name] = (round(share, 2), round(share - 100 * before.count(name) / len(before), 2) if before else None)
    return out


def test_momentum_of_sparse_narratives(spark):
    rng = random.Random(2)
    rows = [(d, rng.choice(["A", "B", None, f"rare{d}"])) for d in sorted(rng.choices(range(1, 90), k=150))]
    start = dt.date(2026, 1, 1)
    df = spark.createDataFrame(
        [(1, start + dt.timedelta(days=d), n, 1, 0, None) for d, n in rows], "project_id int, day date, narrative string, n int, media int, sent double"
    ).groupBy("project_id", "day", "narrative").agg(F.sum("n").alias("n"), F.sum("media").alias("media"), F.sum("sent").alias("sent"))
    got = signals.momentum_from_daily(df, ["project_id"], 7).collect()
    want = plain_momentum(rows, 7)
    assert len(got) == len(want) and all(r.sentiment is None for r in got)
    for r in got:
        volume, change = want[(r.day - start).days, r.narrative]
        assert abs(r.volume_pct - volume) < 0.011
        assert (r.momentum_7d is None) == (change is None) and (change is None or abs(r.momentum_7d - change) < 0.011)


def test_momentum(spark):
    def mention(day, narrative, source="SOCIAL"):
        return (1, datetime(2024, 1, day, 12), narrative, source, 0.5)

    rows = [mention(1, "A"), mention(1, "B"), mention(8, "A"), mention(8, "A", "MEDIA"), mention(8, "B"), mention(8, None)]
    df = spark.createDataFrame(rows, "project_id int, published_at timestamp, narrative string, source string, sentiment double")
    got = {(r.day.day, r.narrative): r for r in signals.narrative_momentum(df).collect()}
    a = got[(8, "A")]
    assert (a.volume_pct, a.momentum_7d, a.media_pickup, a.unclustered_pct) == (50.0, 0.0, 1, 25.0)
    assert got[(8, "B")].momentum_7d == -25.0 and got[(1, "A")].momentum_7d is None


def test_issue_labels(spark):
    df = spark.createDataFrame(
        [(1, p, i, n) for p, i, n in [("1", "x", 10), ("1", "y", 90), ("2", "x", 20), ("2", "y", 80), ("3", "x", 20), ("3", "y", 80)]],
        "project_id int, period_end string, issue string, n int",
    )
    got = {(r.period_end, r.issue): (r.share_pct, r.delta_pp, r.momentum) for r in signals.issue_shares(df).collect()}
    assert got[("1", "x")] == (10.0, None, "NEW") and got[("2", "x")] == (20.0, 10.0, "RISING_FAST")
    assert got[("2", "y")][2] == "FALLING" and got[("3", "x")][2] == "STABLE"


def test_diff_in_diff(spark):
    df = spark.createDataFrame(
        [(1, True, True, 10.0), (1, True, False, 4.0), (1, False, True, 5.0), (1, False, False, 3.0)], "project_id int, t boolean, p boolean, y double"
    )
    assert signals.diff_in_diff(df, "t", "p", "y").first().effect == 4.0


def test_crosstab(spark):
    df = spark.createDataFrame([(1, "a", "x")] * 10 + [(1, "b", "y")] * 10, "project_id int, g string, h string").withColumn("weight", F.lit(1.0))
    t = signals.crosstab_test(signals.crosstab(df, "g", "h"), "g", "h").first()
    assert t.chi2 == pytest.approx(20.0) and t.dof == 1 and t.cramers_v == pytest.approx(1.0)


def test_influence_and_emotions(spark):
    df = spark.createDataFrame([(1, "s", "u", 30, {"anger": 0.5}), (1, "s", "v", 10, {"anger": 0.1, "joy": 1.0}), (1, "s", "u", 0, None)],
                               "project_id int, source string, author_hash string, engagement int, emotion map<string,double>")
    top = signals.influence_shares(df, top=1).collect()
    assert [(r.author_hash, r.engagement_share_pct, r.mentions) for r in top] == [("u", 75.0, 2)]
    got = {r.emotion: r.mean_intensity for r in signals.emotion_means(df).collect()}
    assert got == {"anger": pytest.approx(0.3), "joy": 1.0}


def test_mention_stats_ignore_missing_sentiment(spark):
    df = spark.createDataFrame([(1, "s", 1.0, 1), (1, "s", -1.0, 3), (1, "s", None, 100)], "project_id int, source string, sentiment double, engagement int")
    r = signals.mention_stats(df).first()
    assert (r.volume, r.mean_sentiment, r.engagement_sentiment, r.engagement) == (3, 0.0, -0.5, 104)


def test_segment_profile(spark):
    df = spark.createDataFrame([(1, "a", 1.0, 50.0, 10.0), (1, "a", 1.0, None, 30.0), (1, "b", 2.0, 1.0, 1.0), (1, None, 9.0, 1.0, 1.0)],
                               "project_id int, segment string, weight double, sentiment double, trust double")
    got = {r.segment: (r.size_pct, r.sentiment, r.trust) for r in signals.segment_profile(df).collect()}
    assert got == {"a": (50.0, 50.0, 20.0), "b": (50.0, 1.0, 1.0)}


def test_trend_and_timeline(spark):
    snaps = spark.createDataFrame(
        [(1, m, "S", f"2024-01-{d:02d}", float(d), c) for m in ("trust", "poi") for d in range(1, 6) for c in (1, 2)],
        "project_id int, metric string, source string, period_end string, value double, created_at int",
    )
    rows = reporting.trend(snaps, ["trust"], 2).collect()
    assert [r.period_end for r in rows] == ["2024-01-04"] * 2 + ["2024-01-05"] * 2
    wide = reporting.trend_pivot(snaps.withColumn("value", F.col("value") * F.col("created_at")), ["trust", "poi"])
    assert wide.filter("period_end = '2024-01-03'").first().trust == 6.0
    ev = spark.createDataFrame([(1, i, datetime(2024, 1, 1 + i)) for i in range(9)], "project_id int, event_id int, occurred_at timestamp")
    assert [r.event_id for r in reporting.timeline(ev, 3).collect()] == [6, 7, 8]


def test_top_n_beyond_the_pruning_limit(spark):
    from opinionweave.plans.ranking import top_n_per_key

    df = spark.range(5000).withColumn("k", F.lit(1))
    out = top_n_per_key(df, ["k"], [F.col("id").desc()], 1500, spread_by=["id"])
    assert out.count() == 1500 and out.agg(F.min("id")).first()[0] == 3500


def test_latest_is_pruned_before_the_shuffle(spark):
    from opinionweave.plans.ranking import latest_per_key

    df = spark.range(100).withColumn("k", F.col("id") % 3)
    plan = latest_per_key(df, ["k"], [F.col("id").desc()])._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Final") < plan.index("Exchange") < plan.index("Partial")


def test_province_table_and_drops(spark):
    snaps = spark.createDataFrame(
        [(1, p, m, "SURVEY", "2024", v, n) for p, v, n in (("JB", 60.0, 500), ("DK", 70.0, 300), ("NT", 90.0, 100)) for m in ("poi", "trust", "approval")],
        "project_id int, province_code string, metric string, source string, period_end string, value double, effective_n int",
    )
    got = {r.province_code: r for r in reporting.province_table(snaps).collect()}
    assert (got["DK"].rank, got["JB"].rank, got["NT"].rank) == (1, 2, 3)
    assert got["NT"].poi is None and got["NT"].margin is None and got["NT"].insufficient_data
    assert got["JB"].confidence_label == "HIGH" and got["DK"].confidence_label == "MEDIUM"
    deltas = spark.createDataFrame([(1, "a", -1.0), (1, "b", -3.0), (1, "c", 2.0), (1, "d", -3.0)], "project_id int, item string, delta double")
    assert [r.item for r in reporting.largest_drops(deltas, ["project_id"], "item", "delta", 2).orderBy("rank").collect()] == ["b", "d"]


def test_alerts(spark):
    facts = spark.createDataFrame([(1, 14.0, -2.0, 0.0, 192, 0.79), (2, None, None, None, None, None)],
                                  "project_id int, narrative_momentum double, trust_delta double, approval_delta double, low_quality_count int, sample_coverage double")
    got = reporting.alerts(facts).collect()
    assert {(r.project_id, r.alert) for r in got} == {
        (1, a) for a in ("NARRATIVE_MOMENTUM", "TRUST_DOWN_APPROVAL_FLAT", "LOW_QUALITY_RESPONSES", "SAMPLE_BELOW_TARGET")
    }
