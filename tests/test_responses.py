import random
from datetime import datetime, timedelta
from statistics import median

import pytest
from pyspark.sql import functions as F

from opinionweave.operators import responses
from opinionweave.operators.responses import dataset_quality
from opinionweave.plans.quantiles import median_of_integers, weighted_median
from opinionweave.plans.ranking import group_rank


def score(spark, duration, med, answers, traps=(), **kw):
    people = spark.createDataFrame([(1, 7, duration)], "survey_id int, respondent_id int, duration_sec int")
    resp = spark.createDataFrame(
        [(7, q, float(a)) for q, a in enumerate(answers)] or [(8, 0, 1.0)], "respondent_id int, question_id int, value_num double"
    )
    meds = spark.createDataFrame([(1, float(med))], "survey_id int, median_duration_sec double")
    r = responses.response_quality(people, resp, trap_pairs=traps, medians=meds, **kw).first()
    return r.quality_score, r.quality_flags, r.reasons


def test_score_ladder(spark):
    assert score(spark, 50, 300, [1, 2, 3]) == (70, ["SPEEDING"], ["SPEEDING"])
    assert score(spark, 50, 0, [1, 2, 3])[0] == 100
    assert score(spark, 300, 300, [3] * 6)[:2] == (65, ["STRAIGHT_LINING"])
    assert score(spark, 300, 300, [3] * 9 + [3.5]) == (90, [], ["LOW_VARIATION"])
    assert score(spark, 300, 300, [1] * 5)[:2] == (100, [])
    assert score(spark, 300, 300, [2, 4], [(0, 1)])[0] == 100
    assert score(spark, 300, 300, [5, 5], [(0, 1)])[:2] == (80, ["INCONSISTENT"])
    assert score(spark, 300, 300, [5, 5, 5, 5], [(0, 1), (2, 3)])[0] == 80
    assert score(spark, 50, 300, [5] * 6, [(0, 1)]) == (
        15, ["SPEEDING", "STRAIGHT_LINING", "INCONSISTENT"], ["SPEEDING", "STRAIGHT_LINING", "INCONSISTENT"]
    )


def test_missing_duration_counts_as_zero_or_is_skipped(spark):
    assert score(spark, None, 300, [1])[1] == ["SPEEDING"]
    assert score(spark, None, 300, [1], null_duration="skip")[1] == []


def test_item_types(spark):
    people = spark.createDataFrame([(1, 7, 100)], "survey_id int, respondent_id int, duration_sec int")
    resp = spark.createDataFrame([(7, q, 3.0) for q in range(6)], "respondent_id int, question_id int, value_num double")
    types = spark.createDataFrame([(q, "LIKERT" if q else "OPEN") for q in range(6)], "question_id int, type string")
    assert responses.response_quality(people, resp).first().quality_flags == ["STRAIGHT_LINING"]
    assert responses.response_quality(people, resp, types, ["LIKERT"]).first().quality_flags == []


def people_of(spark, seed=3, n=400):
    rnd = random.Random(seed)
    start = datetime(2024, 1, 1)
    data = []
    for i in range(n):
        survey = 1 if rnd.random() < 0.7 else 2
        value = None if rnd.random() < 0.1 else rnd.randint(-5, 40) * (100_000 if rnd.random() < 0.1 else 1)
        data.append((survey, i, start + timedelta(seconds=rnd.randint(0, 50)), value))
    return data, spark.createDataFrame(data, "survey_id int, respondent_id int, completed_at timestamp, duration_sec int")


@pytest.mark.parametrize("per_slice", [500_000, 13])
def test_running_median(spark, per_slice):
    data, df = people_of(spark)
    got = {
        r.respondent_id: r.running_median_sec
        for r in responses.running_median(df, rows_per_slice=per_slice).collect()
    }
    for survey in (1, 2):
        seen = []
        for _, i, _, value in sorted((d for d in data if d[0] == survey), key=lambda d: (d[2], d[1])):
            if value is not None:
                seen.append(value)
            assert got[i] == (median(seen) if seen else None)


def test_running_median_with_missing_times(spark):
    data = [(1, 1, None, 9), (1, 2, datetime(2024, 1, 1), 1), (1, 3, None, 5), (1, 4, datetime(2023, 1, 1), 2)]
    df = spark.createDataFrame(data, "survey_id int, respondent_id int, completed_at timestamp, duration_sec int")
    for size in (1, 100):
        got = {r.respondent_id: r.running_median_sec for r in responses.running_median(df, rows_per_slice=size).collect()}
        assert got == {1: 9.0, 3: 7.0, 4: 5.0, 2: 3.5}


def test_medians_of_large_groups(spark):
    data, df = people_of(spark, 9)
    got = {r.survey_id: r.median for r in median_of_integers(df, ["survey_id"], "duration_sec").collect()}
    also = {r.survey_id: r.median for r in weighted_median(df, ["survey_id"], "duration_sec", F.lit(1)).collect()}
    want = {s: median(d[3] for d in data if d[0] == s and d[3] is not None) for s in (1, 2)}
    assert got == want and also == want


def test_rank_over_slices(spark):
    data, df = people_of(spark, 4)
    got = {r.respondent_id: r.rk for r in group_rank(df, ["survey_id"], ["completed_at", "respondent_id"], "rk", 11).collect()}
    for survey in (1, 2):
        order = sorted((d for d in data if d[0] == survey), key=lambda d: (d[2], d[1]))
        assert [got[d[1]] for d in order] == list(range(1, len(order) + 1))


def test_rank_keeps_null_groups(spark):
    df = spark.createDataFrame([(None, 1), (None, 2), ("a", 3)], "k string, t int")
    assert {(r.k, r.rk) for r in group_rank(df, ["k"], ["t"], "rk").collect()} == {(None, 1), (None, 2), ("a", 1)}


def quality(spark, total, complete, dup=0, flagged=0, incons=0, dev=0.0, meta=1.0):
    df = spark.createDataFrame(
        [(total, complete, dup, flagged, incons, dev, meta)],
        "total long, complete long, duplicates long, flagged long, inconsistent long, max_stratum_deviation_pp double, metadata_fields_filled double",
    )
    return dataset_quality(df).first()


def test_dataset_quality(spark):
    assert quality(spark, 100, 100).overall == 100
    empty = quality(spark, 0, 0)
    assert empty.completeness == 0 and empty.duplicate == 100
    assert quality(spark, 100, 100, dev=25.0).sample_balance == 0
    assert quality(spark, 100, 100, dev=20.0).overall < quality(spark, 100, 100, meta=0.0).overall


def test_duplicates_and_quota(spark):
    people = spark.createDataFrame(
        [(1, i, datetime(2024, 1, 1 + i), "a" if i < 4 else "b") for i in range(6)],
        "survey_id int, respondent_id int, completed_at timestamp, age_band string",
    )
    vectors = {0: (1, 2), 1: (1, 2), 2: (2, 1), 3: (1, 2), 4: (1, 1), 5: (9, 9)}
    resp = spark.createDataFrame(
        [(i, q, float(v)) for i, vs in vectors.items() for q, v in enumerate(vs)], "respondent_id int, question_id int, value_num double"
    )
    out = {r.respondent_id: r.copies for r in responses.duplicate_suspects(people, resp).collect()}
    assert out == {0: 3, 1: 3, 3: 3}
    texts = {0: "x", 1: "y", 2: "x", 3: "x", 4: None, 5: None}
    spoken = resp.withColumn("value_text", F.when(F.col("question_id") == 1, F.create_map(*[F.lit(k) for kv in texts.items() for k in kv])[F.col("respondent_id")]))
    assert {r.respondent_id: r.copies for r in responses.duplicate_suspects(people, spoken).collect()} == {0: 2, 3: 2}
    quotas = spark.createDataFrame([(1, "a", 3), (1, "b", 5)], "survey_id int, age_band string, quota int")
    late = responses.out_of_quota(people, quotas, "age_band").collect()
    assert [r.respondent_id for r in late] == [3]


def test_ingest_batch(spark):
    schema = (
        "org_id string, survey_id string, completed_at timestamp, respondent struct<anon_code:string,age_band:string,gender:string,"
        "education:string,occupation:string,province_code:string,urbanicity:string,duration_sec:int>, "
        "answers array<struct<question_id:string,value_num:double,value_text:string,value_json:string>>"
    )

    def doc(code, day, duration, answers):
        who = (code, None, None, None, None, None, None, duration)
        return ("o", "s", datetime(2024, 1, day), who, [(q, v, None, None) for q, v in answers])

    docs = spark.createDataFrame(
        [doc("a", 1, 300, [("q1", 1.0), ("q2", 2.0), ("q1", 5.0)]), doc("a", 2, 10, [("q1", 4.0)]),
         doc("b", 1, 50, [(f"q{i}", 3.0) for i in range(6)]), doc("c", 1, 400, [])],
        schema,
    )
    out = responses.ingest_batch(docs)
    people = {r.anon_code: r for r in out["respondents"].collect()}
    assert set(people) == {"a", "b", "c"} and people["a"].duration_sec == 300
    assert people["b"].quality_flags == ["SPEEDING", "STRAIGHT_LINING"] and people["b"].quality_score == 35
    assert out["responses"].count() == 8
    assert [r.anon_code for r in out["rejected_documents"].collect()] == ["a"]
    assert [r.value_num for r in out["rejected_responses"].collect()] == [5.0]
    again = responses.ingest_batch(docs, out["respondents"].filter("anon_code <> 'b'"))
    assert [r.anon_code for r in again["respondents"].collect()] == ["b"]
    assert again["rejected_documents"].count() == 3
