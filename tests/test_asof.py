"""As-of join and stored pages against plain versions."""

import random

import pytest

from opinionweave.plans.asof import asof_join
from opinionweave.sources import tables

EVENTS, SERIES = "k int, at timestamp, id int", "k int, at timestamp, v int, w int"


def stamp(i):
    return None if i is None else f"2026-01-01 00:{i // 60:02d}:{i % 60:02d}"


@pytest.mark.parametrize("rows_per_slice", [7, 500_000])
def test_asof_with_a_hot_key(spark, rows_per_slice):
    rng = random.Random(rows_per_slice)
    events = [(rng.choice([1, 1, 1, 2, 3, None]), rng.choice([None, *range(0, 600, 3)]), i) for i in range(300)]
    events += [(1, 300, 1000 + i) for i in range(100)]
    series = [(rng.choice([1, 2, None]), rng.choice([None, *range(100, 600, 7)]), rng.choice([None, 1, 2]), i) for i in range(60)]
    left = spark.createDataFrame([], EVENTS).union(spark.createDataFrame([(k, stamp(t), i) for k, t, i in events], "k int, at string, id int").selectExpr("k", "cast(at as timestamp)", "id"))
    right = spark.createDataFrame([(k, stamp(t), v, w) for k, t, v, w in series], "k int, at string, v int, w int").selectExpr("k", "cast(at as timestamp) at", "v", "w")
    got = {r["id"]: (r["v"], r["w"]) for r in asof_join(left, right, ["k"], "at", "at", ["v", "w"], rows_per_slice).collect()}
    want = {}
    for k, t, i in events:
        able = [(u, (v is not None, v or 0), w, v) for j, u, v, w in series if None not in (k, t, u) and j == k and u <= t]
        want[i] = (max(able)[3], max(able)[2]) if able else (None, None)
    assert got == want


def test_asof_of_empty_tables(spark):
    left, right = spark.createDataFrame([(1, None, 5)], EVENTS), spark.createDataFrame([], SERIES)
    assert [tuple(r) for r in asof_join(left, right, ["k"], "at", "at", ["v"]).collect()] == [(1, None, 5, None)]
    assert asof_join(left.limit(0), right, ["k"], "at", "at", ["v"]).collect() == []
    with pytest.raises(ValueError):
        asof_join(left, right, ["k"], "at", "at", ["id"])


def test_stored_pages(spark, tmp_path):
    rng = random.Random(1)
    df = spark.createDataFrame([(i, stamp(rng.choice([None, *range(40)]))) for i in range(500)], "id int, at string").selectExpr("id", "cast(at as timestamp) completed_at")
    path = str(tmp_path / "pages")
    tables.write_pages(df, path, rows_per_slice=20)
    for limit, offset in [(10, 0), (60, 135), (1, 499), (10, 495), (5, 500), (5, 9000), (0, 3)]:
        want = tables.page(df, limit, offset).collect()
        assert [r["id"] for r in tables.read_page(spark, path, limit, offset).collect()] == [r["id"] for r in want]
    one = tables.read_page(spark, path, 3, 100)
    assert "_slice" in one._jdf.queryExecution().executedPlan().toString()
    tables.write_pages(df.limit(0), str(tmp_path / "none"))
    assert tables.read_page(spark, str(tmp_path / "none"), 5, 0).collect() == []


def test_questions_in_order(spark):
    rows = spark.createDataFrame([(1, "c", 2), (1, "a", 3), (1, "b", 2), (2, "z", 1), (1, "n", None)], "survey_id int, question_id string, position int")
    assert [r["question_id"] for r in tables.ordered_questions(rows).collect()] == ["n", "b", "c", "a", "z"]
