from datetime import date

import pytest
from pyspark.sql import functions as F

from opinionweave.operators import integrity as it
from opinionweave.sources import tables
from opinionweave.sources.schemas import NATURAL_KEYS, SCHEMAS
from opinionweave.sources.sinks import append, overwrite_partitions, replace_columns


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("store"))
    rows = [("p1", "A", "one"), ("p2", "A", "two"), ("p3", "B", "three"), ("p4", None, "lost")]
    df = spark.createDataFrame(rows, "id string, org_id string, name string")
    df.withColumn("created_at", F.lit("2024-01-01").cast("timestamp")).write.parquet(f"{root}/projects")
    return root


def test_tenant_sees_only_own_rows(spark, store):
    names = lambda org: {r.name for r in tables.Tables(spark, store, org).load("projects").collect()}
    assert names("A") == {"one", "two"} and names("B") == {"three"} and names(None) == set()
    assert not names("A") & names("B")
    assert tables.Tables(spark, store, "A").load("projects", name="two").count() == 1
    assert [r.id for r in tables.Tables(spark, store, "A").newest_first("projects").collect()] == ["p1", "p2"]


def test_foreign_write_is_rejected(spark):
    df = spark.createDataFrame([("A", 1), ("B", 2), (None, 3)], "org_id string, x int")
    own, foreign = tables.split_foreign_writes(df, "A")
    assert [r.x for r in own.collect()] == [1] and {r.x for r in foreign.collect()} == {2, 3}
    assert tables.split_foreign_writes(df, None)[0].count() == 0
    with pytest.raises(Exception, match="another tenant"):
        tables.split_foreign_writes(df, "A", strict=True)[0].collect()


def test_schemas_are_valid(spark):
    for name, ddl in SCHEMAS.items():
        fields = set(spark.createDataFrame([], ddl).columns)
        assert set(NATURAL_KEYS.get(name, ())) <= fields


def test_rules(spark):
    df = spark.createDataFrame(
        [("c", "t", 0, "LIKERT"), (None, "t", -1, "POEM"), ("c", None, 1, None)], "code string, text string, position int, type string"
    )
    got = [r.violations for r in it.violations(df, it.rules_for("questions")).collect()]
    assert got == [[], ["CODE_MISSING", "POSITION_RANGE", "TYPE_UNKNOWN"], ["TEXT_MISSING", "TYPE_MISSING"]]
    good, bad = it.split_valid(df, it.rules_for("questions"))
    assert good.count() == 1 and bad.count() == 2
    req = spark.createDataFrame([(0, 3.0), (100, 11.0)], "max_iterations int, trim_ratio double")
    assert [r.violations for r in it.violations(req, it.rules_for("raking_requests")).collect()] == [["MAX_ITERATIONS_RANGE"], ["TRIM_RATIO_RANGE"]]


def test_keep_first_with_null_keys(spark):
    df = spark.createDataFrame([(1, "a", 1), (2, "a", 0), (3, None, 5), (4, None, 4)], "id int, k string, t int")
    kept, rest = it.keep_first(df, ["k"], [F.col("t")], ["id"])
    assert {r.id for r in kept.collect()} == {2, 4} and {r.id for r in rest.collect()} == {1, 3}


def test_references(spark):
    child = spark.createDataFrame([(1, "a"), (2, "x"), (3, None)], "id int, parent string")
    parent = spark.createDataFrame([("a",), ("b",)], "id string")
    assert [r.id for r in it.orphans(child, "parent", parent).collect()] == [2]
    assert {r.id for r in it.cascade_delete(child, "parent", parent).collect()} == {2, 3}


def test_updates(spark):
    base = spark.createDataFrame([(1, "a", 1), (2, "b", 2)], "id int, name string, n int")
    patch = spark.createDataFrame([(1, None, 9)], "id int, name string, n int")
    assert {tuple(r) for r in it.partial_update(base, patch, ["id"]).collect()} == {(1, "a", 9), (2, "b", 2)}
    assert {tuple(r) for r in replace_columns(base, patch.select("id", "name"), ["id"]).collect()} == {(1, None, 1), (2, "b", 2)}
    assert it.upsert(base, spark.createDataFrame([(2, "z", 0), (3, "c", 3)], base.schema), ["id"]).count() == 3


def test_audit_actions(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "k int, name string")
    new = spark.createDataFrame([(1, "a"), (2, "z"), (4, "d")], "k int, name string")
    rows = it.audit_changes(old, new, ["k"], ["name"], "t", "me", F.lit("2024-01-01").cast("timestamp")).collect()
    assert {(r.k, r.action) for r in rows} == {(2, "t:update"), (3, "t:delete"), (4, "t:insert")}
    assert {r.metadata for r in rows if r.k == 2} == {'{"old":{"name":"b"},"new":{"name":"z"}}'}


def test_retention_and_identities(spark):
    df = spark.createDataFrame([(1, "o", date(2024, 1, 1), "x@y"), (2, "o", date(2022, 1, 1), None)], "respondent_id int, org_id string, d date, mail string")
    now = F.lit("2024-02-01").cast("timestamp")
    assert [r.respondent_id for r in it.retain(df, "d", now).collect()] == [1]
    orgs = spark.createDataFrame([("o", 10)], "id string, retention_days int")
    assert it.retain_by_tenant(df, orgs, "d", now).count() == 0
    people, ids = it.split_identities(df, "mail", "s", F.lit("2024-03-01").cast("date"))
    assert "mail" not in people.columns and ids.count() == 1 and len(ids.first().contact_hash) == 64
    assert it.purge_identities(ids, F.lit("2024-03-02").cast("date")).count() == 0
    hashed = it.pseudonymise(df, "mail", "s")
    assert "mail" not in hashed.columns and hashed.filter("author_hash is null").count() == 1


def test_sinks(spark, tmp_path):
    path = str(tmp_path / "t")
    append(spark.createDataFrame([("A", 1), ("B", 2)], "org_id string, x int"), path)
    append(spark.createDataFrame([("A", 3)], "org_id string, x int"), path)
    assert spark.read.parquet(path).count() == 3
    overwrite_partitions(spark.createDataFrame([("A", 9)], "org_id string, x int"), path)
    assert {(r.org_id, r.x) for r in spark.read.parquet(path).collect()} == {("A", 9), ("B", 2)}


def test_page_puts_missing_times_first(spark):
    df = spark.createDataFrame([(1, "2024-01-01"), (2, None), (3, "2024-02-01")], "id int, completed_at string")
    assert [r.id for r in tables.page(df, 2).collect()] == [2, 3]
    assert [r.id for r in tables.page(df, 2, 2).collect()] == [1]


def test_repeated_keys_are_held_back(spark):
    from opinionweave.sources import sinks

    base = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "id long, x string")
    new = spark.createDataFrame([(1, "A"), (2, "B"), (2, "BB"), (4, "D")], "id long, x string")
    pairs = lambda df: sorted(map(tuple, df.collect()))
    assert pairs(it.upsert(base, new, ["id"])) == [(1, "A"), (2, "b"), (3, "c"), (4, "D")]
    assert pairs(it.partial_update(base, new, ["id"])) == [(1, "A"), (2, "b"), (3, "c")]
    assert pairs(sinks.replace_columns(base, new, ["id"])) == [(1, "A"), (2, "b"), (3, "c")]
    assert pairs(sinks.repeated_keys(new, ["id"])) == [(2, "B", "REPEATED_KEY"), (2, "BB", "REPEATED_KEY")]
