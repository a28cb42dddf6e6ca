"""Tenant scope, constraints, bulk changes, retention and paging queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import constants as C
from ..functions.scalars import map_total
from ..operators import index, integrity as it
from ..plans.lineage import fresh_path
from ..sources import tables
from ..sources.ingest import split_documents
from ..sources.sinks import append, replace_columns, wire_json
from ..sources.views import Views
from .base_sql import joined, with_views
from .registry import query
from .stream_queries import respondent_documents


@query("tenant_scope", with_views("respondents") + " SELECT survey_id, count(*) AS n FROM respondents WHERE project_id = 1 GROUP BY 1")
def tenant_scope(v: Views) -> DataFrame:
    return tables.scoped(v.respondents(), 1, "project_id").groupBy("survey_id").agg(F.count(F.lit(1)).alias("n"))


@query(
    "tenant_no_context",
    with_views("respondents") + " SELECT 'tenant 1' AS context, count(*) AS n FROM respondents WHERE project_id = 1 UNION ALL SELECT 'none', 0",
)
def tenant_no_context(v: Views) -> DataFrame:
    seen = lambda tenant, name: tables.scoped(v.respondents(), tenant, "project_id").agg(
        F.lit(name).alias("context"), F.count(F.lit(1)).alias("n")
    )
    return seen(1, "tenant 1").unionByName(seen(None, "none"))


@query(
    "tenant_write_check",
    with_views("respondents") + """ SELECT CASE WHEN project_id = 1 THEN 'ACCEPTED' ELSE 'FOREIGN_TENANT' END AS outcome, project_id, count(*) AS n FROM respondents GROUP BY 1, 2""",
)
def tenant_write_check(v: Views) -> DataFrame:
    own, foreign = tables.split_foreign_writes(v.respondents().select("project_id"), 1, "project_id")
    return own.withColumn("violation", F.lit("ACCEPTED")).unionByName(foreign).groupBy(
        F.col("violation").alias("outcome"), "project_id"
    ).agg(F.count(F.lit(1)).alias("n"))


@query(
    "national_rows",
    with_views("respondents") + """ SELECT survey_id, count(*) AS n FROM respondents GROUP BY 1""",
)
def national_rows(v: Views) -> DataFrame:
    sets = v.respondents().groupingSets(
        [[F.col("survey_id")], [F.col("survey_id"), F.col("province_code")]], "survey_id", "province_code"
    ).agg(F.count(F.lit(1)).alias("n")).withColumn("segment", F.lit(None).cast("string"))
    return tables.national(sets).select("survey_id", "n")


@query(
    "respondents_page",
    with_views("respondents") + " SELECT respondent_id, completed_at FROM respondents ORDER BY completed_at DESC NULLS FIRST, respondent_id LIMIT 100 OFFSET 200",
)
def respondents_page(v: Views) -> DataFrame:
    return tables.page(v.respondents().select("respondent_id", "completed_at"), 100, 200, row_id="respondent_id")


@query(
    "respondents_deep_page",
    with_views("respondents") + " SELECT respondent_id, completed_at FROM respondents ORDER BY completed_at DESC NULLS FIRST, respondent_id LIMIT 100 OFFSET 900",
)
def respondents_deep_page(v: Views) -> DataFrame:
    path = fresh_path(v.spark, "pages")
    tables.write_pages(v.respondents().select("respondent_id", "completed_at"), path, row_id="respondent_id")
    return tables.read_page(v.spark, path, 100, 900, row_id="respondent_id")


# positions run against the ids, so that the order is not that of the ids
@query(
    "questions_in_order",
    with_views("respondents", "responses") + """ SELECT survey_id, CAST(row_number() OVER (PARTITION BY survey_id ORDER BY 9 - question_id, question_id) AS INTEGER) AS place,
      CAST(question_id AS INTEGER) AS question_id, count(*) AS answers FROM responses JOIN respondents USING (respondent_id) GROUP BY survey_id, question_id""",
)
def questions_in_order(v: Views) -> DataFrame:
    asked = v.responses().join(v.respondents().select("respondent_id", "survey_id"), "respondent_id").groupBy("survey_id", "question_id").agg(
        F.count("*").alias("answers")
    )
    listed = tables.ordered_questions(asked.withColumn("position", 9 - F.col("question_id")))
    place = F.row_number().over(W.partitionBy("survey_id").orderBy("position", "question_id"))
    return listed.select("survey_id", place.alias("place"), "question_id", "answers")


@query(
    "newest_first",
    with_views("mentions") + " SELECT event_id, published_at FROM mentions WHERE source = 'SOCIAL' AND narrative IN ('A', 'B') ORDER BY published_at DESC, event_id LIMIT 50",
)
def newest_first(v: Views) -> DataFrame:
    rows = tables.where_in(tables.where_equal(v.mentions(), source="SOCIAL", project_id=None), "narrative", ["A", "B"])
    listed = rows.orderBy(F.col("published_at").desc(), F.col("event_id")).limit(50)
    return listed.select("event_id", F.col("published_at").cast("timestamp_ntz").alias("published_at"))


@query(
    "constraint_violations",
    f"""SELECT c_custkey, {joined(('C_ACCTBAL_RANGE', 'c_acctbal < 0 OR c_acctbal > 9000'), ('C_MKTSEGMENT_UNKNOWN', "c_mktsegment NOT IN ('AUTOMOBILE', 'BUILDING')"), ('C_NAME_FORMAT', "NOT (regexp_full_match(lower(c_name), '[a-z0-9\\-]+') AND length(c_name) BETWEEN 2 AND 60)"))} AS violations FROM customer""",
)
def constraint_violations(v: Views) -> DataFrame:
    segment = ("C_MKTSEGMENT_UNKNOWN", ~F.col("c_mktsegment").isin("AUTOMOBILE", "BUILDING"))
    lowered = v.raw("customer").withColumn("c_name", F.lower("c_name"))
    marked = it.violations(lowered, [it.in_range("c_acctbal", 0, 9000), segment, it.slug("c_name")])
    return marked.select("c_custkey", F.array_join("violations", ",").alias("violations"))


@query(
    "table_rule_counts",
    with_views("mentions") + """, d AS (SELECT 'TEXT_MISSING' AS violation FROM mentions WHERE narrative IS NULL UNION ALL SELECT 'SOURCE_UNKNOWN' FROM mentions WHERE source NOT IN ('SURVEY', 'SOCIAL', 'MEDIA', 'DIGITAL')
        UNION ALL SELECT 'SENTIMENT_RANGE' FROM mentions WHERE sentiment < -1 OR sentiment > 1)
    SELECT violation, count(*) AS n FROM d GROUP BY 1""",
)
def table_rule_counts(v: Views) -> DataFrame:
    rows = v.mentions().withColumnRenamed("narrative", "text")
    _, bad = it.split_valid(rows, it.rules_for("mentions"))
    return bad.select(F.explode("violations").alias("violation")).groupBy("violation").agg(F.count(F.lit(1)).alias("n"))


@query("duplicate_keys", "SELECT l_orderkey, l_linenumber, count(*) AS copies FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def duplicate_keys(v: Views) -> DataFrame:
    return it.duplicate_keys(v.raw("lineitem"), ["l_orderkey", "l_linenumber"])


@query(
    "keep_first_mention",
    with_views("mentions") + """, r AS (SELECT *, row_number() OVER (PARTITION BY external_id ORDER BY published_at, event_id) AS rn FROM mentions)
    SELECT event_id, external_id, CASE WHEN rn = 1 THEN 'KEPT' ELSE 'REJECTED' END AS outcome FROM r""",
)
def keep_first_mention(v: Views) -> DataFrame:
    kept, others = it.keep_first(
        v.mentions(), ["external_id"], [F.col("published_at"), F.col("event_id")], ["event_id"]
    )
    mark = lambda df, x: df.select("event_id", "external_id", F.lit(x).alias("outcome"))
    return mark(kept, "KEPT").unionByName(mark(others, "REJECTED"))


@query(
    "orphan_rows",
    with_views("responses") + " SELECT respondent_id, question_id FROM responses WHERE respondent_id % 50 = 0",
)
def orphan_rows(v: Views) -> DataFrame:
    parents = v.respondents().filter(F.col("respondent_id") % 50 != 0)
    return it.orphans(v.responses(), "respondent_id", parents, "respondent_id").select("respondent_id", "question_id")


@query(
    "cascade_delete",
    with_views("responses", "respondents") + " SELECT respondent_id, count(*) AS n FROM responses WHERE respondent_id NOT IN (SELECT respondent_id FROM respondents WHERE duration_sec < 100) GROUP BY 1",
)
def cascade_delete(v: Views) -> DataFrame:
    gone = v.respondents().filter(F.col("duration_sec") < 100)
    left = it.cascade_delete(v.responses(), "respondent_id", gone, "respondent_id")
    return left.groupBy("respondent_id").agg(F.count(F.lit(1)).alias("n"))


def _patch(v: Views) -> DataFrame:
    return v.raw("supplier").select(
        F.col("s_suppkey").alias("c_custkey"), F.when(F.col("s_acctbal") > 0, F.col("s_acctbal")).alias("c_acctbal"),
        F.when(F.col("s_nationkey") % 2 == 0, "PATCHED").alias("c_mktsegment"),
    )


@query(
    "partial_update",
    """SELECT c_custkey, c_name, coalesce(CASE WHEN s_acctbal > 0 THEN s_acctbal END, c_acctbal) AS c_acctbal,
      coalesce(CASE WHEN s_nationkey % 2 = 0 THEN 'PATCHED' END, c_mktsegment) AS c_mktsegment FROM customer LEFT JOIN supplier ON s_suppkey = c_custkey""",
)
def partial_update(v: Views) -> DataFrame:
    base = v.raw("customer").select("c_custkey", "c_name", "c_acctbal", "c_mktsegment")
    return it.partial_update(base, _patch(v), ["c_custkey"])


@query(
    "upsert",
    """WITH ch AS (SELECT s_suppkey*30 AS c_custkey, s_name AS c_name FROM supplier)
    SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT c_custkey FROM ch) UNION ALL SELECT c_custkey, c_name FROM ch""",
)
def upsert(v: Views) -> DataFrame:
    changes = v.raw("supplier").select((F.col("s_suppkey") * 30).alias("c_custkey"), F.col("s_name").alias("c_name"))
    return it.upsert(v.raw("customer").select("c_custkey", "c_name"), changes, ["c_custkey"])


@query(
    "replace_columns",
    with_views("respondents") + " SELECT respondent_id, CASE WHEN gender = 'F' THEN CAST(2 AS DOUBLE) ELSE weight END AS weight FROM respondents",
)
def replace_weights(v: Views) -> DataFrame:
    base = v.respondents().select("respondent_id", "gender", "weight")
    new = base.filter(F.col("gender") == "F").select("respondent_id", F.lit(2.0).alias("weight"))
    return replace_columns(base, new, ["respondent_id"]).select("respondent_id", "weight")


@query(
    "audit_changes",
    """WITH n AS (SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN 'MOVED' ELSE c_mktsegment END AS seg FROM customer WHERE c_custkey % 11 <> 0
        UNION ALL SELECT s_suppkey + 1000000000, s_name FROM supplier)
    SELECT coalesce(o.c_custkey, n.c_custkey) AS c_custkey, 'customers:' || CASE WHEN o.c_custkey IS NULL THEN 'insert' WHEN n.c_custkey IS NULL THEN 'delete' ELSE 'update' END AS action
    FROM customer o FULL JOIN n ON o.c_custkey = n.c_custkey WHERE o.c_mktsegment IS DISTINCT FROM n.seg""",
)
def audit_changes(v: Views) -> DataFrame:
    old = v.raw("customer").select("c_custkey", "c_mktsegment")
    moved = F.when(F.col("c_custkey") % 7 == 0, "MOVED").otherwise(F.col("c_mktsegment"))
    new = old.filter(F.col("c_custkey") % 11 != 0).withColumn("c_mktsegment", moved).unionByName(
        v.raw("supplier").select((F.col("s_suppkey") + 1000000000).alias("c_custkey"), F.col("s_name").alias("c_mktsegment"))
    )
    at = F.lit("2024-02-01").cast("timestamp")
    return it.audit_changes(old, new, ["c_custkey"], ["c_mktsegment"], "customers", "job", at).select("c_custkey", "action")


@query(
    "weight_update_audit",
    with_views("ev") + """, nw AS (SELECT project_id, CAST(count(*) AS DOUBLE) AS t FROM ev WHERE project_id <> 3 GROUP BY 1)
    SELECT CAST(r_regionkey AS BIGINT) AS project_id, coalesce(t, CAST(100 AS DOUBLE)) AS weight_total, CASE WHEN t IS NULL THEN 'TOTAL_NOT_POSITIVE' ELSE 'poi_weights:update' END AS outcome FROM region LEFT JOIN nw ON project_id = r_regionkey
    UNION ALL SELECT 5, CAST(NULL AS DOUBLE), 'UNKNOWN_PROJECT'""",
)
def weight_update_audit(v: Views) -> DataFrame:
    """New weights are the event counts per dimension; project 3 gets zeros, project 5 does not exist."""
    projects = v.raw("region").select(
        F.col("r_regionkey").cast("long").alias("project_id"), F.col("r_regionkey").alias("org_id"),
        index.literal_map(C.DEFAULT_INDEX_WEIGHTS).alias("poi_weights"),
    )
    counts = v.events().groupBy("project_id", v.metric_of(F.col("event_type")).alias("metric")).agg(
        F.count(F.lit(1)).cast("double").alias("w")
    )
    updates = counts.groupBy("project_id").agg(
        F.map_from_entries(
            F.collect_list(F.struct("metric", F.when(F.col("project_id") == 3, 0.0).otherwise(F.col("w"))))
        ).alias("new_weights")
    )
    stranger = updates.filter(F.col("project_id") == 0).withColumn("project_id", F.lit(5).cast("long"))
    changed, audit, rejected = index.set_index_weights(
        projects, updates.unionByName(stranger), "analyst", F.lit("2024-02-01").cast("timestamp")
    )
    outcomes = audit.select(F.col("entity_id").cast("long").alias("project_id"), F.col("action").alias("outcome")).unionByName(
        rejected.select("project_id", F.array_join("violations", ",").alias("outcome"))
    )
    totals = changed.select("project_id", map_total(F.col("poi_weights")).alias("weight_total"))
    return outcomes.join(totals, "project_id", "left").select("project_id", "weight_total", "outcome")


@query(
    "retention_purge",
    with_views("mentions") + """ SELECT project_id, count(*) AS n FROM mentions WHERE published_at >= CAST(DATE '2024-01-31' - CAST(5 + 5*project_id AS INTEGER) AS TIMESTAMP) GROUP BY 1""",
)
def retention_purge(v: Views) -> DataFrame:
    orgs = v.raw("region").select(
        F.col("r_regionkey").cast("long").alias("id"), (5 + 5 * F.col("r_regionkey")).cast("int").alias("retention_days")
    )
    rows = v.mentions().withColumn("org_id", F.col("project_id"))
    kept = it.retain_by_tenant(rows, orgs, "published_at", F.lit("2024-01-31").cast("timestamp"))
    return kept.groupBy("project_id").agg(F.count(F.lit(1)).alias("n"))


@query("pseudonymise", with_views("mentions") + " SELECT event_id, sha256('salt-1' || author) AS author_hash FROM mentions")
def pseudonymise(v: Views) -> DataFrame:
    return it.pseudonymise(v.mentions().select("event_id", "author"), "author", "salt-1")


@query(
    "identity_split",
    """SELECT c_custkey AS respondent_id, sha256('salt-2' || c_name) AS contact_hash, CAST(DATE '2024-01-01' + CAST(c_custkey % 60 AS INTEGER) AS DATE) AS purge_after
    FROM customer WHERE DATE '2024-01-01' + CAST(c_custkey % 60 AS INTEGER) >= DATE '2024-01-31'""",
)
def identity_split(v: Views) -> DataFrame:
    people = v.raw("customer").select(
        F.col("c_custkey").alias("respondent_id"), F.col("c_nationkey").alias("org_id"), F.col("c_name").alias("contact")
    )
    due = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("respondent_id") % 60).cast("int"))
    _, identities = it.split_identities(people, "contact", "salt-2", due)
    return it.purge_identities(identities, F.lit("2024-01-31").cast("date")).select("respondent_id", "contact_hash", "purge_after")


@query(
    "ingest_documents",
    with_views("responses") + """ SELECT CAST(year(o_orderdate) AS VARCHAR) AS survey_id, count(DISTINCT o_orderkey) AS respondents, count(*) AS answers, round(avg(value_num), 6) AS mean_answer
    FROM orders JOIN responses ON respondent_id = o_orderkey GROUP BY 1""",
)
def ingest_documents(v: Views) -> DataFrame:
    people, answers, _ = split_documents(respondent_documents(v))
    per_person = answers.groupBy("respondent_id").agg(F.count(F.lit(1)).alias("k"), F.sum("value_num").alias("s"))
    return people.join(per_person, "respondent_id").groupBy("survey_id").agg(
        F.count(F.lit(1)).alias("respondents"), F.sum("k").alias("answers"), F.round(F.sum("s") / F.sum("k"), 6).alias("mean_answer")
    )


@query(
    "append_partitioned",
    with_views("respondents") + " SELECT CAST(project_id AS INTEGER) AS project_id, count(*) AS n, CAST(sum(duration_sec) AS BIGINT) AS seconds FROM respondents GROUP BY 1",
)
def append_partitioned(v: Views) -> DataFrame:
    path = fresh_path(v.spark, "append")
    append(v.respondents().select("project_id", "respondent_id", "duration_sec"), path, ["project_id"])
    stored = v.spark.read.schema("respondent_id long, duration_sec int, project_id int").parquet(path)
    return stored.groupBy("project_id").agg(F.count(F.lit(1)).alias("n"), F.sum("duration_sec").alias("seconds"))


@query(
    "wire_json",
    with_views("latest") + """ SELECT project_id, metric, '{"metric":"' || metric || '","source":"' || source || '","effective_n":' || effective_n || '}' AS body FROM latest""",
)
def wire_documents(v: Views) -> DataFrame:
    rows = index.latest_snapshots(v.snapshots())
    return wire_json(rows, ["metric", "source", "effective_n"]).select("project_id", "metric", "body")
