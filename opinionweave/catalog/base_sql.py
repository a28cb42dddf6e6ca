"""SQL text of the derived views, shared by the statements of all queries."""

from __future__ import annotations

from ..functions.constants import DEFAULT_INDEX_WEIGHTS

VIEWS = {
    "respondents": """respondents AS (
  SELECT n_regionkey AS project_id, CAST(n_regionkey*100 + year(o_orderdate) - 1994 AS INTEGER) AS survey_id,
         o_orderkey AS respondent_id, CASE WHEN o_orderkey % 23 = 0 THEN NULL ELSE c_mktsegment END AS age_band,
         o_orderstatus AS gender, n_name AS province_code, o_orderpriority AS urbanicity,
         CAST(floor(o_totalprice/400) AS INTEGER) AS duration_sec, o_orderdate AS completed_at,
         CAST(1 + (o_orderkey % 5)*CAST(0.1 AS DOUBLE) AS DOUBLE) AS weight
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)""",
    "responses": """responses AS (
  SELECT o_orderkey AS respondent_id, q AS question_id,
         CAST(CASE WHEN o_orderkey % 9 = 0 THEN 3
                   ELSE 1 + (o_orderkey*13 + q*q*7 + CAST(floor(o_totalprice) AS BIGINT)) % 5 END AS DOUBLE) AS value_num
  FROM orders, (SELECT CAST(range AS INTEGER) AS q FROM range(1, 9)) t)""",
    "questions": """questions AS (
  SELECT q AS question_id, CASE q % 4 WHEN 0 THEN 'sentiment' WHEN 1 THEN 'approval' WHEN 2 THEN 'trust' ELSE 'satisfaction' END AS poi_dimension,
         q % 2 = 0 AS reverse_scored FROM (SELECT CAST(range AS INTEGER) AS q FROM range(1, 9)) t)""",
    "census": """census AS (
  SELECT project_id, age_band, CAST(c AS DOUBLE)/sum(c) OVER (PARTITION BY project_id) AS census_share
  FROM (SELECT n_regionkey AS project_id, c_mktsegment AS age_band, count(*) AS c
        FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2) x)""",
    "ev": """ev AS (
  SELECT event_id, user_id % 5 AS project_id, user_id, event_type, ts, value,
         CASE event_type WHEN 'click' THEN 'SOCIAL' WHEN 'view' THEN 'MEDIA' WHEN 'error' THEN 'DIGITAL' ELSE 'SURVEY' END AS source,
         CASE event_type WHEN 'click' THEN 'sentiment' WHEN 'purchase' THEN 'approval' WHEN 'signup' THEN 'trust'
                         WHEN 'view' THEN 'issue_perception' ELSE 'satisfaction' END AS metric,
         CAST(CAST(date_trunc('week', ts) AS DATE) + 6 AS DATE) AS period_end
  FROM events)""",
    "snapshots": """snapshots AS (
  SELECT project_id, metric, source, period_end, avg(least(value, CAST(100 AS DOUBLE))) AS value, CAST(count(*)*3 AS INTEGER) AS effective_n
  FROM ev GROUP BY ALL)""",
    "positive": """positive AS (
  SELECT project_id, source, period_end, 100*avg(CASE WHEN value < 50 THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END) AS value,
         CAST(count(*) AS INTEGER) AS effective_n, lower(source) || '_positive' AS metric
  FROM ev GROUP BY project_id, source, period_end)""",
    "segments": """segments AS (
  SELECT project_id, name, CAST(100 AS DOUBLE)*c/sum(c) OVER (PARTITION BY project_id) AS size_pct,
         CAST(CASE name WHEN 'AUTOMOBILE' THEN 70 WHEN 'BUILDING' THEN -60 WHEN 'FURNITURE' THEN 15
                        WHEN 'HOUSEHOLD' THEN -31 ELSE 2 END * (CAST(0.2 AS DOUBLE) + CAST(0.3 AS DOUBLE)*project_id) AS DOUBLE) AS sentiment
  FROM (SELECT n_regionkey AS project_id, c_mktsegment AS name, count(*) AS c
        FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2) x)""",
    "mentions": """mentions AS (
  SELECT event_id, project_id, event_id - CASE WHEN event_id % 10 = 0 AND event_id > 0 THEN 1 ELSE 0 END AS external_id,
         source, ts AS published_at, user_id AS author, CAST(floor(value) AS INTEGER) AS engagement,
         (CAST(floor(value*100) AS BIGINT) % 201 - 100)/CAST(100 AS DOUBLE) AS sentiment,
         CASE WHEN event_id % 16 = 0 THEN NULL WHEN event_id % 4 = 0 THEN 'A' WHEN event_id % 4 = 1 THEN 'B'
              WHEN event_id % 4 = 2 THEN 'C' ELSE 'D' END AS narrative,
         CAST(event_id % 10 AS INTEGER) AS topic_id, event_id % 200 AS doc_id, event_type, value
  FROM ev)""",
    "outputs": """outputs AS (
  SELECT conv_id*1000 + turn AS id, conv_id % 5 AS project_id,
         text || CASE WHEN conv_id % 7 = 0 THEN ' disebabkan oleh harga' WHEN conv_id % 11 = 0 THEN ' pasti akan naik' ELSE '' END AS payload_text,
         CASE WHEN conv_id % 3 = 0 THEN 'difference-in-differences' ELSE 'RAG agregat' END AS method,
         CASE turn % 3 WHEN 0 THEN 'LOW' WHEN 1 THEN 'HIGH' ELSE 'MEDIUM' END AS confidence,
         CASE conv_id % 3 WHEN 0 THEN 'SURVEY' WHEN 1 THEN 'SOCIAL' ELSE 'MEDIA' END AS ev_source,
         CAST((conv_id*7 + turn*3) % 400 AS INTEGER) AS ev_n, conv_id % 5 = 0 AS is_simulation,
         CASE WHEN conv_id % 10 = 0 THEN 'hasil simulasi, bukan prediksi' WHEN conv_id % 13 = 0 THEN '' ELSE 'satu gelombang survei' END AS limitations,
         text AS ev_label
  FROM conversations WHERE role = 'assistant')""",
    "weights": "weights(metric, weight) AS (VALUES "
    + ", ".join(f"('{k}', CAST({w} AS DOUBLE))" for k, w in DEFAULT_INDEX_WEIGHTS.items()) + ")",
    "latest": """latest AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY project_id, metric ORDER BY period_end DESC, source) AS rn FROM snapshots) x
  WHERE rn = 1)""",
}
NEEDS = {
    "snapshots": ["ev"], "positive": ["ev"], "mentions": ["ev"], "latest": ["snapshots"],
}


def with_views(*names: str) -> str:
    """WITH clause of the named views and what they need."""
    ordered: list[str] = []

    def add(name: str) -> None:
        for need in NEEDS.get(name, []):
            add(need)
        if name not in ordered:
            ordered.append(name)

    for name in names:
        add(name)
    return "WITH " + ",\n".join(VIEWS[n] for n in ordered)


def he(expr: str, digits: int) -> str:
    """Round half to even on the decimal value."""
    return f"CAST(round_even(CAST({expr} AS DECIMAL(28,9)), {digits}) AS DOUBLE)"


def hei(expr: str) -> str:
    return f"CAST(round_even(CAST({expr} AS DECIMAL(28,9)), 0) AS INTEGER)"


def joined(*pairs: tuple[str, str]) -> str:
    """Comma-joined codes whose condition holds."""
    return "concat_ws(',', " + ", ".join(f"CASE WHEN {cond} THEN '{code}' END" for code, cond in pairs) + ")"
