"""Checks of AI outputs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import constants as C
from ..functions.scalars import json_text, prompt_hash
from ..operators import governance as g
from ..sources.views import Views
from .base_sql import joined, with_views
from .index_queries import flat
from .registry import query

BASE = with_views("outputs")


def _any(column: str, terms) -> str:
    return "(" + " OR ".join(f"contains(lower({column}), '{t}')" for t in terms) + ")"


CAUSAL = f"({_any('payload_text', C.CAUSAL_TERMS)} AND NOT {_any('method', C.CAUSAL_DESIGNS)})"
OVER = _any("payload_text", C.OVERCLAIM_TERMS)
UNDISCLOSED = "(is_simulation AND NOT contains(lower(limitations), 'simulasi'))"
SOCIAL_HIGH = "(confidence = 'HIGH' AND ev_source = 'SOCIAL')"
SMALL = "(ev_n BETWEEN 1 AND 4)"
SHORT = "(length(limitations) < 10)"


@query(
    "ai_output_violations",
    BASE + f""" SELECT id, project_id, {joined(('LIMITATIONS_TOO_SHORT', SHORT), ('EVIDENCE_SHAPE', 'length(ev_label) < 1'), ('SMALL_CELL', SMALL), ('CAUSAL_WITHOUT_DESIGN', CAUSAL), ('OVERCLAIM', OVER), ('SIMULATION_NOT_DISCLOSED', UNDISCLOSED), ('HIGH_ON_SOCIAL_ONLY', SOCIAL_HIGH))} AS violations FROM outputs""",
)
def ai_output_violations(v: Views) -> DataFrame:
    return flat(g.validate_outputs(v.ai_outputs()), "violations").select("id", "project_id", "violations")


@query(
    "violation_counts",
    BASE + ", x AS (" + " UNION ALL ".join(
        f"SELECT project_id, '{code}' AS violation FROM outputs WHERE {cond}"
        for code, cond in (
            ("LIMITATIONS_TOO_SHORT", SHORT), ("EVIDENCE_SHAPE", "length(ev_label) < 1"), ("SMALL_CELL", SMALL), ("CAUSAL_WITHOUT_DESIGN", CAUSAL),
            ("OVERCLAIM", OVER), ("SIMULATION_NOT_DISCLOSED", UNDISCLOSED), ("HIGH_ON_SOCIAL_ONLY", SOCIAL_HIGH),
        )
    ) + ") SELECT project_id, violation, count(*) AS outputs FROM x GROUP BY 1, 2",
)
def violation_counts(v: Views) -> DataFrame:
    return g.violation_counts(g.validate_outputs(v.ai_outputs()))


@query("evidence_guard", BASE + f" SELECT id, TRUE AS has_evidence, {SMALL} AS small_cell FROM outputs")
def evidence_guard(v: Views) -> DataFrame:
    return v.ai_outputs().select("id", g.evidence_present().alias("has_evidence"), g.small_cell().alias("small_cell"))


@query("causal_guard", BASE + f" SELECT id FROM outputs WHERE {CAUSAL}")
def causal_guard(v: Views) -> DataFrame:
    return v.ai_outputs().filter(g.causal_without_design(json_text(F.col("payload")), F.col("method"))).select("id")


@query("overclaim_guard", BASE + f" SELECT id FROM outputs WHERE {OVER}")
def overclaim_guard(v: Views) -> DataFrame:
    return v.ai_outputs().filter(g.overclaim(json_text(F.col("payload")))).select("id")


@query("simulation_guard", BASE + f" SELECT id FROM outputs WHERE {UNDISCLOSED}")
def simulation_guard(v: Views) -> DataFrame:
    return v.ai_outputs().filter(g.undisclosed_simulation()).select("id")


@query("social_high_guard", BASE + f" SELECT id FROM outputs WHERE {SOCIAL_HIGH}")
def social_high_guard(v: Views) -> DataFrame:
    return v.ai_outputs().filter(g.high_on_social_only()).select("id")


@query("payload_text", BASE + " SELECT id, payload_text AS text FROM outputs")
def payload_text(v: Views) -> DataFrame:
    return v.ai_outputs().select("id", json_text(F.col("payload")).alias("text"))


_REVIEW = f""", r AS (SELECT id, CASE WHEN ev_n < 250 AND confidence <> 'LOW' THEN 'LOW' WHEN confidence = 'HIGH' AND ev_source <> 'SURVEY' THEN 'MEDIUM' ELSE confidence END AS confidence,
    array_to_string(list_filter([CASE WHEN ev_n < 250 AND confidence <> 'LOW' THEN 'SMALL_SAMPLE_EVIDENCE' END,
        CASE WHEN confidence = 'HIGH' AND ev_source <> 'SURVEY' THEN 'NO_SURVEY_EVIDENCE' END,
        CASE WHEN {_any('ev_label', C.SENSITIVE_HINTS)} THEN 'SENSITIVE_LABEL' END], lambda x: x IS NOT NULL), ',') AS review_codes,
    CASE WHEN {_any('ev_label', C.SENSITIVE_HINTS)} THEN 'NEEDS_REVIEW' ELSE 'PENDING' END AS human_review FROM outputs)"""


@query("review_downgrade", BASE + _REVIEW + " SELECT * FROM r")
def review_downgrade(v: Views) -> DataFrame:
    return g.review(v.ai_outputs()).select("id", "confidence", F.array_join("review_codes", ",").alias("review_codes"), "human_review")


@query(
    "review_approval",
    BASE + _REVIEW + " SELECT id, CASE WHEN id % 3 = 0 THEN 'APPROVED' ELSE human_review END AS human_review, CASE WHEN id % 3 = 0 THEN 'reviewer-' || (id % 4) END AS reviewed_by FROM r",
)
def review_approval(v: Views) -> DataFrame:
    outputs = g.review(v.ai_outputs())
    decisions = v.ai_outputs().filter(F.col("id") % 3 == 0).select(
        "id", F.concat(F.lit("reviewer-"), (F.col("id") % 4).cast("string")).alias("reviewer"),
        F.lit("2024-02-01").cast("timestamp").alias("reviewed_at"),
    )
    return g.approve(outputs, decisions).select("id", "human_review", "reviewed_by")


@query("prompt_hash", BASE + " SELECT id, left(sha256(method || chr(0) || payload_text), 16) AS prompt_hash FROM outputs")
def prompt_hashes(v: Views) -> DataFrame:
    return v.ai_outputs().select("id", prompt_hash(F.col("method"), json_text(F.col("payload"))).alias("prompt_hash"))
