"""Explicit schemas (DDL strings) and natural keys of the base tables."""

from __future__ import annotations

SCHEMAS: dict[str, str] = {
    "organizations": "id string, name string, slug string, plan string, retention_days int, created_at timestamp",
    "users": "id string, org_id string, email string, full_name string, role string, is_active boolean, "
    "last_login_at timestamp, created_at timestamp",
    "projects": "id string, org_id string, name string, objective string, poi_weights map<string,double>, "
    "is_demo boolean, created_by string, created_at timestamp",
    "surveys": "id string, org_id string, project_id string, wave int, title string, sampling_method string, "
    "target_n int, fielded_from date, fielded_to date, sampling_params string, created_at timestamp",
    "questions": "id string, org_id string, survey_id string, position int, code string, type string, "
    "text string, options string, required boolean, poi_dimension string, reverse_scored boolean",
    "respondents": "id string, org_id string, survey_id string, anon_code string, age_band string, "
    "gender string, education string, occupation string, province_code string, urbanicity string, "
    "weight decimal(8,4), completed_at timestamp, duration_sec int, quality_score int, "
    "quality_flags array<string>",
    "respondent_identities": "respondent_id string, org_id string, contact_hash string, "
    "consent_at timestamp, consent_scope string, purge_after date",
    "responses": "id string, org_id string, respondent_id string, question_id string, "
    "value_num decimal(10,4), value_text string, value_json string, answered_at timestamp",
    "data_sources": "id string, org_id string, project_id string, source string, connector string, "
    "config string, is_active boolean, last_sync_at timestamp",
    "mentions": "id string, org_id string, project_id string, source string, connector string, "
    "external_id string, published_at timestamp, author_hash string, text string, lang string, "
    "engagement int, reach_est int, province_code string, sentiment decimal(4,3), "
    "emotion map<string,double>, topic_id string, narrative_id string, embedding array<float>, "
    "ingested_at timestamp",
    "topics": "id string, org_id string, project_id string, parent_id string, label string, "
    "keywords array<string>, centroid array<float>, volume int",
    "narratives": "id string, org_id string, project_id string, code string, statement string, "
    "origin_source string, volume_pct decimal(5,2), momentum_7d decimal(5,2), sentiment decimal(4,3), "
    "media_pickup int, unclustered_pct decimal(5,2), detected_at timestamp",
    "metric_snapshots": "id string, org_id string, project_id string, metric string, source string, "
    "method string, period_start date, period_end date, value decimal(8,3), ci_low decimal(8,3), "
    "ci_high decimal(8,3), effective_n int, province_code string, segment string, breakdown string, "
    "created_at timestamp",
    "segments": "id string, org_id string, project_id string, name string, size_pct decimal(5,2), "
    "sentiment decimal(5,2), trust decimal(5,2), profile string, method string, entropy decimal(4,3)",
    "timeline_events": "id string, org_id string, project_id string, occurred_at timestamp, kind string, "
    "label string, value_note string, associated_metric string",
    "forecasts": "id string, org_id string, project_id string, metric string, horizon_days int, "
    "expected decimal(8,3), pi_low decimal(8,3), pi_high decimal(8,3), pi_level decimal(4,3), "
    "model string, drivers string, is_simulation boolean, scenario string, created_at timestamp",
    "ai_outputs": "id string, org_id string, project_id string, kind string, model_version string, "
    "method string, prompt_hash string, payload string, "
    "evidence array<struct<kind:string,ref_id:string,label:string,period:string,n:int,source:string>>, "
    "confidence string, limitations string, human_review string, is_simulation boolean, "
    "reviewed_by string, reviewed_at timestamp, created_at timestamp",
    "audit_logs": "id string, org_id string, actor_id string, action string, entity string, "
    "entity_id string, ip string, metadata string, at timestamp",
    "data_quality_scores": "id string, org_id string, project_id string, dataset string, "
    "completeness int, duplicate int, response_qual int, consistency int, sample_balance int, "
    "metadata_score int, overall int, computed_at timestamp",
}

NATURAL_KEYS: dict[str, tuple[str, ...]] = {
    "organizations": ("slug",),
    "users": ("org_id", "email"),
    "surveys": ("project_id", "wave"),
    "questions": ("survey_id", "code"),
    "respondents": ("survey_id", "anon_code"),
    "responses": ("respondent_id", "question_id"),
    "mentions": ("project_id", "connector", "external_id"),
    "narratives": ("project_id", "code"),
    "segments": ("project_id", "name"),
}

# child table, child column, parent table, parent column
FOREIGN_KEYS: tuple[tuple[str, str, str, str], ...] = (
    ("surveys", "project_id", "projects", "id"),
    ("questions", "survey_id", "surveys", "id"),
    ("respondents", "survey_id", "surveys", "id"),
    ("responses", "respondent_id", "respondents", "id"),
    ("responses", "question_id", "questions", "id"),
    ("mentions", "project_id", "projects", "id"),
    ("metric_snapshots", "project_id", "projects", "id"),
)

# Storage layout: folders to prune by. Tenants first, so scoping prunes files.
PARTITIONS: dict[str, tuple[str, ...]] = {
    "metric_snapshots": ("org_id", "metric"),
    "mentions": ("org_id", "published_date"),
}

# One respondent with its answers, as it arrives.
INGEST_DOCUMENT = (
    "org_id string, survey_id string, completed_at timestamp, "
    "respondent struct<anon_code:string,age_band:string,gender:string,education:string,"
    "occupation:string,province_code:string,urbanicity:string,duration_sec:int>, "
    "answers array<struct<question_id:string,value_num:double,value_text:string,value_json:string>>"
)
