"""Fixed values. They must keep these exact values for results to agree."""

# --- signal sources and enum sets (fixed values) ---
SOURCES = ("SURVEY", "SOCIAL", "MEDIA", "DIGITAL")
PROBABILITY_SOURCE = "SURVEY"

ENUMS = {
    "signal_source": SOURCES,
    "sampling_method": ("SRS", "STRATIFIED", "CLUSTER", "MULTISTAGE", "QUOTA", "PURPOSIVE"),
    "user_role": (
        "SUPER_ADMIN", "RESEARCH_DIRECTOR", "RESEARCHER", "DATA_ANALYST",
        "COMM_STRATEGIST", "EXECUTIVE", "CLIENT", "VIEWER",
    ),
    "question_type": (
        "SINGLE", "MULTI", "LIKERT", "SEMANTIC_DIFF", "RANKING",
        "MATRIX", "OPEN", "DEMOGRAPHIC", "SCREENING",
    ),
    "review_status": ("PENDING", "APPROVED", "REJECTED", "NEEDS_REVIEW"),
    "confidence_band": ("LOW", "MEDIUM", "HIGH"),
    "quality_flag": (
        "SPEEDING", "STRAIGHT_LINING", "INCONSISTENT", "DUPLICATE_SUSPECT", "OUT_OF_QUOTA",
    ),
    "timeline_kind": ("event", "signal", "media", "alert"),
    "evidence_kind": (
        "metric_snapshot", "mention_aggregate", "narrative", "segment", "forecast",
    ),
}

# --- index (fixed values) ---
MIN_EFFECTIVE_N = 250
MIN_CELL_N = 5
SMALL_SURVEY_N = 400
Z_INDEX = {0.90: 1.6449, 0.95: 1.9600, 0.99: 2.5758}
DEFAULT_INDEX_WEIGHTS = {
    "sentiment": 20.0,
    "approval": 25.0,
    "trust": 25.0,
    "satisfaction": 12.0,
    "issue_perception": 10.0,
    "confidence": 8.0,
}

# --- sampling (fixed values) ---
Z_SAMPLING = {0.80: 1.2816, 0.90: 1.6449, 0.95: 1.9600, 0.99: 2.5758}
DESIGN_EFFECT = {
    "SRS": 1.0, "STRATIFIED": 0.9, "CLUSTER": 2.0,
    "MULTISTAGE": 1.6, "QUOTA": 1.0, "PURPOSIVE": 1.0,
}
NON_PROBABILITY_METHODS = ("QUOTA", "PURPOSIVE")
RAKEABLE = ("age_band", "gender", "education", "occupation", "province_code", "urbanicity")

# --- signal comparison (fixed values) ---
NOTABLE_GAP = 15.0
SOURCE_META = (
    # source, metric, bias code, order
    ("SURVEY", "survey_positive", "PROBABILISTIC", 0),
    ("SOCIAL", "social_positive", "SELF_SELECTED", 1),
    ("MEDIA", "media_positive", "EDITORIAL_AGENDA", 2),
    ("DIGITAL", "digital_positive", "AGGREGATE_DIGITAL", 3),
)

# --- forecast (fixed values) ---
DRIVERS = (
    # key, coefficient, unit, uncertainty per unit
    ("food_price", -0.72, "%", 0.05),
    ("comms_intensity", 0.34, "unit", 0.04),
    ("negative_coverage", -0.28, "unit", 0.09),
)
SPREAD = {1: 0.8, 3: 1.5, 7: 2.3, 14: 3.3, 30: 4.5, 90: 7.2}

# --- risk (fixed values) ---
RISK_WEIGHTS = {
    "negative_sentiment": 0.18,
    "sentiment_velocity": 0.16,
    "issue_growth": 0.12,
    "narrative_polarization": 0.12,
    "influencer_amplification": 0.10,
    "geographic_spread": 0.10,
    "media_escalation": 0.10,
    "trust_decline": 0.07,
    "approval_decline": 0.05,
}
RISK_BANDS = ((20, "Low"), (40, "Moderate"), (60, "Elevated"), (80, "High"), (100, "Critical"))

# --- dataset quality part weights (fixed values) ---
DATASET_WEIGHTS = {
    "completeness": 1.0, "duplicate": 1.0, "response_qual": 1.5,
    "consistency": 1.0, "sample_balance": 2.0, "metadata_score": 0.5,
}

# --- wording guards (fixed values) ---
CAUSAL_TERMS = (
    "menyebabkan", "disebabkan oleh", "mengakibatkan", "akibat langsung",
    "terbukti membuat", "caused by", "causes",
)
CAUSAL_DESIGNS = ("difference-in-differences", "did", "rct", "synthetic control", "eksperimen")
OVERCLAIM_TERMS = ("dipastikan", "pasti akan", "mengendalikan opini", "menjamin")
SENSITIVE_HINTS = ("pemilu", "kandidat", "partai", "agama", "etnis", "suku")
SIMULATION_WORD = "simulasi"
MAX_PAYLOAD_DEPTH = 6
