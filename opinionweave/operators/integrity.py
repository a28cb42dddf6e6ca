"""Constraint checks, uniqueness, references, bulk changes, audit and retention."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import constants as C
from ..functions.scalars import codes, natural_id, not_blank, slug_ok
from ..plans.ranking import latest_per_key
from ..sources.sinks import once_per_key

Rule = tuple[str, Column]


def in_set(column: str, enum: str) -> Rule:
    ok = F.col(column).isin(*C.ENUMS[enum])
    return f"{column.upper()}_UNKNOWN", F.col(column).isNotNull() & ~ok


def required(column: str) -> Rule:
    return f"{column.upper()}_MISSING", F.col(column).isNull()


def in_range(column: str, low: float | None = None, high: float | None = None, open_low: bool = False) -> Rule:
    c = F.col(column)
    bad = F.lit(False)
    if low is not None:
        bad = bad | ((c <= low) if open_low else (c < low))
    if high is not None:
        bad = bad | (c > high)
    return f"{column.upper()}_RANGE", F.coalesce(bad, F.lit(False))


def non_blank(column: str) -> Rule:
    return f"{column.upper()}_BLANK", ~not_blank(F.col(column))


def slug(column: str) -> Rule:
    return f"{column.upper()}_FORMAT", ~F.coalesce(slug_ok(F.col(column)), F.lit(False))


def rules_for(table: str) -> list[Rule]:
    """Write rules per base table; only columns present in the batch should be passed on."""
    rules: dict[str, list[Rule]] = {
        "organizations": [required("name"), slug("slug")],
        "users": [required("full_name"), in_set("role", "user_role")],
        "projects": [required("name")],
        "surveys": [
            required("title"), in_range("wave", 1), in_set("sampling_method", "sampling_method"),
            in_range("target_n", 1),
        ],
        "questions": [
            required("code"), required("text"), in_range("position", 0), in_set("type", "question_type"), required("type"),
        ],
        "respondents": [required("anon_code"), in_range("weight", 0), in_range("duration_sec", 0)],
        "mentions": [
            required("external_id"), required("published_at"), required("text"),
            in_set("source", "signal_source"), in_range("sentiment", -1, 1),
        ],
        "metric_snapshots": [
            required("metric"), required("method"), required("source"), required("value"),
            in_set("source", "signal_source"),
        ],
        "dimensions": [in_range("score", 0, 100), in_range("weight", 0), in_set("source", "signal_source")],
        "raking_requests": [in_range("max_iterations", 1, 100), in_range("trim_ratio", 1, 10)],
        "forecast_requests": [in_range("baseline", 0, 100), in_range("pi_level", 0.5, 0.99)],
        "timeline_events": [required("label"), in_set("kind", "timeline_kind")],
        "ai_outputs": [
            ("EVIDENCE_EMPTY", F.coalesce(F.size("evidence"), F.lit(0)) <= 0), non_blank("limitations"),
            in_set("confidence", "confidence_band"), in_set("human_review", "review_status"),
        ],
    }
    return rules[table]


def violations(df: DataFrame, rules: Sequence[Rule], name: str = "violations") -> DataFrame:
    return df.withColumn(name, codes(*rules))


def split_valid(df: DataFrame, rules: Sequence[Rule]) -> tuple[DataFrame, DataFrame]:
    """(rows that pass every rule, rows with their violation codes)."""
    marked = violations(df, rules)
    return marked.filter(F.size("violations") == 0).drop("violations"), marked.filter(F.size("violations") > 0)


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Key values held by more than one row (counts combined before the shuffle)."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies")).filter(F.col("copies") > 1)


def keep_first(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], row_id: Sequence[str]
) -> tuple[DataFrame, DataFrame]:
    """(first row per key, the others). ``row_id`` is unique in the table and not NULL.

    Winners are pruned to one row per key before the shuffle; the others are found
    by an anti join on the row id, so the rows of a hot key are spread.
    """
    winners = latest_per_key(df, keys, order)
    return winners, df.join(winners.select(*row_id), list(row_id), "left_anti").select(*df.columns)


def orphans(child: DataFrame, column: str, parent: DataFrame, parent_key: str = "id") -> DataFrame:
    """Child rows whose reference has no parent (NULL references are allowed)."""
    keys = parent.select(F.col(parent_key).alias(column))
    return child.filter(F.col(column).isNotNull()).join(keys, column, "left_anti")


def cascade_delete(child: DataFrame, column: str, deleted: DataFrame, deleted_key: str = "id") -> DataFrame:
    """Child rows left after their parents were deleted."""
    return child.join(deleted.select(F.col(deleted_key).alias(column)), column, "left_anti")


def upsert(base: DataFrame, changes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of ``changes`` replace or extend ``base``; keys that are repeated in ``changes`` are not applied."""
    changes = once_per_key(changes, keys)
    return base.join(changes.select(*keys), list(keys), "left_anti").unionByName(changes)


def partial_update(base: DataFrame, patch: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Only the non-NULL fields of the patch overwrite the base; keys repeated in the patch are not applied."""
    patch = once_per_key(patch, keys)
    fields = [c for c in patch.columns if c not in keys]
    p = patch.select(*keys, *[F.col(c).alias(f"_p_{c}") for c in fields])
    joined = base.join(p, list(keys), "left")
    return joined.select(*[
        F.coalesce(F.col(f"_p_{c}"), F.col(c)).alias(c) if c in fields else F.col(c) for c in base.columns
    ])


def audit_changes(
    old: DataFrame, new: DataFrame, keys: Sequence[str], fields: Sequence[str], entity: str, actor: str, at: Column
) -> DataFrame:
    """One audit row per inserted, deleted or changed entity."""
    o = old.select(*keys, F.struct(*fields).alias("_old"))
    n = new.select(*keys, F.struct(*fields).alias("_new"))
    action = (
        F.when(F.col("_old").isNull(), "insert").when(F.col("_new").isNull(), "delete").otherwise("update")
    )
    return (
        o.join(n, list(keys), "full_outer")
        .filter(~F.col("_old").eqNullSafe(F.col("_new")))
        .select(
            natural_id(F.lit(entity), *[F.col(k) for k in keys], at).alias("audit_id"),
            *keys,
            F.lit(entity).alias("entity"),
            F.concat(F.lit(f"{entity}:"), action).alias("action"),
            F.lit(actor).alias("actor_id"),
            F.to_json(F.struct(F.col("_old").alias("old"), F.col("_new").alias("new"))).alias("metadata"),
            at.alias("at"),
        )
    )


def purge_identities(identities: DataFrame, today: Column) -> DataFrame:
    """Identities whose purge date has not come yet (``purge_after >= today``)."""
    return identities.filter(F.col("purge_after") >= today)


def retain(df: DataFrame, time: str, now: Column, days: int | Column = 730) -> DataFrame:
    """Rows still inside the retention period; a literal cut-off reaches the scan."""
    days = F.lit(days) if isinstance(days, int) else days
    return df.filter(F.col(time) >= F.date_sub(now.cast("date"), days))


def retain_by_tenant(df: DataFrame, organizations: DataFrame, time: str, now: Column) -> DataFrame:
    """Retention with each tenant's own number of days."""
    days = organizations.select(F.col("id").alias("org_id"), "retention_days")
    return df.join(days, "org_id").filter(
        F.col(time) >= F.date_sub(now.cast("date"), F.col("retention_days"))
    ).drop("retention_days")


def pseudonymise(df: DataFrame, column: str, salt: str, name: str = "author_hash") -> DataFrame:
    """Replace an account name by a salted hash."""
    hashed = F.sha2(F.concat(F.lit(salt), F.col(column).cast("string")), 256)
    return df.withColumn(name, hashed).drop(column)


def split_identities(
    respondents: DataFrame, contact: str, salt: str, purge_after: Column, keep: Mapping[str, str] | None = None
) -> tuple[DataFrame, DataFrame]:
    """(respondents without contact, identity rows with a hashed contact)."""
    identities = respondents.filter(F.col(contact).isNotNull()).select(
        "respondent_id",
        "org_id",
        F.sha2(F.concat(F.lit(salt), F.col(contact)), 256).alias("contact_hash"),
        *[F.col(src).alias(dst) for src, dst in (keep or {}).items()],
        purge_after.alias("purge_after"),
    )
    return respondents.drop(contact, *(keep or {})), identities
