"""Who may see and write which rows, and the column constraints of each table."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobsift import constants as K
from jobsift.skew import spread_join


@dataclass(frozen=True)
class Rules:
    """Constraints of one table: required columns and allowed words."""

    required: tuple[str, ...]
    allowed: dict[str, tuple[str, ...]]


SCREENING_RULES = Rules(
    required=("id", "user_id", "batch_id", "ats_score", "role_level_score",
              "composite_score", "verdict", "created_at"),
    allowed={"verdict": K.VERDICTS},
)
PROFILE_RULES = Rules(
    required=("id", "email", "screens_used_this_month", "created_at", "updated_at"),
    allowed={"tier": K.TIERS, "api_provider": K.API_PROVIDERS},
)
TRACKER_RULES = Rules(
    required=("id", "user_id", "status", "created_at", "updated_at"),
    allowed={"status": K.TRACKER_STATUSES},
)


def tenant_scope(
    df: DataFrame, principals: DataFrame, owner: str = "user_id", row_id: str = "id"
) -> DataFrame:
    """Rows owned by one of ``principals`` (user_id); no principals, no rows."""
    allowed = principals.where(F.col("user_id").isNotNull()).select(
        F.col("user_id").alias(owner)).distinct()
    return spread_join(df, allowed, [owner], "left_semi", spread_by=[row_id])


def rows_of(df: DataFrame, user_id: str | None, owner: str = "user_id") -> DataFrame:
    """Rows of one user; anonymous (None) sees none."""
    return df.where(F.lit(False) if user_id is None else F.col(owner) == user_id)


def check_insert(df: DataFrame, user_id: str | None, owner: str = "user_id") -> DataFrame:
    """The rows ``user_id`` may not insert; an insert is allowed when this is empty."""
    foreign = F.lit(True) if user_id is None else ~F.coalesce(F.col(owner) == user_id, F.lit(False))
    return df.where(foreign)


def with_problems(df: DataFrame, rules: Rules) -> DataFrame:
    """Add the ordered list of broken constraints; empty means the row is fine."""
    missing = [
        F.when(F.col(c).isNull(), F.lit(f"{c} is missing")) for c in rules.required
    ]
    wrong = [
        F.when(~F.col(c).isin(*words), F.concat(F.lit(f"{c} is not allowed: "), F.col(c)))
        for c, words in rules.allowed.items()
    ]
    return df.withColumn("problems", F.array_compact(F.array(*missing, *wrong)))


def constraint_violations(df: DataFrame, rules: Rules) -> DataFrame:
    """Rows that break a constraint, with the reasons."""
    return with_problems(df, rules).where(F.size("problems") > 0)
