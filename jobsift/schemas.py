"""Declared schemas of the tables and of the JSON documents inside them."""

from pyspark.sql import types as T

S, I, B = T.StringType(), T.IntegerType(), T.BooleanType()
STRINGS = T.ArrayType(S)


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields.items()])


FILTERS = _struct(
    tech_stack_dealbreakers=STRINGS,
    title_floor=S,
    geography_allowed=STRINGS,
    company_type_excluded=STRINGS,
    role_type_excluded=STRINGS,
)

PREFERENCES = _struct(
    preferred_tech_stack=STRINGS,
    target_industries=STRINGS,
    min_company_size=I,
    max_company_size=I,
    onboarding_completed=B,
)

REQUIREMENT = _struct(requirement=S, status=S, evidence=S)

LEVEL_DETECTION = _struct(
    is_fake_em=B, confidence=S, red_flags=STRINGS, actual_level_assessment=S
)

ANALYSIS = _struct(
    ats_score=I,
    role_level_score=I,
    composite_score=I,
    verdict=S,
    hard_reject_triggered=B,
    hard_reject_reasons=STRINGS,
    headline=S,
    matching_skills=STRINGS,
    missing_skills=STRINGS,
    requirements_met=T.ArrayType(REQUIREMENT),
    soft_concerns=STRINGS,
    role_level_assessment=S,
    gap_analysis=S,
    recommendation=S,
    fake_em_detection=LEVEL_DETECTION,
)

PARSED_PROFILE = _struct(
    preferred_tech_stack=STRINGS,
    target_industries=STRINGS,
    title_floor=S,
    geography_allowed=STRINGS,
    tech_stack_dealbreakers=STRINGS,
    company_type_excluded=STRINGS,
    role_type_excluded=STRINGS,
    min_company_size=I,
    max_company_size=I,
)

# Stored screening rows keep the analysis as JSON text.
SCREENING = _struct(
    id=S,
    user_id=S,
    batch_id=S,
    job_url=S,
    job_title=S,
    company=S,
    jd_text=S,
    ats_score=I,
    role_level_score=I,
    composite_score=I,
    verdict=S,
    hard_reject_reasons=STRINGS,
    analysis_json=S,
    created_at=T.TimestampType(),
)

PROFILE = _struct(
    id=S,
    email=S,
    full_name=S,
    resume_text=S,
    api_key_encrypted=S,
    api_provider=S,
    hard_reject_filters=S,
    preferences=S,
    tier=S,
    screens_used_this_month=I,
    created_at=T.TimestampType(),
    updated_at=T.TimestampType(),
    pending_order_id=S,
)

TRACKER = _struct(
    id=S,
    user_id=S,
    screening_result_id=S,
    job_title=S,
    company=S,
    job_url=S,
    status=S,
    notes=S,
    created_at=T.TimestampType(),
    updated_at=T.TimestampType(),
)

REPORT = _struct(
    id=S,
    user_id=S,
    batch_id=S,
    slug=S,
    results_snapshot=T.ArrayType(SCREENING),
    expires_at=T.TimestampType(),
    created_at=T.TimestampType(),
)

SKILL_FREQUENCY = _struct(skill=S, count=I, percentage=T.DoubleType(), trend=S)

BATCH_INTELLIGENCE = _struct(
    total_jds=I,
    top_required_skills=T.ArrayType(SKILL_FREQUENCY),
    top_missing_from_profile=STRINGS,
    title_patterns=STRINGS,
    red_flags_count=I,
)

_NOTES = _struct(entity=_struct(notes=T.MapType(S, S)))
PAYMENT_EVENT = _struct(event=S, payload=_struct(payment=_NOTES, subscription=_NOTES))
