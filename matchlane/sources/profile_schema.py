"""Declared schema of a raw profile (the JSON-Schema subset the validator understands).

Fixed values: field names, types, bounds, enumerations, formats.
"""

COMPANY_SIZES = ["1-10", "11-50", "51-200", "201-500", "501-1000", "1001-5000", "5001-10000", "10001+"]


def _text(**rules) -> dict:
    return {"type": "string", **rules}


def _whole(**rules) -> dict:
    return {"type": "integer", **rules}


def _number(low: float | None = None, high: float | None = None) -> dict:
    rules = {"type": "number", "minimum": low, "maximum": high}
    return {k: v for k, v in rules.items() if v is not None}


def _record(properties: dict, optional: tuple[str, ...] = (), **rules) -> dict:
    required = [name for name in properties if name not in optional]
    return {"type": "object", "required": required, "properties": properties, **rules}


_DAY = _text(format="date")
_FLAG = {"type": "boolean"}
_COUNT = _whole(minimum=0)

PROFILE = _record(
    {
        **{name: _text() for name in ("anonymized_name", "headline", "summary", "location", "country")},
        "years_of_experience": _number(0, 50),
        "current_title": _text(),
        "current_company": _text(),
        "current_company_size": _text(enum=COMPANY_SIZES),
        "current_industry": _text(),
    }
)
ROLE = _record(
    {
        "company": _text(),
        "title": _text(),
        "start_date": _DAY,
        "end_date": {"type": ["string", "null"], "format": "date"},
        "duration_months": _COUNT,
        "is_current": _FLAG,
        "industry": _text(),
        "company_size": _text(enum=COMPANY_SIZES),
        "description": _text(),
    }
)
DEGREE = _record(
    {
        "institution": _text(),
        "degree": _text(),
        "field_of_study": _text(),
        "start_year": _whole(minimum=1970, maximum=2030),
        "end_year": _whole(minimum=1970, maximum=2035),
        "grade": {"type": ["string", "null"]},
        "tier": _text(enum=["tier_1", "tier_2", "tier_3", "tier_4", "unknown"]),
    },
    optional=("grade", "tier"),
)
SKILL = _record(
    {
        "name": _text(),
        "proficiency": _text(enum=["beginner", "intermediate", "advanced", "expert"]),
        "endorsements": _COUNT,
        "duration_months": _COUNT,
    },
    optional=("duration_months",),
)
CERTIFICATION = _record({"name": _text(), "issuer": _text(), "year": _whole()})
LANGUAGE = _record(
    {"language": _text(), "proficiency": _text(enum=["basic", "conversational", "professional", "native"])}
)
SIGNALS = _record(
    {
        "profile_completeness_score": _number(0, 100),
        "signup_date": _DAY,
        "last_active_date": _DAY,
        "open_to_work_flag": _FLAG,
        "profile_views_received_30d": _COUNT,
        "applications_submitted_30d": _COUNT,
        "recruiter_response_rate": _number(0, 1),
        "avg_response_time_hours": _number(0),
        "skill_assessment_scores": {"type": "object", "additionalProperties": _number(0, 100)},
        "connection_count": _COUNT,
        "endorsements_received": _COUNT,
        "notice_period_days": _whole(minimum=0, maximum=180),
        "expected_salary_range_inr_lpa": _record({"min": _number(0), "max": _number(0)}),
        "preferred_work_mode": _text(enum=["remote", "hybrid", "onsite", "flexible"]),
        "willing_to_relocate": _FLAG,
        "github_activity_score": _number(-1, 100),
        "search_appearance_30d": _COUNT,
        "saved_by_recruiters_30d": _COUNT,
        "interview_completion_rate": _number(0, 1),
        "offer_acceptance_rate": _number(-1, 1),
        "verified_email": _FLAG,
        "verified_phone": _FLAG,
        "linkedin_connected": _FLAG,
    }
)


def profile_schema(signals_field: str = "signals") -> dict:
    def items(of: dict, **rules) -> dict:
        return {"type": "array", "items": of, **rules}

    return _record(
        {
            "candidate_id": _text(pattern="^CAND_[0-9]{7}$"),
            "profile": PROFILE,
            "career_history": items(ROLE, minItems=1, maxItems=10),
            "education": items(DEGREE, minItems=0, maxItems=5),
            "skills": items(SKILL, minItems=0),
            "certifications": items(CERTIFICATION),
            "languages": items(LANGUAGE),
            signals_field: SIGNALS,
        },
        optional=("certifications", "languages"),
    )
