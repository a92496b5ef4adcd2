"""Row-local features from a candidate's profile and career.

Everything here is a projection over one candidate row: no join, no shuffle.
Intermediate columns start with ``_`` so that an expression used many times is
evaluated once per row.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchlane.functions.numeric import clip
from matchlane.functions.text import contains_any, normalise, tokenize
from matchlane.lexicons import (
    BUILDER_WORDS,
    CONSULTING_FIRMS,
    HOME_COUNTRY,
    MANAGEMENT_WORDS,
    PREFERRED_CITIES,
    PRODUCT_COMPANIES,
    ROLE_FAMILIES,
    TIER1_CITIES,
)

RECENT_ROLES = 3


def _non_empty(parts: Column) -> Column:
    return F.filter(parts, lambda p: p != "")


def text_blob(career: Column | str = "career") -> Column:
    """Searchable text; summary, title and role descriptions count twice."""
    c = F.col
    head = F.array(
        c("headline"), c("summary"), c("summary"), c("current_title"), c("current_title"), c("current_industry")
    )
    roles = F.flatten(
        F.transform(career, lambda r: F.array(r["title"], r["description"], r["description"], r["industry"]))
    )
    return F.concat_ws(" ", _non_empty(F.concat(head, roles, _skill_names(), _degrees())))


def _skill_names() -> Column:
    return F.transform("skills", lambda s: s["name"])


def _degrees() -> Column:
    return F.transform("education", lambda e: F.concat_ws(" ", e["degree"], e["field_of_study"], e["institution"]))


def blob_tokens() -> Column:
    """Tokens of ``text_blob`` as a bag, tokenising each source text once."""
    c = F.col
    single = F.concat(
        F.array(c("headline"), c("current_industry")),
        F.flatten(F.transform("career", lambda r: F.array(r["title"], r["industry"]))),
        _skill_names(),
        _degrees(),
    )
    double = F.concat(
        F.array(c("summary"), c("current_title")), F.transform("career", lambda r: r["description"])
    )
    return F.concat(
        tokenize(F.concat_ws(" ", single)),
        F.flatten(F.array_repeat(tokenize(F.concat_ws(" ", double)), 2)),
    )


def role_of(title: str) -> str:
    """SQL for the ``struct<family, score>`` of a normalised title; the longest keyword wins.

    The branches are sorted longest keyword first (lexicon order on ties), so
    the first hit is the answer and the rest is skipped.
    """
    keywords = [(kw, fam, score) for fam, score, kws in ROLE_FAMILIES for kw in kws]
    keywords.sort(key=lambda k: -len(k[0]))

    def role(family: str, score: float) -> str:
        return f"named_struct('family', '{family}', 'score', {score}D)"

    branches = " ".join(f"WHEN contains({title}, '{kw}') THEN {role(fam, score)}" for kw, fam, score in keywords)
    return f"CASE {branches} ELSE {role('unknown', 0.0)} END"


def with_role_signals(candidates: DataFrame) -> DataFrame:
    """Adds role family, trajectory and employer flags."""
    prepared = candidates.withColumns(
        {
            "_title": normalise(F.col("current_title")),
            "_recent_titles": F.transform(F.slice("career", 1, RECENT_ROLES), lambda r: normalise(r["title"])),
            "_employers": _non_empty(
                F.transform(
                    F.concat(F.transform("career", lambda r: r["company"]), F.array("current_company")), normalise
                )
            ),
        }
    )
    matched = prepared.withColumns(
        {
            "_role": F.expr(role_of("_title")),
            "_recent": F.expr(f"transform(_recent_titles, t -> {role_of('t')})"),
            "_all_consulting": F.forall("_employers", lambda e: contains_any(e, CONSULTING_FIRMS)),
        }
    )
    total = F.aggregate("_recent", F.lit(0.0), lambda a, r: a + r["score"])
    return matched.withColumns(
        {
            "current_family": F.col("_role.family"),
            "current_family_score": F.col("_role.score"),
            "avg_recent_family_score": F.coalesce(F.try_divide(total, F.size("_recent")), F.col("_role.score")),
            "only_consulting": (F.size("_employers") > 0) & F.col("_all_consulting"),
            "has_product_company": F.exists("_employers", lambda e: contains_any(e, PRODUCT_COMPANIES)),
            "pure_management_track": contains_any(F.col("_title"), MANAGEMENT_WORDS)
            & ~contains_any(F.col("_title"), BUILDER_WORDS),
        }
    ).drop("_title", "_recent_titles", "_employers", "_role", "_recent")


def title_alignment() -> Column:
    base = (0.7 * F.col("current_family_score") + 0.3 * F.col("avg_recent_family_score")) / 3.0

    def adjust(flag: str, by: float) -> Column:
        return F.when(F.col(flag), F.lit(by)).otherwise(F.lit(0.0))

    return clip(
        base
        + adjust("only_consulting", -0.40)
        + adjust("pure_management_track", -0.20)
        + adjust("has_product_company", 0.10),
        -1.0,
        1.0,
    )


def experience_band(years: Column, low: Column, high: Column) -> Column:
    """1 inside the band, proportional below it, minus 0.1 per year above it."""
    return (
        F.when(years.between(low, high), F.lit(1.0))
        .when(years < low, F.greatest(F.lit(0.0), F.coalesce(F.try_divide(years, low), F.lit(0.0))))
        .otherwise(F.greatest(F.lit(0.0), 1.0 - 0.10 * (years - high)))
    )


def with_location_score(candidates: DataFrame) -> DataFrame:
    """Adds ``location_score``; city tests come before the country test."""
    relocates = F.coalesce(F.col("signals.willing_to_relocate"), F.lit(False))

    def by_relocation(yes: float, no: float) -> Column:
        return F.when(relocates, F.lit(yes)).otherwise(F.lit(no))

    return (
        candidates.withColumns({"_city": normalise(F.col("location")), "_country": normalise(F.col("country"))})
        .withColumn(
            "location_score",
            F.when(contains_any(F.col("_city"), PREFERRED_CITIES), F.lit(1.0))
            .when(contains_any(F.col("_city"), TIER1_CITIES), by_relocation(0.85, 0.75))
            .when(F.contains("_country", F.lit(HOME_COUNTRY)), by_relocation(0.65, 0.45))
            .otherwise(by_relocation(0.30, 0.10)),
        )
        .drop("_city", "_country")
    )
