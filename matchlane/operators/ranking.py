"""Score composition, shortlists and the canonical order of the written file."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchlane.functions.numeric import clip, half_even, rescale
from matchlane.lexicons import DISPLAY_RANGE, SCORE_RANGE, SCORE_WEIGHT

COMPONENTS = [
    "title_alignment",
    "semantic_fit",
    "skill_evidence",
    "experience_band",
    "location",
    "behavioural",
    "honeypot_penalty",
    "final",
]


def final_score(
    title: Column,
    semantic: Column,
    skill: Column,
    experience: Column,
    location: Column,
    behavioural: Column,
    penalty: Column,
    weights: dict[str, float] = SCORE_WEIGHT,
) -> Column:
    linear = (
        weights["title"] * title
        + weights["semantic"] * semantic
        + weights["skill"] * skill
        + weights["experience"] * experience
        + weights["location"] * location
    )
    return clip(linear * behavioural - penalty, *SCORE_RANGE)


def breakdown() -> Column:
    """The eight components as a struct, rounded half-even to four decimals."""
    return F.struct(*[half_even(F.col(c), 4).alias(c) for c in COMPONENTS])


def display_components(breakdown_column: str = "breakdown") -> list[Column]:
    """Each component as its position inside its declared range."""
    out = []
    for name, (low, high) in DISPLAY_RANGE.items():
        value = F.col(f"{breakdown_column}.{name}")
        out.append(rescale(-value if name == "honeypot_penalty" else value, low, high).alias(name))
    return out


def canonical_order(shortlist: DataFrame, group: list[str]) -> DataFrame:
    """Re-issue ranks by rounded score, then id.

    Runs on shortlists only, so a group is at most k rows.
    """
    by = Window.partitionBy(*group).orderBy(F.desc(half_even(F.col("score"), 4)), F.asc("candidate_id"))
    return shortlist.withColumn("rank", F.row_number().over(by))
