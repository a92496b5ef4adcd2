"""The full ranking job: candidates x jobs -> explained shortlists."""

import numpy as np
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from matchlane.functions.binding import literal_table
from matchlane.functions.numeric import half_even
from matchlane.operators.joins import join_lookup, top_k
from matchlane.operators.profile import (
    RECENT_ROLES,
    blob_tokens,
    experience_band,
    title_alignment,
    with_location_score,
    with_role_signals,
)
from matchlane.operators.ranking import breakdown, final_score
from matchlane.operators.reasoning import concerns, sentence, strongest_evidence
from matchlane.operators.retrieval import RetrievalIndex, build_index, job_ranges, mean_semantic, scored_blocks
from matchlane.operators.scoring import Jobs, chosen_pairs, known_ranges
from matchlane.operators.signals import behavioural_multiplier, honeypot_penalty
from matchlane.operators.skills import with_skill_evidence
from matchlane.session import materialise

# Columns the scoring pass reads of every candidate.
SCORING = [
    "candidate_id",
    "years_of_experience",
    "title_alignment",
    "skill_evidence",
    "location_score",
    "behavioural",
    "honeypot_penalty",
]


def telling() -> dict[str, Column]:
    """What the sentences of shortlisted candidates are made from, as the candidate's record has it."""
    return {
        "current_title": F.col("current_title"),
        "current_company": F.col("current_company"),
        "_location": F.col("location"),
        "career": F.slice("career", 1, RECENT_ROLES),
        "skills": F.filter("skills", lambda s: s["assessment_score"].isNotNull()),
        "signals": F.struct(F.col("signals.notice_period_days").alias("notice_period_days")),
        "cluster_scores": F.col("cluster_scores"),
        "keyword_stuff_ratio": F.col("keyword_stuff_ratio"),
        "cv_or_speech_dominance": F.col("cv_or_speech_dominance"),
        "_all_consulting": F.col("_all_consulting"),
    }


def candidate_features(candidates: DataFrame, reference_date: Column) -> DataFrame:
    """Every job-independent column a score needs; one map-only pass over the candidates."""
    return with_skill_evidence(with_location_score(with_role_signals(candidates))).withColumns(
        {
            "title_alignment": title_alignment(),
            "behavioural": behavioural_multiplier(reference_date),
            "honeypot_penalty": honeypot_penalty(),
        }
    )


def index_candidates(candidates: DataFrame, reference_date: Column, path: str | None = None) -> RetrievalIndex:
    """Read the candidates once: features and term counts go into the index table."""
    features = candidate_features(candidates, reference_date)
    return build_index(features, blob_tokens(), SCORING, path, "candidates", telling())


def _final(semantic: Column, experience: Column) -> Column:
    return final_score(
        F.col("title_alignment"),
        semantic,
        F.col("skill_evidence"),
        experience,
        F.col("location_score"),
        F.col("behavioural"),
        F.col("honeypot_penalty"),
    )


_BAND = "array<struct<min_years:double,max_years:double,floor:double>>"


def _bands(jobs: DataFrame) -> list[Row]:
    """The distinct experience bands of one block of jobs; at most one per job."""
    return jobs.select("min_years", "max_years").distinct().orderBy("min_years", "max_years").collect()


def _banded(bands: list[Row], floors: dict[int, float] | None = None) -> Column:
    floors = floors or {}
    return literal_table(
        [{"min_years": r.min_years, "max_years": r.max_years, "floor": floors.get(i)} for i, r in enumerate(bands)], _BAND
    )


def _without_semantic(semantic: float, band: Column) -> Column:
    experience = experience_band(F.col("years_of_experience"), band["min_years"], band["max_years"])
    return _final(F.lit(semantic), experience)


def band_floors(index: RetrievalIndex, bands: list[Row], k: int) -> dict[int, float]:
    """Per band, the score that ``k`` candidates reach without any semantic part; none with fewer candidates."""
    lows = F.transform(_banded(bands), lambda b: _without_semantic(0.0, b))
    each = index.docs.select("doc_key", F.posexplode(lows).alias("band", "low"))
    first = top_k(each, ["band"], [F.desc("low")], k, F.col("doc_key")).where(F.col("rank") == k)
    return {r.band: r.low for r in first.collect()}


def survivors(index: RetrievalIndex, bands: list[Row], floors: dict[int, float]) -> DataFrame:
    """The candidates that can be on a list, with ``bands``: the positions of the bands they can be on a list of.

    Everything in the final score but the semantic part, which lies in [0, 1], depends on the candidate
    and the band alone. Who does not reach a band's floor with a full semantic part is on none of its lists.
    """
    reached = F.transform(
        _banded(bands, floors),
        lambda b, i: F.when(b["floor"].isNull() | (_without_semantic(1.0, b) >= b["floor"] - 1e-8), i),
    )
    return index.docs.withColumn("bands", F.array_compact(reached)).where(F.size("bands") > 0)


def score_pairs(index: RetrievalIndex, jobs: DataFrame, k: int | None = None) -> DataFrame:
    """``jd_id, doc_key, …, final``: the components of candidates against the jobs.

    With ``k``, only candidates that can be among the first ``k`` of a job are scored against it; the
    pairs go straight to whatever reads them. ``jobs`` is a stored table.
    """

    def scored(block: Jobs, part: DataFrame) -> DataFrame:
        wanted = part.join(jobs, "jd_id").select("jd_id", "min_years", "max_years")
        bands = _bands(wanted)
        place = {(r.min_years, r.max_years): i for i, r in enumerate(bands)}
        of_job = {r.jd_id: place[r.min_years, r.max_years] for r in wanted.collect()}
        chosen = survivors(index, bands, band_floors(index, bands, k) if k else {})
        ranges = known_ranges(job_ranges(index, block), block)
        at = np.array([of_job[j] for j in block.names.to_pylist()], np.int64)
        found = chosen_pairs(chosen, block, ranges, ["doc_key", *SCORING], at)
        return found.join(F.broadcast(wanted.distinct()), "jd_id")

    found = scored_blocks(index, jobs, scored, "raw_text")
    if found is None:
        empty = index.docs.select("doc_key", *SCORING).limit(0).withColumn("semantic", F.lit(0.0))
        found = jobs.select("jd_id", "min_years", "max_years").join(empty, F.lit(True))
    band = experience_band(F.col("years_of_experience"), F.col("min_years"), F.col("max_years"))
    return (
        found.withColumn("experience_band", band)
        .withColumn("final", _final(F.col("semantic"), F.col("experience_band")))
        .withColumnsRenamed({"semantic": "semantic_fit", "location_score": "location"})
        .drop("min_years", "max_years")
    )


def score_candidates(index: RetrievalIndex, jobs: DataFrame) -> DataFrame:
    """Every candidate against every job: as many rows as both have together, multiplied."""
    return score_pairs(index, materialise(jobs, "jobs"))


def shortlist(
    scored: DataFrame, index: RetrievalIndex, top_k_rows: int = 100
) -> DataFrame:
    """Top rows per job with their sentence; wide columns are read, and sentences made, for these rows only."""
    order = [F.desc(F.round("final", 9)), F.asc("candidate_id"), F.asc("doc_key")]
    best = materialise(top_k(scored, ["jd_id"], order, top_k_rows, F.col("doc_key")), "shortlist")
    # A document is on any number of lists; what is told of it is worked out once.
    told = join_lookup(index.wide, best.select("doc_key", "behavioural", "honeypot_penalty").distinct(), ["doc_key"], F.col("doc_key"))
    told = told.select(
        "doc_key",
        "current_title",
        "_location",
        strongest_evidence().alias("evidence"),
        concerns(F.col("behavioural"), F.col("honeypot_penalty")).alias("concerns"),
    )
    return (
        best.join(told, "doc_key")
        .withColumn("breakdown", breakdown())
        .drop("location")
        .withColumnRenamed("_location", "location")
        .select(
            "jd_id",
            "candidate_id",
            "rank",
            half_even(F.col("final"), 4).alias("score"),
            sentence(F.col("final")).alias("reasoning"),
            "breakdown",
        )
    )


def rank_candidates(
    candidates: DataFrame, jobs: DataFrame, reference_date: Column, top_k_rows: int = 100
) -> DataFrame:
    """``jd_id, candidate_id, rank, score, reasoning, breakdown``.

    ``candidates`` is the typed table, ``jobs`` the parsed requirements.
    """
    index = index_candidates(candidates, reference_date)
    return shortlist(score_pairs(index, materialise(jobs, "jobs"), top_k_rows), index, top_k_rows)


def run_metrics(index: RetrievalIndex, jobs: DataFrame) -> DataFrame:
    """Per job: candidates scored and mean semantic fit over all of them, from per-job sums alone."""
    means = mean_semantic(index, materialise(jobs.select("jd_id", "raw_text"), "jobs"), "raw_text")
    return means.select("jd_id", F.lit(index.n_docs).cast("bigint").alias("n_candidates"), "mean_semantic_fit")
