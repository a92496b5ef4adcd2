"""From JSON lines to written results: gate, coerce, rank, write."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchlane.operators.skills import matched_needs, need_hits, need_misses
from matchlane.operators.validation import gate, validate
from matchlane.plans.shortlist import rank_candidates
from matchlane.session import materialise, scratch
from matchlane.sources.candidates import raw_schema, to_candidates
from matchlane.sources.sinks import write_run


def rank_lines(
    lines: DataFrame,
    schema: dict,
    jobs: DataFrame,
    reference_date: Column,
    out: str,
    top_k_rows: int = 100,
    signals_field: str = "signals",
    strict: bool = False,
) -> None:
    """Rank the valid records of ``lines(row_index, value)`` and write the run to ``out``.

    ``results`` holds the shortlists, ``summary`` a row per job and ``quarantine`` the refused
    records with their errors; ``strict`` refuses the whole input instead. Working tables are removed
    once everything is written.
    """
    with scratch(lines.sparkSession):
        checked = validate(lines, schema, on_bad_json="fail" if strict else "quarantine")
        valid, refused = gate(checked, ["row_index"], strict)
        refused.write.json(f"{out}/quarantine")
        raw = valid.select(F.from_json("value", raw_schema(signals_field), {"mode": "FAILFAST"}).alias("r")).select("r.*")
        candidates = materialise(to_candidates(raw, signals_field), "candidates")
        ranked = rank_candidates(candidates, jobs, reference_date, top_k_rows)
        write_run(ranked, jobs, F.lit(candidates.count()), out)


def need_rows(shortlisted: DataFrame, candidates: DataFrame, jobs: DataFrame) -> DataFrame:
    """``jd_id, candidate_id, hits, misses``: each shortlisted candidate against the job's own must-have list."""
    # Read twice, worked out once.
    wanted = materialise(shortlisted.select("jd_id", "candidate_id").join(jobs.select("jd_id", "must_have_skills"), "jd_id"), "wanted")
    named = wanted.select("candidate_id").distinct()
    covered = candidates.join(named, "candidate_id", "left_semi").select("candidate_id", matched_needs().alias("_covered"))
    return wanted.join(covered, "candidate_id").select(
        "jd_id",
        "candidate_id",
        need_hits(F.col("must_have_skills"), F.col("_covered")).alias("hits"),
        need_misses(F.col("must_have_skills"), F.col("_covered")).alias("misses"),
    )
