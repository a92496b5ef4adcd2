"""Full ranking of the derived profiles against the derived jobs."""

from pyspark.sql import functions as F

from checks import profiles as P
from checks import sql as S
from matchlane import lexicons as lx
from matchlane.operators.joins import top_k
from matchlane.operators.ranking import COMPONENTS, canonical_order, display_components
from matchlane.operators.requirements import parse_requirements
from matchlane.plans import sample_profiles as sp
from matchlane.plans.shortlist import index_candidates, rank_candidates, run_metrics, score_pairs
from matchlane.session import materialise

TOP = 100


def jobs(spark, sf_dir):
    return parse_requirements(sp.job_texts(spark, sf_dir))


def default_job(spark):
    return parse_requirements(spark.createDataFrame([("default", None)], "jd_id string, text string"))


def ranked(spark, sf_dir):
    return rank_candidates(P.candidates(spark, sf_dir), jobs(spark, sf_dir), P.today(), TOP)


def shortlists(spark, sf_dir):
    return ranked(spark, sf_dir).select("jd_id", "candidate_id", "rank", "score", "reasoning")


def single_job(spark, sf_dir):
    """The default job description against every candidate, top 100."""
    out = rank_candidates(P.candidates(spark, sf_dir), default_job(spark), P.today(), TOP)
    return out.select("candidate_id", "rank", "score", "reasoning")


def breakdowns(spark, sf_dir):
    """The components of every shortlisted candidate."""
    wanted = jobs(spark, sf_dir)
    index = index_candidates(P.candidates(spark, sf_dir), P.today())
    scored = score_pairs(index, materialise(wanted, "jobs"), TOP)
    order = [F.desc(F.round("final", 9)), F.asc("candidate_id")]
    best = materialise(top_k(scored, ["jd_id"], order, TOP, F.col("doc_key")), "best")
    return best.select(
        "jd_id", "candidate_id", *[F.bround(F.round(c, 12), 6).alias(c) for c in COMPONENTS],
    )


def display(spark, sf_dir):
    out = ranked(spark, sf_dir)
    return out.select(
        "jd_id", "candidate_id", *[F.round(c, 6).alias(n) for c, n in zip(display_components(), lx.DISPLAY_RANGE)]
    )


def canonical(spark, sf_dir):
    return canonical_order(ranked(spark, sf_dir), ["jd_id"]).select("jd_id", "candidate_id", "rank", "score")


def metrics(spark, sf_dir):
    index = index_candidates(P.candidates(spark, sf_dir), P.today())
    return run_metrics(index, jobs(spark, sf_dir)).select(
        "jd_id", "n_candidates", F.round("mean_semantic_fit", 6).alias("mean_semantic_fit")
    )


QUERIES = {
    "score_breakdown": breakdowns,
    "rank_candidates": shortlists,
    "rank_single_job": single_job,
    "display_components": display,
    "canonical_order": canonical,
    "run_metrics": metrics,
}

_BLOB = f"""
bag AS (
  SELECT k, title || ' in ' || industry AS part FROM cand
  UNION ALL SELECT k, summary FROM cand UNION ALL SELECT k, summary FROM cand
  UNION ALL SELECT k, title FROM cand UNION ALL SELECT k, title FROM cand UNION ALL SELECT k, industry FROM cand
  UNION ALL SELECT k, title FROM roles UNION ALL SELECT k, description FROM roles
  UNION ALL SELECT k, description FROM roles UNION ALL SELECT k, industry FROM roles
  UNION ALL SELECT k, name FROM claims
  UNION ALL SELECT k, {S.pick(sp.DEGREES, 'k % 4')} || ' Computer Science University ' || nation
            FROM cand WHERE nation % 4 <> 0),
blobs AS (SELECT k, string_agg(part, ' ') AS blob FROM bag GROUP BY k)"""


def _hot_words(x: str) -> str:
    return S.contains_any(f"lower({x})", lx.HOT_WORDS)


_LABELS = "CASE c " + " ".join(f"WHEN '{c}' THEN {S.q(n)}" for c, n in lx.CLUSTER_LABEL.items()) + " END"
_BEST = ", ".join(
    f"{{'s': {c}, 'o': {-i}, 'c': '{c}'}}" for i, c in enumerate([*lx.SCORED_CLUSTERS, lx.SURFACE_CLUSTER])
)

_TOLD = f"""
hot AS (
  SELECT k, first('shipped retrieval/ranking work at ' || CASE WHEN trim(company) = '' THEN 'previous role'
      ELSE trim(company) END || ' (' || title || ', ' || months || ' mo)' ORDER BY pos) AS phrase
  FROM roles WHERE pos <= 3 AND {_hot_words('description')} GROUP BY k),
best AS (
  SELECT k, 'evidence in ' || {_LABELS} || ' (cluster strength ' || printf('%.2f', {S.half_even('s', 2)}) || ')' AS phrase
  FROM (SELECT k, m.s AS s, m.c AS c FROM (SELECT k, list_max([{_BEST}]) AS m FROM evidence)) WHERE s >= 0.4),
assessed AS (
  SELECT k, first(proficiency || ' ' || name || ' (assessment ' || printf('%.0f', round_even(assessment, 0)) || ', '
      || months || ' mo)' ORDER BY assessment DESC, pos) AS phrase
  FROM claims WHERE assessment IS NOT NULL GROUP BY k),
worries AS (
  SELECT k, list_filter([
      CASE WHEN {P.NOTICE} > 90 THEN 'long notice ' || ({P.NOTICE}) || 'd' END,
      CASE WHEN behavioural < 0.85 THEN 'low platform activity / response rate' END,
      CASE WHEN stuff_ratio >= 0.6 THEN 'AI skills lack endorsement/duration evidence' END,
      CASE WHEN dominance >= 0.55 THEN 'primarily CV/speech background' END,
      CASE WHEN all_consulting THEN 'career entirely at consulting firms' END,
      CASE WHEN penalty >= 0.15 THEN 'profile inconsistencies flagged' END], lambda w: w IS NOT NULL)[1:2] AS w
  FROM cand JOIN behave USING (k) JOIN evidence USING (k) JOIN track USING (k) JOIN penalties USING (k)),
told AS (
  SELECT cand.k, cand.title || ' with ' || printf('%.1f', {S.half_even('years', 1)}) || ' yrs'
      || CASE WHEN location <> '' THEN ', ' || location ELSE '' END || '; '
      || coalesce(hot.phrase, best.phrase, assessed.phrase,
           'current role ' || cand.title || ' at ' || CASE WHEN company = '' THEN 'employer' ELSE company END)
      || CASE WHEN len(w) > 0 THEN '. Concerns: ' || array_to_string(w, ', ') ELSE '' END || '.' AS tail
  FROM cand LEFT JOIN hot USING (k) LEFT JOIN best USING (k) LEFT JOIN assessed USING (k) JOIN worries USING (k))"""


def _final(job_ctes: str) -> str:
    """All CTEs up to ``final`` for jobs with (jd_id, text, min_years, max_years)."""
    return f"""RECURSIVE {P._BASE},{P.FAMILIES},{P.EMPLOYERS},{P.TRACK},{P.PLACES},{P.PENALTY},{P.BEHAVIOUR},{P.EVIDENCE},
{_BLOB},{S.index_ctes('blobs', 'k', 'blob')},{job_ctes},{S.scores_ctes('parsed', 'jd_id', 'text')},{S.hybrid_ctes()},
parts AS (
  SELECT parsed.jd_id, cand.k, cand.candidate_id, title_alignment,
    coalesce(h.semantic, 0.6 * CASE WHEN bhi > blo THEN -blo / (bhi - blo) ELSE 0 END
      + 0.4 * CASE WHEN chi > clo THEN -clo / (chi - clo) ELSE 0 END, 0.0) AS semantic_fit,
    skill_evidence, {P.EXPERIENCE.format(lo='min_years', hi='max_years')} AS experience_band,
    location_score AS location, behavioural, penalty AS honeypot_penalty
  FROM parsed CROSS JOIN cand JOIN aligned a ON a.k = cand.k JOIN evidence e ON e.k = cand.k
  JOIN places pl ON pl.k = cand.k JOIN behave b ON b.k = cand.k JOIN penalties p ON p.k = cand.k
  LEFT JOIN span ON span.jd = parsed.jd_id
  LEFT JOIN hybrid h ON h.jd = parsed.jd_id AND h.d = cand.k),
final AS (
  SELECT *, {S.clip('''(0.32 * title_alignment + 0.22 * semantic_fit + 0.28 * skill_evidence + 0.12 * experience_band
    + 0.06 * location) * behavioural - honeypot_penalty''', -0.5, 1.5)} AS final FROM parts)"""


_FINAL = _final(P.REQUIREMENTS)
_ONE = _final(f"parsed AS (SELECT 'default' AS jd_id, {S.q(lx.DEFAULT_JD_TEXT)} AS text, 5.0 AS min_years, 9.0 AS max_years)")
_RANKED = f"""{_TOLD},
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY jd_id ORDER BY round(final, 9) DESC, candidate_id) AS rank FROM final),
listed AS (
  SELECT *, {S.half_even('final', 4)} AS score,
    CASE WHEN final >= 0.85 THEN 'Strong match' WHEN final >= 0.65 THEN 'Solid match'
         WHEN final >= 0.40 THEN 'Partial fit' ELSE 'Weak signal' END || ' - ' || tail AS reasoning
  FROM ranked JOIN told USING (k) WHERE rank <= {TOP})"""


def _shown(name: str, low: float, high: float) -> str:
    value = f"-{S.half_even(name, 4)}" if name == "honeypot_penalty" else S.half_even(name, 4)
    return f"round({S.clip(f'({value} - ({low})) / {high - low}', 0, 1)}, 6)::DOUBLE AS {name}"


SQL = {
    "score_breakdown": f"""
WITH {_FINAL} SELECT jd_id, candidate_id,
  {', '.join(f'{S.half_even(c, 6)}::DOUBLE AS {c}' for c in COMPONENTS)} FROM final
QUALIFY row_number() OVER (PARTITION BY jd_id ORDER BY round(final, 9) DESC, candidate_id) <= {TOP}""",
    "rank_candidates": f"""
WITH {_FINAL},{_RANKED} SELECT jd_id, candidate_id, rank::INT AS rank, score, reasoning FROM listed""",
    "rank_single_job": f"""
WITH {_ONE},{_RANKED} SELECT candidate_id, rank::INT AS rank, score, reasoning FROM listed""",
    "display_components": f"""
WITH {_FINAL},{_RANKED} SELECT jd_id, candidate_id,
  {', '.join(_shown(c, *r) for c, r in lx.DISPLAY_RANGE.items())} FROM listed""",
    "canonical_order": f"""
WITH {_FINAL},{_RANKED} SELECT jd_id, candidate_id, score,
  row_number() OVER (PARTITION BY jd_id ORDER BY score DESC, candidate_id)::INT AS rank FROM listed""",
    "run_metrics": f"""
WITH {_FINAL} SELECT jd_id, count(*) AS n_candidates, round(avg(semantic_fit), 6) AS mean_semantic_fit
FROM final GROUP BY jd_id""",
}
