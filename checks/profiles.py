"""Candidate features, skill evidence and ranking over the derived profiles."""

from pyspark.sql import functions as F

from checks import sql as S
from matchlane import lexicons as lx
from matchlane.functions.binding import rows_of
from matchlane.functions.text import normalise
from matchlane.operators.profile import (
    experience_band,
    text_blob,
    title_alignment,
    with_location_score,
    with_role_signals,
)
from matchlane.operators.requirements import parse_requirements
from matchlane.operators.signals import behavioural_multiplier, honeypot_penalty, inconsistencies
from matchlane.operators.skills import (
    evidence_overall,
    first_match,
    matched_needs,
    need_hits,
    need_misses,
    with_claims,
    with_skill_evidence,
)
from matchlane.plans import sample_profiles as sp
from matchlane.plans.sample_profiles import raw_profiles, table
from matchlane.sources.candidates import to_candidates


def today():
    return F.lit(sp.REFERENCE_DATE).cast("date")


def candidates(spark, sf_dir):
    return to_candidates(raw_profiles(spark, sf_dir))


def profile_facts(spark, sf_dir):
    return candidates(spark, sf_dir).select(
        "candidate_id", "name", "headline", "location", "country",
        F.round("years_of_experience", 6).alias("years"), "current_title", "current_company",
        F.size("career").cast("bigint").alias("n_roles"), F.size("skills").cast("bigint").alias("n_skills"),
        F.size("education").cast("bigint").alias("n_degrees"),
    )


def skill_claims(spark, sf_dir):
    """Coerced skills, one row each (the assessment comes from the map by name)."""
    return (
        rows_of(candidates(spark, sf_dir), ["candidate_id"], F.col("skills"), "s")
        .select("candidate_id", "s.*")
        .withColumn("assessment_score", F.round("assessment_score", 6))
    )


def blob(spark, sf_dir):
    return candidates(spark, sf_dir).select("candidate_id", text_blob().alias("blob"))


def role_signals(spark, sf_dir):
    return with_role_signals(candidates(spark, sf_dir)).select(
        "candidate_id", "current_family", F.round("current_family_score", 6).alias("current_score"),
        F.round("avg_recent_family_score", 6).alias("recent_score"),
        "only_consulting", "has_product_company", "pure_management_track",
    )


def title_alignment_scores(spark, sf_dir):
    return with_role_signals(candidates(spark, sf_dir)).select(
        "candidate_id", F.round(title_alignment(), 6).alias("title_alignment")
    )


def experience_scores(spark, sf_dir):
    years = F.col("years_of_experience")
    return candidates(spark, sf_dir).select(
        "candidate_id", F.round(experience_band(years, F.lit(5.0), F.lit(9.0)), 6).alias("experience_band")
    )


def location_scores(spark, sf_dir):
    return with_location_score(candidates(spark, sf_dir)).select("candidate_id", "location_score")


def honeypots(spark, sf_dir):
    flags = [holds.alias(name) for name, holds in inconsistencies().items()]
    return candidates(spark, sf_dir).select("candidate_id", *flags, F.round(honeypot_penalty(), 6).alias("penalty"))


def behavioural(spark, sf_dir):
    return candidates(spark, sf_dir).select(
        "candidate_id", F.round(behavioural_multiplier(today()), 6).alias("behavioural")
    )


def claim_trust(spark, sf_dir):
    return (
        rows_of(with_claims(candidates(spark, sf_dir)), ["candidate_id"], F.col("claims"), "c")
        .select(
            "candidate_id", "c.name", "c.norm", F.round("c.trust", 6).alias("trust"), "c.cluster", "c.surface",
            "c.padded", "c.vision", "c.speech",
        )
    )


def skill_dictionary(spark, sf_dir):
    """First matching cluster member for every distinct skill or part name."""
    claimed = rows_of(raw_profiles(spark, sf_dir), [], F.col("skills.name"), "skill")
    parts = table(spark, sf_dir, "part").select(F.col("p_name").alias("skill"))
    names = claimed.union(parts).distinct()
    match = first_match(normalise(F.col("skill")), lx.SCORED_CLUSTERS)
    return rows_of(names, ["skill"], F.array(match), "m").select("skill", "m.cluster", "m.member")


def skill_evidence(spark, sf_dir):
    scored = with_skill_evidence(candidates(spark, sf_dir))
    return scored.select(
        "candidate_id",
        *[F.round(F.col("cluster_scores")[c], 6).alias(c) for c, _ in lx.SKILL_CLUSTERS],
        F.round("cv_or_speech_dominance", 6).alias("dominance"),
        F.round("keyword_stuff_ratio", 6).alias("stuff_ratio"),
        F.round(evidence_overall(), 6).alias("overall"),
        F.round("skill_evidence", 9).alias("skill_evidence"),
    )


def need_coverage(spark, sf_dir):
    """Must-have hits and misses of the default job."""
    needs = F.array(*[F.lit(n) for n in lx.MUST_HAVE])
    covered = candidates(spark, sf_dir).withColumn("covered", matched_needs())
    return covered.select(
        "candidate_id",
        F.concat_ws("|", need_hits(needs, F.col("covered"))).alias("hits"),
        F.concat_ws("|", need_misses(needs, F.col("covered"))).alias("misses"),
    )


def job_requirements(spark, sf_dir):
    parsed = parse_requirements(sp.job_texts(spark, sf_dir))
    return parsed.select(
        "jd_id", "title", "role_family", "seniority", "min_years", "max_years",
        F.concat_ws("|", "must_have_skills").alias("must"), F.concat_ws("|", "nice_to_have_skills").alias("nice"),
        F.concat_ws("|", "disqualifier_skills").alias("reject"), "preferred_notice_days", "soft_notice_days",
    )


QUERIES = {
    "profile_facts": profile_facts,
    "skill_claims": skill_claims,
    "text_blob": blob,
    "role_signals": role_signals,
    "title_alignment": title_alignment_scores,
    "experience_band": experience_scores,
    "location_score": location_scores,
    "honeypot_penalty": honeypots,
    "behavioural_multiplier": behavioural,
    "claim_trust": claim_trust,
    "skill_dictionary": skill_dictionary,
    "skill_evidence": skill_evidence,
    "need_coverage": need_coverage,
    "job_requirements": job_requirements,
}

# ---- the same derivation in DuckDB ------------------------------------------------


CAND = f"""
cand AS (
  SELECT c_custkey AS k, printf('CAND_%07d', c_custkey) AS candidate_id, c_name AS name, c_nationkey AS nation,
         {S.pick(sp.CITIES, 'c_nationkey % 9')} AS location, {S.pick(sp.COUNTRIES, 'c_nationkey % 9')} AS country,
         floor(abs(c_acctbal) / 50) / 10 AS years, c_mktsegment AS industry, coalesce(d.text, '') AS summary,
         c_acctbal, {S.pick(sp.TITLES, '(c_custkey * 7) % 16')} AS title,
         {S.pick(sp.COMPANIES, 'c_custkey % 12')} AS company
  FROM customer LEFT JOIN documents d ON d.doc_id = c_custkey % (SELECT count(*) FROM documents))"""

ROLES = f"""
roles AS (
  SELECT o_custkey AS k, pos, o_orderkey % 8 AS o_size, {S.pick(sp.COMPANIES, 'o_orderkey % 12')} AS company,
         {S.pick(sp.TITLES, 'o_orderkey % 16')} AS title, strftime(o_orderdate, '%Y-%m-%d') AS start_date,
         year(o_orderdate) AS start_year, (floor(o_totalprice)::BIGINT % 60 + 1) AS months,
         (o_orderstatus = 'O' AND o_orderkey % 5 = 0) AS is_current, o_orderpriority AS industry,
         {S.pick(sp.PHRASES, 'o_orderkey % 6')} || coalesce(' ' || b.text, '') AS description
  FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS pos FROM orders)
  LEFT JOIN benchmark b ON b.item_id = o_orderkey % (SELECT count(*) FROM benchmark)
  WHERE o_custkey IN (SELECT c_custkey FROM customer))"""

CLAIMS = f"""
claims AS (
  SELECT k, pos, {S.pick(sp.SKILLS, 'pos')} AS name,
         CASE WHEN k % 11 = 0 THEN 'expert' ELSE {S.pick(sp.LEVELS, '(k + pos) % 4')} END AS proficiency,
         CASE WHEN k % 11 = 0 THEN 0 ELSE qty END::BIGINT AS endorsements,
         CASE WHEN k % 11 = 0 THEN 1 ELSE 6 * n END::BIGINT AS months,
         CASE WHEN k % 11 <> 0 AND (k + pos) % 3 = 0 THEN round(disc * 1000, 0) END AS assessment
  FROM (
    SELECT o_custkey AS k, l_partkey % 24 AS pos, max(l_quantity) AS qty, count(*) AS n, max(l_discount) AS disc
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey
    WHERE o_custkey IN (SELECT c_custkey FROM customer) GROUP BY ALL))"""

ACTIVITY = """
activity AS (
  SELECT user_id AS k, strftime(min(ts), '%Y-%m-%d') AS first_day, strftime(max(ts), '%Y-%m-%d') AS last_day,
         avg(CASE WHEN event_type = 'click' THEN 1.0 ELSE 0.0 END) AS response,
         avg(CASE WHEN event_type <> 'error' THEN 1.0 ELSE 0.0 END) AS interview,
         count(*) FILTER (event_type = 'purchase') AS saved
  FROM events GROUP BY user_id)"""

_KEYWORDS = [(kw, fam, score, i) for i, (kw, fam, score) in enumerate(
    (kw, fam, score) for fam, score, kws in lx.ROLE_FAMILIES for kw in kws)]

FAMILIES = f"""
titles AS (SELECT DISTINCT title FROM (SELECT title FROM cand UNION ALL SELECT title FROM roles)),
family AS (
  SELECT t.title, coalesce(first(fam ORDER BY length(kw) DESC, ord), 'unknown') AS family,
         coalesce(first(score ORDER BY length(kw) DESC, ord), 0.0) AS score
  FROM titles t LEFT JOIN ({S.values_of(_KEYWORDS)}) kws(kw, fam, score, ord) ON contains({S.norm('t.title')}, kw)
  GROUP BY t.title)"""

EMPLOYERS = f"""
employers AS (
  SELECT k, {S.norm('company')} AS e FROM (SELECT k, company FROM roles UNION ALL SELECT k, company FROM cand)),
firms AS (
  SELECT k, count(*) FILTER (e <> '') AS n,
         coalesce(bool_and({S.contains_any('e', lx.CONSULTING_FIRMS)}) FILTER (e <> ''), true) AS all_consulting,
         coalesce(bool_or({S.contains_any('e', lx.PRODUCT_COMPANIES)}) FILTER (e <> ''), false) AS product
  FROM employers GROUP BY k)"""

TRACK = f"""
track AS (
  SELECT k, candidate_id, f.family AS current_family, f.score AS current_score,
         coalesce(r.avg_score, f.score) AS recent_score, n > 0 AND all_consulting AS only_consulting,
         all_consulting, product AS has_product_company,
         {S.contains_any(S.norm('cand.title'), lx.MANAGEMENT_WORDS)}
           AND NOT {S.contains_any(S.norm('cand.title'), lx.BUILDER_WORDS)} AS pure_management_track
  FROM cand JOIN family f USING (title) JOIN firms USING (k)
  LEFT JOIN (SELECT k, avg(score) AS avg_score FROM roles JOIN family USING (title) WHERE pos <= 3 GROUP BY k) r
    USING (k)),
aligned AS (
  SELECT k, {S.clip('''(0.7 * current_score + 0.3 * recent_score) / 3.0
    - CASE WHEN only_consulting THEN 0.4 ELSE 0 END - CASE WHEN pure_management_track THEN 0.2 ELSE 0 END
    + CASE WHEN has_product_company THEN 0.1 ELSE 0 END''', -1.0, 1.0)} AS title_alignment FROM track)"""

PLACES = f"""
places AS (
  SELECT k, CASE WHEN {S.contains_any(S.norm('location'), lx.PREFERRED_CITIES)} THEN 1.0
    WHEN {S.contains_any(S.norm('location'), lx.TIER1_CITIES)} THEN CASE WHEN k % 2 = 0 THEN 0.85 ELSE 0.75 END
    WHEN contains({S.norm('country')}, 'india') THEN CASE WHEN k % 2 = 0 THEN 0.65 ELSE 0.45 END
    ELSE CASE WHEN k % 2 = 0 THEN 0.30 ELSE 0.10 END END::DOUBLE AS location_score FROM cand)"""

SIGNUP = "CASE WHEN k % 9 = 4 THEN last_day ELSE first_day END"
ACTIVE = "CASE WHEN k % 9 = 4 THEN first_day ELSE last_day END"

PENALTY = f"""
odd AS (
  SELECT cand.k, candidate_id,
    coalesce(r.worked, 0) - round_even(years * 12, 0) >= 24 AND round_even(years * 12, 0) > 0 AS career_overflow,
    coalesce(c.unproven, 0) >= 3 AS unproven_expertise,
    floor(abs(c_acctbal) / 500) > nation AND nation > 0 AS inverted_salary,
    coalesce({SIGNUP} > {ACTIVE}, false) AS signup_after_activity,
    coalesce(r.n_current, 0) > 0 AND nation % 4 <> 0 AND 1985 + cand.k % 30 > r.last_start + 1 AS studied_after_start,
    coalesce(r.n_current, 0) > 1 AS several_current_roles
  FROM cand LEFT JOIN activity USING (k)
  LEFT JOIN (SELECT k, sum(months) AS worked, count(*) FILTER (is_current) AS n_current,
                    max(start_year) FILTER (is_current) AS last_start FROM roles GROUP BY k) r USING (k)
  LEFT JOIN (SELECT k, count(*) AS unproven FROM claims
             WHERE proficiency IN ('expert', 'advanced') AND endorsements = 0 AND months <= 2 GROUP BY k) c USING (k)),
penalties AS (
  SELECT *, least(0.5, 0.18 * career_overflow::INT + 0.15 * unproven_expertise::INT + 0.08 * inverted_salary::INT
    + 0.04 * signup_after_activity::INT + 0.03 * coalesce(studied_after_start, false)::INT
    + 0.10 * several_current_roles::INT)::DOUBLE AS penalty FROM odd)"""

_IDLE = f"date_diff('day', ({ACTIVE})::DATE, DATE '{sp.REFERENCE_DATE}')"
NOTICE = "CASE WHEN (k * 13) % 181 = 0 THEN 90 ELSE (k * 13) % 181 END"

BEHAVIOUR = f"""
behave AS (
  SELECT k, candidate_id, {S.clip(f'''1.0
    + CASE WHEN {_IDLE} IS NULL THEN 0 WHEN {_IDLE} <= 30 THEN 0.12 WHEN {_IDLE} <= 90 THEN 0.05
           WHEN {_IDLE} <= 180 THEN -0.05 ELSE -0.2 END
    + (coalesce(response, 0) - 0.4) * 0.3 + (coalesce(interview, 0) - 0.5) * 0.15
    + CASE WHEN k % 3 = 0 THEN 0.05 ELSE -0.02 END
    + CASE WHEN k % 2 = 1 THEN 0.015 ELSE 0 END + CASE WHEN nation % 2 = 0 THEN 0.015 ELSE 0 END
    + CASE WHEN nation % 3 = 0 THEN 0.02 ELSE 0 END
    + CASE WHEN {NOTICE} <= 30 THEN 0.05 WHEN {NOTICE} <= 60 THEN 0 WHEN {NOTICE} <= 90 THEN -0.04 ELSE -0.08 END
    + 0.05 * least(coalesce(saved, 0), 20) / 20.0''', 0.55, 1.2)}::DOUBLE AS behavioural
  FROM cand LEFT JOIN activity USING (k))"""

_PROF = ("CASE proficiency WHEN 'beginner' THEN 0.25 WHEN 'intermediate' THEN 0.55 WHEN 'advanced' THEN 0.85 "
         "WHEN 'expert' THEN 1.0 ELSE 0.4 END")
_ENDORSED, _USED = "least(endorsements, 50) / 50.0", "least(months, 36) / 36.0"
_LEX = [(c, m, i) for i, (c, m) in enumerate((c, m) for c, ms in lx.SKILL_CLUSTERS for m in ms)]

MATCHED = f"""
lex AS (SELECT cluster, member, ord, {S.norm('member')} AS m FROM ({S.values_of(_LEX)}) v(cluster, member, ord)),
near AS (
  SELECT DISTINCT n AS a, m AS b FROM names, lex
  WHERE 2.0 * least(length(n), length(m)) / (length(n) + length(m)) >= 0.88),
{S.lcs_ctes('near')},
hits AS (
  SELECT n, cluster, member, ord FROM names JOIN lex ON contains(n, m) OR contains(m, n) WHERE n <> ''
  UNION
  SELECT lcs.a, cluster, member, ord FROM lcs JOIN lex ON lex.m = lcs.b
  WHERE 200 * lcs >= 88 * (length(a) + length(b)))"""

EVIDENCE = f"""
names AS (SELECT DISTINCT {S.norm('name')} AS n FROM claims),{MATCHED},
placed AS (
  SELECT n, first(cluster ORDER BY ord) FILTER (cluster <> 'ai_keyword_surface') AS cluster,
         bool_or(cluster = 'ai_keyword_surface') AS surface FROM hits GROUP BY n),
trusted AS (
  SELECT k, name, {S.norm('name')} AS n, proficiency, endorsements, months, assessment,
         least(1.0, CASE WHEN assessment IS NOT NULL
           THEN 0.40 * {_PROF} + 0.20 * {_ENDORSED} + 0.10 * {_USED} + 0.30 * assessment / 100.0
           ELSE 0.55 * {_PROF} + 0.25 * {_ENDORSED} + 0.20 * {_USED} END) AS trust
  FROM claims),
judged AS (
  SELECT t.*, p.cluster, coalesce(p.surface, false) AS surface,
         (proficiency IN ('advanced', 'expert') AND endorsements <= 2 AND months <= 6 AND assessment IS NULL)
           OR trust < 0.40 AS padded,
         t.n IN ({', '.join(S.q(v) for v in lx.VISION_SKILLS)}) AS vision,
         t.n IN ({', '.join(S.q(v) for v in lx.SPEECH_SKILLS)}) AS speech
  FROM trusted t LEFT JOIN placed p USING (n)),
summed AS (
  SELECT k, {', '.join(f"least(1.0, coalesce(sum(trust) FILTER (cluster = '{c}'), 0.0) / 4) AS {c}" for c in lx.SCORED_CLUSTERS)},
         0.0::DOUBLE AS ai_keyword_surface,
         least(1.0, (coalesce(sum(trust) FILTER (vision), 0.0) + coalesce(sum(trust) FILTER (speech), 0.0))
           / (1e-9 + coalesce(sum(trust), 0.0))) AS dominance,
         coalesce(count(*) FILTER (surface AND padded) / nullif(count(*) FILTER (surface), 0), 0.0) AS stuff_ratio
  FROM cand LEFT JOIN judged USING (k) GROUP BY k),
evidence AS (
  SELECT *, least(1.0, (0.30 * embeddings_retrieval + 0.20 * ranking_recsys + 0.20 * nlp_llm + 0.15 * ml_core
      + 0.10 * python_engineering + 0.05 * data_engineering)
      * CASE WHEN dominance >= 0.55 THEN 0.55 ELSE 1 END * CASE WHEN stuff_ratio >= 0.7 THEN 0.65 ELSE 1 END)
      AS skill_evidence
  FROM summed)"""

EXPERIENCE = "CASE WHEN years BETWEEN {lo} AND {hi} THEN 1.0 WHEN years < {lo} THEN greatest(0, years / {lo}) " \
             "ELSE greatest(0, 1 - 0.1 * (years - {hi})) END"

_CLUSTER_COLUMNS = ", ".join(f"round({c}, 6) AS {c}" for c, _ in lx.SKILL_CLUSTERS)
_NEEDS = list(enumerate(lx.MUST_HAVE))

# ---- job descriptions ----------------------------------------------------------------

JOB_TEXTS = f"""
jobs AS (
  SELECT printf('JD_%05d', item_id) AS jd_id, item_id,
    CASE WHEN item_id % 4 <> 1 THEN 'Job Description: ' || {S.pick(sp.TITLES, 'item_id % 16')} || ' - Core'
         ELSE 'Open position' END || chr(10) || text
    || CASE WHEN item_id % 2 = 0 THEN chr(10) || 'Experience: ' || (item_id % 5 + 2) || ' - ' || (item_id % 5 + 6)
         || ' years.' ELSE '' END
    || CASE WHEN item_id % 5 = 0 THEN chr(10) || 'Notice: sub-' || (item_id % 7 * 5 + 10) || ' days.' ELSE '' END
    || CASE WHEN item_id % 3 <> 0 THEN chr(10) || 'Must have: Python, ' || {S.pick(sp.SKILLS, 'item_id % 24')}
         || ', vector database and ranking.' || chr(10) || 'Nice to have: XGBoost, '
         || {S.pick(sp.SKILLS, '(item_id * 5) % 24')} || '.' || chr(10) || 'Do not want: speech only profiles.'
         || chr(10) || 'We offer: time.' ELSE chr(10) || 'Bonus: MLOps and LoRA.' END AS text
  FROM benchmark)"""

_POOL = sorted(set(lx.MUST_HAVE + lx.NICE_TO_HAVE + lx.DISQUALIFIERS), key=lambda s: (-len(s), s))


def _earliest(x: str, markers) -> str:
    found = ", ".join(f"nullif(instr({x}, {S.q(m)}), 0)" for m in markers)
    return f"least({found})"


def _section(name: str) -> str:
    starts, stops = lx.JD_SECTIONS[name]
    return f"""
{name}_rest AS (SELECT jd_id, substr(lower(text), {_earliest('lower(text)', starts)}) AS rest FROM jobs),
{name}_body AS (
  SELECT jd_id, CASE WHEN stop IS NULL THEN rest ELSE substr(rest, 1, stop) END AS body
  FROM (SELECT jd_id, rest, {_earliest('substr(rest, 2)', stops)} AS stop FROM {name}_rest)),
{name} AS (
  SELECT jd_id, coalesce(string_agg(skill, '|' ORDER BY ord), {S.q('|'.join({'must': lx.MUST_HAVE, 'nice': lx.NICE_TO_HAVE, 'reject': lx.DISQUALIFIERS}[name]))}) AS skills
  FROM {name}_body LEFT JOIN ({S.values_of((s, i) for i, s in enumerate(_POOL))}) p(skill, ord)
    ON contains(body, lower(skill)) GROUP BY jd_id)"""


REQUIREMENTS = f"""{JOB_TEXTS},{_section('must')},{_section('nice')},{_section('reject')},
parsed AS (
  SELECT jd_id, text,
    coalesce(trim(string_split(trim(nullif(regexp_extract(text, '(?im)^\\s*job description[^:\\n]*:(.*)$', 1), '')), '-')[1]),
             'Senior AI Engineer') AS title,
    'ml_engineer' AS role_family,
    CASE WHEN contains(lower(text), 'principal') OR contains(lower(text), 'staff') THEN 'staff+'
         WHEN contains(lower(text), 'senior') THEN 'senior'
         WHEN contains(lower(text), 'junior') OR contains(lower(text), 'fresher') THEN 'junior' ELSE 'mid' END AS seniority,
    coalesce(nullif(regexp_extract(text, '(?i)(\\d+)\\s*[-–to]+\\s*(\\d+)\\s*year', 1), '')::DOUBLE, 5.0) AS min_years,
    coalesce(nullif(regexp_extract(text, '(?i)(\\d+)\\s*[-–to]+\\s*(\\d+)\\s*year', 2), '')::DOUBLE, 9.0) AS max_years,
    coalesce(nullif(regexp_extract(text, '(?i)sub-?(\\d+)\\s*day', 1), '')::INT, 30) AS preferred_notice_days
  FROM jobs)"""

_BASE = f"{CAND},{ROLES},{CLAIMS},{ACTIVITY}"

SQL = {
    "profile_facts": f"""
WITH {_BASE} SELECT candidate_id, name, title || ' in ' || industry AS headline, location, country,
  round(years, 6) AS years, title AS current_title, company AS current_company,
  (SELECT count(*) FROM roles WHERE roles.k = cand.k) AS n_roles,
  (SELECT count(*) FROM claims WHERE claims.k = cand.k) AS n_skills,
  CASE WHEN nation % 4 <> 0 THEN 1 ELSE 0 END::BIGINT AS n_degrees FROM cand""",
    "skill_claims": f"""
WITH {_BASE} SELECT candidate_id, c.name, proficiency, endorsements, months AS duration_months,
  round(assessment, 6) AS assessment_score FROM claims c JOIN cand USING (k)""",
    "text_blob": f"""
WITH {_BASE}, parts AS (
  SELECT k, 0 AS o, 0 AS pos, title || ' in ' || industry AS part FROM cand
  UNION ALL SELECT k, 1, 0, summary FROM cand UNION ALL SELECT k, 2, 0, summary FROM cand
  UNION ALL SELECT k, 3, 0, title FROM cand UNION ALL SELECT k, 4, 0, title FROM cand
  UNION ALL SELECT k, 5, 0, industry FROM cand
  UNION ALL SELECT k, 6, pos * 4, title FROM roles UNION ALL SELECT k, 6, pos * 4 + 1, description FROM roles
  UNION ALL SELECT k, 6, pos * 4 + 2, description FROM roles UNION ALL SELECT k, 6, pos * 4 + 3, industry FROM roles
  UNION ALL SELECT k, 7, pos, name FROM claims
  UNION ALL SELECT k, 8, 0, {S.pick(sp.DEGREES, 'k % 4')} || ' Computer Science University ' || nation
            FROM cand WHERE nation % 4 <> 0)
SELECT candidate_id, string_agg(part, ' ' ORDER BY o, pos) AS blob
FROM parts JOIN cand USING (k) WHERE part <> '' GROUP BY candidate_id""",
    "role_signals": f"""
WITH {_BASE},{FAMILIES},{EMPLOYERS},{TRACK}
SELECT candidate_id, current_family, round(current_score, 6)::DOUBLE AS current_score,
  round(recent_score, 6)::DOUBLE AS recent_score, only_consulting, has_product_company, pure_management_track
FROM track""",
    "title_alignment": f"""
WITH {_BASE},{FAMILIES},{EMPLOYERS},{TRACK}
SELECT candidate_id, round(title_alignment, 6)::DOUBLE AS title_alignment FROM aligned JOIN cand USING (k)""",
    "experience_band": f"""
WITH {CAND} SELECT candidate_id, round({EXPERIENCE.format(lo='5.0', hi='9.0')}, 6)::DOUBLE AS experience_band FROM cand""",
    "location_score": f"WITH {CAND},{PLACES} SELECT candidate_id, location_score FROM places JOIN cand USING (k)",
    "honeypot_penalty": f"""
WITH {_BASE},{PENALTY} SELECT candidate_id, career_overflow, unproven_expertise, inverted_salary,
  signup_after_activity, coalesce(studied_after_start, false) AS studied_after_start, several_current_roles,
  round(penalty, 6) AS penalty FROM penalties""",
    "behavioural_multiplier": f"""
WITH {CAND},{ACTIVITY},{BEHAVIOUR} SELECT candidate_id, round(behavioural, 6) AS behavioural FROM behave""",
    "claim_trust": f"""
WITH RECURSIVE {_BASE},{EVIDENCE}
SELECT candidate_id, j.name, n AS norm, round(trust, 6)::DOUBLE AS trust, cluster, surface, padded, vision, speech
FROM judged j JOIN cand USING (k)""",
    "skill_dictionary": f"""
WITH RECURSIVE {_BASE}, raw AS (SELECT DISTINCT name AS skill FROM claims UNION SELECT p_name FROM part),
names AS (SELECT DISTINCT {S.norm('skill')} AS n FROM raw),{MATCHED}
SELECT skill, first(cluster ORDER BY ord) AS cluster, first(member ORDER BY ord) AS member
FROM raw JOIN hits ON hits.n = {S.norm('skill')} WHERE cluster <> 'ai_keyword_surface' GROUP BY skill""",
    "skill_evidence": f"""
WITH RECURSIVE {_BASE},{EVIDENCE}
SELECT candidate_id, {_CLUSTER_COLUMNS}, round(dominance, 6) AS dominance, round(stuff_ratio, 6) AS stuff_ratio,
  round(({' + '.join(lx.SCORED_CLUSTERS)}) / 7, 6) AS overall, round(skill_evidence, 9) AS skill_evidence
FROM evidence JOIN cand USING (k)""",
    "need_coverage": f"""
WITH RECURSIVE {_BASE}, names AS (SELECT DISTINCT {S.norm('name')} AS n FROM claims),
needs AS (SELECT ord, need, {S.norm('need')} AS m FROM ({S.values_of(_NEEDS)}) v(ord, need)),
near AS (SELECT DISTINCT n AS a, m AS b FROM names, needs
         WHERE 2.0 * least(length(n), length(m)) / (length(n) + length(m)) >= 0.88),
{S.lcs_ctes('near')},
covers AS (
  SELECT n, ord FROM names JOIN needs ON contains(n, m) OR contains(m, n) WHERE n <> ''
  UNION SELECT a, ord FROM lcs JOIN needs ON needs.m = lcs.b WHERE 200 * lcs >= 88 * (length(a) + length(b))),
got AS (SELECT DISTINCT k, ord FROM claims JOIN covers ON covers.n = {S.norm('name')})
SELECT candidate_id,
  coalesce(string_agg(need, '|' ORDER BY needs.ord) FILTER (got.ord IS NOT NULL), '') AS hits,
  coalesce(string_agg(need, '|' ORDER BY needs.ord) FILTER (got.ord IS NULL), '') AS misses
FROM cand CROSS JOIN needs LEFT JOIN got ON got.k = cand.k AND got.ord = needs.ord GROUP BY candidate_id""",
    "job_requirements": f"""
WITH {REQUIREMENTS}
SELECT jd_id, title, role_family, seniority, min_years, max_years, must.skills AS must, nice.skills AS nice,
  reject.skills AS reject, preferred_notice_days, 90 AS soft_notice_days
FROM parsed JOIN must USING (jd_id) JOIN nice USING (jd_id) JOIN reject USING (jd_id)""",
}
