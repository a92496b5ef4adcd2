"""Résumé parsing over texts derived from customers, orders and benchmark passages."""

from pyspark.sql import functions as F

from checks import profiles as P
from checks import sql as S
from matchlane import lexicons as lx
from matchlane.functions.binding import rows_of
from matchlane.operators import resume as RZ
from matchlane.operators.validation import validate
from matchlane.plans import sample_profiles as sp
from matchlane.plans.sample_profiles import resume_files, resumes
from matchlane.sources.profile_schema import profile_schema
from matchlane.sources.resumes import resume_texts


def parsed(spark, sf_dir):
    return RZ.parse_resumes(resumes(spark, sf_dir), P.today())


def sections(spark, sf_dir):
    return RZ.section_rows(resumes(spark, sf_dir))


def profiles(spark, sf_dir):
    return parsed(spark, sf_dir).select(
        "path", F.col("profile.anonymized_name").alias("name"), F.col("profile.headline").alias("headline"),
        F.col("profile.years_of_experience").alias("years"),
    )


def skills(spark, sf_dir):
    return rows_of(parsed(spark, sf_dir), ["path"], F.col("skills"), "s").select("path", "s.*")


def career(spark, sf_dir):
    rows = rows_of(parsed(spark, sf_dir), ["path"], F.col("career_history"), "r").select("path", "r.*")
    return rows.drop("industry", "company_size")


def education(spark, sf_dir):
    return rows_of(parsed(spark, sf_dir), ["path"], F.col("education"), "e").select(
        "path", "e.institution", "e.degree", "e.field_of_study", "e.start_year", "e.end_year"
    )


def family(spark, sf_dir):
    return resumes(spark, sf_dir).select("path", RZ.guess_family(F.col("text")).alias("family"))


def validity(spark, sf_dir):
    """Parsed résumés pass the profile schema."""
    record = F.to_json(F.struct("*"), {"ignoreNullFields": "false"})
    lines = parsed(spark, sf_dir).select("path", record.alias("value"))
    return validate(lines, profile_schema()).select("path", F.size("errors").alias("n_errors"))


def batch(spark, sf_dir):
    return RZ.batch_counts(resume_texts(resume_files(spark, sf_dir)))


def file_errors(spark, sf_dir):
    return resume_texts(resume_files(spark, sf_dir)).where("error IS NOT NULL").select("path", "error")


QUERIES = {
    "resume_sections": sections,
    "resume_profiles": profiles,
    "resume_skills": skills,
    "resume_career": career,
    "resume_education": education,
    "resume_role_family": family,
    "resume_validity": validity,
    "resume_batch": batch,
    "resume_file_errors": file_errors,
}

YEAR = int(sp.REFERENCE_DATE[:4])
_DEGREE = S.pick(sp.DEGREES, "k % 4")
TEXTS = f"""
{P.CAND},{P.ROLES},{P.CLAIMS},
role_lines AS (
  SELECT k, string_agg(title || {S.pick(sp.JOINERS, 'pos % 3')} || company || ', ' || start_year
      || CASE WHEN pos % 2 = 0 THEN ' - ' ELSE ' to ' END
      || CASE WHEN is_current THEN 'Present' ELSE (start_year + floor(months / 12)::INT)::VARCHAR END
      || chr(10) || description, chr(10) ORDER BY pos) AS body FROM roles GROUP BY k),
skill_lines AS (SELECT k, string_agg(name, ', ' ORDER BY pos) AS body FROM claims GROUP BY k),
cv AS (
  SELECT k, printf('resume_%07d.txt', k) AS path, concat_ws(chr(10), {S.pick(sp.NAMES, 'k % 6')},
    'person' || k || '@example.com', title || ' for hire', '', {S.pick(sp.SUMMARY_HEADINGS, 'k % 3')}, b.text,
    CASE WHEN k % 7 <> 3 THEN 'Work  Experience' || chr(10) || r.body END,
    chr(10) || 'Education' || chr(10) || CASE WHEN nation % 2 = 0
      THEN 'University ' || nation || ', ' || {_DEGREE} || ', Physics, ' || (1985 + k % 30 - 4) || ' - ' || (1985 + k % 30)
      ELSE 'College | ' || {_DEGREE} || ' ' || (1985 + k % 30) END,
    CASE WHEN k % 5 <> 2 THEN 'Skills:' || chr(10) || s.body || '; Go; sql • go' END) AS text
  FROM cand LEFT JOIN benchmark b ON b.item_id = k % (SELECT count(*) FROM benchmark)
  LEFT JOIN role_lines r USING (k) LEFT JOIN skill_lines s USING (k))"""

_HEADS = " ".join(
    f"WHEN regexp_matches(trim(line), {S.q(pattern)}) THEN '{name}'" for name, pattern in RZ.HEADINGS
)
_TRIM = "trim({}, ' ' || chr(9) || chr(10) || chr(13))"
SECTIONS = f"""
lines AS (
  SELECT k, path, i, parts[i] AS line
  FROM (SELECT k, path, string_split(text, chr(10)) AS parts, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM cv)),
headed AS (SELECT *, CASE {_HEADS} END AS head FROM lines),
placed AS (
  SELECT *, coalesce(last_value(head IGNORE NULLS) OVER (PARTITION BY k ORDER BY i), 'header') AS section FROM headed),
bodies AS (
  SELECT k, path, section, {_TRIM.format("coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (head IS NULL), '')")} AS body
  FROM placed GROUP BY k, path, section),
exper AS (SELECT cv.k, cv.path, coalesce(nullif(b.body, ''), cv.text) AS src
          FROM cv LEFT JOIN bodies b ON b.k = cv.k AND b.section = 'experience'),
learn AS (SELECT cv.k, cv.path, coalesce(nullif(b.body, ''), cv.text) AS src
          FROM cv LEFT JOIN bodies b ON b.k = cv.k AND b.section = 'education')"""

_RANGE = S.q(r"(?i)(\d{4})\s*(?:-|to)\s*(\d{4}|present|current)")
_END = f"CASE WHEN lower(e) IN ('present', 'current') THEN {YEAR} ELSE TRY_CAST(e AS INT) END"
YEARS = f"""
found AS (
  SELECT k, unnest(regexp_extract_all(src, {_RANGE}, 1))::INT AS s, unnest(regexp_extract_all(src, {_RANGE}, 2)) AS e FROM exper),
spans AS (
  SELECT DISTINCT k, s, least({_END}, {YEAR}) AS e FROM found WHERE s BETWEEN 1970 AND {YEAR + 1} AND s <= {_END}),
islands AS (
  SELECT *, sum(fresh) OVER (PARTITION BY k ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island
  FROM (SELECT *, CASE WHEN s <= max(e) OVER (PARTITION BY k ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
                  THEN 0 ELSE 1 END AS fresh FROM spans)),
totals AS (SELECT k, sum(len) AS years FROM (SELECT k, max(e) - min(s) AS len FROM islands GROUP BY k, island) GROUP BY k)"""

_DASHED = S.q(RZ.DASHES)
CAREER = f"""
exp_lines AS (
  SELECT k, path, i, parts[i] AS line FROM (
    SELECT k, path, string_split(src, chr(10)) AS parts, unnest(range(1, len(string_split(src, chr(10))) + 1)) AS i FROM exper)),
blocks AS (
  SELECT *, sum(regexp_matches(line, {_RANGE})::INT) OVER (PARTITION BY k ORDER BY i ROWS UNBOUNDED PRECEDING) AS block FROM exp_lines),
opened AS (
  SELECT k, path, block, regexp_extract(first(line ORDER BY i), {_RANGE}, 1)::INT AS s,
    regexp_extract(first(line ORDER BY i), {_RANGE}, 2) AS e,
    trim(regexp_replace(first(line ORDER BY i), {_RANGE}, '', 'g'), {_DASHED}) AS heading,
    coalesce(string_agg(trim(line), ' ' ORDER BY i) FILTER (NOT regexp_matches(line, {_RANGE}) AND trim(line) <> ''), '') AS described
  FROM blocks WHERE block > 0 GROUP BY k, path, block),
cut AS (
  SELECT *, CASE {' '.join(f"WHEN contains(heading, {S.q(sep)}) THEN [trim(substr(heading, 1, instr(heading, {S.q(sep)}) - 1)), trim(substr(heading, instr(heading, {S.q(sep)}) + {len(sep)}))]" for sep in RZ.SEPARATORS)}
    ELSE [heading, ''] END AS parts FROM opened),
career AS (
  SELECT path, k, coalesce(nullif(parts[2], ''), 'Unknown') AS company, coalesce(nullif(parts[1], ''), 'Professional') AS title,
    printf('%04d-01-01', s) AS start_date,
    CASE WHEN lower(e) NOT IN ('present', 'current') THEN printf('%04d-12-31', {_END}) END AS end_date,
    greatest(1, ({_END} - s) * 12)::BIGINT AS duration_months, lower(e) IN ('present', 'current') AS is_current,
    coalesce(nullif(substr(described, 1, 1500), ''), parts[1]) AS description,
    row_number() OVER (PARTITION BY k ORDER BY s DESC, block) AS place
  FROM cut)"""

_DOUBLED = "regexp_replace({}, '([^a-z0-9])', '\\1\\1', 'g')"
_VOCAB = [(m,) for m in sorted({m for _, ms in lx.SKILL_CLUSTERS for m in ms})]
SKILLS = f"""
hay AS (
  SELECT cv.k, cv.path, coalesce(b.body, '') AS block, lower(coalesce(b.body, '') || chr(10) || cv.text) AS h
  FROM cv LEFT JOIN bodies b ON b.k = cv.k AND b.section = 'skills'),
doubled AS (SELECT k, path, h, {_DOUBLED.format('h')} AS d FROM hay),
vocab AS (SELECT m, '(?:^|[^a-z0-9])' || regexp_escape({_DOUBLED.format('m')}) || '(?:$|[^a-z0-9])' AS pat
          FROM ({S.values_of(_VOCAB)}) v(m)),
counted AS (
  SELECT k, path, m AS name, len(regexp_extract_all(d, pat)) AS hits FROM doubled JOIN vocab ON contains(h, m)),
listed AS (
  SELECT k, path, t, nth FROM (
    SELECT k, path, {_TRIM.format('parts[i]')} AS t, i AS nth
    FROM (SELECT k, path, regexp_split_to_array(block, '[,;•\\n|]') AS parts,
                 unnest(range(1, len(regexp_split_to_array(block, '[,;•\\n|]')) + 1)) AS i FROM hay))
  WHERE length(t) BETWEEN 2 AND 30 AND regexp_full_match(t, '[A-Za-z0-9 .+#/-]+')),
fresh AS (
  SELECT k, path, first(t ORDER BY nth) AS name, 1 AS hits FROM listed
  WHERE NOT EXISTS (SELECT 1 FROM counted c WHERE c.k = listed.k AND c.hits > 0 AND c.name = lower(t)) GROUP BY k, path, lower(t)),
skilled AS (
  SELECT *, row_number() OVER (PARTITION BY k ORDER BY hits DESC, name) AS place
  FROM (SELECT * FROM counted WHERE hits > 0 UNION ALL SELECT * FROM fresh))"""

_KEYWORDS = [(kw, fam, w, i) for i, (fam, w, kw) in enumerate((f, w, kw) for f, w, kws in lx.ROLE_FAMILIES for kw in kws)]
_TITLED = "NOT regexp_matches(line, '(^|[^\\pL])\\p{Ll}') AND NOT regexp_matches(line, '\\pL\\p{Lu}')"

SQL = {
    "resume_sections": f"WITH {TEXTS},{SECTIONS} SELECT path, section, body FROM bodies",
    "resume_profiles": f"""
WITH {TEXTS},{SECTIONS},{YEARS},
tops AS (
  SELECT k, i, trim(line) AS line, regexp_split_to_array(trim(line), '\\s+') AS words FROM placed
  WHERE section = 'header' AND i <= 8 AND trim(line) <> ''),
named AS (
  SELECT k, first(line ORDER BY i) AS name FROM (
    SELECT *, len(list_filter(words, lambda w: regexp_matches(w, '^\\p{{Lu}}'))) AS caps FROM tops)
  WHERE len(words) BETWEEN 2 AND 5 AND NOT regexp_matches(line, '[0-9]') AND NOT contains(line, '@')
    AND ((caps >= greatest(2, len(words) - 1) AND {_TITLED}) OR caps = len(words)) GROUP BY k),
lead AS (
  SELECT t.k, first(line ORDER BY i) AS line FROM tops t LEFT JOIN named n USING (k)
  WHERE line <> coalesce(n.name, 'Anonymous Candidate') AND NOT contains(line, '@') AND length(line) BETWEEN 12 AND 120 GROUP BY t.k)
SELECT path, coalesce(name, 'Anonymous Candidate') AS name, line AS headline, coalesce(years, 0)::DOUBLE AS years
FROM cv LEFT JOIN named USING (k) LEFT JOIN lead USING (k) LEFT JOIN totals USING (k)""",
    "resume_skills": f"""
WITH {TEXTS},{SECTIONS},{SKILLS}
SELECT path, name, CASE WHEN hits >= 4 THEN 'expert' WHEN hits >= 2 THEN 'advanced' ELSE 'intermediate' END AS proficiency,
  least(50, hits * 3)::BIGINT AS endorsements, least(120, hits * 6)::BIGINT AS duration_months FROM skilled WHERE place <= 40""",
    "resume_career": f"""
WITH {TEXTS},{SECTIONS},{YEARS},{CAREER},
kept AS (SELECT * FROM career WHERE place <= 10)
SELECT path, company, title, start_date, end_date, duration_months, is_current, description FROM kept
UNION ALL
SELECT path, 'Independent', 'Professional', greatest(1990, {YEAR} - greatest(1, coalesce(years, 0))) || '-01-01', NULL,
  greatest(1, ({YEAR} - greatest(1990, {YEAR} - greatest(1, coalesce(years, 0)))) * 12), true, 'Professional'
FROM cv LEFT JOIN totals USING (k) WHERE k NOT IN (SELECT k FROM kept)""",
    "resume_education": f"""
WITH {TEXTS},{SECTIONS},
edu AS (
  SELECT k, path, i, trim(parts[i]) AS line FROM (
    SELECT k, path, string_split(src, chr(10)) AS parts, unnest(range(1, len(string_split(src, chr(10))) + 1)) AS i FROM learn)),
dated AS (
  SELECT *, row_number() OVER (PARTITION BY k ORDER BY i) AS place, regexp_extract(line, {_RANGE}, 1) AS s,
    regexp_extract(line, {_RANGE}, 2) AS e, regexp_extract(line, '\\b((?:19|20)\\d{{2}})\\b', 1) AS one,
    list_filter(list_transform(regexp_split_to_array(trim(regexp_replace(line, {_RANGE}, '', 'g'), {_DASHED}), '[,|•]'),
      lambda p: trim(p)), lambda p: p <> '') AS parts
  FROM edu WHERE regexp_matches(line, {_RANGE}) OR regexp_matches(line, '\\b(19|20)\\d{{2}}\\b'))
SELECT path, coalesce(parts[1], 'Unknown') AS institution, coalesce(parts[2], 'Degree') AS degree,
  coalesce(parts[3], parts[2], 'General') AS field_of_study,
  CASE WHEN s <> '' THEN s::BIGINT ELSE greatest(1970, one::BIGINT - 4) END AS start_year,
  CASE WHEN s <> '' THEN {_END}::BIGINT ELSE one::BIGINT END AS end_year FROM dated WHERE place <= 5""",
    "resume_role_family": f"""
WITH {TEXTS}, hits AS (
  SELECT path, fam, ord, (length(lower(text)) - length(replace(lower(text), kw, ''))) / length(kw) * length(kw) * w AS score
  FROM cv JOIN ({S.values_of(_KEYWORDS)}) v(kw, fam, w, ord) ON contains(lower(text), kw)),
best AS (SELECT path, first(fam ORDER BY score DESC, ord) AS family FROM hits WHERE score > 0 GROUP BY path)
SELECT path, coalesce(family, '') AS family FROM cv LEFT JOIN best USING (path)""",
    "resume_validity": f"WITH {TEXTS} SELECT path, 0 AS n_errors FROM cv",
    "resume_batch": """
SELECT count(*) AS n_uploaded, count(*) FILTER (c_custkey % 10 NOT IN (7, 8)) AS n_parsed,
  count(*) FILTER (c_custkey % 10 IN (7, 8)) AS n_failed FROM customer""",
    "resume_file_errors": """
SELECT printf('resume_%07d', c_custkey) || CASE WHEN c_custkey % 10 = 7 THEN '.xyz' ELSE '.txt' END AS path,
  CASE WHEN c_custkey % 10 = 7 THEN 'unsupported resume format .xyz' ELSE 'empty file upload' END AS error
FROM customer WHERE c_custkey % 10 IN (7, 8)""",
}
