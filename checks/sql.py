"""DuckDB building blocks: the rules once more, as relational SQL."""

from matchlane import lexicons as lx
from matchlane.plans import sample_profiles as sp


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def text_list(values) -> str:
    return "[" + ", ".join(q(v) for v in values) + "]"


def values_of(rows) -> str:
    def cell(v):
        return q(v) if isinstance(v, str) else str(v)

    return "VALUES " + ", ".join("(" + ", ".join(cell(v) for v in row) + ")" for row in rows)


def pick(values, position: str) -> str:
    return f"({text_list(values)})[({position}) + 1]"


def half_even(x: str, digits: int) -> str:
    return f"(round_even(round(({x}) * {10 ** digits}, 6), 0) / {10 ** digits})"


def clip(x: str, low, high) -> str:
    return f"greatest({low}, least({high}, {x}))"


def contains_any(x: str, words) -> str:
    return "(" + " OR ".join(f"contains({x}, {q(w)})" for w in words) + ")"


def norm(x: str) -> str:
    """Normalised text (RE2 has ASCII word boundaries, so the year's neighbours are captured)."""
    return (
        f"trim(regexp_replace(regexp_replace(lower(coalesce({x}, '')), '\\b\\d{{4}}\\b', ' ', 'g'), "
        f"'[^a-z0-9+#./-]+', ' ', 'g'))"
    )


def tokens(source: str, key: str, text: str) -> str:
    """Rows (key, term) for every token of a table's text."""
    stop = ", ".join(q(w) for w in lx.STOPWORDS)
    return f"""
  SELECT {key}, term FROM (
    SELECT s.{key} AS {key}, coalesce(syn.canon, s.raw) AS term
    FROM (SELECT {key}, unnest(string_split({norm(text)}, ' ')) AS raw FROM {source}) s
    LEFT JOIN ({values_of(lx.SYNONYMS.items())}) syn(alias, canon) ON syn.alias = s.raw
  ) WHERE length(term) >= 2 AND term NOT IN ({stop})"""


def index_ctes(docs: str, key: str, text: str, prefix: str = "") -> str:
    p = prefix
    return f"""
{p}tok AS ({tokens(docs, key, text)}),
{p}post AS (SELECT {key} AS d, term, count(*) AS tf FROM {p}tok GROUP BY ALL),
{p}terms AS (SELECT term, count(*) AS df FROM {p}post GROUP BY term),
{p}corpus AS (
  SELECT (SELECT count(*) FROM {docs}) AS n,
         (SELECT count(*) FROM {p}tok) / (SELECT count(*) FROM {docs})::DOUBLE AS avgdl),
{p}idf AS (
  SELECT term, df, ln(n - df + 0.5) - ln(df + 0.5) AS raw_idf,
         CASE WHEN df >= 2 AND df <= 0.85 * n THEN ln((1.0 + n) / (1.0 + df)) + 1.0 END AS smooth
  FROM {p}terms, {p}corpus),
{p}okapi AS (
  SELECT term, CASE WHEN raw_idf < 0 THEN 0.25 * (SELECT avg(raw_idf) FROM {p}idf) ELSE raw_idf END AS idf
  FROM {p}idf),
{p}dl AS (SELECT d, sum(tf) AS dl FROM {p}post GROUP BY d),
{p}norms AS (
  SELECT d, sqrt(sum(pow((1 + ln(tf)) * smooth, 2))) AS norm
  FROM {p}post JOIN {p}idf USING (term) WHERE smooth IS NOT NULL GROUP BY d)"""


def scores_ctes(jobs: str, jd_key: str, text: str, prefix: str = "") -> str:
    """Adds {prefix}pairs(jd, d, bm25, cosine) for pairs sharing a term."""
    p = prefix
    return f"""
{p}qt AS (SELECT {jd_key} AS jd, term, count(*) AS qtf FROM ({tokens(jobs, jd_key, text)}) GROUP BY ALL),
{p}qn AS (
  SELECT jd, sqrt(sum(pow((1 + ln(qtf)) * smooth, 2))) AS qnorm
  FROM {p}qt JOIN {p}idf USING (term) WHERE smooth IS NOT NULL GROUP BY jd),
{p}pairs AS (
  SELECT qt.jd, post.d,
         sum(qt.qtf * okapi.idf * post.tf * 2.5 / (post.tf + 1.5 * (0.25 + 0.75 * dl.dl / c.avgdl))) AS bm25,
         coalesce(sum((1 + ln(qt.qtf)) * idf.smooth * (1 + ln(post.tf)) * idf.smooth)
                  / any_value(qn.qnorm) / any_value(norms.norm), 0.0) AS cosine
  FROM {p}qt qt JOIN {p}post post USING (term) JOIN {p}okapi okapi USING (term) JOIN {p}idf idf USING (term)
  JOIN {p}dl dl ON dl.d = post.d CROSS JOIN {p}corpus c
  LEFT JOIN {p}qn qn ON qn.jd = qt.jd LEFT JOIN {p}norms norms ON norms.d = post.d
  GROUP BY qt.jd, post.d)"""


def hybrid_ctes(prefix: str = "") -> str:
    p = prefix
    return f"""
{p}span AS (
  SELECT jd,
         CASE WHEN count(*) < any_value(n) THEN least(min(bm25), 0) ELSE min(bm25) END AS blo,
         CASE WHEN count(*) < any_value(n) THEN greatest(max(bm25), 0) ELSE max(bm25) END AS bhi,
         CASE WHEN count(*) < any_value(n) THEN least(min(cosine), 0) ELSE min(cosine) END AS clo,
         CASE WHEN count(*) < any_value(n) THEN greatest(max(cosine), 0) ELSE max(cosine) END AS chi
  FROM {p}pairs, {p}corpus GROUP BY jd),
{p}hybrid AS (
  SELECT jd, d, bm25, cosine,
         0.6 * CASE WHEN bhi > blo THEN (bm25 - blo) / (bhi - blo) ELSE 0 END
         + 0.4 * CASE WHEN chi > clo THEN (cosine - clo) / (chi - clo) ELSE 0 END AS semantic
  FROM {p}pairs JOIN {p}span USING (jd))"""


def lcs_ctes(pairs: str, prefix: str = "") -> str:
    """Longest common subsequence of ``pairs(a, b)``, filled cell by cell."""
    p = prefix
    return f"""
{p}cells AS (
  SELECT a, b, 1 AS i, 1 AS j, list_transform(range(length(b) + 1), lambda x: 0::BIGINT) AS up, [0::BIGINT] AS row
  FROM (SELECT DISTINCT a, b FROM {pairs} WHERE a <> '' AND b <> '')
  UNION ALL
  SELECT a, b,
         CASE WHEN j = length(b) THEN i + 1 ELSE i END,
         CASE WHEN j = length(b) THEN 1 ELSE j + 1 END,
         CASE WHEN j = length(b) THEN list_append(row, nxt) ELSE up END,
         CASE WHEN j = length(b) THEN [0::BIGINT] ELSE list_append(row, nxt) END
  FROM (
    SELECT *, CASE WHEN substr(a, i, 1) = substr(b, j, 1) THEN up[j] + 1 ELSE greatest(up[j + 1], row[j]) END AS nxt
    FROM {p}cells WHERE i <= length(a))),
{p}lcs AS (SELECT a, b, up[length(b) + 1] AS lcs FROM {p}cells WHERE i = length(a) + 1 AND j = 1)"""
