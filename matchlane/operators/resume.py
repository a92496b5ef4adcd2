"""Plain-text résumés -> raw profile rows.

A résumé is one row from start to end: lines, sections, spans and roles are
arrays inside the row, so no line is ever shuffled.  ``today`` is a required
date: "present" must not change with the calendar.
"""

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from matchlane.functions.binding import rows_of
from matchlane.functions.dates import month_start_before
from matchlane.lexicons import ROLE_FAMILIES, SKILL_CLUSTERS
from matchlane.operators.joins import with_ordinal

SPACE = " \t\n\r\u000b\f"
DASHES = " -–|,"

# Section headings, contact and date patterns, limits, defaults.
HEADINGS = [
    ("summary", r"(?i)^\s*(?:professional\s+)?(summary|profile|about)\s*[:\-]?\s*$"),
    (
        "experience",
        r"(?i)^\s*(work\s+experience|experience|employment|career\s+history|professional\s+experience)\s*[:\-]?\s*$",
    ),
    ("education", r"(?i)^\s*(education|academic|qualifications)\s*[:\-]?\s*$"),
    ("skills", r"(?i)^\s*(skills|technical\s+skills|tech\s+stack|core\s+competencies)\s*[:\-]?\s*$"),
    ("certifications", r"(?i)^\s*(certifications|certificates|licenses)\s*[:\-]?\s*$"),
    ("languages", r"(?i)^\s*(languages)\s*[:\-]?\s*$"),
]
# All headings in one pattern that is tried at the start of a line only.
_BEFORE, _AFTER = r"(?i)^\s*", r"\s*[:\-]?\s*$"
ANY_HEADING = f"{_BEFORE}(?:{'|'.join(pattern.removeprefix(_BEFORE).removesuffix(_AFTER) for _, pattern in HEADINGS)}){_AFTER}"
EMAIL = r"[\w.+-]+@[\w-]+\.[\w.-]+"
PHONE = r"(?:\+?\d{1,3}[\s-])?\(?\d{3,4}\)?[\s.-]?\d{3}[\s.-]?\d{3,4}"
YEAR_RANGE = r"(?i)(\d{4})\s*(?:-|to)\s*(\d{4}|present|current)"
YEAR_RANGE_EN_DASH = r"(?i)(\d{4})\s*(?:-|–|to)\s*(\d{4}|present|current)"
SINGLE_YEAR = r"\b((?:19|20)\d{2})\b"
SEPARATORS = [" at ", " @ ", ", ", " | ", " - ", " – "]
MAX_ROLES, MAX_DEGREES, MAX_SKILLS = 10, 5, 40
ANONYMOUS = "Anonymous Candidate"


def _strip(text: Column) -> Column:
    return F.btrim(text, F.lit(SPACE))


def _strip_dashes(text: Column) -> Column:
    return F.btrim(text, F.lit(DASHES))


def _lines(text: Column) -> Column:
    return F.split(text, r"\R")


def _matches(text: Column, pattern: str) -> Column:
    return text.rlike(pattern)


def _heading(line: Column) -> Column:
    branch = F
    for name, pattern in HEADINGS:
        branch = branch.when(_matches(line, pattern), F.lit(name))
    return F.when(_matches(line, ANY_HEADING), branch.otherwise(F.lit(None)))


def with_sections(resumes: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``sections map<string,string>``: lines belong to the last heading seen, ``header`` before any.

    Heading positions split the line array; a section named twice is joined.
    """
    marked = (
        resumes.withColumn("_lines", _lines(F.col(text)))
        .withColumn("_named", F.transform("_lines", lambda ln: _heading(_strip(ln))))
        .withColumn(
            "_heads",
            F.filter(
                F.concat(
                    F.array(F.struct(F.lit(-1).alias("at"), F.lit("header").alias("name"))),
                    F.transform("_named", lambda n, i: F.struct(i.alias("at"), n.alias("name"))),
                ),
                lambda h: h["name"].isNotNull(),
            ),
        )
    )

    def block(head: Column, i: Column) -> Column:
        following = F.coalesce(F.get("_heads", i + 1)["at"], F.size("_lines"))
        return F.struct(
            head["name"].alias("name"),
            F.slice("_lines", head["at"] + 2, F.greatest(following - head["at"] - 1, F.lit(0))).alias("lines"),
        )

    names = ["header", *[name for name, _ in HEADINGS]]
    with_blocks = marked.withColumn("_blocks", F.transform("_heads", block))

    def section(name: str) -> Column:
        of_name = F.filter("_blocks", lambda b: b["name"] == name)
        lines = F.flatten(F.transform(of_name, lambda b: b["lines"]))
        return F.when(F.size(of_name) > 0, _strip(F.array_join(lines, "\n")))

    sections = F.create_map(*[x for n in names for x in (F.lit(n), section(n))])
    return with_blocks.withColumn("sections", sections).drop("_lines", "_named", "_heads", "_blocks")


def _section(name: str) -> Column:
    return F.coalesce(F.element_at("sections", F.lit(name)), F.lit(""))


def _or_else(first: Column, second: Column) -> Column:
    return F.when(first != "", first).otherwise(second)


def _is_contact(line: Column) -> Column:
    return _matches(line, EMAIL) | _matches(line, PHONE)


def _looks_like_name(line: Column) -> Column:
    """Two to five words without digits, nearly all capitalised."""
    words = F.split(line, r"\s+")
    n = F.size(words)
    capitals = F.size(F.filter(words, lambda w: _matches(w, r"^\p{Lu}")))
    titled = ~_matches(line, r"(?<!\p{L})\p{Ll}|(?<=\p{L})\p{Lu}")
    return (
        (line != "")
        & ~_is_contact(line)
        & n.between(2, 5)
        & ~_matches(line, r"\p{Nd}")
        & (((capitals >= F.greatest(F.lit(2), n - 1)) & titled) | (capitals == n))
    )


def person_name(header: Column) -> Column:
    top = F.transform(F.slice(_lines(header), 1, 8), _strip)
    return F.coalesce(F.get(F.filter(top, _looks_like_name), 0), F.lit(ANONYMOUS))


def headline(header: Column, summary: Column, name: Column) -> Column:
    """First other line of 12 to 120 characters, else the first summary sentence."""
    fitting = F.filter(
        F.transform(_lines(header), _strip),
        lambda ln: (ln != name) & ~_is_contact(ln) & F.length(ln).between(12, 120),
    )
    sentence = F.substring(_strip(F.get(F.split(summary, r"[.\n]", 2), 0)), 1, 120)
    return F.coalesce(F.get(fitting, 0), F.nullif(sentence, F.lit("")), F.lit("Professional"))


def first_paragraph(text: Column) -> Column:
    """First paragraph of 40 to 1200 characters, else the first 600 characters."""
    paragraphs = F.transform(F.split(text, r"\n\s*\n"), _strip)
    fitting = F.get(F.filter(paragraphs, lambda p: F.length(p).between(40, 1200)), 0)
    return F.coalesce(fitting, F.substring(_strip(text), 1, 600))


def _end_year(text: Column, today: Column) -> Column:
    return F.when(F.lower(text).isin("present", "current"), F.year(today)).otherwise(text.try_cast("int"))


def year_spans(text: Column, today: Column, pattern: str = YEAR_RANGE) -> Column:
    """Plausible year ranges of a text, sorted: ``array<struct<s, e>>``."""
    pairs = F.arrays_zip(
        F.regexp_extract_all(text, F.lit(pattern), F.lit(1)).alias("s"),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(2)).alias("e"),
    )
    spans = F.transform(
        pairs, lambda p: F.struct(p["s"].try_cast("int").alias("s"), _end_year(p["e"], today).alias("e"))
    )
    plausible = F.filter(spans, lambda p: p["s"].between(1970, F.year(today) + 1) & (p["s"] <= p["e"]))
    return F.sort_array(
        F.transform(
            plausible, lambda p: F.struct(p["s"].alias("s"), F.least(p["e"], F.year(today)).alias("e"))
        )
    )


def covered_years(spans: Column) -> Column:
    """Total length of the union of sorted spans: one pass with the furthest end so far."""

    def extend(acc: Column, p: Column) -> Column:
        joins = acc["end"].isNotNull() & (p["s"] <= acc["end"])
        furthest = F.greatest(acc["end"], p["e"])
        return F.struct(
            (acc["total"] + F.when(joins, furthest - acc["end"]).otherwise(p["e"] - p["s"])).alias("total"),
            F.when(joins, furthest).otherwise(p["e"]).alias("end"),
        )

    start = F.struct(F.lit(0).alias("total"), F.lit(None).cast("int").alias("end"))
    return F.aggregate(spans, start, extend, lambda acc: acc["total"].cast("double"))


def _vocabulary() -> list[str]:
    """Distinct lexicon skills, longest first."""
    return sorted({m for _, members in SKILL_CLUSTERS for m in members}, key=lambda m: (-len(m), m))


_SKILLS = _vocabulary()
_ALNUM = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789")
_RUN = re.compile("[A-Za-z0-9]+")
# Places of the skills by their first run of letters and digits, which is one of the text's where a skill stands alone.
_BY_RUN: dict[str, list[int]] = {}
for _at, _skill in enumerate(_SKILLS):
    _BY_RUN.setdefault((_RUN.findall(_skill) or [""])[0], []).append(_at)


def _standing_alone(text: str, word: str) -> int:
    """Occurrences of ``word`` without an ASCII letter or digit on either side, from the left without overlaps."""
    n, at = 0, text.find(word)
    while at >= 0:
        end = at + len(word)
        alone = (at == 0 or text[at - 1] not in _ALNUM) and (end == len(text) or text[end] not in _ALNUM)
        n += alone
        at = text.find(word, end if alone else at + 1)
    return n


@F.arrow_udf(T.ArrayType(T.StructType([T.StructField("hits", T.IntegerType()), T.StructField("name", T.StringType())])))
def _mentions(haystack: pa.Array) -> pa.Array:
    """The lexicon skills that a text names, longest names first, with their counts."""

    def found(text: str | None) -> list[dict] | None:
        if text is None:
            return []
        runs = _BY_RUN.keys() & {"", *_RUN.findall(text)}
        named = (_SKILLS[at] for at in sorted(at for run in runs for at in _BY_RUN[run]))
        hits = ((_standing_alone(text, skill), skill) for skill in named if skill in text)
        return [{"hits": n, "name": skill} for n, skill in hits if n]

    return pa.array(map(found, haystack.to_pylist()), pa.list_(pa.struct([("hits", pa.int32()), ("name", pa.string())])))


def with_skills(resumes: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``skills``: lexicon hits and free entries of the skills section, most mentioned first.

    The skills section counts on top of the whole text.
    """
    prepared = resumes.withColumn(
        "_haystack", F.lower(F.concat(_section("skills"), F.lit("\n"), F.col(text)))
    ).withColumn(
        "_listed",
        F.filter(
            F.transform(F.split(_section("skills"), r"[,;•\n|]"), _strip),
            lambda t: F.length(t).between(2, 30) & _matches(t, r"^[A-Za-z0-9 .+#/\-]+$"),
        ),
    )
    counted = prepared.withColumn("_hits", _mentions("_haystack")).withColumn("_lowered", F.transform("_listed", F.lower))
    known = F.transform("_hits", lambda h: h["name"])
    free = F.filter(
        F.transform("_listed", lambda t, i: F.struct(t.alias("name"), i.alias("i"))),
        lambda t: ~F.array_contains(known, F.lower(t["name"]))
        & (F.array_position("_lowered", F.lower(t["name"])) == t["i"] + 1),
    )
    ranked = F.sort_array(
        F.concat(
            F.transform("_hits", lambda h: F.struct((-h["hits"]).alias("order"), h["name"].alias("name"))),
            F.transform(free, lambda t: F.struct(F.lit(-1).alias("order"), t["name"].alias("name"))),
        )
    )

    def claim(r: Column) -> Column:
        hits = -r["order"]
        return F.struct(
            r["name"].alias("name"),
            F.when(hits >= 4, "expert").when(hits >= 2, "advanced").otherwise("intermediate").alias("proficiency"),
            F.least(F.lit(50), hits * 3).cast("bigint").alias("endorsements"),
            F.least(F.lit(120), hits * 6).cast("bigint").alias("duration_months"),
        )

    return counted.withColumn("skills", F.transform(F.slice(ranked, 1, MAX_SKILLS), claim)).drop(
        "_haystack", "_listed", "_hits", "_lowered"
    )


def with_career(resumes: DataFrame, source: Column, today: Column, pattern: str = YEAR_RANGE) -> DataFrame:
    """Adds ``career_history``: a line with a year range opens a role, the lines up to the next describe it."""
    lined = resumes.withColumn("_lines", _lines(source)).withColumn(
        "_anchors",
        F.filter(F.transform("_lines", lambda ln, i: F.when(_matches(ln, pattern), i)), lambda i: i.isNotNull()),
    )

    def opened(at: Column, n: Column) -> Column:
        line = F.get("_lines", at)
        until = F.coalesce(F.get("_anchors", n + 1), F.size("_lines"))
        body = F.transform(F.slice("_lines", at + 2, F.greatest(until - at - 1, F.lit(0))), _strip)
        return F.struct(
            F.regexp_extract(line, pattern, 1).try_cast("int").alias("start"),
            F.regexp_extract(line, pattern, 2).alias("until"),
            _strip_dashes(F.regexp_replace(line, pattern, "")).alias("heading"),
            F.concat_ws(" ", F.filter(body, lambda ln: ln != "")).alias("described"),
            n.alias("n"),
        )

    def split_heading(o: Column) -> Column:
        branch = F
        for sep in SEPARATORS:
            at = F.locate(sep, o["heading"])
            branch = branch.when(
                at > 0,
                F.struct(
                    _strip(F.substr(o["heading"], F.lit(1), at - 1)).alias("title"),
                    _strip(F.substr(o["heading"], at + len(sep))).alias("company"),
                ),
            )
        return branch.otherwise(F.struct(o["heading"].alias("title"), F.lit("").alias("company")))

    def role(o: Column, named: Column) -> Column:
        current = F.lower(o["until"]).isin("present", "current")
        end = _end_year(o["until"], today)
        return F.struct(
            _or_else(named["company"], F.lit("Unknown")).alias("company"),
            _or_else(named["title"], F.lit("Professional")).alias("title"),
            F.concat(F.lpad(o["start"].cast("string"), 4, "0"), F.lit("-01-01")).alias("start_date"),
            F.when(~current, F.concat(F.lpad(end.cast("string"), 4, "0"), F.lit("-12-31"))).alias("end_date"),
            F.greatest(F.lit(1), (end - o["start"]) * 12).cast("bigint").alias("duration_months"),
            current.alias("is_current"),
            F.lit("Technology").alias("industry"),
            F.lit("201-500").alias("company_size"),
            _or_else(F.substring(o["described"], 1, 1500), named["title"]).alias("description"),
        )

    opened_roles = lined.withColumn("_opened", F.transform("_anchors", opened))
    named_roles = opened_roles.withColumn("_heads", F.transform("_opened", split_heading))
    roles = F.transform("_opened", lambda o: role(o, F.get("_heads", o["n"])))
    return (
        named_roles.withColumn("_roles", roles)
        .withColumn(
            "_order",
            F.sort_array(
                F.transform(
                    "_roles",
                    lambda r, i: F.struct((-F.substring(r["start_date"], 1, 4).cast("int")).alias("k"), i.alias("i")),
                )
            ),
        )
        .withColumn(
            "career_history", F.transform(F.slice("_order", 1, MAX_ROLES), lambda x: F.get("_roles", x["i"]))
        )
        .drop("_lines", "_anchors", "_opened", "_heads", "_roles", "_order")
    )


def with_education(resumes: DataFrame, source: Column, today: Column, pattern: str = YEAR_RANGE) -> DataFrame:
    """Adds ``education``: the first five lines that carry a year range or a single year."""
    dated = resumes.withColumn(
        "_dated",
        F.slice(
            F.filter(
                F.transform(_lines(source), _strip), lambda ln: _matches(ln, pattern) | _matches(ln, SINGLE_YEAR)
            ),
            1,
            MAX_DEGREES,
        ),
    ).withColumn(
        "_parts",
        F.transform(
            "_dated",
            lambda ln: F.filter(
                F.transform(F.split(_strip_dashes(F.regexp_replace(ln, pattern, "")), r"[,|•]"), _strip),
                lambda p: p != "",
            ),
        ),
    )

    def degree(line: Column, i: Column) -> Column:
        parts = F.get("_parts", i)
        ranged = _matches(line, pattern)
        single = F.regexp_extract(line, SINGLE_YEAR, 1).try_cast("int")
        first = F.regexp_extract(line, pattern, 1).try_cast("int")
        start = F.when(ranged, first).otherwise(F.greatest(F.lit(1970), single - 4))
        end = F.when(ranged, _end_year(F.regexp_extract(line, pattern, 2), today)).otherwise(single)
        return F.struct(
            F.coalesce(F.get(parts, 0), F.lit("Unknown")).alias("institution"),
            F.coalesce(F.get(parts, 1), F.lit("Degree")).alias("degree"),
            F.coalesce(F.get(parts, 2), F.get(parts, 1), F.lit("General")).alias("field_of_study"),
            start.cast("bigint").alias("start_year"),
            end.cast("bigint").alias("end_year"),
            F.lit(None).cast("string").alias("grade"),
            F.lit("unknown").alias("tier"),
        )

    return dated.withColumn("education", F.transform("_dated", degree)).drop("_dated", "_parts")


_KEYWORDS = [(kw, family, len(kw) * weight) for family, weight, kws in ROLE_FAMILIES for kw in kws]


@F.arrow_udf(T.StringType())
def _best_family(lowered: pa.Array) -> pa.Array:
    def best(text: str | None) -> str:
        found, top = "", 0.0
        for keyword, family, worth in _KEYWORDS:  # of equal scores the first counts
            score = (text or "").count(keyword) * worth
            if score > top:
                found, top = family, score
        return found

    return pa.array(map(best, lowered.to_pylist()), pa.string())


def guess_family(text: Column) -> Column:
    """Family of the keyword with the highest count x length x weight; empty when none scores above 0."""
    return _best_family(F.lower(text))


def parse_resumes(
    resumes: DataFrame, today: Column, text: str = "text", candidate_id: Column | None = None, en_dash: bool = False
) -> DataFrame:
    """``resumes(path, text)`` -> rows with the raw profile schema (plus ``path``).

    Ids default to the place in path order, from 1.
    """
    pattern = YEAR_RANGE_EN_DASH if en_dash else YEAR_RANGE
    if candidate_id is None:
        resumes = with_ordinal(resumes, ["path"], "_ordinal")
        candidate_id = F.format_string("CAND_%07d", F.col("_ordinal") + 1)
    whole = F.col(text)
    experience = _or_else(_section("experience"), whole)
    read = with_sections(resumes, text).withColumn("_header", _or_else(_section("header"), whole))
    read = read.withColumn("_summary", _or_else(_section("summary"), first_paragraph(whole)))
    read = read.withColumn("_name", person_name(F.col("_header")))
    read = read.withColumns(
        {
            "_headline": headline(_section("header"), F.col("_summary"), person_name(_section("header"))),
            "_years": covered_years(year_spans(experience, today, pattern)),
        }
    )
    read = with_skills(read, text)
    read = with_career(read, experience, today, pattern)
    read = with_education(read, _or_else(_section("education"), whole), today, pattern)
    career = F.col("career_history")
    current = F.coalesce(F.get(F.filter(career, lambda r: r["is_current"]), 0), F.get(career, 0))
    read = read.withColumn("_current", current)
    now = F.col("_current")
    title = F.coalesce(_or_else(now["title"], F.lit("Professional")), F.lit("Professional"))
    company = F.when(now.isNull(), F.lit("Independent")).otherwise(_or_else(now["company"], F.lit("Unknown")))
    read = read.withColumns(
        {
            "_title": title,
            "_company": company,
            "_size": F.when(now.isNull(), F.lit("1-10")).otherwise(now["company_size"]),
        }
    )
    years = F.col("_years")
    began = F.greatest(F.lit(1990), F.year(today) - F.greatest(F.lit(1), years.cast("int")))
    placeholder = F.struct(
        F.col("_company").alias("company"),
        F.col("_title").alias("title"),
        F.concat(began.cast("string"), F.lit("-01-01")).alias("start_date"),
        F.lit(None).cast("string").alias("end_date"),
        F.greatest(F.lit(1), (F.year(today) - began) * 12).cast("bigint").alias("duration_months"),
        F.lit(True).alias("is_current"),
        F.lit("Technology").alias("industry"),
        F.lit("201-500").alias("company_size"),
        F.col("_title").alias("description"),
    )
    assessed = F.map_from_entries(
        F.transform(
            F.slice("skills", 1, 10),
            lambda s: F.struct(s["name"], F.least(F.lit(95.0), 50.0 + s["endorsements"]).cast("double")),
        )
    )
    endorsed = F.aggregate("skills", F.lit(0).cast("bigint"), lambda a, s: a + s["endorsements"])
    whole_years = years.cast("int")

    def at_least(floor: int, x: Column) -> Column:
        return F.greatest(F.lit(floor), x).cast("double")

    # The activity every parsed résumé starts with.
    signals = {
        "profile_completeness_score": F.lit(75.0),
        "signup_date": month_start_before(today, 18),
        "last_active_date": F.date_format(today, "yyyy-MM-dd"),
        "open_to_work_flag": F.lit(True),
        "profile_views_received_30d": F.lit(25).cast("bigint"),
        "applications_submitted_30d": F.lit(5).cast("bigint"),
        "recruiter_response_rate": F.lit(0.6),
        "avg_response_time_hours": F.lit(12.0),
        "skill_assessment_scores": assessed,
        "connection_count": F.lit(250).cast("bigint"),
        "endorsements_received": endorsed,
        "notice_period_days": F.lit(30).cast("bigint"),
        "expected_salary_range_inr_lpa": F.struct(
            at_least(6, whole_years * 3).alias("min"), at_least(12, whole_years * 5).alias("max")
        ),
        "preferred_work_mode": F.lit("hybrid"),
        "willing_to_relocate": F.lit(True),
        "github_activity_score": F.lit(40.0),
        "search_appearance_30d": F.lit(10).cast("bigint"),
        "saved_by_recruiters_30d": F.lit(2).cast("bigint"),
        "interview_completion_rate": F.lit(0.9),
        "offer_acceptance_rate": F.lit(0.5),
        "verified_email": F.lit(True),
        "verified_phone": F.lit(False),
        "linkedin_connected": F.lit(True),
    }
    return read.select(
        "path",
        candidate_id.alias("candidate_id"),
        F.struct(
            F.col("_name").alias("anonymized_name"),
            F.col("_headline").alias("headline"),
            F.substring(_or_else(F.col("_summary"), F.col("_headline")), 1, 1200).alias("summary"),
            F.lit("Unknown").alias("location"),
            F.lit("India").alias("country"),
            F.bround(years, 1).alias("years_of_experience"),
            F.col("_title").alias("current_title"),
            F.col("_company").alias("current_company"),
            F.col("_size").alias("current_company_size"),
            F.lit("Technology").alias("current_industry"),
        ).alias("profile"),
        F.when(F.size(career) > 0, career).otherwise(F.array(placeholder)).alias("career_history"),
        "education",
        "skills",
        F.from_json(F.lit("[]"), "array<struct<name:string,issuer:string,year:bigint>>").alias("certifications"),
        F.array(F.struct(F.lit("English").alias("language"), F.lit("professional").alias("proficiency"))).alias(
            "languages"
        ),
        F.struct(*[value.alias(name) for name, value in signals.items()]).alias("signals"),
    )


def batch_counts(files: DataFrame) -> DataFrame:
    """One row from ``files(path, text, error)``: uploaded, parsed and failed."""
    return files.agg(
        F.count("*").alias("n_uploaded"),
        F.count_if(F.col("error").isNull()).alias("n_parsed"),
        F.count_if(F.col("error").isNotNull()).alias("n_failed"),
    )


def section_rows(resumes: DataFrame, text: str = "text") -> DataFrame:
    """``path, section, body``: one row per section present."""
    entries = F.filter(F.map_entries("sections"), lambda e: e["value"].isNotNull())
    return rows_of(with_sections(resumes, text), ["path"], entries, "_e").select(
        "path", F.col("_e.key").alias("section"), F.col("_e.value").alias("body")
    )
