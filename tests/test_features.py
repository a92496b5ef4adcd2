import datetime

import pytest
from pyspark.sql import functions as F

from matchlane import lexicons as lx
from matchlane.operators.profile import experience_band, role_of, with_role_signals
from matchlane.operators.requirements import parse_requirements
from matchlane.operators.resume import covered_years, parse_resumes, year_spans
from matchlane.operators.signals import behavioural_multiplier
from matchlane.operators.validation import validate
from matchlane.plans.sample_profiles import raw_profiles
from matchlane.plans.shortlist import rank_candidates
from matchlane.sources.candidates import raw_schema, to_candidates
from matchlane.sources.profile_schema import profile_schema

TODAY = datetime.date(2024, 2, 1)
SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize(
    "days, term", [(0, -0.04), (None, -0.04), (30, 0.05), (60, 0.0), (90, -0.04), (91, -0.08)]
)
def test_notice_terms(spark, days, term):
    raw = spark.createDataFrame([], raw_schema())
    row = spark.createDataFrame([(days,)], "d long").select(
        F.from_json(F.to_json(F.struct(F.col("d").alias("notice_period_days"))), raw.schema["signals"].dataType).alias("signals")
    )
    base = 1.0 - 0.4 * 0.3 - 0.5 * 0.15 - 0.02
    assert row.select(behavioural_multiplier(F.lit(TODAY)).alias("m")).first().m == pytest.approx(base + term)


@pytest.mark.parametrize(
    "title, family",
    [
        ("senior software engineer", "backend_engineer"),
        ("machine learning scientist", "ml_engineer"),
        ("site reliability engineer", "devops_cloud_engineer"),
        ("astronaut", "unknown"),
    ],
)
def test_longest_keyword_wins(spark, title, family):
    assert spark.createDataFrame([(title,)], "t string").select(F.expr(role_of("t")).alias("r")).first().r.family == family


def test_experience_band_edges(spark):
    df = spark.createDataFrame([(2.5,), (5.0,), (9.0,), (11.0,), (30.0,)], "y double")
    got = [r.x for r in df.select(experience_band(F.col("y"), F.lit(5.0), F.lit(9.0)).alias("x")).collect()]
    assert got == pytest.approx([0.5, 1.0, 1.0, 0.8, 0.0])


def test_no_employers_is_not_consulting_only(spark):
    raw = spark.read.schema(raw_schema()).json(spark.sparkContext.parallelize(['{"candidate_id": "CAND_0000001"}']))
    row = with_role_signals(to_candidates(raw)).first()
    assert (row.only_consulting, row._all_consulting, row.current_family) == (False, True, "unknown")


def test_spans_are_merged(spark):
    text = "2013 - 2017, 2016 to 2018 and 2020 - present; 1900 - 1950, 2023-2021"
    row = spark.createDataFrame([(text,)], "t string")
    years = covered_years(year_spans(F.col("t"), F.lit(datetime.date(2026, 1, 1))))
    assert row.select(years.alias("y")).first().y == 11.0


RESUME = """Jane Doe
Senior AI Engineer at Acme

Summary
Experienced engineer who built search at scale using PyTorch and FAISS.

Experience
Senior AI Engineer at Acme, 2020 - present
Led a team that built recommendations with Kubernetes.
Machine Learning Engineer, BigCo, 2017 - 2020
Built NLP services.

Education
IIT Bombay, B.Tech, Computer Science, 2013 - 2017

Skills
Python, PyTorch, FAISS, AWS
"""


def test_resume_becomes_a_valid_profile(spark):
    files = spark.createDataFrame([("jane.txt", RESUME), ("other.txt", "nothing here")], "path string, text string")
    parsed = parse_resumes(files, F.lit(TODAY))
    jane = parsed.where("path = 'jane.txt'").first()
    assert jane.profile.anonymized_name == "Jane Doe" and jane.profile.years_of_experience == 7.0
    assert [(r.company, r.title, r.is_current) for r in jane.career_history] == [
        ("Acme", "Senior AI Engineer", True),
        ("BigCo", "Machine Learning Engineer", False),
    ]
    assert {"python", "pytorch", "faiss", "AWS"} <= {s.name for s in jane.skills}
    record = F.to_json(F.struct("*"), {"ignoreNullFields": "false"})
    checked = validate(parsed.select(record.alias("value")), profile_schema())
    assert all(r.errors == [] for r in checked.select("errors").collect())


def test_job_requirements(spark):
    jobs = spark.createDataFrame(
        [
            ("a", "Job Description: Staff Search Engineer - Core\nRequirements: FAISS and python, 3 to 7 years\nNice to have: xgboost\nNotice <45 days"),
            ("b", None),
            ("c", "junior role, sub-30-day notice"),
        ],
        "jd_id string, text string",
    )
    a, b, c = parse_requirements(jobs).orderBy("jd_id").collect()
    assert (a.title, a.seniority, a.min_years, a.max_years, a.preferred_notice_days) == ("Staff Search Engineer", "staff+", 3.0, 7.0, 45)
    assert a.must_have_skills == ["Python", "FAISS"] and a.nice_to_have_skills == ["XGBoost"]
    assert b.raw_text == lx.DEFAULT_JD_TEXT and (b.min_years, b.max_years) == (5.0, 9.0)
    assert c.seniority == "junior" and c.preferred_notice_days == 30 and c.must_have_skills == lx.MUST_HAVE


def test_ranking_is_ordered_dense_and_repeatable(spark):
    candidates = to_candidates(raw_profiles(spark, SF))
    jobs = parse_requirements(spark.createDataFrame([("j", "python faiss ranking"), ("k", None)], "jd_id string, text string"))
    rows = rank_candidates(candidates, jobs, F.lit(TODAY), 20).orderBy("jd_id", "rank").collect()
    for jd in ("j", "k"):
        mine = [r for r in rows if r.jd_id == jd]
        assert [r["rank"] for r in mine] == list(range(1, 21))
        assert [r.score for r in mine] == sorted((r.score for r in mine), reverse=True)
        assert all(-0.5 <= r.score <= 1.5 and r.reasoning.endswith(".") for r in mine)
        assert all(r.breakdown.final == r.score for r in mine)
    again = rank_candidates(candidates.repartition(7), jobs, F.lit(TODAY), 20).orderBy("jd_id", "rank").collect()
    assert [(r.jd_id, r.candidate_id, r.score) for r in again] == [(r.jd_id, r.candidate_id, r.score) for r in rows]


def test_an_empty_pool_gives_an_empty_shortlist(spark):
    empty = to_candidates(spark.createDataFrame([], raw_schema()))
    jobs = parse_requirements(spark.createDataFrame([("k", None)], "jd_id string, text string"))
    assert rank_candidates(empty, jobs, F.lit(TODAY)).count() == 0
