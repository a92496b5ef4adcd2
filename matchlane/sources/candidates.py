"""Candidate profiles: raw schema, readers and typed coercion.

The nested platform-activity record is called ``signals`` here; files that
use another key pass it as ``signals_field``.
"""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructField, StructType

_SIGNALS_DDL = """struct<profile_completeness_score:double, signup_date:string, last_active_date:string,
  open_to_work_flag:boolean, profile_views_received_30d:bigint, applications_submitted_30d:bigint,
  recruiter_response_rate:double, avg_response_time_hours:double, skill_assessment_scores:map<string,double>,
  connection_count:bigint, endorsements_received:bigint, notice_period_days:bigint,
  expected_salary_range_inr_lpa:struct<min:double,max:double>, preferred_work_mode:string,
  willing_to_relocate:boolean, github_activity_score:double, search_appearance_30d:bigint,
  saved_by_recruiters_30d:bigint, interview_completion_rate:double, offer_acceptance_rate:double,
  verified_email:boolean, verified_phone:boolean, linkedin_connected:boolean>"""


def raw_schema(signals_field: str = "signals") -> str:
    """DDL of one profile as it appears in a JSON file."""
    return f"""candidate_id string,
  profile struct<anonymized_name:string, headline:string, summary:string, location:string, country:string,
    years_of_experience:double, current_title:string, current_company:string, current_company_size:string,
    current_industry:string>,
  career_history array<struct<company:string,title:string,start_date:string,end_date:string,
    duration_months:bigint,is_current:boolean,industry:string,company_size:string,description:string>>,
  education array<struct<institution:string,degree:string,field_of_study:string,start_year:bigint,
    end_year:bigint,grade:string,tier:string>>,
  skills array<struct<name:string,proficiency:string,endorsements:bigint,duration_months:bigint>>,
  certifications array<struct<name:string,issuer:string,year:bigint>>,
  languages array<struct<language:string,proficiency:string>>,
  {signals_field} {_SIGNALS_DDL}"""


def read_profiles(
    spark: SparkSession,
    path: str | list[str],
    *,
    layout: str = "lines",
    signals_field: str = "signals",
    on_bad_json: str = "FAILFAST",
) -> DataFrame:
    """Read raw profiles.  Compressed files are recognised by their suffix.

    ``layout``: ``lines`` (one JSON object per line, blank lines skipped),
    ``array`` (one JSON array per file) or ``wrapped`` (``{"candidates": [...]}``).
    """
    reader = spark.read.option("mode", on_bad_json)
    ddl = raw_schema(signals_field)
    if layout == "lines":
        return reader.schema(ddl).json(path)
    if layout == "array":
        return reader.schema(ddl).option("multiLine", True).json(path)
    if layout == "wrapped":
        profile = StructType.fromDDL(ddl)
        wrapped = StructType([StructField("candidates", ArrayType(profile))])
        return (
            reader.schema(wrapped)
            .option("multiLine", True)
            .json(path)
            .select(F.inline(_require(F.col("candidates"), "no 'candidates' list in the file")))
        )
    raise ValueError(f"unknown layout {layout!r}")


def _require(column: Column, message: str) -> Column:
    return F.when(column.isNull(), F.raise_error(F.lit(message))).otherwise(column)


def read_json_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Unparsed JSON lines as ``value``, blank lines skipped (input of validation and labelling)."""
    return spark.read.text(path).where(F.trim("value") != "")


def record_id(line: Column) -> Column:
    """``candidate_id`` of a JSON line, else its ``id``, else an empty text."""
    found = [F.nullif(F.get_json_object(line, f"$.{key}"), F.lit("")) for key in ("candidate_id", "id")]
    return F.coalesce(*found, F.lit(""))


def first_candidates(candidates: DataFrame, n: int) -> DataFrame:
    """The ``n`` smallest ids — a limited load that does not depend on file order."""
    return candidates.orderBy("candidate_id").limit(n)


def _text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def _whole(c: Column) -> Column:
    return F.coalesce(c, F.lit(0).cast("bigint"))


def _skill(s: Column, assessments: Column) -> Column:
    name = F.trim(_text(s["name"]))
    return F.struct(
        name.alias("name"),
        F.lower(F.coalesce(s["proficiency"], F.lit("beginner"))).alias("proficiency"),
        _whole(s["endorsements"]).alias("endorsements"),
        _whole(s["duration_months"]).alias("duration_months"),
        F.try_element_at(assessments, name).alias("assessment_score"),
    )


def _role(r: Column) -> Column:
    return F.struct(
        _text(r["company"]).alias("company"),
        _text(r["title"]).alias("title"),
        _text(r["start_date"]).alias("start_date"),
        r["end_date"].alias("end_date"),
        _whole(r["duration_months"]).alias("duration_months"),
        F.coalesce(r["is_current"], F.lit(False)).alias("is_current"),
        _text(r["industry"]).alias("industry"),
        _text(r["company_size"]).alias("company_size"),
        _text(r["description"]).alias("description"),
    )


def _degree(e: Column) -> Column:
    return F.struct(
        _text(e["institution"]).alias("institution"),
        _text(e["degree"]).alias("degree"),
        _text(e["field_of_study"]).alias("field_of_study"),
        _whole(e["start_year"]).alias("start_year"),
        _whole(e["end_year"]).alias("end_year"),
        e["grade"].alias("grade"),
        F.coalesce(e["tier"], F.lit("unknown")).alias("tier"),
    )


def to_candidates(raw: DataFrame, signals_field: str = "signals") -> DataFrame:
    """Raw profiles -> typed candidates with defaults; one map-only projection."""
    signals = F.col(signals_field)

    p = F.col("profile")
    return raw.select(
        F.col("candidate_id"),
        _text(p["anonymized_name"]).alias("name"),
        *[_text(p[f]).alias(f) for f in ("headline", "summary", "location", "country")],
        F.coalesce(p["years_of_experience"], F.lit(0.0)).alias("years_of_experience"),
        *[
            _text(p[f]).alias(f)
            for f in ("current_title", "current_company", "current_company_size", "current_industry")
        ],
        _listed(F.col("career_history"), _role).alias("career"),
        _listed(F.col("education"), _degree).alias("education"),
        _listed(F.col("skills"), lambda s: _skill(s, signals["skill_assessment_scores"])).alias("skills"),
        signals.alias("signals"),
    )


def _listed(column: Column, item) -> Column:
    """Coerce each entry; a missing list becomes an empty one."""
    present = F.filter(column, lambda x: x.isNotNull())
    empty = F.slice(F.array(item(F.get(column, 0))), 1, 0)
    return F.coalesce(F.transform(present, item), empty)
