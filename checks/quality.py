"""Schema validation of derived profile lines and of ``events.props``."""

from pyspark.sql import functions as F

from checks import profiles as P
from checks import sql as S
from matchlane.operators import validation as V
from matchlane.plans import sample_profiles as sp
from matchlane.plans.sample_profiles import profile_lines, table
from matchlane.sources.profile_schema import COMPANY_SIZES, profile_schema

SCHEMA = profile_schema()
EVENT_SCHEMA = {
    "type": "object",
    "required": ["k", "url"],
    "additionalProperties": False,
    "properties": {"url": {"type": "string"}, "k": {"type": "integer", "minimum": 10, "maximum": 80}},
}


def validated(spark, sf_dir):
    return V.validate(profile_lines(spark, sf_dir), SCHEMA)


def profile_errors(spark, sf_dir):
    return V.error_rows(validated(spark, sf_dir), ["row_index"]).select("row_index", "path", "code", "expected", "actual")


def error_counts(spark, sf_dir):
    return V.error_counts(validated(spark, sf_dir)).select("code", "n_errors", "n_records")


def validation_report(spark, sf_dir):
    out = V.report(validated(spark, sf_dir))
    shown = F.transform("errors_by_row", lambda r: F.concat_ws(":", r["index"], F.size(r["errors"]), r["truncated"]))
    return out.select("n_total", "n_valid", "n_invalid", "first_invalid_index", F.concat_ws(" ", shown).alias("shown"))


def quarantine(spark, sf_dir):
    good, bad = V.gate(validated(spark, sf_dir), ["row_index"])
    return good.select("row_index", F.lit("valid").alias("gate")).unionByName(
        bad.select("row_index", F.lit("quarantine").alias("gate"))
    )


def event_errors(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", "props")
    return V.error_rows(V.validate(events, EVENT_SCHEMA, "props"), ["event_id"])


def flat_events(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", F.try_parse_json("props").alias("_v"))
    return V.flatten(events, ["event_id"], "_v")


def schema_diff(spark, sf_dir):
    lines = V.diff(validated(spark, sf_dir), ["row_index"], SCHEMA)
    return lines.groupBy("kind", "path").agg(F.count("*").alias("n"))


def ordered_diff(spark, sf_dir):
    events = V.validate(table(spark, sf_dir, "events").select("event_id", "props"), EVENT_SCHEMA, "props")
    return V.ordered_diff(V.diff(events, ["event_id"], EVENT_SCHEMA), ["event_id"])


# Orders as nested records: a missing key, an unknown one, empty containers and wrong values by key.
ORDER_SCHEMA = {
    "type": "object",
    "required": ["id", "who", "tags"],
    "additionalProperties": False,
    "properties": {
        "id": {"type": "integer", "minimum": 1},
        "who": {
            "type": "object",
            "required": ["key"],
            "additionalProperties": False,
            "properties": {"key": {"type": "integer"}, "note": {"type": ["string", "null"]}},
        },
        "tags": {"type": "array", "minItems": 1, "items": {"type": "string", "enum": ["O", "F", "P"]}},
    },
}


def order_lines(spark, sf_dir):
    key = F.col("o_orderkey")
    who = F.struct(
        F.col("o_custkey").alias("key"),
        F.when(key % 4 == 1, F.struct(F.struct(key.alias("b")).alias("a"))).alias("extra"),
    )
    tags = F.when(key % 3 == 0, F.array().cast("array<string>")).otherwise(F.array("o_orderstatus", F.lit("Z")))
    record = F.struct(F.when(key % 5 != 0, key).alias("id"), who.alias("who"), tags.alias("tags"))
    return table(spark, sf_dir, "orders").select(key.alias("row_index"), F.to_json(record).alias("value"))


def nested_errors(spark, sf_dir):
    checked = V.validate(order_lines(spark, sf_dir), ORDER_SCHEMA)
    return V.error_rows(checked, ["row_index"]).select("row_index", "path", "code", "actual")


def nested_leaves(spark, sf_dir):
    parsed = order_lines(spark, sf_dir).select("row_index", F.parse_json("value").alias("_v"))
    return V.flatten(parsed, ["row_index"], "_v", levels=2)


def nested_diff(spark, sf_dir):
    checked = V.validate(order_lines(spark, sf_dir), ORDER_SCHEMA)
    return V.diff(checked, ["row_index"], ORDER_SCHEMA).select("row_index", "kind", "path", "expected", "actual")


QUERIES = {
    "nested_errors": nested_errors,
    "nested_leaves": nested_leaves,
    "nested_diff": nested_diff,
    "profile_errors": profile_errors,
    "error_counts": error_counts,
    "validation_report": validation_report,
    "quarantine_gate": quarantine,
    "event_props_errors": event_errors,
    "flatten_event_props": flat_events,
    "schema_diff": schema_diff,
    "ordered_diff": ordered_diff,
}

_NULLABLE = [  # (path, condition under which the value is null, json type)
    ("career_history", "r.k IS NULL AND k10 <> 8", "array"),
    ("education", "nation % 4 = 0", "array"),
    ("skills", "c.k IS NULL", "array"),
    ("signals.signup_date", "a.k IS NULL", "string"),
    ("signals.last_active_date", "a.k IS NULL", "string"),
    ("signals.recruiter_response_rate", "a.k IS NULL", "number"),
    ("signals.interview_completion_rate", "a.k IS NULL", "number"),
    ("signals.saved_by_recruiters_30d", "a.k IS NULL", "integer"),
    ("signals.skill_assessment_scores", "c.k IS NULL AND k10 <> 9", "object"),
]
_LEVELS = ", ".join(repr(s) for s in COMPANY_SIZES)

BASE = f"""
{P._BASE},
keyed AS (
  SELECT cand.*, cand.k % 10 AS k10, r.k IS NOT NULL AS has_roles, c.k IS NOT NULL AS has_claims, r.k AS rk, c.k AS ck, a.k AS ak
  FROM cand LEFT JOIN (SELECT DISTINCT k FROM roles) r ON r.k = cand.k
  LEFT JOIN (SELECT DISTINCT k FROM claims) c ON c.k = cand.k LEFT JOIN activity a ON a.k = cand.k),
errors AS (
  {' UNION ALL '.join(f'''
  SELECT k AS row_index, {S.q(path)} AS path,
    CASE WHEN k10 = 2 THEN 'missing_required' ELSE 'wrong_type' END AS code,
    CASE WHEN k10 = 2 THEN {S.q(path.split('.')[-1])} ELSE {S.q(kind)} END AS expected,
    CASE WHEN k10 = 2 THEN '<missing>' ELSE 'NoneType' END AS actual
  FROM keyed WHERE {cond.replace('r.k', 'rk').replace('c.k', 'ck').replace('a.k', 'ak')}''' for path, cond, kind in _NULLABLE)}
  UNION ALL SELECT k, 'candidate_id', 'pattern_mismatch', '^CAND_[0-9]{{7}}$', '"ID_' || k || '"' FROM keyed WHERE k10 = 1
  UNION ALL SELECT k, 'profile.current_company_size', 'enum_violation', {S.q(_LEVELS)}, '"weird"' FROM keyed WHERE k10 = 3
  UNION ALL SELECT k, 'profile.years_of_experience', 'out_of_range', '<= 50', '75.5' FROM keyed WHERE k10 = 4
  UNION ALL SELECT k, 'skills[0].endorsements', 'out_of_range', '>= 0', '-1' FROM keyed WHERE k10 = 5 AND has_claims
  UNION ALL SELECT k, 'career_history[0].start_date', 'bad_date', 'YYYY-MM-DD', '"2020/01/01"'
            FROM keyed WHERE k10 = 6 AND has_roles
  UNION ALL SELECT k, 'education', 'too_many_items', '<= 5', '6' FROM keyed WHERE k10 = 7 AND nation % 4 <> 0
  UNION ALL SELECT k, 'career_history', 'too_many_items', '<= 10', count(*)::VARCHAR FROM roles
            WHERE k % 10 <> 8 GROUP BY k HAVING count(*) > 10
  UNION ALL SELECT k, 'career_history', 'too_few_items', '>= 1', '0' FROM keyed WHERE k10 = 8 AND has_roles
  UNION ALL SELECT k, 'career_history', 'wrong_type', 'array', 'NoneType' FROM keyed WHERE k10 = 8 AND NOT has_roles
  UNION ALL SELECT k, 'signals.skill_assessment_scores.Python', 'out_of_range', '<= 100', '150.0' FROM keyed WHERE k10 = 9
  UNION ALL SELECT roles.k, 'career_history[' || (pos - 1) || '].end_date', 'missing_required', 'end_date', '<missing>'
            FROM roles WHERE roles.k % 10 = 2 AND is_current)"""

_SHOWN = "CAST(json_extract_string(props, '$.k') AS BIGINT)"

_LEAVES = """
leaves AS (
  SELECT o_orderkey AS row_index, 'id' AS path, o_orderkey::VARCHAR AS value FROM orders WHERE o_orderkey % 5 <> 0
  UNION ALL SELECT o_orderkey, 'who.key', o_custkey::VARCHAR FROM orders
  UNION ALL SELECT o_orderkey, 'who.extra.a.b', o_orderkey::VARCHAR FROM orders WHERE o_orderkey % 4 = 1
  UNION ALL SELECT o_orderkey, 'tags', '[]' FROM orders WHERE o_orderkey % 3 = 0
  UNION ALL SELECT o_orderkey, 'tags[0]', '"' || o_orderstatus || '"' FROM orders WHERE o_orderkey % 3 <> 0
  UNION ALL SELECT o_orderkey, 'tags[1]', '"Z"' FROM orders WHERE o_orderkey % 3 <> 0)"""

SQL = {
    "nested_errors": """
SELECT o_orderkey AS row_index, 'id' AS path, 'missing_required' AS code, '<missing>' AS actual FROM orders WHERE o_orderkey % 5 = 0
UNION ALL SELECT o_orderkey, 'who.extra', 'unknown_property', 'extra' FROM orders WHERE o_orderkey % 4 = 1
UNION ALL SELECT o_orderkey, 'tags', 'too_few_items', '0' FROM orders WHERE o_orderkey % 3 = 0
UNION ALL SELECT o_orderkey, 'tags[1]', 'enum_violation', '"Z"' FROM orders WHERE o_orderkey % 3 <> 0""",
    "nested_leaves": f"WITH {_LEAVES} SELECT row_index, path, value FROM leaves",
    "nested_diff": f"""
WITH {_LEAVES}, known(path, expected) AS (VALUES ('id', '1'), ('who.key', '0'), ('tags[0]', '"O"'))
SELECT row_index, CASE WHEN expected IS NULL THEN 'extra' ELSE 'match' END AS kind, path, expected, value AS actual
FROM leaves LEFT JOIN known USING (path)
UNION ALL
SELECT o_orderkey, 'missing', path, expected, NULL FROM orders, known
WHERE (path = 'id' AND o_orderkey % 5 = 0) OR (path = 'tags[0]' AND o_orderkey % 3 = 0)""",
    "profile_errors": f"WITH {BASE} SELECT * FROM errors",
    "error_counts": f"""
WITH {BASE} SELECT code, count(*) AS n_errors, count(DISTINCT row_index) AS n_records FROM errors GROUP BY code""",
    "validation_report": f"""
WITH {BASE}, per AS (SELECT row_index, count(*) AS n FROM errors GROUP BY row_index),
listed AS (SELECT * FROM per ORDER BY row_index LIMIT 25)
SELECT (SELECT count(*) FROM cand) AS n_total, (SELECT count(*) FROM cand) - (SELECT count(*) FROM per) AS n_valid,
  (SELECT count(*) FROM per) AS n_invalid, (SELECT min(row_index) FROM per) AS first_invalid_index,
  (SELECT string_agg(row_index || ':' || least(n, 25) || ':' || (n > 25)::VARCHAR, ' ' ORDER BY row_index) FROM listed) AS shown""",
    "quarantine_gate": f"""
WITH {BASE} SELECT k AS row_index, CASE WHEN k IN (SELECT row_index FROM errors) THEN 'quarantine' ELSE 'valid' END AS gate
FROM cand""",
    "event_props_errors": f"""
SELECT event_id, 'url' AS path, 'missing_required' AS code, 'required property ''url'' is missing' AS message,
  'url' AS expected, '<missing>' AS actual FROM events
UNION ALL SELECT event_id, 'k', 'out_of_range', 'value is below minimum 10', '>= 10', {_SHOWN}::VARCHAR
  FROM events WHERE {_SHOWN} < 10
UNION ALL SELECT event_id, 'k', 'out_of_range', 'value is above maximum 80', '<= 80', {_SHOWN}::VARCHAR
  FROM events WHERE {_SHOWN} > 80""",
    "flatten_event_props": "SELECT event_id, 'k' AS path, json_extract_string(props, '$.k') AS value FROM events",
    "ordered_diff": f"""
SELECT event_id, 'missing' AS kind, 'url' AS path, '""' AS expected, NULL AS actual, 1 AS position FROM events
UNION ALL SELECT event_id, 'match', 'k', '10', {_SHOWN}::VARCHAR, 2 FROM events""",
}
