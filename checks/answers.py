"""Prompt samples, gold labels and completion scoring."""

from pyspark.sql import functions as F

from checks import profiles as P
from checks import ranking as R
from checks import sql as S
from matchlane import lexicons as lx
from matchlane.operators import dataset as D
from matchlane.operators import rewards as W
from matchlane.plans import sample_profiles as sp
from matchlane.plans.sample_profiles import completions, prompt_pool, raw_profiles
from matchlane.plans.shortlist import index_candidates, score_candidates
from matchlane.session import materialise

TOP, CAP = 20, 30  # the report's limits
JD = lx.DEFAULT_JD_TEXT


def contexts(spark, sf_dir):
    return raw_profiles(spark, sf_dir).select("candidate_id", D.candidate_context().alias("context"))


def records(spark, sf_dir):
    """Raw profiles with the whole record as one line and their place in the input."""
    raw = raw_profiles(spark, sf_dir)
    return raw.withColumn("line", D.record_line(raw.columns)).withColumn("ordinal", sp.candidate_key(F.col("candidate_id")))


def overlap_scores(spark, sf_dir):
    """Word overlap of every whole record with the default job."""
    scored = D.overlap_scores(records(spark, sf_dir), JD, "line")
    return scored.select("candidate_id", F.round("base", 9).alias("base"))


def labelled(spark, sf_dir, shown=True):
    """Gold labels; records of equal overlap stay in input order.

    The overlap of a record is worked out once, into a stored table with what a prompt shows of it.
    """
    scored = D.overlap_scores(records(spark, sf_dir), JD, "line")
    kept = scored.select("candidate_id", "ordinal", "base", *(D.shown_columns() if shown else []))
    return D.label(materialise(kept, "overlaps"), TOP, ["ordinal"])


def gold_labels(spark, sf_dir):
    return labelled(spark, sf_dir, False).select("candidate_id", "decision", "score", "is_top")


def gold_labels_by_ranking(spark, sf_dir):
    """Labels from the ranking's score of every candidate."""
    index = index_candidates(P.to_candidates(raw_profiles(spark, sf_dir)), P.today())
    out = D.label_by_ranking(score_candidates(index, R.default_job(spark)), TOP)
    return out.select("candidate_id", "decision", "score", "is_top")


def class_counts(spark, sf_dir):
    return D.class_counts(labelled(spark, sf_dir, False))


def balanced(spark, sf_dir):
    return D.balance(labelled(spark, sf_dir, False)).select("candidate_id", "decision")


def samples(spark, sf_dir):
    return D.prompt_samples(D.balance(labelled(spark, sf_dir)), JD)


def prompt_samples(spark, sf_dir):
    return D.take_shuffled(samples(spark, sf_dir), CAP)


def chat_messages(spark, sf_dir):
    """Gold answers of every candidate as minified JSON in the assistant turn."""
    chats = D.chat_messages(D.prompt_samples(labelled(spark, sf_dir), JD))
    return chats.select(
        "candidate_id", "answer", F.concat_ws(",", F.transform("messages", lambda m: m["role"])).alias("roles"),
        (F.get("messages", 2)["content"] == F.col("answer")).alias("answered"),
    )


def stripped(spark, sf_dir):
    made = completions(spark, sf_dir)
    return made.select("sample_id", "model", W.strip_thinking(F.col("completion")).alias("completion"))


def parsed_answers(spark, sf_dir):
    read = W.with_answer(stripped(spark, sf_dir))
    return read.select(
        "sample_id", "model", "predicted_decision", F.round("predicted_score", 6).alias("predicted_score"),
        F.concat_ws("|", "_clean").alias("reasons"),
    )


def rewards(spark, sf_dir):
    return W.score_completions(stripped(spark, sf_dir), prompt_pool(spark, sf_dir))


def reward_components(spark, sf_dir):
    return rewards(spark, sf_dir).select(
        "sample_id", "model", *[F.round(c, 6).alias(c) for c in [*W.COMPONENTS, "total"]]
    )


def reward_means(spark, sf_dir):
    means = W.component_means(rewards(spark, sf_dir))
    return means.select("model", "n", *[F.round(c, 6).alias(c) for c in ["mean_reward", *W.COMPONENTS]])


def reward_uplift(spark, sf_dir):
    out = W.uplift(rewards(spark, sf_dir), "base", "tuned")
    return out.select("component", *[F.round(c, 6).alias(c) for c in ("baseline", "trained", "delta")])


def reward_histogram(spark, sf_dir):
    return W.histogram(rewards(spark, sf_dir)).withColumn("bin", F.col("bin").cast("bigint"))


def reward_summary(spark, sf_dir):
    out = W.summary(rewards(spark, sf_dir), "base", "tuned")
    return out.select("n_rewards", *[F.round(c, 6).alias(c) for c in out.columns[1:]])


QUERIES = {
    "candidate_context": contexts,
    "word_overlap": overlap_scores,
    "gold_labels": gold_labels,
    "gold_labels_by_ranking": gold_labels_by_ranking,
    "class_counts": class_counts,
    "balanced_samples": balanced,
    "prompt_samples": prompt_samples,
    "chat_messages": chat_messages,
    "strip_thinking": stripped,
    "parsed_answers": parsed_answers,
    "reward_components": reward_components,
    "reward_means": reward_means,
    "reward_uplift": reward_uplift,
    "reward_histogram": reward_histogram,
    "reward_summary": reward_summary,
}

CONTEXT = f"""
{P._BASE},
ctx AS (
  SELECT k, candidate_id, years, 'Headline: ' || title || ' in ' || industry || chr(10) || 'Current: ' || title || ' @ '
    || company || ' (' || {S.pick(sp.SIZES, 'k % 8')} || ')' || chr(10) || 'YoE: ' || printf('%.1f', years) || chr(10)
    || 'Location: ' || location || ', ' || country || chr(10) || 'Summary: ' || substr(summary, 1, 600) || chr(10)
    || 'Top skills: ' || coalesce((
      SELECT string_agg(name || ' (' || proficiency || ', ' || months || 'm)', ', ' ORDER BY pos)
      FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY pos) AS nth FROM claims) c
      WHERE c.k = cand.k AND nth <= 8), '') || chr(10)
    || 'Latest role desc: ' || coalesce((
      SELECT substr(description, 1, 400) FROM roles WHERE roles.k = cand.k AND pos = 1), '') AS context
  FROM cand)"""

# The words of a whole record: its keys as far as they are there, and every text as JSON in plain ASCII.
_KEYS = {
    "record": "candidate_id profile anonymized_name headline summary location country years_of_experience current_title "
    "current_company current_company_size current_industry career_history education skills signals "
    "profile_completeness_score signup_date last_active_date open_to_work_flag profile_views_received_30d "
    "applications_submitted_30d recruiter_response_rate avg_response_time_hours skill_assessment_scores connection_count "
    "endorsements_received notice_period_days expected_salary_range_inr_lpa min max preferred_work_mode "
    "willing_to_relocate github_activity_score search_appearance_30d saved_by_recruiters_30d interview_completion_rate "
    "offer_acceptance_rate verified_email verified_phone linkedin_connected",
    "role": "company title start_date end_date duration_months is_current industry company_size description",
    "degree": "institution degree field_of_study start_year end_year grade tier University Computer Science tier_2",
    "skill": "name proficiency endorsements duration_months",
}


def _ascii(text: str) -> str:
    """The text as a JSON string, characters beyond ASCII as code points."""
    escaped = "CASE WHEN unicode(c) > 127 THEN '\\u' || printf('%04x', unicode(c)) ELSE c END"
    return f"array_to_string(list_transform(string_split(to_json({text})::VARCHAR, ''), lambda c: {escaped}), '')"


_WORDS = "list_distinct(regexp_extract_all(lower({}), '[a-z]{{3,}}'))"
LABELS = f"""
career AS (
  SELECT k, {S.q(_KEYS['role'])} || ' ' || string_agg(concat_ws(' ', company, title, industry,
    {S.pick(sp.SIZES, 'o_size')}, {_ascii('description')}), ' ') AS words FROM roles GROUP BY k),
claimed_words AS (
  SELECT k, {S.q(_KEYS['skill'])} || ' ' || string_agg(name || ' ' || proficiency, ' ') AS words FROM claims GROUP BY k),
lines AS (
  SELECT ctx.k, ctx.candidate_id, context, concat_ws(' ', {S.q(_KEYS['record'])}, name, title || ' in ' || industry,
    {_ascii('summary')}, location, country, title, company, {S.pick(sp.SIZES, 'ctx.k % 8')}, industry,
    {S.pick(sp.MODES, 'ctx.k % 4')}, CASE WHEN nation % 4 <> 0 THEN {S.q(_KEYS['degree'])} || ' '
      || {S.pick(sp.DEGREES, 'ctx.k % 4')} END, career.words, claimed_words.words) AS line
  FROM ctx JOIN cand USING (k) LEFT JOIN career ON career.k = ctx.k LEFT JOIN claimed_words ON claimed_words.k = ctx.k),
over AS (
  SELECT k, candidate_id, context,
    len(list_intersect({_WORDS.format(S.q(JD))}, {_WORDS.format('line')})) / len({_WORDS.format(S.q(JD))}) AS base
  FROM lines),
gold AS (
  SELECT *, CASE WHEN place <= {TOP} THEN 'shortlist' ELSE 'reject' END AS decision,
    CASE WHEN place <= {TOP} THEN '1' ELSE '0' END AS is_top,
    {S.half_even(f'CASE WHEN place <= {TOP} THEN base ELSE greatest(0, 1 - base) END', 4)} AS score
  FROM (SELECT *, row_number() OVER (ORDER BY base DESC, k) AS place FROM over)),
fair AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY decision ORDER BY md5('0:' || candidate_id)) AS nth FROM gold)
  WHERE nth <= (SELECT min(n) FROM (SELECT count(*) AS n FROM gold GROUP BY decision)))"""

_JD = S.q(JD.strip())
ANSWERS = r"""
facts AS (
  SELECT candidate_id, decision, score,
    list_filter(list_transform(string_split(trim(regexp_extract(full_ctx, 'Top skills:\s*(.+)', 1)), ','),
                lambda s: trim(s)), lambda s: s <> '')[1:3] AS skills,
    regexp_extract(full_ctx, 'YoE:\s*([0-9.]+)', 1) AS yoe,
    trim(regexp_replace(trim(regexp_extract(full_ctx, 'Current:\s*(.+)', 1)), '\s*\([^)]*\)\s*$', '')) AS cur
  FROM (SELECT *, """ + _JD + r""" || chr(10) || chr(10) || context AS full_ctx FROM gold)),
chosen AS (
  SELECT *, list_filter(CASE WHEN decision = 'reject' THEN [
      CASE WHEN len(skills) > 0 THEN 'Listed skills (' || array_to_string(skills, ', ') || ') only partially overlap the JD.'
           ELSE 'Profile lists no skills matching the JD''s core stack.' END,
      CASE WHEN yoe = '' OR TRY_CAST(yoe AS DOUBLE) < 2 THEN 'Years-of-experience signal is weak for this role.' END,
      'Headline does not match the JD''s primary responsibilities.'] ELSE [
      CASE WHEN len(skills) > 0 THEN 'Brings hands-on skills: ' || array_to_string(skills, ', ') || '.' END,
      CASE WHEN yoe <> '' THEN yoe || ' years of experience matches the role''s seniority.' END,
      CASE WHEN cur <> '' THEN 'Currently ' || cur || ', relevant to the JD focus.' END] END, lambda r: r IS NOT NULL) AS rs
  FROM facts),
answers AS (
  SELECT candidate_id, '{"decision":"' || decision || '","score":' || """ + S.half_even("score", 2) + r"""::VARCHAR
    || ',"reasons":["' || array_to_string(CASE WHEN len(rs) < 2
      THEN list_append(rs, 'See profile for additional supporting evidence.') ELSE rs END, '","') || '"]}' AS answer
  FROM chosen)"""

_FACT = f"'\"Works as ' || {S.pick(sp.TITLES, '(c_custkey * 7) % 16')} || ' in ' || {S.pick(sp.CITIES, 'c_nationkey % 9')} || '\"'"
_TICKETS = "floor(abs(c_acctbal) / 50)::BIGINT"
MADE = f"""
made AS (
  SELECT printf('CAND_%07d', c_custkey) AS sample_id, 'tuned' AS model, CASE c_custkey % 4
    WHEN 0 THEN 'Answer: {{"decision":"reject","score":0.' || printf('%03d', {_TICKETS}) || ',"reasons":[' || {_FACT}
      || ',"Has ' || {_TICKETS} || ' tickets at Contoso Labs","Knows Kubernetes and Airflow well"]}} done'
    WHEN 1 THEN '{{''decision'': ''reject'', ''score'': 0.4, ''reasons'': [''Only one short reason given'']}}'
    WHEN 2 THEN '{{"decision":" Shortlist ","score":0.9,"reasons":[' || {_FACT} || ',' || {_FACT} || ',7,"ok"]}}'
    ELSE '{{"decision":"shortlist","score":"0.35","reasons":[]}}' END AS completion
  FROM customer
  UNION ALL
  SELECT printf('CAND_%07d', conv_id % (SELECT count(*) FROM customer)), 'base', text FROM conversations)"""

READ = r"""
blocks AS (SELECT *, regexp_extract(completion, '(?s)\{.*\}', 0) AS block FROM made),
objects AS (
  SELECT *, CASE WHEN block = '' THEN NULL WHEN json_valid(block) THEN block
    WHEN json_valid(replace(block, '''', '"')) THEN replace(block, '''', '"') END AS obj FROM blocks),
read AS (
  SELECT sample_id, model, completion, obj, lower(trim(coalesce(json_extract_string(obj, '$.decision'), ''))) AS decision,
    TRY_CAST(json_extract_string(obj, '$.score') AS DOUBLE) AS score,
    list_transform(list_filter(CAST(json_extract(obj, '$.reasons') AS JSON[]), lambda r: json_type(r) = 'VARCHAR'),
                   lambda r: r ->> '$') AS given
  FROM objects),
cleaned AS (
  SELECT *, list_filter(list_transform(given, lambda r: trim(r)), lambda r: length(r) BETWEEN 3 AND 240) AS clean FROM read)"""

SCORED = f"""
pool AS (
  SELECT candidate_id AS sample_id, CASE WHEN k % 2 = 0 THEN 'shortlist' ELSE 'reject' END AS gold,
    {S.half_even('years / 20', 4)} AS gold_score, context FROM ctx),
claimed AS (
  SELECT c.*, gold, gold_score, context,
    flatten(list_transform(clean, lambda r: regexp_extract_all(lower(r), '[a-zA-Z][a-zA-Z\\-]{{2,}}'))) AS words,
    list_concat(regexp_extract_all(array_to_string(given, ' '), '\\b\\d+(?:\\.\\d+)?\\b'),
      regexp_extract_all(array_to_string(given, ' '), '\\b[A-Z][a-zA-Z0-9\\-]{{2,}}(?:\\s+[A-Z][a-zA-Z0-9\\-]{{2,}})*\\b')) AS facts
  FROM cleaned c JOIN pool USING (sample_id)),
components AS (
  SELECT sample_id, model, (obj IS NOT NULL)::INT::DOUBLE AS format_valid, (decision = gold)::INT::DOUBLE AS decision_match,
    CASE WHEN score IS NULL THEN 0.0 ELSE 1 - abs(greatest(0, least(1, score)) - gold_score) END AS score_alignment,
    CASE WHEN coalesce(len(clean), 0) = 0 THEN 0.0 ELSE
      0.5 * least(len(clean), 5) / 5.0 * CASE WHEN len(clean) < 2 THEN 0.5 ELSE 1 END
      + 0.3 * coalesce(len(list_distinct(words)) / nullif(len(words), 0), 0)
      + 0.2 * (1 - len(list_filter(clean, lambda r: contains(lower(context), lower(r)))) / len(clean)) END AS reason_quality,
    CASE WHEN length(completion) < 30 THEN length(completion) / 30.0 WHEN length(completion) <= 1200 THEN 1.0
         ELSE greatest(0, 1 - (length(completion) - 1200) / 1200.0) END AS length_penalty,
    CASE WHEN coalesce(json_array_length(obj, '$.reasons'), 0) = 0 THEN 0.0 WHEN len(facts) = 0 THEN 1.0
         ELSE len(list_filter(facts, lambda f: contains(context, f))) / len(facts) END AS no_hallucination
  FROM claimed),
scored AS (
  SELECT *, 0.2 * format_valid + 0.3 * decision_match + 0.15 * score_alignment + 0.15 * reason_quality
    + 0.05 * length_penalty + 0.15 * no_hallucination AS total FROM components)"""

_LABELLED = f"WITH {CONTEXT},{LABELS}"
_REWARDS = f"WITH {CONTEXT},{MADE},{READ},{SCORED}"
_PARTS = [*W.COMPONENTS, "total"]
_MEANS = " UNION ALL ".join(
    f"SELECT '{c}' AS component, avg({c}) FILTER (model = 'base') AS b, avg({c}) FILTER (model = 'tuned') AS t FROM scored"
    for c in _PARTS
)

SQL = {
    "candidate_context": f"WITH {CONTEXT} SELECT candidate_id, context FROM ctx",
    "word_overlap": f"{_LABELLED} SELECT candidate_id, round(base, 9) AS base FROM over",
    "gold_labels": f"{_LABELLED} SELECT candidate_id, decision, score, is_top FROM gold",
    "gold_labels_by_ranking": f"""
WITH {R._ONE}, r AS (
  SELECT candidate_id, {S.half_even('final', 4)} AS base, row_number() OVER (ORDER BY round(final, 9) DESC, candidate_id) AS place
  FROM final)
SELECT candidate_id, CASE WHEN place <= {TOP} THEN 'shortlist' ELSE 'reject' END AS decision,
  CASE WHEN place <= {TOP} THEN '1' ELSE '0' END AS is_top,
  CASE WHEN place <= {TOP} THEN base ELSE {S.half_even('greatest(0, 1 - base)', 4)} END AS score FROM r""",
    "class_counts": f"{_LABELLED} SELECT decision, count(*) AS n FROM gold GROUP BY decision",
    "balanced_samples": f"{_LABELLED} SELECT candidate_id, decision FROM fair",
    "prompt_samples": f"""
{_LABELLED} SELECT '[JOB DESCRIPTION]' || chr(10) || substr({_JD}, 1, 1500) || chr(10) || chr(10) || '[CANDIDATE]' || chr(10)
  || context || chr(10) || chr(10) || {S.q(D.TASK)} AS prompt, {_JD} || chr(10) || chr(10) || context AS context,
  decision, score, candidate_id, is_top FROM fair ORDER BY md5('7:' || candidate_id) LIMIT {CAP}""",
    "chat_messages": f"""
{_LABELLED},{ANSWERS} SELECT candidate_id, answer, 'system,user,assistant' AS roles, true AS answered FROM answers""",
    "strip_thinking": f"WITH {MADE} SELECT * FROM made",
    "parsed_answers": f"""
WITH {MADE},{READ} SELECT sample_id, model, decision AS predicted_decision, round(score, 6) AS predicted_score,
  coalesce(array_to_string(clean, '|'), '') AS reasons FROM cleaned""",
    "reward_components": f"""
{_REWARDS} SELECT sample_id, model, {', '.join(f'round({c}, 6)::DOUBLE AS {c}' for c in _PARTS)} FROM scored""",
    "reward_means": f"""
{_REWARDS} SELECT model, count(*) AS n, round(avg(total), 6) AS mean_reward,
  {', '.join(f'round(avg({c}), 6) AS {c}' for c in W.COMPONENTS)} FROM scored GROUP BY model""",
    "reward_uplift": f"""
{_REWARDS}, m AS ({_MEANS})
SELECT component, round(b, 6) AS baseline, round(t, 6) AS trained, round(t - b, 6) AS delta FROM m""",
    "reward_histogram": f"""
{_REWARDS} SELECT model, least(floor(round(total * 20, 9)), 19)::BIGINT AS bin, count(*) AS n FROM scored
WHERE total BETWEEN 0 AND 1 GROUP BY ALL""",
    "reward_summary": f"""
{_REWARDS} SELECT count(*) AS n_rewards, round(avg(total) FILTER (model = 'base'), 6) AS baseline_mean_reward,
  round(avg(total) FILTER (model = 'tuned'), 6) AS trained_mean_reward,
  round(avg(total) FILTER (model = 'tuned') - avg(total) FILTER (model = 'base'), 6) AS uplift FROM scored""",
}
