"""Queries over files written to the shared folder and read back, and the run from lines to results."""

import io
import zipfile
import zlib
from xml.sax.saxutils import escape

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import functions as F

from checks import answers as A
from checks import profiles as P
from checks import quality as Q
from checks import ranking as R
from checks import resumes as Z
from checks import sql as S
from matchlane.functions.dates import month_start_before, year_of
from matchlane.operators import resume as RZ
from matchlane.plans import sample_profiles as sp
from matchlane.plans.run import need_rows, rank_lines
from matchlane.plans.sample_profiles import candidate_key, profile_lines, raw_profiles, table
from matchlane.session import materialise, work_path
from matchlane.sources.candidates import first_candidates, read_json_lines, read_profiles, record_id, to_candidates
from matchlane.sources.jobs import read_jobs
from matchlane.sources.resumes import read_resumes
from matchlane.sources.sinks import shortlist_facts, write_metrics, write_samples, write_shortlist

FIRST = 25  # the report's limit
PER_FILE = 200


def _facts(candidates):
    return candidates.select(
        "candidate_id", "name", F.round("years_of_experience", 6).alias("years"), "current_title",
        F.size("career").cast("bigint").alias("n_roles"), F.size("skills").cast("bigint").alias("n_skills"),
    )


def _lines(spark, sf_dir):
    return raw_profiles(spark, sf_dir).select("candidate_id", F.to_json(F.struct("*")).alias("value"))


def profiles_from_lines(spark, sf_dir):
    """Profiles written as compressed JSON lines and read back."""
    path = work_path(spark, "lines")
    _lines(spark, sf_dir).select("value").write.option("compression", "gzip").text(path)
    return _facts(to_candidates(read_profiles(spark, path)))


def _in_files(spark, sf_dir, before, after):
    """One compressed file per ``PER_FILE`` candidates: a list of them between two texts.

    A line moves to the others of its file in compressed form.
    """
    path = work_path(spark, "arrays")
    bucket = F.floor(candidate_key(F.col("candidate_id")) / PER_FILE).alias("bucket")

    def packed(batches):
        for batch in batches:
            lines = [zlib.compress(line.encode(), 1) for line in batch["value"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["bucket"], pa.array(lines, pa.binary())], ["bucket", "line"])

    def texts(batches):
        for batch in batches:
            for at in range(len(batch)):
                lines = [zlib.decompress(line).decode() for line in batch["lines"][at].as_py()]
                text = pa.array([before + ",".join(lines) + after])
                yield pa.RecordBatch.from_arrays([batch["bucket"].slice(at, 1), text], ["bucket", "value"])

    lines = _lines(spark, sf_dir).select(bucket, "value").mapInArrow(packed, "bucket long, line binary")
    files = lines.groupBy("bucket").agg(F.collect_list("line").alias("lines")).mapInArrow(texts, "bucket long, value string")
    files.write.option("compression", "gzip").partitionBy("bucket").text(path)
    return path


def profiles_from_arrays(spark, sf_dir):
    return _facts(to_candidates(read_profiles(spark, _in_files(spark, sf_dir, "[", "]"), layout="array")))


def profiles_from_wrapped_files(spark, sf_dir):
    path = _in_files(spark, sf_dir, '{"candidates":[', "]}")
    return _facts(to_candidates(read_profiles(spark, path, layout="wrapped")))


def limited_load(spark, sf_dir):
    return _facts(first_candidates(P.candidates(spark, sf_dir), FIRST))


def record_ids(spark, sf_dir):
    """Ids of raw lines, of which every third calls them ``id`` and every fifth has none."""
    path = work_path(spark, "ids")
    k = F.col("row_index")
    renamed = F.replace("value", F.lit('"candidate_id":'), F.lit('"id":'))
    dropped = F.replace("value", F.lit('"candidate_id":'), F.lit('"other":'))
    lines = profile_lines(spark, sf_dir).select(F.when(k % 5 == 0, dropped).when(k % 3 == 0, renamed).otherwise(F.col("value")))
    lines.write.option("compression", "gzip").text(path)
    return read_json_lines(spark, path).select(record_id(F.col("value")).alias("id"))


def job_files(spark, sf_dir):
    """Job texts written as one file each and read back."""
    path = work_path(spark, "jobs")
    sp.job_texts(spark, sf_dir).select("jd_id", F.col("text").alias("value")).write.partitionBy("jd_id").text(path)
    return read_jobs(spark, f"{path}/*").select(F.md5(F.col("text").cast("binary")).alias("digest"))


def sample_lines(spark, sf_dir):
    path = work_path(spark, "samples")
    write_samples(A.samples(spark, sf_dir), path)
    back = spark.read.schema("candidate_id string, decision string, score double, prompt string").json(path)
    return back.select("candidate_id", "decision", "score", F.md5(F.col("prompt").cast("binary")).alias("prompt"))


def metrics_file(spark, sf_dir):
    path = work_path(spark, "metrics")
    made = A.reward_summary(spark, sf_dir)
    write_metrics(made, path)
    return spark.read.schema(made.schema).json(path)


def id_facts(spark, sf_dir):
    """Rows, distinct and malformed ids of the lines' records."""
    return shortlist_facts(profile_lines(spark, sf_dir).select(record_id(F.col("value")).alias("candidate_id")))


def order_years(spark, sf_dir):
    """Years of ISO dates, of other texts that start with a year, and of neither."""
    k, day = F.col("o_orderkey"), F.date_format("o_orderdate", "yyyy-MM-dd")
    text = F.when(k % 3 == 0, F.replace(day, F.lit("-"), F.lit("/"))).when(k % 7 == 0, F.concat(F.lit("x"), day)).otherwise(day)
    return table(spark, sf_dir, "orders").select("o_orderkey", year_of(text).alias("year"))


def first_paragraphs(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", RZ.first_paragraph(F.col("text")).alias("paragraph"))


def resume_current(spark, sf_dir):
    """Id, title and employer of every parsed résumé."""
    return Z.parsed(spark, sf_dir).select(
        "path", "candidate_id", F.col("profile.current_title").alias("title"), F.col("profile.current_company").alias("company")
    )


def _run(spark, sf_dir):
    out = work_path(spark, "run")
    lines = materialise(profile_lines(spark, sf_dir), "lines")
    rank_lines(lines, Q.SCHEMA, R.jobs(spark, sf_dir), P.today(), out, R.TOP)
    return out


def ranked_run(spark, sf_dir):
    """Shortlists of the valid records of a file, written and read back."""
    return spark.read.parquet(f"{_run(spark, sf_dir)}/results").select("jd_id", "candidate_id", "rank", "score")


def run_summary(spark, sf_dir):
    """A row per job of the written run, and the number of refused records."""
    out = _run(spark, sf_dir)
    refused = spark.read.schema("row_index long").json(f"{out}/quarantine").agg(F.count("*")).scalar()
    summary = spark.read.schema("jd_id string, n_returned long, n_candidates long").json(f"{out}/summary")
    return summary.select("jd_id", "n_returned", "n_candidates", refused.alias("n_refused"))


def job_need_coverage(spark, sf_dir):
    """Must-have hits and misses of every shortlisted candidate against its own job."""
    candidates, jobs = P.candidates(spark, sf_dir), R.jobs(spark, sf_dir)
    rows = need_rows(R.ranked(spark, sf_dir), candidates, jobs)
    return rows.select("jd_id", "candidate_id", F.concat_ws("|", "hits").alias("hits"), F.concat_ws("|", "misses").alias("misses"))


def _put_file(path, content):
    system, target = fs.FileSystem.from_uri(path)
    system.create_dir(target.rsplit("/", 1)[0], recursive=True)
    with system.open_output_stream(target, compression=None) as out:
        out.write(content)


def _docx(text):
    """A .docx archive with a paragraph per line."""
    space = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    body = "".join(f"<w:p><w:r><w:t>{escape(line)}</w:t></w:r></w:p>" for line in text.split("\n"))
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as archive:
        archive.writestr("word/document.xml", f'<w:document xmlns:w="{space}"><w:body>{body}</w:body></w:document>')
    return out.getvalue()


def resume_folder(spark, sf_dir):
    """Résumés written as text and .docx files in sub-folders, some empty, unknown or damaged, and read back."""
    root = work_path(spark, "resume-folder")
    k = F.regexp_extract("path", "([0-9]+)", 1).cast("bigint")
    files = sp.resumes(spark, sf_dir).select(k.alias("k"), "text")

    def write(batches):
        for batch in batches:
            for key, text in zip(batch["k"].to_pylist(), batch["text"].to_pylist(), strict=True):
                kind = key % 10
                suffix = ".xyz" if kind == 7 else ".docx" if kind in (1, 2, 3, 9) else ".txt"
                content = b"" if kind == 8 else b"no archive" if kind == 9 else _docx(text) if suffix == ".docx" else text.encode()
                _put_file(f"{root}/{key % 7}/r{key:07d}{suffix}", content)
            yield batch.select(["k"])

    files.mapInArrow(write, "k long").write.format("noop").mode("overwrite").save()
    return read_resumes(spark, root).select(
        F.substring_index("path", "/", -1).alias("name"), F.md5(F.col("text").cast("binary")).alias("digest"), "error"
    )


def loose_shortlist_file(spark, sf_dir):
    """Lines of a list of seven, which is written as ranked, without the checks of the strict format."""
    ranked = R.rank_candidates(P.candidates(spark, sf_dir), R.default_job(spark), P.today(), 7)
    path = work_path(spark, "loose")
    write_shortlist(ranked, path, strict=False)
    return spark.read.text(path).withColumnRenamed("value", "line")


def month_starts(spark, sf_dir):
    """First days of months before each order's date."""
    orders = table(spark, sf_dir, "orders")
    return orders.select("o_orderkey", *[month_start_before(F.col("o_orderdate"), n).alias(f"before_{n}") for n in (0, 5, 26)])


QUERIES = {
    "resume_folder": resume_folder,
    "loose_shortlist_file": loose_shortlist_file,
    "month_starts": month_starts,
    "profiles_from_lines": profiles_from_lines,
    "profiles_from_arrays": profiles_from_arrays,
    "profiles_from_wrapped_files": profiles_from_wrapped_files,
    "limited_load": limited_load,
    "record_ids": record_ids,
    "job_files": job_files,
    "sample_lines": sample_lines,
    "metrics_file": metrics_file,
    "id_facts": id_facts,
    "order_years": order_years,
    "first_paragraphs": first_paragraphs,
    "resume_current": resume_current,
    "ranked_run": ranked_run,
    "run_summary": run_summary,
    "job_need_coverage": job_need_coverage,
}

_FACTS = f"""
WITH {P._BASE} SELECT candidate_id, name, round(years, 6) AS years, title AS current_title,
  (SELECT count(*) FROM roles WHERE roles.k = cand.k) AS n_roles,
  (SELECT count(*) FROM claims WHERE claims.k = cand.k) AS n_skills FROM cand"""

# The run's candidates: those without an error. The ranking's SQL then reads them as the customers.
_VALID = f"""valid_customer AS (
  WITH {Q.BASE} SELECT c.* FROM customer c WHERE c.c_custkey NOT IN (SELECT row_index FROM errors))"""
_RUN = R._final(P.REQUIREMENTS).replace("FROM customer", "FROM valid_customer").replace("RECURSIVE ", f"RECURSIVE {_VALID},\n", 1)
_RUN_RANKED = f"""
run_ranked AS (
  SELECT jd_id, candidate_id, row_number() OVER (PARTITION BY jd_id ORDER BY round(final, 9) DESC, candidate_id) AS rank,
    {S.half_even('final', 4)} AS score FROM final)"""

_POOL = list(enumerate(P._POOL))
_GOT = f"""got AS (
  WITH RECURSIVE names AS (SELECT DISTINCT {S.norm('name')} AS n FROM claims),
  needs AS (SELECT ord, need, {S.norm('need')} AS m FROM ({S.values_of(_POOL)}) v(ord, need)),
  near AS (SELECT DISTINCT n AS a, m AS b FROM names, needs
           WHERE 2.0 * least(length(n), length(m)) / (length(n) + length(m)) >= 0.88),
  {S.lcs_ctes('near')},
  covers AS (
    SELECT n, need FROM names JOIN needs ON contains(n, m) OR contains(m, n) WHERE n <> ''
    UNION SELECT a, need FROM lcs JOIN needs ON needs.m = lcs.b WHERE 200 * lcs >= 88 * (length(a) + length(b)))
  SELECT DISTINCT k, need FROM claims JOIN covers ON covers.n = {S.norm('name')})"""

SQL = {
    "resume_folder": f"""
WITH {Z.TEXTS},
lines AS (
  SELECT k, text, array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> ''), chr(10)) AS told
  FROM cv)
SELECT printf('r%07d', k) || CASE WHEN k % 10 = 7 THEN '.xyz' WHEN k % 10 IN (1, 2, 3, 9) THEN '.docx' ELSE '.txt' END AS name,
  CASE WHEN k % 10 IN (1, 2, 3) THEN md5(told) WHEN k % 10 NOT IN (7, 8, 9) THEN md5(text) END AS digest,
  CASE WHEN k % 10 = 7 THEN 'unsupported resume format .xyz' WHEN k % 10 = 8 THEN 'empty file upload'
       WHEN k % 10 = 9 THEN 'not a valid .docx file: File is not a zip file' END AS error
FROM lines""",
    "loose_shortlist_file": f"""
WITH {R._ONE},{R._RANKED}
SELECT 'candidate_id,rank,score,reasoning' AS line
UNION ALL SELECT candidate_id || ',' || rank || ',' || printf('%.4f', score) || ','
  || CASE WHEN regexp_matches(reasoning, '[,"]') THEN '"' || replace(reasoning, '"', '""') || '"' ELSE reasoning END
FROM listed WHERE rank <= 7""",
    "month_starts": "SELECT o_orderkey, " + ", ".join(
        f"strftime(date_trunc('month', o_orderdate - INTERVAL {n} MONTH), '%Y-%m-%d') AS before_{n}" for n in (0, 5, 26)
    ) + " FROM orders",
    "profiles_from_lines": _FACTS,
    "profiles_from_arrays": _FACTS,
    "profiles_from_wrapped_files": _FACTS,
    "limited_load": f"SELECT * FROM ({_FACTS}) ORDER BY candidate_id LIMIT {FIRST}",
    "record_ids": """
SELECT CASE WHEN c_custkey % 5 = 0 THEN '' WHEN c_custkey % 10 = 1 THEN 'ID_' || c_custkey
  ELSE printf('CAND_%07d', c_custkey) END AS id FROM customer""",
    "job_files": f"WITH {P.JOB_TEXTS} SELECT md5(text || chr(10)) AS digest FROM jobs",
    "sample_lines": f"""
{A._LABELLED} SELECT candidate_id, decision, score, md5('[JOB DESCRIPTION]' || chr(10) || substr({A._JD}, 1, 1500) || chr(10)
  || chr(10) || '[CANDIDATE]' || chr(10) || context || chr(10) || chr(10) || {S.q(A.D.TASK)}) AS prompt FROM fair""",
    "metrics_file": A.SQL["reward_summary"],
    "id_facts": """
SELECT count(*) AS n, count(*) AS n_ids, count(*) FILTER (c_custkey % 10 = 1) AS n_malformed FROM customer""",
    "order_years": """
SELECT o_orderkey, CASE WHEN o_orderkey % 3 <> 0 AND o_orderkey % 7 = 0 THEN NULL ELSE year(o_orderdate)::INT END AS year FROM orders""",
    "first_paragraphs": r"""
SELECT doc_id, coalesce(list_filter(list_transform(regexp_split_to_array(text, '\n\s*\n'), lambda p: trim(p, ' ' || chr(9) || chr(10) || chr(13))),
  lambda p: length(p) BETWEEN 40 AND 1200)[1], substr(trim(text, ' ' || chr(9) || chr(10) || chr(13)), 1, 600)) AS paragraph FROM documents""",
    "resume_current": f"""
WITH {Z.TEXTS},{Z.SECTIONS},{Z.YEARS},{Z.CAREER},
now AS (SELECT k, first(title ORDER BY is_current DESC, place) AS title, first(company ORDER BY is_current DESC, place) AS company
        FROM career WHERE place <= 10 GROUP BY k)
SELECT path, printf('CAND_%07d', row_number() OVER (ORDER BY path)) AS candidate_id,
  coalesce(title, 'Professional') AS title, coalesce(company, 'Independent') AS company FROM cv LEFT JOIN now USING (k)""",
    "ranked_run": f"WITH {_RUN},{_RUN_RANKED} SELECT jd_id, candidate_id, rank::INT AS rank, score FROM run_ranked WHERE rank <= {R.TOP}",
    "run_summary": f"""
WITH {Q.BASE}, bad AS (SELECT count(DISTINCT row_index) AS n FROM errors), every AS (SELECT count(*) AS n FROM customer)
SELECT printf('JD_%05d', item_id) AS jd_id, least(every.n - bad.n, {R.TOP}) AS n_returned, every.n - bad.n AS n_candidates,
  bad.n AS n_refused FROM benchmark, every, bad""",
    "job_need_coverage": f"""
WITH {R._FINAL},{R._RANKED},{_GOT},
wished AS (SELECT jd_id, parts[i] AS need, i FROM (
  SELECT jd_id, string_split(skills, '|') AS parts, unnest(range(1, len(string_split(skills, '|')) + 1)) AS i FROM must))
SELECT l.jd_id, l.candidate_id,
  coalesce(string_agg(w.need, '|' ORDER BY i) FILTER (got.k IS NOT NULL), '') AS hits,
  coalesce(string_agg(w.need, '|' ORDER BY i) FILTER (got.k IS NULL), '') AS misses
FROM listed l JOIN wished w USING (jd_id) LEFT JOIN got ON got.k = l.k AND got.need = w.need GROUP BY l.jd_id, l.candidate_id""",
}
