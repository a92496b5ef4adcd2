import gzip
import io
import json
import zipfile

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from matchlane.operators.ranking import canonical_order
from matchlane.sources import resumes
from matchlane.sources.candidates import first_candidates, read_json_lines, read_profiles, to_candidates
from matchlane.sources.jobs import read_jobs
from matchlane.sources.resumes import read_resumes
from matchlane.sources.sinks import ShortlistError, write_metrics, write_run, write_samples, write_shortlist

RAW = [
    {
        "candidate_id": "CAND_0000002",
        "profile": {"headline": "h", "years_of_experience": 4},
        "skills": [{"name": " Go ", "proficiency": "EXPERT", "endorsements": None}, {"name": "C"}],
        "activity": {"skill_assessment_scores": {"Go": 61.5}, "notice_period_days": 0},
    },
    {"candidate_id": "CAND_0000001"},
]


def test_json_lines_plain_and_gzip(spark, tmp_path):
    text = "\n\n".join(json.dumps(r) for r in RAW) + "\n"
    (tmp_path / "a.jsonl").write_text(text)
    with gzip.open(tmp_path / "b.jsonl.gz", "wt") as out:
        out.write(text)
    for name in ("a.jsonl", "b.jsonl.gz"):
        raw = read_profiles(spark, str(tmp_path / name), signals_field="activity")
        assert sorted(r.candidate_id for r in raw.collect()) == ["CAND_0000001", "CAND_0000002"]
    assert read_json_lines(spark, str(tmp_path / "a.jsonl")).count() == 2
    limited = first_candidates(raw, 1).collect()
    assert [r.candidate_id for r in limited] == ["CAND_0000001"]


def test_arrays_and_wrapped_lists(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps(RAW))
    (tmp_path / "w.json").write_text(json.dumps({"candidates": RAW}))
    (tmp_path / "x.json").write_text(json.dumps({"people": RAW}))
    assert read_profiles(spark, str(tmp_path / "a.json"), layout="array").count() == 2
    assert read_profiles(spark, str(tmp_path / "w.json"), layout="wrapped").count() == 2
    with pytest.raises(PySparkException, match="no 'candidates' list"):
        read_profiles(spark, str(tmp_path / "x.json"), layout="wrapped").collect()


def test_a_broken_line_fails_the_read(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text(json.dumps(RAW[0]) + "\n{oops\n")
    with pytest.raises(Exception, match="MALFORMED_RECORD_IN_PARSING|oops"):
        read_profiles(spark, str(tmp_path / "a.jsonl")).collect()


def test_defaults_of_missing_fields(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text("\n".join(json.dumps(r) for r in RAW))
    typed = to_candidates(read_profiles(spark, str(tmp_path / "a.jsonl"), signals_field="activity"), "activity")
    bare, full = typed.orderBy("candidate_id").collect()
    assert (bare.headline, bare.years_of_experience, bare.career, bare.skills, bare.education) == ("", 0.0, [], [], [])
    assert [tuple(s) for s in full.skills] == [("Go", "expert", 0, 0, 61.5), ("C", "beginner", 0, 0, None)]


def test_job_files(spark, tmp_path):
    (tmp_path / "one.txt").write_bytes("Senior – role".encode() + b"\xff")
    row = read_jobs(spark, str(tmp_path / "one.txt")).first()
    assert (row.jd_id, row.text) == ("one", "Senior – role�")


def docx(*paragraphs):
    ns = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    body = "".join(f"<w:p><w:r><w:t>{p}</w:t></w:r></w:p>" for p in paragraphs)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {ns}><w:body>{body}</w:body></w:document>")
    return out.getvalue()


def test_resume_files_of_every_kind(spark, tmp_path):
    files = {
        "a.txt": b"Jane", "b.md": b"# Jo", "noext": b"plain", "c.docx": docx("Jane Doe", "", "Engineer"),
        "d.docx": b"no zip", "e.docx": docx(""), "f.xyz": b"x", "g.txt": b"",
    }
    for name, content in files.items():
        (tmp_path / name).write_bytes(content)
    rows = {r.path.rsplit("/", 1)[1]: r for r in read_resumes(spark, str(tmp_path)).collect()}
    assert {n: r.text for n, r in rows.items() if r.error is None} == {
        "a.txt": "Jane", "b.md": "# Jo", "noext": "plain", "c.docx": "Jane Doe\nEngineer",
    }
    assert rows["d.docx"].error.startswith("not a valid .docx file")
    assert rows["e.docx"].error == "DOCX contained no text"
    assert rows["f.xyz"].error == "unsupported resume format .xyz"
    assert rows["g.txt"].error == "empty file upload"


def test_resume_folders_are_listed_in_tasks_and_read_in_small_batches(spark, tmp_path, monkeypatch):
    for i in range(12):
        folder = tmp_path / f"in/{i % 3}" / ("deep" if i % 2 else ".")
        folder.mkdir(parents=True, exist_ok=True)
        (folder / f"r{i}.txt").write_text(f"text {i}")
    (tmp_path / "in/0/big.docx").write_bytes(docx(*[f"line {i}" for i in range(5000)]))
    (tmp_path / "in/_skipped").write_text("x")
    (tmp_path / "in/top.txt").write_bytes(b"caf\xc3\xa9 \xff")
    reader = resumes.ResumeReader(f"file://{tmp_path}/in")
    parts = reader.partitions()
    assert len(parts) == 4 and sum(p.names is None for p in parts) == 3  # the driver saw no file of a sub-folder
    monkeypatch.setattr(resumes, "BATCH_BYTES", 1000)
    assert max(b.num_rows for p in parts for b in reader.read(p)) <= 5
    rows = {r.path.rsplit("/", 1)[1]: r for r in read_resumes(spark, [str(tmp_path / "in")]).collect()}
    assert set(rows) == {f"r{i}.txt" for i in range(12)} | {"big.docx", "top.txt"}
    assert rows["big.docx"].text.count("\n") == 4999 and rows["top.txt"].text == "café \ufffd"
    (tmp_path / "none").mkdir()
    assert read_resumes(spark, str(tmp_path / "none")).count() == 0
    assert rows["r1.txt"].path == f"file:{tmp_path}/in/1/deep/r1.txt"


def test_paragraphs_in_paragraphs_keep_their_order():
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    body = "<w:p><w:t>a</w:t><w:p><w:t>b</w:t></w:p><w:t>c</w:t></w:p><w:p><w:t> d </w:t></w:p>"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{w}"><w:body>{body}</w:body></w:document>')
    assert resumes._docx_text(out) == ("abc\nb\nd", None)


def ranked(spark, scores):
    rows = [(f"CAND_{i + 1:07d}", i + 1, float(s), 'said "ok",\nthen left ') for i, s in enumerate(scores)]
    return spark.createDataFrame(rows, "candidate_id string, rank int, score double, reasoning string")


def written(spark, path):
    return "".join(p.read_text() for p in sorted(path.glob("part-*.csv"))).splitlines()


def test_strict_file_is_checked_and_reordered(spark, tmp_path):
    write_shortlist(ranked(spark, range(100)), str(tmp_path / "s"))
    lines = written(spark, tmp_path / "s")
    assert lines[0] == "candidate_id,rank,score,reasoning" and len(lines) == 101
    assert lines[1] == 'CAND_0000100,1,99.0000,"said ""ok"", then left"'
    assert lines[-1].startswith("CAND_0000001,100,0.0000,")


def test_strict_file_refuses_bad_shortlists(spark, tmp_path):
    for name, bad in {
        "exactly 100": ranked(spark, [1.0]),
        "do not match": ranked(spark, range(100)).withColumn("candidate_id", F.concat(F.lit("X"), "candidate_id")),
        "repeated": ranked(spark, range(100)).withColumn("candidate_id", F.lit("CAND_0000001")),
    }.items():
        with pytest.raises(ShortlistError, match=name):
            write_shortlist(bad, str(tmp_path / "bad"))


def test_loose_file_keeps_the_given_ranks(spark, tmp_path):
    write_shortlist(ranked(spark, [0.1, 0.9]), str(tmp_path / "l"), strict=False)
    assert [line.split(",")[0] for line in written(spark, tmp_path / "l")[1:]] == ["CAND_0000001", "CAND_0000002"]


def test_equal_rounded_scores_are_ordered_by_id(spark):
    rows = canonical_order(ranked(spark, [0.50001, 0.50004]), []).orderBy("rank").collect()
    assert [r.candidate_id for r in rows] == ["CAND_0000001", "CAND_0000002"]


def test_run_samples_and_metrics_files(spark, tmp_path):
    results = ranked(spark, [0.9, 0.8]).withColumn("jd_id", F.lit("j"))
    jobs = spark.createDataFrame(
        [("j", "T", "f", "mid", 1.0, 2.0, ["Go"])],
        "jd_id string, title string, role_family string, seniority string, min_years double, max_years double, must_have_skills array<string>",
    )
    write_run(results, jobs, F.lit(7), str(tmp_path / "run"))
    summary = spark.read.json(str(tmp_path / "run" / "summary")).first()
    assert (summary.n_candidates, summary.n_returned) == (7, 2)
    write_samples(spark.createDataFrame([("é",)], "prompt string"), str(tmp_path / "samples"))
    assert "é" in "".join(p.read_text() for p in (tmp_path / "samples").glob("*.json"))
    write_metrics(spark.createDataFrame([(0.5,)], "uplift double"), str(tmp_path / "metrics"))
    assert spark.read.json(str(tmp_path / "metrics")).first().uplift == 0.5
