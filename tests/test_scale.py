"""Steps that have to grow no faster than their input."""

import re

import pyarrow as pa
from pyspark.sql import functions as F

from checks import answers, files, ranking
from matchlane.operators import dataset, resume, retrieval, validation
from matchlane.operators.retrieval import _head_cut
from matchlane.plans.run import need_rows
from matchlane.session import work_path


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_head_takes_as_many_terms_as_fit(spark):
    vocabulary = spark.createDataFrame([("a", 9), ("b", 3), ("c", 3), ("d", 2)], "term string, df long")
    assert [_head_cut(vocabulary, 17, n) for n in (4, 3, 2)] == [2, 3, 9]
    assert _head_cut(vocabulary.limit(0), 0, 4) == 2


def test_family_lowers_a_text_once(spark):
    rows = [("Search engineer, ML Engineer and ml engineer",), (None,), ("zzz",)]
    found = spark.createDataFrame(rows, "text string").select(resume.guess_family("text").alias("family"))
    assert "regexp_count" not in _plan(found) and _plan(found).count("lower(") == 1
    assert [r.family for r in found.collect()][1:] == ["", ""]


def test_words_standing_alone():
    for text in ("", "c", "c c,c", "cc c++ xc c-c 1c c1", "a.a.a", "a a.a aa.a", "éaé a"):
        for word in ("c", "c++", "a", "a.a", "a a"):
            want = re.findall(rf"(?<![A-Za-z0-9]){re.escape(word)}(?![A-Za-z0-9])", text)
            assert resume._standing_alone(text, word) == len(want), (text, word)


def test_balance_orders_ids_only(spark, monkeypatch):
    ordered = []
    real = dataset.with_ordinal
    monkeypatch.setattr(dataset, "with_ordinal", lambda df, *a: ordered.append(df.columns) or real(df, *a))
    rows = [(f"c{i // 3}", "reject", f"wide{i}") for i in range(30)] + [(f"s{i}", "shortlist", "x") for i in range(4)]
    kept = dataset.balance(spark.createDataFrame(rows, "candidate_id string, decision string, wide string")).collect()
    assert [sum(r.decision == d for r in kept) for d in ("reject", "shortlist")] == [4, 4]
    assert len({r.wide for r in kept if r.decision == "reject"}) == 4
    assert ordered and all("wide" not in columns for columns in ordered)


def test_overlaps_are_worked_out_once(spark):
    assert "to_json" not in _plan(answers.labelled(spark, "/root/testdata/sf0.001"))


def test_leaves_are_opened_by_generators(spark, monkeypatch):
    stored = []
    real = validation.materialise
    monkeypatch.setattr(validation, "materialise", lambda df, name: stored.append((name, df)) or real(df, name))
    text = '{"a":{"b":{"c":{"d":{"e":[1,{"g":null}]}}}},"":3,"x.y":[],"z":{},"s":"q"}'
    rows = spark.createDataFrame([(1, text), (2, "[]"), (3, None)], "path int, value string")
    lines = rows.select("path", F.try_parse_json("value").alias("v"))
    found = validation.flatten(lines.withColumnRenamed("path", "id"), ["id"], "v").collect()
    assert {(r.id, r.path, r.value) for r in found} == {
        (1, "a.b.c.d.e[0]", "1"), (1, "a.b.c.d.e[1].g", "null"), (1, "$", "3"), (1, "x.y", "[]"), (1, "z", "{}"),
        (1, "s", '"q"'), (2, "$", "[]"), (3, "$", None),
    }
    assert len(found) == 8 and _plan(stored[0][1]).count("variant_explode") == 4


def test_records_are_worked_out_once_for_their_differences(spark):
    schema = {"type": "object", "required": ["a", "b"], "properties": {"a": {"type": "string"}, "b": {"type": "array"}}}
    lines = spark.createDataFrame([(1, '{"a":"x","c":1}'), (2, '{"b":[]}'), (3, "4")], "id int, value string")
    found = validation.diff(validation.validate(lines, schema), ["id"], schema)
    assert "parse_json" not in _plan(found)
    assert {(r.id, r.kind, r.path) for r in found.collect()} == {
        (1, "match", "a"), (1, "missing", "b"), (1, "extra", "c"), (2, "missing", "a"), (2, "match", "b"),
        (3, "extra", "$"), (3, "missing", "a"), (3, "missing", "b"),
    }


def test_an_index_is_written_in_bounded_batches(spark, monkeypatch):
    rows, bytes_ = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"
    before, seen = [spark.conf.get(c) for c in (rows, bytes_)], []
    for name in ("index_rows", "block_maxima"):
        real = getattr(retrieval, name)
        monkeypatch.setattr(retrieval, name, lambda *a, r=real: seen.append([int(spark.conf.get(c)) for c in (rows, bytes_)]) or r(*a))
    docs = spark.createDataFrame([(i, ["a", f"t{i % 7}"]) for i in range(20)], "id int, words array<string>")
    index = retrieval.build_index(docs, F.col("words"), ["id"])
    assert index.docs.count() == 20
    assert seen == [[retrieval.KERNEL_ROWS, retrieval.BATCH_BYTES]] * 2
    assert [spark.conf.get(c) for c in (rows, bytes_)] == before


def test_sound_leaves_are_judged_without_lists(spark):
    leaf = {"type": ["integer", "number", "string", "null"], "minimum": 2, "maximum": 9, "enum": ["5", "x", 3, "2020-01-02"], "format": "date"}
    kinds = ["string", "integer", "number", "boolean", "null", "array", "object", ["string", "null"], ["integer", "string"]]
    rules = [leaf, *({"type": k} for k in kinds), {"type": "number", "minimum": 2}, {"type": "string", "pattern": "[a-z]"}, {}]
    fields = {f"f{i}": rule for i, rule in enumerate(rules)}
    inner = {"type": "object", "required": ["f1", "f2"], "additionalProperties": False, "properties": fields}
    schema = inner | {"properties": fields | {"list": {"type": "array", "items": inner}}, "required": ["f1", "list", "other"]}
    shown = ["1", "5", "2.5", "1e3", "1.0", '"x"', '"5"', '"2020-01-02"', '"a1"', '"A"', "true", "null", "[]", "{}", "[1]", '{"a":1}']
    objects = ["{" + ",".join(f'"{key}":{value}' for key in fields) + "}" for value in shown] + ["{}", "null", "3"]
    right = '{"f0":5,"f1":"x","f2":3,"f3":2.5,"f4":false,"f5":null,"f6":[1],"f7":{"a":1},"f8":null,"f9":"q","f10":2,"f11":"a","f12":{}}'
    texts = [o if len(o) < 5 else (o[:-1] + ("," if len(o) > 2 else "") + f'"list":[{right},{",".join(objects)}],"other":1}}') for o in [right, *objects]]
    lines = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, right])], "id int, value string")
    checked = validation.validate(lines, schema)
    rows = checked.withColumn("walked", validation.record_errors(schema, "_parsed")).select("id", "errors", "walked").collect()
    assert len(rows) == len(texts) + 1 and all(r.errors == r.walked for r in rows)
    assert not any(e.path.startswith("list[0]") for r in rows for e in r.errors)
    assert all(any(e.path.startswith(f"list[{at}]") for e in rows[0].errors) for at in range(1, len(objects) + 1))
    judged = validation._Typed("_parsed")
    assert not any("exists(" in judged.leaf_is_valid(rule, "v") for rule in rules)


def test_skills_are_looked_up_by_their_words(monkeypatch):
    tried, real = [], resume._standing_alone
    monkeypatch.setattr(resume, "_standing_alone", lambda text, word: tried.append(word) or real(text, word))
    text = "java, javascript; c++ c and machine learning, scikit-learn (nlp)/rag; postgresql no-sql spark" + " x" * 500
    assert resume._mentions.func(pa.array(["pythonic ragtime loras " * 9])).to_pylist() == [[]] and not tried
    found = resume._mentions.func(pa.array([text, "", None])).to_pylist()
    want = [{"hits": n, "name": s} for s in resume._SKILLS if (n := real(text, s))]
    assert found == [want, [], []] and len(want) > 3


def test_index_rows_are_ordered_without_a_sort(spark, monkeypatch):
    plans = []
    real = retrieval.materialise
    monkeypatch.setattr(retrieval, "materialise", lambda df, name, path: plans.append((name, _plan(df))) or real(df, name, path))
    rows = [(i, ["t"] * (i * 37 % 100 + 1)) for i in range(300)]
    index = retrieval.build_index(spark.createDataFrame(rows, "id long, words array<string>").coalesce(1), F.col("words"), ["id"])
    assert [plan for name, plan in plans if name == "docs" and "Sort" in plan] == [] and "docs" in dict(plans)
    spans = index.docs.groupBy("block").agg((F.max("dl") - F.min("dl")).alias("span"), F.count("*").alias("n")).collect()
    assert all(r.span <= 25 for r in spans) and sum(r.n for r in spans) == 300
    assert sorted(r.id for r in index.docs.collect()) == list(range(300))


def test_lines_and_lists_are_written_compressed(spark, monkeypatch):
    made = []
    monkeypatch.setattr(files, "work_path", lambda spark, name: made.append(work_path(spark, name)) or made[-1])
    for query in (files.record_ids, files.profiles_from_arrays, files.profiles_from_wrapped_files):
        assert query(spark, "/root/testdata/sf0.001").count() == 150
    for path in made:
        names = [r.path for r in spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path").collect()]
        assert names and all(name.endswith(".txt.gz") for name in names)


def test_breakdowns_are_worked_out_once(spark):
    assert "MapInArrow" not in _plan(ranking.breakdowns(spark, "/root/testdata/sf0.001"))


def test_needs_read_the_ranking_once(spark):
    ranked = spark.createDataFrame([("j", "a"), ("j", "b")], "jd_id string, candidate_id string").where(F.rand(1) < 2)
    jobs = spark.createDataFrame([("j", ["Python"])], "jd_id string, must_have_skills array<string>")
    candidates = spark.createDataFrame([("a", ["python"]), ("b", [])], "candidate_id string, names array<string>")
    candidates = candidates.select("candidate_id", F.transform("names", lambda n: F.struct(n.alias("name"))).alias("skills"))
    rows = need_rows(ranked, candidates, jobs)
    assert "rand(" not in _plan(rows)
    assert {(r.candidate_id, *r.hits, *r.misses) for r in rows.collect()} == {("a", "Python"), ("b", "Python")}
