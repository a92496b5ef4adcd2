import json

import pytest
from pyspark.sql import functions as F

from matchlane.operators.dataset import balance, gold_answer, label, overlap_scores
from matchlane.operators.rewards import Rubric, histogram, score_completions, strip_thinking, uplift

CONTEXT = "Works at Acme Corp since 2019 with Python and FAISS"


def rewards(spark, completions, rubric=Rubric()):
    samples = spark.createDataFrame(
        [("s", "shortlist", 0.8, CONTEXT)], "sample_id string, decision string, score double, context string"
    )
    rows = [("s", f"m{i}", c) for i, c in enumerate(completions)]
    made = spark.createDataFrame(rows, "sample_id string, model string, completion string")
    return [r for r in score_completions(made, samples, rubric).orderBy("model").collect()]


def test_a_grounded_answer_scores_high(spark):
    answer = {"decision": "shortlist", "score": 0.8, "reasons": ["Knows Python and FAISS well", "Joined Acme Corp in 2019"]}
    (good,) = rewards(spark, [json.dumps(answer)])
    assert (good.format_valid, good.decision_match, good.score_alignment, good.length_penalty) == (1, 1, 1, 1)
    # "Knows Python" and "Joined Acme Corp" are not in the context; FAISS and 2019 are
    assert good.no_hallucination == pytest.approx(2 / 4)
    assert good.total > 0.8


@pytest.mark.parametrize(
    "text, valid, aligned",
    [
        ("definitely no", 0, 0.0),
        ("{'decision': 'shortlist', 'score': 0.3}", 1, 0.5),
        ('x {"score": "0.8"} y', 1, 1.0),
        ('{"score": 7}', 1, 0.8),
        ('{"score": true}', 1, 0.8),
        ('{"score": null}', 1, 0.0),
        ("{broken", 0, 0.0),
        (None, 0, 0.0),
    ],
)
def test_lenient_reading_of_answers(spark, text, valid, aligned):
    (row,) = rewards(spark, [text])
    assert row.format_valid == valid and row.score_alignment == pytest.approx(aligned)


def test_length_penalty_shape(spark):
    rows = rewards(spark, ["x" * n for n in (15, 30, 1200, 1800, 3000)])
    assert [r.length_penalty for r in rows] == pytest.approx([0.5, 1.0, 1.0, 0.5, 0.0])


def test_copied_single_reason_is_worth_little(spark):
    (row,) = rewards(spark, [json.dumps({"reasons": ["python and faiss", 5, "no"]})])
    assert row.reason_quality == pytest.approx(0.5 * 0.5 * 1 / 5 + 0.3 * 1.0 + 0.2 * 0.0)


def test_thinking_is_removed(spark):
    row = spark.createDataFrame([("<Think>a\nb</think>ok<think>c</think>!",)], "t string")
    assert row.select(strip_thinking(F.col("t")).alias("t")).first().t == "ok!"


def test_histogram_closes_the_last_bin_and_uplift_subtracts(spark):
    parts = ["format_valid", "decision_match", "score_alignment", "reason_quality", "length_penalty", "no_hallucination"]
    rows = [("a", *[0.5] * 6, t) for t in (0.0, 0.05, 1.0)] + [("b", *[0.75] * 6, 0.96)]
    df = spark.createDataFrame(rows, ["model", *parts, "total"])
    assert {(r.model, r.bin): r.n for r in histogram(df).collect()} == {("a", 0): 1, ("a", 1): 1, ("a", 19): 1, ("b", 19): 1}
    assert {r.component: round(r.delta, 6) for r in uplift(df, "a", "b").collect()}["format_valid"] == 0.25


def test_labels_and_balance(spark):
    texts = [(f"c{i}", " ".join(["python"] * (i > 6) + ["search"] * (i > 7) + ["x"])) for i in range(10)]
    scored = overlap_scores(spark.createDataFrame(texts, "candidate_id string, value string"), "python search")
    labelled = label(scored, 2, ["candidate_id"])
    got = {r.candidate_id: (r.decision, r.score) for r in labelled.collect()}
    assert got["c8"] == got["c9"] == ("shortlist", 1.0)
    assert got["c7"] == ("reject", 0.5) and got["c0"] == ("reject", 1.0)
    kept = balance(labelled)
    assert sorted(r.decision for r in kept.collect()) == ["reject"] * 2 + ["shortlist"] * 2
    only = labelled.where("decision = 'reject'")
    assert balance(only).count() == only.count()


def answer_of(spark, context, decision):
    row = spark.createDataFrame([(context, decision, 0.456)], "c string, d string, s double")
    return row.select(gold_answer(F.col("c"), F.col("d"), F.col("s")).alias("a")).first().a


def test_gold_answers_cite_the_context(spark):
    context = "Current: Engineer @ Acme (1-10)\nYoE: 5.5\nTop skills: Go (expert, 3m), C (beginner, 1m)"
    accepted = answer_of(spark, context, "shortlist")
    assert accepted.score == 0.46 and accepted.reasons == [
        "Brings hands-on skills: Go (expert, 3m), C (beginner.",
        "5.5 years of experience matches the role's seniority.",
        "Currently Engineer @ Acme, relevant to the JD focus.",
    ]
    refused = answer_of(spark, "YoE: 1.0", "reject")
    assert len(refused.reasons) == 3 and refused.reasons[0].startswith("Profile lists no skills")
    assert answer_of(spark, "YoE: 3.0", "shortlist").reasons[-1].startswith("See profile")
