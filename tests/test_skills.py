import pytest
from pyspark.sql import functions as F

from matchlane import lexicons as lx
from matchlane.functions.text import normalise_literal
from matchlane.operators.skills import first_match, with_claims, with_skill_evidence

SKILLS = "id string, skills array<struct<name:string,proficiency:string,endorsements:bigint,duration_months:bigint,assessment_score:double>>"


def evidence(spark, skills):
    df = spark.createDataFrame([("a", skills)], SKILLS)
    return with_skill_evidence(df).first()


def test_padded_claims_are_stuffing(spark):
    names = ["LangChain", "Pinecone", "RAG", "Prompt Engineering", "Fine-tuning LLMs", "LoRA"]
    found = evidence(spark, [(n, "expert", 0, 1 + i % 2, None) for i, n in enumerate(names)])
    assert found.keyword_stuff_ratio == 1.0


def test_practitioner_scores_high_on_retrieval(spark):
    found = evidence(
        spark,
        [
            ("FAISS", "advanced", 40, 44, None),
            ("Elasticsearch", "advanced", 54, 44, None),
            ("Embeddings", "expert", 48, 60, None),
            ("Information Retrieval", "expert", 15, 84, None),
        ],
    )
    assert found.cluster_scores["embeddings_retrieval"] >= 0.85
    assert found.cluster_scores[lx.SURFACE_CLUSTER] == 0.0


def test_no_skills_score_zero(spark):
    found = evidence(spark, [])
    assert (found.skill_evidence, found.keyword_stuff_ratio, found.cv_or_speech_dominance) == (0.0, 0.0, 0.0)


def plain_ratio(a, b):
    from tests.test_text import plain_lcs

    return 200 * plain_lcs(a, b) / (len(a) + len(b))


def plain_cluster(name):
    n = normalise_literal(name)
    for cluster in lx.SCORED_CLUSTERS:
        for member in dict(lx.SKILL_CLUSTERS)[cluster]:
            m = normalise_literal(member)
            if n and (m in n or n in m or plain_ratio(n, m) >= lx.FUZZY_THRESHOLD):
                return cluster
    return None


def misspelt():
    """Lexicon names with a letter dropped, doubled or swapped, and unrelated ones."""
    for _, members in lx.SKILL_CLUSTERS:
        for m in members:
            yield m
            yield m[:2] + m[3:]
            yield m[:1] + m[:1] + m[1:]
            yield m[:3] + "x" + m[3:]
            yield m.replace(" ", "-")
            if len(m) > 5:
                yield m[:2] + m[3] + m[2] + m[4:]
    yield from ["c", "Excel", "post office", "sentence transfomer", "airflw", "weights and biases", "graph", ""]


def test_fast_placement_agrees_with_plain_matching(spark):
    names = sorted(set(misspelt()))
    rows = spark.createDataFrame([(n, [(n, "expert", 1, 1, None)]) for n in names], SKILLS).repartition(4)
    placed = with_claims(rows).select("id", F.col("claims")[0]["cluster"].alias("cluster")).collect()
    assert {r.id: r.cluster for r in placed} == {n: plain_cluster(n) for n in names}


def test_dictionary_match_names_the_first_member(spark):
    row = spark.createDataFrame([("postgres",), ("recomendation systems",), ("zzz",)], "n string")
    found = row.select("n", first_match(F.col("n"), lx.SCORED_CLUSTERS)["member"].alias("m")).collect()
    assert {r.n: r.m for r in found} == {"postgres": "postgresql", "recomendation systems": "recommendation systems", "zzz": None}


@pytest.mark.parametrize("min_len, cluster", [(0, "embeddings_retrieval"), (2, None)])
def test_short_names_match_inside_members_unless_told_otherwise(spark, min_len, cluster):
    row = spark.createDataFrame([("a", [("C", "expert", 1, 1, None)])], SKILLS)
    assert with_claims(row, min_len).first().claims[0].cluster == cluster
