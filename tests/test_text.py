import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from matchlane.functions.text import char_ngrams, indel_ratio, lcs_length, normalise, tokenize


def one(spark, make, *values):
    names = [f"c{i}" for i in range(len(values))]
    row = spark.createDataFrame([values], ", ".join(f"{n} string" for n in names))
    return row.select(make(*[F.col(n) for n in names]).alias("x")).first().x


def test_normalise_keeps_technical_punctuation(spark):
    assert one(spark, normalise, "Node.js + C++") == "node.js + c++"


@pytest.mark.parametrize(
    "text, expected",
    [("since 2019 at", "since at"), ("v20190", "v20190"), ("é2020 x", "2020 x"), ("2020-2021", "-"), ("", "")],
)
def test_normalise_drops_standalone_years_only(spark, text, expected):
    assert one(spark, normalise, text) == expected


def test_null_text_is_empty(spark):
    row = spark.createDataFrame([(None,)], "t string")
    assert row.select(normalise(F.col("t")).alias("n"), tokenize(F.col("t")).alias("t")).first() == ("", [])


def test_tokenize_collapses_synonyms_and_drops_stopwords(spark):
    tokens = one(spark, tokenize, "AI and ML engineer with NLP and LLMs")
    assert "and" not in tokens and tokens.count("ai_ml") == 2 and {"llm", "nlp"} <= set(tokens)


def test_short_input_is_its_own_ngram(spark):
    assert one(spark, char_ngrams, "ab") == ["ab"]
    assert one(spark, char_ngrams, "ab cd") == ["ab_", "b_c", "_cd"]


def test_similarity_counts_inserts_and_deletes(spark):
    assert one(spark, indel_ratio, "postgresql", "postgres") == pytest.approx(88.889, abs=1e-3)


def plain_lcs(a, b):
    rows = [[0] * (len(b) + 1)]
    for x in a:
        row = [0]
        for j, y in enumerate(b):
            row.append(rows[-1][j] + 1 if x == y else max(rows[-1][j + 1], row[j]))
        rows.append(row)
    return rows[-1][-1]


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(pairs=st.lists(st.tuples(st.text("abc", min_size=1, max_size=9), st.text("abc", min_size=1, max_size=9)), min_size=20, max_size=20))
def test_lcs_against_plain_dynamic_programming(spark, pairs):
    df = spark.createDataFrame(pairs, "a string, b string")
    for row in df.select("a", "b", lcs_length(F.col("a"), F.col("b")).alias("n")).collect():
        assert row.n == plain_lcs(row.a, row.b)


def test_lcs_of_long_texts_crosses_words(spark):
    rng = random.Random(7)
    for size in (61, 62, 63, 124, 125, 200):
        a = "".join(rng.choices("abcé", k=size))
        b = "".join(rng.choices("abcé", k=rng.randint(1, 150)))
        assert one(spark, lcs_length, a, b) == plain_lcs(a, b) == one(spark, lcs_length, b, a)
    assert one(spark, lcs_length, "a" * 130, "a" * 130) == 130 and one(spark, lcs_length, "", "ab") == 0
