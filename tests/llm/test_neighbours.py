import numpy as np
from pyspark.sql import functions as F

from matchlane.llm import neighbours


def test_nearest_against_brute_force(spark):
    rng = np.random.default_rng(3)
    vectors = rng.standard_normal((1500, 16)).astype(np.float32) * rng.uniform(0.5, 2, (1500, 1)).astype(np.float32)
    vectors[100:500] = vectors[7]  # one hot vector
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)]
    odd = [(2000, None), (2020, [0.0] * 16), (2040, [float("nan")] * 16), (2060, [1.0] * 15), (2080, [None] + [1.0] * 15), (None, [1.0] * 16), (2100, [])]
    table = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>").withColumn("score", F.lit("x")).withColumn("rank", F.lit(1))
    got = neighbours.nearest(table, F.col("vec_id") % 20 == 0, 20).toPandas().sort_values(["query_id", "rank"])
    exact, found = vectors.astype(float), 0
    assert sorted(got.query_id.unique()) == list(range(0, 1500, 20))
    for query, rows in got.groupby("query_id"):
        products = exact @ exact[query]
        order = [i for i in np.lexsort((np.arange(1500), -products)) if i != query][:20]
        assert rows["rank"].tolist() == list(range(1, 21)) and query not in rows.vec_id.tolist()
        assert np.allclose(rows.score, products[rows.vec_id], rtol=0, atol=1e-9)
        assert sorted(rows.score, reverse=True) == rows.score.tolist()
        found += len(set(order) & set(rows.vec_id))
    assert found / (75 * 20) >= 0.9
    hot = got[got.query_id == 120]
    assert hot.vec_id.tolist()[:3] == [7, 100, 101]  # ties to the smaller id


def test_few_or_no_vectors(spark):
    schema = "vec_id long, embedding array<double>"
    assert neighbours.nearest(spark.createDataFrame([], schema), F.col("vec_id") >= 0).count() == 0
    two = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5]), (1, [0.5, 0.5])], schema)
    got = neighbours.nearest(two, F.col("vec_id") == 0).collect()
    assert [(r.query_id, r["rank"], r.vec_id, r.score) for r in got] == [(0, 1, 1, 0.5), (0, 2, 1, 0.5)]


def test_slices_keep_the_smallest_copies(spark):
    rows = spark.range(5000).selectExpr("1L AS rep", "id AS vec_id")
    assert sorted(r.vec_id for r in neighbours.smallest_copies(rows, 21, 5000).collect()) == list(range(21))
