import math
import random

import pytest
from pyspark.sql import functions as F

from matchlane.functions.text import tokenize
from matchlane.operators import joins, retrieval, scoring
from matchlane.operators.joins import join_lookup, join_split, top_k, with_ordinal
from matchlane.operators.retrieval import (
    append_documents,
    build_index,
    hybrid_scores,
    hybrid_topk,
    index_rows,
    load_index,
    overlap,
    pair_scores,
    weighted_query,
)
from matchlane.operators.scoring import loaded, score_ranges
from matchlane.session import work_path

DOCS = [
    (1, "alpha beta beta gamma"),
    (2, "alpha delta"),
    (3, "beta gamma gamma gamma epsilon"),
    (4, "alpha alpha zeta"),
    (5, ""),
]


@pytest.fixture(scope="module")
def index(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string")
    return build_index(docs, tokenize(F.col("text")), ["doc_id"])


def plain_bm25(query):
    bags = {d: t.split() for d, t in DOCS}
    n, avgdl = len(bags), sum(map(len, bags.values())) / len(bags)
    df = {}
    for bag in bags.values():
        for t in set(bag):
            df[t] = df.get(t, 0) + 1
    raw = {t: math.log(n - f + 0.5) - math.log(f + 0.5) for t, f in df.items()}
    floor = 0.25 * sum(raw.values()) / len(raw)
    idf = {t: v if v >= 0 else floor for t, v in raw.items()}
    return {
        d: sum(
            idf.get(q, 0) * bag.count(q) * 2.5 / (bag.count(q) + 1.5 * (0.25 + 0.75 * len(bag) / avgdl))
            for q in query.split()
        )
        for d, bag in bags.items()
    }


def plain_cosine(query):
    bags = {d: t.split() for d, t in DOCS}
    n = len(bags)
    df = {}
    for bag in bags.values():
        for t in set(bag):
            df[t] = df.get(t, 0) + 1
    idf = {t: math.log((1 + n) / (1 + f)) + 1 for t, f in df.items() if 2 <= f <= 0.85 * n}

    def vector(words):
        v = {t: (1 + math.log(words.count(t))) * idf[t] for t in set(words) if t in idf}
        size = math.sqrt(sum(x * x for x in v.values()))
        return {t: x / size for t, x in v.items()} if size else {}

    q = vector(query.split())
    return {d: sum(q.get(t, 0) * x for t, x in vector(bag).items()) for d, bag in bags.items()}


@pytest.mark.parametrize("query", ["beta beta alpha", "gamma zeta unknown", "alpha alpha alpha"])
def test_scores_match_the_formulas(spark, index, query):
    jobs = spark.createDataFrame([("q", query)], "jd_id string, text string")
    found = {r.doc_id: r for r in pair_scores(index, jobs, ["doc_id"]).collect()}
    assert set(found) == {d for d, t in DOCS if set(query.split()) & set(t.split())}
    for doc, score in plain_bm25(query).items():
        assert (found[doc].bm25 if doc in found else 0) == pytest.approx(score, abs=1e-12)
    for doc, score in plain_cosine(query).items():
        assert (found[doc].cosine if doc in found else 0) == pytest.approx(score, abs=1e-12)


def test_hybrid_is_scaled_per_job_and_leaves_out_strangers(spark, index):
    jobs = spark.createDataFrame([("a", "zeta alpha"), ("b", "epsilon")], "jd_id string, text string")
    rows = hybrid_scores(index, jobs, ["doc_id"]).collect()
    assert {(r.jd_id, r.doc_id) for r in rows} == {("a", 1), ("a", 2), ("a", 4), ("b", 3)}
    assert max(r.semantic for r in rows if r.jd_id == "a") == pytest.approx(1.0)


def test_lists_are_filled_with_strangers_by_id(spark, index):
    jobs = spark.createDataFrame([("a", "zeta alpha"), ("b", "epsilon"), ("c", "nothing")], "jd_id string, text string")
    got = hybrid_topk(index, jobs, 4, "doc_id").orderBy("jd_id", "rank").collect()
    assert [r.doc_id for r in got if r.jd_id == "b"] == [3, 1, 2, 4]
    assert [r.doc_id for r in got if r.jd_id == "c"] == [1, 2, 3, 4]
    assert [r.doc_id for r in got if r.jd_id == "a"][:1] == [4] and sum(r.jd_id == "a" for r in got) == 4
    assert hybrid_topk(index, jobs, 9, "doc_id").count() == 15


def test_norms_do_not_depend_on_the_head_cut(index):
    whole = {r.doc_key: r.norm for r in index_rows(index, ["doc_id"]).collect()}
    split = {r.doc_key: r.norm for r in index_rows(index, ["doc_id"], head_terms=4).collect()}
    assert whole.keys() == split.keys() and all(split[k] == pytest.approx(v) for k, v in whole.items())


def test_index_can_be_reopened(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string")
    path = work_path(spark, "kept")
    built = build_index(docs, tokenize(F.col("text")), ["doc_id"], path)
    again = load_index(spark, path)
    assert (again.n_docs, again.avgdl, again.mean_idf) == (built.n_docs, built.avgdl, built.mean_idf)
    assert again.docs.count() == len(DOCS)


def same_tables(a, b):
    """Equal rows but for the document keys."""
    order = ["doc_id", "dl", "terms", "norm"]
    return [sorted(map(repr, x.docs.select(*order).collect())) for x in (a, b)]


def test_opening_scans_nothing_and_appending_equals_rebuilding(spark):
    more = [(6, "beta omega omega"), (7, "gamma gamma alpha"), (8, None), (5, "repeated id")]
    first, rest = (spark.createDataFrame(rows, "doc_id long, text string") for rows in (DOCS, more))
    path = work_path(spark, "grown")
    build_index(first, tokenize(F.col("text")), ["doc_id"], path, wide={"shown": F.upper("text")})
    append_documents(path, rest, tokenize(F.col("text")), {"shown": F.upper("text")})
    jobs = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("opening", "")
    grown = load_index(spark, path)
    read = [jobs.getJobInfo(j) for j in jobs.getJobIdsForGroup("opening")]
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(read) == 1  # the manifest
    whole = build_index(first.unionByName(rest), tokenize(F.col("text")), ["doc_id"])
    assert (grown.n_docs, grown.n_postings) == (whole.n_docs, whole.n_postings) == (9, 16)
    assert grown.avgdl == pytest.approx(whole.avgdl) and grown.mean_idf == pytest.approx(whole.mean_idf)
    got, want = same_tables(grown, whole)
    assert got == want
    assert grown.docs.select("doc_key").distinct().count() == 9
    assert {r.shown for r in grown.wide.collect()} == {t and t.upper() for _, t in DOCS + more}
    query = spark.createDataFrame([("a", "omega beta gamma")], "jd_id string, text string")
    lists = [[(r.doc_id, round(r.semantic, 9)) for r in hybrid_topk(i, query, 5, "doc_id").orderBy("rank").collect()] for i in (grown, whole)]
    assert lists[0] == lists[1]


def test_ranges_shuffle_a_row_per_job_and_task(spark, index):
    jobs = spark.createDataFrame([("a", "zeta alpha"), ("b", "epsilon")], "jd_id string, text string")
    weights = weighted_query(index, jobs)
    block = loaded(jobs, weights, index.avgdl)
    ranges = {r.jd_id: r for r in score_ranges(index.docs, block, index.n_docs).collect()}
    pairs = pair_scores(index, jobs, ["doc_id"]).collect()
    for job in "ab":
        scores = [r.bm25 for r in pairs if r.jd_id == job]
        assert ranges[job].n == len(scores) and ranges[job].bm25_sum == pytest.approx(sum(scores))
        assert (ranges[job].bm25_lo, ranges[job].bm25_hi) == (0.0, pytest.approx(max(scores)))
    plan = score_ranges(index.docs, block, index.n_docs)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan


def test_blocks_of_jobs_change_nothing(spark, index, monkeypatch):
    jobs = spark.createDataFrame([(str(i), t) for i, (_, t) in enumerate(DOCS)], "jd_id string, text string")
    whole = sorted(map(tuple, hybrid_topk(index, jobs, 3, "doc_id").collect()))
    monkeypatch.setattr(scoring.blocks_of, "__defaults__", (2,))
    assert sorted(map(tuple, hybrid_topk(index, jobs, 3, "doc_id").collect())) == whole
    assert hybrid_topk(index, jobs.limit(0), 3, "doc_id").count() == 0


def test_few_jobs_read_few_blocks_and_find_the_same(spark, monkeypatch):
    rng = random.Random(4)
    words, odds = [f"w{i}" for i in range(400)], [1 / (i + 1) for i in range(400)]
    texts = [" ".join(rng.choices(words, odds, k=rng.randint(5, 60))) for _ in range(6000)]
    for i in range(0, 6000, 750):
        texts[i] += " rare0 rare1 rare2 rare3"
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    index = build_index(docs, tokenize(F.col("text")), ["doc_id"])
    asked = [("a", "rare0 rare1 rare3 w5"), ("b", "rare2 w9 w200")]
    jobs = spark.createDataFrame(asked, "jd_id string, text string")
    read = []
    real = retrieval.best_documents
    monkeypatch.setattr(retrieval, "best_documents", lambda docs, *rest: read.append(docs.count()) or real(docs, *rest))
    got = sorted(map(tuple, hybrid_topk(index, jobs, 5, "doc_id").collect()))
    assert len(read) == 2 and sum(read) < 4000  # the first for the k-th best so far
    read.clear()
    monkeypatch.setattr(retrieval, "BLOCKS_PER_JOB", 10**6)
    whole = sorted(map(tuple, hybrid_topk(index, jobs, 5, "doc_id").collect()))
    assert read == [6000]
    assert [(j, d, r) for j, _, d, _, r in got] == [(j, d, r) for j, _, d, _, r in whole]
    assert [s for *_, s, _ in got] == pytest.approx([s for *_, s, _ in whole])
    # A job that fewer than k documents match fills its list from all blocks.
    monkeypatch.setattr(retrieval, "BLOCKS_PER_JOB", 1)
    few = spark.createDataFrame([("c", "rare0")], "jd_id string, text string")
    ranked = [r.doc_id for r in hybrid_topk(index, few, 12, "doc_id").orderBy("rank").collect()]
    assert sorted(ranked[:8]) == list(range(0, 6000, 750)) and ranked[8:] == [1, 2, 3, 4]


def test_overlap_is_the_share_of_job_words(spark):
    row = spark.range(1).select(overlap(F.lit("The quick Fox x1"), F.lit("fox and hen quick")).alias("x"))
    assert row.first().x == 0.5


def test_salted_join_equals_the_broadcast_join(spark):
    big = spark.range(400).select((F.col("id") % 3).alias("k"), "id")
    lookup = spark.createDataFrame([(0, "a"), (1, "b"), (0, "c")], "k long, v string")
    small = join_lookup(big, lookup, ["k"], F.col("id"))
    salted = join_lookup(big, lookup, ["k"], F.col("id"), max_bytes=1, salts=5)
    assert sorted(map(tuple, small.collect())) == sorted(map(tuple, salted.collect()))
    left = join_lookup(big, lookup, ["k"], F.col("id"), "left", max_bytes=1, salts=5)
    assert left.where("v is null").count() == big.where("k = 2").count()


def test_heavy_keys_are_joined_apart(spark):
    keys = F.when(F.col("id") % 3 == 0, 0).when(F.col("id") % 50 == 1, F.lit(None)).otherwise(F.col("id") % 1500)
    big = spark.range(6000).select(keys.cast("int").alias("k"), "id")
    other = spark.range(1400).select(F.col("id").cast("int").alias("k"), (F.col("id") * 2).alias("v"))
    for how in ("inner", "left"):
        split = join_split(big, other, ["k"], F.col("id"), how, heavy_keys=100)
        assert sorted(map(repr, split.collect())) == sorted(map(repr, big.join(other, "k", how).collect()))
    sizes = joins.join_lookup(big.where("k = 0"), other.where("k = 0"), ["k"], F.col("id"), max_bytes=1, salts=8)
    per_salt = [r[0] for r in big.where("k = 0").groupBy(F.pmod(F.xxhash64("id"), F.lit(8))).agg(F.count("*").alias("n")).select("n").collect()]
    assert sizes.count() == 2000 and max(per_salt) <= 2 * sorted(per_salt)[len(per_salt) // 2]
    assert join_split(big.limit(0), other, ["k"], F.col("id")).count() == 0


def test_top_k_of_one_hot_group(spark):
    df = spark.range(5000).select(F.lit("g").alias("g"), "id", (F.col("id") * 7919 % 5003).alias("s"))
    got = top_k(df, ["g"], [F.desc("s")], 10, F.col("id")).orderBy("rank").collect()
    assert [r.s for r in got] == sorted((i * 7919 % 5003 for i in range(5000)), reverse=True)[:10]


def test_ordinals_follow_the_order(spark):
    df = spark.range(1000).select((F.col("id") * 37 % 1000).alias("v"))
    assert all(r.v == r.ordinal for r in with_ordinal(df, ["v"]).collect())
