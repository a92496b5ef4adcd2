import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from matchlane.llm import lexical_search, queries
from tests.llm.support import documents, lower

QUERIES = "query long, text string, rank int, doc_id string"


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lower(text))


def brute_force(texts, asked, k):
    found = [(d, Counter(terms(t))) for d, t in texts]
    n = sum(bool(c) for _, c in found)
    total = sum(sum(c.values()) for _, c in found)
    df = Counter(t for _, c in found for t in c)
    wanted = {}
    for q, t in asked:
        wanted.setdefault(q, set()).update(terms(t))
    result = []
    for q, words in wanted.items():
        scores = []
        for d, c in found:
            m = 100 - 90 + (90 * sum(c.values()) * n) // total if total else 0
            hit = [t for t in words if c[t]]
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in hit)
            if score > 0:
                scores.append((-score, d is None, d or 0))
        result += [(q, i + 1, None if none else d, -s) for i, (s, none, d) in enumerate(sorted(scores)[:k])]
    return sorted(result, key=repr)


def rows(df):
    return sorted(((r["query"], r["rank"], r.doc_id, r.score) for r in df.collect()), key=repr)


@pytest.mark.parametrize("width, block_terms", [(1024, 1 << 18), (16, 1 << 18), (64, 40)])
def test_search_against_brute_force(spark, width, block_terms):
    rng = random.Random(width)
    vocabulary = [f"w{i}" for i in range(300)] + ["Ünder", "日本", "a1b"]
    weights = [1 / (i + 1) for i in range(len(vocabulary))]
    texts = [(i, " ".join(rng.choices(vocabulary, weights, k=rng.randint(1, 60)))) for i in range(400)]
    texts += [(500 + i, "w7 w9 W7. w250") for i in range(40)]  # ties, repeated texts
    texts += [(None, "w299 w298 w297"), (7, "w299"), (600, None), (601, ""), (602, ".,; -"), (603, "w5 " * 3000 + "w6")]
    asked = [(i, " ".join(rng.choices(vocabulary, k=8)) + " unknown") for i in range(30)]
    asked += [(100, None), (101, ""), (102, "nothing known"), (3, "w299 w5"), (None, "w7 w9"), (103, "w7 w7 w9 w250"), (104, "w299")]
    index = lexical_search.build(documents(spark, texts).repartition(3), width)
    got = lexical_search.search(index, spark.createDataFrame([(*a, 1, "x") for a in asked], QUERIES), 10, block_terms)
    assert rows(got) == brute_force(texts, asked, 10)


def test_bounds_spare_documents():
    """Most documents are ruled out by their sketches; no bound is below its score."""
    rng = np.random.default_rng(1)
    texts = [" ".join(f"w{w}" for w in rng.zipf(1.3, 200) if w < 5000) for _ in range(600)]
    data = [t.encode() for t in texts]
    offsets = np.cumsum([0, *map(len, data)])
    found, counts, ranges = lexical_search.counted_terms(np.frombuffer(b"".join(data), np.uint8), offsets)
    sizes = np.add.reduceat(counts, ranges[:-1])
    sketch = lexical_search.sketches(found, counts, ranges)
    asked = np.unique(found[ranges[17] : ranges[18]])[:12]
    weight = np.array([1000 * math.log(600 / (1 + (found == t).sum())) for t in asked]).astype(np.int64)
    searcher = lexical_search.Searcher(np.zeros(12, np.int64), asked, weight, 1, 600, int(sizes.sum()), lexical_search.WIDTH)
    best = lexical_search.Best(1, 10)
    searcher.search(np.arange(600), np.zeros(600, bool), sizes, sketch, found, counts, ranges, best)
    exact = np.zeros(600, np.int64)
    impact = searcher.impacts(counts, np.repeat(sizes, np.diff(ranges)))
    for d in range(600):
        for t, x in zip(found[ranges[d] : ranges[d + 1]], impact[ranges[d] : ranges[d + 1]], strict=True):
            exact[d] += (weight[asked == t] * x).sum()
    assert best.found[0][0].tolist() == sorted(exact, reverse=True)[:10]
    assert best.rescored < 300


def test_very_long_and_empty_tables(spark):
    long_text = "alpha " * 700_000 + "omega"
    index = lexical_search.build(documents(spark, [(1, long_text), (2, "omega"), (3, "beta")]))
    asked = spark.createDataFrame([(1, "omega alpha", 1, "")], QUERIES)
    assert rows(lexical_search.search(index, asked)) == brute_force([(1, long_text), (2, "omega"), (3, "beta")], [(1, "omega alpha")], 10)
    none = documents(spark, [])
    assert lexical_search.search(lexical_search.build(none), asked).count() == 0
    assert lexical_search.search(index, asked.limit(0)).count() == 0


def test_registered_query(spark):
    sf = "/root/testdata/sf0.001"
    got = queries.op12_max_sketches(spark, sf)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    texts = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    asked = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    assert rows(got.withColumnRenamed("item_id", "query")) == brute_force(texts, asked, 10)
