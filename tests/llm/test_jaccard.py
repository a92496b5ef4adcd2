import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from matchlane.llm import jaccard
from matchlane.session import materialise
from tests.llm.support import components, documents, shingles


def near_copies(seed, n=400):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(rng.choice([12, 40, 300]))]
    bases = [[rng.choice(vocabulary) for _ in range(rng.choice([1, 2, 5, 20, 60, 100]))] for _ in range(20)]
    shared = [rng.choice(vocabulary) for _ in range(60)]
    texts = []
    for i in range(n):
        base = list(bases[0] if i % 3 == 0 else rng.choice(bases))
        for _ in range(rng.choice([0, 0, 1, 2, 3, 6])):
            base[rng.randrange(len(base))] = f"u{rng.randrange(50)}"
        if rng.random() < 0.2:
            base += shared
        text = " ".join(w.upper() if rng.random() < 0.1 else w for w in base)
        texts.append((i, rng.choice([None, "", " \n\t"]) if rng.random() < 0.02 else text))
    return texts


@pytest.mark.parametrize("seed, k, num", [(1, 3, 90), (2, 5, 80)])
def test_against_brute_force(spark, seed, k, num):
    texts = near_copies(seed)
    sets = {d: shingles(t, k) for d, t in texts}
    want = {d: (len(sets[d]), c) for d, c in components(sets, num, 100).items()}
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.near_duplicates(documents(spark, texts), k, num).collect()}
    assert got == want


def test_one_of_each_keeps_whole_rows(spark, tmp_path):
    long = " ".join(f"w{i}" for i in range(30000))
    texts = [(5, "a b c d e f g h"), (3, "A b c d e f g h"), (3, "a b c d e f g h"), (None, "a b c d e f g h"), (9, None), (10, ""), (11, long), (12, long + " end")]
    documents(spark, texts).write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    kept = jaccard.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["10", "11", "3", "9", "None"]


def test_empty_table(spark):
    assert jaccard.near_duplicates(documents(spark, [])).count() == 0


def matrix_rows(label, family, sets):
    """Rows for the matrix: a family of one group."""
    return [(f"{label}-{i}", len(s), label, family, 0, sorted(s)) for i, s in enumerate(sets)]


def test_bound_of_groups_keeps_all_links(spark):
    """Documents inside a member of another family, at the threshold; other members hold later tokens."""
    inside = set(range(0, 400, 10))
    member = inside | {1, 2, 3, 4, *range(395, 401)}
    other = member - {70} | {401, 402}
    rows = matrix_rows("a", 1, [inside]) + matrix_rows("b", 2, [member, other])
    wanted = {("a-0", "b", 0)}
    rng = random.Random(1)
    for case in range(1, 300):
        tokens = [case * 10**6 + x for x in rng.sample(range(10**5), 200)]
        inside = set(tokens[:40])
        members = [inside | set(tokens[40:50])]
        for _ in range(rng.randint(1, 5)):
            few = rng.sample(sorted(members[0]), rng.randint(44, 49))
            members.append(set(few) | set(rng.sample(tokens[50:], 50 - len(few) + rng.randint(0, 1))))
        rows += matrix_rows(f"a{case}", 1, [inside]) + matrix_rows(f"b{case}", len(members), members)
        wanted.add((f"a{case}-0", f"b{case}", 0))
    names = "rep string, n long, label string, family long, chunk long, tokens array<long>"
    sets = spark.createDataFrame(rows, names).withColumns({"d1": F.lit(1), "d2": F.lit(2)})
    found = jaccard._matrix_pairs(sets, 80, 100).collect()
    assert wanted <= {(r.q.rep, r.label, r.chunk) for r in found}


def test_an_id_with_two_texts_loses_none(spark):
    a = " ".join(f"a{i}" for i in range(40))
    b = " ".join(f"b{i}" for i in range(40))
    table = documents(spark, [(1, a), (1, b), (2, b + " more"), (3, ""), (1, ""), (4, a)])
    found = sorted(map(tuple, jaccard.near_duplicates(table).select("doc_id", "n_shingles", "component_id").collect()))
    assert found == [(1, 0, 1), (1, 36, 1), (1, 36, 1), (2, 37, 1), (3, 0, 3), (4, 36, 1)]
    kept = sorted((r.doc_id, r.text) for r in jaccard.one_of_each(materialise(table, "docs")).collect())
    assert kept == sorted([(1, a), (1, b), (1, ""), (3, "")])


def test_filter_grows_with_its_keys(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOOM_BITS", 1 << 15)
    keys = materialise(spark.range(40000).select(F.xxhash64("id").alias("token")), "keys")
    table = np.frombuffer(jaccard._bloom(keys), np.uint8)
    others = spark.range(40000, 80000).select(F.xxhash64("id").alias("token")).toArrow()["token"].to_numpy()
    assert jaccard._in_bloom(table, keys.toArrow()["token"].to_numpy()).all()
    assert jaccard._in_bloom(table, others).mean() < 0.05


def test_settling_shuffles_tokens_and_owners_only(spark, monkeypatch):
    stored = []
    real = jaccard.materialise
    monkeypatch.setattr(jaccard, "materialise", lambda df, name: stored.append((name, df.columns)) or real(df, name))
    rows = [(i, 1, 2, 5, i // 2, 1, 0, [1, 2, 3, 4, 5] if i < 4 else [10 * i + x for x in range(5)]) for i in range(8)]
    names = "rep long, d1 long, d2 long, n long, label long, family long, chunk long, tokens array<long>"
    documents = real(spark.createDataFrame(rows, names), "documents")
    kept = jaccard._settled(documents, 80, 100)
    assert sorted(r.rep for r in kept.collect()) == [0, 1, 2, 3] and kept.columns == documents.columns
    assert all(columns in (["token"], documents.columns) for _, columns in stored)
