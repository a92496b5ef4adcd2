import hashlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from matchlane.llm import queries, vector_codes

SCHEMA = "vec_id long, embedding array<double>, label int, codes string, v string"


def brute_force(rows, parts, entries, rounds, scale=256):
    kept = [(i, [int(np.floor(scale * x)) for x in v], label) for i, v, label in rows]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    cuts = [p * len(kept[0][1]) // parts for p in range(parts + 1)]
    books = [[v[a:b] for _, v, _ in kept[:entries]] for a, b in zip(cuts, cuts[1:], strict=False)]

    def nearest(p, piece):
        return min((sum((x - y) ** 2 for x, y in zip(piece, e, strict=True)), i) for i, e in enumerate(books[p]))

    for _ in range(rounds):
        for p, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            members = {}
            for _, v, _ in kept:
                members.setdefault(nearest(p, v[a:b])[1], []).append(v[a:b])
            for i, found in members.items():
                books[p][i] = [sum(x) // len(found) for x in zip(*found, strict=True)]
    result = Counter()
    for i, v, label in kept:
        best = [nearest(p, v[a:b]) for p, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
        result[i, bytes(e for _, e in best), sum(d for d, _ in best), label] += 1
    return result, books


@pytest.mark.parametrize("leaves", [1, 3, 50, 4096])
def test_trie_against_all_entries(leaves):
    rng = np.random.default_rng(leaves)
    pieces, _ = vector_codes.in_order(rng.integers(-4, 4, (900, 4)))
    book = rng.integers(-4, 4, (17, 4))
    index, least = vector_codes.nearest_entries(pieces, book, leaves)
    distances = ((pieces[:, None] - book[None]) ** 2).sum(2)
    assert (index == distances.argmin(1)).all() and (least == distances.min(1)).all()


def test_prefixes_are_shared(monkeypatch):
    """The walk adds one component per node of the trie, not one per component of each piece."""
    pieces, _ = vector_codes.in_order(np.array([(a, b, c, d) for a in range(3) for b in range(3) for c in range(3) for d in range(30)]))
    rows = []
    real = np.searchsorted
    monkeypatch.setattr(np, "searchsorted", lambda a, v, **k: rows.append(len(v)) or real(a, v, **k))
    vector_codes.nearest_entries(pieces, np.zeros((2, 4), np.int64))
    assert rows == [3, 9, 27, 810]


def test_codes_against_brute_force(spark):
    rng = np.random.default_rng(5)
    vectors = np.round(rng.standard_normal((150, 10)), 1)
    vectors[20:90] = vectors[3]  # a hot vector
    rows = [(int(i % 140), v.tolist(), [None, 1, 2][i % 3]) for i, v in enumerate(vectors)] + [(None, [0.5] * 10, 1)]
    odd = [(900, None, 1), (901, [None] * 10, 1), (902, [float("nan")] * 10, 1), (903, [float("inf")] * 10, 2), (904, [1.0] * 9, 1), (905, [], 1)]
    table = spark.createDataFrame([(*r, "x", "y") for r in rows + odd], SCHEMA)
    for parts in (4, 16):  # 16 parts of 10 components: some are empty
        coded, books = vector_codes.compress(table, parts, 8, 2)
        want, want_books = brute_force(rows, parts, 8, 2)
        assert [b.tolist() for b in books] == want_books
        assert Counter((r.vec_id, bytes(r.codes), r.error, r.label) for r in coded.collect()) == want
    sums = {(r.label, r.label_error) for r in vector_codes.with_label_error(coded).collect()}
    errors = Counter()
    for (_, _, error, label), n in want.items():
        errors[label] += error * n
    assert sums == set(errors.items())
    near = vector_codes.restore(coded, books).select("vec_id", "embedding", "error").collect()
    assert all(len(r.embedding) == 10 for r in near)


def test_few_huge_or_no_vectors(spark):
    assert vector_codes.compress(spark.createDataFrame([], SCHEMA))[0].count() == 0
    huge = spark.createDataFrame([(1, [1e300, -1e300], 1, "", ""), (2, [0.0, 0.0], None, "", "")], SCHEMA)
    coded, books = vector_codes.compress(huge, 2, 64, 1)
    assert [len(b) for b in books] == [2, 2]
    assert sorted((r.vec_id, bytes(r.codes), r.error) for r in coded.collect()) == [(1, b"\0\0", 0), (2, b"\1\1", 0)]


def test_large_components_are_exact(spark):
    """Components beyond 2**16, also where squares leave 64 bits, keep their value."""
    rng = np.random.default_rng(9)
    for scale in (1e6, 1e15):
        vectors = rng.standard_normal((60, 4)) * scale
        vectors[::7] /= scale
        rows = [(i, v.tolist(), i % 2) for i, v in enumerate(vectors)]
        table = spark.createDataFrame([(*r, "", "") for r in rows], SCHEMA)
        coded, books = vector_codes.compress(table, 2, 8, 2)
        want, want_books = brute_force(rows, 2, 8, 2)
        assert [b.tolist() for b in books] == want_books
        got = Counter((r.vec_id, bytes(r.codes), r.error, r.label) for r in coded.collect())
        assert got == Counter({(i, c, e if e < 1 << 63 else None, label): n for (i, c, e, label), n in want.items()})


def test_pieces_of_several_files_in_any_order(spark):
    """A task that reads files of later parts first counts every piece."""
    rows = [(p, [float(a), float(p)], 1 + a) for p in (3, 1, 2, 0) for a in range(5)]
    pieces = spark.createDataFrame(rows, "part int, piece array<double>, n long").coalesce(1)
    books = [np.array([[0, p], [4, p]]) for p in range(4)]
    want = [[[sum(a * (1 + a) for a in range(3)) // 6, p], [sum(a * (1 + a) for a in (3, 4)) // 9, p]] for p in range(4)]
    assert [b.tolist() for b in vector_codes.moved(pieces, books)] == want


def test_registered_query(spark):
    sf = "/root/testdata/sf0.001"
    got = queries.op11_entry_trie(spark, sf)
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    rows = [(r.vec_id, list(r.embedding), r.label) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    want, books = brute_force(rows, 16, 64, 2)
    text = ",".join(str(x) for b in books for e in b for x in e)
    assert {r.codebooks_sha256 for r in got.collect()} == {hashlib.sha256(text.encode()).hexdigest()}
    assert Counter((r.vec_id, r.code, r.error) for r in got.collect()) == Counter((i, c.hex(), e) for i, c, e, _ in want.elements())
    assert got.select(F.sum("error")).first()[0] == sum(e for _, _, e, _ in want.elements())
