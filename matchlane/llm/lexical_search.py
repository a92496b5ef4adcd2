"""Ranked lexical search with hashed max-sketches.

A document's index row holds its distinct terms with their counts and a sketch: terms are hashed to
``WIDTH`` coordinates, and a coordinate holds the largest count of its terms. A term's impact rises
with its count at a given document length, so the impact of that count is the coordinate's largest
impact, and the index needs no corpus statistics but its own term table (document frequencies).

A search looks all terms of a batch of queries up in the sketches of a batch of documents, one matrix
product: the weighted sum is an upper bound of the score. For each query the documents are rescored
exactly by descending bound, until the next bound is below the ``k``-th best score the task has found
so far; a task carries those best from batch to batch, and one more ranking merges the tasks. Nothing
is dropped but what the bound rules out. Queries are read in blocks of about ``BLOCK_TERMS`` terms;
each block goes to all tasks and scans the index once.

Terms are runs of ASCII letters, digits and characters beyond ASCII, A-Z lower-cased, known by 64-bit
hashes. Scores are 64-bit integers: the sum over the distinct query terms of
``w * (10**9 * tf div (1000 * tf + 8 * m))``, with ``w = floor(1000 * ln((2N + 2) / (2df + 1)))`` and
``m = 10 + 90 * n * N div L`` (N documents with a term, L their terms, n the document's, df documents
with the term, tf its count in the document).

Nulls: a null or empty text has no terms and is neither counted nor found; a null document id comes
last among ties. Repeated documents count and rank each. Query rows with the same id (null too) are
one query with the terms of all. Very long texts are read in pieces. Empty tables give no rows; other
columns are not read.
"""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from matchlane.llm.support import PUNCTUATION, SLICE_BYTES, text_slices, word_hashes
from matchlane.session import materialise

WIDTH = 1024
MANY = 255  # a sketch's coordinate for this count or any larger one
FULL = 1_000_000  # no impact reaches it
BLOCK_TERMS = 1 << 18
QUERIES, DOCUMENTS, CHUNK = 256, 512, 32


def _words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all terms and each row's range in them; one very long row is read in pieces."""
    if len(offsets) > 2 or len(data) <= 2 * SLICE_BYTES:
        return word_hashes(data, offsets, PUNCTUATION)
    hashes, at = [], 0
    while at < len(data):
        to = min(at + SLICE_BYTES, len(data))
        while to < len(data) and not PUNCTUATION[data[to]]:
            to += 1
        hashes.append(word_hashes(data[at:to], np.array([0, to - at]), PUNCTUATION)[0])
        at = to
    return np.concatenate(hashes), np.array([0, sum(map(len, hashes))])


def counted_terms(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct terms (ascending in a row), their counts, and the range of each row in them."""
    hashes, ranges = _words(data, offsets)
    terms, row = hashes.view(np.int64), np.repeat(np.arange(len(ranges) - 1), np.diff(ranges))
    order = np.lexsort((terms, row))
    terms, row = terms[order], row[order]
    first = np.ones(len(terms), bool)
    first[1:] = (terms[1:] != terms[:-1]) | (row[1:] != row[:-1])
    starts = np.flatnonzero(first)
    return terms[starts], np.diff(np.r_[starts, len(terms)]), np.searchsorted(row[starts], np.arange(len(ranges)))


def sketches(terms: np.ndarray, counts: np.ndarray, ranges: np.ndarray, width: int = WIDTH) -> np.ndarray:
    """Rows x ``width``: the largest count of the terms hashed to a coordinate, ``MANY`` at most."""
    found = np.zeros((len(ranges) - 1) * width, np.uint8)
    row = np.repeat(np.arange(len(ranges) - 1), np.diff(ranges))
    np.maximum.at(found, row * width + terms % width, np.minimum(counts, MANY).astype(np.uint8))
    return found.reshape(-1, width)


def _lists(values: np.ndarray, ranges: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(ranges.astype(np.int32)), pa.array(values))


@dataclass
class Index:
    """``docs(doc_id, n, sketch, terms, counts)``, ``terms(term, df)``, and how many documents and terms there are."""

    docs: DataFrame
    terms: DataFrame
    n_docs: int
    n_terms: int
    width: int


def build(docs: DataFrame, width: int = WIDTH) -> Index:
    """Index of all texts of ``docs(doc_id, text)``, written once."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, to, data, offsets in text_slices(batch["text"]):
                terms, counts, ranges = counted_terms(data, offsets)
                n = np.add.reduceat(np.r_[counts, 0], ranges[:-1]) * (np.diff(ranges) > 0)
                sketch = pa.array([s.tobytes() for s in sketches(terms, counts, ranges, width)], pa.binary())
                found = pa.RecordBatch.from_pydict(
                    {
                        "doc_id": batch["doc_id"].slice(at, to - at),
                        "n": pa.array(n.astype(np.int64)),
                        "sketch": sketch,
                        "terms": _lists(terms, ranges),
                        "counts": _lists(counts.astype(np.int32), ranges),
                    }
                )
                yield found.filter(pa.array(n > 0))

    schema = "doc_id long, n long, sketch binary, terms array<long>, counts array<int>"
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(rows, schema)
    stored = materialise(read, "lexical-docs")
    frequencies = stored.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    total = stored.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    return Index(stored, materialise(frequencies, "lexical-terms"), total[0], total[1], width)


def weighted_terms(index: Index, queries: DataFrame) -> DataFrame:
    """query, term, w for the distinct terms of ``queries(query, text)`` that the index knows."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, to, data, offsets in text_slices(batch["text"]):
                terms, _, ranges = counted_terms(data, offsets)
                yield pa.RecordBatch.from_pydict({"query": batch["query"].slice(at, to - at), "terms": _lists(terms, ranges)})

    read = queries.select(F.col("query").cast("long").alias("query"), "text").mapInArrow(rows, "query long, terms array<long>")
    each = read.select("query", F.explode("terms").alias("term")).distinct()
    rarity = F.log(F.lit(2.0 * index.n_docs + 2) / (2 * F.col("df") + 1))
    return each.join(index.terms, "term").select("query", "term", F.floor(1000 * rarity).alias("w"))


class Best:
    """The ``k`` best documents of each query that a task has met, and the score a further one has to reach."""

    def __init__(self, queries: int, k: int):
        self.k = k
        self.found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool))] * queries
        self.least = np.ones(queries, np.int64)
        self.rescored = 0

    def add(self, query: int, scores: np.ndarray, ids: np.ndarray, unknown: np.ndarray) -> None:
        self.rescored += len(scores)
        some = scores > 0
        new = (scores[some], ids[some], unknown[some])
        all_scores, all_ids, all_unknown = (np.concatenate(x) for x in zip(self.found[query], new, strict=True))
        order = np.lexsort((all_ids, all_unknown, -all_scores))[: self.k]
        self.found[query] = (all_scores[order], all_ids[order], all_unknown[order])
        if len(order) == self.k:
            self.least[query] = all_scores[order[-1]]


class Searcher:
    """One block of queries against batches of index rows."""

    def __init__(self, query: np.ndarray, term: np.ndarray, weight: np.ndarray, n_queries: int, n_docs: int, n_terms: int, width: int):
        """``query`` numbers the queries from 0, ascending; with one row for each of its terms."""
        self.n_docs, self.n_terms, self.width = n_docs, n_terms, width
        self.vocabulary, self.place = np.unique(term, return_inverse=True)
        self.weight, self.ranges = weight, np.searchsorted(query, np.arange(n_queries + 1))
        self.lookups = []
        for at in range(0, n_queries, QUERIES):
            lo, hi = self.ranges[at], self.ranges[min(at + QUERIES, n_queries)]
            matrix = np.zeros((width, min(QUERIES, n_queries - at)))
            np.add.at(matrix, (term[lo:hi] % width, query[lo:hi] - at), weight[lo:hi])
            self.lookups.append(matrix)

    def impacts(self, counts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        m = 10 + 90 * sizes * self.n_docs // self.n_terms
        return 10**9 * counts // np.maximum(1, 1000 * counts + 8 * m)

    def search(self, ids: np.ndarray, unknown: np.ndarray, sizes: np.ndarray, sketch: np.ndarray, terms: np.ndarray, counts: np.ndarray, ranges: np.ndarray, best: Best) -> None:
        """Bounds of all documents, then exact scores by descending bound."""
        folded = sketch.astype(np.int64)
        ceiling = np.where(sketch == MANY, FULL, self.impacts(folded, sizes[:, None])).astype(np.float64)
        bounds = np.concatenate([ceiling @ matrix for matrix in self.lookups], 1)  # whole numbers below 2**53
        promising = bounds >= best.least
        asked = np.flatnonzero(promising.any(0))
        if not len(asked):
            return
        keys, impact = self._matches(promising.any(1), sizes, terms, counts, ranges)
        for q in asked:
            places, weights = (x[self.ranges[q] : self.ranges[q + 1]] for x in (self.place, self.weight))
            open_rows = np.flatnonzero(promising[:, q])
            open_rows = open_rows[np.argsort(-bounds[open_rows, q], kind="stable")]
            for at in range(0, len(open_rows), CHUNK):
                rows = open_rows[at : at + CHUNK]
                rows = rows[bounds[rows, q] >= best.least[q]]
                if not len(rows):
                    break
                wanted = rows[:, None] * len(self.vocabulary) + places
                found = np.searchsorted(keys, wanted)
                known = keys[np.minimum(found, len(keys) - 1)] == wanted if len(keys) else np.zeros(wanted.shape, bool)
                scores = np.where(known, impact[found * known], 0) @ weights if len(keys) else np.zeros(len(rows), np.int64)
                best.add(q, scores, ids[rows], unknown[rows])

    def _matches(self, wanted: np.ndarray, sizes: np.ndarray, terms: np.ndarray, counts: np.ndarray, ranges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ascending (row, vocabulary) keys and impacts of the query terms in the ``wanted`` rows."""
        row = np.repeat(np.arange(len(sizes)), np.diff(ranges))
        at = np.flatnonzero(wanted[row])
        place = np.minimum(np.searchsorted(self.vocabulary, terms[at]), len(self.vocabulary) - 1)
        known = self.vocabulary[place] == terms[at]
        at, place = at[known], place[known]
        return row[at] * len(self.vocabulary) + place, self.impacts(counts[at].astype(np.int64), sizes[row[at]])


def search_block(index: Index, block: list, k: int) -> DataFrame:
    """query, doc_id, score: each task's best for a block of (query, term, w) rows."""
    names = sorted({r["query"] for r in block}, key=lambda q: (q is None, q))
    number = {q: i for i, q in enumerate(names)}
    rows = sorted((number[r["query"]], r["term"], r["w"]) for r in block)
    query, term, weight = (np.array(x, np.int64) for x in zip(*rows, strict=True))
    n_docs, n_terms, width = index.n_docs, index.n_terms, index.width

    def ranked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searcher = Searcher(query, term, weight, len(names), n_docs, n_terms, width)
        best = Best(len(names), k)
        for whole in batches:
            for at in range(0, len(whole), DOCUMENTS):
                batch = whole.slice(at, DOCUMENTS)
                ranges = np.r_[0, np.cumsum(batch["terms"].value_lengths().to_numpy())]
                searcher.search(
                    batch["doc_id"].fill_null(0).to_numpy(),
                    batch["doc_id"].is_null().to_numpy(zero_copy_only=False),
                    batch["n"].to_numpy(),
                    np.frombuffer(b"".join(batch["sketch"].to_pylist()), np.uint8).reshape(-1, width),
                    batch["terms"].flatten().to_numpy(),
                    batch["counts"].flatten().to_numpy(),
                    ranges,
                    best,
                )
        for name, (scores, ids, unknown) in zip(names, best.found, strict=True):
            yield pa.RecordBatch.from_pydict(
                {"query": pa.array([name] * len(ids), pa.int64()), "doc_id": pa.array(ids, mask=unknown), "score": scores}
            )

    return index.docs.mapInArrow(ranked, "query long, doc_id long, score long")


def search(index: Index, queries: DataFrame, k: int = 10, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """query, rank, doc_id, score: the ``k`` best documents with a score above 0 of each of ``queries(query, text)``."""
    weighted = materialise(weighted_terms(index, queries), "lexical-queries")
    blocks = -(-weighted.count() // block_terms)
    dealt = weighted.withColumn("block", F.pmod(F.xxhash64("query"), F.lit(blocks or 1)))
    found = index.docs.sparkSession.createDataFrame([], "query long, doc_id long, score long")
    for block in range(blocks):
        rows = dealt.where(F.col("block") == block).drop("block").collect()  # about ``block_terms`` rows
        if rows:
            found = found.unionByName(search_block(index, rows, k))
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query", "rank", "doc_id", "score")
