"""Scores of index rows against many jobs, worked out where the rows are.

The weights of a block of jobs go to every task and meet the terms inside the
index row, so a (document, job) pair exists only inside one batch of a task.  What
leaves a task is a fold over its documents: a row per job for ranges and sums, at
most ``k`` rows per job for top lists, or the pairs a caller asked for.
"""

from collections.abc import Callable, Iterator
from copy import copy
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType, DoubleType, LongType, StructField, StructType

# BM25 parameters and hybrid weights.
K1, B = 1.5, 0.75
BM25_SHARE, COSINE_SHARE = 0.6, 0.4
# Scores that agree to this many decimals are ties.
DECIMALS = 9

# Query terms of the jobs that are scored in one scan, and (posting, job) products or
# (document, job) cells held at a time.
BLOCK_TERMS = 1 << 18
PRODUCTS, CELLS = 1 << 21, 1 << 20

_RANGES = ["bm25_sum", "cosine_sum", "bm25_lo", "bm25_hi", "cosine_lo", "cosine_hi"]


class Jobs:
    """Term weights of some jobs, addressed by the position of a job in ``names``."""

    def __init__(self, weights: list[Row], names: list, kind: DataType, avgdl: float):
        self.names, self.kind, self.avgdl = pa.array(names, to_arrow_type(kind)), kind, avgdl or 1.0
        number = {name: i for i, name in enumerate(names)}
        rows = sorted((r["term"], number[r["jd_id"]], r["bm25_w"], r["cos_w"]) for r in weights)
        terms = [r[0] for r in rows]
        self.terms = pa.array(sorted(set(terms)), pa.string())
        first = [i for i, t in enumerate(terms) if i == 0 or t != terms[i - 1]]
        self.starts = np.array([*first, len(rows)], np.int64)
        self.job = np.array([r[1] for r in rows], np.int64)
        self.bm25_w = np.array([r[2] for r in rows], np.float64)
        self.cos_w = np.array([r[3] for r in rows], np.float64)

    def scores(self, batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
        """(first row, end row, bm25, cosine, whether a term is shared) of slices: documents x jobs.

        ``batch`` has ``terms array<struct<term, tf>>, dl, norm``.
        """
        sizes = batch["terms"].value_lengths().fill_null(0).to_numpy()
        flat = batch["terms"].flatten()
        place = pc.index_in(flat.field("term"), value_set=self.terms)
        at = np.flatnonzero(place.is_valid().to_numpy(zero_copy_only=False))
        row = np.repeat(np.arange(len(batch)), sizes)[at]
        term = place.fill_null(0).to_numpy()[at]
        tf = flat.field("tf").to_numpy()[at].astype(np.float64)
        dl, norm = batch["dl"].to_numpy(), batch["norm"].fill_null(0.0).to_numpy()
        saturated = tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl[row] / self.avgdl))
        logged = 1.0 + np.log(tf)
        each = np.diff(self.starts)[term]
        done = np.concatenate([[0], np.cumsum(np.bincount(row, each, len(batch)))])
        most, start = max(1, CELLS // max(1, len(self.names))), 0
        while start < len(batch):
            end = int(np.searchsorted(done, done[start] + PRODUCTS, side="right")) - 1
            end = min(max(end, start + 1), start + most, len(batch))
            lo, hi = np.searchsorted(row, [start, end])
            yield start, end, *self._sums(row[lo:hi] - start, term[lo:hi], saturated[lo:hi], logged[lo:hi], norm[start:end])
            start = end

    def _sums(self, row, term, saturated, logged, norm) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n, cells = np.diff(self.starts)[term], len(norm) * len(self.names)
        posting = np.repeat(np.arange(len(term)), n)
        weight = np.arange(len(posting)) - np.repeat(np.cumsum(n) - n, n) + self.starts[term][posting]
        cell = row[posting] * len(self.names) + self.job[weight]
        shape = (len(norm), len(self.names))
        bm25 = np.bincount(cell, self.bm25_w[weight] * saturated[posting], cells).reshape(shape)
        dot = np.bincount(cell, self.cos_w[weight] * logged[posting], cells).reshape(shape)
        shared = np.bincount(cell, minlength=cells).reshape(shape) > 0
        return bm25, np.divide(dot, norm[:, None], out=np.zeros(shape), where=norm[:, None] != 0), shared


    def bounding(self) -> "Jobs":
        """The same jobs with negative weights left out, for upper bounds."""
        other = copy(self)
        other.bm25_w, other.cos_w = np.maximum(self.bm25_w, 0), np.maximum(self.cos_w, 0)
        return other


@dataclass
class Ranges:
    """Per job, the ranges of both scores over all documents; a job without a match has none (all 0)."""

    bm25_lo: np.ndarray
    bm25_hi: np.ndarray
    cosine_lo: np.ndarray
    cosine_hi: np.ndarray

    def semantic(self, bm25: np.ndarray, cosine: np.ndarray) -> np.ndarray:
        """Both scores min-max scaled, then mixed."""

        def unit(value, low, high):
            wide = high > low
            return np.where(wide, (value - low) / np.where(wide, high - low, 1.0), 0.0)

        return BM25_SHARE * unit(bm25, self.bm25_lo, self.bm25_hi) + COSINE_SHARE * unit(
            cosine, self.cosine_lo, self.cosine_hi
        )


def blocks_of(jobs: DataFrame, weights: DataFrame, block_terms: int = BLOCK_TERMS) -> Iterator[DataFrame]:
    """The jobs in blocks whose weights number about ``block_terms``; a job is never split."""
    n = max(1, -(-max(weights.count(), jobs.count()) // block_terms))
    for block in range(n):
        yield jobs.where(F.pmod(F.xxhash64("jd_id"), F.lit(n)) == block)


def loaded(jobs: DataFrame, weights: DataFrame, avgdl: float) -> Jobs:
    """One block of jobs with its weights, on the driver; jobs without an id take no part."""
    named = jobs.select("jd_id").where("jd_id is not null").distinct()
    names = sorted(r.jd_id for r in named.collect())
    return Jobs(weights.join(F.broadcast(named), "jd_id", "left_semi").collect(), names, weights.schema["jd_id"].dataType, avgdl)


def score_ranges(docs: DataFrame, block: Jobs, n_docs: int) -> DataFrame:
    """Count, sums and ranges per job that shares a term with a document; documents that share none score 0.

    A task folds its documents into one row per job before anything is exchanged.
    """

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        j = len(block.names)
        n, sums = np.zeros(j, np.int64), np.zeros((2, j))
        low, high = np.full((2, j), np.inf), np.full((2, j), -np.inf)
        for batch in batches:
            for _, _, bm25, cosine, shared in block.scores(batch):
                n += shared.sum(0)
                for i, score in enumerate((bm25, cosine)):
                    sums[i] += score.sum(0)
                    low[i] = np.minimum(low[i], np.where(shared, score, np.inf).min(0))
                    high[i] = np.maximum(high[i], np.where(shared, score, -np.inf).max(0))
        some = np.flatnonzero(n)
        columns = [n, *sums, low[0], high[0], low[1], high[1]]
        arrays = [block.names.take(pa.array(some)), *(pa.array(c[some]) for c in columns)]
        yield pa.RecordBatch.from_arrays(arrays, ["jd_id", "n", *_RANGES])

    schema = _schema(block, StructType([StructField("n", LongType())]), _RANGES)
    folded = docs.select("terms", "dl", "norm").mapInArrow(fold, schema)
    seen = F.sum("n")

    def with_zero(agg, pick, name: str) -> Column:
        return F.when(seen < n_docs, pick(agg(name), F.lit(0.0))).otherwise(agg(name)).alias(name)

    return folded.groupBy("jd_id").agg(
        seen.alias("n"),
        F.sum("bm25_sum").alias("bm25_sum"),
        F.sum("cosine_sum").alias("cosine_sum"),
        *[with_zero(F.min, F.least, f"{s}_lo") for s in ("bm25", "cosine")],
        *[with_zero(F.max, F.greatest, f"{s}_hi") for s in ("bm25", "cosine")],
    )


def known_ranges(ranges: DataFrame, block: Jobs) -> Ranges:
    """The ranges of a block's jobs, on the driver: one row per job."""
    found = {r.jd_id: r for r in ranges.collect()}
    names = block.names.to_pylist()
    return Ranges(*[np.array([found[j][n] if j in found else 0.0 for j in names]) for n in _RANGES[2:]])


def matching_pairs(docs: DataFrame, block: Jobs, keep: list[str], ranges: Ranges | None = None) -> DataFrame:
    """``jd_id, doc_key, keep…, bm25, cosine`` of every document and job that share a term; a map-only pass.

    With ``ranges`` there is ``semantic``, too.
    """

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, _, bm25, cosine, shared in block.scores(batch):
                row, job = np.nonzero(shared)
                found = {"bm25": bm25[row, job], "cosine": cosine[row, job]}
                if ranges:
                    found["semantic"] = ranges.semantic(bm25, cosine)[row, job]
                yield _rows(batch, kept, start + row, block, job, found)

    kept = ["doc_key", *keep]
    read = docs.select(*kept, "terms", "dl", "norm")
    scores = ["bm25", "cosine", "semantic"] if ranges else ["bm25", "cosine"]
    return read.mapInArrow(pairs, _schema(block, read.select(*kept).schema, scores))


def chosen_pairs(docs: DataFrame, block: Jobs, ranges: Ranges, keep: list[str], bands: np.ndarray) -> DataFrame:
    """``jd_id, keep…, semantic`` of each document with the jobs of its bands.

    ``docs`` has ``bands array<int>``; ``bands`` gives the band of each job of the block.
    """

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch["bands"].value_lengths().fill_null(0).to_numpy()
            wanted = np.zeros((len(batch), int(bands.max()) + 1), bool)
            wanted[np.repeat(np.arange(len(batch)), sizes), batch["bands"].flatten().to_numpy()] = True
            for start, end, bm25, cosine, _ in block.scores(batch):
                row, job = np.nonzero(wanted[start:end][:, bands])
                semantic = ranges.semantic(bm25, cosine)[row, job]
                yield _rows(batch, keep, start + row, block, job, {"semantic": semantic})

    read = docs.select(*keep, "bands", "terms", "dl", "norm")
    return read.mapInArrow(pairs, _schema(block, read.select(*keep).schema, ["semantic"]))


def best_documents(docs: DataFrame, block: Jobs, ranges: Ranges, doc_id: str, k: int) -> DataFrame:
    """``jd_id, doc_key, doc_id, semantic``: each task's ``k`` best documents per job.

    Documents without a common term compete with the score of no match. ``doc_id`` is a number or a
    string and breaks ties; then ``doc_key`` does.
    """

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [[] for _ in block.names]  # (-score, whether an id, id, key, semantic), sorted
        least, kind = np.full(len(best), -np.inf), pa.int64()
        for batch in batches:
            ids, keys, kind = batch[doc_id].to_pylist(), batch["doc_key"].to_numpy(), batch[doc_id].type
            for start, _, bm25, cosine, _ in block.scores(batch):
                semantic = ranges.semantic(bm25, cosine)
                rounded = np.round(semantic, DECIMALS)
                for job in np.flatnonzero((rounded >= least).any(0)):
                    rows = np.flatnonzero(rounded[:, job] >= least[job])
                    if len(rows) > k:  # ties at the cut stay
                        rows = rows[rounded[rows, job] >= -np.partition(-rounded[rows, job], k - 1)[k - 1]]
                    new = [
                        (-rounded[r, job], ids[start + r] is not None, ids[start + r], int(keys[start + r]), semantic[r, job])
                        for r in rows
                    ]
                    best[job] = sorted(best[job] + new, key=lambda x: (x[0], x[1], x[2] if x[1] else 0, x[3]))[:k]
                    if len(best[job]) == k:
                        least[job] = -best[job][-1][0]
        rows = [(job, *row) for job, found in enumerate(best) for row in found]
        if rows:
            job, _, _, ids, keys, scores = zip(*rows, strict=True)
            arrays = [block.names.take(pa.array(job)), pa.array(keys, pa.int64()), pa.array(ids, kind), pa.array(scores, pa.float64())]
            yield pa.RecordBatch.from_arrays(arrays, ["jd_id", "doc_key", doc_id, "semantic"])

    read = docs.select("doc_key", doc_id, "terms", "dl", "norm")
    return read.mapInArrow(pick, _schema(block, read.select("doc_key", doc_id).schema, ["semantic"]))


# ---- blocks of documents as pseudo-documents ---------------------------------------


def block_maxima(docs: DataFrame) -> DataFrame:
    """``block, n, dl, terms, norm``: each block of index rows as one row that no document of it exceeds.

    The largest count of every term, the shortest length and the smallest norm: scored like a document,
    it bounds the scores of all its documents from above.  A block that two tasks read has two rows.
    """

    def folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            number, first, of_row = np.unique(batch["block"].to_numpy(), return_index=True, return_inverse=True)
            flat, sizes = batch["terms"].flatten(), batch["terms"].value_lengths().fill_null(0).to_numpy()
            coded = flat.field("term").dictionary_encode()
            width = max(1, len(coded.dictionary))
            key = np.repeat(of_row, sizes) * width + coded.indices.to_numpy()
            pair, place = np.unique(key, return_inverse=True)
            largest = np.zeros(len(pair), np.int32)
            np.maximum.at(largest, place, flat.field("tf").to_numpy())
            owner, word = np.divmod(pair, width)
            dl, norm = np.full(len(number), np.iinfo(np.int32).max), np.full(len(number), np.inf)
            np.minimum.at(dl, of_row, batch["dl"].to_numpy())
            positive = batch["norm"].fill_null(0.0).to_numpy()
            np.minimum.at(norm, of_row, np.where(positive > 0, positive, np.inf))
            starts = np.searchsorted(owner, np.arange(len(number) + 1)).astype(np.int32)
            terms = pa.StructArray.from_arrays([coded.dictionary.take(pa.array(word)), pa.array(largest)], ["term", "tf"])
            yield pa.RecordBatch.from_pydict(
                {
                    "block": number,
                    "n": np.bincount(of_row, minlength=len(number)),
                    "dl": dl.astype(np.int32),
                    "terms": pa.ListArray.from_arrays(pa.array(starts), terms),
                    "norm": np.where(np.isinf(norm), 0.0, norm),
                }
            )

    read = docs.select("block", "dl", "terms", "norm")
    return read.mapInArrow(folded, "block long, n long, dl int, terms array<struct<term:string,tf:int>>, norm double")


def leading_blocks(blocks: DataFrame, block: Jobs, n: int) -> DataFrame:
    """``block``: per task and job, the ``n`` blocks with the largest bounds of either score."""
    bounds = block.bounding()

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [(np.zeros((0, len(block.names))), np.zeros((0, len(block.names)), np.int64)) for _ in range(2)]
        for batch in batches:
            numbers = batch["block"].to_numpy()
            for start, end, *scores, _ in bounds.scores(batch):
                for i, score in enumerate(scores):
                    values = np.vstack([best[i][0], score])
                    owners = np.vstack([best[i][1], np.repeat(numbers[start:end, None], score.shape[1], 1)])
                    order = np.argsort(-values, 0, kind="stable")[:n]
                    best[i] = np.take_along_axis(values, order, 0), np.take_along_axis(owners, order, 0)
        yield pa.RecordBatch.from_pydict({"block": np.unique(np.concatenate([owners.ravel() for _, owners in best]))})

    return blocks.mapInArrow(pick, "block long").distinct()


def blocks_reaching(blocks: DataFrame, block: Jobs, reach: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> DataFrame:
    """``block`` of those for which ``reach`` of the bounds (blocks x jobs, for bm25 and cosine) holds for a job."""
    bounds = block.bounding()

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            numbers = batch["block"].to_numpy()
            for start, end, bm25, cosine, _ in bounds.scores(batch):
                yield pa.RecordBatch.from_pydict({"block": numbers[start:end][reach(bm25, cosine).any(1)]})

    return blocks.mapInArrow(kept, "block long").distinct()


def _rows(batch: pa.RecordBatch, keep: list[str], row: np.ndarray, block: Jobs, job: np.ndarray, scores: dict) -> pa.RecordBatch:
    at = pa.array(row)
    return pa.RecordBatch.from_pydict({"jd_id": block.names.take(pa.array(job))} | {c: batch[c].take(at) for c in keep} | scores)


def _schema(block: Jobs, kept: StructType, scores: list[str]) -> StructType:
    return StructType([StructField("jd_id", block.kind), *kept.fields, *(StructField(s, DoubleType()) for s in scores)])


def per_block(jobs: DataFrame, weights: DataFrame, avgdl: float, scored: Callable[[Jobs, DataFrame], DataFrame]) -> DataFrame | None:
    """The rows of ``scored(block, jobs)`` over all blocks of jobs; None without jobs."""
    found = None
    for part in blocks_of(jobs, weights):
        block = loaded(part, weights, avgdl)
        if len(block.names):
            rows = scored(block, part)
            found = rows if found is None else found.unionByName(rows)
    return found
