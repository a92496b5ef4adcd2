"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

Every sequence of ``SEED`` words of a test item is a seed. Where a text holds seeds of one item close
to one diagonal (position in the text less position in the item), that stretch is a candidate if one
of its seeds is rare in the corpus, or if it has two different seeds; so a passage that many
documents share stays a candidate. The item is aligned with the stretch word by word; a match counts
2, a mismatch or gap -1. An item's score is the best alignment over that of an exact copy.

The benchmark is read in blocks of bounded size, each broadcast in turn, and the texts are scanned
once per block: no shuffle of texts, and no pair is made without a common seed.

Words are runs of letters and digits, A-Z lower-cased. Nulls: a null text or item is empty. Items of
fewer than ``SEED`` words have no seed and are not searched for. Repeated documents and items are
each compared. An empty benchmark or corpus gives no hits.
"""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchlane.llm.support import PUNCTUATION, row_grams, text_slices, word_hashes

SEED = 3
RARE_SHARE = 1e-6
THRESHOLD = 0.5
BLOCK_BYTES = 8 << 20
_BITS = 22


@dataclass
class Items:
    """A block of test items with their seeds, sorted by hash."""

    names: list
    words: list[np.ndarray]
    seeds: np.ndarray  # distinct hashes
    first: np.ndarray  # range of each seed in the next two
    item: np.ndarray
    position: np.ndarray
    rare: np.ndarray  # by seed
    bits: np.ndarray  # which hash prefixes occur

    def find(self, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Indices of the grams that are seeds, and which seeds they are."""
        maybe = np.flatnonzero(self.bits[grams >> np.uint64(64 - _BITS)])
        at = np.searchsorted(self.seeds, grams[maybe])
        at[at == len(self.seeds)] = 0
        hit = self.seeds[at] == grams[maybe] if len(self.seeds) else np.zeros(0, bool)
        return maybe[hit], at[hit]


def _block(rows: pa.Table, id_column: str) -> Items:
    words, ranges = [], [np.zeros(1, np.int64)]
    for part in rows.combine_chunks().to_batches():
        for _, _, data, offsets in text_slices(part.column("text")):
            found, bounds = word_hashes(data, offsets, PUNCTUATION)
            words.append(found)
            ranges.append(bounds[1:] + ranges[-1][-1])
    whole, bounds = np.concatenate([np.zeros(0, np.uint64), *words]), np.concatenate(ranges)
    at, grams = row_grams(whole, bounds, SEED)
    item = np.searchsorted(bounds, at, side="right") - 1
    order = np.argsort(grams, kind="stable")
    seeds, first = np.unique(grams[order], return_index=True)
    bits = np.zeros(1 << _BITS, bool)
    bits[seeds >> np.uint64(64 - _BITS)] = True
    return Items(
        rows.column(id_column).to_pylist(),
        [whole[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)],
        seeds,
        np.append(first, len(grams)),
        item[order],
        (at - bounds[item])[order],
        np.zeros(len(seeds), bool),
        bits,
    )


def _seed_counts(docs: DataFrame, items: Broadcast) -> tuple[np.ndarray, int]:
    """Occurrences of each seed in the corpus, and of all n-grams. At most one row per seed is returned."""

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(len(items.value.seeds) + 1, np.int64)
        for part in parts:
            for _, _, data, offsets in text_slices(part.column("text")):
                _, grams = row_grams(*word_hashes(data, offsets, PUNCTUATION), SEED)
                counts[:-1] += np.bincount(items.value.find(grams)[1], minlength=len(counts) - 1)
                counts[-1] += len(grams)
        at = np.flatnonzero(counts)
        if len(at):
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts[at])], names=["at", "n"])

    found = docs.select("text").mapInArrow(batches, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(len(items.value.seeds) + 1, np.int64)
    counts[found.column("at").to_numpy()] = found.column("n").to_numpy()
    return counts[:-1], int(counts[-1])


def alignment(item: np.ndarray, text: np.ndarray) -> float:
    """Smith-Waterman score over that of an exact copy of ``item``."""
    steps = np.arange(len(text) + 1)
    row, best = np.zeros(len(text) + 1, np.int64), 0
    for word in item:
        diagonal = row[:-1] + np.where(text == word, 2, -1)
        new = np.maximum(row - 1, 0)
        np.maximum(new[1:], diagonal, out=new[1:])
        row = np.maximum.accumulate(new + steps) - steps  # gaps in the item
        best = max(best, int(row.max()))
    return best / (2 * len(item))


def _matches(items: Items, words: np.ndarray, ranges: np.ndarray, threshold: float) -> dict[tuple[int, int], float]:
    """Best score by (row, item), of those that reach the threshold."""
    at, grams = row_grams(words, ranges, SEED)
    index, seed = items.find(grams)
    if len(index) == 0:
        return {}
    n = items.first[seed + 1] - items.first[seed]
    posting = np.repeat(items.first[seed] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
    place, seed = np.repeat(at[index], n), np.repeat(seed, n)
    row = np.searchsorted(ranges, place, side="right") - 1
    item, q = items.item[posting], items.position[posting]
    diagonal = place - q
    order = np.lexsort((diagonal, item, row))
    row, item, q, diagonal, seed = (x[order] for x in (row, item, q, diagonal, seed))
    sizes = np.array([len(w) for w in items.words])[item]
    slack = sizes // 4 + 2
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (item[1:] != item[:-1]) | (diagonal[1:] - diagonal[:-1] > slack[1:])
    starts = np.append(np.flatnonzero(new), len(row))
    best: dict[tuple[int, int], float] = {}
    for a, b in zip(starts[:-1], starts[1:], strict=True):
        if not items.rare[seed[a:b]].any() and (q[a:b] == q[a]).all():
            continue
        key = (int(row[a]), int(item[a]))
        low = max(ranges[key[0]], diagonal[a] - slack[a])
        high = min(ranges[key[0] + 1], diagonal[b - 1] + sizes[a] + slack[a])
        found = alignment(items.words[key[1]], words[low:high])
        if found >= threshold:
            best[key] = max(best.get(key, 0.0), found)
    return best


def _blocks(docs: DataFrame, benchmark: DataFrame, id_column: str, rare_share: float) -> Iterator[Broadcast]:
    """Broadcast blocks of about ``BLOCK_BYTES`` of item text."""
    texts = benchmark.select(id_column, F.coalesce("text", F.lit("")).alias("text"))
    size = texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n = -(-size // BLOCK_BYTES)
    context = docs.sparkSession.sparkContext
    for block in range(n):
        chosen = texts.where(F.pmod(F.xxhash64(id_column, "text"), F.lit(n)) == block)
        items = _block(chosen.toArrow(), id_column)
        if len(items.seeds):
            counts, total = _seed_counts(docs, context.broadcast(items))
            items.rare = counts <= max(3, rare_share * total)
            yield context.broadcast(items)


def contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    id_column: str = "item_id",
    threshold: float = THRESHOLD,
    rare_share: float = RARE_SHARE,
) -> DataFrame:
    """doc_id, item id and score of every document that holds a copy, whole or edited, of an item.

    A seed is rare if it is at most ``rare_share`` of the corpus's n-grams (or occurs three times).
    """
    kinds = [dict(docs.dtypes)["doc_id"], dict(benchmark.dtypes)[id_column]]
    schema = f"doc_id {kinds[0]}, {id_column} {kinds[1]}, score double"

    def search(items: Broadcast):
        def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in parts:
                for at, to, data, offsets in text_slices(part.column("text")):
                    best = _matches(items.value, *word_hashes(data, offsets, PUNCTUATION), threshold)
                    if not best:
                        continue
                    names = part.column("doc_id").slice(at, to - at).take(pa.array([row for row, _ in best]))
                    tests = pa.array([items.value.names[i] for _, i in best], item_type)
                    yield pa.RecordBatch.from_arrays(
                        [names, tests, pa.array(list(best.values()))], names=["doc_id", id_column, "score"]
                    )

        return batches

    item_type = benchmark.limit(0).select(id_column).toArrow().schema.field(0).type
    found = docs.sparkSession.createDataFrame([], schema)
    for items in _blocks(docs, benchmark, id_column, rare_share):
        found = found.unionByName(docs.select("doc_id", "text").mapInArrow(search(items), schema))
    return found


def keep_clean(
    docs: DataFrame,
    benchmark: DataFrame,
    id_column: str = "item_id",
    threshold: float = THRESHOLD,
    rare_share: float = RARE_SHARE,
) -> DataFrame:
    """The rows of ``docs``, all columns, that hold no item."""

    def sift(items: Broadcast):
        def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in parts:
                clean = np.ones(part.num_rows, bool)
                for at, _, data, offsets in text_slices(part.column("text")):
                    best = _matches(items.value, *word_hashes(data, offsets, PUNCTUATION), threshold)
                    clean[[at + row for row, _ in best]] = False
                yield part.filter(pa.array(clean))

        return batches

    kept = docs
    for items in _blocks(docs, benchmark, id_column, rare_share):
        kept = kept.mapInArrow(sift(items), docs.schema)
    return kept
