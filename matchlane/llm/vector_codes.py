"""Vector codes: every part of a vector becomes the index of the nearest entry of that part's codebook.

Components become integers ``floor(scale * x)`` and vectors are cut into consecutive parts. Codebooks
start as the parts of the vectors with the smallest ids and move through rounds of assignment and
averaging (floor of the mean; an entry nobody chose stays), all in integers, so results do not depend
on the order of rows or tasks. Whole numbers travel as doubles, which hold them exactly; batches and
codebooks with numbers whose squares could leave 64 bits are reckoned in Python's integers.

Assignment reads the distinct pieces of a part in lexicographic order, that is as a trie with a
component on each level. It is walked depth first; a node holds the squared distances of its prefix to
all entries, and its children add one component to them, so pieces with a common prefix share that
sum. A leaf takes the argmin (ties to the lower index) and counts with the number of its vectors.
Subtrees of up to ``LEAVES`` pieces are walked level by level, a matrix for each level.

The distinct pieces are counted once, before the shuffle, and stored in lexicographic ranges: each
task walks a stretch of the tries, all rounds read that table, and a piece that a third of all vectors
share is one leaf. Rounds return one row per task, part and entry. The last assignment builds the
tries over each batch of vectors, so that codes need no join.

Nulls: vectors that are null, hold null or non-finite components, or are of another length than the
most frequent one (ties: the shorter) take no part. Scaled components beyond the range of doubles count
as its ends; an error beyond 64 bits is null. Lengths that the parts do not divide are cut as evenly as possible; with fewer components than
parts some parts are empty, with index 0. Repeated ids are vectors each (first in order of their
components before scaling where ids tie; null ids last). Fewer vectors than entries give smaller codebooks, no
vectors no rows. Other columns are kept by ``encode`` and not read.
"""

import hashlib
import math
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from matchlane.operators.joins import join_lookup
from matchlane.session import materialise

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
LEAVES = 4096
BATCH_ROWS = 16384
LIMB_BITS = 40


def whole_numbers(vector: Column, scale: int = SCALE) -> Column:
    """``floor(scale * x)`` of every component, as doubles; null where the vector takes no part."""
    v = vector.cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    top = F.lit(sys.float_info.max)

    def whole(x: Column) -> Column:  # doubles from 2**52 on have no fraction, and may be beyond 64 bits
        return F.when(F.abs(x) < float(1 << 52), F.floor(x).cast("double")).otherwise(F.greatest(F.least(x, top), -top))

    return F.when(~bad, F.transform(v, lambda x: whole(x * scale)))


def in_integers(pieces: np.ndarray, book: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Both as 64-bit integers if squared distances over ``size`` components fit into them, else as Python's."""
    limit = math.isqrt((1 << 62) // max(1, size)) // 2
    if all(np.abs(x).max(initial=0) <= limit for x in (pieces, book)):
        return pieces.astype(np.int64), book.astype(np.int64)
    exact = np.frompyfunc(int, 1, 1)
    return tuple(exact(x).astype(object) for x in (pieces, book))


def cuts(size: int, parts: int) -> list[int]:
    """Where the parts of a vector of ``size`` components begin, and the end of the last."""
    return [i * size // parts for i in range(parts + 1)]


def in_order(pieces: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct ``pieces`` in lexicographic order, and the position of each row in them."""
    if pieces.shape[1] == 0:
        return pieces[:1], np.zeros(len(pieces), np.int64)
    order = np.lexsort(pieces.T[::-1])
    ranked = pieces[order]
    first = np.r_[True, (ranked[1:] != ranked[:-1]).any(1)]
    place = np.empty(len(pieces), np.int64)
    place[order] = np.cumsum(first) - 1
    return ranked[first], place


def nearest_entries(pieces: np.ndarray, book: np.ndarray, leaves: int = LEAVES) -> tuple[np.ndarray, np.ndarray]:
    """Index and squared distance of the nearest entry of ``book`` for distinct ``pieces`` in lexicographic order."""
    n, width = pieces.shape
    index, least = np.zeros(n, np.int64), np.zeros(n, pieces.dtype)
    # The level on which a piece leaves the path of the one before it.
    fork = np.zeros(n, np.int64)
    fork[1:] = (pieces[1:] != pieces[:-1]).argmax(1) if width else 0

    def settle(start: int, end: int, depth: int, shared: np.ndarray) -> None:
        """Leaves of a small subtree: one matrix of distances a level, rows taken from their parents."""
        nodes, sums = np.array([start]), shared[None]
        for level in range(depth, width):
            heads = start + np.flatnonzero(np.r_[True, fork[start + 1 : end] <= level])
            step = pieces[heads, level][:, None] - book[:, level]
            sums = sums[np.searchsorted(nodes, heads, side="right") - 1] + step * step
            nodes = heads
        index[start:end] = sums.argmin(1)
        least[start:end] = sums.min(1)

    def descend(start: int, end: int, depth: int, shared: np.ndarray) -> None:
        """Pieces ``start`` to ``end`` agree in ``depth`` components, whose distances are in ``shared``."""
        if depth == width or end - start <= leaves:
            return settle(start, end, depth, shared)
        heads = start + np.flatnonzero(np.r_[True, fork[start + 1 : end] <= depth])
        at = start
        for head, to in zip(heads, np.r_[heads[1:], end], strict=True):
            if to - at > leaves and at < head:  # the small siblings so far
                settle(at, head, depth, shared)
                at = head
            if to - head > leaves:
                step = pieces[head, depth] - book[:, depth]
                descend(head, to, depth + 1, shared + step * step)
                at = to
        if at < end:
            settle(at, end, depth, shared)

    if n:
        descend(0, n, 0, np.zeros(len(book), np.int64))
    return index, least


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)


def _gathered(batches: Iterator[pa.RecordBatch], rows: int = BATCH_ROWS) -> Iterator[pa.RecordBatch]:
    """Batches of ``rows`` rows or little more, whatever the session's batch size."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(map(len, held)) >= rows:
            yield pa.concat_batches(held)
            held = []
    if held:
        yield pa.concat_batches(held)


def limbs(whole: int) -> list[int]:
    """``whole`` in digits of ``LIMB_BITS`` bits with its sign, lowest first, which Spark can add up."""
    sign, rest = (-1, -whole) if whole < 0 else (1, whole)
    digits = [sign * (rest & ((1 << LIMB_BITS) - 1))]
    while rest := rest >> LIMB_BITS:
        digits.append(sign * (rest & ((1 << LIMB_BITS) - 1)))
    return digits


def distinct_pieces(rows: DataFrame, size: int, parts: int) -> DataFrame:
    """part, piece, n: the distinct pieces of each part, counted, in lexicographic ranges."""
    at = cuts(size, parts)
    each = F.array(*[F.struct(F.lit(p).alias("part"), F.slice("v", at[p] + 1, at[p + 1] - at[p]).alias("piece")) for p in range(parts)])
    counted = rows.select(F.explode(each).alias("_p")).groupBy("_p.part", "_p.piece").agg(F.count("*").alias("n"))
    ranged = counted.repartitionByRange("part", "piece").sortWithinPartitions("part", "piece")
    return materialise(ranged, "code-pieces")


def moved(pieces: DataFrame, books: list[np.ndarray]) -> list[np.ndarray]:
    """The codebooks after one round: floors of the means of the pieces that chose an entry."""

    size = sum(b.shape[1] for b in books)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [np.zeros((len(b), b.shape[1] + 1), np.int64) for b in books]
        for batch in _gathered(batches):
            part = batch["part"].to_numpy()
            # A task may read several files, in any order.
            for p in np.unique(part):
                own = batch.filter(pa.array(part == p))
                found, book = in_integers(_matrix(own["piece"], books[p].shape[1]), books[p], size)
                n = own["n"].to_numpy().astype(object)
                index, _ = nearest_entries(found, book)
                counted = np.c_[n[:, None], found * n[:, None]]
                wide = int(np.abs(counted).sum()) + int(np.abs(total[p]).max()) >= 1 << 62
                total[p] = total[p].astype(object) if wide else total[p]
                np.add.at(total[p], index, counted.astype(total[p].dtype))
        rows = [
            (p, int(entry), at, limb, x)
            for p, t in enumerate(total)
            for entry in np.flatnonzero(t[:, 0])
            for at, whole in enumerate(t[entry])
            for limb, x in enumerate(limbs(int(whole)))
        ]
        yield pa.RecordBatch.from_pylist([dict(zip(found_schema.names, r, strict=True)) for r in rows], found_schema)

    found_schema = pa.schema([("part", pa.int32()), ("entry", pa.int32()), ("at", pa.int32()), ("limb", pa.int32()), ("x", pa.int64())])
    found = pieces.mapInArrow(sums, "part int, entry int, at int, limb int, x long")
    whole = found.groupBy("part", "entry", "at", "limb").agg(F.sum("x").alias("x"))
    sums_of: dict[tuple[int, int], dict[int, int]] = {}
    for r in whole.collect():  # a few numbers per component of a codebook
        entry = sums_of.setdefault((r.part, r.entry), {})
        entry[r.at] = entry.get(r.at, 0) + (r.x << (LIMB_BITS * r.limb))
    books = [b.copy() for b in books]
    for (part, entry), total in sums_of.items():
        means = [total[i + 1] // total[0] for i in range(books[part].shape[1])]
        if any(abs(m) >= 1 << 62 for m in means):
            books[part] = books[part].astype(object)
        books[part][entry] = means
    return books


def learn(rows: DataFrame, first: DataFrame, size: int, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> list[np.ndarray]:
    """Codebooks, by part a matrix of entries, from ``rows(vec_id, v)`` of ``size`` components.

    They start as the ``v`` of the first rows of ``first(vec_id, embedding, v)``, which holds the same vectors.
    """
    chosen = first.orderBy(F.asc_nulls_last("vec_id"), "embedding").limit(entries).select("v").collect()
    exact = [[int(x) for x in r.v] for r in chosen]
    large = any(abs(x) >= 1 << 62 for v in exact for x in v)
    start = np.array(exact, object if large else np.int64).reshape(len(exact), size)
    at = cuts(size, parts)
    books = [start[:, a:b].copy() for a, b in zip(at, at[1:], strict=False)]
    pieces = distinct_pieces(rows, size, parts) if rounds else None
    for _ in range(rounds):
        books = moved(pieces, books)
    return books


def encode(rows: DataFrame, books: list[np.ndarray]) -> DataFrame:
    """``rows`` with ``v`` replaced by ``codes`` (a byte per part) and ``error``, the summed squared distances."""
    at = np.cumsum([0, *[b.shape[1] for b in books]])
    kept = [c for c in rows.columns if c != "v"]

    def assigned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _gathered(batches):
            vectors = _matrix(batch["v"], int(at[-1]))
            codes, error = np.zeros((len(batch), len(books)), np.uint8), np.zeros(len(batch), np.int64)
            for p, book in enumerate(books):
                found, place = in_order(vectors[:, at[p] : at[p + 1]])
                index, least = nearest_entries(*in_integers(found, book, int(at[-1])))
                codes[:, p] = index[place]
                error = error + least[place]
            if error.dtype == object:
                error = pa.array([e if e < 1 << 63 else None for e in error], pa.int64())
            columns = {c: batch[c] for c in kept} | {"codes": pa.array([c.tobytes() for c in codes], pa.binary()), "error": error}
            yield pa.RecordBatch.from_pydict(columns)

    schema = rows.select(*kept).schema.add("codes", "binary").add("error", "long")
    return rows.mapInArrow(assigned, schema)


def restore(coded: DataFrame, books: list[np.ndarray], scale: int = SCALE) -> DataFrame:
    """``coded`` with ``embedding``: the middle of the cell that each code stands for."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = np.array([list(c) for c in batch["codes"].to_pylist()], np.int64).reshape(len(batch), len(books))
            found = np.concatenate([b[codes[:, p]] for p, b in enumerate(books)], 1)
            yield batch.append_column("embedding", pa.array(list((found + 0.5) / scale), pa.list_(pa.float64())))

    return coded.mapInArrow(read, T.StructType([*coded.schema.fields, T.StructField("embedding", T.ArrayType(T.DoubleType()))]))


def fingerprint(books: list[np.ndarray]) -> str:
    """SHA-256 of all components in decimal, by part, entry and position."""
    return hashlib.sha256(",".join(str(x) for b in books for x in b.ravel()).encode()).hexdigest()


def compress(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> tuple[DataFrame, list[np.ndarray]]:
    """``vec_id, label, codes, error`` of every vector, and the codebooks."""
    if entries > 256:
        raise ValueError("an index has to fit into a byte")
    rows = vectors.select("vec_id", "label", whole_numbers(F.col("embedding"), scale).alias("v")).where("v is not null")
    rows = materialise(rows, "code-vectors")
    shape = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if shape is None:
        return rows.select("vec_id", "label", F.lit(b"").alias("codes"), F.lit(0).cast("long").alias("error")), []
    rows = rows.where(F.size("v") == shape.d)
    whole = whole_numbers(F.col("embedding"), scale).alias("v")
    first = vectors.select("vec_id", "embedding", whole).where((F.size("v") == shape.d) & F.col("v").isNotNull())
    books = learn(rows, first, shape.d, parts, entries, rounds)
    return encode(rows, books), books


def with_label_error(coded: DataFrame) -> DataFrame:
    """Adds ``label_error``: ``error`` summed over rows with an equal label, nulls together."""
    keyed = materialise(coded.withColumn("_none", F.col("label").isNull()).withColumn("_label", F.coalesce(F.col("label").cast("string"), F.lit(""))), "codes")
    sums = keyed.groupBy("_none", "_label").agg(F.try_sum("error").alias("label_error"))
    return join_lookup(keyed, sums, ["_none", "_label"], F.col("vec_id")).drop("_none", "_label")
