"""Document scores by prediction by partial matching, and by smoothed word frequencies.

The byte model is a trie of contexts of up to three bytes with the counts of the byte that follows.
A byte's probability is taken at the longest known context; unseen bytes escape to the next shorter
one, with the escape weight of method C (distinct bytes seen / (occurrences + distinct bytes)) and
without the bytes already excluded, down to a uniform choice of the bytes left. Every text ends with
an end byte. All contexts seen twice or more in the training rows are known, so the model grows with
the corpus and is never broadcast whole: contexts that hold at least one of ``MAX_CONTEXTS`` bytes of
all rows (so at most that many of each order) are, 16 MB at most for three bytes. The cost of a byte after
any other context is worked out where all contexts with the same last two bytes are together; only the
256 x 256 counts of order 1 go to every task. As many of these bytes with their contexts as fit in
``RARE_GRAMS``, most frequent first, are broadcast with their cost, eight bytes each; only the rest, if
any, meet their cost in a shuffle.

The word counts of all training texts grow with the corpus and are never broadcast whole: words of
at least one in ``HEAD_SHARE`` tokens (so at most that many) are, with their counts; all others meet
their counts in a shuffle, where none is frequent.

Nulls: a null text is empty; a null document id counts as the empty string for the choice of
training rows. Repeated documents are counted and scored each. Without training rows the model is
uniform and the word score 0. Words are known by 64-bit hashes. Other columns are not read.
"""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchlane.llm.support import text_slices, word_hashes
from matchlane.session import materialise

ORDER = 3
MAX_CONTEXTS = 16384
RARE_GRAMS = 1 << 21
HEAD_SHARE = 2_000_000
FLUSH_BYTES = 32 << 20
FLUSH_WORDS = 1 << 20
RARE_ROWS = 1 << 14
END_WORD = np.uint64(0xE17D)


def padded(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Context codes (three bytes), symbols, and each row's first and end position in them."""
    sizes, rows = np.diff(offsets), np.arange(len(offsets) - 1)
    out = np.zeros(len(data) + (ORDER + 1) * len(rows), np.uint8)
    out[np.arange(len(data)) + np.repeat((ORDER + 1) * rows + ORDER, sizes)] = data
    wide = out.astype(np.uint32)
    codes = wide[:-3] << np.uint32(16) | wide[1:-2] << np.uint32(8) | wide[2:-1]
    first = offsets[:-1] + (ORDER + 1) * rows
    return codes, out[ORDER:], first, first + sizes + 1


@dataclass
class Model:
    """Base-10 logarithms of byte probabilities after the frequent contexts: one row of 256 per context."""

    contexts: list[np.ndarray]  # by order: sorted codes
    logs: np.ndarray  # contexts x 256, float32, all orders one after another


def known_counts(counts: np.ndarray) -> np.ndarray:
    """``counts`` (contexts x 256) without those of contexts seen only once."""
    return counts * (counts.sum(1, keepdims=True) >= 2)


def log_rows(contexts: list[np.ndarray], counts: list[np.ndarray], order: int) -> np.ndarray:
    """Logarithms (contexts x 256, float32) after the contexts of one order.

    ``counts``: by order, occurrences (contexts x 256), 0 for a context that is not known. The suffixes
    of every context have to be in ``contexts``.
    """
    logs = []
    for at in range(0, max(1, len(contexts[order])), 2048):
        codes = contexts[order][at : at + 2048]
        left, free = np.ones(len(codes)), np.ones((len(codes), 256), bool)
        result = np.zeros((len(codes), 256))
        for lower in range(order, -1, -1):
            rows = np.searchsorted(contexts[lower], codes & ((1 << 8 * lower) - 1))
            here = counts[lower][rows] * free
            total, distinct = here.sum(1), (here > 0).sum(1)
            more = (free & (here == 0)).any(1)
            weight = total + np.where(more, distinct, 0)
            share = np.divide(left, weight, out=np.zeros_like(left), where=weight > 0)
            result += here * share[:, None]
            left = np.where(weight > 0, share * np.where(more, distinct, 0), left)
            free &= here == 0
        rest = free.sum(1)
        result += free * np.divide(left, rest, out=np.zeros_like(left), where=rest > 0)[:, None]
        logs.append(np.log10(result).astype(np.float32))
    return np.concatenate(logs)


def _gram_counts(docs: DataFrame) -> DataFrame:
    """Stored (gram, n, seen): counts of (context, next byte) codes over training rows, and over all rows."""

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bool, list[np.ndarray]] = {True: [], False: []}
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            for train, lists in held.items():
                if lists:
                    grams, seen = np.unique(np.concatenate(lists), return_counts=True)
                    lists.clear()
                    n = seen if train else np.zeros_like(seen)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(grams.astype(np.int64)), pa.array(n), pa.array(seen)], names=["gram", "n", "seen"]
                    )

        for part in parts:
            trained = part.column("train").to_numpy(zero_copy_only=False).astype(bool)
            for at, to, data, offsets in text_slices(part.column("text")):
                codes, symbols, first, end = padded(data, offsets)
                for train in (True, False):
                    chosen = trained[at:to] == train
                    held[train].append(_grams(codes, symbols, _inside(len(codes), first[chosen], end[chosen])))
                    size += len(held[train][-1])
                if size >= FLUSH_BYTES:
                    yield from flush()
                    size = 0
        yield from flush()

    partial = docs.select("train", "text").mapInArrow(batches, "gram long, n long, seen long")
    return materialise(partial.groupBy("gram").agg(F.sum("n").alias("n"), F.sum("seen").alias("seen")), "ppm-grams")


def _inside(size: int, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Which of ``size`` positions lie in the rows from ``first`` to ``end``."""
    edges = np.zeros(size + 1, np.int8)
    np.add.at(edges, first, 1)
    np.add.at(edges, end, -1)
    return np.cumsum(edges[:-1], dtype=np.int8) > 0


def _grams(codes: np.ndarray, symbols: np.ndarray, keep: np.ndarray) -> np.ndarray:
    return codes[keep] << np.uint32(8) | symbols[: len(codes)][keep]


def _pair_counts(grams: DataFrame, order: int) -> DataFrame:
    """(code, byte, n, seen) of the contexts of one order."""
    code = F.shiftright("gram", 8).bitwiseAND((1 << 8 * order) - 1)
    by = grams.groupBy(code.alias("code"), F.col("gram").bitwiseAND(255).alias("byte"))
    return by.agg(F.sum("n").alias("n"), F.sum("seen").alias("seen"))


def _dense(codes: np.ndarray, byte: np.ndarray, n: np.ndarray, names: np.ndarray) -> np.ndarray:
    matrix = np.zeros((len(names), 256))
    np.add.at(matrix, (np.searchsorted(names, codes), byte), n)
    return matrix


def _frequent(grams: DataFrame, max_contexts: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Contexts by order that hold one of ``max_contexts`` bytes, and their counts where they are known.

    At most ``3 * max_contexts * 256`` counts reach the driver.
    """
    total = grams.agg(F.coalesce(F.sum("seen"), F.lit(0))).first()[0]
    contexts, counts = [], []
    least = max(2, -(-total // max_contexts))
    for order in range(ORDER + 1):
        pairs = _pair_counts(grams, order)
        if order:
            kept = pairs.groupBy("code").agg(F.sum("seen").alias("total")).where(F.col("total") >= least).select("code")
            pairs = pairs.join(kept, "code")
        found = pairs.select("code", "byte", "n").toArrow()
        codes, byte, n = (found.column(c).to_numpy() for c in ("code", "byte", "n"))
        names = np.unique(codes) if order else np.zeros(1, np.int64)
        matrix = _dense(codes, byte, n, names)
        contexts.append(names)
        counts.append(known_counts(matrix) if order else matrix)
    return contexts, counts


def train(docs: DataFrame, max_contexts: int = MAX_CONTEXTS) -> Model:
    """The frequent contexts of a model of all texts of ``docs``."""
    contexts, counts = _frequent(_gram_counts(docs.withColumn("train", F.lit(True))), max_contexts)
    return Model(contexts, np.concatenate([log_rows(contexts, counts, order) for order in range(ORDER + 1)]))


def _rare_costs(grams: DataFrame, frequent, order_0: np.ndarray) -> DataFrame:
    """Stored (gram, seen, cost) of all grams, training rows or not, whose context is not in the array ``frequent``."""
    found = _pair_counts(grams, 1).select("code", "byte", "n").toArrow()
    every = np.arange(256)
    order_1 = known_counts(_dense(*(found.column(c).to_numpy() for c in ("code", "byte", "n")), every))
    lower = grams.sparkSession.sparkContext.broadcast((order_0, order_1))

    def costs(gram: np.ndarray, n: np.ndarray, seen: np.ndarray) -> pa.RecordBatch:
        code, byte = gram >> 8, gram & 255
        longest, shorter = np.unique(code), np.unique(code & 0xFFFF)
        all_2 = known_counts(_dense(code & 0xFFFF, byte, n, shorter))
        all_3 = known_counts(_dense(code, byte, n, longest))
        wanted = ~find(frequent.value, longest)[1]
        contexts, counts = [np.zeros(1, np.int64), every, shorter, longest[wanted]], [*lower.value, all_2, all_3[wanted]]
        rare = wanted[np.searchsorted(longest, code)]
        logs = log_rows(contexts, counts, ORDER)
        cost = logs[np.searchsorted(contexts[ORDER], code[rare]), byte[rare]]
        return pa.RecordBatch.from_arrays([*map(pa.array, (gram[rare], seen[rare], cost))], names=["gram", "seen", "cost"])

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for part in parts:
            held.append([part.column(c).to_numpy() for c in ("gram", "n", "seen")])
            size += part.num_rows
            if size >= RARE_ROWS:
                gram, n, seen = (np.concatenate(x) for x in zip(*held, strict=True))
                last = gram >> 8 & 0xFFFF
                cut = int(np.searchsorted(last, last[-1]))  # the last two bytes may go on in the next batch
                if cut:
                    yield costs(gram[:cut], n[:cut], seen[:cut])
                held, size = [[gram[cut:], n[cut:], seen[cut:]]], len(gram) - cut
        if size:
            yield costs(*(np.concatenate(x) for x in zip(*held, strict=True)))

    last = F.shiftright("gram", 8).bitwiseAND(0xFFFF)
    ordered = grams.withColumn("last", last).repartition("last").sortWithinPartitions("last", "gram")
    found = ordered.select("gram", "n", "seen").mapInArrow(batches, "gram long, seen long, cost float")
    return materialise(found, "ppm-costs")


def _known_costs(costs: DataFrame, max_grams: int) -> tuple[np.ndarray, np.ndarray, DataFrame | None]:
    """Sorted grams and costs of the most frequent rows of ``costs``, ``max_grams`` at most, and the rows left, if any."""
    step = F.floor(F.log2("seen") * 16).cast("int")  # at most 1024 steps
    counts = sorted(costs.groupBy(step.alias("step")).agg(F.count("*").alias("n")).collect(), reverse=True)
    fitting = [r.step for r, total in zip(counts, np.cumsum([r.n for r in counts]), strict=True) if total <= max_grams]
    if not counts:
        return np.zeros(0, np.uint32), np.zeros(0, np.float32), None
    known = step >= (fitting[-1] if fitting else counts[0].step + 1)
    found = costs.where(known).select("gram", "cost").toArrow()
    grams, cost = found.column("gram").to_numpy().astype(np.uint32), found.column("cost").to_numpy()
    order = np.argsort(grams)
    return grams[order], cost[order], None if len(fitting) == len(counts) else costs.where(~known)


def _rare_sums(docs: DataFrame, costs: DataFrame, frequent, known) -> DataFrame:
    """doc_id, one, two and the cost of a document's bytes after contexts not in ``frequent``, in several rows.

    Without the grams in ``known``.
    """

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        skipped = np.zeros(1 << 24, bool)
        skipped[frequent.value] = True
        for part in parts:
            for at, to, data, offsets in text_slices(part.column("text")):
                codes, symbols, first, end = padded(data, offsets)
                keep = np.flatnonzero(_inside(len(codes), first, end) & ~skipped[codes])
                keep = keep[~find(known.value[0], _grams(codes, symbols, keep))[1]]
                rows = np.searchsorted(first, keep, side="right") - 1
                keys, n = np.unique(rows.astype(np.uint64) << np.uint64(32) | _grams(codes, symbols, keep), return_counts=True)
                rows = pa.array((keys >> np.uint64(32)).astype(np.int64) + at)
                yield pa.RecordBatch.from_arrays(
                    [
                        *[part.column(c).take(rows) for c in ("doc_id", "one", "two")],
                        pa.array((keys & np.uint64(0xFFFFFFFF)).astype(np.int64)),
                        pa.array(n.astype(np.int32)),
                    ],
                    names=["doc_id", "one", "two", "gram", "n"],
                )

    schema = f"doc_id {dict(docs.dtypes)['doc_id']}, one long, two long, gram long, n int"
    found = docs.select("doc_id", "one", "two", "text").mapInArrow(batches, schema)
    met = found.join(costs.select("gram", F.col("cost").cast("double")), "gram")
    return met.select("doc_id", "one", "two", (F.col("n") * F.col("cost")).alias("cost"))


def _head_words(docs: DataFrame, share: int) -> np.ndarray:
    """Sorted hashes of the words that hold at least one in ``share`` tokens, as counted by batch."""

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def flush() -> pa.RecordBatch:
            words, n = np.unique(np.concatenate(held), return_counts=True)
            often = n >= max(2, size // share)
            held.clear()
            keys = np.append(words[often].view(np.int64), 0)
            kinds = np.append(np.zeros(often.sum(), np.int8), np.int8(1))
            return pa.RecordBatch.from_arrays(
                [pa.array(kinds), pa.array(keys), pa.array(np.append(n[often], size))], names=["kind", "word", "n"]
            )

        for part in parts:
            for _, _, data, offsets in text_slices(part.column("text")):
                held.append(word_hashes(data, offsets)[0])
                size += len(held[-1])
                if size >= FLUSH_WORDS:
                    yield flush()
                    size = 0
        if held:
            yield flush()

    partial = docs.select("text").mapInArrow(batches, "kind byte, word long, n long")
    sums = materialise(partial.groupBy("kind", "word").agg(F.sum("n").alias("n")), "ppm-words")
    total = sums.where("kind = 1").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    often = sums.where((F.col("kind") == 0) & (F.col("n") >= max(2, total // share))).select("word").toArrow()
    return np.sort(often.column("word").to_numpy().view(np.uint64))


def _head_counts(docs: DataFrame, head) -> np.ndarray:
    """Occurrences of the head words, then of rows (text ends) and of all words, in ``docs``."""

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = head.value
        counts = np.zeros(len(known) + 2, np.int64)
        for part in parts:
            for _, _, data, offsets in text_slices(part.column("text")):
                words, _ = word_hashes(data, offsets)
                at, found = find(known, words)
                counts[:-2] += np.bincount(at[found], minlength=len(known))
                counts[-2:] += (len(offsets) - 1, len(words))
        at = np.flatnonzero(counts)
        if len(at):
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts[at])], names=["at", "n"])

    partial = docs.select("text").mapInArrow(batches, "at long, n long")
    found = partial.groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(len(head.value) + 2, np.int64)
    counts[found.column("at").to_numpy()] = found.column("n").to_numpy()
    return counts


def find(known: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Position of each word in the sorted array, and whether it is there."""
    if len(known) == 0:
        return np.zeros(len(words), np.int64), np.zeros(len(words), bool)
    at = np.searchsorted(known, words)
    at[at == len(known)] = 0
    return at, known[at] == words


def _tail_sums(docs: DataFrame, head, costs: DataFrame | None) -> DataFrame:
    """Stored sums over the words outside the head and over ``costs``, if any, by document id and text hashes.

    log_sum: of n * log10(count + 1); known: occurrences with a count; copies: rows with this key;
    first: words met first here that the training rows hold, for the number of distinct ones; cost: of
    bytes in ``costs``.
    """

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for at, to, data, offsets in text_slices(part.column("text")):
                words, ranges = word_hashes(data, offsets)
                _, found = find(head.value, words)
                rows = np.repeat(np.arange(to - at), np.diff(ranges))[~found]
                order = np.lexsort((words[~found], rows))
                rows, rare = rows[order], words[~found][order]
                starts = np.flatnonzero(np.concatenate([[True], (rare[1:] != rare[:-1]) | (rows[1:] != rows[:-1])])) if len(rare) else np.zeros(0, np.int64)
                n = np.diff(np.append(starts, len(rare)))
                rows = np.concatenate([rows[starts], np.arange(to - at)])  # the last are one mark for each document
                rows = pa.array(rows + at)
                yield pa.RecordBatch.from_arrays(
                    [
                        *[part.column(c).take(rows) for c in ("doc_id", "one", "two", "train")],
                        pa.array(np.concatenate([rare[starts].view(np.int64), np.zeros(to - at, np.int64)])),
                        pa.array(np.concatenate([n, np.zeros(to - at, np.int64)])),
                    ],
                    names=["doc_id", "one", "two", "train", "word", "n"],
                )

    schema = f"doc_id {dict(docs.dtypes)['doc_id']}, one long, two long, train boolean, word long, n long"
    found = docs.select("doc_id", "one", "two", "train", "text").mapInArrow(batches, schema)
    # Marks have no key to meet on; they are spread like rare words.
    by = Window.partitionBy("word", F.when(F.col("n") == 0, F.col("one")))
    counted = found.withColumn("c", F.sum(F.when(F.col("train"), F.col("n")).otherwise(0)).over(by)).withColumn(
        "r", F.row_number().over(by.orderBy("one"))
    )
    known = (F.col("c") > 0) & (F.col("n") > 0)
    terms = counted.select(
        "doc_id",
        "one",
        "two",
        (F.col("n") * F.log10(F.col("c") + 1)).alias("log_sum"),
        F.when(known, F.col("n")).otherwise(0).alias("known"),
        (F.col("n") == 0).cast("long").alias("copies"),
        (known & (F.col("r") == 1)).cast("long").alias("first"),
    )
    both = terms.withColumn("cost", F.lit(0.0)) if costs is None else terms.unionByName(costs, allowMissingColumns=True)
    names = ("log_sum", "known", "copies", "first", "cost")
    sums = both.groupBy("doc_id", "one", "two").agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in names])
    return materialise(sums, "ppm-tail")


def score(
    docs: DataFrame,
    held_out: Column,
    max_contexts: int = MAX_CONTEXTS,
    head_share: int = HEAD_SHARE,
    rare_grams: int = RARE_GRAMS,
) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every document.

    Learns from the rows where ``held_out`` is false. ``base_score`` is the smoothed unigram log10
    probability of words and end; ``score`` the byte model's log10 probability of the text.
    """
    spark = docs.sparkSession
    hashes = [F.xxhash64(F.lit(seed), "text").alias(name) for seed, name in ((1, "one"), (2, "two"))]
    texts = docs.select("doc_id", held_out.alias("held_out"), (~held_out).alias("train"), *hashes, "text")
    training = texts.where("train")
    grams = _gram_counts(texts)
    contexts, byte_counts = _frequent(grams, max_contexts)
    frequent = spark.sparkContext.broadcast(contexts[ORDER])
    table_of = spark.sparkContext.broadcast(log_rows(contexts, byte_counts, ORDER))
    head = spark.sparkContext.broadcast(_head_words(texts, head_share))
    counts = _head_counts(training, head)
    *known, left = _known_costs(_rare_costs(grams, frequent, byte_counts[0]), rare_grams)
    sparse = spark.sparkContext.broadcast(known)
    tail = _tail_sums(texts, head, None if left is None else _rare_sums(texts, left, frequent, sparse))
    rare = tail.agg(F.coalesce(F.sum("first"), F.lit(0))).first()[0]
    ends, train_tokens = int(counts[-2]), int(counts[-2:].sum())
    distinct = int(np.count_nonzero(counts[:-2])) + rare + (ends > 0)
    logs_of = spark.sparkContext.broadcast(counts[:-2])

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, occurrences, logs = head.value, logs_of.value, np.log10(logs_of.value + 1.0)
        grams, gram_costs = sparse.value
        table = np.concatenate([np.zeros((1, 256), np.float32), table_of.value])  # row 0: a rare context
        index = np.zeros(1 << 24, np.uint16 if len(table) <= 1 << 16 else np.uint32)
        index[frequent.value] = np.arange(1, len(table))
        for part in parts:
            for at, to, data, offsets in text_slices(part.column("text")):
                words, ranges = word_hashes(data, offsets)
                where, found = find(known, words)
                sums = _row_sums(np.where(found, logs[where], 0.0) if len(known) else np.zeros(len(words)), ranges)
                hits = _row_sums(found & (occurrences[where] > 0) if len(known) else found, ranges)
                codes, symbols, first, end = padded(data, offsets)
                context = index[codes]
                cost = table[context, symbols[: len(codes)]].astype(np.float64)
                rare = np.flatnonzero(context == 0)
                at_gram, met = find(grams, _grams(codes, symbols, rare))
                cost[rare[met]] = gram_costs[at_gram[met]]
                bounds = np.stack([first, end], 1).ravel()
                scores = np.add.reduceat(np.append(cost, 0.0), bounds)[::2]
                piece = part.slice(at, to - at)
                yield pa.RecordBatch.from_arrays(
                    [
                        *[piece.column(c) for c in ("doc_id", "held_out", "one", "two")],
                        *map(pa.array, (np.diff(ranges) + 1, sums, hits.astype(np.int64), scores)),
                    ],
                    names=["doc_id", "held_out", "one", "two", "n_tokens", "head_sum", "head_known", "head_cost"],
                )

    kind = dict(docs.dtypes)["doc_id"]
    schema = f"doc_id {kind}, held_out boolean, one long, two long, n_tokens long, head_sum double, head_known long, head_cost double"
    scored = texts.select("doc_id", "held_out", "one", "two", "text").mapInArrow(batches, schema)
    sums = tail.select(F.col("doc_id").alias("_doc"), F.col("one").alias("_one"), F.col("two").alias("_two"), "log_sum", "known", "copies", "cost")
    joined = scored.join(sums, F.expr("doc_id <=> _doc and one = _one and two = _two"))
    end_known = int(ends > 0)
    total = F.col("head_sum") + F.col("log_sum") / F.col("copies") + float(np.log10(ends + 1.0))
    return joined.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("head_known") + (F.col("known") / F.col("copies")).cast("long") + end_known).alias("n_known"),
        F.lit(train_tokens).cast("long").alias("train_tokens"),
        (total - F.col("n_tokens") * float(np.log10(train_tokens + distinct + 1.0))).alias("base_score"),
        (F.col("head_cost") + F.col("cost") / F.col("copies")).alias("score"),
    )


def _row_sums(values: np.ndarray, ranges: np.ndarray) -> np.ndarray:
    total = np.concatenate([np.zeros(1), np.cumsum(values, dtype=np.float64)])
    return total[ranges[1:]] - total[ranges[:-1]]
