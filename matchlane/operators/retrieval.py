"""Hybrid lexical retrieval: BM25 and TF-IDF cosine over a forward index.

A document is one index row that carries its own term counts, computed inside
the row from its sorted tokens.  Building it shuffles term statistics only, and
searching shuffles what a task has left after folding its documents (``scoring``).

An index folder holds segments, each written once with its own statistics, and a
version per set of segments: merged statistics, a one-row manifest and the rows
with their norms.  Opening reads the manifest alone; appending writes a segment
and a new version.
"""

import json
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StringType, StructField, StructType

from matchlane.functions.binding import rows_of
from matchlane.functions.text import tokenize
from matchlane.operators.joins import join_lookup, top_k
from matchlane.operators.scoring import (
    BM25_SHARE,
    COSINE_SHARE,
    DECIMALS,
    Jobs,
    best_documents,
    block_maxima,
    blocks_reaching,
    known_ranges,
    leading_blocks,
    matching_pairs,
    per_block,
    score_ranges,
)
from matchlane.session import materialise, work_path

# The floor of rare idf values and the vocabulary's limits.
NEGATIVE_IDF_SHARE = 0.25
MIN_DF, MAX_DF_RATIO = 2, 0.85

# Upper bound of the terms that go to every task while document norms are computed.
HEAD_TERMS = 500_000
# Documents of a block, and how many blocks a job there must be for a search by blocks to pay.
BLOCK_ROWS = 64
BLOCKS_PER_JOB = 32
NAMED_BLOCKS = 10_000
# Rows that a task counts at a time, and bytes of the Arrow batches it reads them in: whole blocks, if rows are short.
KERNEL_ROWS = 16 * BLOCK_ROWS
BATCH_BYTES = 8 << 20
# ``doc_key`` of a segment's rows starts at its number times this.
SEGMENT_KEYS = 1 << 56


def term_counts(docs: DataFrame, tokens: Column) -> DataFrame:
    """Adds ``dl`` and ``terms array<struct<term, tf>>``; row-local.

    Sorting puts equal tokens side by side; a run's length is the distance to
    the next run's start.
    """
    ordered = docs.withColumn("_tokens", F.sort_array(tokens)).withColumn("dl", F.size("_tokens"))
    starts = F.filter(
        F.sequence(F.lit(0), F.greatest(F.col("dl") - 1, F.lit(0))),
        lambda i: (F.col("dl") > 0) & ((i == 0) | (F.get("_tokens", i) != F.get("_tokens", i - 1))),
    )
    return (
        ordered.withColumn("_starts", starts)
        .withColumn(
            "terms",
            F.transform(
                "_starts",
                lambda at, run: F.struct(
                    F.get("_tokens", at).alias("term"),
                    (F.coalesce(F.get("_starts", run + 1), F.col("dl")) - at).alias("tf"),
                ),
            ),
        )
        .drop("_tokens", "_starts")
    )


def postings(docs: DataFrame, keys: list[str]) -> DataFrame:
    """One row per (document, term)."""
    return rows_of(docs, keys, F.col("terms"), "_t").select(*keys, "_t.term", "_t.tf")


def term_stats(docs: DataFrame) -> DataFrame:
    """Document frequency per term; map-side counts keep frequent terms small."""
    return rows_of(docs, [], F.col("terms.term"), "term").groupBy("term").agg(F.count("*").alias("df"))


def _okapi_idf(df: Column, n_docs: Column) -> Column:
    return F.log(n_docs - df + 0.5) - F.log(df + 0.5)


def corpus_stats(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """One row: document count, mean length, posting count, mean idf over the vocabulary."""
    sizes = docs.agg(F.count("*").alias("n_docs"), F.avg("dl").alias("avgdl"))
    return terms.agg(
        F.avg(_okapi_idf(F.col("df"), sizes.select("n_docs").scalar())).alias("mean_idf"),
        F.coalesce(F.sum("df"), F.lit(0)).alias("n_postings"),
    ).select(
        sizes.select("n_docs").scalar().alias("n_docs"),
        sizes.select("avgdl").scalar().alias("avgdl"),
        "n_postings",
        "mean_idf",
    )


@dataclass
class RetrievalIndex:
    """``docs(doc_key, keep…, dl, terms, norm, block)``, ``blocks`` (``block_maxima`` of it),
    ``rows(doc_key, keep…, tokens, _wide)``, ``terms(term, df)`` and corpus scalars.
    """

    docs: DataFrame
    blocks: DataFrame
    rows: DataFrame
    terms: DataFrame
    n_docs: int
    avgdl: float
    n_postings: int
    mean_idf: float

    @property
    def wide(self) -> DataFrame:
        """``doc_key`` and the wide columns."""
        return self.rows.select("doc_key", "_wide.*")

    def tfidf_vocabulary(self) -> DataFrame:
        """Terms that are neither too rare nor too common, with their smooth idf."""
        return self.terms.where(
            (F.col("df") >= MIN_DF) & (F.col("df") <= MAX_DF_RATIO * self.n_docs)
        ).select("term", "df", (F.log((1.0 + self.n_docs) / (1.0 + F.col("df"))) + 1.0).alias("idf"))


MANIFEST = (
    "n_segments int, keep array<string>, n_docs long, avgdl double, n_postings long, mean_idf double, "
    "rows_schema string, docs_schema string"
)
TERMS = "term string, df long"
BLOCKS = "block long, n long, dl int, terms array<struct<term:string,tf:int>>, norm double"


def build_index(
    docs: DataFrame,
    tokens: Column,
    keep: list[str],
    path: str | None = None,
    name: str = "index",
    wide: dict[str, Column] | None = None,
) -> RetrievalIndex:
    """Tokenise once, write the index tables, return them for any number of jobs.

    ``keep`` are the document columns that every search reads; ``wide`` columns are
    stored beside them, for the few documents a search returns.  ``doc_key`` is a row
    number of the written table, so repeated ids stay separate documents.
    """
    root = path or work_path(docs.sparkSession, name)
    written = _write_segment(docs, tokens, keep, wide or {}, root, 0)
    return _write_version(docs.sparkSession, root, keep, 1, written.schema)


def append_documents(
    index_path: str, docs: DataFrame, tokens: Column, wide: dict[str, Column] | None = None
) -> RetrievalIndex:
    """The index at ``index_path`` with more documents: a further segment and a new version.

    Texts already indexed are not read again; their norms change with the corpus and are
    worked out anew from the stored counts.
    """
    spark = docs.sparkSession
    last = _manifest(spark, index_path)
    written = _write_segment(docs, tokens, last.keep, wide or {}, index_path, last.n_segments)
    if written.schema != StructType.fromJson(json.loads(last.rows_schema)):
        raise ValueError("the documents to append have other columns than the index")
    return _write_version(spark, index_path, last.keep, last.n_segments + 1, written.schema)


def load_index(spark: SparkSession, path: str) -> RetrievalIndex:
    """Open the newest version of an index; reads one row."""
    return _opened(spark, path, _manifest(spark, path))


def _write_segment(docs: DataFrame, tokens: Column, keep: list[str], wide: dict[str, Column], root: str, number: int) -> DataFrame:
    key = (F.monotonically_increasing_id() + F.lit(number * SEGMENT_KEYS)).alias("doc_key")
    beside = F.struct(*[column.alias(name) for name, column in wide.items()] or [F.lit(True).alias("none")]).alias("_wide")
    rows = materialise(docs.select(key, *keep, tokens.alias("tokens"), beside), "segment", f"{root}/segments/{number}/rows")
    each = rows.select(F.explode(F.array_distinct("tokens")).alias("term"))
    materialise(each.groupBy("term").agg(F.count("*").alias("df")), "terms", f"{root}/segments/{number}/terms")
    return rows


def _segments(spark: SparkSession, root: str, n: int, table: str, schema: StructType | str) -> DataFrame:
    return spark.read.schema(schema).parquet(*[f"{root}/segments/{i}/{table}" for i in range(n)])


@contextmanager
def _bounded_batches(spark: SparkSession) -> Iterator[None]:
    """Arrow batches of a few MB for what runs inside, so a task never holds thousands of very long documents."""
    wanted = {"maxRecordsPerBatch": KERNEL_ROWS, "maxBytesPerBatch": BATCH_BYTES}
    before = {name: spark.conf.get(f"spark.sql.execution.arrow.{name}") for name in wanted}
    try:
        for name, value in wanted.items():
            spark.conf.set(f"spark.sql.execution.arrow.{name}", str(value))
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(f"spark.sql.execution.arrow.{name}", value)


def _write_version(spark: SparkSession, root: str, keep: list[str], n: int, schema: StructType) -> RetrievalIndex:
    rows = _segments(spark, root, n, "rows", schema)
    terms = _segments(spark, root, n, "terms", TERMS).groupBy("term").agg(F.sum("df").alias("df"))
    target = f"{root}/versions/{n}"
    stored = materialise(terms, "terms", f"{target}/terms")
    stats = corpus_stats(rows.select(F.size("tokens").alias("dl")), stored).first()
    index = RetrievalIndex(
        rows, rows, rows, stored, stats.n_docs, stats.avgdl or 0.0, stats.n_postings, stats.mean_idf or 0.0
    )
    with _bounded_batches(spark):
        blocked = index_rows(index, keep).withColumn("block", F.floor(F.monotonically_increasing_id() / BLOCK_ROWS))
        docs = materialise(blocked, "docs", f"{target}/docs")
        materialise(block_maxima(docs), "blocks", f"{target}/blocks")
    facts = (n, keep, index.n_docs, index.avgdl, index.n_postings, index.mean_idf, rows.schema.json(), docs.schema.json())
    # Written last: a version without its manifest does not exist.
    spark.createDataFrame([facts], MANIFEST).coalesce(1).write.mode("append").parquet(f"{root}/manifest")
    return load_index(spark, root)


def _manifest(spark: SparkSession, root: str):
    return spark.read.schema(MANIFEST).parquet(f"{root}/manifest").orderBy(F.desc("n_segments")).first()


def _opened(spark: SparkSession, root: str, facts) -> RetrievalIndex:
    target = f"{root}/versions/{facts.n_segments}"
    rows_schema, docs_schema = (StructType.fromJson(json.loads(x)) for x in (facts.rows_schema, facts.docs_schema))
    rows = _segments(spark, root, facts.n_segments, "rows", rows_schema)
    docs, terms = spark.read.schema(docs_schema).parquet(f"{target}/docs"), spark.read.schema(TERMS).parquet(f"{target}/terms")
    blocks = spark.read.schema(BLOCKS).parquet(f"{target}/blocks")
    return RetrievalIndex(docs, blocks, rows, terms, facts.n_docs, facts.avgdl, facts.n_postings, facts.mean_idf)


def _run_lengths(tokens: pa.ListArray) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct tokens of all rows, sorted; and by row and token: row, position in them, count."""
    coded = tokens.flatten().dictionary_encode()
    order = pc.sort_indices(coded.dictionary).to_numpy()
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    row = np.repeat(np.arange(len(tokens)), tokens.value_lengths().fill_null(0).to_numpy())
    pair, count = np.unique(row * len(order) + place[coded.indices.to_numpy()], return_counts=True)
    return coded.dictionary.take(pa.array(order)), *np.divmod(pair, max(1, len(order))), count


def _by_length(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches ordered by ``dl``: documents of a similar length share a block, so that its bounds are tight.

    Only what a task holds anyway is ordered; sorting whole partitions would write all terms to disk once more.
    """
    for batch in batches:
        yield batch.take(pc.sort_indices(batch["dl"]))


def _head_cut(vocabulary: DataFrame, n_postings: int, head_terms: int) -> int:
    """The smallest document frequency that at most ``head_terms`` terms reach.

    It is never above ``n_postings / head_terms``; how many terms have each frequency up to there is counted.
    """
    bound = max(MIN_DF, -(-n_postings // head_terms))
    counts = vocabulary.groupBy(F.least("df", F.lit(bound)).alias("df")).agg(F.count("*").alias("n")).collect()
    reached, cut = 0, bound
    for row in sorted(counts, key=lambda r: -r.df):  # at most ``bound`` rows
        reached += row.n
        if row.df < bound and reached > head_terms:
            return cut
        cut = row.df
    return MIN_DF


def index_rows(index: RetrievalIndex, keep: list[str], head_terms: int = HEAD_TERMS) -> DataFrame:
    """``doc_key, keep…, dl, terms array<struct<term, tf>>, norm`` of every row of the index.

    The norm is that of the TF-IDF vector, 0 without a known term.  Document
    frequencies add up to ``n_postings``, so at most ``head_terms`` terms reach a
    frequency of ``n_postings / head_terms``, and as many terms as that, most frequent
    ones first, go to every task whatever the corpus size; a document adds up its own
    terms of that head.  The remaining terms meet
    the documents in a shuffle in which, by the same cut, no term has more rows than
    the cut; there are none in a small corpus.
    """
    vocabulary = index.tfidf_vocabulary()
    cut = _head_cut(vocabulary, index.n_postings, head_terms)
    head = vocabulary.where(F.col("df") >= cut).select("term", "idf").toArrow()
    known, idf = head["term"].combine_chunks(), head["idf"].to_numpy()

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(at, KERNEL_ROWS) for whole in batches for at in range(0, len(whole), KERNEL_ROWS)):
            words, row, word, count = _run_lengths(batch["tokens"])
            place = pc.index_in(words, value_set=known)
            weight = np.where(place.is_valid().to_numpy(zero_copy_only=False), np.append(idf, 0.0)[place.fill_null(len(idf)).to_numpy()], 0.0)
            weight = (1.0 + np.log(count)) * weight[word]
            pairs = pa.StructArray.from_arrays([words.take(pa.array(word)), pa.array(count.astype(np.int32))], ["term", "tf"])
            starts = np.searchsorted(row, np.arange(len(batch) + 1)).astype(np.int32)
            columns = {c: batch[c] for c in kept} | {
                "dl": batch["tokens"].value_lengths().fill_null(0),
                "terms": pa.ListArray.from_arrays(pa.array(starts), pairs),
                "_w2": pa.array(np.bincount(row, weight * weight, len(batch)), pa.float64()),
            }
            yield pa.RecordBatch.from_pydict(columns)

    kept = ["doc_key", *keep]
    rows = index.rows.select(*kept, "tokens")
    terms = ArrayType(StructType([StructField("term", StringType()), StructField("tf", IntegerType())]))
    fields = [StructField("dl", IntegerType()), StructField("terms", terms), StructField("_w2", DoubleType())]
    schema = StructType([*rows.select(*kept).schema.fields, *fields])
    squared = rows.mapInArrow(lambda batches: _by_length(counted(batches)), schema)
    if cut == MIN_DF:
        return squared.withColumn("norm", F.sqrt("_w2")).drop("_w2")
    squared = materialise(squared, "head-norms")
    tail = vocabulary.where(F.col("df") < cut).select("term", "idf")
    weight = (1.0 + F.log("tf")) * F.col("idf")
    rare = postings(squared, ["doc_key"]).join(tail, "term").select("doc_key", (weight * weight).alias("w2"))
    rest = rare.groupBy("doc_key").agg(F.sum("w2").alias("_rest"))
    both = squared.join(rest, "doc_key", "left")
    both = both.withColumn("norm", F.sqrt(F.col("_w2") + F.coalesce("_rest", F.lit(0.0)))).drop("_w2", "_rest")
    return both.mapInArrow(_by_length, both.schema)


def query_terms(jobs: DataFrame, text: str = "text") -> DataFrame:
    """Terms of each job with their multiplicity: ``jd_id, term, qtf``."""
    return (
        rows_of(jobs, ["jd_id"], tokenize(F.col(text)), "term").groupBy("jd_id", "term").agg(F.count("*").alias("qtf"))
    )


def weighted_query(index: RetrievalIndex, jobs: DataFrame, text: str = "text") -> DataFrame:
    """``jd_id, term, bm25_w, cos_w``: weights of the job terms the corpus knows.

    ``cos_w`` already holds the document side's idf, so a document adds
    ``cos_w * (1 + ln tf)`` to the dot product.
    """
    query = query_terms(jobs, text)
    idf = _okapi_idf(F.col("df"), F.lit(index.n_docs))
    floored = F.when(idf < 0, F.lit(NEGATIVE_IDF_SHARE * index.mean_idf)).otherwise(idf)
    in_vocabulary = (F.col("df") >= MIN_DF) & (F.col("df") <= MAX_DF_RATIO * index.n_docs)
    smooth = F.log((1.0 + index.n_docs) / (1.0 + F.col("df"))) + 1.0
    weighted = join_lookup(index.terms, query, ["term"], F.col("term")).select(
        "jd_id",
        "term",
        (F.col("qtf") * floored).alias("bm25_w"),
        F.when(in_vocabulary, smooth).otherwise(F.lit(0.0)).alias("idf"),
        ((1.0 + F.log("qtf")) * F.col("idf")).alias("raw_w"),
    )
    lengths = weighted.groupBy("jd_id").agg(F.sqrt(F.sum(F.col("raw_w") * F.col("raw_w"))).alias("len"))
    return weighted.join(lengths, "jd_id").select(
        "jd_id",
        "term",
        "bm25_w",
        (F.coalesce(F.try_divide("raw_w", "len"), F.lit(0.0)) * F.col("idf")).alias("cos_w"),
    )


def scored_blocks(index: RetrievalIndex, jobs: DataFrame, scored, text: str = "text") -> DataFrame | None:
    """The rows of ``scored(block, jobs of the block)`` over all jobs; None without jobs."""
    weights = materialise(weighted_query(index, jobs, text), "query")
    named = materialise(jobs.select("jd_id"), "jobs")
    return per_block(named, weights, index.avgdl, scored)


def _none(jobs: DataFrame, index: RetrievalIndex, keep: list[str], scores: list[str]) -> DataFrame:
    fields = [jobs.schema["jd_id"], *index.docs.select("doc_key", *keep).schema.fields]
    return index.docs.sparkSession.createDataFrame([], StructType([*fields, *(StructField(s, DoubleType()) for s in scores)]))


def pair_scores(index: RetrievalIndex, jobs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """``jd_id, doc_key, keep…, bm25, cosine`` for documents sharing a term with a job; nothing is shuffled."""
    found = scored_blocks(index, jobs, lambda block, _: matching_pairs(index.docs, block, keep), text)
    return _none(jobs, index, keep, ["bm25", "cosine"]) if found is None else found


def job_ranges(index: RetrievalIndex, block: Jobs) -> DataFrame:
    """Per job of the block, count, sums and ranges of both scores over all documents; stored, as searches follow."""
    return materialise(score_ranges(index.docs, block, index.n_docs), "ranges")


def hybrid_scores(index: RetrievalIndex, jobs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """Pairs that share a term, with ``semantic``; a first pass over the index finds the ranges."""

    def scored(block: Jobs, _: DataFrame) -> DataFrame:
        return matching_pairs(index.docs, block, keep, known_ranges(job_ranges(index, block), block))

    found = scored_blocks(index, jobs, scored, text)
    return _none(jobs, index, keep, ["bm25", "cosine", "semantic"]) if found is None else found


def hybrid_topk(index: RetrievalIndex, jobs: DataFrame, k: int, doc_id: str, text: str = "text") -> DataFrame:
    """Best ``k`` documents per job over all documents.

    Scores that agree to nine decimals are ties (copies of a text), broken by id.
    Documents without a common term all score the same for a job and compete like
    any other.  Few jobs on a large index read only the blocks whose bounds can
    matter; the lists are the same.
    """

    def scored(block: Jobs, _: DataFrame) -> DataFrame:
        if index.n_docs >= len(block.names) * BLOCKS_PER_JOB * BLOCK_ROWS:
            found = by_blocks(index, block, doc_id, k)
            if found is not None:
                return found
        return best_documents(index.docs, block, known_ranges(job_ranges(index, block), block), doc_id, k)

    found = scored_blocks(index, jobs, scored, text)
    found = _none(jobs, index, [doc_id], ["semantic"]) if found is None else found
    best = [F.desc(F.round("semantic", DECIMALS)), F.asc(doc_id), F.asc("doc_key")]
    return top_k(found, ["jd_id"], best, k, F.col("doc_key")).select("jd_id", "doc_key", doc_id, "semantic", "rank")


def _in_blocks(index: RetrievalIndex, wanted: DataFrame) -> DataFrame:
    """The documents of the ``wanted`` blocks; up to ``NAMED_BLOCKS`` of them prune the scan itself."""
    wanted = materialise(wanted, "blocks")
    numbers = [r.block for r in wanted.limit(NAMED_BLOCKS + 1).collect()]
    if len(numbers) <= NAMED_BLOCKS:
        return index.docs.where(F.col("block").isin(numbers))
    return join_lookup(index.docs, wanted, ["block"], F.col("doc_key"))


def by_blocks(index: RetrievalIndex, block: Jobs, doc_id: str, k: int) -> DataFrame | None:
    """``best_documents`` of the blocks that can hold a range's end or one of a job's ``k`` best.

    The documents of the leading blocks give scores that are reached; every block whose bound reaches
    one of them is read for the exact ranges, then every block whose mixed bound reaches a job's k-th
    best so far. None where the lowest score can't be told without all documents: a job has a negative
    weight, or all documents read share a term with it.
    """
    if (block.bm25_w < 0).any() or (block.cos_w < 0).any():
        return None
    slack = 1e-9
    seeds = _in_blocks(index, leading_blocks(index.blocks, block, 1))
    reached = known_ranges(materialise(score_ranges(seeds, block, 0), "ranges"), block)

    def end_of_range(bm25: np.ndarray, cosine: np.ndarray) -> np.ndarray:
        return (bm25 >= reached.bm25_hi - slack) & (bm25 > 0) | (cosine >= reached.cosine_hi - slack) & (cosine > 0)

    read = materialise(_in_blocks(index, blocks_reaching(index.blocks, block, end_of_range)), "opened")
    n_read = read.count()
    found = materialise(score_ranges(read, block, index.n_docs), "ranges")
    if n_read < index.n_docs and found.where(F.col("n") >= n_read).count():
        return None
    ranges = known_ranges(found, block)
    best = [F.desc(F.round("semantic", DECIMALS)), F.asc(doc_id), F.asc("doc_key")]
    first = top_k(best_documents(read, block, ranges, doc_id, k), ["jd_id"], best, k, F.col("doc_key"))
    last = {r.jd_id: r.semantic for r in first.where(F.col("rank") == k).collect()}
    least = np.array([last.get(j, -np.inf) for j in block.names.to_pylist()])

    def on_a_list(bm25: np.ndarray, cosine: np.ndarray) -> np.ndarray:
        return ranges.semantic(bm25, cosine) >= least - slack

    wanted = _in_blocks(index, blocks_reaching(index.blocks, block, on_a_list))
    return best_documents(wanted, block, ranges, doc_id, k)


def mean_semantic(index: RetrievalIndex, jobs: DataFrame, text: str = "text") -> DataFrame:
    """``jd_id, mean_semantic_fit`` over all documents, from per-job sums and ranges alone."""

    def unit(name: str) -> Column:
        low, high = F.col(f"{name}_lo"), F.col(f"{name}_hi")
        return F.when(high > low, (F.col(f"{name}_sum") / index.n_docs - low) / (high - low)).otherwise(F.lit(0.0))

    mean = BM25_SHARE * unit("bm25") + COSINE_SHARE * unit("cosine")

    def scored(block: Jobs, part: DataFrame) -> DataFrame:
        ranges = job_ranges(index, block)
        return part.join(F.broadcast(ranges), "jd_id", "left").select("jd_id", F.coalesce(mean, F.lit(0.0)).alias("mean_semantic_fit"))

    found = scored_blocks(index, jobs, scored, text)
    return jobs.select("jd_id", F.lit(0.0).alias("mean_semantic_fit")) if found is None else found


def word_set(text: Column) -> Column:
    """Distinct alphabetic runs of three letters or more."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("([a-z]{3,})"), F.lit(1)))


def overlap(text: Column, jd_text: Column) -> Column:
    """Share of the job's words found in the text."""
    wanted = word_set(jd_text)
    return F.size(F.array_intersect(wanted, word_set(text))) / F.greatest(F.size(wanted), F.lit(1))
