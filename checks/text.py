"""Text functions and retrieval over ``documents`` and ``benchmark``."""

from pyspark.sql import functions as F

from checks import sql as S
from matchlane.functions.binding import rows_of
from matchlane.functions.text import char_ngrams, indel_ratio, normalise, tokenize, tokens_set
from matchlane.operators.retrieval import (
    build_index,
    corpus_stats,
    hybrid_scores,
    hybrid_topk,
    pair_scores,
    postings,
    term_counts,
    term_stats,
)
from matchlane.plans.sample_profiles import table
from matchlane.session import spread


def _documents(spark, sf_dir):
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text"))


def _jobs(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("jd_id"), "text")


def _counted(spark, sf_dir):
    return term_counts(_documents(spark, sf_dir), tokenize(F.col("text")))


def _index(spark, sf_dir):
    return build_index(_documents(spark, sf_dir), tokenize(F.col("text")), ["doc_id"], name="documents")


def normalise_text(spark, sf_dir):
    return _documents(spark, sf_dir).select("doc_id", normalise(F.col("text")).alias("norm"))


def token_counts(spark, sf_dir):
    tokens = rows_of(_documents(spark, sf_dir), [], tokenize(F.col("text")), "term")
    return tokens.groupBy("term").agg(F.count("*").alias("n"))


def raw_token_counts(spark, sf_dir):
    tokens = rows_of(_documents(spark, sf_dir), [], tokenize(F.col("text"), drop_stopwords=False), "term")
    return tokens.groupBy("term").agg(F.count("*").alias("n"))


def distinct_tokens(spark, sf_dir):
    return _documents(spark, sf_dir).select("doc_id", F.size(tokens_set(F.col("text"))).cast("bigint").alias("n_terms"))


def ngram_counts(spark, sf_dir):
    grams = rows_of(_documents(spark, sf_dir), [], char_ngrams(F.col("text"), 3), "gram")
    return grams.groupBy("gram").agg(F.count("*").alias("n"))


def similarity(spark, sf_dir):
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_name", F.lower("p_type").alias("p_type"))
    return parts.select("p_partkey", F.round(indel_ratio(F.col("p_name"), F.col("p_type")), 6).alias("ratio"))


def document_postings(spark, sf_dir):
    return postings(_counted(spark, sf_dir), ["doc_id"]).withColumn("tf", F.col("tf").cast("bigint"))


def document_frequencies(spark, sf_dir):
    return term_stats(_counted(spark, sf_dir))


def corpus_statistics(spark, sf_dir):
    docs = _counted(spark, sf_dir)
    return corpus_stats(docs, term_stats(docs)).select(
        "n_docs", F.round("avgdl", 6).alias("avgdl"), "n_postings", F.round("mean_idf", 6).alias("mean_idf")
    )


def document_vectors(spark, sf_dir):
    index = _index(spark, sf_dir)
    return index.docs.select(
        "doc_id", F.col("dl").cast("bigint").alias("dl"), F.round(F.coalesce("norm", F.lit(0.0)), 6).alias("norm")
    )


def bm25(spark, sf_dir):
    return pair_scores(_index(spark, sf_dir), _jobs(spark, sf_dir), ["doc_id"]).select(
        "jd_id", "doc_id", F.round("bm25", 6).alias("bm25")
    )


def cosine(spark, sf_dir):
    return pair_scores(_index(spark, sf_dir), _jobs(spark, sf_dir), ["doc_id"]).select(
        "jd_id", "doc_id", F.round("cosine", 6).alias("cosine")
    )


def hybrid(spark, sf_dir):
    return hybrid_scores(_index(spark, sf_dir), _jobs(spark, sf_dir), ["doc_id"]).select(
        "jd_id", "doc_id", F.round("semantic", 6).alias("semantic")
    )


def topk(spark, sf_dir):
    ranked = hybrid_topk(_index(spark, sf_dir), _jobs(spark, sf_dir), 10, "doc_id")
    return ranked.select("jd_id", "doc_id", "rank", F.round("semantic", 6).alias("semantic"))


QUERIES = {
    "normalise_text": normalise_text,
    "token_counts": token_counts,
    "raw_token_counts": raw_token_counts,
    "distinct_tokens": distinct_tokens,
    "ngram_counts": ngram_counts,
    "name_similarity": similarity,
    "document_postings": document_postings,
    "document_frequencies": document_frequencies,
    "corpus_statistics": corpus_statistics,
    "document_vectors": document_vectors,
    "bm25_scores": bm25,
    "tfidf_cosine": cosine,
    "hybrid_scores": hybrid,
    "hybrid_topk": topk,
}

_INDEX = S.index_ctes("documents", "doc_id", "text")
_PAIRS = _INDEX + "," + S.scores_ctes("benchmark", "item_id", "text")
_HYBRID = _PAIRS + "," + S.hybrid_ctes()
_SYN = S.values_of(S.lx.SYNONYMS.items())

SQL = {
    "normalise_text": f"SELECT doc_id, {S.norm('text')} AS norm FROM documents",
    "token_counts": f"SELECT term, count(*) AS n FROM ({S.tokens('documents', 'doc_id', 'text')}) GROUP BY term",
    "raw_token_counts": f"""
SELECT term, count(*) AS n FROM (
  SELECT coalesce(canon, raw) AS term
  FROM (SELECT unnest(string_split({S.norm('text')}, ' ')) AS raw FROM documents)
  LEFT JOIN ({_SYN}) syn(alias, canon) ON alias = raw)
WHERE length(term) >= 2 GROUP BY term""",
    "distinct_tokens": f"""
SELECT doc_id, count(DISTINCT term) AS n_terms
FROM documents LEFT JOIN ({S.tokens('documents', 'doc_id', 'text')}) USING (doc_id) GROUP BY doc_id""",
    "ngram_counts": f"""
WITH s AS (SELECT replace({S.norm('text')}, ' ', '_') AS s FROM documents)
SELECT gram, count(*) AS n FROM (
  SELECT unnest(CASE WHEN length(s) < 3 THEN [s]
                ELSE list_transform(range(1, length(s) - 1), lambda i: substr(s, i, 3)) END) AS gram FROM s)
GROUP BY gram""",
    "name_similarity": f"""
WITH RECURSIVE pairs AS (SELECT p_partkey, p_name AS a, lower(p_type) AS b FROM part), {S.lcs_ctes('pairs')}
SELECT p_partkey, round(200.0 * lcs / (length(a) + length(b)), 6) AS ratio FROM pairs JOIN lcs USING (a, b)""",
    "document_postings": f"WITH {_INDEX} SELECT d AS doc_id, term, tf FROM post",
    "document_frequencies": f"WITH {_INDEX} SELECT term, df FROM terms",
    "corpus_statistics": f"""
WITH {_INDEX} SELECT n AS n_docs, round(avgdl, 6) AS avgdl, (SELECT sum(df)::BIGINT FROM terms) AS n_postings,
  (SELECT round(avg(raw_idf), 6) FROM idf) AS mean_idf FROM corpus""",
    "document_vectors": f"""
WITH {_INDEX} SELECT doc_id, coalesce(dl, 0)::BIGINT AS dl, round(coalesce(norm, 0.0), 6) AS norm
FROM documents LEFT JOIN dl ON dl.d = doc_id LEFT JOIN norms ON norms.d = doc_id""",
    "bm25_scores": f"WITH {_PAIRS} SELECT jd AS jd_id, d AS doc_id, round(bm25, 6) AS bm25 FROM pairs",
    "tfidf_cosine": f"WITH {_PAIRS} SELECT jd AS jd_id, d AS doc_id, round(cosine, 6) AS cosine FROM pairs",
    "hybrid_scores": f"WITH {_HYBRID} SELECT jd AS jd_id, d AS doc_id, round(semantic, 6) AS semantic FROM hybrid",
    "hybrid_topk": f"""
WITH {_HYBRID}, r AS (
  SELECT *, row_number() OVER (PARTITION BY jd ORDER BY round(semantic, 9) DESC, d) AS rank FROM hybrid)
SELECT jd AS jd_id, d AS doc_id, rank::INTEGER AS rank, round(semantic, 6) AS semantic FROM r WHERE rank <= 10""",
}
