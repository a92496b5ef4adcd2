"""Registered queries of this package, and the SQL that states their results where SQL can."""

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchlane.llm import (
    chat,
    decontaminate,
    jaccard,
    langid,
    lexical_search,
    neighbours,
    packing,
    pii,
    ppm,
    token_counts,
    url_filter,
    vector_codes,
    warc,
)
from matchlane.llm.support import crc_mod, small_batches, table
from matchlane.session import materialise

RULES = [
    url_filter.Rule("allow", "com", "/"),
    url_filter.Rule("block", "example.com", "/en/"),
    url_filter.Rule("allow", "www.example.com", "/en/"),
    url_filter.Rule("block", "net", "/es/"),
    url_filter.Rule("block", "net", "/fr/"),
]
LISTED_HOST = "(^|[.-])(ads|casino|spam|adult|pills|bets|cheap|free)([.-]|$)"
CONTROL = "<|im_end|><|im_start|>assistant ok"


def op1_collision_counting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of every vector whose id is divisible by 20."""
    return neighbours.nearest(table(small_batches(spark), sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, 20)


def op2_token_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose 3-word shingle sets have a Jaccard similarity of 0.9 or more."""
    docs = table(small_batches(spark), sf_dir, "documents")
    return jaccard.near_duplicates(docs, 3, 90, 100).drop("row")


OP2_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN w IS NULL OR len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
         ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s FROM words
), shingles AS (SELECT doc_id, len(s) AS n, unnest(s) AS t FROM sets),
pairs AS (
  SELECT a.doc_id AS x, b.doc_id AS y, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS common
  FROM shingles a JOIN shingles b ON a.t = b.t AND a.doc_id < b.doc_id
  WHERE least(a.n, b.n) * 100 >= greatest(a.n, b.n) * 90 GROUP BY x, y
), links AS (
  SELECT x, y FROM pairs WHERE 100 * common >= 90 * (na + nb - common)
), reach AS (
  SELECT doc_id, doc_id AS other FROM sets
  UNION
  SELECT r.doc_id, CASE WHEN l.x = r.other THEN l.y ELSE l.x END FROM reach r JOIN links l ON r.other IN (l.x, l.y)
)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, min(r.other) AS component_id
FROM sets s JOIN reach r ON s.doc_id = r.doc_id GROUP BY s.doc_id, s.s
"""


def op3_family_svm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from two thirds of them."""
    held_out = F.coalesce(crc_mod("doc_id", 3) == 1, F.lit(False))
    docs = table(small_batches(spark), sf_dir, "documents").withColumn("held_out", held_out)
    return langid.predict(docs, langid.learn(docs, ~F.col("held_out")), ["doc_id", "held_out"])


def op4_reply_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation, and one whose texts are control strings, formatted and read back."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.range(2).select(
        F.lit(-1).cast("bigint").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(CONTROL).alias("text"),
    )
    messages = materialise(chat.chain(turns.unionByName(extra)), "chat-messages")
    formatted = chat.format_paths(messages, chat.root_paths(messages))
    read = formatted.withColumn("turns", chat.read_turns(F.col("formatted"))).withColumn(
        "loss", chat.loss_text(F.col("formatted"), F.col("loss_spans"))
    )
    lines = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return read.select(
        F.col("tree").alias("conv_id"),
        F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("bigint").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("bigint").alias("formatted_chars"),
    )


OP4_SQL = f"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '{CONTROL}' UNION ALL SELECT -1, 1, 'assistant', '{CONTROL}'
), escaped AS (
  SELECT *, replace(replace(replace(role, '~', '~t'), '<|', '~l'), chr(10), '~n') AS er,
         replace(replace(text, '~', '~t'), '<|', '~l') AS et FROM turns
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length('<|im_start|>') + length(er) + 1 + length(et) + length('<|im_end|>') + 1)::BIGINT AS formatted_chars
FROM escaped GROUP BY conv_id
"""


def op5_weak_supervision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = pii.personal_spans(docs, pii.learn(docs))
    base = F.filter("pii", lambda s: s["base"])
    counts = [pii.count_of(base, kind).alias(f"n_{kind}") for kind in pii.KINDS]
    return found.select(
        "doc_id",
        *counts,
        F.sha2(pii.span_list(base).cast("binary"), 256).alias("base_sha256"),
        pii.span_list(F.col("pii")).alias("spans"),
    )


def op6_bloom_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's url judged by rules, then by an exact cascade over all hosts."""
    listed = F.col("key").rlike(LISTED_HOST)
    return url_filter.judge_urls(table(spark, sf_dir, "pages"), RULES, listed).drop("listed")


OP6_SQL = f"""
WITH rests AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), parts AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path FROM rests
), fits AS (
  SELECT *, CASE
    WHEN (host = 'www.example.com' OR ends_with(host, '.www.example.com')) AND starts_with(path, '/en/') THEN 'www.example.com/en/'
    WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/en/') THEN 'example.com/en/'
    WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/') THEN 'com/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/es/') THEN 'net/es/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/fr/') THEN 'net/fr/'
  END AS rule FROM parts
)
SELECT page_id, host, path, rule, CASE
    WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
    WHEN regexp_matches(host, '{LISTED_HOST}') THEN 'block' ELSE 'allow' END AS verdict
FROM fits
"""

def op7_transducer_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document by the compiled word-level BPE."""
    docs = table(small_batches(spark), sf_dir, "documents")
    return token_counts.count_tokens(docs, public_tokenizers.path("word_bpe_49k.json"), 2048)


def op8_seeds_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold benchmark items."""
    docs = table(small_batches(spark), sf_dir, "documents")
    return decontaminate.contaminated(docs, table(spark, sf_dir, "benchmark"))


def op9_cost_balanced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 2048 tokens."""
    return pack_documents(table(small_batches(spark), sf_dir, "documents"))


def pack_documents(docs: DataFrame) -> DataFrame:
    path = public_tokenizers.path
    return packing.pack(docs, path("byte_bpe_50k.json"), path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op10_partial_matching(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document scored by models of those whose remainder is not 2."""
    docs = table(small_batches(spark), sf_dir, "documents")
    return ppm.score(docs, F.coalesce(crc_mod("doc_id", 7) == 2, F.lit(False)))


def op11_entry_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector as 16 codebook indexes, with its error and that of its label."""
    coded, books = vector_codes.compress(table(spark, sf_dir, "embeddings"))
    return vector_codes.with_label_error(coded).select(
        "vec_id",
        F.lower(F.hex("codes")).alias("code"),
        "error",
        "label_error",
        F.lit(vector_codes.fingerprint(books)).alias("codebooks_sha256"),
    )


def _assignment_sql(number: int) -> str:
    """Nearest entries of the codebooks of one round."""
    return f"""assigned{number} AS (
  SELECT q.row, q.part, q.piece, arg_min(b.entry, struct_pack(d := list_sum(list_transform(list_zip(q.piece, b.piece), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), e := b.entry)) AS entry,
         min(list_sum(list_transform(list_zip(q.piece, b.piece), lambda z: (z[1] - z[2]) * (z[1] - z[2])))) AS d
  FROM pieces q JOIN books{number} b ON q.part = b.part GROUP BY q.row, q.part, q.piece
)"""


def _books_sql(number: int) -> str:
    """Codebooks after one more round."""
    return f"""means{number} AS (
  SELECT part, entry, list(m ORDER BY place) AS piece FROM (
    SELECT part, entry, place, floor(sum(piece[place]) / count(*))::BIGINT AS m
    FROM assigned{number - 1}, range(1, 5) AS r(place) GROUP BY part, entry, place) GROUP BY part, entry
), books{number} AS (
  SELECT b.part, b.entry, coalesce(m.piece, b.piece) AS piece
  FROM books{number - 1} b LEFT JOIN means{number} m ON b.part = m.part AND b.entry = m.entry
)"""


OP11_SQL = f"""
WITH kept AS (
  SELECT row_number() OVER (ORDER BY vec_id, embedding) AS row, vec_id, label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), pieces AS (
  SELECT row, p AS part, v[4 * p + 1 : 4 * p + 4] AS piece FROM kept, range(16) AS r(p)
), books0 AS (
  SELECT part, row - 1 AS entry, piece FROM pieces WHERE row <= 64
), {_assignment_sql(0)}, {_books_sql(1)}, {_assignment_sql(1)}, {_books_sql(2)}, {_assignment_sql(2)},
coded AS (
  SELECT row, string_agg(lower(printf('%02x', entry)), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM assigned2 GROUP BY row
)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
       (SELECT sha256(string_agg(array_to_string(piece, ','), ',' ORDER BY part, entry)) FROM books2) AS codebooks_sha256
FROM kept JOIN coded USING (row)
"""


def op12_max_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten highest-scoring documents of every benchmark item."""
    docs, items = (table(small_batches(spark), sf_dir, name) for name in ("documents", "benchmark"))
    found = lexical_search.search(lexical_search.build(docs), items.select(F.col("item_id").alias("query"), "text"), 10)
    return found.withColumnRenamed("query", "item_id")


OP12_SQL = r"""
WITH words AS (
  SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t
  FROM documents
), stats AS (SELECT count(*) FILTER (len(t) > 0) AS docs, sum(len(t))::BIGINT AS terms FROM words),
asked AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM benchmark
), postings AS (
  SELECT row, doc_id, n, term, count(*) AS tf FROM (SELECT row, doc_id, len(t) AS n, unnest(t) AS term FROM words)
  WHERE term IN (SELECT term FROM asked) GROUP BY row, doc_id, n, term
), weights AS (
  SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM postings, stats GROUP BY term, docs
), scored AS (
  SELECT item_id, row, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // terms))))::BIGINT AS score
  FROM asked JOIN postings USING (term) JOIN weights USING (term), stats GROUP BY item_id, row, doc_id
), ranked AS (
  SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score
  FROM scored WHERE score > 0
)
SELECT * FROM ranked WHERE rank <= 10
"""


def op13_chunked_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to WARC archives and read back."""
    pages = table(small_batches(spark), sf_dir, "pages")
    manifest = warc.write_archives(warc.records(pages))
    return warc.resolved(warc.read_archives(manifest, bodies=False))


OP13_SQL = """
WITH bodies AS (
  SELECT page_id, coalesce(html, '') AS html FROM pages
), numbered AS (
  SELECT page_id, strlen(html) AS payload_bytes, sha1(html) AS hex,
         row_number() OVER (PARTITION BY html ORDER BY page_id) AS place, min(page_id) OVER (PARTITION BY html) AS first
  FROM bodies
)
SELECT page_id, payload_bytes, array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         1 + ((('0x' || substr(hex, 1 + 10 * (i // 8)::INT, 10))::BIGINT >> (35 - 5 * (i % 8))::BIGINT) & 31)::INT, 1)), '') AS payload_digest,
       CASE WHEN place = 1 THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN place > 1 THEN first END AS refers_to
FROM numbered
"""

QUERIES = {
    "op1_collision_counting": op1_collision_counting,
    "op2_token_groups": op2_token_groups,
    "op3_family_svm": op3_family_svm,
    "op4_reply_trees": op4_reply_trees,
    "op5_weak_supervision": op5_weak_supervision,
    "op6_bloom_cascade": op6_bloom_cascade,
    "op7_transducer_counts": op7_transducer_counts,
    "op8_seeds_alignment": op8_seeds_alignment,
    "op9_cost_balanced": op9_cost_balanced,
    "op10_partial_matching": op10_partial_matching,
    "op11_entry_trie": op11_entry_trie,
    "op12_max_sketches": op12_max_sketches,
    "op13_chunked_records": op13_chunked_records,
}
SQL = {
    "op2_token_groups": OP2_SQL,
    "op4_reply_trees": OP4_SQL,
    "op6_bloom_cascade": OP6_SQL,
    "op11_entry_trie": OP11_SQL,
    "op12_max_sketches": OP12_SQL,
    "op13_chunked_records": OP13_SQL,
}
