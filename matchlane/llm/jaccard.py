"""Near duplicates by an n-gram Jaccard join over a token-group matrix.

A document is the set of its ``k``-word shingles (64-bit hashes). Two link when
``den * |intersection| >= num * |union|``. All links are found exactly:

1. Documents with equal sets form a class; its smallest id goes on alone.
2. Similar documents are put into groups: a class is compared with the smallest one that shares a
   min-hash, if their sketches agree; verified links make families, and families are cut into groups
   of about ``GROUP`` members (a class without a family is a group of its own).
3. The token-group matrix holds, for each token, the groups in whose prefixes it occurs. A prefix is
   the ``n - ceil(n * num / den) + 1`` first tokens of a set; linked sets share a token of their
   prefixes. Tokens are ordered by the number of open documents that hold them, those of one family
   alone first: a copy's own tokens and rare ones fill its prefix before those of a passage that many
   share. Before that, a document with as many tokens as its prefix has that occur in no
   other class (later: no other family) can't link outside, as a link leaves it fewer tokens of its
   own: it is done. Looking at somewhat more than the prefix settles most documents; those left are
   looked at again among themselves, now with all their tokens, until no more can be settled.
4. For a document and a group of another family, the places of a shared prefix token in both and the
   sizes of the sets bound the overlap with any member; so does, then, the overlap with the union of
   the group's tokens. Only qualifying groups are opened and their members verified.

Pairs inside a family are never made, so a large family of near copies costs its size, not its
square. Full sets are read only for documents with a candidate.

Nulls: a null text, or one without words, has an empty set and links with nothing; a row without an
id does not take part and has no component. Fewer than ``k`` words make one shingle of the whole
sequence. Rows that repeat an id are judged by their own text: a class is known by its smallest id
and its set, so an id may name several components. An empty table gives an empty result.
"""

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchlane.llm.components import connected
from matchlane.llm.support import mix, shingle_hashes, text_slices, word_hashes
from matchlane.session import materialise

GROUP = 64
SKETCH = 16  # positions of the min-hash sketch; every fourth one is a key for step 2
ROUNDS = 4
BANDS = 16
# Bits of a Bloom filter: ``BITS_EACH`` for each key, as a power of two between these.
BITS_EACH, BLOOM_BITS, MOST_BITS = 16, 1 << 26, 1 << 29
PAGE_BITS = 32768
_STARTS = np.arange(-(SKETCH // 2), SKETCH // 2, dtype=np.int64) * (1 << 64 - SKETCH.bit_length() + 1)


def _sets(part: pa.RecordBatch, k: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingles as signed numbers) of a batch's texts."""
    for at, to, data, offsets in text_slices(part.column("text")):
        words, ranges = word_hashes(data, offsets)
        for i in range(to - at):
            tokens = shingle_hashes(words[ranges[i] : ranges[i + 1]], k).view(np.int64)
            tokens = np.sort(tokens)
            if len(tokens) > 1:
                tokens = tokens[np.concatenate([[True], tokens[1:] != tokens[:-1]])]
            yield at + i, tokens


def _digest(tokens: np.ndarray) -> tuple[int, int]:
    """Two 64-bit sums over a set; equal sets have equal digests and sizes."""
    mixed = mix(tokens.view(np.uint64) + np.uint64(1))
    return int(mixed.sum(dtype=np.uint64).view(np.int64)), int(mix(mixed).sum(dtype=np.uint64).view(np.int64))


def _sketch(tokens: np.ndarray) -> list[int]:
    """The first token from each of ``SKETCH`` evenly spaced places on, going round."""
    if len(tokens) == 0:
        return []
    return tokens[np.searchsorted(tokens, _STARTS) % len(tokens)].tolist()


def _features(docs: DataFrame, k: int) -> DataFrame:
    """Stored rows (doc_id, row, n, d1, d2, mins): a document's set size, digests and sketch."""

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            n, one, two, mins = [], [], [], []
            for _, tokens in _sets(part, k):
                digest = _digest(tokens)
                n.append(len(tokens))
                one.append(digest[0])
                two.append(digest[1])
                mins.append(_sketch(tokens))
            numbers = [pa.array(x, pa.int64()) for x in (n, one, two)]
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), part.column("row"), *numbers, pa.array(mins, pa.list_(pa.int64()))],
                names=["doc_id", "row", "n", "d1", "d2", "mins"],
            )

    schema = f"doc_id {dict(docs.dtypes)['doc_id']}, row long, n long, d1 long, d2 long, mins array<long>"
    return materialise(docs.select("doc_id", "row", "text").mapInArrow(batches, schema), "jaccard-features")


def _prefix_size(n: int, num: int, den: int) -> int:
    return n - -(-n * num // den) + 1


def _carried(tokens: np.ndarray, num: int, den: int) -> np.ndarray:
    """The prefix of a set and some more tokens.

    The common tokens of two linked sets come first in the same order in both. So of x's carried tokens
    those missing from y's are at most the larger of ``|x| - o`` and ``carried(x) - carried(y) + |y| - o``
    for an overlap ``o``, and both are less than x's prefix.
    """
    size = _prefix_size(len(tokens), num, den)
    return tokens[: size + max(2, size // 3)]


def _chosen(docs: DataFrame, reps: DataFrame | None) -> tuple[DataFrame, Callable[[pa.RecordBatch], pa.RecordBatch]]:
    """Texts with a hash of their id, and a filter of their batches: a Bloom filter of ``reps``, or none."""
    if reps is None:
        return docs.select("doc_id", "text"), lambda part: part
    bits = docs.sparkSession.sparkContext.broadcast(_bloom(reps.select(F.xxhash64("rep").alias("key"))))

    def some(part: pa.RecordBatch) -> pa.RecordBatch:
        table = np.frombuffer(bits.value, np.uint8)
        return part.filter(pa.array(_in_bloom(table, part.column("hash").to_numpy())))

    return docs.select("doc_id", F.xxhash64("doc_id").alias("hash"), "text"), some


def _shared_tokens(docs: DataFrame, reps: DataFrame | None, part_of: Callable[[np.ndarray], np.ndarray], k: int) -> DataFrame:
    """Stored tokens that the chosen part of more than one class's set holds."""
    texts, some = _chosen(docs, reps)

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            lists = [(part_of(t), _digest(t)[0]) for _, t in _sets(some(part), k) if len(t)]
            if lists:
                owners = np.repeat(np.array([d for _, d in lists], np.int64), [len(t) for t, _ in lists])
                tokens = np.concatenate([t for t, _ in lists])
                yield pa.RecordBatch.from_arrays([pa.array(tokens), pa.array(owners)], names=["token", "owner"])

    return _of_several(texts.mapInArrow(batches, "token long, owner long"))


def _of_several(found: DataFrame) -> DataFrame:
    """Stored tokens of ``found(token, owner)`` that more than one owner holds."""
    ends = found.groupBy("token").agg(F.min("owner").alias("low"), F.max("owner").alias("high"))
    return materialise(ends.where("low != high").select("token"), "jaccard-tokens")


def _open_documents(
    docs: DataFrame, reps: DataFrame | None, part_of: Callable[[np.ndarray], np.ndarray], k: int, num: int, den: int, keep: bool
) -> DataFrame:
    """rep, d1, d2 (and all tokens, to ``keep``) of the documents that may link outside their class.

    The tokens of the chosen parts that classes share are looked up in a Bloom filter; what it lets
    through by mistake only leaves more documents open.
    """
    shared = _shared_tokens(docs, reps, part_of, k)
    texts, some = _chosen(docs, reps)
    bits = docs.sparkSession.sparkContext.broadcast(_bloom(shared))

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.frombuffer(bits.value, np.uint8)
        for whole in parts:
            part = some(whole)
            kept, ones, twos, lists = [], [], [], []
            for row, tokens in _sets(part, k):
                chosen = part_of(tokens) if len(tokens) else tokens
                own = len(chosen) - np.count_nonzero(_in_bloom(table, chosen))
                if len(tokens) and own < _prefix_size(len(tokens), num, den):
                    digest = _digest(tokens)
                    kept.append(row)
                    ones.append(digest[0])
                    twos.append(digest[1])
                    lists.append(tokens if keep else tokens[:0])
            ends = np.cumsum([0, *map(len, lists)])
            tokens = pa.array(np.concatenate([np.zeros(0, np.int64), *lists]))
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc_id").take(pa.array(kept, pa.int64())),
                    *[pa.array(x, pa.int64()) for x in (ones, twos)],
                    pa.ListArray.from_arrays(pa.array(ends, pa.int32()), tokens),
                ],
                names=["rep", "d1", "d2", "tokens"],
            )

    schema = f"rep {dict(docs.dtypes)['doc_id']}, d1 long, d2 long, tokens array<long>"
    return texts.mapInArrow(batches, schema)


def _settled(documents: DataFrame, num: int, den: int) -> DataFrame:
    """``documents`` without those whose own tokens rule out a link to another family, stored.

    Every round drops documents and with them the reason to keep others; any number of rounds is right.
    The tokens that families share are looked up in a Bloom filter where the documents are, so that only
    a token and a hash of its family are shuffled.
    """
    spark = documents.sparkSession
    left = documents.count()
    for _ in range(ROUNDS):
        shared = _of_several(documents.select(F.xxhash64("label").alias("owner"), F.explode("tokens").alias("token")))
        bits = spark.sparkContext.broadcast(_bloom(shared))

        def batches(parts: Iterator[pa.RecordBatch], bits=bits) -> Iterator[pa.RecordBatch]:
            table = np.frombuffer(bits.value, np.uint8)
            for part in parts:
                sizes = part.column("tokens").value_lengths().to_numpy()
                mixed = _in_bloom(table, part.column("tokens").flatten().to_numpy())
                mixed = np.bincount(np.repeat(np.arange(len(part)), sizes)[mixed], minlength=len(part))
                n = part.column("n").to_numpy()
                # A link takes a token of another family.
                yield part.filter(pa.array((mixed > 0) & (sizes - mixed < _prefix_size(n, num, den))))

        documents = materialise(documents.mapInArrow(batches, documents.schema), "jaccard-open")
        before, left = left, documents.count()
        if left == before or left == 0:
            break
    return documents


def _prefix_column(num: int, den: int) -> Column:
    return F.expr(f"n - (n * {num} + {den - 1}) div {den} + 1")


def _bloom(keys: DataFrame) -> bytes:
    """A Bloom filter of the 64-bit values of a stored column; it grows with them up to ``MOST_BITS`` bits.

    Beyond, too many keys only make it let more through.
    """
    value, n = F.col(keys.columns[0]), keys.count()
    bits = min(MOST_BITS, max(BLOOM_BITS, 1 << (n * BITS_EACH - 1).bit_length() if n else 0))
    places = F.array(value.bitwiseAND(bits - 1), F.shiftright(value, 32).bitwiseAND(bits - 1))
    positions = keys.select(F.explode(places).alias("at")).select((F.col("at") + 1).alias("at"))
    pages = positions.groupBy(F.bitmap_bucket_number("at").alias("page"))
    data = bytearray(bits // 8)
    for page, body in pages.agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits")).toLocalIterator():
        data[(page - 1) * PAGE_BITS // 8 : page * PAGE_BITS // 8] = body
    return bytes(data)


def _in_bloom(table: np.ndarray, values: np.ndarray) -> np.ndarray:
    found, last = np.ones(len(values), np.uint8), len(table) * 8 - 1
    for at in (values & last, values >> 32 & last):
        found &= table[at >> 3] >> (at & 7).astype(np.uint8)
    return (found & 1).astype(bool)


def _full_sets(docs: DataFrame, reps: DataFrame, k: int) -> DataFrame:
    """rep, d1, d2, n and tokens of the texts that a Bloom filter of ``reps`` lets through."""
    texts, some = _chosen(docs, reps)

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in parts:
            part = some(whole)
            for row, tokens in _sets(part, k):
                digest = _digest(tokens)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id").slice(row, 1),
                        pa.array([digest[0]]),
                        pa.array([digest[1]]),
                        pa.array([len(tokens)], pa.int64()),
                        pa.ListArray.from_arrays(pa.array([0, len(tokens)], pa.int32()), pa.array(tokens)),
                    ],
                    names=["rep", "d1", "d2", "n", "tokens"],
                )

    schema = f"rep {dict(docs.dtypes)['doc_id']}, d1 long, d2 long, n long, tokens array<long>"
    return texts.mapInArrow(batches, schema)


def _key(prefix: str = "") -> Column:
    """A class: its smallest id, and its set; the smallest of a component has the component's smallest id."""
    return F.struct(*[F.col(f"{prefix}{c}").alias(c) for c in ("rep", "d1", "d2")])


def _sizes_fit(a: Column, b: Column, num: int, den: int) -> Column:
    return F.least(a, b) * den >= F.greatest(a, b) * num


def _linked(shared: Column, num: int, den: int) -> Column:
    return shared * den >= (F.col("na") + F.col("nb") - shared) * num


def _seed_links(docs: DataFrame, classes: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """Stored links (a, b) between classes and the smallest one that shares a min-hash.

    Pairs whose sketches agree in less than half are left to the matrix. A set moves twice: to its
    pair, and to the smaller class of the pair.
    """
    own = F.struct("rep", "n", "d1", "d2", "mins")
    places = F.filter("mins", lambda x, i: i % 4 == 0)
    keyed = classes.select(own.alias("b"), F.explode(F.array_distinct(places)).alias("value"))
    first = keyed.groupBy("value").agg(F.min("b").alias("a"), F.count("*").alias("many")).where("many > 1").drop("many")
    agree = F.size(F.filter(F.arrays_zip(F.col("a.mins").alias("x"), F.col("b.mins").alias("y")), lambda z: z["x"] == z["y"]))
    near = keyed.join(first, "value").where(
        (_key("a.") != _key("b.")) & _sizes_fit(F.col("a.n"), F.col("b.n"), num, den) & (agree * 2 >= SKETCH)
    )
    names = [f"{side}.{c} AS {side}_{c}" for side in "ab" for c in ("rep", "d1", "d2")]
    seeds = materialise(near.selectExpr(*names).distinct(), "jaccard-seeds")
    ends = [_key("a_").alias("a"), _key("b_").alias("b")]
    if seeds.isEmpty():
        return seeds.select(*ends)
    members = _full_sets(docs, seeds.selectExpr("b_rep AS rep"), k).toDF("b_rep", "b_d1", "b_d2", "nb", "tb")
    leaders = _full_sets(docs, seeds.selectExpr("a_rep AS rep"), k).toDF("a_rep", "a_d1", "a_d2", "na", "ta")
    met = seeds.join(members, ["b_rep", "b_d1", "b_d2"]).join(leaders, ["a_rep", "a_d1", "a_d2"])
    linked = met.where(_linked(F.size(F.array_intersect("ta", "tb")), num, den))
    return materialise(linked.select(*ends).distinct(), "jaccard-links")


def _labelled(classes: DataFrame, links: DataFrame) -> DataFrame:
    """Stored classes with their family (``label``), its size, and their group in it (``chunk``)."""
    labels = connected(links)
    sizes = labels.groupBy("label").agg(F.count("*").alias("family"))
    named = labels.join(sizes, "label").select("node.*", "label", "family")
    joined = classes.join(named, ["rep", "d1", "d2"], "left")
    family = F.coalesce("family", F.lit(1).cast("long"))
    return materialise(
        joined.select(
            "rep",
            "n",
            "d1",
            "d2",
            F.coalesce(F.col("label"), _key()).alias("label"),
            family.alias("family"),
            F.pmod(F.xxhash64("rep", "d1"), F.ceil(family / GROUP)).alias("chunk"),
        ),
        "jaccard-families",
    )


def _prefixes(documents: DataFrame, num: int, den: int) -> DataFrame:
    """A row (…, at, token) for each prefix token that another family holds, too; ``at`` is its place.

    A token is its count and its hash, in this order; the ``own`` tokens of a family come before all of
    them and meet nothing. ``documents`` is a stored table: its rows are told apart by their place in it.
    """
    documents = documents.withColumn("number", F.monotonically_increasing_id())
    named = ["rep", "d1", "d2", "n", "label", "family", "chunk"]
    postings = documents.select("number", F.xxhash64("label").alias("owner"), F.explode("tokens").alias("token"))
    counts = postings.groupBy("token").agg(F.min("owner").alias("low"), F.max("owner").alias("high"), F.count("*").alias("held"))
    mixed = postings.select("number", "token").join(counts.where("low != high").select("token", "held"), "token")
    ordered = mixed.groupBy("number").agg(F.array_sort(F.collect_list(F.struct("held", "token"))).alias("mixed"))
    own = (F.size("tokens") - F.size("mixed")).alias("own")
    sized = documents.join(ordered, "number").select(*named, own, "mixed")
    left = F.greatest(_prefix_column(num, den) - F.col("own"), F.lit(0)).cast("int")
    each = sized.select(*named, "own", F.posexplode(F.slice("mixed", 1, left)).alias("place", "token"))
    return each.withColumn("at", F.col("own") + F.col("place")).drop("own", "place")


def _band(n: Column) -> Column:
    """Band of set sizes: about six in a hundred wide."""
    return F.floor(F.log(n) * BANDS)


def _matrix_pairs(documents: DataFrame, num: int, den: int) -> DataFrame:
    """Stored (q, label, chunk): documents and groups of other families that may hold a link.

    Of two families the smaller one asks, so a large family is met by group and not by member. Linked
    sets of ``n`` and ``m`` tokens have ``num * (n + m) / (num + den)`` tokens in common, and all of them
    lie at their first common token or after it. So that token leaves as many in both sets, and a token
    met later than that is no reason to open a group. A document therefore asks, by token, only the bands
    of sizes that its place of the token allows, and a group answers if the place in a member allows it.
    Of a group of one member all common tokens up to the last one met are then known; to their number
    no more can be added than tokens are left in either set.
    """
    rows = materialise(_prefixes(documents, num, den), "jaccard-prefixes")
    both = num + den
    groups = rows.groupBy("token", _band(F.col("n")).alias("band"), "label", "chunk", "family").agg(
        F.min("n").alias("low"),
        F.max("n").alias("high"),
        F.max(F.col("n") * den - F.col("at") * both).alias("reach"),
        F.max("at").alias("place"),
    )
    least = F.expr(f"(n * {num} + {den - 1}) div {den}")
    most = F.least(F.expr(f"n * {den} div {num}"), F.expr(f"(({both}) * (n - at) - {num} * n) div {num}"))
    asking = rows.select("token", _key().alias("q"), "n", "at", F.struct("family", "label").alias("from"), least.alias("least"), most.alias("most"))
    asking = asking.where("least <= most").withColumn("band", F.explode(F.sequence(_band(F.col("least")), _band(F.col("most")))))
    met = asking.join(groups, ["token", "band"]).where(
        (F.col("from") < F.struct("family", "label"))
        & (F.col("low") <= F.col("most"))
        & (F.col("high") >= F.col("least"))
        & (F.col("reach") >= F.col("n") * num)
    )
    pairs = met.groupBy("q", "label", "chunk").agg(
        F.count("*").alias("common"),
        F.max("at").alias("at"),
        F.max("place").alias("place"),
        *[F.min(c).alias(c) for c in ("n", "family", "low")],
    )
    rest = F.least(F.col("n") - 1 - F.col("at"), F.col("low") - 1 - F.col("place"))
    bound = (F.col("common") + rest) * both >= (F.col("n") + F.col("low")) * num
    return materialise(pairs.where((F.col("family") > 1) | bound).select("q", "label", "chunk"), "jaccard-pairs")


def _opened(pairs: DataFrame, documents: DataFrame, num: int, den: int) -> DataFrame:
    """Stored links (a, b) between documents and the open members of qualifying groups."""
    asking = documents.select(_key().alias("q"), F.col("n").alias("na"), F.col("tokens").alias("ta"))
    members = documents.select("label", "chunk", _key().alias("b"), F.col("n").alias("nb"), F.col("tokens").alias("tb"))
    members = members.join(pairs.select("label", "chunk").distinct(), ["label", "chunk"], "left_semi")
    unions = members.groupBy("label", "chunk").agg(F.array_distinct(F.flatten(F.collect_list("tb"))).alias("union"))
    bound = F.size(F.array_intersect("ta", "union")) * den >= F.col("na") * num
    qualified = pairs.join(unions, ["label", "chunk"]).join(asking, "q").where(bound).select("q", "label", "chunk")
    met = qualified.join(members, ["label", "chunk"]).join(asking, "q")
    linked = met.where(_sizes_fit(F.col("na"), F.col("nb"), num, den) & _linked(F.size(F.array_intersect("ta", "tb")), num, den))
    return materialise(linked.select(F.col("q").alias("a"), "b"), "jaccard-links")


def _components(docs: DataFrame, k: int, num: int, den: int, row: Column) -> DataFrame:
    """doc_id, row, n, component: the smallest class that links lead to; a set of its own for empty texts."""
    texts = docs.select("doc_id", row.cast("long").alias("row"), "text")
    features = _features(texts, k)
    grouped = features.where("n > 0 and doc_id is not null").groupBy("n", "d1", "d2")
    classes = materialise(grouped.agg(F.min("doc_id").alias("rep"), F.first("mins").alias("mins")), "jaccard-classes")
    families = _labelled(classes, _seed_links(texts, classes, k, num, den))
    few = _open_documents(texts, None, lambda tokens: _carried(tokens, num, den), k, num, den, False)
    few = materialise(few.select("rep").distinct(), "jaccard-few")
    all_tokens = _open_documents(texts, few, lambda tokens: tokens, k, num, den, True)
    owned = families.select("rep", "d1", "d2", "n", "label", "family", "chunk")
    once = all_tokens.join(owned, ["rep", "d1", "d2"]).dropDuplicates(["rep", "d1", "d2"])
    documents = _settled(materialise(once, "jaccard-open"), num, den)
    pairs = _matrix_pairs(documents, num, den)
    component = families.select("n", "d1", "d2", F.col("label").alias("component"))
    if not pairs.isEmpty():
        found = _opened(pairs, documents, num, den)
        label = families.select(_key().alias("key"), "label")
        between = found.join(label.toDF("a", "la"), "a").join(label.toDF("b", "lb"), "b").selectExpr("la AS a", "lb AS b")
        merged = connected(between.distinct()).toDF("label", "top")
        component = families.join(merged, "label", "left").select("n", "d1", "d2", F.coalesce("top", "label").alias("component"))
    named = features.join(component, ["n", "d1", "d2"], "left")
    alone = F.when(F.col("doc_id").isNotNull(), F.struct(F.col("doc_id").alias("rep"), "d1", "d2"))
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce(F.col("component"), alone))
    return named.select("doc_id", "row", "n", own.alias("component"))


def near_duplicates(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100, row: Column | None = None) -> DataFrame:
    """doc_id, row, n_shingles, component_id: the smallest id that links lead to, itself included.

    Links have a Jaccard similarity of at least ``num / den``. ``row`` names a row for the caller.
    """
    found = _components(docs, k, num, den, F.lit(None) if row is None else row)
    return found.select("doc_id", "row", F.col("n").alias("n_shingles"), F.col("component.rep").alias("component_id"))


def one_of_each(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """The rows of ``docs``, all columns, without near duplicates: each component keeps its smallest id.

    Of rows that repeat that id in the component one stays; other texts under the same id are other
    components. Rows without an id are kept. ``docs`` is a stored table: its rows are told apart by
    their place in it.
    """
    row = F.monotonically_increasing_id()
    found = materialise(_components(docs, k, num, den, row), "jaccard-components")
    kept = found.groupBy("component").agg(F.min(F.struct("doc_id", "row")).alias("kept")).select("kept.row")
    dropped = found.where("component is not null").join(kept, "row", "left_anti").select("row")
    return docs.select(F.struct("*").alias("doc"), row.alias("row")).join(dropped, "row", "left_anti").select("doc.*")
