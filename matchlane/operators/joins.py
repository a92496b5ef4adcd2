"""Joins and top-k that hold up under skew."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchlane.session import is_stored, materialise, size_of

BROADCAST_BYTES = 64 << 20
SALTS = 64


def join_lookup(
    big: DataFrame,
    lookup: DataFrame,
    on: list[str],
    spread: Column,
    how: str = "inner",
    max_bytes: int = BROADCAST_BYTES,
    salts: int | None = None,
) -> DataFrame:
    """Join a large table with a lookup of unknown size.

    The lookup is worked out once, into a stored table whose size is then known.
    Up to ``max_bytes`` it is broadcast and the large side is not shuffled.  Beyond that, every lookup row is copied to
    ``salts`` buckets (as many as the session has shuffle partitions, at most
    1000) and each row of the large side picks one by ``spread``, so a key that
    holds a third of the large side is split over all of them.
    """
    lookup = lookup if is_stored(lookup) else materialise(lookup, "lookup")
    if size_of(lookup) <= max_bytes:
        return big.join(F.broadcast(lookup), on, how)
    if salts is None:
        salts = min(1000, int(big.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    salted = lookup.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return (
        big.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int"))
        .join(salted, [*on, "_salt"], how)
        .drop("_salt")
    )


def join_split(big: DataFrame, other: DataFrame, on: list[str], spread: Column, how: str = "inner", heavy_keys: int = 1000) -> DataFrame:
    """Join two large tables where some keys may hold a large share of ``big``.

    The keys of ``big`` are counted first. A key with more than one in ``heavy_keys`` of its rows is
    heavy, so there are fewer than ``heavy_keys`` of them; their rows meet their partners by
    ``join_lookup``, spread over all tasks by ``spread``. The other rows meet theirs in a shuffle, in
    which no key is heavy.
    """
    counts = big.groupBy(*on).agg(F.count("*").alias("_n"))
    counts = materialise(counts, "key-counts")
    total = counts.agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0]
    known = F.lit(True)
    for key in on:
        known = known & F.col(key).isNotNull()
    heavy = counts.where((F.col("_n") * heavy_keys > total) & known).select(*on)
    heavy = materialise(heavy, "heavy-keys")
    if heavy.isEmpty():
        return big.join(other, on, how)
    few = F.broadcast(heavy)  # fewer than ``heavy_keys`` rows
    rest = big.join(few, on, "left_anti").join(other, on, how)
    split = join_lookup(big.join(few, on, "left_semi"), other.join(few, on, "left_semi"), on, spread, how)
    return rest.unionByName(split)


def top_k(
    df: DataFrame, group: list[str], order: list[Column], k: int, spread: Column, rank: str = "rank", salts: int = SALTS
) -> DataFrame:
    """The first ``k`` rows per group with their rank.

    The first window ranks inside ``salts`` slices of a group, so one task never
    sorts a whole group; the second sees at most ``k * salts`` rows per group.
    Spark pushes both limits below their shuffle.
    """
    sliced = df.withColumn("_slice", F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int"))
    partial = Window.partitionBy(*group, "_slice").orderBy(*order)
    final = Window.partitionBy(*group).orderBy(*order)
    return (
        sliced.withColumn("_r", F.row_number().over(partial))
        .where(F.col("_r") <= k)
        .drop("_r", "_slice")
        .withColumn(rank, F.row_number().over(final))
        .where(F.col(rank) <= k)
    )


def with_ordinal(df: DataFrame, order: list[str | Column], name: str = "ordinal") -> DataFrame:
    """Adds the row's position (from 0) in the given total order, without a single-task sort.

    Rows are range-partitioned and sorted inside partitions; one small table of
    partition sizes gives each partition its offset.
    """
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = materialise(
        ranged.select("*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_at")),
        "ordinal",
    )
    sizes = placed.groupBy("_part").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    return (
        placed.join(F.broadcast(offsets), "_part")
        .withColumn(name, F.col("_offset") + F.col("_at") - F.col("_first"))
        .drop("_part", "_at", "_first", "_offset")
    )
