"""Session settings and the shared working folder."""

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Settings the jobs rely on.  Duplicate JSON keys keep the last value instead of failing.
RECOMMENDED = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.variant.allowDuplicateKeys": "true",
}


def tune(spark: SparkSession) -> SparkSession:
    """Apply the recommended settings to a running session."""
    for key, value in RECOMMENDED.items():
        spark.conf.set(key, value)
    return spark


# Working tables made by this process, for ``scratch``.
_made: list[str] = []


@cache
def _local_folder(application: str) -> str:
    """A folder of this machine that goes when the process ends."""
    folder = tempfile.mkdtemp(prefix=f"matchlane-{application}-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach, named by ``spark.checkpoint.dir``.

    A temporary folder of this machine is used only in local mode.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if spark.sparkContext.master.startswith("local"):
        return _local_folder(spark.sparkContext.applicationId)
    raise ValueError("set spark.checkpoint.dir to a folder shared by the cluster")


def work_path(spark: SparkSession, name: str) -> str:
    _made.append(f"{shared_folder(spark)}/matchlane/{name}-{uuid.uuid4().hex}")
    return _made[-1]


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Removes the working tables made inside, for jobs that end with their results written."""
    first = len(_made)
    try:
        yield
    finally:
        for path in _made[first:]:
            folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
        del _made[first:]


def materialise(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Write ``df`` as a parquet table in the shared folder and read it back.

    Cuts the lineage: a lost executor re-reads the table instead of repeating the work.
    """
    target = path or work_path(df.sparkSession, name)
    df.write.mode("errorifexists").option("compression", "zstd").parquet(target)
    return df.sparkSession.read.schema(df.schema).parquet(target)


def is_stored(df: DataFrame) -> bool:
    """Whether ``df`` is a scan of files (of some of their columns) and nothing else."""
    plan = df._jdf.queryExecution().analyzed()
    while plan.nodeName() == "Project" and all(e.nodeName() == "AttributeReference" for e in _listed(plan.expressions())):
        plan = plan.children().head()
    return plan.nodeName() == "LogicalRelation"


def _listed(items) -> list:
    return [items.apply(i) for i in range(items.size())]


def fits(df: DataFrame, max_rows: int) -> bool:
    """Whether ``df`` has at most ``max_rows`` rows; counted where the rows are."""
    return df.count() <= max_rows


def size_of(df: DataFrame) -> int:
    """About how many bytes the rows of ``df`` hold, summed up where they are."""

    def width(name: str, kind: str) -> Column:
        column = F.col(f"`{name}`")
        if kind in ("string", "binary"):
            return F.octet_length(column)
        nested = kind.startswith(("array", "map", "struct", "variant"))
        return F.octet_length(F.to_json(F.struct(column))) if nested else F.lit(8)

    row = sum((F.coalesce(width(*column), F.lit(0)) for column in df.dtypes), F.lit(16))
    return df.agg(F.coalesce(F.sum(row.cast("bigint")), F.lit(0))).first()[0]


def spread(df: DataFrame) -> DataFrame:
    """Rebalance an input with fewer splits than cores (few large files or row groups).

    Leaves larger inputs alone, so it adds no shuffle at scale.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
