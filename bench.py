"""Headline queries on local[$BENCH_CPUS]; prints one JSON line.

``rank_100k`` ranks a pool of 100 000 profiles (the derived profiles repeated
under new ids) against one job: features, index, scores, shortlist, reasoning.
The pool is written as JSON lines before the clock starts, like a candidate file
would be; reading and parsing them counts.
"""

import json
import os
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from checks import answers, profiles, quality, ranking, resumes, text
from matchlane.plans.sample_profiles import candidate_id, candidate_key, raw_profiles
from matchlane.plans.shortlist import rank_candidates
from matchlane.session import materialise, tune, work_path
from matchlane.sources.candidates import read_profiles, to_candidates

POOL = 100_000


def session() -> SparkSession:
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("matchlane-bench")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "20g"))
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return tune(spark)


def pool(spark: SparkSession, sf_dir: str):
    """At least ``POOL`` raw profiles, each with its own id."""
    raw = materialise(raw_profiles(spark, sf_dir), "bench-profiles")
    n = raw.count()
    copies = -(-POOL // n)
    key = candidate_key(F.col("candidate_id"))
    repeated = raw.withColumn("_copy", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))
    return (
        repeated.withColumn("candidate_id", candidate_id(key + F.col("_copy") * n))
        .drop("_copy")
        .limit(POOL)
        .repartition(spark.sparkContext.defaultParallelism * 4)
    )


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = session()
    path = work_path(spark, "bench-pool")
    pool(spark, sf_dir).select(F.to_json(F.struct("*")).alias("value")).write.text(path)

    def rank_pool(spark, _):
        return rank_candidates(to_candidates(read_profiles(spark, path)), ranking.default_job(spark), profiles.today(), 100)

    headline = {
        "rank_100k": rank_pool,
        "rank_candidates": ranking.shortlists,
        "hybrid_topk": text.topk,
        "bm25_scores": text.bm25,
        "token_counts": text.token_counts,
        "skill_evidence": profiles.skill_evidence,
        "error_counts": quality.error_counts,
        "reward_means": answers.reward_means,
        "resume_profiles": resumes.profiles,
    }
    times = {}
    for name, query in headline.items():
        start = time.perf_counter()
        query(spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    print(
        json.dumps(
            {
                "metric": "headline queries, total wall time",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
