"""Rule-based scoring of model completions and its aggregates.

Each component is a column expression over one completion joined to its
sample; nothing is collected per group.
"""

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchlane.functions.numeric import clip
from matchlane.operators.joins import join_split

COMPONENTS = [
    "format_valid",
    "decision_match",
    "score_alignment",
    "reason_quality",
    "length_penalty",
    "no_hallucination",
]

# Patterns of checked tokens.
WORD = r"([a-zA-Z][a-zA-Z\-]{2,})"
NUMBER = r"(?U)\b(\d+(?:\.\d+)?)\b"
PROPER_NAME = r"(?U)\b([A-Z][a-zA-Z0-9\-]{2,}(?:\s+[A-Z][a-zA-Z0-9\-]{2,})*)\b"
SPACE = " \t\n\r\u000b\f"


@dataclass(frozen=True)
class Rubric:
    """Weights and limits of the reward."""

    weights: dict[str, float] = field(
        default_factory=lambda: {
            "format_valid": 0.20,
            "decision_match": 0.30,
            "score_alignment": 0.15,
            "reason_quality": 0.15,
            "length_penalty": 0.05,
            "no_hallucination": 0.15,
        }
    )
    min_reasons: int = 2
    max_reasons: int = 5
    max_chars: int = 1200
    min_chars: int = 30


def strip_thinking(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"(?is)<think>.*?</think>", "")


def json_answer(text: Column) -> Column:
    """The object between the first ``{`` and the last ``}``; single quotes are tried as double ones."""
    block = F.nullif(F.regexp_extract(text, r"(?s)\{.*\}", 0), F.lit(""))
    return F.coalesce(F.try_parse_json(block), F.try_parse_json(F.replace(block, F.lit("'"), F.lit('"'))))


def _kind(v: Column) -> Column:
    return F.regexp_extract(F.schema_of_variant(v), "^[A-Z]+", 0)


def _strings(v: Column) -> Column:
    """The string entries of a JSON list."""
    entries = F.filter(v.cast("array<variant>"), lambda x: _kind(x) == "STRING")
    return F.transform(entries, lambda x: x.cast("string"))


def with_answer(completions: DataFrame, completion: str = "completion") -> DataFrame:
    """Adds ``_answer`` and the fields read from it."""
    parsed = completions.withColumn("_answer", json_answer(F.col(completion)))
    fields = parsed.withColumns(
        {f"_{k}": F.try_variant_get("_answer", f"$.{k}", "variant") for k in ("decision", "score", "reasons")}
    )
    score, reasons = F.col("_score"), F.col("_reasons")
    number = (
        F.when(_kind(score) == "BOOLEAN", score.cast("boolean").cast("double"))
        .when(_kind(score).isin("BIGINT", "DECIMAL", "DOUBLE", "STRING"), score.cast("string").try_cast("double"))
    )
    listed = (_kind(reasons) == "ARRAY") & (F.size(F.when(_kind(reasons) == "ARRAY", reasons.cast("array<variant>"))) > 0)
    return (
        fields.withColumns(
            {
                "predicted_decision": F.when(
                    _kind(F.col("_decision")) == "STRING",
                    F.lower(F.btrim(F.col("_decision").cast("string"), F.lit(SPACE))),
                ).otherwise(F.lit("")),
                "predicted_score": number,
                "_given": F.when(listed, _strings(reasons)),
            }
        )
        .withColumn(
            "_clean",
            F.filter(
                F.transform("_given", lambda r: F.btrim(r, F.lit(SPACE))), lambda r: F.length(r).between(3, 240)
            ),
        )
        .withColumn("_words", F.flatten(F.transform("_clean", lambda r: _found(F.lower(r), WORD))))
        .withColumn("_claims", F.concat(_found(_joined(), NUMBER), _found(_joined(), PROPER_NAME)))
    )


def _found(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(1))


def _joined() -> Column:
    return F.concat_ws(" ", "_given")


def _share(part: Column, whole: Column) -> Column:
    return F.coalesce(F.try_divide(part, whole), F.lit(0.0))


def reason_quality(context: Column, rubric: Rubric) -> Column:
    """Enough reasons, varied words, not copied from the context."""
    n = F.size("_clean")
    enough = F.least(n, F.lit(rubric.max_reasons)) / rubric.max_reasons
    enough = F.when(n < rubric.min_reasons, enough * 0.5).otherwise(enough)
    varied = _share(F.size(F.array_distinct("_words")), F.size("_words"))
    copied = F.size(F.filter("_clean", lambda r: F.contains(context, F.lower(r))))
    return F.when(n > 0, 0.5 * enough + 0.3 * varied + 0.2 * (1.0 - _share(copied, n))).otherwise(F.lit(0.0))


def length_penalty(completion: Column, rubric: Rubric) -> Column:
    n = F.length(F.coalesce(completion, F.lit("")))
    return (
        F.when(n < rubric.min_chars, n / rubric.min_chars)
        .when(n <= rubric.max_chars, F.lit(1.0))
        .otherwise(F.greatest(F.lit(0.0), 1.0 - (n - rubric.max_chars) / rubric.max_chars))
    )


def no_hallucination(context: Column) -> Column:
    """Share of numbers and proper names in the reasons that occur in the context."""
    grounded = F.size(F.filter("_claims", lambda c: F.contains(context, c)))
    return (
        F.when(F.col("_given").isNull(), F.lit(0.0))
        .when(F.size("_claims") == 0, F.lit(1.0))
        .otherwise(_share(grounded, F.size("_claims")))
    )


def score_completions(completions: DataFrame, samples: DataFrame, rubric: Rubric = Rubric()) -> DataFrame:
    """``sample_id, model`` and the components of each completion.

    ``completions(sample_id, model, completion)``, ``samples(sample_id,
    decision, score, context)``.  Many completions may share a sample: samples
    that hold a large share of them are found by counting and joined apart.
    """
    gold = samples.select(
        "sample_id", F.col("decision").alias("_gold"), F.col("score").alias("_gold_score"), "context"
    )
    sampled = join_split(completions, gold, ["sample_id"], F.col("completion"))
    answered = with_answer(sampled).withColumn("_lowered", F.lower("context"))
    predicted = clip(F.col("predicted_score"), 0.0, 1.0)
    parts = answered.withColumns(
        {
            "format_valid": F.col("_answer").isNotNull().cast("double"),
            "decision_match": (F.col("predicted_decision") == F.col("_gold")).cast("double"),
            "score_alignment": F.when(
                F.col("predicted_score").isNotNull(), 1.0 - F.abs(predicted - F.col("_gold_score"))
            ).otherwise(F.lit(0.0)),
            "reason_quality": reason_quality(F.col("_lowered"), rubric),
            "length_penalty": length_penalty(F.col("completion"), rubric),
            "no_hallucination": no_hallucination(F.col("context")),
        }
    )
    weighted = sum((rubric.weights[c] * F.col(c) for c in COMPONENTS), F.lit(0.0))
    total = weighted / max(sum(rubric.weights.values()), 1e-9)
    return parts.select("sample_id", "model", *COMPONENTS, total.alias("total"))


def component_means(rewards: DataFrame) -> DataFrame:
    """Mean reward and mean of every component per model."""
    return rewards.groupBy("model").agg(
        F.count("*").alias("n"), F.avg("total").alias("mean_reward"), *[F.avg(c).alias(c) for c in COMPONENTS]
    )


def uplift(rewards: DataFrame, baseline: str, trained: str) -> DataFrame:
    """Per component: baseline mean, trained mean and their difference."""
    means = rewards.where(F.col("model").isin(baseline, trained)).groupBy("model").agg(
        *[F.avg(c).alias(c) for c in [*COMPONENTS, "total"]]
    )
    long = means.unpivot(["model"], [*COMPONENTS, "total"], "component", "mean")
    wide = long.groupBy("component").pivot("model", [baseline, trained]).agg(F.first("mean"))
    return wide.select(
        "component",
        F.col(baseline).alias("baseline"),
        F.col(trained).alias("trained"),
        (F.col(trained) - F.col(baseline)).alias("delta"),
    )


def histogram(rewards: DataFrame, bins: int = 20) -> DataFrame:
    """Completions per model and reward bin on [0, 1]; the last bin includes 1."""
    position = F.least(F.floor(F.round(F.col("total") * bins, 9)), F.lit(bins - 1))
    inside = rewards.where(F.col("total").between(0.0, 1.0))
    return inside.groupBy("model", position.alias("bin")).agg(F.count("*").alias("n"))


def summary(rewards: DataFrame, baseline: str, trained: str) -> DataFrame:
    """One row: rewards compared, the two means and the uplift."""

    def mean(model: str) -> Column:
        return F.avg(F.when(F.col("model") == model, F.col("total")))

    return rewards.agg(
        F.count("*").alias("n_rewards"),
        mean(baseline).alias("baseline_mean_reward"),
        mean(trained).alias("trained_mean_reward"),
        (mean(trained) - mean(baseline)).alias("uplift"),
    )
