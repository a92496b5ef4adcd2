"""Evidence behind claimed skills.

A claim is matched against the skill clusters and weighted by how much backs
it.  Skills are an array inside the candidate row, so matching, summing and the
ratios are row-local: nothing is exploded and a skill that a third of all
candidates list is no hot key.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchlane.functions.binding import let, literal_table
from matchlane.functions.numeric import saturate
from matchlane.functions.text import contains_any, indel_ratio, normalise, normalise_literal
from matchlane.lexicons import (
    CLUSTER_TARGET,
    CLUSTER_WEIGHT,
    DISQUALIFIERS,
    FUZZY_THRESHOLD,
    MUST_HAVE,
    NICE_TO_HAVE,
    PROFICIENCY_DEFAULT,
    PROFICIENCY_WEIGHT,
    SCORED_CLUSTERS,
    SKILL_CLUSTERS,
    SPEECH_SKILLS,
    SURFACE_CLUSTER,
    VISION_SKILLS,
)

TRUST_FLOOR = 1e-9

_ENTRY = "array<struct<norm:string,low:int,high:int,edits:int,pieces:array<string>,cluster:string,member:string>>"


def _pieces(name: str, edits: int) -> list[str]:
    """``edits + 1`` consecutive pieces: one of them survives ``edits`` inserts and deletes unchanged."""
    cuts = [len(name) * i // (edits + 1) for i in range(edits + 2)]
    return [name[i:j] for i, j in zip(cuts, cuts[1:]) if j > i]


def _entry(name: str, cluster: str = "") -> dict:
    """A member with what the fuzzy test needs of it.

    At the threshold a partner's length lies in ``[low, high]``; of the pieces
    for the largest edit count that allows, one must occur in the partner.
    """
    norm = normalise_literal(name)
    t = FUZZY_THRESHOLD
    low = -(-len(norm) * t // (200 - t))
    high = len(norm) * (200 - t) // t
    edits = (len(norm) + high) * (100 - t) // 100
    pieces = _pieces(norm, edits)
    return {"norm": norm, "low": low, "high": high, "edits": edits, "pieces": pieces, "cluster": cluster, "member": name}


def names_match(claim: Column, length: Column, entry: Column, min_len: int = 0) -> Column:
    """Either name contains the other, or they are nearly the same string.

    ``claim`` is normalised.  ``min_len`` > 0 keeps shorter claims from matching
    inside longer names (the default keeps the published behaviour).
    """
    member = entry["norm"]
    inside = F.contains(member, claim)
    return (
        F.contains(claim, member)
        | (inside if min_len == 0 else inside & (length >= min_len))
        | (
            (length >= entry["low"])
            & (length <= entry["high"])
            & F.exists(entry["pieces"], lambda p: F.contains(claim, p))
            & (F.levenshtein(claim, member) <= entry["edits"])
            & (indel_ratio(claim, member) >= FUZZY_THRESHOLD)
        )
    )


def _members(clusters: list[str]) -> Column:
    return literal_table([_entry(n, c) for c, names in SKILL_CLUSTERS if c in clusters for n in names], _ENTRY)


def first_match(claim: Column, clusters: list[str], min_len: int = 0) -> Column:
    """The first matching member in lexicon order, with ``cluster`` and ``member``."""
    hits = let(
        F.length(claim), lambda n: F.filter(_members(clusters), lambda m: names_match(claim, n, m, min_len))
    )
    return F.when(claim != "", F.get(hits, 0))


def _contains_either(claim: Column, cluster: str, min_len: int) -> Column:
    """Some member contains the claim or lies inside it.

    The first half is one search in the joined members: ``|`` occurs in no
    normalised text, so a hit never spans two of them.
    """
    norms = [normalise_literal(n) for n in dict(SKILL_CLUSTERS)[cluster]]
    inside = F.contains(F.lit("|".join(norms)), claim)
    if min_len:
        inside = inside & (F.length(claim) >= min_len)
    return (claim != "") & (inside | contains_any(claim, norms))


def _place_by_containment(claim: Column, min_len: int) -> Column:
    """Position of the first scored cluster decided by containment (or past the end); surface flag."""
    branch = F
    for position, cluster in enumerate(SCORED_CLUSTERS):
        branch = branch.when(_contains_either(claim, cluster, min_len), F.lit(position))
    return F.struct(
        branch.otherwise(F.lit(len(SCORED_CLUSTERS))).alias("position"),
        _contains_either(claim, SURFACE_CLUSTER, min_len).alias("surface"),
    )


def _place_by_similarity(claim: Column, placed: Column) -> Column:
    """Positions of clusters with a nearly equal member that containment has not decided.

    Members are looked up by the claim's length.  Inserts and deletes have the
    parity of the length gap, so an equal length needs two of them, which only
    names of nine characters or more can afford at the threshold.  Their number
    lies between the Levenshtein distance and twice it, so the table is filled
    only when those two fall on different sides of the limit.
    """
    t = FUZZY_THRESHOLD
    entries = [
        (position, normalise_literal(n))
        for position, cluster in enumerate([*SCORED_CLUSTERS, SURFACE_CLUSTER])
        for n in dict(SKILL_CLUSTERS)[cluster]
    ]
    longest = max(len(n) for _, n in entries) * (200 - t) // t

    def near(size: int) -> list[dict]:
        limits = [(position, n, (len(n) + size) * (100 - t) // 100) for position, n in entries]
        return [
            {"position": position, "norm": n, "edits": edits, "pieces": _pieces(n, edits)}
            for position, n, edits in limits
            if edits >= (abs(len(n) - size) or 2)
        ]

    by_length = literal_table(
        [near(size) for size in range(longest + 1)],
        "array<array<struct<position:int,norm:string,edits:int,pieces:array<string>>>>",
    )
    undecided = F.filter(
        F.get(by_length, F.length(claim)),
        lambda m: (
            (m["position"] < placed["position"]) | ((m["position"] == len(SCORED_CLUSTERS)) & ~placed["surface"])
        )
        & F.exists(m["pieces"], lambda p: F.contains(claim, p)),
    )
    hits = F.filter(
        F.transform(undecided, lambda m: m.withField("distance", F.levenshtein(claim, m["norm"]))),
        lambda m: (m["distance"] * 2 <= m["edits"])
        | ((m["distance"] <= m["edits"]) & (indel_ratio(claim, m["norm"]) >= t)),
    )
    return F.transform(hits, lambda m: m["position"])


def skill_trust(s: Column) -> Column:
    """Trust in one claim, in [0, 1]."""
    weights = F
    for level, weight in PROFICIENCY_WEIGHT.items():
        weights = weights.when(s["proficiency"] == level, F.lit(weight))
    prof = weights.otherwise(F.lit(PROFICIENCY_DEFAULT))
    endorsed = saturate(s["endorsements"], 50)
    used = saturate(s["duration_months"], 36)
    assessed = s["assessment_score"] / 100.0
    return F.least(
        F.lit(1.0),
        F.when(
            s["assessment_score"].isNotNull(), 0.40 * prof + 0.20 * endorsed + 0.10 * used + 0.30 * assessed
        ).otherwise(0.55 * prof + 0.25 * endorsed + 0.20 * used),
    )


def looks_padded(s: Column, trust: Column) -> Column:
    loud = s["proficiency"].isin("advanced", "expert")
    thin = (s["endorsements"] <= 2) & (s["duration_months"] <= 6) & s["assessment_score"].isNull()
    return (loud & thin) | (trust < 0.40)


def with_claims(candidates: DataFrame, min_len: int = 0) -> DataFrame:
    """Adds ``claims``: one struct per skill with trust, cluster and flags."""
    named = F.transform(
        "skills", lambda s: s.withField("norm", normalise(s["name"])).withField("trust", skill_trust(s))
    )
    clusters = F.array(*[F.lit(c) for c in SCORED_CLUSTERS])

    def claim(s: Column, i: Column) -> Column:
        placed, similar = F.get("_placed", i), F.get("_similar", i)
        return F.struct(
            s["name"].alias("name"),
            s["norm"].alias("norm"),
            s["trust"].alias("trust"),
            F.get(clusters, F.least(placed["position"], F.array_min(similar))).alias("cluster"),
            (placed["surface"] | F.coalesce(F.array_contains(similar, len(SCORED_CLUSTERS)), F.lit(False))).alias(
                "surface"
            ),
            looks_padded(s, s["trust"]).alias("padded"),
            s["norm"].isin(VISION_SKILLS).alias("vision"),
            s["norm"].isin(SPEECH_SKILLS).alias("speech"),
        )

    return (
        candidates.withColumn("_named", named)
        .withColumn("_placed", F.transform("_named", lambda s: _place_by_containment(s["norm"], min_len)))
        .withColumn(
            "_similar", F.transform("_named", lambda s, i: _place_by_similarity(s["norm"], F.get("_placed", i)))
        )
        .withColumn("claims", F.transform("_named", claim))
        .drop("_named", "_placed", "_similar")
    )


def _trust_where(condition) -> Column:
    return F.aggregate(F.filter("claims", condition), F.lit(0.0), lambda a, c: a + c["trust"])


def cluster_score(cluster: str) -> Column:
    return F.least(F.lit(1.0), _trust_where(lambda c: c["cluster"] == cluster) / CLUSTER_TARGET)


def with_skill_evidence(candidates: DataFrame, min_len: int = 0) -> DataFrame:
    """Adds ``cluster_scores`` and the two ratios that discount the skill score."""
    flagged = _trust_where(lambda c: c["vision"]) + _trust_where(lambda c: c["speech"])
    surface = F.filter("claims", lambda c: c["surface"])
    padded = F.filter("claims", lambda c: c["surface"] & c["padded"])
    return (
        with_claims(candidates, min_len)
        .withColumns(
            {
                "cluster_scores": F.create_map(
                    *[x for name in SCORED_CLUSTERS for x in (F.lit(name), cluster_score(name))],
                    F.lit(SURFACE_CLUSTER),
                    F.lit(0.0),
                ),
                "cv_or_speech_dominance": F.least(
                    F.lit(1.0), flagged / (TRUST_FLOOR + _trust_where(lambda c: F.lit(True)))
                ),
                "keyword_stuff_ratio": F.coalesce(F.try_divide(F.size(padded), F.size(surface)), F.lit(0.0)),
            }
        )
        .withColumn("skill_evidence", skill_component())
    )


def evidence_overall() -> Column:
    """Mean of the cluster scores."""
    values = F.map_values("cluster_scores")
    return F.aggregate(values, F.lit(0.0), lambda a, v: a + v) / F.size(values)


def skill_component(dominance_threshold: float = 0.55, stuff_threshold: float = 0.7) -> Column:
    """Weighted cluster scores, discounted for off-target and padded profiles."""
    base = F.lit(0.0)
    for name, weight in CLUSTER_WEIGHT.items():
        base = base + F.lit(weight) * F.element_at("cluster_scores", F.lit(name))
    off_target = F.when(F.col("cv_or_speech_dominance") >= dominance_threshold, F.lit(0.55)).otherwise(F.lit(1.0))
    stuffed = F.when(F.col("keyword_stuff_ratio") >= stuff_threshold, F.lit(0.65)).otherwise(F.lit(1.0))
    return F.least(F.lit(1.0), base * off_target * stuffed)


def matched_needs() -> Column:
    """Requirement names a candidate covers, over the whole requirement vocabulary.

    Does not depend on the job, so one pass serves every job: hits and misses
    are then array operations against a job's list.
    """
    needs = list(dict.fromkeys(MUST_HAVE + NICE_TO_HAVE + DISQUALIFIERS))
    vocabulary = literal_table([_entry(n) for n in needs], _ENTRY)
    claimed = F.filter(F.transform("skills", lambda s: normalise(s["name"])), lambda n: n != "")
    covered = let(
        claimed,
        lambda names: F.filter(
            vocabulary, lambda v: F.exists(names, lambda n: names_match(n, F.length(n), v))
        ),
    )
    return F.transform(covered, lambda v: v["member"])


def need_hits(required: Column, matched: Column) -> Column:
    return F.array_intersect(required, matched)


def need_misses(required: Column, matched: Column) -> Column:
    return F.array_except(required, matched)
