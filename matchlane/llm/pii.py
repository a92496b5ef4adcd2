"""Personal data by weak supervision: labelers vote, EM weighs them, a classifier decides.

Base spans (email, ip, card, phone) are the valid leftmost matches of fixed patterns. Further
candidates come from looser patterns and from base matches that failed their check. Every candidate
gets a vote (yes, no or none) from each labeler: pattern shape, checksum or range, gazetteer, context
and plain digits. The votes of the whole corpus are counted by pattern of votes (a table of at most
2 x 4 x 3**5 rows), expectation-maximisation (Dawid and Skene) estimates each labeler's reliability
and each pattern's probability, and a logistic regression trained on these decides the candidates
outside the base. Base spans always stay. Only DataFrame functions touch rows.

A pattern is matched by splitting the text at it; offsets are prefix sums of piece lengths in code
points, so a text costs time in proportion to its length. Repetitions are possessive and starts are
anchored at the edge of a run, which does not change what matches: a long run of letters or digits
is read once.

Nulls: a null text is empty. Documents without spans give counts of 0, the hash of the empty string
and empty spans. Repeated documents are judged each. Other columns are not read. An empty table
gives an empty result; without candidates outside the base nothing is learned or added.
"""

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchlane.functions.binding import let

KINDS = ("email", "ip", "card", "phone")
_LOCAL = "A-Za-z0-9._%+-"
BASE = {
    "email": rf"(?:(?<![{_LOCAL}])|\G)[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
LOOSE = {
    "email": rf"(?i)(?<![{_LOCAL}])[{_LOCAL}]{{1,64}} ?[\[(]at[\])] ?[A-Z0-9-]{{1,63}}(?: ?(?:[\[(]dot[\])]|\.) ?[A-Z0-9-]{{1,63}}){{1,8}}",
    "ip": r"(?i)(?<![0-9a-f:])(?:[0-9a-f]{1,4}:){7}[0-9a-f]{1,4}(?![0-9a-f:])",
    "phone": r"(?<![0-9+.-])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9.-])",
}
# What a text must hold for a pattern to match at all; cheap to look for.
HINT = {
    "email": "@",
    "ip": r"[0-9]\.[0-9]",
    "card": r"[0-9](?:[\x20-]?[0-9]){12}",
    "phone": r"\+",
}
LOOSE_HINT = {"email": r"(?i)[\[(]at[\])]", "ip": r"(?i)[0-9a-f]:[0-9a-f]{1,4}:", "phone": r"[0-9]{3}[ .-][0-9]{4}"}
CUES = {
    "email": r"(?i)(mail|contact|write|correo|courriel)\W*(\w+\W+)?$",
    "ip": r"(?i)(\bip|host|server|address|adresse|client)\W*(\w+\W+)?$",
    "card": r"(?i)(card|visa|credit|account|karte|carte|tarjeta)\W*(\w+\W+)?$",
    "phone": r"(?i)(phone|tel|call|fax|mobile|telefon)\W*(\w+\W+)?$",
}
NO_CUE = r"(?i)(version|section|chapter|isbn|issn|order|total|figure|page|sku|build|release)\W*(\w+\W+)?$"
TOP_DOMAINS = "com org net edu gov mil int info biz io co de fr es it uk us eu ch at nl be pl pt se no fi dk cz ru cn jp in br mx ca au".split()
LABELERS = 5
CONTEXT = 24
BLOCK = 256
THRESHOLD = 0.9


def prefix_sums(values: Column) -> Column:
    """Running totals of a non-empty array, block by block so that long arrays stay cheap."""
    zero = F.lit(0).cast("bigint")

    def totals(items: Column) -> Column:
        start = F.struct(zero.alias("at"), F.array().cast("array<bigint>").alias("out"))

        def add(state: Column, v: Column) -> Column:
            at = state["at"] + v
            return F.struct(at.alias("at"), F.concat(state["out"], F.array(at)).alias("out"))

        return F.aggregate(items, start, add, lambda state: state["out"])

    blocks = F.transform(
        F.sequence(F.lit(0), F.floor((F.size(values) - 1) / BLOCK).cast("int")),
        lambda b: totals(F.slice(values, b * BLOCK + 1, BLOCK)),
    )

    def joined(local: Column) -> Column:
        ends = totals(F.transform(local, lambda x: F.element_at(x, -1)))
        shifts = F.concat(F.array(zero), F.slice(ends, 1, F.size(ends) - 1))
        return F.flatten(F.zip_with(local, shifts, lambda x, by: F.transform(x, lambda v: v + by)))

    return let(blocks, joined)


def matches(text: Column, pattern: str, hint: str) -> Column:
    """Array of (start, end, found, before) of all matches; null if the hint is not in the text.

    ``before`` is the end of the text between the match and the one before.
    """
    shape = "array<struct<start:bigint,end:bigint,found:string,before:string>>"

    def place(both: Column) -> Column:
        found, pieces = both["found"], both["pieces"]
        lengths = F.zip_with(pieces, found, lambda p, f: F.length(p) + F.coalesce(F.length(f), F.lit(0)))
        rows = F.arrays_zip(
            F.slice(prefix_sums(lengths), 1, F.size(found)).alias("end"),
            found.alias("found"),
            F.slice(pieces, 1, F.size(found)).alias("piece"),
        )
        return F.transform(
            rows,
            lambda r: F.struct(
                (r["end"] - F.length(r["found"])).alias("start"),
                r["end"].alias("end"),
                r["found"].alias("found"),
                F.right(r["piece"], F.lit(CONTEXT)).alias("before"),
            ),
        ).cast(shape)

    both = F.struct(
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"), F.split(text, pattern, -1).alias("pieces")
    )
    placed = let(both, lambda b: F.when(F.size(b["found"]) > 0, place(b)))
    return F.when(text.rlike(hint), placed)


def digits(found: Column) -> Column:
    return F.regexp_replace(found, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""

    def add(total: Column, i: Column) -> Column:
        digit = F.substring(number, -i, F.lit(1)).cast("int")
        doubled = digit * 2
        return total + F.when(i % 2 == 1, digit).when(doubled > 9, doubled - 9).otherwise(doubled)

    return F.aggregate(F.sequence(F.lit(1), F.length(number)), F.lit(0), add) % 10 == 0


def valid(kind: str, found: Column) -> Column:
    """The check that a base match must pass."""
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        part = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
        return found.rlike(rf"^{part}(?:\.{part}){{3}}$")
    number = digits(found)
    if kind == "card":
        return let(number, lambda n: F.when(F.length(n).between(14, 19), luhn(n)).otherwise(False))
    return F.length(number).between(10, 15)


def _votes(kind: str, loose: bool, m: Column) -> list[Column]:
    """One vote per labeler: 1 yes, 0 no, 2 none."""
    found, yes, no, none = m["found"], F.lit(1), F.lit(0), F.lit(2)
    number = digits(found)
    shape = none if loose else yes
    same = (number == F.repeat(F.left(number, F.lit(1)), F.length(number))) | F.contains(number, F.lit("123456789"))
    if kind == "email":
        top = F.lower(F.regexp_extract(found, "([A-Za-z0-9-]+)$", 1))
        check = F.when(top.rlike("^[a-z]{2,24}$"), yes).otherwise(no)
        known = F.when(top.isin(TOP_DOMAINS), yes).otherwise(none)
        same = F.lit(False)
    elif kind == "ip":
        check = yes if loose else F.when(valid(kind, found), yes).otherwise(no)
        known = F.when(found.rlike(r"^(0|10|127|255|192\.168)\."), no).otherwise(none)
    elif kind == "card":
        check = F.when(valid(kind, found), yes).otherwise(no)
        known = F.when(number.rlike("^(4|5[1-5]|2[2-7]|3[47]|6011|65|35|62)"), yes).otherwise(no)
    else:
        check = F.when(valid(kind, found), yes).otherwise(no)
        known = F.when(found.rlike(r"^\+[1-9]"), yes).otherwise(none)
    cue = F.when(m["before"].rlike(CUES[kind]), yes).when(m["before"].rlike(NO_CUE), no).otherwise(none)
    return [shape, check, known, cue, F.when(same, no).otherwise(none)]


def candidates(text: Column) -> Column:
    """All candidates of a text: (start, end, kind, base, votes); kinds are numbers into ``KINDS``."""

    def of(kind: str, pattern: str, hint: str, loose: bool) -> Column:
        def one(m: Column) -> Column:
            base = F.lit(False) if loose else valid(kind, m["found"])
            return F.struct(
                m["start"].alias("start"),
                F.lit(KINDS.index(kind)).alias("kind"),
                m["end"].alias("end"),
                base.alias("base"),
                F.concat(*[v.cast("string") for v in _votes(kind, loose, m)]).alias("votes"),
            )

        keep = (lambda m: F.length(digits(m["found"])) >= 13) if kind == "card" else None
        found = matches(text, pattern, hint)
        found = F.transform(F.filter(found, keep) if keep else found, one)
        return F.coalesce(found, F.array().cast("array<struct<start:bigint,kind:int,end:bigint,base:boolean,votes:string>>"))

    strict = [of(k, BASE[k], HINT[k], False) for k in KINDS]
    return F.concat(*strict, *[of(k, LOOSE[k], LOOSE_HINT[k], True) for k in LOOSE])


@dataclass(frozen=True)
class SpanClassifier:
    """Logistic regression on a candidate's kind and votes."""

    bias: list[float]
    weights: list[list[float]]  # labeler x vote (no, yes, none)
    reliability: list[dict[str, float]]  # labeler: how often right, of its votes

    def probability(self, kind: Column, votes: Column) -> Column:
        total = F.element_at(F.array(*map(F.lit, self.bias)), kind + 1)
        for i, row in enumerate(self.weights):
            vote = F.substring(votes, i + 1, 1).cast("int")
            total = total + F.element_at(F.array(*map(F.lit, row)), vote + 1)
        return 1 / (1 + F.exp(-total))


def vote_table(docs: DataFrame) -> DataFrame:
    """Counts of candidates by kind, base and votes: a few thousand rows for any corpus."""
    found = docs.select(F.explode(candidates(F.coalesce("text", F.lit("")))).alias("c")).select("c.*")
    return found.groupBy("kind", "base", "votes").agg(F.count("*").alias("n"))


def estimate(rows: list[tuple[int, str, int]], rounds: int = 50) -> tuple[list[float], list[list[list[float]]]]:
    """Dawid-Skene EM over (kind, votes, n): probability of each row, and P(vote | class, labeler).

    Starts from the majority of the votes; every estimate is smoothed by one observation.
    """
    share = [(1 + 2 * v.count("1")) / (2 + 2 * v.count("1") + 2 * v.count("0")) for _, v, _ in rows]
    model: list[list[list[float]]] = []
    for _ in range(rounds):
        prior = {k: [1.0, 1.0] for k in range(len(KINDS))}
        seen = [[[1.0] * 3 for _ in range(2)] for _ in range(LABELERS)]
        for (kind, votes, n), p in zip(rows, share, strict=True):
            for truth, weight in ((1, p), (0, 1 - p)):
                prior[kind][truth] += n * weight
                for i, v in enumerate(votes):
                    seen[i][truth][int(v)] += n * weight
        model = [[[x / sum(row) for x in row] for row in labeler] for labeler in seen]
        share = []
        for kind, votes, _ in rows:
            log = [math.log(x / sum(prior[kind])) for x in prior[kind]]
            for i, v in enumerate(votes):
                for truth in (0, 1):
                    log[truth] += math.log(model[i][truth][int(v)])
            share.append(1 / (1 + math.exp(min(700, max(-700, log[0] - log[1])))))
    return share, model


def train(table: list[tuple[int, str, int]], steps: int = 300, rate: float = 2.0, shrink: float = 1e-3) -> SpanClassifier:
    """The classifier for EM's probabilities, by gradient descent over the rows of the vote table."""
    share, model = estimate(table)
    bias, weights = [0.0] * len(KINDS), [[0.0] * 3 for _ in range(LABELERS)]
    heavy = [math.log1p(n) for _, _, n in table]
    total = sum(heavy) or 1.0
    for _ in range(steps):
        gb, gw = [shrink * b for b in bias], [[shrink * w for w in row] for row in weights]
        for (kind, votes, _), p, n in zip(table, share, heavy, strict=True):
            z = bias[kind] + sum(weights[i][int(v)] for i, v in enumerate(votes))
            error = n / total * (1 / (1 + math.exp(min(700, max(-700, -z)))) - p)
            gb[kind] += error
            for i, v in enumerate(votes):
                gw[i][int(v)] += error
        bias = [b - rate * g for b, g in zip(bias, gb, strict=True)]
        weights = [[w - rate * g for w, g in zip(row, grow, strict=True)] for row, grow in zip(weights, gw, strict=True)]
    reliability = [{"yes": m[1][1], "no": m[0][0]} for m in model]
    return SpanClassifier(bias, weights, reliability)


def learn(docs: DataFrame) -> SpanClassifier:
    rows = vote_table(docs).groupBy("kind", "votes").agg(F.sum("n").alias("n")).collect()
    return train(sorted((r.kind, r.votes, r.n) for r in rows))


def personal_spans(docs: DataFrame, classifier: SpanClassifier, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with ``pii``: (start, kind, end, base, votes) of base spans and accepted candidates, sorted.

    A candidate that overlaps a base span of its kind adds nothing and is left out.
    """

    def decide(found: Column) -> Column:
        base = F.filter(found, lambda c: c["base"])

        def added(c: Column) -> Column:
            clash = F.exists(base, lambda b: (b["kind"] == c["kind"]) & (b["start"] < c["end"]) & (c["start"] < b["end"]))
            return ~c["base"] & (classifier.probability(c["kind"], c["votes"]) >= threshold) & ~clash

        return F.when(F.size(base) == F.size(found), base).otherwise(F.concat(base, F.filter(found, added)))

    text = F.coalesce("text", F.lit(""))
    return docs.withColumn("pii", F.array_sort(let(candidates(text), decide)))


def count_of(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == KINDS.index(kind))).cast("bigint")


def span_list(spans: Column) -> Column:
    """``kind:start:end`` by start, then kind, joined by commas."""
    names = F.array(*map(F.lit, KINDS))
    one = lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])
    return F.array_join(F.transform(spans, one), ",")


def masked(text: Column, classifier: SpanClassifier, threshold: float = THRESHOLD) -> Column:
    """The text with personal data replaced by ``[KIND]``, kind by kind."""
    for loose, patterns, hints in ((False, BASE, HINT), (True, LOOSE, LOOSE_HINT)):
        for kind in patterns:
            text = _mask_kind(text, kind, patterns[kind], hints[kind], loose, classifier, threshold)
    return text


def _mask_kind(text, kind, pattern, hint, loose, classifier, threshold) -> Column:
    def rebuild(both: Column) -> Column:
        def one(piece: Column, found: Column) -> Column:
            m = F.struct(found.alias("found"), F.right(piece, F.lit(CONTEXT)).alias("before"))
            votes = F.concat(*[v.cast("string") for v in _votes(kind, loose, m)])
            likely = classifier.probability(F.lit(KINDS.index(kind)), votes) >= threshold
            if kind == "card":
                likely &= F.length(digits(found)) >= 13
            hit = likely if loose else valid(kind, found) | likely
            return F.concat(piece, F.when(found.isNull(), "").when(hit, f"[{kind.upper()}]").otherwise(found))

        return F.array_join(F.zip_with(both["pieces"], both["found"], one), "")

    def whole(t: Column) -> Column:
        both = F.struct(
            F.regexp_extract_all(t, F.lit(pattern), F.lit(0)).alias("found"), F.split(t, pattern, -1).alias("pieces")
        )
        return F.when(t.rlike(hint), let(both, rebuild)).otherwise(t)

    return let(text, whole)


def without_personal_data(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with personal data masked in ``text``, and ``n_chars``, where present, counted anew."""
    clean = masked(F.coalesce("text", F.lit("")), learn(docs), threshold)
    changed = docs.withColumn("text", F.when(F.col("text").isNotNull(), clean))
    return changed.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else changed
