"""Language identification in two steps: the family, then one-versus-one linear SVMs within it.

Features are frequencies of byte 2-, 3- and 4-grams of the lower-cased text, hashed to buckets, with
everything that is no letter read as a space. Each decision is a linear support vector machine over
features scaled by their log count ratio of the two sides, trained by stochastic subgradient steps
that start from and are drawn to the ratio itself. Families are one-versus-rest; inside a family
every pair of languages has a machine and the language with most wins, then the largest sum of
margins, is predicted.

Training uses at most ``per_language`` documents a language (those of the smallest hashes of id and
text) of at most ``max_languages`` languages, the most frequent: a fixed bound for what reaches the
driver. Short stretches of the sampled texts are trained on as well, for the sake of short documents.

Nulls: a text that is null or has no letter is ``und`` with score 0; so is every text if no language
was learned. Rows without a language, or with a blank one, are not trained on. Repeated documents are
predicted each. Other columns are not read, and language, source and id never enter a prediction.
"""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchlane.llm.support import text_slices

# Language codes by family.
FAMILIES = {
    "germanic": ["en", "de", "nl", "sv", "da", "no", "nb", "nn", "is", "fo", "af", "fy", "lb", "yi"],
    "romance": ["fr", "es", "it", "pt", "ro", "ca", "gl", "oc", "la"],
    "slavic": ["ru", "uk", "be", "pl", "cs", "sk", "bg", "sr", "hr", "bs", "sl", "mk"],
    "baltic": ["lt", "lv"],
    "celtic": ["ga", "gd", "cy", "br"],
    "uralic": ["fi", "et", "hu"],
    "turkic": ["tr", "az", "kk", "uz", "tt"],
    "indic": ["hi", "ur", "bn", "mr", "ne", "pa", "gu"],
    "semitic": ["ar", "he", "mt"],
    "sinitic": ["zh", "yue"],
    "austronesian": ["id", "ms", "tl", "jv"],
}
FAMILY_OF = {language: family for family, languages in FAMILIES.items() for language in languages}
BUCKETS = 1 << 14
PER_LANGUAGE = 300
MAX_LANGUAGES = 64
UNKNOWN = "und"
_LETTER = regex.compile(r"\p{L}")
_FOLD = np.full(256, 32, np.uint8)
_FOLD[97:123] = _FOLD[65:91] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)


def gram_buckets(data: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """(n, bucket of the n-gram at each position) for n = 2, 3, 4."""
    b = _FOLD[data].astype(np.uint32)
    out, code = [], b
    for n in (2, 3, 4):
        code = code[:-1] * np.uint32(0x01000193) ^ b[n - 1 :] * np.uint32(0x9E3779B1)
        out.append((n, (code * np.uint32(0x85EBCA6B) >> np.uint32(18)).astype(np.int32)))
    return out


def row_scores(data: np.ndarray, offsets: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Mean weight of each row's n-grams, by machine (rows x machines)."""
    rows = len(offsets) - 1
    total, count = np.zeros((rows, weights.shape[1])), np.zeros(rows)
    for n, buckets in gram_buckets(data):
        first = np.minimum(offsets[:-1], len(buckets))
        end = np.minimum(np.maximum(offsets[:-1], offsets[1:] - n + 1), len(buckets))
        count += end - first
        for machine in range(weights.shape[1]):
            sums = np.concatenate([np.zeros(1), np.cumsum(weights[buckets, machine], dtype=np.float64)])
            total[:, machine] += sums[end] - sums[first]
    return total / np.maximum(count, 1)[:, None]


def _frequencies(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    found, n = np.unique(np.concatenate([b for _, b in gram_buckets(data)]), return_counts=True)
    return found.astype(np.int16), (n / max(1, n.sum())).astype(np.float32)


@dataclass
class Machine:
    """Separates two groups of languages: positive margin for ``yes``."""

    yes: str
    no: str


@dataclass
class Model:
    languages: list[str]
    families: list[str]
    family_machines: list[Machine]
    pair_machines: list[Machine]
    weights: np.ndarray  # buckets x machines
    bias: np.ndarray
    scale: np.ndarray

    def predict(self, margins: np.ndarray) -> tuple[list[str], np.ndarray]:
        """Language and confidence of each row of margins."""
        n = len(margins)
        confidence = 1 / (1 + np.exp(-np.clip(margins * self.scale, -50, 50)))
        family, sure = np.zeros(n, int), np.ones(n)
        if self.family_machines:
            own = margins[:, : len(self.family_machines)]
            if len(self.families) == 2:
                family = (own[:, 0] < 0).astype(int)
                sure = np.where(family == 0, confidence[:, 0], 1 - confidence[:, 0])
            else:
                family = own.argmax(1)
                sure = confidence[np.arange(n), family]
        wins = np.zeros((n, len(self.languages)))
        place = {language: i for i, language in enumerate(self.languages)}
        for k, machine in enumerate(self.pair_machines, len(self.family_machines)):
            a, b = place[machine.yes], place[machine.no]
            wins[:, a] += (margins[:, k] >= 0) + 1e-3 * np.tanh(margins[:, k])
            wins[:, b] += (margins[:, k] < 0) - 1e-3 * np.tanh(margins[:, k])
        members = np.array([[FAMILY_OF.get(x, x) == f for x in self.languages] for f in self.families])
        best = np.where(members[family], wins, -np.inf).argmax(1)
        for k, machine in enumerate(self.pair_machines, len(self.family_machines)):
            for name, share in ((machine.yes, confidence[:, k]), (machine.no, 1 - confidence[:, k])):
                sure = np.where(best == place[name], np.minimum(sure, share), sure)
        return [self.languages[i] for i in best], sure


def sample(labelled: DataFrame, per_language: int, max_languages: int) -> DataFrame:
    """At most ``per_language`` rows (lang, text) of each of the ``max_languages`` most frequent languages.

    Only ids and hashes are ranked; a first cut by hash, from the counts, keeps the ranking small.
    """
    counts = labelled.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(max_languages).collect()
    if not counts:
        return labelled.select("lang", "text").limit(0)
    cut = F.lit(0.0)
    for row in counts:
        cut = F.when(F.col("lang") == row.lang, min(1.0, 4.0 * per_language / row["count"] + 16 / row["count"])).otherwise(cut)
    at = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 40)) / float(1 << 40)
    near = labelled.select("lang", "text", at.alias("_at")).where(F.col("_at") < cut)
    order = Window.partitionBy("lang").orderBy("_at", "text")
    return near.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= per_language).select("lang", "text")


def _examples(texts: list[str]) -> list[np.ndarray]:
    """The texts' bytes, and stretches of 2, 4 and 8 words from inside them."""
    out = []
    for text in texts:
        words = text.split()
        out.append(text)
        for i, n in enumerate((2, 4, 8, 16)):
            at = (len(words) * (2 * i + 1)) // 9
            if len(words) > n:
                out.append(" ".join(words[at : at + n]))
    return [np.frombuffer(t.encode(), np.uint8) for t in out if _LETTER.search(t)]


def _machine(yes: list, no: list, rounds: int = 30, shrink: float = 1e-2, seed: int = 7) -> tuple[np.ndarray, float, float]:
    """Weights by bucket, bias and the scale of margins, of one linear SVM."""
    counts = [np.full(BUCKETS, 0.5), np.full(BUCKETS, 0.5)]
    for side, rows in enumerate((yes, no)):
        for at, share in rows:
            counts[side][at] += share * len(at)
    ratio = np.log(counts[0] / counts[0].sum()) - np.log(counts[1] / counts[1].sum())
    n_yes, rows = len(yes), [*yes, *no]  # scaled when they are met, to hold the sample once
    share_of = {1.0: 0.5 / max(1, len(yes)), -1.0: 0.5 / max(1, len(no))}
    w, b, order = np.ones(BUCKETS), 0.0, np.random.default_rng(seed)
    step = 1
    for _ in range(rounds):
        for i in order.permutation(len(rows)):
            (at, share), y = rows[i], 1.0 if i < n_yes else -1.0
            x = share * ratio[at]
            rate = 1 / (shrink * (step + 1000))
            margin = y * (x @ w[at] + b)
            w[at] -= rate * shrink * (w[at] - 1)
            if margin < 1:
                push = rate * y * share_of[y] * len(rows) / 10
                w[at] += push * x
                b += push / 10
            step += 1
    return w * ratio, b, 4.0


def train(rows: list[tuple[str, str]]) -> Model | None:
    """A model of (language, text) rows, on the driver; the sample bounds their number."""
    by: dict[str, list] = {}
    for language, text in sorted(rows):
        by.setdefault(language, []).append(text)
    features = {k: [_frequencies(d) for d in _examples(v) if len(d) > 4] for k, v in by.items()}
    languages = sorted(k for k, v in features.items() if v)
    if not languages:
        return None
    family = {x: FAMILY_OF.get(x, x) for x in languages}
    families = sorted(set(family.values()))
    inside = {f: [r for x in languages if family[x] == f for r in features[x]] for f in families}
    firsts = families[:1] if len(families) == 2 else families if len(families) > 2 else []
    machines = [(Machine(f, "rest"), inside[f], [r for g in families if g != f for r in inside[g]]) for f in firsts]
    pairs = [(a, b) for i, a in enumerate(languages) for b in languages[i + 1 :] if family[a] == family[b]]
    machines += [(Machine(a, b), features[a], features[b]) for a, b in pairs]
    built = [_machine(yes, no) for _, yes, no in machines]
    weights = np.stack([w for w, _, _ in built], 1) if built else np.zeros((BUCKETS, 0))
    names = [m for m, _, _ in machines]
    return Model(
        languages,
        families,
        names[: len(firsts)],
        names[len(firsts) :],
        weights.astype(np.float32),
        np.array([b for _, b, _ in built]),
        np.array([s for _, _, s in built]),
    )


def learn(docs: DataFrame, usable: Column, per_language: int = PER_LANGUAGE, max_languages: int = MAX_LANGUAGES) -> Model | None:
    """A model of the rows where ``usable`` holds, from their text and lang."""
    named = usable & F.col("lang").isNotNull() & (F.trim("lang") != "") & F.col("text").isNotNull()
    chosen = sample(docs.where(named).select("doc_id", "lang", "text"), per_language, max_languages)
    return train([(r.lang, r.text) for r in chosen.collect()])


def predict(docs: DataFrame, model: Model | None, keep: list[str], inside: str | None = None) -> DataFrame:
    """Columns ``keep`` with lang_pred and score, for every row; the text may lie ``inside`` one of them."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for part in parts:
            found, scores = [], []
            column = part.column("_text") if inside is None else part.column(inside).field("text")
            for at, to, data, offsets in text_slices(column):
                letters = [bool(t and _LETTER.search(t)) for t in column.slice(at, to - at).to_pylist()]
                if known is None:
                    names, sure = [UNKNOWN] * (to - at), np.zeros(to - at)
                else:
                    names, sure = known.predict(row_scores(data, offsets, known.weights) + known.bias)
                found += [x if ok else UNKNOWN for x, ok in zip(names, letters, strict=True)]
                scores.append(np.where(letters, sure, 0.0))
            rest = [part.column(c) for c in keep]
            yield pa.RecordBatch.from_arrays(
                [*rest, pa.array(found, pa.string()), pa.array(np.concatenate([*scores, np.zeros(0)]))],
                names=[*keep, "lang_pred", "score"],
            )

    kept = docs.select(*keep, *([F.col("text").alias("_text")] if inside is None else []))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[: len(keep)])
    return kept.mapInArrow(batches, f"{schema}, lang_pred string, score double")


def keep_known(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, whose language is known, however low its score.

    The score says how sure the choice between languages is; a clean text between several of them has
    a low one.
    """
    model = learn(docs, F.lit(True))
    named = predict(docs.select(F.struct("*").alias("doc")), model, ["doc"], "doc")
    return named.where(F.col("lang_pred") != UNKNOWN).select("doc.*")
