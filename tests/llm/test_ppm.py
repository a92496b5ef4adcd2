import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from matchlane.llm import ppm
from tests.llm.support import documents, words


def code_length(counts, context, symbol):
    """log10 of a byte's probability: method C escapes, exclusion of bytes seen in longer contexts."""
    share, excluded = 1.0, set()
    for order in range(len(context), -1, -1):
        seen = counts.get(context[len(context) - order :])
        if not seen:
            continue
        here = {s: n for s, n in seen.items() if s not in excluded}
        distinct = len(here) if len(excluded) + len(here) < 256 else 0
        total = sum(here.values()) + distinct
        if symbol in here:
            return math.log10(share * here[symbol] / total)
        if total:
            share *= distinct / total
        excluded |= set(here)
    return math.log10(share / (256 - len(excluded)))


def brute_model(texts):
    counts = defaultdict(Counter)
    for text in texts:
        data = b"\0\0\0" + (text or "").encode() + b"\0"
        for i in range(3, len(data)):
            for order in range(4):
                counts[data[i - order : i]][data[i]] += 1
    return {c: n for c, n in counts.items() if len(c) == 0 or sum(n.values()) >= 2}


def test_scores_against_brute_force(spark):
    rng = random.Random(3)
    vocabulary = ["the", "The", "of", "été", "zebra", "x" * 30, "a"]
    texts = [(i, " ".join(rng.choices(vocabulary, k=rng.randint(0, 30)))) for i in range(60)]
    texts += [(70, None), (71, ""), (72, "new words here"), (73, "the " * 30000), (5, texts[5][1]), (5, texts[5][1])]
    held = lambda d: d % 5 == 2
    got = ppm.score(documents(spark, texts), F.col("doc_id") % 5 == 2, max_contexts=1 << 30).collect()
    training = [t for d, t in texts if not held(d)]
    tokens = Counter(w for t in training for w in [*words(t), "\0"])
    n, distinct, model = sum(tokens.values()), len(tokens), brute_model(training)
    by = dict(texts)
    assert len(got) == len(texts)
    for r in got:
        own = [*words(by[r.doc_id]), "\0"]
        base = sum(math.log10((tokens[w] + 1) / (n + distinct + 1)) for w in own)
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held(r.doc_id), len(own), sum(tokens[w] > 0 for w in own), n)
        assert r.base_score == pytest.approx(base, rel=1e-9)
        data = b"\0\0\0" + (by[r.doc_id] or "").encode() + b"\0"
        if len(data) < 2000:
            assert r.score == pytest.approx(sum(code_length(model, data[i - 3 : i], data[i]) for i in range(3, len(data))), rel=1e-4)


def test_probabilities_sum_to_one(spark):
    docs = documents(spark, [(i, f"some text {i} and more text {i % 7}") for i in range(200)])
    model = ppm.train(docs, max_contexts=100)
    assert np.allclose((10.0 ** model.logs.astype(float)).sum(1), 1, atol=1e-4)
    assert all(len(c) <= 100 for c in model.contexts)


def test_without_training_rows(spark):
    docs = documents(spark, [(1, "abc"), (2, None)])
    got = {r.doc_id: r for r in ppm.score(docs, F.lit(True)).collect()}
    assert got[1].train_tokens == 0 and got[1].base_score == 0 and got[1].n_known == 0
    assert got[1].score == pytest.approx(-4 * math.log10(256), rel=1e-6)
    assert ppm.score(documents(spark, []), F.lit(False)).count() == 0


@pytest.mark.parametrize("setting", [{}, {"max_contexts": 20}])
def test_rare_contexts_are_known(spark, setting):
    """Texts of another kind than nearly all the corpus, whose contexts are few of its bytes."""
    rng = random.Random(5)
    common = ["lorem", "ipsum", "dolor", "sit", "amet"]
    rare = ["žluť", "kůň", "ДОМ", "QUARTZ", "#7", "été"]
    texts = [(i, " ".join(rng.choices(common, k=600))) for i in range(100)]
    texts += [(100 + i, " ".join(rng.choices(rare, k=12))) for i in range(14)] + [(107, "ДОМ"), (107, "дом"), (107, "ДОМ")]
    got = ppm.score(documents(spark, texts), F.col("doc_id") % 5 == 2, **setting).collect()
    model = brute_model([t for d, t in texts if d % 5 != 2])
    want = []
    for d, t in texts:
        data = b"\0\0\0" + t.encode() + b"\0"
        want.append((d, sum(code_length(model, data[i - 3 : i], data[i]) for i in range(3, len(data))) if d >= 100 else None))
    want = sorted(w for w in want if w[0] >= 100)
    found = sorted((r.doc_id, r.score) for r in got if r.doc_id >= 100)
    assert len(got) == len(texts) and [d for d, _ in found] == [d for d, _ in want]
    assert [s for _, s in found] == pytest.approx([s for _, s in want], rel=1e-4)


def test_rare_contexts_are_met_without_a_shuffle(spark, monkeypatch):
    """The same scores whether all, some or none of the rare grams fit; a shuffle only for those that do not."""
    rng, shuffled, real = random.Random(7), [], ppm._rare_sums
    monkeypatch.setattr(ppm, "_rare_sums", lambda *a: shuffled.append(a[1].count()) or real(*a))
    words_ = ["lorem", "ipsum", "žluť", "ДОМ", "QUARTZ", "#7"]
    texts = [(i, " ".join(rng.choices(words_, [40, 40, 5, 1, 1, 1], k=50))) for i in range(40)] + [(3, None), (4, "")]
    docs, held = documents(spark, texts), F.col("doc_id") % 5 == 2
    found = []
    for rare_grams in (1 << 21, 60, 0):
        rows = ppm.score(docs, held, max_contexts=20, rare_grams=rare_grams).collect()
        found.append(sorted((r.doc_id, r.n_tokens, r.score) for r in rows))
    assert len(shuffled) == 2 and 0 < shuffled[0] < shuffled[1]
    model = brute_model([t for d, t in texts if d % 5 != 2])
    want = []
    for d, t in texts:
        data = b"\0\0\0" + (t or "").encode() + b"\0"
        want.append((d, len(words(t)) + 1, sum(code_length(model, data[i - 3 : i], data[i]) for i in range(3, len(data)))))
    for rows in found:
        assert [r[:2] for r in rows] == [w[:2] for w in sorted(want)]
        assert [r[2] for r in rows] == pytest.approx([w[2] for w in sorted(want)], rel=1e-4)
