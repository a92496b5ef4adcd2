import random

from pyspark.sql import functions as F

from matchlane.llm import langid
from tests.llm.support import documents

SYLLABLES = {"en": "th er on an re he in ed nd ha", "de": "en er ch ei ie ge st be sch ung", "fr": "es le en re ou ai eau on ent la", "es": "os as ar do ci el ue que la ra", "xx": "ka ki ku ko ke ma mi mu mo me"}


def texts(n, seed):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        language = list(SYLLABLES)[i % 5]
        parts = SYLLABLES[language].split()
        out.append((i, " ".join("".join(rng.choices(parts, k=rng.randint(1, 4))) for _ in range(rng.randint(3, 60))), language))
    return out


def test_held_out_accuracy_and_rejected_texts(spark):
    rows = texts(600, 1)
    names = {d: x for d, _, x in rows}
    odd = [(1000, None), (1001, ""), (1002, "12 %% 34"), (1003, "the " * 60000)]
    docs = documents(spark, [(d, t) for d, t, _ in rows] + odd, names.get)
    held = F.col("doc_id") % 3 == 1
    got = langid.predict(docs, langid.learn(docs, ~held), ["doc_id"]).collect()
    assert len(got) == 604 and all(0 <= r.score <= 1 for r in got)
    right = [r.lang_pred == names[r.doc_id] for r in got if r.doc_id % 3 == 1 and r.doc_id < 600]
    assert sum(right) / len(right) >= 0.97
    assert {r.doc_id for r in got if r.lang_pred == "und"} == {1000, 1001, 1002}
    kept = langid.keep_known(docs)
    assert kept.columns == docs.columns and kept.count() == 601


def test_nothing_to_learn(spark):
    docs = documents(spark, [(1, "some words"), (2, None)])
    assert [r.lang_pred for r in langid.predict(docs, langid.learn(docs, F.lit(True)), ["doc_id"]).collect()] == ["und", "und"]
    one = documents(spark, [(i, "some words here") for i in range(9)], lambda d: "en")
    assert {r.lang_pred for r in langid.predict(one, langid.learn(one, F.lit(True)), ["doc_id"]).collect()} == {"en"}
    assert langid.keep_known(documents(spark, [])).count() == 0


def test_unsure_languages_are_kept(spark):
    """More than two families, and three languages in one: low scores of clean texts."""
    names = ["en", "de", "nl", "fr", "es", "xx", "yy"]
    parts = {**SYLLABLES, "nl": "ij aa oe ee van het een uit", "yy": "zo zu za wo wu wa"}
    rng = random.Random(2)
    rows = [(i, " ".join("".join(rng.choices(parts[names[i % 7]].split(), k=3)) for _ in range(20))) for i in range(210)]
    mixed = [(1000 + i, " ".join("".join(rng.choices(parts[x].split(), k=2)) for x in names for _ in range(3))) for i in range(30)]
    docs = documents(spark, [*rows, *mixed, (2000, "12 %%")], lambda d: names[d % 7] if d < 1000 else None)
    scores = langid.predict(docs, langid.learn(docs, F.lit(True)), ["doc_id"]).collect()
    assert any(r.score < 0.5 for r in scores if r.doc_id < 2000)
    assert sorted(r.doc_id for r in langid.keep_known(docs).collect()) == [d for d, _ in [*rows, *mixed]]
