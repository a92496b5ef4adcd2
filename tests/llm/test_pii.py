import random
import re

from matchlane.llm import pii
from tests.llm.support import documents

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
PARTS = ["a@b.c-d@e.f", "a@b.c_d@e.f", "x@y", "1.2.3.4.5.6.7.8", "256.1.1.1", "001.002.003.004", "4111 1111 1111 1111", "4111111111111112", "+1 (017) 555-7713", "+49 30 1234567 89", "é😀", "user%x+y@sub.ex-a.org.", "12", "call 212-555-1212", "name [at] site [dot] com", "9" * 30, "(at)", "\n", "@x.y", "a.b@c..d", "Version 1.2.3.4"]


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = int(c) * (1 + i % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def valid(kind, found):
    digits = re.sub("[^0-9]", "", found)
    if kind == "ip":
        return all(int(p) <= 255 for p in found.split("."))
    if kind == "card":
        return 14 <= len(digits) <= 19 and luhn(digits)
    return kind != "phone" or 10 <= len(digits) <= 15


def base(text):
    found = [(m.start(), i, m.end()) for i, (k, p) in enumerate(PATTERNS.items()) for m in re.finditer(p, text or "") if valid(k, m.group())]
    return sorted(found)


def test_base_spans_against_brute_force(spark):
    rng = random.Random(4)
    texts = [(i, "".join(rng.choice(PARTS) + rng.choice([" ", "", ", "]) for _ in range(rng.randint(0, 25)))) for i in range(250)]
    texts += [(300, None), (301, ""), (302, "a" * 100000), (303, "1" * 50000), (304, "a@b" + ".c" * 30000), (305, "x@y.z " * 3000), (306, "+1" * 20000), (306, "+1" * 20000)]
    docs = documents(spark, texts)
    model = pii.learn(docs)
    got = pii.personal_spans(docs, model).select("doc_id", "text", "pii").collect()
    assert len(got) == len(texts)
    for row in got:
        assert [(s.start, s.kind, s.end) for s in row.pii if s.base] == base(row.text)
        for s in row.pii:
            assert s.base or not any(k == s.kind and a < s.end and s.start < e for a, k, e in base(row.text))
    for row in pii.without_personal_data(docs).collect():
        assert row.text is None or (row.n_chars == len(row.text) and not re.search(PATTERNS["email"], row.text))


def test_labelers_learn_who_is_right():
    table = [(0, "11122", 90), (0, "12122", 10), (2, "11112", 50), (2, "10022", 200), (3, "10002", 30), (3, "11112", 80)]
    share, model = pii.estimate(table)
    assert [round(p) for p in share] == [1, 1, 1, 0, 0, 1]
    assert model[1][0][0] > 0.9 > 0.1 > model[1][0][1]
    trained = pii.train(table)
    score = lambda kind, votes: trained.bias[kind] + sum(trained.weights[i][int(v)] for i, v in enumerate(votes))
    assert score(0, "11122") > 0 > score(2, "10022")


def test_nothing_found_and_empty_table(spark):
    docs = documents(spark, [(1, "plain words"), (2, None)])
    model = pii.learn(docs)
    assert [list(r.pii) for r in pii.personal_spans(docs, model).collect()] == [[], []]
    assert [r.text for r in pii.without_personal_data(docs).orderBy("doc_id").collect()] == ["plain words", None]
    empty = documents(spark, [])
    assert pii.personal_spans(empty, pii.learn(empty)).count() == 0
