import re
from collections import defaultdict

import corpus_pipeline
from matchlane.llm import queries
from matchlane.llm.support import table
from matchlane.session import materialise
from tests.llm.support import components, shingles
from tests.llm.test_pii import PATTERNS, base

SF = "/root/testdata/sf0.001"


def spelled(text):
    return re.findall("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", text.lower())


def test_stages_against_brute_force(spark):
    docs = table(spark, SF, "documents")
    rows = {r.doc_id: r.text for r in docs.collect()}
    items = [spelled(r.text) for r in table(spark, SF, "benchmark").collect()]
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        docs = materialise(stage(spark, docs, SF), f"test-{name}")
        seen.append(docs)
    language, unique, clean, private, packed = seen
    letters = {d for d, t in rows.items() if t and re.search(r"[^\W\d_]", t)}
    assert {r.doc_id for r in language.collect()} == letters
    top = components({d: shingles(rows[d], 5) for d in letters}, 80, 100)
    assert {r.doc_id for r in unique.collect()} == set(top.values())
    held = lambda t: any(" ".join(i) in " ".join(spelled(t)) for i in items)
    left = {r.doc_id for r in clean.collect()}
    assert left <= {d for d in set(top.values()) if not held(rows[d])} and len(left) >= 0.98 * len(set(top.values()))
    masked = {r.doc_id: r.text for r in private.collect()}
    assert set(masked) == left and private.columns == table(spark, SF, "documents").columns
    for d, text in masked.items():
        if not base(rows[d]):
            assert text == rows[d] or "[" in text
        assert not re.search(PATTERNS["email"], text)
    pieces = packed.collect()
    sizes, total = defaultdict(int), {}
    for p in pieces:
        sizes[p.doc_id] += p.length
        total[p.doc_id] = p.doc_tokens
    assert dict(sizes) == total and set(total) == left


def test_registered_queries_read_their_tables(spark):
    assert sum(re.match(r"op\d+_", name) is not None for name in queries.QUERIES) == 10
    assert set(queries.SQL) <= set(queries.QUERIES)
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language", "near_duplicates", "decontaminate", "personal_data", "packing"]
