import random

import numpy as np

from matchlane.llm import decontaminate
from tests.llm.support import documents


def smith_waterman(a, b):
    best, rows = 0, [[0] * (len(b) + 1)]
    for x in a:
        row = [0]
        for j, y in enumerate(b):
            row.append(max(0, rows[-1][j] + (2 if x == y else -1), rows[-1][j + 1] - 1, row[j] - 1))
        rows.append(row)
        best = max(best, *row)
    return best / (2 * len(a))


def test_alignment_against_the_full_table():
    rng = random.Random(1)
    for _ in range(60):
        a, b = ([rng.randrange(5) for _ in range(rng.randint(1, 15))] for _ in range(2))
        assert decontaminate.alignment(np.array(a, np.uint64), np.array(b, np.uint64)) == smith_waterman(a, b)


def test_copies_edits_and_clean_texts(spark):
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(400)]
    make = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [make(30) for _ in range(20)]
    texts, leaks = [], set()
    for i in range(300):
        body = make(120)
        if i % 3 == 0:
            item = list(items[i // 3 % 20])
            for _ in range(i % 5):
                item[rng.randrange(30)] = "edited"
            if i % 2:
                del item[rng.randrange(30)]
            body[40:40] = item
            leaks.add((i, i // 3 % 20))
        texts.append((i, ", ".join(body).upper() if i % 7 == 0 else " ".join(body)))
    texts += [(400, None), (401, ""), (402, " ".join(make(60000))), (0, texts[0][1])]
    benchmark = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)] + [(50, None), (51, "two words"), (52, "")], "item_id long, text string")
    docs = documents(spark, texts)
    got = decontaminate.contaminated(docs, benchmark).collect()
    assert {(r.doc_id, r.item_id) for r in got} == leaks and all(0.5 <= r.score <= 1 for r in got)
    clean = decontaminate.keep_clean(docs, benchmark)
    assert clean.columns == docs.columns
    assert sorted(r.doc_id for r in clean.collect()) == sorted({d for d, _ in texts} - {d for d, _ in leaks})
    assert decontaminate.contaminated(docs, benchmark.limit(0)).count() == 0
    assert decontaminate.keep_clean(documents(spark, []), benchmark).count() == 0


def test_a_passage_that_all_documents_share_is_found(spark):
    passage = "one two three four five six seven eight nine ten"
    docs = documents(spark, [(i, f"a{i} b{i} {passage} c{i}") for i in range(100)])
    benchmark = spark.createDataFrame([(1, passage), (2, "none of these words is there at all")], "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, benchmark).collect()} == {(i, 1) for i in range(100)}


def test_blocks_give_the_same(spark, monkeypatch):
    items = spark.createDataFrame([(i, f"x{i} y{i} z{i} u{i} v{i}") for i in range(40)], "item_id long, text string")
    docs = documents(spark, [(i, f"p q x{i} y{i} z{i} u{i} v{i} r") for i in range(40)])
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 200)
    assert {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, items).collect()} == {(i, i) for i in range(40)}
    assert decontaminate.keep_clean(docs, items).count() == 0
