import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from matchlane.llm import packing
from matchlane.llm.queries import pack_documents
from tests.llm.support import documents

LIBRARY = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def check_sequences(pieces, length):
    """Pieces (sequence, offset, length) fill sequences without gaps, up to the length or a power of two."""
    by = defaultdict(list)
    for sequence, offset, n in pieces:
        by[sequence].append((offset, n))
    for parts in by.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at and n > 0
            at += n
        assert at <= length and at & (at - 1) == 0


def test_blocks_lose_nothing_and_pad_nothing():
    for seed in range(100):
        rng = random.Random(seed)
        length = rng.choice([8, 64, 2048])
        sizes = [rng.choice([1, 2, rng.randint(1, 3 * length), rng.randint(1, length)]) for _ in range(rng.randint(1, 60))]
        pieces = packing.pack_block(sizes, length, 1.0, 1 / 4096)
        check_sequences([(q, o, n) for _, _, n, q, o in pieces], length)
        for doc, size in enumerate(sizes):
            at = 0
            for _, start, n, _, _ in sorted(p for p in pieces if p[0] == doc):
                assert start == at
                at += n
            assert at == size


def test_costs_are_balanced():
    rng = random.Random(1)
    sizes = [rng.randint(1, 1500) for _ in range(2000)]
    cost = defaultdict(float)
    for _, _, n, q, _ in packing.pack_block(sizes, 2048, 1.0, 1 / 4096):
        cost[q] += n + n * n / 4096
    whole = sorted(cost.values())[12:]
    assert max(whole) / (sum(whole) / len(whole)) < 1.25


def test_ids_are_those_of_the_library(spark):
    texts = [(0, "hello world, it's 12:30"), (1, None), (2, ""), (3, "<|endoftext|> x"), (4, "日本語 \u0085\u00a0 é"), (5, "word " * 4000), (6, "  \n\n a  b"), (6, "  \n\n a  b")]
    got = pack_documents(documents(spark, texts)).collect()
    check_sequences([(r.sequence_id, r.offset, r.length) for r in got], 2048)
    ids = {d: np.array([*LIBRARY.encode(t or "", add_special_tokens=False).ids, 1], "<u4") for d, t in texts}
    for r in got:
        assert r.doc_tokens == len(ids[r.doc_id])
        assert r.ids_crc32 == zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes())
    for d, n in [(d, 1 + (d == 6)) for d in ids]:
        assert sum(r.length for r in got if r.doc_id == d) == n * len(ids[d])
    assert pack_documents(documents(spark, [])).count() == 0
