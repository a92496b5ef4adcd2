import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from matchlane.llm import token_counts
from tests.llm.support import documents

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = ["don't we'll 'S 12ab 3.4 'tis !'s ''s ", " <|endoftext|>a<|startoftext|> b<|END", "ﬁ ŉ İstanbul \u00a0 x\u0085 é e\u0301", "a" * 5000, "x'" * 300, "ab12" * 3000, "", " \n ", "naïve ÀÉ œuvre ß ²³ ª", "日本語 текст 😀"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def test_counts_equal_the_library(spark, library):
    rng = random.Random(2)
    letters = "etaoinshrdlucmfwypvbgkqjxz'é.-"
    texts = [" ".join("".join(rng.choices(letters, k=rng.randint(1, 14))) for _ in range(rng.randint(0, 60))) for _ in range(200)] + ODD
    rows = [*enumerate(texts), (900, None), (0, texts[0])]
    got = token_counts.count_tokens(documents(spark, rows), PATH, 40).collect()
    assert len(got) == len(rows)
    for r, (d, t) in zip(sorted(got, key=lambda r: r.doc_id), sorted(rows, key=lambda r: r[0]), strict=True):
        n = len(library.encode(t or "", add_special_tokens=False).ids)
        assert (r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) == (d, len((t or "").encode()), n, n > 40)
    assert token_counts.count_tokens(documents(spark, []), PATH).count() == 0


def test_chunk_maps_compose():
    transducer = token_counts.counter(PATH).transducer
    word = "internationalisation" * 5
    for cut in (1, 7, 50, 99):
        state, first = transducer.run(0, word[:cut])
        state, second = transducer.run(state, word[cut:-1])
        assert first + second + transducer.close(state, word[-1]) == transducer.count(word)
