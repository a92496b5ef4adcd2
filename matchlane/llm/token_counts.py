"""Token counts by a compiled transducer of a word-level BPE.

The merges of one word, its last symbol marked as the word's end, form a deterministic transducer.
Reading a symbol moves it to a state (which last tokens are possible, and what each costs) and adds
the change in the number of tokens to the output. A state is compiled when it is first reached. The
state map of a whole word starts and ends in the start state, so the maps of a text's words compose
by addition: token counts are differences of a prefix sum. A word longer than a chunk is read chunk
by chunk, each chunk's map applied to the state before it.

The count is exact: a sequence of tokens is the merge result exactly if every adjacent pair of it is
(each pair is checked with the merges themselves). Texts with characters outside the plain Latin
ranges, where normalisation or character classes may differ between Unicode versions, are counted by
the tokenizer library.

Nulls: a null text is empty and has no tokens. Repeated documents are counted each. Other columns
are not read. Memory: states and word maps are dropped and compiled anew beyond a bound.
"""

import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

PLAIN = regex.compile(r"[^\t\n\r\x20-\x7e\xa1-\xac\xae-įı-ňŊ-ž‘’“”–—…]")
CHUNK = 256
MAX_STATES = 250_000
MAX_WORDS = 400_000


@lru_cache(maxsize=1)
def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: Latin-1's own, then those from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in own else chr(next(spare)) for b in range(256)]


class Transducer:
    """Counts the tokens of a pre-token, given as a string of byte symbols."""

    def __init__(self, merges: list[tuple[str, str]], end: str):
        self.end = end
        self.rank = {pair: i for i, pair in enumerate(merges)}
        tokens = {a + b for a, b in merges} | set(byte_symbols()) | {s + end for s in byte_symbols()}
        self.tokens = {t for t in tokens if self.merge(self.symbols(t)) == [t]}
        self.prefixes = {t[:i] for t in self.tokens for i in range(1, len(t) + 1)}
        self.pairs: dict[tuple[str, str], bool] = {}
        self.reset()

    def symbols(self, token: str) -> list[str]:
        """The symbols that a token is merged from; the end mark belongs to the last."""
        if token.endswith(self.end) and len(token) > len(self.end):
            body = token[: -len(self.end)]
            return [*body[:-1], body[-1] + self.end]
        return list(token)

    def merge(self, parts: list[str]) -> list[str]:
        """Applies merges by rank until none fits."""
        while len(parts) > 1:
            ranked = [(self.rank.get(p, len(self.rank)), i) for i, p in enumerate(zip(parts, parts[1:], strict=False))]
            best, at = min(ranked)
            if best == len(self.rank):
                return parts
            pair, out, i = (parts[at], parts[at + 1]), [], 0
            while i < len(parts):
                if i + 1 < len(parts) and (parts[i], parts[i + 1]) == pair:
                    out.append(parts[i] + parts[i + 1])
                    i += 2
                else:
                    out.append(parts[i])
                    i += 1
            parts = out
        return parts

    def adjacent(self, left: str, right: str) -> bool:
        """Whether ``right`` can follow ``left`` in a merge result."""
        if not left:
            return True
        found = self.pairs.get((left, right))
        if found is None:
            found = self.pairs[left, right] = self.merge([*self.symbols(left), *self.symbols(right)]) == [left, right]
        return found

    def reset(self) -> None:
        # A state: (open text, last token before it, its token count relative to now), longest first.
        self.keys: list[tuple] = [(("", "", 0),)]
        self.ids: dict[tuple, int] = {self.keys[0]: 0}
        self.steps: list[dict[str, tuple[int, int]]] = [{}]
        self.closing: list[dict[str, int]] = [{}]
        self.words: dict[str, int] = {}

    def last(self, state: int, symbol: str) -> tuple[str, int]:
        """Last token after ``symbol``, and the token count up to it, relative to the state's."""
        for text, before, count in self.keys[state]:
            token = text + symbol
            if token in self.tokens and self.adjacent(before, token):
                return token, count + 1
        raise ValueError(f"no token ends with {symbol!r}")

    def step(self, state: int, symbol: str) -> tuple[int, int]:
        """Next state and emitted count of a symbol inside a word."""
        token, count = self.last(state, symbol)
        kept = [(t + symbol, b, c - count) for t, b, c in self.keys[state] if t + symbol in self.prefixes]
        key = (*kept, ("", token, 0))
        target = self.ids.get(key)
        if target is None:
            target = self.ids[key] = len(self.keys)
            self.keys.append(key)
            self.steps.append({})
            self.closing.append({})
        found = self.steps[state][symbol] = (target, count)
        return found

    def run(self, state: int, chunk: str) -> tuple[int, int]:
        """The chunk's state map at ``state``: the state after it and the tokens it adds."""
        steps, added = self.steps, 0
        for symbol in chunk:
            found = steps[state].get(symbol) or self.step(state, symbol)
            state = found[0]
            added += found[1]
        return state, added

    def close(self, state: int, symbol: str) -> int:
        """Tokens added by the word's last symbol; the next state is the start."""
        found = self.closing[state].get(symbol)
        if found is None:
            found = self.closing[state][symbol] = self.last(state, symbol + self.end)[1]
        return found

    def count(self, word: str) -> int:
        if len(self.keys) > MAX_STATES:
            self.reset()
        state, total = 0, 0
        for at in range(0, len(word) - 1, CHUNK):
            state, added = self.run(state, word[at : min(at + CHUNK, len(word) - 1)])
            total += added
        return total + self.close(state, word[-1])


class Counter:
    """Token counts of texts for one tokenizer file."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        pattern, end = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"], spec["model"]["end_of_word_suffix"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        self.library = Tokenizer.from_file(path)
        self.special = regex.compile("|".join(regex.escape(t["content"]) for t in spec["added_tokens"]))
        self.pattern = regex.compile(pattern)
        self.transducer = Transducer(merges, end)
        self.symbols = byte_symbols()

    def word(self, word: str) -> int:
        """Tokens of a word without white space; the sum over its pre-tokens."""
        words = self.transducer.words
        if len(words) >= MAX_WORDS:
            words.clear()
        lower, total = word.lower(), 0
        if lower.isalpha():
            parts = [lower]
        elif lower[:-1].isalpha() and lower[-1] in ",.;:!?":
            parts = [lower[:-1], lower[-1]]
        else:
            parts = self.pattern.findall(lower)
        for part in parts:
            encoded = part if part.isascii() else "".join([self.symbols[b] for b in part.encode()])
            total += self.transducer.count(encoded)
        if len(word) <= CHUNK:
            self.transducer.words[word] = total
        return total

    def texts(self, texts: list[str]) -> np.ndarray:
        """Token counts: differences of the prefix sum over the words' counts."""
        counts, ends, extra = [], [0], []
        for text in texts:
            special = 0
            if PLAIN.search(text):
                special = len(self.library.encode(text, add_special_tokens=False).ids)
                text = ""
            elif "<|" in text:
                special = len(self.special.findall(text))
                text = self.special.sub(" ", text)
            split = text.split()
            known = self.transducer.words.get
            counts += [n if (n := known(w)) is not None else self.word(w) for w in split]
            ends.append(len(counts))
            extra.append(special)
        total = np.concatenate([[0], np.cumsum(np.asarray(counts, np.int64))])
        return np.diff(total[ends]) + np.asarray(extra, np.int64)


@lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    """One per Python worker: compiled states and words serve all its tasks."""
    return Counter(path)


def count_tokens(docs: DataFrame, path: str, limit: int = 2048) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every document.

    ``path``: a tokenizers file of a lower-casing BPE with word ends, readable on all executors.
    """

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            texts = part.column("text").fill_null("").to_pylist()
            n = counter(path).texts(texts)
            sizes = np.fromiter((len(t) if t.isascii() else len(t.encode()) for t in texts), np.int64, len(texts))
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(sizes), pa.array(n), pa.array(n > limit)],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    kind = dict(docs.dtypes)["doc_id"]
    schema = f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean"
    return docs.select("doc_id", "text").mapInArrow(batches, schema)
