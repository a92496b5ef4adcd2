"""Cost-balanced packing of documents into sequences of at most ``length`` tokens.

A document costs ``linear * n + quadratic * n**2`` (attention). Whole stretches of ``length`` tokens
become sequences of their own. The rest of each document, in descending cost, goes to the sequence
of the lowest cost that has room for it; what fits nowhere is cut to fill the rooms left. Only the
last, incomplete sequence of a block would need padding: it is split into sequences whose sizes are
powers of two, so nothing is padded.

Documents are packed in blocks of bounded size where they are read: no shuffle, and a lost task
packs the same blocks again, under the same sequence ids (partition number and position).

Nulls: a null text is empty; its document is the end token alone. Repeated documents are packed each.
A document longer than a block is a block of its own. Other columns are not read.
"""

import base64
import heapq
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame

BLOCK_TOKENS = 1 << 20
# Characters on which all Unicode versions agree; other texts go to the reference library.
PLAIN = regex.compile(r"[^\t\n\r\x20-\x7e\xa1-ſ‘’“”–—…]")

Piece = tuple[int, int, int, int, int]  # document, start, length, sequence, offset


class Encoder:
    """Token ids as the ``tokenizers`` library gives them for ``path``.

    With ``ranks``, the same vocabulary as a rank file, plain texts take the faster path of tiktoken.
    """

    def __init__(self, path: str, ranks: str | None = None, pattern: str | None = None):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.fast = None
        if ranks and pattern:
            import tiktoken

            with open(ranks, "rb") as file:
                merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
            self.fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=merges, special_tokens={})

    def ids(self, text: str) -> np.ndarray:
        if self.fast is None or "<|" in text or PLAIN.search(text):
            return np.asarray(self.library.encode(text, add_special_tokens=False).ids, np.uint32)
        return self.fast.encode_to_numpy(text)


@lru_cache(maxsize=2)
def encoder(path: str, ranks: str | None, pattern: str | None) -> Encoder:
    return Encoder(path, ranks, pattern)


def pack_block(sizes: list[int], length: int, linear: float, quadratic: float) -> list[Piece]:
    """Pieces of documents of these sizes; sequences are numbered from 0, in whole."""
    pieces: list[Piece] = []
    tails, sequence = [], 0
    for doc, n in enumerate(sizes):
        for start in range(0, n - n % length, length):
            pieces.append((doc, start, length, sequence, 0))
            sequence += 1
        if n % length:
            tails.append((doc, n - n % length, n % length))
    tails.sort(key=lambda t: (-t[2], t[0]))
    full, rest = divmod(sum(t[2] for t in tails), length)
    rooms = [length] * full + [1 << b for b in range(length.bit_length() - 1, -1, -1) if rest >> b & 1]
    used = [0] * len(rooms)
    # Sequences by cost; one without room for this document has none for a later one only if that is
    # as long, so those passed over wait by their room.
    heap = [(0.0, i) for i in range(len(rooms))]
    heapq.heapify(heap)
    waiting: list[tuple[int, float, int]] = []
    cut = []
    for doc, start, n in tails:
        while waiting and -waiting[0][0] >= n:
            _, cost, i = heapq.heappop(waiting)
            heapq.heappush(heap, (cost, i))
        placed = False
        while heap:
            cost, i = heapq.heappop(heap)
            if rooms[i] - used[i] >= n:
                pieces.append((doc, start, n, sequence + i, used[i]))
                used[i] += n
                if used[i] < rooms[i]:
                    heapq.heappush(heap, (cost + linear * n + quadratic * n * n, i))
                placed = True
                break
            heapq.heappush(waiting, (-(rooms[i] - used[i]), cost, i))
        if not placed:
            cut.append((doc, start, n))
    free = (i for i in range(len(rooms)) if used[i] < rooms[i])
    i = next(free, None)
    for doc, start, n in cut:
        while n:
            take = min(n, rooms[i] - used[i])
            pieces.append((doc, start, take, sequence + i, used[i]))
            used[i] += take
            start, n = start + take, n - take
            if used[i] == rooms[i]:
                i = next(free, None)
    return pieces


def pack(
    docs: DataFrame,
    path: str,
    ranks: str | None = None,
    pattern: str | None = None,
    end_id: int = 1,
    length: int = 2048,
    linear: float = 1.0,
    quadratic: float = 1 / 4096,
    block_tokens: int = BLOCK_TOKENS,
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    ``linear`` and ``quadratic`` weigh a document's tokens and their square. The tokenizer files must
    be readable on all executors.
    """

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode: Callable[[str], np.ndarray] = encoder(path, ranks, pattern).ids
        base, names, ids, held = TaskContext.get().partitionId() << 33, [], [], 0

        def packed() -> Iterator[pa.RecordBatch]:
            nonlocal base, names, ids, held
            pieces = pack_block([len(x) for x in ids], length, linear, quadratic)
            pieces.sort()
            crc = [zlib.crc32(ids[d][s : s + n].tobytes()) for d, s, n, _, _ in pieces]
            column = lambda i: np.array([p[i] for p in pieces], np.int64)
            docs_of, sizes = column(0), np.array([len(x) for x in ids], np.int64)
            keys = pa.array([names[d] for d in docs_of], id_type)
            yield pa.RecordBatch.from_arrays(
                [keys, *map(pa.array, (column(1), column(2), np.array(crc, np.int64), sizes[docs_of], column(3) + base, column(4)))],
                names=columns,
            )
            base += int(column(3).max()) + 1
            names, ids, held = [], [], 0

        id_type = None
        for part in parts:
            id_type = part.schema.field("doc_id").type
            for name, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True):
                found = np.append(encode(text or ""), np.uint32(end_id)).astype("<u4")
                if held and held + len(found) > block_tokens:
                    yield from packed()
                names.append(name)
                ids.append(found)
                held += len(found)
        if ids:
            yield from packed()

    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    schema = f"doc_id {dict(docs.dtypes)['doc_id']}, " + ", ".join(f"{c} long" for c in columns[1:])
    return docs.select("doc_id", "text").mapInArrow(batches, schema)
