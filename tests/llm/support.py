"""Small tables and brute-force versions for the tests of the training-data operators."""

import re

from pyspark.sql import DataFrame, SparkSession

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, row long, pii string"


def documents(spark: SparkSession, texts, lang=None) -> DataFrame:
    """Documents of (id, text), with columns whose names clash with working names."""
    rows = [(d, t, lang and lang(d), "src", None if t is None else len(t), 0.5, 7, "x") for d, t in texts]
    return spark.createDataFrame(rows, DOCS)


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", lower(text))


def shingles(text, k):
    w = words(text)
    return frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset()


def components(sets, num, den):
    """Smallest id reachable over pairs with Jaccard similarity num / den or more."""
    parent = {d: d for d in sets}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if sets[a] and sets[b] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
                x, y = top(a), top(b)
                parent[max(x, y)] = min(x, y)
    return {d: top(d) for d in ids}
