import random

from pyspark.sql import functions as F

from matchlane.llm import url_filter as uf

RULES = [uf.Rule("allow", "com", "/"), uf.Rule("block", "example.com", "/en/"), uf.Rule("allow", "www.example.com", "/en/")]


def test_cascade_is_exact_over_its_universe(spark):
    rng = random.Random(1)
    keys = [f"host{i}.example" for i in range(6000)]
    listed = set(rng.sample(keys, 500))
    table = spark.createDataFrame([(k, k in listed) for k in keys], "key string, listed boolean")
    cascade = uf.build_cascade(table)
    assert len(cascade.levels) > 1 and sum(len(x.data) for x in cascade.levels) < 100_000
    assert table.where(cascade.listed(F.col("key")) != F.col("listed")).count() == 0
    rows = table.select(F.col("key").alias("host"))
    joined = uf.is_listed(rows, F.col("host"), table, 0)
    assert {r.host for r in joined.where("listed").collect()} == listed


def test_long_lists_are_cut_into_shards(spark):
    keys = [""] + [f"host{i}.example" for i in range(15000)]
    listed = set(random.Random(2).sample(keys, 8000)) | {""}
    table = spark.createDataFrame([(k, k in listed) for k in keys], "key string, listed boolean")
    assert uf.cascade_bytes(8000, 7000) > 1.2 * (uf.PAGE_BITS // 8)
    hosts = [*keys, *keys[:100], None] + ["host1.example"] * 5000  # repeated rows, a null, and a hot key
    rows = spark.createDataFrame([(k, "x", 3) for k in hosts], "host string, row string, shard int")
    found = uf.is_listed(rows, F.col("host"), table, 1)
    assert found.columns == ["host", "row", "shard", "listed"]
    got = sorted((r.host or "", r.row, r.shard, r.listed) for r in found.collect())
    assert got == sorted((k or "", "x", 3, (k or "") in listed) for k in hosts)
    assert uf.is_listed(rows.limit(0), F.col("host"), table, 1).count() == 0


def test_all_or_none_listed(spark):
    for flag in (True, False):
        table = spark.createDataFrame([(f"k{i}", flag) for i in range(50)], "key string, listed boolean")
        assert table.where(uf.build_cascade(table).listed(F.col("key")) != F.col("listed")).count() == 0


def test_urls_rules_and_odd_rows(spark):
    urls = ["http://example.com/en/1", "https://WWW.Example.com/en/x?q", "http://a.example.com", "http://notexample.com/en/", "spam.org", None, "", "ftp://spam.org#x", "x://h?://y/z", "http://spam.org/en/\na"]
    pages = spark.createDataFrame([(i, u, "x", 1) for i, u in enumerate(urls)], "page_id long, url string, listed string, key int")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in uf.judge_urls(pages, RULES, F.col("key") == "spam.org").collect()}
    assert got[0] == ("example.com", "/en/1", "example.com/en/", "block")
    assert got[1] == ("www.example.com", "/en/x", "www.example.com/en/", "allow")
    assert got[2] == ("a.example.com", "", None, "allow")
    assert got[3] == ("notexample.com", "/en/", "com/", "allow")
    assert got[4] == got[5] == got[6] == ("", "", None, "allow")
    assert got[7] == ("spam.org", "", None, "block") and got[8] == ("h", "", None, "allow")
    assert got[9] == ("spam.org", "/en/\na", None, "block")
    assert uf.judge_urls(pages.limit(0), RULES, F.col("key") == "spam.org").count() == 0
