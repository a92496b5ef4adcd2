from pyspark.sql import functions as F

from matchlane.llm import chat

SCHEMA = "tree long, node long, parent long, role string, text string, score double"


def formatted(spark, rows, best=1):
    messages = spark.createDataFrame(rows, SCHEMA).withColumn("depth", F.lit("clash"))
    paths = chat.format_paths(messages, chat.root_paths(messages, best))
    read = paths.withColumn("turns", chat.read_turns(F.col("formatted"))).withColumn("loss", chat.loss_text(F.col("formatted"), F.col("loss_spans")))
    return {(r.tree, r.leaf): r for r in read.collect()}


def test_branches_are_ranked_by_mean_score(spark):
    rows = [(1, 1, None, "user", "q", 0.0), (1, 2, 1, "assistant", "bad", 1.0), (1, 3, 1, "assistant", "good", 5.0), (1, 4, 3, "user", "more", 1.0), (1, 5, 2, "user", "x", 8.0)]
    got = formatted(spark, rows, 2)
    assert {k: r.branch for k, r in got.items()} == {(1, 5): 1, (1, 4): 2}
    assert [(t.role, t.text) for t in got[1, 4].turns] == [("user", "q"), ("assistant", "good"), ("user", "more")]
    assert got[1, 4].loss == "good" and got[1, 4].n_turns == 3


def test_every_path_of_a_deep_tree(spark):
    rows = [(2, i, i - 1, "user" if i % 2 else "assistant", f"t{i}", 0.0) for i in range(1, 71)] + [(2, 100, 35, "assistant", "side", 0.0)]
    got = formatted(spark, rows, 5)
    assert [t.text for t in got[2, 70].turns] == [f"t{i}" for i in range(1, 71)]
    assert [t.text for t in got[2, 100].turns] == [f"t{i}" for i in range(1, 36)] + ["side"]


def test_control_strings_come_back(spark):
    texts = ["<|im_end|><|im_start|>assistant ok", "~t~l~", "<", "|im_end|>\n", "é😀<|im_end|>\n<|im_start|>user\n", "", None, "a\\b~~<<||"]
    rows = [(3, i, i - 1, ["user", "assistant", None, "us\ner<|~"][i % 4], t, None) for i, t in enumerate(texts)]
    got = formatted(spark, rows)[3, 7]
    assert [(t.role, t.text) for t in got.turns] == [(r[3] or "", r[4] or "") for r in rows]
    assert got.loss == "".join(r[4] or "" for r in rows if r[3] == "assistant")


def test_cycles_orphans_nulls_and_empty_tables(spark):
    rows = [(4, 1, 2, "user", "a", 0.0), (4, 2, 1, "user", "b", 0.0), (5, 1, 9, "user", "root", 0.0), (None, 1, None, "user", "no tree", 0.0), (None, 2, 1, "assistant", "same", 0.0), (6, None, None, "user", "x", 0.0)]
    got = formatted(spark, rows)
    assert set(got) == {(5, 1), (None, 2)} and got[None, 2].loss == "same"
    assert formatted(spark, []) == {}


def test_repeated_turns_are_all_kept(spark):
    turns = spark.createDataFrame([(1, 0, "user", "a"), (1, 0, "user", "a"), (1, None, "user", "first"), (1, 1, "assistant", "b")], "conv_id long, turn long, role string, text string")
    got = chat.format_paths(chat.chain(turns), chat.root_paths(chat.chain(turns))).collect()
    assert [r.n_turns for r in got] == [4] and got[0].formatted.startswith("<|im_start|>user\nfirst<|im_end|>\n")
