"""Chat formatting: reply trees to paths, paths to one masked conversation each.

Messages (tree, node, parent, role, text, score) form trees. Ancestors are found by pointer
doubling: a self-join links each node to its 1st, 2nd, 4th, ... ancestor and adds up scores, so a
path of n messages takes log2(n) joins. Leaves are ranked by the mean score of their path; only the
chosen ones are followed back to the root.

Nulls: null roles and texts are empty, a null score is 0. A parent that is not in the tree makes a
root. Messages on a reply cycle have no root and belong to no path. Nodes must be unique within a
tree. Ties of branches go to the smaller leaf. An empty table gives an empty result.

The template is ``<|im_start|>role\\ntext<|im_end|>\\n`` per turn. Inside roles and texts ``~`` is
written ``~t`` and ``<|`` is written ``~l`` (line breaks of a role ``~n``), so a marker never occurs
inside a text and the output can be read back.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchlane.session import materialise

START, END = "<|im_start|>", "<|im_end|>"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("~"), F.lit("~t")), F.lit("<|"), F.lit("~l"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("~l"), F.lit("<|")), F.lit("~t"), F.lit("~"))


def ancestor_tables(messages: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """Stored tables i = 0, 1, ... of each node's 2**i-th ancestor ``up``, where it has one; and all roots' paths.

    ``far`` counts and ``total`` adds up the nodes from the node up to, without, ``up``; in the second
    result, up to the root. A node leaves the doubling once its path has reached the root.
    """
    score = F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score")
    nodes = messages.where(F.col("node").isNotNull()).select("tree", "node", "parent", score)
    known = nodes.selectExpr("tree AS _tree", "node AS up")
    linked = nodes.join(known, F.expr("tree <=> _tree and parent = up"), "left")
    links = materialise(linked.selectExpr("tree", "node", "up", "1L AS far", "score AS total"), "chat-links")
    n = links.count()
    steps, whole = [links.where("up is not null")], links.where("up is null")
    while 2 ** (len(steps) - 1) <= n and not steps[-1].isEmpty():
        above = steps[-1].unionByName(whole).selectExpr(
            "tree AS _tree", "node AS _node", "up AS _up", "far AS _far", "total AS _total"
        )
        doubled = materialise(
            steps[-1]
            .join(above, F.expr("tree <=> _tree and up = _node"))
            .selectExpr("tree", "node", "_up AS up", "far + _far AS far", "total + _total AS total"),
            "chat-links",
        )
        steps.append(doubled.where("up is not null"))
        whole = whole.unionByName(doubled.where("up is null"))
    return steps, whole


def root_paths(messages: DataFrame, best: int = 1) -> DataFrame:
    """tree, leaf, branch (rank from 1), node, depth (from 0) for the ``best`` branches of each tree.

    Takes (tree, node, parent, score). Joins are on (tree, node) and the ranking keeps ``best`` leaves
    of a tree before its shuffle, so a tree with many messages meets in no task.
    """
    steps, whole = ancestor_tables(messages)
    answered = messages.select(F.col("tree").alias("_tree"), F.col("parent").alias("_parent"))
    leaves = whole.join(answered, F.expr("tree <=> _tree and node = _parent"), "left_anti")
    order = Window.partitionBy("tree").orderBy((F.col("total") / F.col("far")).desc(), "node")
    chosen = leaves.withColumn("branch", F.row_number().over(order)).where(F.col("branch") <= best)
    paths = chosen.selectExpr("tree", "node AS leaf", "branch", "node", "far - 1 AS depth")
    for i in range(len(steps) - 1, -1, -1):
        paths = materialise(paths, "chat-paths")
        above = steps[i].selectExpr("tree AS _tree", "node AS _node", "up")
        higher = paths.join(above, F.expr("tree <=> _tree and node = _node")).selectExpr(
            "tree", "leaf", "branch", "up AS node", f"depth - {2**i}L AS depth"
        )
        paths = paths.unionByName(higher)
    return paths


def format_paths(messages: DataFrame, paths: DataFrame, trained: str = "assistant") -> DataFrame:
    """One row per path: tree, leaf, branch, n_turns, formatted, loss_spans.

    ``loss_spans`` are the (start, length) code points of the texts of role ``trained``.
    """
    texts = messages.select(
        F.col("tree").alias("_tree"),
        F.col("node").alias("_node"),
        F.replace(escape(F.coalesce("role", F.lit(""))), F.lit("\n"), F.lit("~n")).alias("_role"),
        escape(F.coalesce("text", F.lit(""))).alias("_text"),
        F.coalesce(F.col("role") == trained, F.lit(False)).alias("_trained"),
    )
    before = Window.partitionBy("tree", "leaf").orderBy("depth").rowsBetween(Window.unboundedPreceding, -1)
    head = F.concat(F.lit(START), "_role", F.lit("\n"))
    turns = paths.join(texts, F.expr("tree <=> _tree and node = _node")).withColumn(
        "_turn", F.concat(head, "_text", F.lit(END + "\n"))
    )
    turns = turns.withColumn("_at", F.coalesce(F.sum(F.length("_turn")).over(before), F.lit(0)) + F.length(head))
    span = F.when(F.col("_trained"), F.struct(F.col("_at").alias("start"), F.length("_text").cast("bigint").alias("length")))
    grouped = turns.groupBy("tree", "leaf", "branch").agg(
        F.sort_array(F.collect_list(F.struct("depth", "_turn", span.alias("_span")))).alias("_turns")
    )
    return grouped.select(
        "tree",
        "leaf",
        "branch",
        F.size("_turns").cast("bigint").alias("n_turns"),
        F.array_join(F.col("_turns._turn"), "").alias("formatted"),
        F.filter(F.col("_turns._span"), lambda s: s.isNotNull()).alias("loss_spans"),
    )


def read_turns(formatted: Column) -> Column:
    """The (role, text) turns of a formatted conversation, unescaped."""
    parts = F.split(formatted, "<\\|im_end\\|>\n")
    bodies = F.transform(F.slice(parts, 1, F.size(parts) - 1), lambda x: F.substring(x, len(START) + 1, F.length(x)))
    return F.transform(
        bodies,
        lambda x: F.struct(
            unescape(F.replace(F.substring_index(x, "\n", 1), F.lit("~n"), F.lit("\n"))).alias("role"),
            unescape(F.substring(x, F.instr(x, "\n") + 1, F.length(x))).alias("text"),
        ),
    )


def loss_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substring(formatted, s["start"] + 1, s["length"]))), "")


def chain(turns: DataFrame) -> DataFrame:
    """Messages of linear conversations (conv_id, turn, role, text): each turn answers the one before.

    Repeated turns keep all their rows, ordered by role and text.
    """
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    numbered = turns.select(F.col("conv_id").alias("tree"), "role", "text", F.row_number().over(order).cast("bigint").alias("node"))
    return numbered.select("tree", "node", (F.col("node") - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score"))
