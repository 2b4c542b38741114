"""Chat formatting: root-to-leaf paths of reply trees, ranked by score, each one conversation text.

Nodes are (tree_id, node_id, parent_id, role, text, score); a root has a null parent. Paths come
from self-joins that double the distance to an ancestor, so a tree of depth d takes log2(d) rounds,
and the rows grow with the paths' lengths alone.

The template is ``<|im_start|>role\\ntext<|im_end|>\\n`` for each turn. In a role or text a backslash
is doubled and a control string gets a backslash after its first character, so that no text
contains one and the reading back is exact. In a role a line feed is written ``\\n``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyrack.llm.common import written

START, END = "<|im_start|>", "<|im_end|>"
#: Strings that chat templates treat as control: fixed values.
CONTROL = (
    "<|im_start|>", "<|im_end|>", "<|endoftext|>", "<|system|>", "<|user|>", "<|assistant|>", "<s>", "</s>", "<unk>", "<pad>",
    "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<start_of_turn>", "<end_of_turn>", "<|start_header_id|>", "<|end_header_id|>",
    "<|eot_id|>", "<|begin_of_text|>", "<|end_of_text|>",
)
ASSISTANT = "assistant"
#: Keep this many branches of each tree; none: all.
BRANCHES: int | None = None


def escaped(text: Column) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for word in CONTROL:
        out = F.replace(out, F.lit(word), F.lit(word[0] + "\\" + word[1:]))
    return out


def unescaped(text: Column) -> Column:
    """Doubled backslashes become one, from the left; a single one is a mark and goes."""
    pieces = F.split(text, r"\\\\", -1)
    plain = F.transform(pieces, lambda p: F.replace(F.replace(p, F.lit("\\n"), F.lit("\n")), F.lit("\\"), F.lit("")))
    return F.array_join(plain, "\\")


def paths(nodes: DataFrame) -> DataFrame:
    """(leaf, node, up, top): every node on the path of every leaf, ``up`` steps above it; ``top`` is the path's length - 1.

    ``nodes`` has distinct keys (node, parent). A node whose parent isn't there is a root. A loop
    of parents has no leaf and no root, so it gives no path.
    """
    known = nodes.select("node")
    links = nodes.select("node", "parent").join(known.select(F.col("node").alias("parent")), "parent", "left_semi").select("node", "parent")
    jumps = written(links)
    leaves = nodes.select("node").join(jumps.select(F.col("parent").alias("node")), "node", "left_anti")
    reached = written(leaves.select(F.col("node").alias("leaf"), "node", F.lit(0).cast("bigint").alias("up")))
    step = 1
    while not jumps.isEmpty() and not reached.isEmpty():
        further = reached.join(jumps, "node").select("leaf", F.col("parent").alias("node"), (F.col("up") + step).alias("up"))
        grown = written(reached.unionByName(further))
        if step > 1 and grown.count() == reached.count():
            break
        far = jumps.select(F.col("node").alias("n"), F.col("parent").alias("node"))
        jumps = written(far.join(jumps, "node").select(F.col("n").alias("node"), "parent"))
        reached, step = grown, step * 2
    top = reached.groupBy("leaf").agg(F.max("up").alias("top"))
    return reached.join(top, "leaf")


def conversations(nodes: DataFrame, branches: int | None = BRANCHES) -> DataFrame:
    """(tree_id, leaf, branch, score, turns): chosen paths of each tree, turns = array of (role, text) from the root.

    A path's score is the mean of its nodes' scores (null: 0); branches are ranked by it, ties by
    the smaller leaf. Null roles and texts count as empty.
    """
    nodes = written(nodes)
    steps = paths(nodes.select(F.col("node_id").alias("node"), F.col("parent_id").alias("parent")))
    facts = nodes.select(F.col("node_id").alias("node"), "tree_id", "role", "text", "score")
    turn = F.struct(
        (F.col("top") - F.col("up")).alias("at"),
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
        "tree_id",
    )
    whole = steps.join(facts, "node").groupBy("leaf").agg(F.array_sort(F.collect_list(turn)).alias("all"))
    mean = F.aggregate("all", F.lit(0.0), lambda a, t: a + t["score"]) / F.size("all")
    out = whole.select(
        F.col("all")[0]["tree_id"].alias("tree_id"), "leaf", mean.alias("score"),
        F.transform("all", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"),
    )
    if branches is None:
        return out.withColumn("branch", F.lit(None).cast("int"))
    rank = Window.partitionBy("tree_id").orderBy(F.desc("score"), "leaf")
    return out.withColumn("branch", F.row_number().over(rank)).filter(F.col("branch") <= branches)


def formatted(chosen: DataFrame) -> DataFrame:
    """Adds ``formatted``, the conversation's text, and ``loss_spans``: (start, end) code points of each assistant text in it."""

    def one(turn: Column) -> Column:
        role = F.replace(escaped(turn["role"]), F.lit("\n"), F.lit("\\n"))
        return F.struct(F.concat(F.lit(START), role, F.lit("\n")).alias("head"), escaped(turn["text"]).alias("body"), (turn["role"] == ASSISTANT).alias("own"))

    rows = chosen.withColumn("_parts", F.transform("turns", one))
    tail = END + "\n"
    text = F.array_join(F.transform("_parts", lambda p: F.concat(p["head"], p["body"], F.lit(tail))), "")

    def step(acc: Column, p: Column) -> Column:
        start = acc["at"] + F.length(p["head"])
        end = start + F.length(p["body"])
        span = F.array(F.struct(start.alias("start"), end.alias("end")))
        spans = F.when(p["own"], F.concat(acc["spans"], span)).otherwise(acc["spans"])
        return F.struct((end + len(tail)).alias("at"), spans.alias("spans"))

    first = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<struct<start:int,end:int>>)").alias("spans"))
    return rows.withColumn("formatted", text).withColumn("loss_spans", F.aggregate("_parts", first, step, lambda a: a["spans"])).drop("_parts")


def read_back(text: Column) -> Column:
    """The turns of a formatted conversation: array of (role, text)."""
    pieces = F.split(text, r"<\|im_end\|>\n", -1)
    bodies = F.transform(F.slice(pieces, 1, F.size(pieces) - 1), lambda p: F.substring(p, F.lit(len(START) + 1), F.length(p)))

    def turn(body: Column) -> Column:
        role = F.substring_index(body, "\n", 1)
        return F.struct(unescaped(role).alias("role"), unescaped(F.substring(body, F.length(role) + 2, F.length(body))).alias("text"))

    return F.transform(bodies, turn)


def loss_texts(text: Column, spans: Column) -> Column:
    """The texts under the loss mask, unescaped."""
    return F.transform(spans, lambda s: unescaped(F.substring(text, s["start"] + 1, s["end"] - s["start"])))


def chains(rows: DataFrame) -> DataFrame:
    """Nodes from conversations by turn: each row replies to the one before it.

    Rows of one conversation go by turn, ties by role and text; a conversation becomes one text,
    so its rows fit in one task. A null conv_id is a conversation too.
    """
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    at = rows.select("conv_id", "turn", "role", "text").withColumn("_at", F.row_number().over(order))
    node = F.struct("conv_id", F.col("_at").alias("at"))
    parent = F.when(F.col("_at") > 1, F.struct("conv_id", (F.col("_at") - 1).alias("at")))
    key = lambda c: F.concat_ws(":", F.coalesce(c["conv_id"].cast("string"), F.lit("none")), c["at"])
    return at.select(
        F.col("conv_id").alias("tree_id"), key(node).alias("node_id"), F.when(parent.isNotNull(), key(parent)).alias("parent_id"),
        "role", "text", F.lit(0.0).alias("score"),
    )
