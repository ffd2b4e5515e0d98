"""Chat formatting of reply trees.

Messages point to the message they reply to.  Iterative self-joins enumerate
the root-to-leaf paths: in round k every (leaf, message) pair known so far is
joined with the ancestor 2**k steps up, and the ancestor table is joined with
itself, so a tree of depth d takes about log2(d) rounds.  Branches of a tree
are ranked by their score, and the chosen ones are formatted as one
conversation each.

A message whose parent is not there is a root.  In a circle of replies the
smallest node counts as the root: its reply is left out, so the circle is a
chain, and the rounds are bounded by log2 of the number of messages.  A
circle that nothing else replies to has one leaf, the message that the root
replied to.  Two messages of one node id are an error.

The template is ``<|role|>\\n`` + text + ``</s>\\n`` per turn.  Control strings
inside texts and roles are escaped: a backslash is doubled, and in ``<s>
</s> [INST] [/INST] <<SYS>> <</SYS>> <|`` and ``|>`` one is put after the
first character, which breaks the control string; ``unescape`` takes the
backslashes out again.

DataFrame functions only.  A written table ends every round.  Null text and
null role: empty.  Rows with equal turns are ordered by role and text;
repeated rows are turns of their own.  A null turn comes first.  A null
conversation id is one conversation.  An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

# Where a control string starts, as first character and what
# must follow it.
_CONTROL = r"(<)(?=\||/?s>|</?SYS>>)|(\|)(?=>)|(\[)(?=/?INST\])"
_END = "</s>\n"


def escape(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, r"\\", r"\\\\"), _CONTROL, r"$1$2$3\\")


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, r"(?s)\\(.)", "$1")


def _doubled(jumps: DataFrame) -> DataFrame:
    """(node, over) twice as far up."""
    return jumps.join(jumps.select(F.col("node").alias("over"), F.col("over").alias("far")), "over").select(
        "node", F.col("far").alias("over"))


def without_circles(messages: DataFrame, scratch: Scratch) -> DataFrame:
    """``messages`` (node, parent) with a null parent where it is not there
    or where a circle of replies is cut, written."""
    there = messages.select(F.col("node").alias("parent")).where("parent is not null").distinct()
    known = scratch.write(messages.where("parent is not null").join(there, "parent").select("node", "parent"), "known")
    rounds = max(1, int(messages.count()).bit_length())
    # after more steps than there are messages, only what leads to a circle is left
    far, k = known.select("node", F.col("parent").alias("over")), 0
    while k < rounds and far.limit(1).count():
        far, k = scratch.write(_doubled(far), f"far_{k}"), k + 1
    circles = far.select(F.col("over").alias("node")).distinct()
    if far.limit(1).count():
        # each circle's smallest node, spread by doubling around the circle
        ring = scratch.write(circles.join(known, "node").select(
            "node", F.col("parent").alias("over"), F.least("node", "parent").alias("low")), "ring_0")
        for k in range(1, rounds + 1):
            next_ = ring.select(F.col("node").alias("over"), F.col("over").alias("far"), F.col("low").alias("far_low"))
            ring = scratch.write(ring.join(next_, "over").select(
                "node", F.col("far").alias("over"), F.least("low", "far_low").alias("low")), f"ring_{k}")
        cut = ring.where(F.col("node") == F.col("low")).select("node")
        known = known.join(cut, "node", "left_anti")
    return scratch.write(messages.select("node").join(known, "node", "left"), "acyclic")


def reply_paths(messages: DataFrame, scratch: Scratch) -> DataFrame:
    """(leaf, node, up) for every message on the path from each leaf to its
    root; ``up`` counts steps from the leaf.  ``messages`` has node and
    parent (null at a root)."""
    if messages.groupBy("node").count().where("count > 1").limit(1).count():
        raise ValueError("two messages have one node id")
    messages = without_circles(messages, scratch)
    parents = messages.select(F.col("parent").alias("node")).where("node is not null").distinct()
    jumps = scratch.write(messages.where("parent is not null").select("node", F.col("parent").alias("over")),
                          "jump_0")
    paths = scratch.write(messages.join(parents, "node", "left_anti").select(
        F.col("node").alias("leaf"), "node", F.lit(0).cast("long").alias("up")), "path_0")
    k = 0
    while jumps.limit(1).count():
        farther = paths.join(jumps, "node").select("leaf", F.col("over").alias("node"), (F.col("up") + (1 << k)).alias("up"))
        k += 1
        paths = scratch.write(paths.unionByName(farther), f"path_{k}")
        jumps = scratch.write(_doubled(jumps), f"jump_{k}")
        scratch.drop(f"path_{k - 1}", f"jump_{k - 1}")
    return paths


def format_trees(messages: DataFrame, branches: int = 1, loss_role: str = "assistant") -> DataFrame:
    """One row per chosen branch: tree, leaf, branch (1 = best), n_turns,
    formatted (text) and loss_spans (start, length in code points of the
    formatted text).

    ``messages``: tree, node (unique), parent, role, text, score.  A branch
    scores the sum of its messages; the best ``branches`` of each tree are
    formatted, ties to the smaller leaf."""
    scratch = Scratch(messages.sparkSession, "reply_trees")
    messages = scratch.write(messages.select(
        "tree", "node", "parent", F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"), F.coalesce("score", F.lit(0.0)).cast("double").alias("score")),
        "messages")
    paths = reply_paths(messages.select("node", "parent"), scratch)
    scored = paths.join(messages.select("node", "tree", "score"), "node").groupBy("tree", "leaf").agg(
        F.sum("score").alias("score"))
    best = Window.partitionBy("tree").orderBy(F.desc("score"), "leaf")
    chosen = scored.withColumn("branch", F.row_number().over(best)).where(F.col("branch") <= branches)
    turns = (paths.join(chosen.select("tree", "leaf", "branch"), "leaf")
             .join(messages.select("node", "role", "text"), "node"))
    mark = F.concat(F.lit("<|"), escape(F.col("role")), F.lit("|>\n"))
    made = turns.select("tree", "leaf", "branch", F.struct(
        (-F.col("up")).alias("at"), (F.col("role") == loss_role).alias("loss"), mark.alias("mark"),
        escape(F.col("text")).alias("body")).alias("turn"))
    whole = made.groupBy("tree", "leaf", "branch").agg(F.sort_array(F.collect_list("turn")).alias("turns"))
    step = lambda acc, t: F.struct(
        (acc["at"] + F.length(t["mark"]) + F.length(t["body"]) + len(_END)).alias("at"),
        F.when(t["loss"], F.concat(acc["spans"], F.array(F.struct(
            (acc["at"] + F.length(t["mark"])).alias("start"), F.length(t["body"]).alias("length")))))
        .otherwise(acc["spans"]).alias("spans"))
    start = F.struct(F.lit(0).alias("at"),
                     F.array().cast("array<struct<start:int,length:int>>").alias("spans"))
    return whole.select(
        "tree", "leaf", "branch", F.size("turns").cast("long").alias("n_turns"),
        F.array_join(F.transform("turns", lambda t: F.concat(t["mark"], t["body"], F.lit(_END))), "").alias("formatted"),
        F.aggregate("turns", start, step, lambda acc: acc["spans"]).alias("loss_spans"))


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted conversation as (role, text)."""
    pieces = F.split(formatted, r"</s>\n")
    return F.transform(F.slice(pieces, 1, F.size(pieces) - 1), lambda p: F.struct(
        unescape(F.regexp_extract(p, r"(?s)^<\|(.*?)\|>\n(.*)$", 1)).alias("role"),
        unescape(F.regexp_extract(p, r"(?s)^<\|(.*?)\|>\n(.*)$", 2)).alias("text")))


def read_loss(formatted: Column, spans: Column) -> Column:
    """The text under the loss mask, unescaped span by span."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substring(formatted, s["start"] + 1, s["length"]))), "")


def chain_messages(rows: DataFrame) -> DataFrame:
    """Conversation rows (conv_id, turn, role, text) as trees of one branch:
    each row replies to the row before."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    at = rows.select("conv_id", "turn", "role", "text").withColumn("at", F.row_number().over(order))
    node = lambda k: F.struct(F.col("conv_id"), k.alias("at"))
    return at.select(
        F.col("conv_id").alias("tree"), node(F.col("at")).alias("node"),
        F.when(F.col("at") > 1, node(F.col("at") - 1)).alias("parent"),
        "role", "text", F.lit(1.0).alias("score"))


def format_conversations(rows: DataFrame) -> DataFrame:
    """Per conversation what can be read back from its formatted text:
    conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars."""
    made = format_trees(chain_messages(rows))
    turns = read_turns(F.col("formatted"))
    loss = read_loss(F.col("formatted"), F.col("loss_spans"))
    told = F.array_join(F.transform(F.col("turns"), lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return made.withColumns({"turns": turns, "loss": loss}).select(
        F.col("tree").cast("long").alias("conv_id"), F.size("turns").cast("long").alias("n_turns"),
        F.sha2(told, 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))
