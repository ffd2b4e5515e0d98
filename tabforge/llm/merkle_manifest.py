"""Merkle manifest of a dataset by slot pivots.

Every row is a leaf; the leaves of a group (language) stand in id order, and
``fanout`` consecutive nodes become the hash of their concatenated digests
until one is left, the group's subroot.  The subroots, in group order, are the
leaves of a second tree of the same kind, whose last node is the root.

A level is one slot pivot: nodes are grouped by (group, position div fanout)
and conditional aggregates spread the children into the columns c0, c1, ...;
the hash of the concatenated columns is the parent, and the columns without a
node's own slot are its siblings.  Proofs are passed down: a node's path is
its siblings, taken from its parent's columns, followed by its parent's path,
so each level is one equi-join of children with half as many parents.

Positions come from a range sort over (group, id, leaf) and the counts per
(sort partition, group), so a group with most of the rows is spread over all
tasks, and no key of a join or pivot has more than ``fanout`` rows.  Every
level is written below the shared checkpoint folder.  The driver holds the
root, the largest group's count and the distinct tree heights.

H is the lowercase hex SHA-256 of the inputs' concatenation, digests as hex
text; inside the tables digests are 32 bytes.

Null fields hash as ``-``; a null text differs from an empty one (``0:``).  A
null group or id comes first.  Rows with equal ids are ordered by their leaf;
repeated rows are leaves of their own.  A null id is never tampered with.  An
empty table gives no rows.  Other columns of the table are not hashed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, ranked

FANOUT = 2
WRITE_EVERY = 4             # levels of the way down that one job joins

_PATH = "array<struct<before:binary,after:binary>>"


def _hash(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def _text(digest: Column) -> Column:
    return F.coalesce(F.lower(F.hex(digest)), F.lit(""))


def field(c: Column) -> Column:
    """``-`` if null, else the UTF-8 byte count, a colon and the value."""
    s = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))


def group_key(c: Column) -> Column:
    """Groups in order: null first, then UTF-8 bytewise; never null."""
    return F.coalesce(F.concat(F.lit("1"), c.cast("string")), F.lit("0"))


def _height(m: Column, fanout: int) -> Column:
    """Levels above ``m`` leaves until one node is left."""
    steps = F.sequence(F.lit(0), F.lit(63))
    return F.aggregate(steps, F.struct(m.cast("long").alias("m"), F.lit(0).alias("h")), lambda a, _: F.struct(
        F.floor((a["m"] + (fanout - 1)) / fanout).alias("m"), (a["h"] + (a["m"] > 1).cast("int")).alias("h")),
        lambda a: a["h"])


def climb(leaves: DataFrame, scratch: Scratch, name: str, fanout: int) -> tuple[list[DataFrame], set[int]]:
    """Written levels of all trees, leaves first, and the distinct heights.
    ``leaves``: tree, at (position from 0), m (leaves of the tree), digest."""
    heights = {r["h"] for r in leaves.where("at = 0").select(_height(F.col("m"), fanout).alias("h")).distinct().collect()}
    levels = [leaves]
    for k in range(1, max(heights, default=0) + 1):
        slot = F.col("at") % fanout
        parents = levels[-1].where("m > 1").groupBy(
            "tree", F.expr(f"at div {fanout}").alias("at"), F.expr(f"(m + {fanout - 1}) div {fanout}").alias("m")).agg(
            *(F.max(F.when(slot == s, F.col("digest"))).alias(f"c{s}") for s in range(fanout)))
        digest = F.unhex(_hash(*(_text(F.col(f"c{s}")) for s in range(fanout))))
        levels.append(scratch.write(parents.withColumn("digest", digest), f"{name}_{k}"))
    return levels, heights


def descend(levels: list[DataFrame], heights: set[int], tops: DataFrame, scratch: Scratch, name: str,
            fanout: int) -> DataFrame:
    """The leaves, all columns, with path (their siblings level by level) and
    subroot.  ``tops``: tree, path (above the tree's last node), subroot."""
    known, pending = None, 0
    for k in range(len(levels) - 1, -1, -1):
        level, parts = levels[k], []
        if k in heights:
            parts.append(level.where("m = 1").join(tops, "tree"))
        if known is not None:
            slot = F.col("at") % fanout
            parents = known.select(F.col("tree").alias("p_tree"), F.col("at").alias("p_at"), F.col("path").alias("above"),
                                   "subroot", *(F.col(f"c{s}").alias(f"p{s}") for s in range(fanout)))
            side = lambda use: F.concat(*(F.when(use(s), F.coalesce(F.col(f"p{s}"), F.lit(b"")))
                                          .otherwise(F.lit(b"")) for s in range(fanout)))
            own = F.struct(side(lambda s: slot > s).alias("before"), side(lambda s: slot < s).alias("after"))
            parts.append(level.where("m > 1").join(
                parents, (F.col("tree") == F.col("p_tree")) & (F.expr(f"at div {fanout}") == F.col("p_at"))).select(
                *level.columns, F.concat(F.array(own), F.col("above")).alias("path"), "subroot"))
        known = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
        pending += 1
        if k and pending == WRITE_EVERY:
            known, pending = scratch.write(known, f"{name}_paths_{k}"), 0
    return known


def fold(start: Column, path: Column) -> Column:
    """The root that a leaf digest (hex) and its siblings lead to."""
    return F.aggregate(path, start, lambda acc, e: _hash(_text(e["before"]), acc, _text(e["after"])))


def manifest(rows: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """``rows`` (tree: group key, never null; id; leaf: hex digest; further
    columns) with at, path, subroot and root (hex).  Leaves of a group stand
    in the order of id, then leaf."""
    scratch = Scratch(rows.sparkSession, "merkle")
    rows = scratch.write(rows.withColumn("digest", F.unhex("leaf")).drop("leaf"), "leaves")
    leaves = ranked(rows, [F.col("tree"), F.col("id").asc_nulls_first(), F.col("digest")], scratch, "sorted", "tree")
    levels, heights = climb(leaves, scratch, "level", fanout)
    ends = [levels[h].where("m = 1").select("tree", "digest") for h in sorted(heights)]
    if not ends:
        return leaves.withColumns({"path": F.array().cast(_PATH), "subroot": F.lit(""), "root": F.lit(""),
                                   "leaf": _text(F.col("digest"))}).drop("digest")
    subroots = ends[0]
    for e in ends[1:]:
        subroots = subroots.unionByName(e)
    over = ranked(subroots.select(F.lit("").alias("tree"), F.col("tree").alias("group"), "digest"),
                  [F.col("group")], scratch, "subroots", "tree")
    top_levels, top_heights = climb(over, scratch, "top", fanout)
    root = top_levels[-1].where("m = 1").select(_text(F.col("digest"))).first()[0]
    top = rows.sparkSession.range(1).select(F.lit("").alias("tree"), F.array().cast(_PATH).alias("path"),
                                            F.lit(None).cast("string").alias("subroot"))
    tops = scratch.write(descend(top_levels, top_heights, top, scratch, "top", fanout).select(
        F.col("group").alias("tree"), "path", _text(F.col("digest")).alias("subroot")), "tops")
    return descend(levels, heights, tops, scratch, "level", fanout).withColumns(
        {"root": F.lit(root), "leaf": _text(F.col("digest"))}).drop("digest")


def leaf_of(source: Column, lang: Column, doc_id: Column, n_chars: Column, text: Column) -> Column:
    return _hash(field(doc_id), field(source), field(lang), field(n_chars), field(text))


def document_manifest(docs: DataFrame, fanout: int = FANOUT, tamper_every: int = 7) -> DataFrame:
    """Per document: doc_id, leaf, subroot, root, proof_sha256 (hash of its
    siblings, level by level up to the root), folded_root (the root that the
    siblings lead to from the row as it is now) and verified.  The row as it
    is now has n_chars one higher where ``tamper_every`` divides
    crc32(doc_id)."""
    hit = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % tamper_every == 0, F.lit(False))
    cols = [F.col("source"), F.col("lang"), F.col("doc_id")]
    now = F.when(hit & F.col("n_chars").isNotNull(), F.unhex(leaf_of(*cols, F.col("n_chars") + 1, F.col("text"))))
    rows = docs.select(group_key(F.col("lang")).alias("tree"), F.col("doc_id").alias("id"),
                       leaf_of(*cols, F.col("n_chars"), F.col("text")).alias("leaf"), now.alias("now"))
    told = F.array_join(F.transform("path", lambda e: _text(F.concat(e["before"], e["after"]))), "")
    made = manifest(rows, fanout).select(
        F.col("id").alias("doc_id"), "leaf", "subroot", "root", F.sha2(told, 256).alias("proof_sha256"),
        fold(F.coalesce(F.lower(F.hex("now")), F.col("leaf")), F.col("path")).alias("folded_root"))
    return made.withColumn("verified", F.col("folded_root") == F.col("root"))
