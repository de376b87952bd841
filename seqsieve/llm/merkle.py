"""Merkle manifest of a table: a tree for each group of rows, and one over the groups' roots.

Every level joins its nodes with themselves at computed sibling indices: XOR 1 in a binary
tree, else the offsets to the other slots of the run. A node so gets what stands left and
right of it, which is its step of the proof, and the node in slot zero gives the parent.
Then the steps go down again, a level at a time, so each leaf ends with its path to the root.
Nodes are joined on (group, index), which spreads a hot group as evenly as any other, and a
level has 1 / arity of the rows of the one below.

Digests are 32 bytes inside and lowercase hex text outside; a parent is the sha256 of the
concatenated hex texts of its children.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqsieve.operators.ranking import numbered
from seqsieve.plans.materialise import materialise

#: The columns of a document that its leaf covers, in order.
LEAF_COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
EMPTY = bytearray(b"")
#: Group of the tree over the groups' roots.
TOP = ""


def field(value: Column) -> Column:
    """A value as text that can't run into the next one: `-` for null, else its length in bytes, a colon, and the value (numbers in decimal)."""
    text = value.cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_digest(values: Sequence[Column]) -> Column:
    """The 32 bytes of a row's leaf."""
    return F.unhex(F.sha2(F.concat(*map(field, values)), 256))


def to_hex(digest: Column) -> Column:
    return F.lower(F.hex(digest))


def node_digest(children: Column) -> Column:
    """The digest of concatenated digests, which are hashed as hex text."""
    return F.unhex(F.sha2(to_hex(children), 256))


def group_key(group: Column) -> Column:
    """The group as a text that isn't null and sorts null first, then by bytes."""
    return F.when(group.isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), group.cast("string")))


def sibling(idx: Column, shift: int, arity: int) -> Column:
    """Index of the sibling that is shift slots further in the ring of a run."""
    if arity == 2:
        return idx.bitwiseXOR(F.lit(1))
    return idx - idx % arity + (idx % arity + shift) % arity


def with_siblings(nodes: DataFrame, arity: int) -> DataFrame:
    """nodes (grp, idx, hash, ...) with left and right: the digests of the run's others before and behind each node, concatenated."""
    out, slot = nodes, F.col("idx") % arity
    for shift in range(1, arity):
        other = nodes.select(F.col("grp").alias("_g"), F.col("idx").alias("_i"), F.col("hash").alias(f"_s{shift}"))
        out = out.join(other, (F.col("grp") == F.col("_g")) & (sibling(F.col("idx"), shift, arity) == F.col("_i")), "left").drop("_g", "_i")
    found = [F.coalesce(f"_s{s}", F.lit(EMPTY)) for s in range(1, arity)]
    before = [F.when(slot + s >= arity, x).otherwise(F.lit(EMPTY)) for s, x in enumerate(found, 1)]
    behind = [F.when(slot + s < arity, x).otherwise(F.lit(EMPTY)) for s, x in enumerate(found, 1)]
    return out.select(*nodes.columns, F.concat(*before).alias("left"), F.concat(*behind).alias("right"))


def climb(leaves: DataFrame, arity: int) -> tuple[list[DataFrame], DataFrame]:
    """(levels, tops) of the trees over leaves (grp, idx from 0, n, hash, ...), n being the group's nodes.

    A level holds the nodes that have a parent, with left and right; tops is (grp, height, hash).
    """
    most = leaves.agg(F.max("n")).first()[0] or 0
    levels, nodes = [], leaves
    tops = leaves.where("n = 1").select("grp", F.lit(0).alias("height"), "hash")
    while most > 1:
        level = materialise(with_siblings(nodes.where("n > 1"), arity))
        levels.append(level)
        nodes = level.where(F.col("idx") % arity == 0).select(
            "grp", F.floor(F.col("idx") / arity).alias("idx"), F.floor((F.col("n") + (arity - 1)) / arity).alias("n"), node_digest(F.concat("hash", "right")).alias("hash")
        )
        tops = tops.unionByName(nodes.where("n = 1").select("grp", F.lit(len(levels)).alias("height"), "hash"))
        most = -(-most // arity)
    return levels, materialise(tops)


def descend(leaves: DataFrame, levels: Sequence[DataFrame], tops: DataFrame, arity: int) -> DataFrame:
    """leaves with top (the digest of their tree's root) and steps, from the leaf up: arrays of (left, right). tops is (grp, height, top, steps), the steps above a tree's root."""
    above = None
    for height in range(len(levels), -1, -1):
        here = tops.where(F.col("height") == height).select(F.col("grp").alias("_g"), F.lit(0).cast("long").alias("_i"), "top", "steps")
        if height < len(levels):
            own = levels[height]
            down = own.join(above, (F.col("grp") == F.col("_g")) & (F.floor(F.col("idx") / arity) == F.col("_i"))).withColumn("steps", F.array_prepend("steps", F.struct("left", "right")))
            if not height:
                single = leaves.where("n = 1").join(here.drop("_i"), F.col("grp") == F.col("_g"))
                return down.select(*leaves.columns, "top", "steps").unionByName(single.select(*leaves.columns, "top", "steps"))
            here = here.unionByName(down.select(F.col("grp").alias("_g"), F.col("idx").alias("_i"), "top", "steps"))
        above = materialise(here)
    return leaves.join(above.drop("_i"), F.col("grp") == F.col("_g")).select(*leaves.columns, "top", "steps")  # every tree is a lone leaf


def fold(start: Column, steps: Column) -> Column:
    """The root that a leaf's digest leads to."""
    return F.aggregate(steps, start, lambda acc, s: node_digest(F.concat(s["left"], acc, s["right"])))


def manifest(docs: DataFrame, *, arity: int = 3, columns: Sequence[str] = LEAF_COLUMNS, id_col: str = "doc_id", group_col: str = "source", altered: Mapping[str, Column] | None = None) -> DataFrame:
    """One row per row of docs: (doc_id, leaf, subroot, root, steps, altered_leaf), digests as binary.

    A group's leaves stand in order of id, null ids first, equal ids by leaf; each run of arity
    consecutive nodes has one parent, the last run too if it is shorter, until one node is left.
    The groups' roots, null first and then by bytes, are joined to the root in the same way.
    steps, from the leaf to the root, are what stands left and right on each level; a lone leaf
    in a lone group has none. altered maps columns to changed values; altered_leaf is the leaf
    of the changed row, which fold() leads to another root than the table's.

    Rows that are alike in everything stand next to each other and get a row and a proof each.
    Nulls are part of a leaf and differ from empty texts; texts count whole, however long.
    Columns of docs that aren't named are ignored, whatever their names. An empty table gives
    an empty result.
    """
    changed = {**{c: F.col(c) for c in columns}, **(altered or {})}
    rows = materialise(
        docs.select(
            F.col(id_col).alias("doc_id"), group_key(F.col(group_col)).alias("grp"), leaf_digest([F.col(c) for c in columns]).alias("hash"), leaf_digest([changed[c] for c in columns]).alias("altered_leaf")
        )
    )
    leaves = materialise(numbered(rows, ["doc_id", "hash"], "rn", ["grp"], "n").select("doc_id", "altered_leaf", "grp", (F.col("rn") - 1).alias("idx"), "n", "hash"))
    levels, tops = climb(leaves, arity)
    groups = materialise(numbered(tops, ["grp"], "rn", (), "n").select(F.col("grp").alias("name"), "height", F.lit(TOP).alias("grp"), (F.col("rn") - 1).alias("idx"), "n", "hash"))
    upper, root = climb(groups, arity)
    none = F.array().cast("array<struct<left:binary,right:binary>>")
    placed = descend(groups, upper, root.select("grp", "height", F.col("hash").alias("top"), none.alias("steps")), arity)
    # the root of every group's proof is the same: it is carried like the groups' own roots
    named = materialise(placed.select(F.col("name").alias("grp"), "height", F.struct(F.col("hash").alias("sub"), F.col("top").alias("root")).alias("top"), "steps"))
    proven = descend(leaves, levels, named, arity)
    return proven.select("doc_id", F.col("hash").alias("leaf"), F.col("top.sub").alias("subroot"), F.col("top.root").alias("root"), "steps", "altered_leaf")


def proof_digest(steps: Column) -> Column:
    """sha256, as hex text, of all siblings on the way to the root, level by level and from left to right."""
    return F.sha2(to_hex(F.aggregate(steps, F.lit(EMPTY), lambda acc, s: F.concat(acc, s["left"], s["right"]))), 256)


def verified(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) per row of docs after manifest, which tells what becomes of nulls and repeated rows; the altered leaf is folded, with the table's own siblings."""
    rows = manifest(docs, **options).withColumn("folded", fold(F.col("altered_leaf"), F.col("steps")))
    return rows.select("doc_id", to_hex(F.col("leaf")).alias("leaf"), to_hex(F.col("subroot")).alias("subroot"), to_hex(F.col("root")).alias("root"), proof_digest(F.col("steps")).alias("proof_sha256"), to_hex(F.col("folded")).alias("folded_root"), (F.col("folded") == F.col("root")).alias("verified"))
