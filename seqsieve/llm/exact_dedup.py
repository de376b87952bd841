"""Exact deduplication by owners in compressed radix (Patricia) tries.

Every text is inserted, as its full bytes behind a fixed-size (length, content hash)
prefix, into a compressed radix trie whose terminal nodes hold an owner and a count. Two
levels keep hot texts apart: each input partition builds a trie of its own rows and hands
on one row for each different text, and the (length, content hash) partitions merge those
in a second trie over rows that Spark has sorted by the same prefix.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqsieve.plans.materialise import join_groups, materialise

#: Bytes of text that one trie may hold before it spills subtrees.
TRIE_BYTES = 64 << 20


class RadixTrie:
    """Compressed radix trie from byte strings to (owner, count).

    A node is [edge bytes, children by first byte, owner, count]; count 0 marks an inner node.
    """

    def __init__(self, better) -> None:
        self.root: list = [b"", {}, None, 0]
        self.better, self.held = better, 0

    def insert(self, key: bytes, owner, count: int) -> None:
        node, at = self.root, 0
        while at < len(key):
            child = node[1].get(key[at])
            if child is None:
                node[1][key[at]] = [key[at:], {}, owner, count]
                self.held += len(key) - at + 200
                return
            edge = child[0]
            if key.startswith(edge, at):
                node, at = child, at + len(edge)
                continue
            same = _common(edge, key, at)
            upper = [edge[:same], {edge[same]: child}, None, 0]
            child[0] = edge[same:]
            node[1][key[at]] = upper
            self.held += 200
            node, at = upper, at + same
        if node[3]:
            node[2] = self.better(node[2], owner)
        else:
            node[2] = owner
        node[3] += count

    @staticmethod
    def terminals(node: list, prefix: bytes) -> Iterator[tuple[bytes, object, int]]:
        """All (key, owner, count) of a subtree, without recursion."""
        todo = [(node, prefix)]
        while todo:
            node, prefix = todo.pop()
            key = prefix + node[0]
            if node[3]:
                yield key, node[2], node[3]
            todo += [(child, key) for child in node[1].values()]

    def spill(self) -> Iterator[tuple[bytes, object, int]]:
        """Empty the trie, one subtree of the root's branching node after another, and yield the terminals."""
        node, prefix = self.root, b""
        while len(node[1]) == 1 and not node[3]:
            (node,) = node[1].values()
            prefix += node[0]
        if node[3]:
            yield prefix, node[2], node[3]
        for first in sorted(node[1]):
            yield from self.terminals(node[1].pop(first), prefix)
        self.root, self.held = [b"", {}, None, 0], 0


def _common(edge: bytes, key: bytes, at: int) -> int:
    """Length of the common prefix of edge and key[at:], by halving."""
    low, high = 0, min(len(edge), len(key) - at)
    while low < high:
        mid = (low + high + 1) // 2
        if edge[:mid] == key[at : at + mid]:
            low = mid
        else:
            high = mid - 1
    return low


def _largest(a, b):
    return b if a is None or (b is not None and b > a) else a


def _smallest(a, b):
    return b if a is None or (b is not None and b < a) else a


def _prefix(text: bytes) -> bytes:
    return len(text).to_bytes(8, "big") + xxhash.xxh64_digest(text)


def _frame(rows: list) -> pd.DataFrame:
    return pd.DataFrame({"prefix": [k[:16] for k, _, _ in rows], "body": [k[16:] for k, _, _ in rows], "owner": pd.array([o for _, o, _ in rows], dtype="Int64"), "n": [n for _, _, n in rows]})


def _in_slices(found: Iterator) -> Iterator[pd.DataFrame]:
    rows, held = [], 0
    for row in found:
        rows.append(row)
        held += len(row[0])
        if held > 8 << 20 or len(rows) >= 5000:
            yield _frame(rows)
            rows, held = [], 0
    if rows:
        yield _frame(rows)


def exact_owners(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", keep: str = "largest", trie_bytes: int = TRIE_BYTES) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z; a null text counts as empty. The
    owner is the largest (or, with keep="smallest", the smallest) id of its equal texts; a null
    id is never preferred. If rows repeat an id, each gets its row and all rows of the owner's
    id are kept. Other columns of docs are ignored, whatever their names; an empty table gives
    an empty result. One trie holds about trie_bytes; beyond that the map side spills its
    subtrees as partial rows, and the merge side, whose rows come sorted by (length, hash),
    spills them once the next (length, hash) begins, when all are final. No row is lost.
    """
    better = {"largest": _largest, "smallest": _smallest}[keep]
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def local(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        trie = RadixTrie(better)
        for pdf in batches:
            for i, text in zip(pdf["doc_id"].astype("Int64"), pdf["text"], strict=True):
                body = text.encode("utf-8", "surrogatepass").lower()
                trie.insert(_prefix(body) + body, None if i is pd.NA else int(i), 1)
                if trie.held > trie_bytes:
                    yield from _in_slices(trie.spill())
        yield from _in_slices(trie.spill())

    def merged(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        trie = RadixTrie(better)

        def out(rows: Iterator) -> Iterator[pd.DataFrame]:
            rows = [(k[:16] + hashlib.sha256(k[16:]).digest(), o, n) for k, o, n in rows]
            if rows:
                yield _frame(rows).rename(columns={"body": "sha"})

        last = None
        for pdf in batches:
            for prefix, body, owner, n in zip(pdf["prefix"], pdf["body"], pdf["owner"].astype("Int64"), pdf["n"], strict=True):
                if prefix != last and trie.held > trie_bytes:
                    yield from out(trie.spill())
                last = prefix
                trie.insert(bytes(prefix) + bytes(body), None if owner is pd.NA else int(owner), int(n))
        yield from out(trie.spill())

    parts = base.mapInPandas(local, "prefix binary, body binary, owner long, n long")
    merge = parts.repartition("prefix").sortWithinPartitions("prefix").mapInPandas(merged, "prefix binary, sha binary, owner long, n long")
    owners = materialise(merge.select("sha", F.col("owner").alias("keep_id"), F.col("n").alias("group_size")))
    rows = materialise(base.select("doc_id", F.unhex(F.sha2(_lower(F.col("text")), 256)).alias("sha")))
    total = rows.count()
    found = join_groups(rows, owners, "sha", "group_size", total)
    return found.select("doc_id", "keep_id", "group_size", F.coalesce(F.col("doc_id") == F.col("keep_id"), F.col("keep_id").isNull()).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))


def _lower(c):
    """A-Z only, unlike lower()."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
