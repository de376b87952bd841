"""Merkle manifest against a plain loop over lists."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from seqsieve.llm.merkle import verified
from seqsieve.llm.queries import ORACLES, QUERIES
from tests.oracle import expected, same

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row):
    return sha(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def tree(nodes, arity):
    """(root, for each leaf its siblings as (before, behind) level by level)."""
    paths, under = [[] for _ in nodes], [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        up, below = [], []
        for at in range(0, len(nodes), arity):
            run = nodes[at : at + arity]
            for i in range(len(run)):
                for leaf in under[at + i]:
                    paths[leaf].append(("".join(run[:i]), "".join(run[i + 1 :])))
            up.append(sha(*run))
            below.append([x for some in under[at : at + arity] for x in some])
        nodes, under = up, below
    return nodes[0] if nodes else None, paths


def brute(rows, arity, changed):
    """Sorted (doc_id, leaf, subroot, root, proof, folded, verified)."""
    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append(r)
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    out, subs = [], []
    for g in names:
        own = sorted(groups[g], key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r)))
        sub, paths = tree([leaf_of(r) for r in own], arity)
        subs.append(sub)
        out += [(g, r, sub, p) for r, p in zip(own, paths, strict=True)]
    root, tops = tree(subs, arity)
    found = []
    for g, r, sub, p in out:
        steps = p + tops[names.index(g)]
        h = leaf_of(changed(r))
        for a, b in steps:
            h = sha(a, h, b)
        found.append((r[0], leaf_of(r), sub, root, sha(*(a + b for a, b in steps)), h, h == root))
    return sorted(found, key=str)


def without_breaks(r):
    return (*r[:4], r[4].replace("\n", "") if r[4] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 and r[0] is not None else r[4])


def altered():
    return {"text": F.when(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, F.translate("text", "\n", "")).otherwise(F.col("text"))}


def some_rows(n, seed):
    rnd = random.Random(seed)
    text = lambda: rnd.choice([None, "", "a\nb", "\n", "ä\n日本", "plain", "x" * 50_000 + "\n"])
    rows = [(i, rnd.choice(["hot", "hot", "hot", "b", "é", "", None, f"s{i}"]), rnd.choice(["en", None]), rnd.choice([None, 3, -1]), text()) for i in range(n)]
    return rows + [(None, "b", None, None, "t"), (None, None, None, None, None), (5, "hot", "en", 1, "again"), rows[0], rows[0]]


@pytest.mark.parametrize(("arity", "n"), [(3, 40), (2, 9)])
def test_equals_a_loop(spark, arity, n):
    rows = some_rows(n, arity)
    docs = spark.createDataFrame(rows, SCHEMA)
    for name in ("grp", "hash", "idx", "n", "rn", "left", "right", "steps", "top", "_g", "_i", "_s1", "leaf", "root", "_part", "_in", "altered_leaf"):
        docs = docs.withColumn(name, F.lit("x"))  # columns that aren't part of a leaf
    got = verified(docs, arity=arity, altered=altered()).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(rows, arity, without_breaks)


def test_lone_groups_and_empty_table(spark):
    rows = [(i, f"s{i}", None, None, "a\nb") for i in range(10)]
    got = verified(spark.createDataFrame(rows, SCHEMA), altered=altered()).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(rows, 3, without_breaks)
    assert verified(spark.createDataFrame([], SCHEMA)).collect() == []


def test_a_change_of_any_column_is_found(spark):
    rows = [(i, "s", "en", 1, f"t{i}") for i in range(9)]
    changes = {1: ("lang", "de"), 3: ("n_chars", 2), 4: ("text", None), 7: ("source", "t")}
    changed = {column: F.when(F.col("doc_id") == i, F.lit(value)).otherwise(F.col(column)) for i, (column, value) in changes.items()}
    got = verified(spark.createDataFrame(rows, SCHEMA), altered=changed).collect()
    assert sorted(r["doc_id"] for r in got if not r["verified"]) == sorted(changes)
    assert len({r["root"] for r in got}) == 1


def test_query_equals_sql(spark, data):
    same(QUERIES["op11_merkle"](spark, data).toPandas(), expected(ORACLES["op11_merkle"], data))
