"""Near-duplicates by the true similarity of word shingles: Golay keys and MinHash bands, exact verification, components.

At a Jaccard similarity of 0.8 the 64-bit fingerprints of two texts differ in about 10 +- 3
bits, and keys that stay complete for such a radius are of four bits or fewer. So the Golay
keys of operator 7, over fingerprints of the same shingles, give the candidates at 2 or fewer
differing bits, and the others come from the shingle sets themselves: of BANDS keys, each of ROWS minima of hashes, two sets
of similarity s share at least one with probability 1 - (1 - s^ROWS)^BANDS, which is 0.9996 at
0.8 and rises above. Every candidate is verified on the whole sets before it becomes a link.

All pairs of fingerprints at 2 or fewer bits are candidates, whatever the size of their keys.
A band that many sets share is cut into blocks of bounded size, each searched whole in a task
of its own; a few members of each component found stand for it in the next round's blocks,
until the band is one block. That leaves few components, not all links: at last all pairs of a
large band whose ends are still in different components are compared, a pair of blocks in a
task, but for sets that the whole of the other components can't bring to the least similarity.
So no band loses a link, whatever its size.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqsieve.llm.simhash_golay import ball_pairs, majority, shared_keys, small_links
from seqsieve.operators.components import connected_components
from seqsieve.operators.ranking import numbered
from seqsieve.plans.materialise import join_groups, materialise
from seqsieve.plans.workers import release_memory

BANDS, ROWS = 20, 5
#: The least similarity of a link, as a fraction.
SIMILAR = (4, 5)
#: Sets of one band that are compared pair by pair; larger bands go in blocks.
BUCKET = 16
#: Sets of a block, members that stand for a component, and rounds in which a band may fail to shrink by half.
BLOCK, REPRESENTATIVES, IDLE = 256, 8, 3
SKETCH = "key binary, doc_id long, set_key binary, size int, fp long, bands array<long>"

_RANDOM = np.random.default_rng(20)
_FLIP, _ODD, _MIX = (_RANDOM.integers(0, 1 << 64, n, np.uint64) for n in (BANDS * ROWS, BANDS * ROWS, BANDS * ROWS))
_ODD |= np.uint64(1)
_MIX |= np.uint64(1)


def shingle_set(text: str | None, shingle: int = 5) -> np.ndarray:
    """Sorted distinct XXH64 (seed 42) of the word shingles; of all words together if there are fewer; empty without a word."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    n = max(1, len(words) - shingle + 1)
    hashes = map(xxhash.xxh64_intdigest, map(b" ".join, zip(*(words[i:] for i in range(shingle)))), repeat(42)) if len(words) >= shingle else [xxhash.xxh64_intdigest(b" ".join(words), 42)]
    return np.unique(np.fromiter(hashes, np.uint64, n))


def band_keys(found: np.ndarray) -> np.ndarray:
    """A key of each band of a set that isn't empty."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(found), 4096):
        least = np.minimum(least, ((found[None, at : at + 4096] ^ _FLIP[:, None]) * _ODD[:, None]).min(axis=1))
    mixed = ((least ^ (least >> np.uint64(29))) * _MIX).reshape(BANDS, ROWS).sum(axis=1, dtype=np.uint64)
    return mixed ^ (mixed >> np.uint64(31))


def sketches(docs: DataFrame, key_col: str, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """SKETCH of each row of docs."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            sets = [shingle_set(t, shingle) for t in pdf["text"]]
            bands = [band_keys(s).view(np.int64) if len(s) else np.zeros(0, np.int64) for s in sets]
            names = [xxhash.xxh3_128_digest(s.tobytes(), 7) for s in sets]
            fps = np.array([majority(s) if len(s) else 0 for s in sets], np.uint64).view(np.int64)
            yield pd.DataFrame({"key": pdf["key"], "doc_id": pdf["doc_id"].astype("Int64"), "set_key": names, "size": [len(s) for s in sets], "fp": fps, "bands": bands})
        release_memory()

    return docs.select(F.col(key_col).alias("key"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInPandas(run, SKETCH)


def candidate_sets(docs: DataFrame, named: DataFrame, key_col: str, text_col: str, shingle: int) -> DataFrame:
    """(set_key, shingles) of the rows of docs whose key is in named (key, set_key), made again from the text: few texts have a candidate, and a set is as long as its text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"set_key": pdf["set_key"], "shingles": [shingle_set(t, shingle).view(np.int64) for t in pdf["text"]]})
        release_memory()

    texts = docs.select(F.col(key_col).alias("key"), F.col(text_col).alias("text")).join(named, "key").select("set_key", "text")
    return texts.mapInPandas(run, "set_key binary, shingles array<long>").dropDuplicates(["set_key"])


def golay_pairs(distinct: DataFrame) -> DataFrame:
    """(a, b): set keys whose fingerprints (the majority of a set's hashes) differ in 2 or fewer bits; of sets with one fingerprint the least stands for the others.

    Pairs that meet in a small Golay key come from it. The fingerprints of larger keys meet in
    their one-bit neighbours, of which none has more than 65: two lie within 2 bits exactly if
    they share one, so their pairs grow with their number, not its square.
    """
    named = distinct.where("size > 0").select("fp", "set_key")
    least = materialise(named.groupBy("fp").agg(F.min("set_key").alias("a")))
    same = named.join(least, "fp").where("a <> set_key").select("a", F.col("set_key").alias("b"))
    shared = shared_keys(least.select("fp"))
    links = materialise(small_links(shared).unionByName(ball_pairs(shared)).distinct())
    near = links.join(least.select(F.col("fp").alias("a"), F.col("a").alias("x")), "a").join(least.select(F.col("fp").alias("b"), F.col("a").alias("y")), "b")
    return same.unionByName(near.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")))


def components_of(sets: list[np.ndarray]) -> tuple[list[tuple[int, int]], np.ndarray]:
    """(links, component of each set): edges of a spanning forest of the pairs of sets with the least similarity or more, breadth first, each set against all that aren't reached yet."""
    up, down = SIMILAR
    sizes = np.array([len(s) for s in sets])
    ids = np.unique(np.concatenate(sets), return_inverse=True)[1]
    parts = np.split(ids, np.cumsum(sizes)[:-1])
    rest, links = np.arange(len(sets)), []
    root = np.arange(len(sets))
    mark = np.zeros(len(ids), bool)
    while len(rest):
        first, queue, rest = rest[0], [rest[0]], rest[1:]
        flat = None
        while queue and len(rest):
            x = queue.pop()
            if flat is None:
                flat = np.concatenate([parts[i] for i in rest])
                starts = np.cumsum(sizes[rest]) - sizes[rest]
            mark[parts[x]] = True
            both = np.add.reduceat(mark[flat], starts, dtype=np.int64)
            mark[parts[x]] = False
            near = down * both >= up * (sizes[x] + sizes[rest] - both)
            if near.any():
                links += [(x, y) for y in rest[near]]
                root[rest[near]] = first
                queue += list(rest[near])
                rest, flat = rest[~near], None
    return links, root


def _block_links(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of rows (band, block, set_key, shingles) that come sorted by band and block: the links (a, b) of each block, and for each component its representatives a, with no b."""
    at, names, sets = None, [], []

    def out() -> pd.DataFrame:
        if not names:
            return pd.DataFrame({"band": pd.array([], "Int64"), "a": [], "b": []})
        links, root = components_of(sets)
        rows = [(names[x], names[y]) for x, y in links]
        for r in np.unique(root):
            members = np.flatnonzero(root == r)
            rows += [(names[i], None) for i in members[np.unique(np.linspace(0, len(members) - 1, min(REPRESENTATIVES, len(members))).astype(int))]]
        return pd.DataFrame({"band": pd.array([at[0]] * len(rows), "Int64"), "a": [r[0] for r in rows], "b": [r[1] for r in rows]})

    for pdf in batches:
        for band, block, name, s in zip(pdf["band"], pdf["block"], pdf["set_key"], pdf["shingles"], strict=True):
            if (band, block) != at:
                yield out()
                at, names, sets = (band, block), [], []
            names.append(name)
            sets.append(np.asarray(s, np.int64))
    yield out()
    release_memory()


def block_links(large: DataFrame, sets: DataFrame, block: int = BLOCK) -> DataFrame:
    """Links (a, b) of the sets of large bands (band, pos, set_key, bands), round by round.

    A band's sets stand in order of other bands' keys, so that sets that are alike stand near
    each other, and are numbered by a range shuffle; so no band is one task. A band leaves when
    it is one block, or when IDLE rounds, each in another order, haven't left it smaller by half.
    """
    rows, links, idle = materialise(large.select("band", "pos", "set_key", "bands")), None, 0
    size, turn = rows.count(), 0
    while size:
        orders = [F.get("bands", (F.col("pos") + 1 + turn + i) % BANDS).alias(f"_o{i}") for i in (0, 7)]
        placed = numbered(rows.select("band", "set_key", *orders), ["_o0", "_o7", "set_key"], "_rn", ["band"], "_all")
        cut = materialise(placed.select("band", "set_key", F.floor((F.col("_rn") - 1) / block).alias("block"), (F.col("_all") > block).alias("more")))
        found = cut.join(sets, "set_key").repartition("band", "block").sortWithinPartitions("band", "block").mapInPandas(_block_links, "band long, a binary, b binary")
        found = materialise(found)
        own = found.where("b IS NOT NULL").select("a", "b")
        links = own if links is None else links.unionByName(own)
        open_ = cut.where("more").select("band").distinct()
        left = found.where("b IS NULL").select("band", F.col("a").alias("set_key")).join(open_, "band", "left_semi")
        rows = materialise(rows.join(left, ["band", "set_key"], "left_semi"))
        last, size = size, rows.count()
        idle = idle + 1 if 2 * size > last else 0
        if idle >= IDLE:
            break
        turn += 1
    return links if links is not None else large.select(F.col("set_key").alias("a"), F.col("set_key").alias("b")).limit(0)


def links_between(sets: list[np.ndarray], roots: list, left: list[bool], right: list[bool]) -> list[tuple[int, int]]:
    """Links of sets on the left with sets on the right whose roots differ, as many as join all that have one."""
    up, down = SIMILAR
    sizes = np.array([len(s) for s in sets])
    ids = np.unique(np.concatenate(sets), return_inverse=True)[1]
    parts = np.split(ids, np.cumsum(sizes)[:-1])
    root = np.unique(np.array(roots, object), return_inverse=True)[1]
    others = np.flatnonzero(right)
    flat = np.concatenate([parts[i] for i in others])
    starts = np.cumsum(sizes[others]) - sizes[others]
    mark, links = np.zeros(len(ids), bool), []
    for x in np.flatnonzero(left):
        fits = (root[others] != root[x]) & (down * np.minimum(sizes[x], sizes[others]) >= up * np.maximum(sizes[x], sizes[others]))
        if not fits.any():
            continue
        mark[parts[x]] = True
        both = np.add.reduceat(mark[flat], starts, dtype=np.int64)
        mark[parts[x]] = False
        for y in others[fits & (down * both >= up * (sizes[x] + sizes[others] - both))]:
            if root[y] != root[x]:
                links.append((x, y))
                root[root == root[y]] = root[x]
    return links


def _cross_links(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The links (a, b) of each pair of blocks, of rows (band, i, j, block, set_key, component, shingles) that come sorted by the first three."""
    at, rows = None, []

    def out() -> pd.DataFrame:
        names, roots, blocks, sets = zip(*rows, strict=True) if rows else ((), (), (), ())
        links = links_between(list(sets), list(roots), [b == at[1] for b in blocks], [b == at[2] for b in blocks]) if rows else []
        return pd.DataFrame({"a": [names[x] for x, _ in links], "b": [names[y] for _, y in links]})

    for pdf in batches:
        for band, i, j, block, name, component, s in zip(*(pdf[c] for c in ("band", "i", "j", "block", "set_key", "component", "shingles")), strict=True):
            if (band, i, j) != at:
                yield out()
                at, rows = (band, i, j), []
            rows.append((name, component, block, np.asarray(s, np.int64)))
    yield out()
    release_memory()


def of_several(rows: DataFrame) -> DataFrame:
    """The rows (band, component, ...) of bands with more than one component."""
    kinds = rows.groupBy("band").agg(F.min("component").alias("_low"), F.max("component").alias("_high")).where("_low <> _high").select("band")
    return rows.join(kinds, "band", "left_semi")


def may_link(named: DataFrame, sets: DataFrame) -> DataFrame:
    """The set keys of named (set_key, component) that aren't ruled out: sets of which so many shingles are in sets of other components, all taken together, as a link to one would need."""
    up, down = SIMILAR
    # two hashes stand for the component, as its bytes have no place in a hash aggregate
    marks = {"c": F.xxhash64("component"), "d": F.xxhash64(F.lit(1), "component")}
    tokens = materialise(named.withColumns(marks).drop("component").join(sets, "set_key").select("set_key", "c", "d", F.size("shingles").alias("size"), F.explode("shingles").alias("token")))
    ends = [f(m).alias(f"{n}{m}") for m in marks for n, f in (("low_", F.min), ("high_", F.max))]
    common = materialise(tokens.groupBy("token").agg(F.count("*").alias("n"), *ends).where("low_c <> high_c OR low_d <> high_d").select("token", "n"))
    met = join_groups(tokens.select("set_key", "size", "token"), common, "token", "n", tokens.count())
    return met.groupBy("set_key").agg(F.first("size").alias("size"), F.count("*").alias("met")).where(down * F.col("met") >= up * F.col("size")).select("set_key")


def cross_links(large: DataFrame, sets: DataFrame, found: DataFrame, block: int = BLOCK) -> DataFrame:
    """Links (a, b) between the components found (id, component) of the sets of large bands (band, set_key): any two that a pair of a band links get one, directly or through others.

    The sets of a band with several components stand in order of component, in blocks. Each pair
    of blocks is compared whole in one group of rows, but those of one and the same component.
    """
    named = large.select("band", "set_key").join(found.withColumnRenamed("id", "set_key"), "set_key", "left").withColumn("component", F.coalesce("component", "set_key"))
    several = materialise(of_several(named))
    if several.isEmpty():
        return several.select(F.col("set_key").alias("a"), F.col("set_key").alias("b"))
    left = of_several(several.join(may_link(several.select("set_key", "component").distinct(), sets), "set_key", "left_semi"))
    placed = numbered(left, ["component", "set_key"], "_rn", ["band"], "_all").withColumn("_last", F.floor((F.col("_all") - 1) / block))
    placed = materialise(placed.select("band", "set_key", "component", "_last", F.floor((F.col("_rn") - 1) / block).alias("block")))
    blocks = placed.groupBy("band", "block", "_last").agg(F.min("component").alias("_low"), F.max("component").alias("_high"))
    whole = blocks.where("_low = _high").groupBy("band", F.col("_low").alias("_one")).agg(F.max("block").alias("_end"))  # blocks of one component stand in a row
    first = F.when(F.col("_low") == F.col("_high"), F.col("_end") + 1).otherwise(F.col("block"))
    jobs = blocks.join(whole.withColumnRenamed("band", "_band"), (F.col("band") == F.col("_band")) & (F.col("_low") == F.col("_one")), "left").withColumn("_first", first)
    jobs = materialise(jobs.where("_first <= _last").select("band", F.col("block").alias("i"), F.explode(F.sequence("_first", "_last")).alias("j")))
    ends = jobs.select("band", "i", "j", F.explode(F.array_distinct(F.array("i", "j"))).alias("block"))
    rows = ends.join(placed.select("band", "block", "set_key", "component"), ["band", "block"]).join(sets, "set_key")
    return rows.repartition("band", "i", "j").sortWithinPartitions("band", "i", "j").mapInPandas(_cross_links, "a binary, b binary")


def similar_links(docs: DataFrame, distinct: DataFrame, key_col: str, text_col: str, shingle: int, bucket: int = BUCKET) -> DataFrame:
    """Edges (a, b) between set keys that give the same components as all pairs whose sets share a band or a Golay key and have the least similarity or more; without a large band, these pairs."""
    up, down = SIMILAR
    keys = distinct.select("set_key", "size", "bands", F.posexplode("bands").alias("pos", "band"))
    sizes = materialise(keys.groupBy("band").agg(F.count("*").alias("n")).where("n > 1"))
    shared = materialise(keys.drop("bands").join(sizes, "band"))
    small = shared.where(F.col("n") <= bucket).groupBy("band").agg(F.collect_list(F.struct("set_key", "size")).alias("m"))
    fits = lambda a, b: (b["set_key"] > a["set_key"]) & (down * F.least(a["size"], b["size"]) >= up * F.greatest(a["size"], b["size"]))
    pairs = F.flatten(F.transform("m", lambda a: F.transform(F.filter("m", lambda b: fits(a, b)), lambda b: F.struct(a["set_key"].alias("a"), b["set_key"].alias("b")))))
    golay = golay_pairs(distinct)
    pair = materialise(small.select(F.inline(pairs)).unionByName(golay).distinct())
    wanted = shared.select("set_key").union(pair.select("a")).union(pair.select("b")).distinct()
    named = distinct.select("set_key", F.col("first.key").alias("key")).join(wanted, "set_key", "left_semi")
    sets = materialise(candidate_sets(docs, named, key_col, text_col, shingle))
    sided = pair.join(sets.select(F.col("set_key").alias("a"), F.col("shingles").alias("sa")), "a").join(sets.select(F.col("set_key").alias("b"), F.col("shingles").alias("sb")), "b")
    both = F.size(F.array_intersect("sa", "sb"))
    links = sided.where(down * both >= up * (F.size("sa") + F.size("sb") - both)).select("a", "b")
    large = shared.where(F.col("n") > bucket).select("band", "pos", "set_key").join(distinct.select("set_key", "bands"), "set_key")
    if large.isEmpty():
        return links
    found = connected_components(materialise(links.unionByName(block_links(large, sets))))
    return found.select(F.col("id").alias("a"), F.col("component").alias("b")).unionByName(cross_links(large, sets, found))


def first_of_similar(docs: DataFrame, *, key_col: str, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5) -> DataFrame:
    """(key): the key of one row of each group of near-duplicates, the least by id, null ids last, then by key.

    Two rows are linked if their sets of word shingles have a Jaccard similarity of 0.8 or more;
    groups are the components. Texts without a word, null or empty, are copies of each other.
    Sets are told apart by 128 bits. Rows of the same key count as one; texts count whole,
    however long; other columns are ignored. An empty table gives an empty result.
    """
    rank = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "key")
    distinct = materialise(sketches(docs, key_col, id_col, text_col, shingle).groupBy("set_key").agg(F.min(rank).alias("first"), F.first("size").alias("size"), F.first("fp").alias("fp"), F.first("bands").alias("bands")))
    found = connected_components(materialise(similar_links(docs, distinct, key_col, text_col, shingle)))
    labelled = distinct.select("set_key", "first").join(found, distinct["set_key"] == found["id"], "left").select("first", F.coalesce("component", "set_key").alias("component"))
    return labelled.groupBy("component").agg(F.min("first").alias("first")).select(F.col("first.key").alias("key"))
