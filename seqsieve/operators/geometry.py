"""Hamming geometry of 13-site patterns: similarity joins, nearest neighbours, outliers, clusters, smoothing."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqsieve.functions.constants import BASES, SITES
from seqsieve.functions.sequence import hamming
from seqsieve.operators.components import connected_components
from seqsieve.plans.materialise import materialise

LENGTH = len(SITES)
#: Last letters by which the distance transform is dealt out, and a distance beyond any.
TILE, FAR = 3, 100


def masked(patterns: DataFrame, column: str, distance: int, length: int = LENGTH) -> DataFrame:
    """patterns with key: the pattern with each choice of distance positions hidden in turn. Two patterns within the distance share a key, and a key has at most 4 ** distance patterns, however the data are spread."""
    places = F.array(*[F.array(*map(F.lit, c)) for c in combinations(range(1, length + 1), distance)])
    key, hidden = F.col(column), patterns.withColumn("_hide", F.explode(places))
    for i in range(distance):
        key = F.overlay(key, F.lit("*"), F.get("_hide", i))
    return hidden.withColumn("key", key).drop("_hide")


def _spread(df: DataFrame, column: str) -> DataFrame:
    """Distinct values of a column, over enough tasks for the work that each of them makes; small shuffles would be drawn together to one."""
    return df.select(column).distinct().repartition(2 * df.sparkSession.sparkContext.defaultParallelism, column)


def _met(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of a and b that share a masked key. Keys are far more than their source's bytes tell, so neither side may be broadcast."""
    return a.join(b.hint("merge"), "key")


def similar_patterns(left: DataFrame, right: DataFrame, distance: int, length: int = LENGTH, once: bool = False) -> DataFrame:
    """(a, b, distance) of distinct patterns of left.pattern and right.pattern within a distance, which should be small: rows meet in masked keys, of which each has length over distance. A pair is taken from one key only, that whose other hidden places are the first on which both agree, so each stands once; with once, only with a < b."""
    a = masked(_spread(left.select(F.col("pattern").alias("a")), "a"), "a", distance, length)
    b = masked(_spread(right.select(F.col("pattern").alias("b")), "b"), "b", distance, length)
    at = lambda c, i: F.substring(c, i, 1)
    agreed = F.concat(*[F.when(at("a", i) != at("b", i), "").when(at("key", i) == "*", "h").otherwise("v") for i in range(1, length + 1)])
    met = _met(a, b).where(F.instr(agreed, "vh") == 0)
    return (met.where("a < b") if once else met).select("a", "b", hamming(F.col("a"), F.col("b"), length).alias("distance"))


def similar_pairs(df: DataFrame, distance: int, length: int = LENGTH) -> DataFrame:
    """(a, b, distance) with a < b of the distinct patterns of one table."""
    return similar_patterns(df, df, distance, length, once=True)


def _code(pattern: str, first: int, n: int) -> Column:
    """n letters of a pattern from first (from 1) on as a number in base 4."""
    return F.conv(F.translate(F.substring(pattern, first, n), "".join(BASES), "0123"), 4, 10).cast("int")


def _relax(near: np.ndarray, axes: range) -> np.ndarray:
    """Distances to the two nearest points, near[2, ...], after each of the axes of length 4 may be changed at a cost of 1.

    Points that have reached a cell agree with it on all axes to come, so those of the four
    cells along an axis differ, and the two least of their distances are exact.
    """
    for axis in axes:
        one, two = near
        first, second = one, two
        for turn in (1, 2, 3):
            other, third = np.roll(one, turn, axis) + 1, np.roll(two, turn, axis) + 1
            first, second = np.minimum(first, other), np.minimum(np.maximum(first, other), np.minimum(second, third))
        near = np.stack([first, second])
    return np.minimum(near, FAR)


def two_nearest(queries: DataFrame, reference: DataFrame, length: int = LENGTH) -> DataFrame:
    """(pattern, nearest, second): distances of each distinct pattern of queries to the nearest and second nearest distinct pattern of reference (null for none).

    An exact distance transform over all 4 ** length patterns. The first pass relaxes the last
    letters, within each beginning that reference has; its results are dealt out anew by those
    last letters, and the second pass relaxes the beginnings. So the cost of the middle is
    bounded by the number of possible patterns, not by pairs of rows, and no cell of the deal
    is larger than 4 ** (length - TILE) or depends on how the data are spread.
    """
    head, tail = length // 2, length - length // 2
    tile = min(TILE, tail)
    cells, inner = 4**tile, 4 ** (tail - tile)
    known = reference.select("pattern").distinct().select(_code("pattern", 1, head).alias("head"), _code("pattern", head + 1, tail).alias("tail"))
    asked = queries.select("pattern").distinct().select("pattern", _code("pattern", 1, head).alias("head"), _code("pattern", head + 1, tail).alias("tail"))

    def tails(key: tuple, rows: pa.Table) -> pa.Table:
        near = np.full((2, 4**tail), FAR, np.int8)
        near[0, rows["tail"].to_numpy()] = 0
        near = _relax(near.reshape(2, *[4] * tail), range(tail)).reshape(2, cells, inner)
        return pa.table({"tile": pa.array(np.arange(cells), pa.int32()), "head": pa.array([key[0].as_py()] * cells, pa.int32()), "near": [near[:, i].tobytes() for i in range(cells)]})

    def heads(left: pa.Table, right: pa.Table) -> pa.Table:
        near = np.full((2, 4**head, inner), FAR, np.int8)
        for at, raw in zip(right["head"].to_pylist(), right["near"].to_pylist(), strict=True):
            near[:, at] = np.frombuffer(raw, np.int8).reshape(2, inner)
        if len(left):
            near = _relax(near.reshape(2, *[4] * head, inner), range(head)).reshape(2, 4**head, inner)
        found = near[:, left["head"].to_numpy(), left["tail"].to_numpy() % inner].astype(np.int32)
        return pa.table({"pattern": left["pattern"], "nearest": found[0], "second": found[1]})

    first = known.groupBy("head").applyInArrow(tails, "tile int, head int, near binary")
    asked = asked.withColumn("tile", F.floor(F.col("tail") / inner).cast("int"))
    done = asked.groupBy("tile").cogroup(first.groupBy("tile")).applyInArrow(heads, "pattern string, nearest int, second int")
    return done.select("pattern", *[F.when(F.col(c) < FAR, F.col(c)).alias(c) for c in ("nearest", "second")])


def nearest_distance(df: DataFrame, reference: DataFrame, length: int = LENGTH) -> DataFrame:
    """(pattern, distance) of each distinct pattern of df to its nearest of reference.pattern; null if reference is empty."""
    return two_nearest(df, reference, length).select("pattern", F.col("nearest").alias("distance"))


def leave_one_out(df: DataFrame, key: str = "cand_id", length: int = LENGTH) -> DataFrame:
    """(key, distance) to the nearest other row: 0 for a pattern that occurs twice, null for a table of one row."""
    sizes = df.groupBy("pattern").agg(F.count("*").alias("_n"))
    found = sizes.join(two_nearest(df, df, length), "pattern").select("pattern", F.when(F.col("_n") > 1, 0).otherwise(F.col("second")).alias("distance"))
    return df.select(key, "pattern").join(found, "pattern", "left").select(key, "distance")


def outliers(pool: DataFrame, train: DataFrame, n_changed: Column, quantile: float = 0.95, key: str = "cand_id") -> DataFrame:
    """(key, distance, n_changed, ood): pool rows whose number of changes lies outside the training range or whose distance passes the quantile of training's leave-one-out distances."""
    limits = train.agg(F.min(n_changed).alias("_low"), F.max(n_changed).alias("_high"))
    cut = leave_one_out(train, key).agg(F.percentile("distance", quantile).alias("_cut"))
    near = nearest_distance(pool, train)
    rows = pool.withColumn("n_changed", n_changed).join(near, "pattern").join(F.broadcast(limits.join(F.broadcast(cut))))  # both one row
    return rows.select(key, "distance", "n_changed", ((F.col("n_changed") < F.col("_low")) | (F.col("n_changed") > F.col("_high")) | (F.col("distance") > F.col("_cut"))).alias("ood"))


def clusters(df: DataFrame, distance: int, key: str = "cand_id") -> DataFrame:
    """(key, pattern, cluster): connected components of patterns within a distance, named by their smallest pattern."""
    found = connected_components(similar_pairs(df, distance).select("a", "b"))
    named = df.select("pattern").distinct().join(found, F.col("pattern") == F.col("id"), "left").select("pattern", F.coalesce("component", "pattern").alias("cluster"))
    return df.select(key, "pattern").join(named, "pattern")


def neighbours(df: DataFrame, k: int, radius: int, key: str = "cand_id", value: str = "y") -> DataFrame:
    """(key, other, distance, value, rn) of the k nearest other rows within a radius, ties by key. Rows with fewer neighbours in the radius have fewer.

    The k + 1 nearest rows are found for each distinct pattern, distance by distance: only
    patterns that still lack some go on to the next, and of a neighbouring pattern only its
    first k + 1 rows can matter. So neither rows nor copies are multiplied by neighbours.
    """
    first = F.row_number().over(Window.partitionBy("pattern").orderBy(key))
    heads = df.select("pattern", key, F.col(value).alias("value")).withColumn("_r", first).where(F.col("_r") <= k + 1)
    own = materialise(heads.groupBy("pattern").agg(F.array_sort(F.collect_list(F.struct(F.col(key).alias("other"), "value"))).alias("rows")))
    at = lambda d: lambda r: F.struct(F.lit(d).alias("distance"), r["other"].alias("other"), r["value"].alias("value"))
    found = own.select("pattern", F.transform("rows", at(0)).alias("found"))
    for d in range(1, radius + 1):
        found = materialise(found)
        asking = found.where(F.size("found") <= k)
        a, b = (masked(_spread(x.select(F.col("pattern").alias(c)), c), c, d) for x, c in ((asking, "a"), (own, "b")))
        ring = _met(a, b).where(hamming(F.col("a"), F.col("b")) == d)  # a pair at d meets in one key, which hides what differs
        met = ring.select("a", "b").join(own.select(F.col("pattern").alias("b"), "rows"), "b").select("a", F.explode("rows").alias("r")).select("a", "r.other", "r.value")
        near = met.withColumn("_r", F.row_number().over(Window.partitionBy("a").orderBy("other"))).where(F.col("_r") <= k + 1)
        near = near.groupBy("a").agg(F.array_sort(F.collect_list(F.struct("other", "value"))).alias("_more"))
        more = F.coalesce(F.transform("_more", at(d)), F.slice("found", 1, 0))
        found = found.join(near, F.col("pattern") == F.col("a"), "left").select("pattern", F.slice(F.concat("found", more), 1, k + 1).alias("found"))
    others = F.slice(F.filter("found", lambda r: r["other"] != F.col(key)), 1, k)
    joined = df.select(key, "pattern").join(materialise(found), "pattern").select(key, F.posexplode(others).alias("rn", "r"))
    return joined.select(key, "r.other", "r.distance", "r.value", (F.col("rn") + 1).alias("rn"))


def smooth(df: DataFrame, k: int, alpha: float, radius: int, key: str = "cand_id", value: str = "y") -> DataFrame:
    """(key, value, smoothed): (1 - alpha) y + alpha times the mean of the k nearest, or y without neighbours; and the variance of the neighbours' values."""
    near = neighbours(df, k, radius, key, value).groupBy(key).agg(F.avg("value").alias("_mean"), F.var_pop("value").alias("_var"))
    joined = df.select(key, value).join(near, key, "left")
    return joined.select(key, value, F.coalesce((1 - alpha) * F.col(value) + alpha * F.col("_mean"), F.col(value)).alias("smoothed"), (F.col("_var") + 1e-8).alias("variance"))


def nearest_prototype(df: DataFrame, prototypes: Sequence[str], length: int = LENGTH) -> Column:
    """Number of the nearest of a few prototype patterns, ties to the first."""
    best, at = hamming(F.col("pattern"), F.lit(prototypes[0]), length), F.lit(0)
    for i, p in enumerate(prototypes[1:], 1):
        d = hamming(F.col("pattern"), F.lit(p), length)
        at, best = F.when(d < best, i).otherwise(at), F.least(d, best)
    return at


def _characters(values: np.ndarray) -> np.ndarray:
    """Walsh-Hadamard transform along the first axis, whose length is a power of 2: sums over the letters' characters, as a letter is two bits."""
    step = 1
    while step < len(values):
        pairs = values.reshape(-1, 2, step, *values.shape[1:])
        values = np.stack([pairs[:, 0] + pairs[:, 1], pairs[:, 0] - pairs[:, 1]], axis=1).reshape(values.shape)
        step *= 2
    return values


def _weights(n: int) -> np.ndarray:
    """Letters other than the first in each of the 4 ** n words."""
    out = np.zeros(1, np.int64)
    for _ in range(n):
        out = (out[:, None] + np.array([0, 1, 1, 1])).ravel()
    return out


def power_by_weight(patterns: DataFrame, length: int = LENGTH) -> DataFrame:
    """(weight, power): squares of the characters of the set of distinct patterns, summed over those that depend on weight letters.

    The transform goes in two passes, dealt out like two_nearest: over the last letters within
    each beginning that occurs, then over the beginnings within each part of the last letters'
    characters. All sums are whole numbers of at most 16 ** length.
    """
    head, tail = length // 2, length - length // 2
    tile = min(TILE, tail)
    cells, inner = 4**tile, 4 ** (tail - tile)
    known = patterns.select("pattern").distinct().select(_code("pattern", 1, head).alias("head"), _code("pattern", head + 1, tail).alias("tail"))

    def tails(key: tuple, rows: pa.Table) -> pa.Table:
        found = np.zeros(4**tail, np.int32)
        found[rows["tail"].to_numpy()] = 1
        found = _characters(found).reshape(cells, inner)
        return pa.table({"tile": pa.array(np.arange(cells), pa.int32()), "head": pa.array([key[0].as_py()] * cells, pa.int32()), "part": [x.tobytes() for x in found]})

    def heads(key: tuple, rows: pa.Table) -> pa.Table:
        found = np.zeros((4**head, inner), np.int32)
        for at, raw in zip(rows["head"].to_pylist(), rows["part"].to_pylist(), strict=True):
            found[at] = np.frombuffer(raw, np.int32)
        found = _characters(found)
        last = _weights(tail)[key[0].as_py() * inner :][:inner]
        weight = (_weights(head)[:, None] + last).ravel()
        power = np.zeros(length + 1, np.int64)
        power += np.bincount(weight, np.square(found.ravel(), dtype=np.float64), length + 1).astype(np.int64)  # exact: all add up to 2 ** 52 at most
        return pa.table({"weight": pa.array(np.arange(length + 1), pa.int32()), "power": power})

    first = known.groupBy("head").applyInArrow(tails, "tile int, head int, part binary")
    return first.groupBy("tile").applyInArrow(heads, "weight int, power long").groupBy("weight").agg(F.sum("power").alias("power"))


def pair_histogram(df: DataFrame, distance: int = LENGTH, length: int = LENGTH) -> DataFrame:
    """(distance, n): pairs of distinct patterns at each distance from 1 to the given one, those without a pair left out.

    Pairs are counted from the spectrum of the set (length + 1 numbers, which come to the
    driver), by Krawtchouk polynomials; no pair is ever made. So the cost is that of the
    transform, whatever the number of pairs. Repeated patterns count once; an empty table gives
    an empty result.
    """
    power = {r["weight"]: r["power"] for r in power_by_weight(df, length).collect()}

    def krawtchouk(d: int, k: int) -> int:
        return sum((-1) ** j * 3 ** (d - j) * comb(k, j) * comb(length - k, d - j) for j in range(d + 1))

    counts = [(d, sum(p * krawtchouk(d, k) for k, p in power.items()) // (2 * 4**length)) for d in range(1, min(distance, length) + 1)]
    return df.sparkSession.createDataFrame([c for c in counts if c[1]], "distance int, n long")
