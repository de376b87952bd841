"""Feature subsets chosen by inner cross-validation: least squares from sums of products by fold, all subsets of a round ranked at once."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqsieve.operators.metrics import rank_correlation
from seqsieve.operators.ranking import join_sized, value_ranks
from seqsieve.plans.materialise import materialise

#: Decimals of a score that count in a comparison, so that sums in another order choose the same.
DIGITS = 9


@dataclass(frozen=True)
class FoldMoments:
    """Sums of products of 1, the standardised features and the target, for each fold: (features + 2)² numbers a fold, whatever the rows."""

    rows: DataFrame
    features: tuple[str, ...]
    target: str
    fold: str
    centre: np.ndarray
    scale: np.ndarray
    products: dict[int, np.ndarray]

    def weights(self, subset: Sequence[str], without: int | None = None) -> np.ndarray:
        """Intercept and coefficients on the standardised features of least squares over all folds but one (or all); of many solutions the shortest."""
        total = sum(m for k, m in self.products.items() if k != without)
        at = [0, *[1 + self.features.index(f) for f in subset]]
        if not np.any(total):
            return np.zeros(len(at))
        return np.linalg.lstsq(total[np.ix_(at, at)], total[at, -1], rcond=1e-12)[0]

    @cached_property
    def ranked(self) -> tuple[DataFrame, DataFrame]:
        """((fold, _y, _t, _size): the rank of each value of the target in its fold, the rows with it), both written."""
        sizes = self.rows.groupBy(self.fold, "_y").agg(F.count("*").alias("_size"))
        truths = materialise(value_ranks(sizes, "_y", [self.fold], name="_t", keep=["_size"]))
        return truths, materialise(join_sized(self.rows, truths, [self.fold, "_y"]))


def fold_moments(df: DataFrame, features: Sequence[str], target: str, fold: str = "fold") -> FoldMoments:
    """The moments of df by its integer fold column, in two passes; only sums leave a task. Rows with a null or non-finite feature, target or fold are left out.

    A feature without variance stands as zeros. df is read again by every round of a search, so it should be a written table.
    """
    features = tuple(features)
    fine = F.col(fold).try_cast("int").isNotNull()
    for c in (*features, target):
        v = F.col(c).cast("double")
        fine = fine & v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))
    rows = df.where(fine).select(F.col(fold).try_cast("int").alias(fold), *[F.col(c).cast("double").alias(c) for c in features], F.col(target).cast("double").alias("_y"))
    one = rows.agg(*[F.avg(c) for c in (*features, "_y")], *[F.stddev_pop(c) for c in features]).first()
    known = [0.0 if v is None else float(v) for v in one]
    centre, scale = np.array(known[: len(features) + 1]), np.array([s if s > 0 else float("inf") for s in known[len(features) + 1 :]])

    def sums(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, np.ndarray] = {}
        for part in parts:
            x = (part[list(features)].to_numpy() - centre[:-1]) / scale
            made = np.column_stack([np.ones(len(part)), x, part["_y"].to_numpy() - centre[-1]])
            at = part[fold].to_numpy()
            for k in np.unique(at).tolist():
                held[k] = held.get(k, 0.0) + made[at == k].T @ made[at == k]
        if held:
            yield pd.DataFrame({"fold": list(held), "products": [m.ravel().tolist() for m in held.values()]})

    parts = rows.mapInPandas(sums, "fold int, products array<double>").select("fold", F.posexplode("products").alias("at", "v"))
    side = len(features) + 2
    products: dict[int, np.ndarray] = {}
    for r in parts.groupBy("fold", "at").agg(F.sum("v").alias("v")).collect():  # folds x side² numbers
        products.setdefault(r["fold"], np.zeros(side * side))[r["at"]] = r["v"]
    return FoldMoments(rows, features, target, fold, centre, scale, {k: m.reshape(side, side) for k, m in products.items()})


def held_out_r2(moments: FoldMoments, subset: Sequence[str], held: int = 0) -> float:
    """1 - mean squared error / variance of the target on the held fold, of least squares of the other folds; minus infinity without rows or variance. No pass over the rows."""
    m = moments.products.get(held)
    if m is None or len(moments.products) < 2:
        return float("-inf")
    at = [0, *[1 + moments.features.index(f) for f in subset], len(m) - 1]
    v = np.append(-moments.weights(subset, without=held), 1.0)
    n, variance = m[0, 0], m[-1, -1] / m[0, 0] - (m[0, -1] / m[0, 0]) ** 2
    return float(1 - v @ m[np.ix_(at, at)] @ v / n / variance) if variance > 0 else float("-inf")


def cv_spearman(moments: FoldMoments, subsets: Sequence[Sequence[str]]) -> list[float]:
    """For each subset the mean over folds of the rank correlation of the held-out target with the prediction of the other folds' least squares; a fold without variance on a side counts 0.

    The target is ranked once for all subsets and rounds. What is broadcast has a number for every
    subset, fold and feature.
    """
    spark = moments.rows.sparkSession
    plans = []
    for k in moments.products:
        each = []
        for subset in subsets:
            w = moments.weights(subset, without=k)
            full = np.zeros(len(moments.features) + 1)
            full[[0, *[1 + moments.features.index(f) for f in subset]]] = w
            each.append(full.tolist())
        plans.append((k, each))
    if not plans:
        return [0.0] * len(subsets)
    table = spark.createDataFrame(plans, f"`{moments.fold}` int, _plans array<array<double>>")
    x = F.array(*[(F.col(f) - F.lit(float(c))) / F.lit(float(s)) for f, c, s in zip(moments.features, moments.centre, moments.scale, strict=False)])
    truths, ranked = moments.ranked
    scored = ranked.select(moments.fold, "_t", x.alias("_x")).join(F.broadcast(table), moments.fold).select(moments.fold, "_t", "_x", F.posexplode("_plans").alias("_subset", "_w"))
    pred = F.aggregate(F.zip_with("_x", F.slice("_w", 2, len(moments.features)), lambda a, b: a * b), F.get("_w", 0), lambda a, v: a + v)
    every = truths.join(F.broadcast(spark.range(len(subsets)).select(F.col("id").cast("int").alias("_subset"))))  # a copy of each value's rank for a subset, summed at once
    found = rank_correlation(every, scored.select("_subset", moments.fold, "_t", pred.alias("_y"), F.lit(1).cast("long").alias("_w")), ["_subset", moments.fold], 0.0, "spearman")
    means = {r["_subset"]: r["m"] for r in found.groupBy("_subset").agg(F.avg("spearman").alias("m")).collect()}  # one number a subset
    return [round(means[i], DIGITS) for i in range(len(subsets))]


def forward(moments: FoldMoments, most: int, least_gain: float = 0.002) -> list[tuple[str, float]]:
    """(feature, score with it) in the order of choice: each round the feature whose addition scores best, ties to the smaller name, until most are chosen or the gain is below least_gain or nothing."""
    chosen: list[tuple[str, float]] = []
    while len(chosen) < min(most, len(moments.features)):
        names = [f for f, _ in chosen]
        rest = sorted(set(moments.features) - set(names))
        scores = cv_spearman(moments, [[*names, f] for f in rest])
        best = max(range(len(rest)), key=lambda i: (scores[i], -i))
        if chosen and (scores[best] <= chosen[-1][1] or scores[best] - chosen[-1][1] < least_gain):
            break
        chosen.append((rest[best], scores[best]))
    return chosen


def backward(moments: FoldMoments, least: int) -> list[tuple[str, float]]:
    """(feature, score of those left without it) in the order of leaving: each round the one goes without which the others score best, ties to the smaller name, until least are left."""
    left, gone = sorted(moments.features), []
    while len(left) > max(1, least):
        scores = cv_spearman(moments, [[x for x in left if x != f] for f in left])
        worst = max(range(len(left)), key=lambda i: (scores[i], -i))
        gone.append((left.pop(worst), scores[worst]))
    return gone


def elimination(moments: FoldMoments, least: int) -> list[tuple[str, float]]:
    """(feature, its coefficient's size) in the order of leaving: each round least squares of those left over all rows, on standardised columns, and the smallest coefficient goes, ties to the larger name. No pass over the rows."""
    left, gone = sorted(moments.features), []
    while len(left) > max(1, least):
        sizes = [round(float(w), DIGITS) for w in np.abs(moments.weights(left)[1:])]
        worst = min(range(len(left)), key=lambda i: (sizes[i], -i))
        gone.append((left.pop(worst), sizes[worst]))
    return gone
