"""Batch selection under budgets and quotas. Scores are better when smaller unless maximise is set; ties go to the smaller id."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from math import floor

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqsieve.functions.sequence import hamming
from seqsieve.operators.ranking import numbered, seeded_order
from seqsieve.operators.space import nearest_in_space
from seqsieve.plans.materialise import materialise


def direction(score: str, maximise: bool) -> Column:
    return F.desc(score) if maximise else F.asc(score)


def first_rows(df: DataFrame, order: Sequence[Column], budget: int, role: str) -> DataFrame:
    """The first budget rows in order with their place (pick) and role."""
    return df.orderBy(*order).limit(max(0, budget)).withColumn("pick", F.row_number().over(Window.orderBy(*order))).withColumn("role", F.lit(role))


def random_batch(pool: DataFrame, budget: int, seed: int, key: str = "cand_id") -> DataFrame:
    return first_rows(pool, [seeded_order(F.lit(seed), F.col(key)), F.col(key)], budget, "random")


def greedy_batch(pool: DataFrame, budget: int, score: str, key: str = "cand_id", maximise: bool = False) -> DataFrame:
    return first_rows(pool, [direction(score, maximise), F.col(key)], budget, "greedy")


def uncertainty_batch(pool: DataFrame, budget: int, sigma: str, key: str = "cand_id") -> DataFrame:
    return first_rows(pool, [F.desc(sigma), F.col(key)], budget, "uncertainty")


def _picks_of_head(head: list[tuple], whole: bool, budget: int) -> list[tuple]:
    """The picks that a head of a table, (key, pattern, distance, place by order) by falling distance and rising order, is sure of.

    Rows beyond the head come after its last row, and their distances only fall. So a pick is
    sure while it stands farther than the last row did, or as far and before it in order.
    """
    letters = np.array([list(r[1].encode()) for r in head], np.uint8)
    distance, place = np.array([r[2] for r in head], np.int64), np.array([r[3] for r in head], np.int64)
    last, last_place = distance[-1], place[-1]
    picks: list[tuple] = []
    left = np.ones(len(head), bool)
    while len(picks) < budget and left.any():
        far = distance[left].max()
        among = np.flatnonzero(left & (distance == far))
        at = among[place[among].argmin()]
        if not whole and (far < last or (far == last and place[at] > last_place)):
            break
        picks.append(head[at])
        left[at] = False
        distance = np.minimum(distance, (letters != letters[at]).sum(axis=1))
    return picks


def farthest_first(pool: DataFrame, known: DataFrame, budget: int, order: Sequence[Column], key: str = "cand_id", role: str = "coverage", head_rows: int = 4096) -> DataFrame:
    """Max-min selection: each pick is the row farthest from known and from the picks before it, ties by order, then key.

    A column holds each row's distance to the nearest chosen pattern. A round brings the
    head_rows first rows to the driver, takes all picks that these rows alone decide (one at
    least), and lowers the distances by them in one narrow pass, so most batches need a round or two.
    """
    from seqsieve.operators.geometry import nearest_distance

    start = nearest_distance(pool, known).withColumnRenamed("distance", "_d")
    rows = materialise(pool.join(start, "pattern").withColumn("_d", F.coalesce("_d", F.lit(10**6))))
    picks: list[tuple] = []
    while len(picks) < budget:
        first = rows.orderBy(F.desc("_d"), *order, F.col(key)).limit(head_rows)
        placed = first.withColumn("_place", F.row_number().over(Window.orderBy(*order, F.col(key))))  # of head_rows rows
        head = placed.orderBy(F.desc("_d"), "_place").select(key, "pattern", "_d", "_place").collect()
        if not head:
            break
        found = _picks_of_head([tuple(r) for r in head], len(head) < head_rows, budget - len(picks))
        picks += found
        if len(picks) < budget:
            chosen_patterns = F.array(*[F.lit(p[1]) for p in found])
            nearest = F.aggregate(chosen_patterns, F.col("_d").cast("int"), lambda d, p: F.least(d, hamming(F.col("pattern"), p)))
            rows = materialise(rows.where(~F.col(key).isin([p[0] for p in found])).withColumn("_d", nearest))
    kind = dict(pool.dtypes)[key]
    chosen = pool.sparkSession.createDataFrame([(p[0], i, role) for i, p in enumerate(picks, 1)], f"{key} {kind}, pick int, role string")
    return pool.join(F.broadcast(chosen), key)  # at most budget rows


def greedy_diverse(pool: DataFrame, known: DataFrame, budget: int, score: str, key: str = "cand_id", maximise: bool = False, factor: int = 5) -> DataFrame:
    """Farthest-first among the factor * budget best by score."""
    head = pool.orderBy(direction(score, maximise), key).limit(factor * budget)
    return farthest_first(materialise(head), known, budget, [direction(score, maximise)], key, "greedy_diverse")


def scaled_quotas(ratios: Mapping[str, float], budget: int) -> dict[str, int]:
    """Whole quotas that sum to budget: floors, then one more each for the largest ratios (stable order). A zero ratio stays zero."""
    if budget < 0 or any(r < 0 for r in ratios.values()):
        raise ValueError("budgets and ratios must not be negative")
    total = sum(ratios.values())
    if not total:
        raise ValueError("no ratio is positive")
    out = {k: floor(budget * r / total + 1e-9) for k, r in ratios.items()}
    for k in sorted((k for k in ratios if ratios[k] > 0), key=lambda k: -ratios[k])[: budget - sum(out.values())]:
        out[k] += 1
    return out


def effective_budget(available: int, budget: int) -> tuple[int, str]:
    """(budget that can be met, a note if it is less)."""
    if budget < 1:
        raise ValueError("the budget must be positive")
    return min(budget, available), "" if available >= budget else f"only {available} of {budget} are available"


def mixed_batch(pool: DataFrame, known: DataFrame, budget: int, ratios: Mapping[str, float], score: str, sigma: str, seed: int, key: str = "cand_id") -> DataFrame:
    """Roles uncertainty, coverage, promising and random by quota, one after another on what is left; a shortfall is filled by score."""
    quotas = scaled_quotas(ratios, budget)
    rest, chosen = pool, None
    steps = {
        "uncertainty": lambda df, n: first_rows(df, [F.desc(sigma), F.col(key)], n, "uncertainty"),
        "coverage": lambda df, n: farthest_first(df, known, n, [F.col(score)], key, "coverage"),
        "promising": lambda df, n: first_rows(df, [F.col(score), F.col(key)], n, "promising"),
        "random": lambda df, n: first_rows(df, [seeded_order(F.lit(seed), F.col(key)), F.col(key)], n, "random"),
    }
    for role, n in [(r, quotas.get(r, 0)) for r in steps] + [("fill", None)]:
        if role == "fill":
            n = budget - (chosen.count() if chosen is not None else 0)
            part = first_rows(rest, [F.col(score), F.col(key)], n, "fill") if n > 0 else None
        else:
            part = steps[role](rest, n) if n > 0 else None
        if part is None:
            continue
        part = materialise(part)
        chosen = part if chosen is None else chosen.unionByName(part)
        rest = rest.join(F.broadcast(part.select(key)), key, "left_anti")  # at most budget rows
    return chosen


def rounded_quotas(parts: Mapping[str, float], budget: int, rest: str) -> dict[str, int]:
    """The parts as they are if they sum to budget, else rounded shares of it (halves to even), and what is left for the part named rest."""
    total = sum(parts.values())
    if total == budget:
        return {k: int(v) for k, v in parts.items()}
    out = {k: round(budget * v / total) for k, v in parts.items() if k != rest}
    return out | {rest: max(0, budget - sum(out.values()))}


#: Shares of the roles in a batch by novelty in space.
SPACE_PARTS = {"uncertainty": 45, "coverage": 25, "promising": 20, "random": 10}


def space_batch(
    pool: DataFrame, known: DataFrame, budget: int, columns: Sequence[str], score: str, sigma: str, seed: int, *, parts: Mapping[str, float] = SPACE_PARTS, key: str = "cand_id", maximise: bool = False
) -> DataFrame:
    """(key, role, pick, novelty): rows of pool with the greatest sigma, then those farthest from known in the standardised columns, then the best by score, then random ones, by rounded quotas, each role on what the ones before have left; a shortfall is filled by sigma.

    Novelty is compared with nine digits, as distances that should be equal may differ by
    rounding; without rows of known it is 0 for all. A pool smaller than the budget is taken whole.
    """
    near = nearest_in_space(pool, known, columns, key).select(key, F.round(F.coalesce("distance", F.lit(0.0)), 9).alias("novelty"))
    rest = materialise(pool.join(near, key).select(key, "novelty", F.col(score).alias("_score"), F.col(sigma).alias("_sigma")))
    quotas = rounded_quotas(parts, budget, "random")
    orders = {
        "uncertainty": [F.desc("_sigma"), F.col(key)],
        "coverage": [F.desc("novelty"), F.col(key)],
        "promising": [direction("_score", maximise), F.col(key)],
        "random": [seeded_order(F.lit(seed), F.col(key)), F.col(key)],
        "fill": [F.desc("_sigma"), F.col(key)],
    }
    chosen, taken = None, 0
    for role, order in orders.items():
        n = min(quotas.get(role, 0), budget - taken) if role != "fill" else budget - taken
        if n <= 0:
            continue
        part = materialise(first_rows(rest, order, n, role).select(key, "role", "pick", "novelty"))
        taken += part.count()
        chosen = part if chosen is None else chosen.unionByName(part)
        rest = rest.join(F.broadcast(part.select(key)), key, "left_anti")  # at most budget rows
    return chosen if chosen is not None else first_rows(rest, orders["fill"], 0, "fill").select(key, "role", "pick", "novelty")


def even_quotas(sizes: Mapping[str, int], budget: int) -> dict[str, int]:
    """Near-even quotas over groups, in order of their names; what a small group can't use goes to the others."""
    out, left = dict.fromkeys(sizes, 0), min(budget, sum(sizes.values()))
    while left:
        open_ = [g for g in sorted(sizes) if out[g] < sizes[g]]
        share = max(1, left // len(open_))
        for g in open_:
            give = min(share, sizes[g] - out[g], left)
            out[g] += give
            left -= give
    return out


def grouped_batch(pool: DataFrame, group: str, budget: int, score: str, key: str = "cand_id") -> DataFrame:
    """Greedy within each group, by even quotas over the (few) groups.

    Only the first rows of a group, as many as the largest quota, are ranked; they are cut off
    before the shuffle, so a group may hold most of the pool.
    """
    sizes = {r[group]: r["n"] for r in pool.where(F.col(group).isNotNull()).groupBy(group).agg(F.count("*").alias("n")).collect()}
    quotas = even_quotas(sizes, budget)
    table = pool.sparkSession.createDataFrame(list(quotas.items()), f"{group} {dict(pool.dtypes)[group]}, _quota int")
    pick = F.row_number().over(Window.partitionBy(group).orderBy(score, key))
    head = pool.withColumn("pick", pick).where(F.col("pick") <= max(quotas.values(), default=0))
    return head.join(F.broadcast(table), group).where(F.col("pick") <= F.col("_quota")).select(*pool.columns, "pick")  # a row per group


def replica_allocation(df: DataFrame, score: str, variance: str, budget: int, key: str = "cand_id") -> DataFrame:
    """(key, top, weighted): replicas by two plans: one each for the budget best, and the budget shared in proportion to variance with remainders to the largest."""
    total = df.agg(F.sum(variance).cast("double")).first()[0] or 1.0
    part = F.col(variance) / F.lit(total) * budget
    rows = df.withColumn("_w", F.floor(part)).withColumn("_f", F.floor(part) - part)
    rest = budget - (rows.agg(F.sum("_w")).first()[0] or 0)
    placed = numbered(numbered(rows, [score, key], "_top"), ["_f", key], "_place")
    return placed.select(key, (F.col("_top") <= budget).cast("int").alias("top"), (F.col("_w") + (F.col("_place") <= rest).cast("int")).alias("weighted"))
