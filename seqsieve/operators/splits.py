"""Leakage-safe splits and transforms that are fitted on training rows only.

Order is pseudo-random by md5 of 'seed:key', so any engine gives the same splits.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqsieve.operators.ranking import join_null_safe, numbered, quantiles, seeded_order, value_ranks, with_ranks
from seqsieve.plans.materialise import materialise


def with_seeds(df: DataFrame, seeds: Sequence[int]) -> DataFrame:
    return df.withColumn("seed", F.explode(F.array(*map(F.lit, seeds))))


def by_order(df: DataFrame, key: str) -> DataFrame:
    """df (with seed) with rn, its number in its seed's order, and n, the rows of the seed."""
    sizes = df.groupBy(F.col("seed").alias("_seed")).agg(F.count("*").alias("n"))
    placed = numbered(df.withColumn("_order", seeded_order(F.col("seed"), F.col(key))), ["_order", key], "rn", ["seed"]).drop("_order")
    return placed.join(F.broadcast(sizes), F.col("seed").eqNullSafe(F.col("_seed"))).drop("_seed")  # one row a seed


def train_test(df: DataFrame, key: str, share: float) -> DataFrame:
    """role is test for the first ceil(share n) rows of each seed's order, else train.

    Counts of the order's first four digits tell where each seed's last test row lies; only the
    keys with its digits are sorted, and no row moves. df is read three times, the first two its
    seed and key alone. Keys should tell a seed's rows apart; if the last one doesn't, rows are numbered.
    """
    order, digits = seeded_order(F.col("seed"), F.col(key)), F.col("_digits")
    keys = df.select(F.col("seed").alias("_seed"), F.col(key).alias("_key"), order.alias("_order")).withColumn("_digits", F.substring("_order", 1, 4))
    sizes = keys.groupBy("_seed", "_digits").agg(F.count("*").alias("_n"))  # 65,536 a seed at most
    by = Window.partitionBy("_seed")
    upto = sizes.withColumn("_upto", F.sum("_n").over(by.orderBy("_digits"))).withColumn("_wanted", F.ceil(F.sum("_n").over(by) * F.lit(share)))
    edges = upto.where((F.col("_upto") >= F.col("_wanted")) & (F.col("_upto") - F.col("_n") < F.col("_wanted")))
    edges = edges.select(F.col("_seed").alias("_at"), digits.alias("_edge"), (F.col("_wanted") - F.col("_upto") + F.col("_n")).alias("_wanted"))
    near = keys.join(F.broadcast(edges), F.col("_seed").eqNullSafe(F.col("_at")) & (digits == F.col("_edge"))).groupBy("_seed", "_order", "_key", "_wanted").agg(F.count("*").alias("_n"))
    last = near.withColumn("_upto", F.sum("_n").over(by.orderBy("_order", "_key"))).where((F.col("_upto") >= F.col("_wanted")) & (F.col("_upto") - F.col("_n") < F.col("_wanted")))
    cuts = last.select(F.col("_seed").alias("_at"), F.struct("_order", "_key").alias("_cut"), (F.col("_upto") > F.col("_wanted")).alias("_shared")).collect()  # a row a seed
    if any(r["_shared"] for r in cuts):
        return by_order(df, key).withColumn("role", F.when(F.col("rn") <= F.ceil(F.col("n") * F.lit(share)), "test").otherwise("train")).drop("rn", "n")
    known = df.sparkSession.createDataFrame([(r["_at"], r["_cut"]) for r in cuts], last.select(F.col("_seed").alias("_at"), F.struct("_order", "_key").alias("_cut")).schema)
    upto_cut = F.struct(order.alias("_order"), F.col(key).alias("_key")) <= F.col("_cut")
    return df.join(F.broadcast(known), F.col("seed").eqNullSafe(F.col("_at")), "left").withColumn("role", F.when(upto_cut, "test").otherwise("train")).drop("_at", "_cut")


def train_test_by_threshold(df: DataFrame, key: str, share: float) -> DataFrame:
    """The same without a sort, for large tables: a row is test if its hash lies below share."""
    h = F.conv(F.substring(seeded_order(F.col("seed"), F.col(key)), 1, 8), 16, 10).cast("double") / float(1 << 32)
    return df.withColumn("role", F.when(h < share, "test").otherwise("train"))


def multiway(df: DataFrame, key: str, sizes: Sequence[tuple[str, int]], rest: str) -> DataFrame:
    """role by consecutive runs of the order: the named sizes, then rest."""
    role, upto = None, 0
    for name, size in sizes:
        upto += size
        role = F.when(F.col("rn") <= upto, name) if role is None else role.when(F.col("rn") <= upto, name)
    return by_order(df, key).withColumn("role", role.otherwise(rest)).drop("rn", "n")


def k_fold(df: DataFrame, key: str, folds: int) -> DataFrame:
    """fold = place in the seed's order modulo folds."""
    return by_order(df, key).withColumn("fold", F.pmod(F.col("rn") - 1, F.lit(folds)).cast("int")).drop("rn", "n")


def serpentine_folds(groups: DataFrame, group: str, folds: int) -> DataFrame:
    """(group, size, fold): groups by size, dealt out in serpentine order, so that no group straddles folds and fold sizes stay within one group's size."""
    sizes = groups.groupBy(group).agg(F.count("*").alias("size"))
    place = F.col("_place") - 1
    lap, at = F.floor(place / folds), F.pmod(place, F.lit(folds))
    placed = numbered(sizes.withColumn("_down", -F.col("size")), ["_down", group], "_place")
    return placed.select(group, "size", F.when(lap % 2 == 0, at).otherwise(folds - 1 - at).cast("int").alias("fold"))


def greedy_plan(classes: Sequence[tuple[int, int]], folds: int) -> list[tuple[int, int, int, list[int]]]:
    """(size, fold, groups, loads before the size) for (size, groups) by falling size, each group going to the emptiest fold, the first of equal ones.

    The emptiest fold is picked over and over, so the picks of one size are the least of the
    numbers load + i * size of all folds, in order; how many of them are a fold's is counted.
    """
    loads, plan = [0] * folds, []
    for size, n in classes:
        upto = lambda top: [max(0, -(-(top - x) // size)) for x in loads]  # noqa: B023,E731  picks below top
        low, high = min(loads), max(loads) + size * n + 1
        while high - low > 1:
            mid = (low + high) // 2
            low, high = (mid, high) if sum(upto(mid)) <= n else (low, mid)
        given = upto(low)
        left = n - sum(given)
        for f in range(folds):  # what is left are picks at exactly low, by number of fold
            if left and loads[f] <= low and (low - loads[f]) % size == 0:
                given[f], left = given[f] + 1, left - 1
        plan += [(size, f, k, list(loads)) for f, k in enumerate(given) if k]
        loads = [x + k * size for x, k in zip(loads, given, strict=True)]
    return plan


def group_folds(groups: DataFrame, group: str, folds: int) -> DataFrame:
    """(group, size, fold): the largest group goes to the emptiest fold, and so on, equal sizes by name, the first of equally empty folds; no group straddles folds.

    The driver takes in the histogram of sizes, of which there are at most sqrt(2 rows), and
    works out how many groups of each size a fold gets. When a fold takes its i-th group of a
    size follows from the loads alone, so groups meet their folds in one join, by size and
    place. A null group is one like the others; an empty table gives an empty result.
    """
    sizes = materialise(groups.groupBy(group).agg(F.count("*").alias("size")))
    classes = [(r["size"], r["n"]) for r in sizes.groupBy("size").agg(F.count("*").alias("n")).orderBy(F.desc("size")).collect()]
    plan = groups.sparkSession.createDataFrame(greedy_plan(classes, folds), "size long, fold int, n long, loads array<long>")
    picks = plan.withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    at = F.get("loads", F.col("fold")) + F.col("i") * F.col("size")

    def before(load: Column, f: Column) -> Column:
        """Picks of fold f that come before the one at this place."""
        gap = at - load
        tie = (gap >= 0) & (gap % F.col("size") == 0) & (f < F.col("fold"))
        return F.when(gap > 0, F.floor((gap + F.col("size") - 1) / F.col("size"))).otherwise(0) + tie.cast("long")

    place = F.aggregate(F.transform("loads", before), F.lit(0).cast("long"), lambda a, x: a + x)
    picks = picks.select("size", "fold", (place + 1).alias("_place"))
    return numbered(sizes, [group], "_place", ["size"]).join(picks, ["size", "_place"]).select(group, "size", "fold")


def stratified_subset(df: DataFrame, value: str, key: str, seed: int, per_bin: int, edges: DataFrame, bin_of: Column) -> DataFrame:
    """Up to per_bin rows of each value bin, by the seed's order."""
    binned = df.join(F.broadcast(edges)).withColumn("bin", bin_of)
    return binned.withColumn("_rn", F.row_number().over(Window.partitionBy("bin").orderBy(seeded_order(F.lit(seed), F.col(key)), key))).where(F.col("_rn") <= per_bin).drop("_rn")


def leave_stratum_out(df: DataFrame, stratum: str, least_train: int, least_test: int) -> DataFrame:
    """(held, n_train, n_test): strata whose leaving-out keeps both sides large enough."""
    counts = df.groupBy(F.col(stratum).alias("held")).agg(F.count("*").alias("n_test"))
    total = df.agg(F.count("*").alias("_n"))
    return counts.join(F.broadcast(total)).select("held", (F.col("_n") - F.col("n_test")).alias("n_train"), "n_test").where((F.col("n_train") >= least_train) & (F.col("n_test") >= least_test))


def winsorise(df: DataFrame, value: str, low: float = 0.025, high: float = 0.975) -> DataFrame:
    """clipped: value within its seed's percentiles, which only training rows (role = 'train') set."""
    bounds = quantiles(df.where("role = 'train'"), value, {"_low": low, "_high": high}, ["seed"])
    return df.join(F.broadcast(bounds), "seed").withColumn("clipped", F.least(F.greatest(F.col(value), F.col("_low")), F.col("_high"))).drop("_low", "_high")


def denoised(df: DataFrame, value: str, second: str, shrink: float) -> DataFrame:
    """Three denoised targets: sum of z-scores, sum of ranks, and shrinkage toward the scaled second target; training rows set all statistics, and ranks are of training rows only (null else)."""
    stats = df.where("role = 'train'").groupBy("seed").agg(F.avg(value).alias("_m"), F.stddev_pop(value).alias("_s"), F.avg(second).alias("_m2"), F.stddev_pop(second).alias("_s2"))
    z, z2 = F.try_divide(F.col(value) - F.col("_m"), "_s"), F.try_divide(F.col(second) - F.col("_m2"), "_s2")
    out = df.join(F.broadcast(stats), "seed").withColumn("z_sum", z + z2).withColumn("shrunk", (1 - shrink) * F.col(value) + shrink * (z2 * F.col("_s") + F.col("_m")))
    for name, c in (("_rank1", value), ("_rank2", second)):
        sizes = df.where("role = 'train'").groupBy("seed", c).agg(F.count("*").alias("_size"))
        out = join_null_safe(out, value_ranks(sizes, c, ["seed"], name=name), ["seed", c], "left")
    ranks = F.when(F.col("role") == "train", F.col("_rank1") + F.col("_rank2"))
    return out.withColumn("rank_sum", ranks).drop("_m", "_s", "_m2", "_s2", "_rank1", "_rank2")


def corrected(df: DataFrame, value: str, second: str, share: float = 0.15) -> DataFrame:
    """target: value, but for the share of training rows whose ranks disagree most, the scaled second target."""
    train = df.where("role = 'train'")
    placed = with_ranks(train, {"_rank1": value, "_rank2": second}, ["seed"], total="_n")
    ranked = materialise(placed.withColumn("_gap", F.abs(F.col("_rank1") - F.col("_rank2")) / F.col("_n")).drop("_rank1", "_rank2", "_n"))
    stats = quantiles(ranked, "_gap", {"_cut": 1 - share}, ["seed"]).join(train.groupBy("seed").agg(F.avg(value).alias("_m"), F.stddev_pop(value).alias("_s"), F.avg(second).alias("_m2"), F.stddev_pop(second).alias("_s2")), "seed")
    joined = ranked.join(F.broadcast(stats), "seed")
    return joined.withColumn("target", F.when(F.col("_gap") > F.col("_cut") + 1e-12, F.try_divide(F.col(second) - F.col("_m2"), "_s2") * F.col("_s") + F.col("_m")).otherwise(F.col(value))).drop("_gap", "_cut", "_m", "_s", "_m2", "_s2")


def permuted(df: DataFrame, columns: Sequence[str], key: str, seed: int) -> DataFrame:
    """Negative control: each column independently permuted among training rows of its seed, by pairing two hash orders of the same rows."""
    train, rest = df.where("role = 'train'"), df.where("role <> 'train'")
    for i, c in enumerate(columns):
        placed = lambda d, tag: numbered(d.withColumn("_order", seeded_order(F.lit(f"{seed}{tag}{i}"), F.col(key))), ["_order", key], "_at", ["seed"])  # noqa: B023,E731
        values = placed(train.select("seed", key, F.col(c).alias("_v")), "b").select("seed", "_at", "_v")
        train = placed(train.drop(c), "a").drop("_order").join(values, ["seed", "_at"]).withColumnRenamed("_v", c).drop("_at")
    return train.select(df.columns).unionByName(rest)


def bagged(df: DataFrame, key: str, members: int, rate: float = 0.8, most: int = 8) -> DataFrame:
    """(member, weight) of each row: a Poisson(rate) number of draws from the row's hash, most at most; rows without a draw are left out."""
    drawn = df.withColumn("member", F.explode(F.sequence(F.lit(0), F.lit(members - 1))))
    u = F.conv(F.substring(seeded_order(F.concat_ws("-", F.col("seed").cast("string"), F.col("member").cast("string")), F.col(key)), 1, 8), 16, 10).cast("double") / float(1 << 32)
    upto, weight = 0.0, F.lit(0)
    for k in range(most):
        upto += math.exp(-rate) * rate**k / math.factorial(k)
        weight = weight + (u >= upto).cast("int")
    return drawn.withColumn("weight", weight).where("weight > 0")


def target_statistics(df: DataFrame, pattern: str, value: str, least: int = 3) -> DataFrame:
    """(seed, site, allele, n, diff, std, median_diff): statistics of training rows by allele, against the seed's training mean; null below least rows."""
    train = df.where("role = 'train'").select("seed", value, F.posexplode(F.split(pattern, "")).alias("site", "allele")).where("allele <> ''")
    overall = df.where("role = 'train'").groupBy("seed").agg(F.avg(value).alias("_all"))
    by = ["seed", "site", "allele"]
    middle = quantiles(train, value, {"_median": 0.5}, by)  # of few groups, each a share of the seed's rows
    grouped = train.groupBy(*by).agg(F.count("*").alias("n"), F.avg(value).alias("_mean"), F.stddev_pop(value).alias("_std")).join(middle, by, "left")
    enough = F.col("n") >= least
    return grouped.join(F.broadcast(overall), "seed").select("seed", "site", "allele", "n", F.when(enough, F.col("_mean") - F.col("_all")).alias("diff"), F.when(enough, F.col("_std")).alias("std"), F.when(enough, F.col("_median") - F.col("_all")).alias("median_diff"))
