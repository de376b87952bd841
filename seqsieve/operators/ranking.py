"""Ranks: in groups by windows, and over a whole table without one window."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqsieve.plans.materialise import HOT_SHARE, materialise


def top_k(df: DataFrame, k: int, order: Sequence[Column], groups: Sequence[str] = (), name: str = "rank") -> DataFrame:
    """The first k rows in order, of each group or of the table, with their rank from 1. The order should end with a unique column."""
    if not groups:
        df = df.orderBy(*order).limit(k)  # a heap in each partition, then one of at most k rows each
        return df.withColumn(name, F.row_number().over(Window.orderBy(*order)))
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*groups).orderBy(*order))).where(F.col(name) <= k)


def _with_heads(ranged: DataFrame, groups: Sequence[str], size: Column) -> DataFrame:
    """ranged, whose _part orders it, with _head (the size of its group in earlier parts) and _total (in all parts). Nulls are a group."""
    counts = ranged.groupBy("_part", *groups).agg(F.sum(size).alias("_n"))
    by = Window.partitionBy(*groups)
    before = by.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    heads = counts.select(F.col("_part").alias("_nth"), *[F.col(g).alias(f"_nth{i}") for i, g in enumerate(groups)], F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_head"), F.sum("_n").over(by).alias("_total"))
    same = F.col("_part") == F.col("_nth")
    for i, g in enumerate(groups):
        same = same & F.col(g).eqNullSafe(F.col(f"_nth{i}"))
    return ranged.join(heads if groups else F.broadcast(heads), same).drop("_part", "_nth", *[f"_nth{i}" for i in range(len(groups))])


def numbered(df: DataFrame, order: Sequence[str], name: str = "rn", groups: Sequence[str] = (), total: str | None = None) -> DataFrame:
    """df with its row number from 1, by ascending order columns, in the table or in each group; total names a column for the number of rows there.

    A range shuffle sorts the table; the counts of its partitions, one row each (and group that
    they hold), give every partition's offset. Nothing is sorted in one task, nor is a group.
    """
    by = [*groups, *order]
    ranged = df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_part", F.spark_partition_id())
    ranged = materialise(ranged.withColumn("_in", F.row_number().over(Window.partitionBy("_part", *groups).orderBy(*order))))
    placed = _with_heads(ranged, groups, F.lit(1)).withColumn(name, F.col("_head") + F.col("_in")).drop("_in", "_head")
    return placed.withColumnRenamed("_total", total) if total else placed.drop("_total")


def value_ranks(sizes: DataFrame, value: str, groups: Sequence[str] = (), size: str = "_size", name: str = "rank", first: str | None = None, total: str | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """(groups, value, rank, keep): average ranks of distinct values, of which sizes has one row with the number of its rows. No group is sorted in one task; nulls come first.

    first names a column for the least rank of the value's rows, total one for the rows of the group; keep names columns of sizes that stay, or _size.
    """
    by = [*groups, value]
    ranged = sizes.select(*by, F.col(size).alias("_size"), *[c for c in keep if c != "_size"]).repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_part", F.spark_partition_id())
    upto = F.sum("_size").over(Window.partitionBy("_part", *groups).orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    placed = _with_heads(materialise(ranged.withColumn("_upto", upto)), groups, F.col("_size"))
    last = F.col("_head") + F.col("_upto")
    more = [(last - F.col("_size") + 1).alias(first)] if first else []
    return placed.select(*by, (last - (F.col("_size") - 1) / F.lit(2.0)).alias(name), *more, *([F.col("_total").alias(total)] if total else []), *keep)


def average_ranks(df: DataFrame, value: str, groups: Sequence[str] = (), name: str = "rank", first: str | None = None, total: str | None = None) -> DataFrame:
    """df with the average rank of value in the table or in each group, however large: value_ranks joined back. Equal values share the mean of their ranks from 1."""
    return with_ranks(df, {name: value}, groups, first, total)


def with_ranks(df: DataFrame, ranks: Mapping[str, str], groups: Sequence[str] = (), first: str | None = None, total: str | None = None) -> DataFrame:
    """df with several average ranks, as {rank: value}, whose names df doesn't have; first is a prefix for the names of the least ranks, total names a column for the rows of the group."""
    out = df
    for i, (name, value) in enumerate(ranks.items()):
        sizes = df.groupBy(*groups, value).agg(F.count("*").alias("_size"))
        least = first and (first + name if len(ranks) > 1 else first)
        out = join_sized(out, value_ranks(sizes, value, groups, name=name, first=least, total=None if i else total, keep=["_size"]), [*groups, value])
    return out


def quantiles(df: DataFrame, value: str, shares: Mapping[str, float], groups: Sequence[str] = ()) -> DataFrame:
    """(groups, a column per share): exact quantiles of the table or of each group, between two rows in proportion. Nulls don't count; a group without a value has no row, a table without one has nulls.

    A group's distinct values are ranked by a range shuffle, never held in one aggregate's buffer.
    """
    sizes = df.where(F.col(value).isNotNull()).groupBy(*groups, value).agg(F.count("*").alias("_size"))
    placed = value_ranks(sizes, value, groups, name="_mid", first="_first", total="_n")
    last = 2 * F.col("_mid") - F.col("_first")

    def at(place: Column) -> Column:
        return F.max(F.when((F.col("_first") <= place + 1) & (place + 1 <= last), F.col(value).cast("double")))

    cuts = []
    for name, share in shares.items():
        exact = F.lit(float(share)) * (F.col("_n") - 1)
        low, part = F.floor(exact), F.max(exact - F.floor(exact))
        below, above = at(low), at(F.ceil(exact))
        cuts.append(F.when(below == above, below).otherwise(below + (above - below) * part).alias(name))
    return placed.groupBy(*groups).agg(*cuts)


def join_null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on keys that both sides have, where null meets null; the keys stay once."""
    other = right.withColumnsRenamed({k: f"_right_{k}" for k in keys})
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_right_{k}"))
    return left.join(other, same, how).drop(*[f"_right_{k}" for k in keys])


def join_sized(rows: DataFrame, sized: DataFrame, keys: Sequence[str], size: str = "_size") -> DataFrame:
    """Inner null-safe join of rows to the one row of sized for their keys, which counts them as size; size goes.

    Keys of more than 1 / HOT_SHARE of all rows, fewer than HOT_SHARE, are broadcast, so a value
    that many rows share is no task of its own. sized is read again, and rows too if there are such keys.
    """
    bar = (sized.agg(F.sum(size)).first()[0] or 0) / HOT_SHARE
    hot, cold = sized.where(F.col(size) > bar).drop(size), sized.where(F.col(size) <= bar).drop(size)
    if hot.isEmpty():
        return join_null_safe(rows, cold, keys)
    rest = join_null_safe(rows, F.broadcast(hot.select(*keys)), keys, "left_anti")
    return join_null_safe(rows, F.broadcast(hot), keys).unionByName(join_null_safe(rest, cold, keys))


def seeded_order(seed: Column, key: Column) -> Column:
    """A pseudo-random order that any engine reproduces: md5 of 'seed:key'."""
    return F.md5(F.concat_ws(":", seed.cast("string"), key.cast("string")).cast("binary"))


def quantile_bin(value: Column, edges: Column) -> Column:
    """Right-closed bin of a value: the number of distinct interior edges below it."""
    inner = F.array_distinct(edges)
    return F.size(F.filter(F.slice(inner, 2, F.greatest(F.size(inner) - 2, F.lit(0))), lambda e: e < value))


def decile(rn: Column, n: Column, bins: int = 10) -> Column:
    """Bin d of row rn (from 1) of n, where bin d holds the rows from int(d n / bins) to int((d + 1) n / bins)."""
    return F.floor((bins * rn - 1) / n).cast("int")


def inverse_normal(p: Column) -> Column:
    """Quantile of the standard normal distribution, by a rational approximation with an error below 1.2e-9."""
    # Coefficients of the approximation's central and tail parts.
    a = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00)
    b = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01)
    c = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00)
    d = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00)

    def poly(x: Column, parts: Sequence[float]) -> Column:
        out = F.lit(parts[0])
        for v in parts[1:]:
            out = out * x + v
        return out

    q, low = p - 0.5, 0.02425
    centre = poly(q * q, a) * q / poly(q * q, (*b, 1.0))

    def tail(x: Column) -> Column:
        r = F.sqrt(-2.0 * F.log(x))
        return poly(r, c) / poly(r, (*d, 1.0))

    return F.when(p < low, tail(p)).when(p > 1 - low, -tail(1 - p)).otherwise(centre)
