"""Table contracts: keys, finite values, formulas, profiles, digests, coverage, partitions."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def not_finite(c: Column) -> Column:
    return c.isNull() | F.isnan(c) | (F.abs(c) == F.lit(float("inf")))


def key_contract(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row: rows, rows with a missing key, and rows that repeat a key. The distinct count is a grouped count, so no set of keys gathers anywhere."""
    missing = None
    for k in keys:
        missing = F.col(k).isNull() if missing is None else missing | F.col(k).isNull()
    groups = df.groupBy(*keys).agg(F.count("*").alias("_n")).withColumn("_missing", missing)
    return groups.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("n_rows"), F.coalesce(F.sum(F.when(F.col("_missing"), F.col("_n")).otherwise(0)), F.lit(0)).alias("n_missing"), F.coalesce(F.sum(F.when(F.col("_missing"), 0).otherwise(F.col("_n") - 1)), F.lit(0)).alias("n_repeated"))


def finite_contract(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, n_bad) of values that are null, NaN or infinite."""
    counts = df.agg(*[F.sum(not_finite(F.col(c)).cast("int")).cast("long").alias(c) for c in columns])
    return counts.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("n_bad")) for c in columns])).alias("r")).select("r.*")


def allowed_columns(names: Sequence[str], *, required: Sequence[str] = (), forbidden: Sequence[str] = (), prefixes: Sequence[str] = ()) -> list[str]:
    """Names that have one of the prefixes (all if none is given); raises if a required one is missing or a forbidden one is present."""
    if lost := [c for c in required if c not in names]:
        raise ValueError(f"columns are missing: {lost}")
    if found := [c for c in names if c in forbidden]:
        raise ValueError(f"columns must not be features: {found}")
    return [c for c in names if not prefixes or c.startswith(tuple(prefixes))]


def column_blocks(names: Sequence[str], patterns: Sequence[tuple[str, str]]) -> dict[str, str]:
    """Block of each column: the first (block, regex) whose regex matches, else _unassigned."""
    return {c: next((block for block, p in patterns if re.search(p, c)), "_unassigned") for c in names}


def formula_check(df: DataFrame, left: Column, right: Column, atol: float, rtol: float = 1e-5) -> DataFrame:
    """One row: whether all rows agree within atol + rtol |right|, the largest difference, and the ranges of both sides."""
    gap = F.abs(left - right)
    return df.agg(F.bool_and(gap <= atol + rtol * F.abs(right)).alias("agrees"), F.max(gap).alias("max_abs_diff"), F.sum((gap > atol + rtol * F.abs(right)).cast("int")).cast("long").alias("n_off"), F.min(left).alias("min_left"), F.max(left).alias("max_left"))


def hash_number(c: Column) -> Column:
    """The first 32 bits of md5 as a long."""
    return F.conv(F.substring(F.md5(c.cast("binary")), 1, 8), 16, 10).cast("long")


def content_hash(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row: rows and an order-free sum of row hashes over the columns' text forms; nulls differ from texts."""
    row = F.concat_ws("|", *[F.coalesce(F.concat(F.lit("v"), F.col(c).cast("string")), F.lit("n")) for c in columns])
    return df.agg(F.count("*").alias("n_rows"), F.coalesce(F.sum(hash_number(row)), F.lit(0)).alias("content"))


def set_digest(df: DataFrame, value: str) -> DataFrame:
    """One row: sha256 of a set. The distinct values are dealt into 4096 buckets by hash; each is sorted and hashed, and the list of bucket hashes is hashed again."""
    distinct = df.select(F.col(value).alias("_v")).where("_v IS NOT NULL").distinct()
    parts = distinct.groupBy(F.substring(F.md5(F.col("_v").cast("binary")), 1, 3).alias("_b")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list("_v")), "\n"), 256).alias("_d"))
    return parts.agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_b", "_d"))), lambda x: x["_d"]), "\n"), 256).alias("digest"))


def profile(df: DataFrame, numeric: Sequence[str], text: Sequence[str] = ()) -> DataFrame:
    """(column, n, missing, n_distinct, low, high, mean, std) in long form; low and high are lengths for text columns. Distinct counts are exact."""
    out = None
    for c in [*numeric, *text]:
        v = F.col(c).cast("double") if c in numeric else F.length(c).cast("double")
        counts = df.groupBy(c).agg(F.count("*").alias("_n")).withColumn("_v", v)
        n, total = F.sum("_n"), F.sum(F.when(F.col(c).isNotNull(), F.col("_n")))
        mean = F.try_divide(F.sum(F.col("_v") * F.col("_n")), total)
        one = counts.agg(F.lit(c).alias("column"), n.alias("n"), (n - F.coalesce(total, F.lit(0))).alias("missing"), F.count(c).alias("n_distinct"), F.min("_v").alias("low"), F.max("_v").alias("high"), mean.alias("mean"), F.sqrt(F.greatest(F.lit(0.0), F.try_divide(F.sum(F.col("_v") * F.col("_v") * F.col("_n")) - mean * mean * total, total - 1))).alias("std"))
        out = one if out is None else out.unionByName(one)
    return out


def coverage(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """One row: keys on both sides, keys of left that right lacks, and keys of right that left lacks."""
    a, b = left.select(key).distinct().withColumn("_l", F.lit(1)), right.select(key).distinct().withColumn("_r", F.lit(1))
    return a.join(b, key, "full_outer").agg(F.coalesce(F.sum(F.col("_l") * F.col("_r")), F.lit(0)).alias("n_both"), F.coalesce(F.sum(F.when(F.col("_r").isNull(), 1)), F.lit(0)).cast("long").alias("n_missing"), F.coalesce(F.sum(F.when(F.col("_l").isNull(), 1)), F.lit(0)).cast("long").alias("n_extra"))


def partition_check(parts: DataFrame, full: DataFrame, key: str, split: str) -> DataFrame:
    """One row: keys in two splits, keys of full in none, and keys of splits that full lacks."""
    held = parts.groupBy(key).agg(F.countDistinct(split).alias("_s"))
    both = held.join(full.select(key).distinct().withColumn("_f", F.lit(1)), key, "full_outer")
    one = lambda c: F.coalesce(F.sum(F.when(c, 1).otherwise(0)), F.lit(0)).cast("long")
    return both.agg(one(F.col("_s") > 1).alias("n_overlapping"), one(F.col("_s").isNull()).alias("n_uncovered"), one(F.col("_f").isNull()).alias("n_foreign"))


def reconcile(left: DataFrame, right: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """One row: matched rows, largest difference, rows only on the left and only on the right."""
    a = left.select(*keys, F.col(value).alias("_a"), F.lit(1).alias("_l"))
    b = right.select(*keys, F.col(value).alias("_b"), F.lit(1).alias("_r"))
    one = lambda c: F.coalesce(F.sum(F.when(c, 1).otherwise(0)), F.lit(0)).cast("long")
    return a.join(b, list(keys), "full_outer").agg(one(F.col("_l").isNotNull() & F.col("_r").isNotNull()).alias("n_both"), F.max(F.abs(F.col("_a") - F.col("_b"))).alias("max_abs_diff"), one(F.col("_r").isNull()).alias("n_left_only"), one(F.col("_l").isNull()).alias("n_right_only"))


def differences(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows of either table that the other lacks, counted with repeats, with the side they stand on."""
    return left.exceptAll(right).withColumn("side", F.lit("left")).unionByName(right.exceptAll(left).withColumn("side", F.lit("right")))


def first_match(rules: Sequence[tuple[Column, str]], default: str) -> Column:
    """The label of the first condition that holds."""
    out = None
    for condition, label in rules:
        out = F.when(condition, F.lit(label)) if out is None else out.when(condition, F.lit(label))
    return F.lit(default) if out is None else out.otherwise(F.lit(default))
