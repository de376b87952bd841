"""Dot-bracket structures, ensemble defects, and score expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqsieve.functions.constants import HYBRID_ENERGY, HYBRID_GAP


def partners(df: DataFrame, key: str, structure: str) -> DataFrame:
    """(key, i, j) of each position (from 0): the partner of a bracket, -1 of a dot or an unmatched bracket.

    The k-th opening bracket that reaches a depth pairs with the k-th closing one that leaves it.
    """
    chars = df.select(key, F.posexplode(F.split(structure, "")).alias("i", "c")).where("c <> ''")
    by = Window.partitionBy(key).orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    step = F.when(F.col("c") == "(", 1).when(F.col("c") == ")", -1).otherwise(0)
    deep = chars.withColumn("after", F.sum(step).over(by)).withColumn("level", F.when(F.col("c") == ")", F.col("after") + 1).otherwise(F.col("after")))
    order = Window.partitionBy(key, "level", "c").orderBy("i")
    numbered = deep.withColumn("k", F.row_number().over(order))
    opens = numbered.where("c = '('").select(key, "level", "k", F.col("i").alias("a"))
    closes = numbered.where("c = ')'").select(key, "level", "k", F.col("i").alias("b"))
    pairs = opens.join(closes.hint("merge"), [key, "level", "k"])  # exploded rows are far more than their source's bytes tell: none is broadcast
    both = pairs.select(key, F.col("a").alias("i"), F.col("b").alias("j")).unionByName(pairs.select(key, F.col("b").alias("i"), F.col("a").alias("j")))
    return chars.select(key, "i").join(both.hint("merge"), [key, "i"], "left").select(key, "i", F.coalesce("j", F.lit(-1)).alias("j"))


def ensemble_defect(target: DataFrame, probabilities: DataFrame, key: str) -> DataFrame:
    """(key, n, defect): n less the sum of the target pairs' probabilities, cut to 0..1. probabilities (key, i, j, p) hold the unpaired probability at j = i."""
    wanted = target.withColumn("j", F.when(F.col("j") < 0, F.col("i")).otherwise(F.col("j")))
    p = wanted.join(probabilities.hint("merge"), [key, "i", "j"], "left").withColumn("p", F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce("p", F.lit(0.0)))))
    return p.groupBy(key).agg(F.count("*").alias("n"), (F.count("*") - F.sum("p")).alias("defect"))


def hybrid(gap: Column, energy: Column) -> Column:
    return gap * HYBRID_GAP + energy * HYBRID_ENERGY


def lower_bound(mu: Column, sigma: Column, beta: Column | float) -> Column:
    return mu - sigma * beta


def valid_prediction(mu: Column, sigma: Column) -> Column:
    """A finite prediction and, if there is one, a finite spread that isn't negative."""
    fine = lambda c: ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))
    return F.coalesce(mu.isNotNull() & fine(mu) & (sigma.isNull() | (fine(sigma) & (sigma >= 0))), F.lit(False))
