"""Metrics, paired comparisons and completeness over long tables."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqsieve.operators.ranking import decile, join_null_safe, join_sized, numbered, quantiles, value_ranks
from seqsieve.plans.materialise import materialise


def correlation(x: Column | str, y: Column | str) -> Column:
    """Pearson correlation as an aggregate; null without variance on either side, where corr would divide by zero."""
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def error_metrics(truth: str = "truth", pred: str = "pred") -> list[Column]:
    """Aggregates n, pearson, r2, mae, rmse; pearson and r2 are null without variance."""
    t, p = F.col(truth), F.col(pred)
    squares = F.sum((t - p) * (t - p))
    return [
        F.count("*").alias("n"),
        correlation(t, p).alias("pearson"),
        (1 - F.try_divide(squares, F.count("*") * F.var_pop(t))).alias("r2"),
        F.avg(F.abs(t - p)).alias("mae"),
        F.sqrt(F.avg((t - p) * (t - p))).alias("rmse"),
    ]


def histogram(df: DataFrame, value: str) -> DataFrame:
    """(value, n): rows of each value of a column of few different values; nulls are a value."""
    return df.groupBy(value).agg(F.count("*").alias("n"))


def distribution(df: DataFrame, groups: Sequence[str], value: str) -> DataFrame:
    """(groups, n, low, p05, median, mean, p95, high) of the table or of each group, however large; all but n are null without a value."""
    sums = df.groupBy(*groups).agg(F.count("*").alias("n"), F.min(value).alias("low"), F.avg(value).alias("mean"), F.max(value).alias("high"))
    return join_null_safe(sums, quantiles(df, value, {"p05": 0.05, "median": 0.5, "p95": 0.95}, groups), groups, "left")


def spearman(df: DataFrame, groups: Sequence[str], truth: str = "truth", pred: str = "pred", degenerate: float | None = None, name: str = "spearman") -> DataFrame:
    """Rank correlation per group with average ranks; groups without variance or with fewer than 2 rows give degenerate.

    Ranks are of distinct values, so a group may be larger than a task and a value may be most of it:
    only the ranks of truth meet the rows, whose weights and ranks are then summed for each value of pred.
    """
    cells = materialise(df.select(*groups, F.col(truth).alias("_x"), F.col(pred).alias("_y")).groupBy(*groups, "_x", "_y").agg(F.count("*").alias("_w")))
    truths = value_ranks(cells.groupBy(*groups, "_x").agg(F.sum("_w").alias("_size")), "_x", groups, name="_t", keep=["_size"])
    return rank_correlation(truths, join_sized(cells, truths, [*groups, "_x"]), groups, degenerate, name)


def rank_correlation(truths: DataFrame, rows: DataFrame, groups: Sequence[str], degenerate: float | None, name: str) -> DataFrame:
    """(groups, name) of rows (groups, _t, _y, _w), the rank of the truth, the prediction and a weight, and of truths (groups, _t, _size), a row for each value of the truth."""
    preds = value_ranks(rows.groupBy(*groups, "_y").agg(F.sum("_w").alias("_size"), F.sum(F.col("_w") * F.col("_t")).alias("_wt")), "_y", groups, name="_p", keep=["_size", "_wt"])

    def sums(ranked: DataFrame, rank: str, *more: Column) -> DataFrame:
        r, n = F.col(rank), F.col("_size")
        return ranked.groupBy(*groups).agg(F.sum(n).alias(f"_n{rank}"), F.sum(n * r).alias(f"_1{rank}"), F.sum(n * r * r).alias(f"_2{rank}"), (F.min(r) < F.max(r)).alias(f"_varied{rank}"), *more)

    both = sums(preds, "_p", F.sum(F.col("_wt") * F.col("_p")).alias("_tp"))
    both = join_null_safe(both, sums(truths, "_t"), groups)
    n = F.col("_n_t")

    def product(ab: str, a: str, b: str) -> Column:
        return F.col(ab) / n - (F.col(a) / n) * (F.col(b) / n)

    found = F.when(F.col("_varied_t") & F.col("_varied_p"), F.try_divide(product("_tp", "_1_t", "_1_p"), F.sqrt(product("_2_t", "_1_t", "_1_t")) * F.sqrt(product("_2_p", "_1_p", "_1_p"))))
    return both.select(*groups, F.coalesce(found, F.lit(degenerate).cast("double")).alias(name))


def weighted_inversions(values: np.ndarray, weights: np.ndarray) -> float:
    """Sum of the products of weights over the pairs of places in which a larger value stands before a smaller one; n log² n, by merging sorted runs."""
    found, width, n = 0.0, 1, len(values)
    values, weights = values.copy(), weights.astype(float)
    while width < n:
        for at in range(0, n - width, 2 * width):
            both = slice(at, at + 2 * width)
            left, right = values[at : at + width], values[at + width : at + 2 * width]
            upto = np.concatenate([[0.0], np.cumsum(weights[at : at + width])])
            found += float(((upto[-1] - upto[np.searchsorted(left, right, side="right")]) * weights[at + width : at + 2 * width]).sum())
            order = np.argsort(values[both], kind="stable")
            values[both], weights[both] = values[both][order], weights[both][order]
        width *= 2
    return found


def _discordant(rows: DataFrame, by: Sequence[str], groups: Sequence[str], first: str, second: str) -> DataFrame:
    """(groups, _bad): the weighted inversions of second, in order of first and second, within each set of rows with equal by."""
    kinds = dict(rows.dtypes)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        at = pdf.sort_values([first, second])
        return pdf[list(groups)].head(1).assign(_bad=weighted_inversions(at[second].to_numpy(), at["_w"].to_numpy()))

    used = list(dict.fromkeys([*groups, *by, first, second, "_w"]))
    return rows.select(*used).groupBy(*groups, *by).applyInPandas(run, ", ".join([*(f"`{g}` {kinds[g]}" for g in groups), "_bad double"]))


def kendall(df: DataFrame, groups: Sequence[str], truth: str = "truth", pred: str = "pred", block: int = 1 << 17, blocks: int = 1024) -> DataFrame:
    """Kendall's tau-b per group; null without variance. Rows with a null on either side are left out.

    Discordant pairs are counted in pieces, as a group may be larger than a task. Distinct
    (truth, pred) have a place by either side, and places are cut into blocks. A pair lies in one
    block by truth, or else in one block by pred, or differs in both: then the counts of the
    blocks' crossings, at most blocks² a group, tell it. A piece holds block places, or a
    blocks-th of the largest group.
    """
    known = df.select(*groups, F.col(truth).alias("_x"), F.col(pred).alias("_y")).where("_x IS NOT NULL AND _y IS NOT NULL")
    cells = materialise(known.groupBy(*groups, "_x", "_y").agg(F.count("*").alias("_w")))
    largest = cells.groupBy(*groups).count().agg(F.max("count")).first()[0] or 0
    size = max(block, -(-largest // blocks))
    placed = numbered(numbered(cells, ["_x", "_y"], "_i", groups), ["_y", "_x"], "_j", groups)
    placed = materialise(placed.withColumn("_a", F.expr(f"(_i - 1) div {size}")).withColumn("_b", F.expr(f"(_j - 1) div {size}")))
    crossings = placed.groupBy(*groups, "_a", "_b").agg(F.sum("_w").alias("_w"))
    bad = [_discordant(placed, ["_a"], groups, "_i", "_j"), _discordant(placed, ["_b"], groups, "_a", "_j"), _discordant(crossings, [], groups, "_a", "_b")]

    def pairs(count: str) -> Column:
        c = F.col(count).cast("double")
        return c * (c - 1) / 2

    nothing = {k: F.lit(0.0) for k in ("_all", "_tx", "_ty", "_txy", "_bad")}

    def part(rows: DataFrame, **given: Column) -> DataFrame:
        return rows.select(*groups, *[v.alias(k) for k, v in {**nothing, **given}.items()])

    sums = part(df.groupBy(*groups).agg(F.count(F.when(F.col(truth).isNotNull() & F.col(pred).isNotNull(), 1)).alias("_n")), _all=pairs("_n"))
    sums = sums.unionByName(part(cells, _txy=pairs("_w")))
    for value, tied in (("_x", "_tx"), ("_y", "_ty")):
        sums = sums.unionByName(part(cells.groupBy(*groups, value).agg(F.sum("_w").alias("_n")), **{tied: pairs("_n")}))
    for rows in bad:
        sums = sums.unionByName(part(rows, _bad=F.col("_bad")))
    s = {k: F.sum(k) for k in nothing}
    below = F.sqrt(s["_all"] - s["_tx"]) * F.sqrt(s["_all"] - s["_ty"])
    return sums.groupBy(*groups).agg(F.try_divide(s["_all"] - s["_tx"] - s["_ty"] + s["_txy"] - 2 * s["_bad"], below).alias("kendall"))


def top_k_recall(df: DataFrame, groups: Sequence[str], fraction: float, truth: str = "truth", pred: str = "pred", key: str = "id") -> DataFrame:
    """Share of the truly best k (smallest) among the k predicted best, k = max(1, half-even rounded fraction of n)."""
    by_truth = numbered(df.select(*groups, truth, pred, key), [truth, key], "_t", groups, total="_n")
    k = F.greatest(F.lit(1), F.bround(F.col("_n") * F.lit(float(fraction)), 0)).cast("long")
    ranked = numbered(by_truth, [pred, key], "_p", groups).withColumn("_k", k)
    return ranked.groupBy(*groups).agg(F.max("_k").alias("k"), (F.sum(((F.col("_t") <= F.col("_k")) & (F.col("_p") <= F.col("_k"))).cast("int")) / F.max("_k")).alias("recall"))


def error_by_decile(df: DataFrame, groups: Sequence[str], spread: str, error: Column, key: str) -> DataFrame:
    """Mean error and count in each decile of a group by spread."""
    cut = numbered(df, [spread, key], "_at", groups, total="_n").withColumn("decile", decile(F.col("_at"), F.col("_n")))
    return cut.groupBy(*groups, "decile").agg(F.count("*").alias("n"), F.avg(error).alias("error"))


def _mixed(x: np.ndarray) -> np.ndarray:
    """A well mixed hash of 64-bit integers."""
    x = x + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _draws(seed: int, places: np.ndarray, resamples: np.ndarray) -> np.ndarray:
    """(resample, place) hashes."""
    return _mixed(_mixed(places.astype(np.uint64) + _mixed(np.array([seed], np.uint64))) + (resamples.astype(np.uint64) << np.uint64(32))[:, None])


#: Numbers drawn at once, and the distribution function of the Poisson law with mean 1.
DRAWN = 1 << 20
POISSON = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(20)])


def _small_means(values: np.ndarray, resamples: int, seed: int) -> np.ndarray:
    """Means of resamples of values, each of as many draws."""
    n, out = len(values), np.empty(resamples)
    places, size = np.arange(n), max(1, DRAWN // max(1, len(values)))
    for at in range(0, resamples, size):
        some = np.arange(at, min(at + size, resamples))
        out[some] = values[(_draws(seed, places, some) % np.uint64(n)).astype(np.int64)].mean(axis=1)
    return out


def _weight_table() -> tuple[np.ndarray, np.ndarray]:
    """(least 53-bit draw of each weight from 1, weight of each value of the highest 16 bits, 255 where the bits below decide)."""
    least = np.ceil(POISSON * 2.0**53).astype(np.uint64)
    low = np.arange(1 << 16).astype(np.uint64) << np.uint64(37)
    first, last = (np.searchsorted(least, x, side="right") for x in (low, low + np.uint64((1 << 37) - 1)))
    return least, np.where(first == last, first, 255).astype(np.uint8)


LEAST, WEIGHTS = _weight_table()
#: Draws held at once by weighted sums, so that they stay in a core's cache.
CACHED = 1 << 17


def _weighted_sums(values: np.ndarray, places: np.ndarray, resamples: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(sums of values, sums of weights) of each resample, in which each value has a Poisson weight of its own.

    The draws are those of _draws, made in place; the highest 16 bits, which its last step
    leaves alone, give nearly all weights by a table, and the rest is drawn whole.
    """
    heads = _mixed(places.astype(np.uint64) + _mixed(np.array([seed], np.uint64))) + np.uint64(0x9E3779B97F4A7C15)
    steps = (np.arange(resamples).astype(np.uint64) << np.uint64(32))[:, None]
    both = np.column_stack([values, np.ones(len(values))])
    out, size = np.zeros((resamples, 2)), max(1, CACHED // resamples)
    for at in range(0, len(values), size):
        x = steps + heads[at : at + size]
        t = x >> np.uint64(30)
        x ^= t
        x *= np.uint64(0xBF58476D1CE4E5B9)
        np.right_shift(x, np.uint64(27), out=t)
        x ^= t
        x *= np.uint64(0x94D049BB133111EB)
        np.right_shift(x, np.uint64(48), out=t)
        w = WEIGHTS.take(t.view(np.int64))
        open_ = np.flatnonzero(w == 255)
        y = x.reshape(-1)[open_]
        w.reshape(-1)[open_] = np.searchsorted(LEAST, (y ^ (y >> np.uint64(31))) >> np.uint64(11), side="right")
        out += w.astype(np.float64) @ both[at : at + size]
    return out[:, 0], out[:, 1]


#: Rows of a group of which one task draws the weights.
WEIGHED = 250_000


def bootstrap_ci(df: DataFrame, groups: Sequence[str], value: str, resamples: int = 1000, seed: int = 0, packed: int = 10_000) -> DataFrame:
    """Mean and 95 % bootstrap interval of the mean per group; null and non-finite values are left out.

    A group of at most packed rows is resampled whole in one task, n draws each time. A larger
    one is never gathered: each task adds up, for every resample, its rows weighted by Poisson
    numbers, and only these sums, two per resample, task and group, are shuffled and added.
    That is the bootstrap with a random size of mean n, whose interval differs by less than
    the resampling itself from 10,000 rows on. Draws are hashes of the row's number in its
    group by value, so runs repeat.
    """
    groups = list(groups)
    fine = df.where(F.col(value).isNotNull() & ~F.isnan(value) & (F.abs(F.col(value)) < F.lit(float("inf"))))
    rows = fine.select(*groups, F.col(value).cast("double").alias("_v"), F.xxhash64(*df.columns).alias("_salt"))  # equal values lie in many ranges
    ranked = materialise(numbered(rows, ["_v", "_salt"], "_i", groups, total="_n").select(*groups, "_i", "_n", "_v"))
    named = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in ranked.select(*groups).schema)
    names = [*groups, "n", "ci_low", "ci_high"]

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by group and place; a group may run over batches."""
        held: list[pa.RecordBatch] = []

        def done() -> pa.RecordBatch:
            values = np.concatenate([b["_v"].to_numpy() for b in held])
            low, high = np.percentile(_small_means(values, resamples, seed), [2.5, 97.5])
            return pa.RecordBatch.from_arrays([*[held[0][g].slice(0, 1) for g in groups], *map(pa.array, ([len(values)], [low], [high]))], names)

        for batch in batches:
            first = batch["_i"].to_numpy() == 1
            cuts = [*np.flatnonzero(first).tolist(), batch.num_rows]
            if cuts[0] and held:
                held.append(batch.slice(0, cuts[0]))
            for x, y in zip(cuts[:-1], cuts[1:], strict=True):
                if held:
                    yield done()
                held = [batch.slice(x, y - x)]
        if held:
            yield done()

    def partly(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One row for each group of a task, which has few, as rows come by range."""
        held: dict[tuple, list] = {}
        for batch in batches:
            # numbers of the groups in the batch, whatever their types
            kinds = pa.Table.from_batches([batch]).select(groups).append_column("_row", pa.array(np.arange(batch.num_rows)))
            firsts = kinds.group_by(groups).aggregate([("_row", "list")])["_row_list"].to_pylist() if groups else [list(range(batch.num_rows))] if batch.num_rows else []
            for at in firsts:
                own = batch.take(pa.array(at))
                found = _weighted_sums(own["_v"].to_numpy(), own["_i"].to_numpy(), resamples, seed)
                name = tuple(str(own[g][0]) if own[g][0].is_valid else None for g in groups)
                known = held.setdefault(name, [own.slice(0, 1), np.zeros(resamples), np.zeros(resamples)])
                known[1] += found[0]
                known[2] += found[1]
        for own, sums, weights in held.values():
            yield pa.RecordBatch.from_arrays([*[own[g] for g in groups], own["_n"], pa.array([sums.tolist()], pa.list_(pa.float64())), pa.array([weights.tolist()], pa.list_(pa.float64()))], [*groups, "n", "sums", "weights"])

    small = ranked.where(F.col("_n") <= packed)
    small = (small.repartition(*groups) if groups else small.coalesce(1)).sortWithinPartitions(*groups, "_i")  # packed rows at most
    bounds = small.mapInArrow(whole, f"{named}n long, ci_low double, ci_high double")
    more = ranked.where(F.col("_n") > packed)
    # a row costs as many draws as there are resamples, whatever its bytes
    tasks = max(2 * df.sparkSession.sparkContext.defaultParallelism, more.count() // WEIGHED)
    parts = more.repartitionByRange(tasks, *groups, "_i").mapInArrow(partly, f"{named}n long, sums array<double>, weights array<double>")
    each = parts.select(*groups, "n", F.posexplode(F.arrays_zip("sums", "weights")).alias("_b", "_s")).groupBy(*groups, "n", "_b").agg((F.sum("_s.sums") / F.sum("_s.weights")).alias("_m"))
    cut = F.percentile("_m", F.array(F.lit(0.025), F.lit(0.975)))  # of as many rows as resamples
    large = each.groupBy(*groups, "n").agg(F.get(cut, 0).alias("ci_low"), F.get(cut, 1).alias("ci_high"))
    centre = fine.groupBy(*groups).agg(F.avg(value).alias("mean"))
    if not groups:  # one row each, or none
        return bounds.unionByName(large).crossJoin(F.broadcast(centre)).select("n", "mean", "ci_low", "ci_high")
    return join_null_safe(bounds.unionByName(large), centre, groups).select(*groups, "n", "mean", "ci_low", "ci_high")


def paired_deltas(df: DataFrame, keys: Sequence[str], variant: str, control: str, value: str = "value") -> DataFrame:
    """Rows of all variants but the control with delta = value - the control's value of the same keys (inner join)."""
    base = df.where(F.col(variant) == control).select(*keys, F.col(value).alias("control_value"))
    return df.where(F.col(variant) != control).join(base, list(keys)).withColumn("delta", F.col(value) - F.col("control_value"))


def paired_summary(deltas: DataFrame, groups: Sequence[str], tolerance: float = 1e-12, exclusive: bool = True, resamples: int = 0, seed: int = 0) -> DataFrame:
    """n, mean, median, quartiles, wins (delta < 0), ties and losses; with resamples the bootstrap interval of the mean, ci_low and ci_high. exclusive keeps deltas inside the tolerance out of wins and losses."""
    d = F.col("delta")
    tie = F.abs(d) <= tolerance
    one = lambda c: F.sum(c.cast("int"))
    sums = deltas.groupBy(*groups).agg(
        F.count("*").alias("n"), F.avg(d).alias("mean_delta"),
        one((d < 0) & ~tie if exclusive else d < 0).alias("wins"), one(tie).alias("ties"), one((d > 0) & ~tie if exclusive else d > 0).alias("losses"),
    )
    out = join_null_safe(sums, quantiles(deltas, "delta", {"median_delta": 0.5, "q25": 0.25, "q75": 0.75}, groups), groups, "left")
    if resamples:
        out = join_null_safe(out, bootstrap_ci(deltas, groups, "delta", resamples, seed).select(*groups, "ci_low", "ci_high"), groups, "left")
    return out


def gates(summary: DataFrame, max_drop: float, control_bound: float | None = None) -> DataFrame:
    """summary (mean_delta, ci_low, ci_high, smaller deltas being better) with flags: better (the interval lies below zero), worse (above), holds (the mean is at most max_drop above zero), and with a control_bound also quiet (no end of the interval is farther than it from zero, as of a negative control). A null interval sets none but holds."""
    one = lambda c: F.coalesce(c, F.lit(False))
    out = summary.withColumns({"better": one(F.col("ci_high") < 0), "worse": one(F.col("ci_low") > 0), "holds": one(F.col("mean_delta") <= max_drop)})
    return out if control_bound is None else out.withColumn("quiet", one(F.greatest(F.abs("ci_low"), F.abs("ci_high")) < control_bound))


def tail_stats(deltas: DataFrame, groups: Sequence[str], key: str, share: float = 0.1) -> DataFrame:
    """Means of the best (smallest) and worst deltas, max(1, round(share n)) of each, and their parts of the total."""
    placed = numbered(deltas, ["delta", key], "_up", groups, total="_n")
    r = placed.withColumn("_k", F.greatest(F.lit(1), F.bround(F.col("_n") * F.lit(share), 0))).withColumn("_down", F.col("_n") + 1 - F.col("_up"))
    best, worst = F.when(F.col("_up") <= F.col("_k"), F.col("delta")), F.when(F.col("_down") <= F.col("_k"), F.col("delta"))
    total = F.sum("delta")
    return r.groupBy(*groups).agg(F.max("_k").cast("long").alias("k"), F.avg(best).alias("best_mean"), F.avg(worst).alias("worst_mean"), F.try_divide(F.sum(best), total).alias("best_share"), F.try_divide(F.sum(worst), total).alias("worst_share"))


def completeness(observed: DataFrame, dimensions: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """(keys, problem, n): expected keys that are missing, observed ones that are extra or repeated. The expected keys are all combinations of the dimension tables, which are small."""
    expected = dimensions[0]
    for d in dimensions[1:]:
        expected = expected.crossJoin(d)
    counts = observed.groupBy(*keys).agg(F.count("*").alias("n"))
    missing = expected.join(counts, list(keys), "left_anti").select(*keys, F.lit("missing").alias("problem"), F.lit(0).cast("long").alias("n"))
    extra = counts.join(expected, list(keys), "left_anti").select(*keys, F.lit("extra").alias("problem"), "n")
    again = counts.where("n > 1").select(*keys, F.lit("repeated").alias("problem"), "n")
    return missing.unionByName(extra).unionByName(again)


def column_gaps(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """(keys, column_name, n, n_missing, all_missing) for each key and column with a null or NaN: n rows of the key, those without a value, and whether the column has none in the whole table."""
    gone = lambda c: F.col(c).isNull() | (F.isnan(c) if kinds[c] in ("double", "float") else F.lit(False))
    kinds = dict(df.dtypes)
    each = df.groupBy(*keys).agg(F.count("*").alias("n"), *[F.count_if(gone(c)).alias(c) for c in columns])
    long = each.unpivot([F.col(k) for k in [*keys, "n"]], [F.col(c) for c in columns], "column_name", "n_missing")
    whole = long.groupBy("column_name").agg((F.sum("n") == F.sum("n_missing")).alias("all_missing"))  # a row for each column
    return long.where("n_missing > 0").join(F.broadcast(whole), "column_name").select(*keys, "column_name", "n", "n_missing", "all_missing")


def jaccard(df: DataFrame, groups: Sequence[str], side: str, left: str, right: str, item: str) -> DataFrame:
    """Jaccard index of the item sets of two sides in each group; null if both are empty."""
    flags = df.where(F.col(side).isin(left, right)).groupBy(*groups, item).agg(F.max((F.col(side) == left).cast("int")).alias("_l"), F.max((F.col(side) == right).cast("int")).alias("_r"))
    return flags.groupBy(*groups).agg((F.sum(F.col("_l") * F.col("_r")) / F.count("*")).alias("jaccard"))


def diversity(df: DataFrame, groups: Sequence[str], pattern: str, length: int) -> DataFrame:
    """Mean pairwise Hamming distance in a group, from the base counts of each position instead of pairs."""
    sizes = df.groupBy(*groups).agg(F.count("*").alias("_n"))
    places = df.select(*groups, F.posexplode(F.split(F.substring(pattern, 1, length), "")).alias("_i", "_b")).where("_b <> ''")
    counts = places.groupBy(*groups, "_i", "_b").agg(F.count("*").alias("_c"))
    same = counts.groupBy(*groups).agg(F.sum(F.col("_c") * F.col("_c")).alias("_same"))
    return same.join(sizes, list(groups)).select(*groups, F.try_divide(length * F.col("_n") * F.col("_n") - F.col("_same"), F.col("_n") * (F.col("_n") - 1)).alias("diversity"))


def aligned_best(archive: DataFrame, group: Sequence[str], search: str, call: str, pred: str) -> DataFrame:
    """Best prediction of each search within the calls that all searches of its group have made."""
    counts = archive.groupBy(*group, search).agg(F.max(call).alias("_calls"))
    common = counts.groupBy(*group).agg(F.min("_calls").alias("common_calls"))
    cut = archive.join(common, list(group)).where(F.col(call) <= F.col("common_calls"))
    return cut.groupBy(*group, search).agg(F.max("common_calls").alias("common_calls"), F.min(pred).alias("best"), F.min_by(call, F.struct(pred, call)).alias("best_call"))


def unequal_starts(archive: DataFrame, group: Sequence[str], search: str, call: str, key: str, model: str, is_start: Column) -> DataFrame:
    """(group, n_searches, n_unshared, n_models) of groups whose searches may not be compared: n_unshared starts (call, key) that not all searches have, or n_models fitted models other than one. Nulls are values."""
    sizes = archive.groupBy(*group).agg(F.countDistinct(search).alias("n_searches"), (F.countDistinct(model) + F.max(F.col(model).isNull().cast("int"))).alias("n_models"))
    shared = archive.where(is_start).groupBy(*group, call, key).agg(F.countDistinct(search).alias("_n"))
    found = join_null_safe(shared, sizes.select(*group, "n_searches"), group).groupBy(*group).agg(F.count_if(F.col("_n") < F.col("n_searches")).alias("n_unshared"))
    both = join_null_safe(sizes, found, group, "left").withColumn("n_unshared", F.coalesce("n_unshared", F.lit(0)))
    return both.where("n_unshared > 0 OR n_models <> 1").select(*group, "n_searches", "n_unshared", "n_models")
