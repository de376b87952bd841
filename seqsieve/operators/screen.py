"""Feature screening, model fits on MLlib, and rank fusion."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from functools import reduce
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.ml import Model
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqsieve.operators.forest import bin_edges, binned, forest_importances
from seqsieve.operators.metrics import correlation, spearman
from seqsieve.operators.ranking import seeded_order, with_ranks
from seqsieve.plans.materialise import free_name, materialise


def unpivot(df: DataFrame, features: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """(keep, feature, value) in long form."""
    return df.unpivot([F.col(c) for c in keep], [F.col(c).cast("double").alias(c) for c in features], "feature", "value")


def variances(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """(feature, score): sample variance."""
    one = df.agg(*[F.var_samp(c).alias(c) for c in features])
    return unpivot(one.withColumn("_", F.lit(0)), features, ["_"]).select("feature", F.col("value").alias("score"))


def f_scores(df: DataFrame, features: Sequence[str], target: str) -> DataFrame:
    """(feature, score): F statistic of a simple regression, (n - 2) r^2 / (1 - r^2); its order is that of -log10 p."""
    one = df.agg(F.count("*").alias("_n"), *[correlation(c, target).alias(c) for c in features])
    r2 = F.col("value") * F.col("value")
    return unpivot(one, features, ["_n"]).select("feature", F.try_divide((F.col("_n") - 2) * r2, 1 - r2).alias("score"))


def half_step(a: Column) -> Column:
    """log gamma(a + 1/2) - log gamma(a) of a positive number, by its asymptotic series at a + 12."""
    x = a + 12
    # The series in odd powers of 1 / x.
    tail = sum(c / F.pow(x, F.lit(float(k))) for k, c in ((1, -1 / 8), (3, 1 / 192), (5, -1 / 640), (7, 17 / 14336), (9, -31 / 18432)))
    return 0.5 * F.log(x) + tail - sum(F.log1p(0.5 / (a + i)) for i in range(12))


def f_tail_log(r2: Column, freedom: Column) -> Column:
    """log p of the F statistic freedom * r2 / (1 - r2) with 1 and freedom degrees, the share r2 being explained: minus infinity for r2 = 1, null without freedom.

    p is the regularised incomplete beta function of 1 - r2 with a = freedom / 2 and 1/2, from
    its continued fraction in logarithms, so nothing underflows; where r2 is small it is 1 less
    the same function of r2 with the parameters changed. The fraction takes some sqrt(a) steps.
    """
    a, half = freedom / 2.0, F.lit(0.5)
    front = half_step(a) - 0.5 * math.log(math.pi)  # minus log of the beta function

    def fraction(x: Column, p: Column, q: Column, steps: Column) -> Column:
        """Lentz's product for the function of x with parameters p and q."""
        start = 1 / (1 - (p + q) * x / (p + 1))

        def turn(s: Column, m: Column) -> Column:
            def one(s: Column, k: Column) -> Column:
                d, c = 1 / (1 + k * s["d"]), 1 + k / s["c"]
                return F.struct(c.alias("c"), d.alias("d"), (s["h"] * d * c).alias("h"))

            even = m * (q - m) * x / ((p + 2 * m - 1) * (p + 2 * m))
            odd = -(p + m) * (p + q + m) * x / ((p + 2 * m) * (p + 2 * m + 1))
            return one(one(s, even), odd)

        return F.aggregate(F.sequence(F.lit(1), steps), F.struct(F.lit(1.0).alias("c"), start.alias("d"), start.alias("h")), turn, lambda s: s["h"])

    steps = (60 + 4 * F.sqrt(a)).cast("int")
    x = 1 - r2
    tail = a * F.log1p(-r2) + 0.5 * F.log(r2) + front - F.log(a) + F.log(fraction(x, a, half, steps))
    body = F.exp(0.5 * F.log(r2) + a * F.log1p(-r2) + front + math.log(2.0)) * fraction(r2, half, a, steps)
    log_p = F.when(x < (a + 1) / (a + 2.5), tail).otherwise(F.log1p(-body))
    return F.when(freedom > 0, F.when(r2 >= 1, float("-inf")).when(r2 <= 0, 0.0).otherwise(log_p))


def f_log_p(df: DataFrame, features: Sequence[str], target: str) -> DataFrame:
    """(feature, f, score): the F statistic of a simple regression and -log10 of its p; null without variance, and no p is too small to rank."""
    one = df.agg(F.count("*").alias("_n"), *[correlation(c, target).alias(c) for c in features])
    long = unpivot(one, features, ["_n"]).select("feature", (F.col("value") * F.col("value")).alias("_r2"), (F.col("_n") - 2).cast("double").alias("_free"))
    return long.select("feature", F.try_divide(F.col("_free") * F.col("_r2"), 1 - F.col("_r2")).alias("f"), (-f_tail_log(F.col("_r2"), F.col("_free")) / math.log(10)).alias("score"))


def spearman_scores(df: DataFrame, features: Sequence[str], target: str) -> DataFrame:
    """(feature, score): absolute rank correlation with the target; 0 without variance."""
    long = unpivot(df, features, [target])
    return spearman(long, ["feature"], target, "value", degenerate=0.0).select("feature", F.abs("spearman").alias("score"))


def information_scores(df: DataFrame, features: Sequence[str], target: str, bins: int = 8) -> DataFrame:
    """(feature, score): mutual information in nats of equal-frequency bins of feature and target. The estimator is by bins, not by neighbours."""
    ranked = with_ranks(unpivot(df, features, [target]), {"_x": "value", "_y": target}, ["feature"], first="_least", total="_n")
    cut = lambda c: F.floor((F.col(c) - 1) * bins / F.col("_n"))
    cells = ranked.select("feature", cut("_least_x").alias("x"), cut("_least_y").alias("y")).groupBy("feature", "x", "y").agg(F.count("*").alias("n"))
    over = lambda *k: F.sum("n").over(Window.partitionBy("feature", *k))
    p = cells.withColumn("t", F.col("n") / over() * F.log(F.col("n") * over() / (over("x") * over("y"))))
    return p.groupBy("feature").agg(F.sum("t").alias("score"))


def top_features(scores: DataFrame, k: int, forced: Sequence[str] = ()) -> DataFrame:
    """(feature, score): the k best, ties by name; forced ones always stand and take slots from the tail."""
    must = F.col("feature").isin(list(forced)) if forced else F.lit(False)
    return scores.orderBy(F.desc(must), F.desc("score"), "feature").limit(max(k, len(forced)))


def stable_features(chosen: DataFrame, folds: int, share: float, keys: Sequence[str] = ("seed", "method")) -> DataFrame:
    """Features that stand in ceil(folds * share) or more folds."""
    return chosen.groupBy(*keys, "feature").agg(F.countDistinct("fold").alias("n_folds")).where(F.col("n_folds") >= F.ceil(F.lit(folds * share)))


def estimator(name: str, seed: int = 0):
    """The learners that stand in for the original ones: rf, gbt, linear, lasso."""
    common = {"featuresCol": "_x", "labelCol": "_y"}
    return {
        "rf": lambda: RandomForestRegressor(**common, numTrees=30, maxDepth=6, seed=seed),
        "gbt": lambda: GBTRegressor(**common, maxIter=15, maxDepth=3, stepSize=0.2, seed=seed),
        "linear": lambda: LinearRegression(**common, regParam=0.0, solver="normal"),
        "lasso": lambda: LinearRegression(**common, regParam=0.02, elasticNetParam=1.0),
    }[name]()


#: Rows of a task that fits trees; MLlib holds some 300 bytes a row of them.
FIT_ROWS = 500_000
#: Rows below which a task of its own doesn't pay.
LEAST_ROWS = 20_000


def merged(df: DataFrame, features: Sequence[str], target: str, weight: str | None = None, keys: Sequence[str] = (), name: str = "weight") -> DataFrame:
    """(keys, features, target, name): rows of equal features (and keys) as one, with their mean target and the sum of their weights, or their number.

    A split of a squared loss, the mean of a leaf and least squares depend on these sums alone, so
    a fit to them is the fit to all rows. A null target or weight makes that of its row null, which a fit refuses.
    """
    y, w = F.col(target).cast("double"), F.col(weight).cast("double") if weight else F.lit(1.0)
    bad = F.count_if((y * w).isNull()) > 0
    sums = df.groupBy(*dict.fromkeys([*keys, *features])).agg((F.sum(w * y) / F.sum(w)).alias("_mean"), F.sum(w).alias("_sum"), bad.alias("_bad"))
    known = lambda c: F.when(~F.col("_bad"), F.col(c))
    return sums.where("_bad OR _sum <> 0").select(*dict.fromkeys([*keys, *features]), known("_mean").alias(target), known("_sum").alias(name))


def _for_trees(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The columns of df as a written table, as trees are fitted in many passes, in tasks of some FIT_ROWS rows; smaller tables are spread as well."""
    rows = materialise(df.select(*dict.fromkeys(columns)))
    n = rows.count()
    parts = max(-(-n // FIT_ROWS), min(rows.sparkSession.sparkContext.defaultParallelism, n // LEAST_ROWS))
    if parts < 2:
        return rows
    at = free_name(rows, "_spread")
    return rows.withColumn(at, F.monotonically_increasing_id()).repartition(parts, at).drop(at)


def fit(df: DataFrame, features: Sequence[str], target: str, learner: str, seed: int = 0, weight: str | None = None) -> Model:
    """A model fitted to all rows of df. Trees are fitted to rows of equal features as one, so a forest draws these together."""
    df = df.withColumn("_y", F.col(target).cast("double"))
    if learner in ("rf", "gbt"):
        df, weight = _for_trees(merged(df, features, "_y", weight, name="_weight"), [*features, "_y", "_weight"]), "_weight"
    made = VectorAssembler(inputCols=list(features), outputCol="_x").transform(df)
    e = estimator(learner, seed)
    return (e.setWeightCol(weight) if weight else e).fit(made)


def predict(model: Model, df: DataFrame, features: Sequence[str], name: str = "pred") -> DataFrame:
    made = VectorAssembler(inputCols=list(features), outputCol="_x").transform(df)
    return model.transform(made).withColumnRenamed("prediction", name).drop("_x")


def _with_members(models: Sequence[Model], df: DataFrame, features: Sequence[str]) -> tuple[DataFrame, Column]:
    """df with a prediction of each model, all in one pass over its rows, and the array of them."""
    made = VectorAssembler(inputCols=list(features), outputCol="_x").transform(df)
    for i, model in enumerate(models):
        made = model.copy().setFeaturesCol("_x").setPredictionCol(f"_m{i}").transform(made)
    return made, F.array(*[F.col(f"_m{i}") for i in range(len(models))])


def ensemble_spread(models: Sequence[Model], df: DataFrame, features: Sequence[str], mean: str = "pred", sigma: str = "sigma") -> DataFrame:
    """df with the mean and the deviation (ddof 0) of the models' predictions; nothing is shuffled, and a row with a null feature is an error, as in a single prediction."""
    made, values = _with_members(models, df, features)
    centre = F.aggregate(values, F.lit(0.0), lambda a, x: a + x) / len(models)
    gaps = F.aggregate(values, F.lit(0.0), lambda a, x: a + (x - F.col(mean)) * (x - F.col(mean)))
    out = made.withColumn(mean, centre).withColumn(sigma, F.sqrt(gaps / len(models)))
    return out.drop("_x", *[f"_m{i}" for i in range(len(models))])


def forest_spread(model: Model, df: DataFrame, features: Sequence[str], mean: str = "pred", sigma: str = "sigma") -> DataFrame:
    """df with a fitted forest's prediction and the deviation of its trees' predictions, tree by tree in one pass."""
    return ensemble_spread(model.trees, df, features, mean, sigma)


def bagged_models(bag: DataFrame, features: Sequence[str], target: str, learner: str, members: int, weight: str = "weight", seed: int = 0) -> list[Model]:
    """A model for each member from 0 on of a bag (member, weight, ...), fitted with its weights and a seed of its own. Trees take in the bag in one pass."""
    if learner in ("rf", "gbt"):
        bag = materialise(merged(bag, features, target, weight, ["member"], weight))
    return [fit(bag.where(F.col("member") == m), features, target, learner, seed + m, weight) for m in range(members)]


def out_of_fold(df: DataFrame, features: Sequence[str], target: str, learner: str, folds: int, keep: Sequence[str]) -> DataFrame:
    """(keep, pred): each row scored by the model of the other folds (df has fold)."""
    parts = [predict(fit(df.where(F.col("fold") != k), features, target, learner), df.where(F.col("fold") == k), features).select(*keep, "pred") for k in range(folds)]
    return reduce(DataFrame.unionByName, parts)


def tree_importance(df: DataFrame, features: Sequence[str], target: str) -> DataFrame:
    """(feature, score): a random forest's importances, one number per feature."""
    found = fit(df, features, target, "rf").featureImportances.toArray().tolist()
    return df.sparkSession.createDataFrame(list(zip(features, found, strict=True)), "feature string, score double")


def lasso_selection(df: DataFrame, features: Sequence[str], target: str, fallback: int = 3) -> DataFrame:
    """(feature, score): features with a non-zero L1 coefficient on standardised columns; if there are none, the fallback best by F."""
    spread = df.agg(*[F.coalesce(F.stddev_samp(f), F.lit(0.0)).alias(f) for f in features]).first()
    weights = fit(df, features, target, "lasso").coefficients.toArray().tolist()  # on the columns' own scales
    found = [(f, abs(c) * spread[f]) for f, c in zip(features, weights, strict=True) if c]
    return df.sparkSession.createDataFrame(found, "feature string, score double") if found else top_features(f_scores(df, features, target), fallback)


def permuted(df: DataFrame, features: Sequence[str], keep: Sequence[str], key: str, copies: int, block: int = 1 << 15) -> DataFrame:
    """The features and keep of df with permuted copies of each feature, p{copy}_{number of the feature}, as a written table.

    One shuffle makes random blocks of about block rows by the hash of the key, which tells rows
    apart; each block's values change places at random, for every copy and feature anew. Which
    they are depends on keys alone. So all rows stand in every copy, and none is sorted or
    joined over the whole table.
    """
    features, keep = list(features), [c for c in dict.fromkeys(keep) if c not in features]
    rows = materialise(df.select(*dict.fromkeys([key, *features, *keep])))
    blocks = max(1, -(-rows.count() // block))
    place = free_name(rows, "_block")
    made = [(r, i, f"p{r}_{i}") for r in range(copies) for i in range(len(features))]
    out = rows.select(*features, *keep, *[F.col(features[i]).alias(name) for _, i, name in made]).schema
    names = out.names

    def run(rows: pa.Table) -> pa.Table:
        at = rows[place][0].as_py()
        rows = rows.drop_columns([place]).combine_chunks().sort_by(key)
        columns = [rows[c] for c in (*features, *keep)]
        for r, i, _ in made:
            columns.append(rows[features[i]].take(pa.array(np.random.default_rng([r, i, at]).permutation(len(rows)))))
        return pa.Table.from_arrays(columns, names=names)

    dealt = rows.withColumn(place, F.pmod(F.conv(F.substring(seeded_order(F.lit("block"), F.col(key)), 1, 15), 16, 10).cast("long"), F.lit(blocks)))
    return materialise(dealt.groupBy(place).applyInArrow(run, out))


def permutation_importance(df: DataFrame, features: Sequence[str], target: str, learner: str, repeats: int, key: str) -> DataFrame:
    """(feature, score): mean rise of the squared error when a column is permuted, all columns and repeats in one pass."""
    features = list(features)
    rows = permuted(df, features, [target], key, repeats)
    model = fit(rows, features, target, learner)
    made, errors = rows, []
    for i, r in [(None, 0), *product(range(len(features)), range(repeats))]:
        x, name = f"_x{i}_{r}", f"_e{i}_{r}"
        inputs = [f"p{r}_{i}" if i == j else f for j, f in enumerate(features)]
        made = model.copy().setFeaturesCol(x).setPredictionCol(name).transform(VectorAssembler(inputCols=inputs, outputCol=x).transform(made)).drop(x)
        errors.append(F.avg((F.col(name) - F.col(target)) * (F.col(name) - F.col(target))).alias(name))
    one = made.agg(*errors)
    rises = [F.struct(F.lit(f).alias("feature"), (sum(F.col(f"_e{i}_{r}") for r in range(repeats)) / F.lit(float(repeats)) - F.col("_eNone_0")).alias("score")) for i, f in enumerate(features)]
    return one.select(F.inline(F.array(*rises)))


def shadow_selection(df: DataFrame, features: Sequence[str], target: str, key: str, rounds: int = 5, level: float = 0.05) -> list[str]:
    """Features whose importance beats the best shadow (permuted copy) often enough: binomial tail below level. Features are binned before they are copied, and the forests of all rounds grow together."""
    from math import comb

    features = list(features)
    hits = dict.fromkeys(features, 0)
    read = materialise(df.select(*dict.fromkeys([key, *features, target])))
    edges = bin_edges(read, features)
    names = [f"_b{i}" for i in range(len(features))]
    given = read.select(F.col(key).alias("_key"), F.col(target).cast("double").alias("_y"), F.xxhash64(key).alias("_row"), *[F.col(f).alias(f"_v{i}") for i, f in enumerate(features)])
    by = {f"_v{i}": edges[f] for i, f in enumerate(features)}
    bins = binned(given, by, dict(zip(by, names, strict=True)), f"_key {dict(given.dtypes)['_key']}, _y double, _row long")
    rows = permuted(bins, names, ["_y", "_row"], "_key", rounds)
    inputs = [[*names, *[f"p{r}_{i}" for i in range(len(features))]] for r in range(rounds)]
    for found in forest_importances(rows, inputs, "_y", "_row"):
        bar = max(found[len(features) :])
        for f, x in zip(features, found, strict=False):
            hits[f] += bool(x > bar)
    tail = lambda h: sum(comb(rounds, i) for i in range(h, rounds + 1)) / 2**rounds
    chosen = [f for f in features if tail(hits[f]) < level]
    return chosen or sorted(features, key=lambda f: (-hits[f], f))[:3]


def held_out_score(df: DataFrame, features: Sequence[str], target: str, learner: str, fold: str = "fold", held: int = 0) -> float:
    """1 - mean squared error / variance on the held fold, of a model of the other folds; minus infinity without rows on a side."""
    model = fit(df.where(F.col(fold) != held), features, target, learner)
    rest = predict(model, df.where(F.col(fold) == held), features)
    found = rest.agg((1 - F.try_divide(F.avg((F.col("pred") - F.col(target)) * (F.col("pred") - F.col(target))), F.var_pop(target))).alias("r2")).first()["r2"]
    return float("-inf") if found is None else found


def forward_selection(features: Sequence[str], k: int, score: Callable[[list[str]], float]) -> list[str]:
    """k features in the order of their choice: each round the one whose addition scores best, ties to the smaller name. A bounded loop of fits that run on Spark."""
    chosen: list[str] = []
    while len(chosen) < min(k, len(features)):
        chosen.append(max(sorted(set(features) - set(chosen)), key=lambda f: score([*chosen, f])))
    return chosen


def backward_selection(features: Sequence[str], k: int, score: Callable[[list[str]], float]) -> list[str]:
    """k features, sorted: each round the one goes without which the others score best, ties to the smaller name."""
    left = sorted(features)
    while len(left) > max(1, k):
        left.remove(max(left, key=lambda f: score([x for x in left if x != f])))
    return left


def recursive_elimination(df: DataFrame, features: Sequence[str], target: str, k: int, learner: str = "linear") -> list[str]:
    """k features, sorted: each round a model of those left is fitted and the least important goes, by the forest's importance or the standardised coefficient; ties to the larger name."""
    spread = df.agg(*[F.coalesce(F.stddev_samp(f), F.lit(0.0)).alias(f) for f in features]).first()
    left = sorted(features)
    while len(left) > max(1, k):
        model = fit(df, left, target, learner)
        weights = model.coefficients.toArray() if learner in ("linear", "lasso") else model.featureImportances.toArray()
        size = {f: abs(w) * (spread[f] if learner in ("linear", "lasso") else 1.0) for f, w in zip(left, weights, strict=True)}
        left.remove(min(reversed(left), key=lambda f: size[f]))
    return left


def mean_fusion(predictions: Sequence[str]) -> Column:
    """Mean of several models' predictions; null if any is."""
    return sum(map(F.col, predictions)) / F.lit(float(len(predictions)))


def rank_fusion(df: DataFrame, groups: Sequence[str], scores: Sequence[str], weights: Sequence[float] | None = None, name: str = "fused") -> DataFrame:
    """df with the mean (or weighted mean) of the average ranks of several scores in a group, however large."""
    w = weights or [1.0] * len(scores)
    ranks = {f"_rank{i}": c for i, c in enumerate(scores)}
    total = sum(F.col(r) * F.lit(float(x)) for r, x in zip(ranks, w, strict=True))
    return with_ranks(df, ranks, groups).withColumn(name, total / F.lit(float(sum(w)))).drop(*ranks)


def fusion_weights(df: DataFrame, groups: Sequence[str], scores: Sequence[str], truth: str, steps: int = 4, penalty: float = 0.05) -> DataFrame:
    """Per group the weights on a grid of the simplex that minimise -Spearman + penalty |w|^2. All grid points are scored at once: the Spearman of a weighted rank sum needs its ranks, so each grid point is a row group."""
    grid = [w for w in product(range(steps + 1), repeat=len(scores)) if sum(w) == steps]
    points = F.array(*[F.struct(F.lit(i).alias("point"), F.array(*[F.lit(x / steps) for x in w]).alias("w")) for i, w in enumerate(grid)])
    ranked = with_ranks(df.select(*groups, truth, *scores), {f"_r{i}": c for i, c in enumerate(scores)}, groups)
    each = ranked.withColumn("g", F.explode(points)).select(*groups, truth, "g.point", "g.w", sum(F.get("g.w", i) * F.col(f"_r{i}") for i in range(len(scores))).alias("fused"))
    found = spearman(each, [*groups, "point"], truth, "fused", degenerate=0.0)
    named = F.broadcast(df.sparkSession.createDataFrame([(i, [x / steps for x in w]) for i, w in enumerate(grid)], "point int, weights array<double>"))
    loss = -F.col("spearman") + penalty * F.aggregate("weights", F.lit(0.0), lambda a, x: a + x * x)
    return found.join(named, "point").withColumn("loss", F.round(loss, 9)).groupBy(*groups).agg(F.min(F.struct("loss", "point", "weights", "spearman")).alias("b")).select(*groups, "b.weights", "b.spearman")


def residual_ridge(df: DataFrame, groups: Sequence[str], base: str, second: str, truth: str, alpha: float = 100.0) -> DataFrame:
    """(groups, slope, intercept): one-variable ridge of the residual truth - base on the centred second score."""
    s, r = F.col(second), F.col(truth) - F.col(base)
    n, sx, sr = F.count("*"), F.sum(s), F.sum(r)
    slope = (F.sum(s * r) - sx * sr / n) / (F.sum(s * s) - sx * sx / n + alpha)
    return df.groupBy(*groups).agg(slope.alias("slope"), (sr / n - slope * sx / n).alias("intercept"))


def overlap(candidates: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """One row (n, n_distinct, n_shared): candidates, their different keys, and how many of those are known; null keys count as rows only."""
    keys = candidates.groupBy(key).agg(F.count("*").alias("_n"))
    held = known.where(F.col(key).isNotNull()).select(key).distinct().withColumn("_held", F.lit(True))
    sums = keys.join(held, key, "left").agg(F.sum("_n").alias("n"), F.count(key).alias("n_distinct"), F.count("_held").alias("n_shared"))
    return sums.select(F.coalesce("n", F.lit(0)).alias("n"), "n_distinct", "n_shared")
