"""Fits to rows of equal features as one, and splits that move no row."""

import random

import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from seqsieve.operators import screen, splits
from seqsieve.plans import model_queries as Q


@pytest.fixture(scope="module")
def repeated(spark):
    r = random.Random(4)
    rows = [(i, float(a := i % 6), float(z := r.randrange(5)), 3.0 * a - z * z + r.gauss(0, 0.5), float(r.randrange(1, 4))) for i in range(900)]
    return spark.createDataFrame(rows, "id long, x double, z double, y double, w double").cache()


def seen_by_trees(monkeypatch):
    seen, real = [], screen._for_trees
    monkeypatch.setattr(screen, "_for_trees", lambda df, columns: (seen.append(df.count()), real(df, columns))[1])
    return seen


@pytest.mark.parametrize("weight", [None, "w"])
def test_boosted_trees_are_those_of_all_rows(repeated, monkeypatch, weight):
    """every pass of the boosting read all rows, of which 30 have different features."""
    seen = seen_by_trees(monkeypatch)
    made = VectorAssembler(inputCols=["x", "z"], outputCol="_x").transform(repeated.withColumn("_y", F.col("y")))
    plain = screen.estimator("gbt")
    plain = (plain.setWeightCol(weight) if weight else plain).fit(made)
    want = {r["id"]: r["prediction"] for r in plain.transform(made).collect()}
    got = {r["id"]: r["pred"] for r in screen.predict(screen.fit(repeated, ["x", "z"], "y", "gbt", weight=weight), repeated, ["x", "z"]).collect()}
    assert seen == [30] and got == pytest.approx(want, abs=1e-9)


def test_a_bag_is_merged_in_one_pass(repeated, monkeypatch):
    seen = seen_by_trees(monkeypatch)
    bag = repeated.withColumn("member", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("w", ((F.col("id") + F.col("member")) % 3).cast("double"))
    models = screen.bagged_models(bag, ["x", "z"], "y", "gbt", 2, "w")
    assert len(seen) == 2 and max(seen) <= 30
    for m, model in enumerate(models):
        made = VectorAssembler(inputCols=["x", "z"], outputCol="_x").transform(bag.where(f"member = {m} AND w > 0").withColumn("_y", F.col("y")))
        want = {r["id"]: r["prediction"] for r in screen.estimator("gbt", m).setWeightCol("w").fit(made).transform(made).collect()}
        got = {r["id"]: r["pred"] for r in screen.predict(model, repeated, ["x", "z"]).collect()}
        assert all(got[i] == pytest.approx(p, abs=1e-9) for i, p in want.items())


def test_a_null_target_is_refused(repeated):
    holed = repeated.withColumn("y", F.when(F.col("id") > 0, F.col("y")))
    assert screen.merged(holed, ["x", "z"], "y").where("y IS NULL").count() == 1
    with pytest.raises(Exception, match="null|Null|NULL"):
        screen.fit(holed, ["x", "z"], "y", "gbt")


@pytest.mark.parametrize("share", [0.0, 0.3, 1.0])
def test_a_split_numbers_no_rows(spark, monkeypatch, share):
    """all columns of every seed's rows were sorted, written and joined to mark the first of them."""
    df = splits.with_seeds(spark.range(997).withColumnRenamed("id", "k"), [1, 2, None])
    want = {(r["seed"], r["k"]): r["rn"] <= -(-r["n"] * share // 1) for r in splits.by_order(df, "k").collect()}
    monkeypatch.setattr(splits, "numbered", None)
    got = {(r["seed"], r["k"]): r["role"] == "test" for r in splits.train_test(df, "k", share).collect()}
    assert got == want


def test_a_split_of_equal_keys_keeps_its_size(spark):
    df = spark.range(40).select(F.lit(1).alias("seed"), (F.col("id") % 4).alias("k"))
    assert splits.train_test(df, "k", 0.3).where("role = 'test'").count() == 12


@pytest.mark.parametrize("name", ["m13_grid", "m21_block_gain"])
def test_seeds_are_not_written(spark, monkeypatch, name):
    """the table was written once for each seed, with every column."""
    from seqsieve.plans import materialise as m

    sizes, real = [], m.materialise
    for module in (Q, splits, screen):
        monkeypatch.setattr(module, "materialise", lambda df: (sizes.append((out := real(df)).count()), out)[1])
    from seqsieve.plans.catalogue import QUERIES
    from seqsieve.sources.views import view

    small = "/root/testdata/sf0.001"
    n = view(spark, small, "features").count()
    assert QUERIES[name](spark, small).count() == (6 if name == "m13_grid" else 2)
    assert sizes.count(n) == 1 and all(s <= 1.4 * n for s in sizes)  # of both seeds at most the different training rows


def test_forests_grow_together(spark, monkeypatch):
    """five forests were five fits of row objects that didn't fit memory; now a level of all of them is one pass over bins."""
    from seqsieve.operators import forest

    r = random.Random(5)
    rows = [(i, r.randrange(40), r.random(), r.random(), r.randrange(3)) for i in range(2000)]
    df = spark.createDataFrame([(i, a, b, c, float(d), 2.0 * a + 30 * b + 3 * d + r.gauss(0, 1)) for i, a, b, c, d in rows], "id long, a long, b double, c double, d double, y double")
    names = list("abcd")
    edges = forest.bin_edges(df, names)
    assert edges["d"] == [0.0, 1.0] and all(len(e) <= 31 for e in edges.values())
    bins = forest.binned(df.select("y", F.xxhash64("id").alias("u"), *names), edges, {f: f"bin_{f}" for f in names}, "y double, u long").withColumnsRenamed({f"bin_{f}": f for f in names})
    first, again, part = forest.forest_importances(bins.repartition(3), [names, names, ["c", "d"]], "y", "u")
    want = screen.tree_importance(df, names, "y").collect()
    for i, x in enumerate(want):
        assert first[i] == pytest.approx(x["score"], abs=0.05) and again[i] == pytest.approx(first[i], abs=0.05)
    assert sum(first) == pytest.approx(1) and list(first) != list(again) and sum(part) == pytest.approx(1)
    same = forest.forest_importances(bins.coalesce(1), [names], "y", "u")[0]
    assert list(same) == pytest.approx(list(first), abs=1e-3)  # sums in another order decide near ties
    with pytest.raises(Exception, match="null or NaN"):
        forest.forest_importances(bins.withColumn("a", F.lit(None).cast("byte")), [names], "y", "u")
    monkeypatch.setattr(screen, "fit", None)
    assert screen.shadow_selection(df, names, "y", "id")
