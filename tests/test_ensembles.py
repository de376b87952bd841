"""Spread of ensembles against their members one by one."""

import random

import pytest
from pyspark.sql import functions as F

from seqsieve.operators import screen, selection


@pytest.fixture(scope="module")
def table(spark):
    r = random.Random(6)
    rows = [(i, x := r.random(), z := r.random(), 3 * x - z * z + r.gauss(0, 0.1)) for i in range(300)]
    return spark.createDataFrame(rows, "id int, x double, z double, y double").cache()


def by_hand(models, table):
    each = [{r["id"]: r["pred"] for r in screen.predict(m, table, ["x", "z"]).collect()} for m in models]
    for i in each[0]:
        v = [e[i] for e in each]
        mean = sum(v) / len(v)
        yield i, mean, (sum((a - mean) ** 2 for a in v) / len(v)) ** 0.5


def test_forest_spread(table):
    forest = screen.fit(table, ["x", "z"], "y", "rf").setFeaturesCol("_x")
    got = {r["id"]: r for r in screen.forest_spread(forest, table, ["x", "z"]).collect()}
    whole = {r["id"]: r["pred"] for r in screen.predict(forest, table, ["x", "z"]).collect()}
    assert len(forest.trees) == 30 and set(got[0].asDict()) == {"id", "x", "z", "y", "pred", "sigma"}
    trees = [t.setFeaturesCol("_x") for t in forest.trees[:]]
    for i, mean, sigma in by_hand(trees[:30], table.where("id < 20")):
        assert got[i]["pred"] == pytest.approx(mean) == pytest.approx(whole[i]) and got[i]["sigma"] == pytest.approx(sigma)


def test_boosted_members(table):
    bag = table.withColumn("member", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("weight", ((F.col("id") + F.col("member")) % 3).cast("double"))
    models = screen.bagged_models(bag.where("weight > 0"), ["x", "z"], "y", "gbt", 2)
    got = {r["id"]: r for r in screen.ensemble_spread(models, table, ["x", "z"]).collect()}
    for i, mean, sigma in by_hand(models, table):
        assert got[i]["pred"] == pytest.approx(mean) and got[i]["sigma"] == pytest.approx(sigma)
    assert max(r["sigma"] for r in got.values()) > 0


def test_grouped_batch_ranks_only_heads(table):
    pool = table.withColumn("g", F.when(F.col("id") % 10 == 0, "small").when(F.col("id") % 7 > 0, "large"))
    got = selection.grouped_batch(pool, "g", 80, "y", "id")
    rows = {(r["g"], r["pick"]): r["id"] for r in got.collect()}
    for g, quota in (("small", 30), ("large", 50)):
        want = [r["id"] for r in pool.where(F.col("g") == g).orderBy("y", "id").limit(quota).collect()]
        assert [rows[g, i] for i in range(1, quota + 1)] == want
    assert len(rows) == 80 and "WindowGroupLimit" in got._jdf.queryExecution().executedPlan().toString()
